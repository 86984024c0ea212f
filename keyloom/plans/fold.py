"""Order-dependent logs: a reducer for one key, and its distributed fold over a log.

The reducer is plain Python, shared with streaming. The batch fold sorts each shuffle partition by (key,
position) and streams it, so only the state of the current key is held, whatever the length of its log.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.functions.parse import clamp, parse_float, parse_int, wrap
from keyloom.model import REPLY

WRONGTYPE = "WRONGTYPE Operation against a key holding the wrong kind of value"
NOT_INT = "ERR value is not an integer or out of range"
NO_KEY = "ERR key is required"
SYNTAX = "ERR syntax error"
#: Longest time to live, in microseconds and whole seconds: what fits in 64 bits of nanoseconds. More is out of range.
MAX_TTL_US = (2**63 - 1) // 1_000
MAX_TTL_S = MAX_TTL_US // 1_000_000

#: (least, most, step) of arguments per command; most None: no limit; step: what exceeds least comes in such steps.
ARITY = {
    "PING": (0, 1, 1), "SET": (2, None, 1), "SETEX": (3, 3, 1), "GET": (1, 1, 1), "DEL": (1, None, 1), "EXISTS": (1, None, 1), "TYPE": (1, 1, 1), "EXPIRE": (2, 2, 1),
    "TTL": (1, 1, 1), "INCR": (1, 1, 1), "HSET": (3, None, 2), "HGET": (2, 2, 1), "HDEL": (2, None, 1), "HGETALL": (1, 1, 1), "LPUSH": (2, None, 1), "RPUSH": (2, None, 1),
    "LPOP": (1, 1, 1), "RPOP": (1, 1, 1), "LRANGE": (3, 3, 1), "SADD": (2, None, 1), "SREM": (2, None, 1), "SMEMBERS": (1, 1, 1), "SISMEMBER": (2, 2, 1), "SCARD": (1, 1, 1),
    "ZADD": (3, None, 2), "ZCARD": (1, 1, 1), "ZRANGE": (3, 3, 1), "ZREMRANGEBYSCORE": (3, 3, 1), "PUBLISH": (2, 2, 1),
}
TYPE_OF = {"INCR": "string", "GET": "string"} | {c: t for t, cs in {"hash": "HSET HGET HDEL HGETALL", "list": "LPUSH RPUSH LPOP RPOP LRANGE", "set": "SADD SREM SMEMBERS SISMEMBER SCARD", "zset": "ZADD ZCARD ZRANGE ZREMRANGEBYSCORE"}.items() for c in cs.split()}
#: Commands of any number of keys; each key's part is folded alone.
MANY = {"DEL", "EXISTS"}
#: Commands on a key whose empty name is no error.
ANY_NAME = {"DEL", "EXISTS", "TYPE", "EXPIRE", "TTL"}

Reply = tuple[str, int | None, str | None, list[str] | None]


def integer(n: int) -> Reply:
    return ("int", n, None, None)


def bulk(s: str | None) -> Reply:
    return ("bulk", None, s, None) if s is not None else ("nil", None, None, None)


def simple(s: str) -> Reply:
    return ("simple", None, s, None)


def error(s: str) -> Reply:
    return ("error", None, s, None)


def array(xs) -> Reply:
    return ("array", None, None, list(xs))


def arity_error(cmd: str, n: int) -> bool:
    least, most, step = ARITY[cmd]
    return n < least or (most is not None and n > most) or (n - least) % step != 0


@dataclass
class Entry:
    type: str
    value: object
    expires: int | None = None
    created: int = 0
    updated: int = 0


@dataclass
class Key:
    """State of one key; step() applies a command at a time and returns its reply."""

    entry: Entry | None = None

    def live(self, now: int) -> Entry | None:
        if self.entry is not None and self.entry.expires is not None and now >= self.entry.expires:
            self.entry = None
        return self.entry

    def step(self, cmd: str, name: str, rest: list[str], now: int) -> Reply:
        """rest: the arguments after the key. Arity is checked before."""
        act = getattr(self, "_" + cmd.lower())
        if cmd in TYPE_OF:
            args = self._numbers(cmd, rest)
            if isinstance(args, tuple):
                return args
            if name == "":
                return error(NO_KEY)
            e = self.live(now)
            if e is not None and e.type != TYPE_OF[cmd]:
                return error(WRONGTYPE)
            out = act(e, args, now)
            if self.entry is not None and self.entry.type != "string" and not self.entry.value:
                self.entry = None  # an emptied collection is gone, and its deadline with it
            return out
        return act(name, rest, now)

    @staticmethod
    def _numbers(cmd: str, rest: list[str]):
        """Arguments with numbers parsed, or the error of the first that isn't one."""
        if cmd in ("LRANGE", "ZRANGE"):
            bounds = [parse_int(x) for x in rest]
            return error(NOT_INT) if None in bounds else bounds
        if cmd == "ZADD":
            scores = [parse_float(x) for x in rest[::2]]
            return error("ERR value is not a valid float") if None in scores else list(zip(rest[1::2], scores, strict=True))
        if cmd == "ZREMRANGEBYSCORE":
            low, high = map(parse_float, rest)
            return error("ERR min is not a float") if low is None else error("ERR max is not a float") if high is None else [low, high]
        return rest

    def _make(self, kind: str, value, now: int) -> Entry:
        """The live entry, or a new one without deadline."""
        if self.entry is None:
            self.entry = Entry(kind, value, None, now, now)
        self.entry.updated = now
        return self.entry

    def _write(self, name: str, value: str, ttl: int | None, now: int) -> Reply:
        if name == "":
            return error(NO_KEY)
        old = self.live(now)
        self.entry = Entry("string", value, None if ttl is None else now + ttl, old.created if old else now, now)
        return simple("OK")

    def _set(self, name, rest, now):
        ttl, options = None, rest[1:]
        while options:
            unit = {"EX": 1_000_000, "PX": 1_000}.get(options[0].upper())
            if unit is None or len(options) < 2:
                return error(SYNTAX)
            n = parse_int(options[1])
            if n is None or n <= 0 or n * unit > MAX_TTL_US:
                return error(NOT_INT)
            ttl, options = n * unit, options[2:]
        return self._write(name, rest[0], ttl, now)

    def _setex(self, name, rest, now):
        n = parse_int(rest[0])
        if n is None or not 0 < n <= MAX_TTL_S:
            return error("ERR invalid expire time in 'SETEX' command")
        return self._write(name, rest[1], n * 1_000_000, now)

    def _del(self, name, rest, now):
        gone, self.entry = self.live(now) is not None, None
        return integer(int(gone))

    def _exists(self, name, rest, now):
        return integer(int(self.live(now) is not None))

    def _type(self, name, rest, now):
        e = self.live(now)
        return simple(e.type if e else "none")

    def _expire(self, name, rest, now):
        n = parse_int(rest[0])
        if n is None:
            return error(NOT_INT)
        if not 0 < n <= MAX_TTL_S:
            return error("ERR invalid expire time in 'EXPIRE' command")
        e = self.live(now)
        if e is None:
            return integer(0)
        e.expires, e.updated = now + n * 1_000_000, now
        return integer(1)

    def _ttl(self, name, rest, now):
        e = self.live(now)
        return integer(-2 if e is None else -1 if e.expires is None else (e.expires - now) // 1_000_000)

    def _get(self, e, rest, now):
        return bulk(e.value if e else None)

    def _incr(self, e, rest, now):
        n = 0 if e is None else parse_int(e.value)
        if n is None:
            return error(NOT_INT)
        self._make("string", "0", now).value = str(wrap(n + 1))
        return integer(wrap(n + 1))

    def _hset(self, e, rest, now):
        new = dict(zip(rest[::2], rest[1::2], strict=True))
        fields = self._make("hash", {}, now).value
        added = sum(f not in fields for f in new)
        fields.update(new)
        return integer(added)

    def _hget(self, e, rest, now):
        return bulk(e.value.get(rest[0]) if e else None)

    def _remove(self, e, names, now, pop):
        found = [x for x in dict.fromkeys(names) if e is not None and x in e.value]
        for x in found:
            pop(x)
        if found:
            e.updated = now
        return integer(len(found))

    def _hdel(self, e, rest, now):
        return self._remove(e, rest, now, lambda x: e.value.pop(x))

    def _hgetall(self, e, rest, now):
        return array(x for f in sorted(e.value, key=str.encode) for x in (f, e.value[f])) if e else array([])

    def _lpush(self, e, rest, now):
        items = self._make("list", deque(), now).value
        items.extendleft(rest)
        return integer(len(items))

    def _rpush(self, e, rest, now):
        items = self._make("list", deque(), now).value
        items.extend(rest)
        return integer(len(items))

    def _pop(self, e, now, take):
        if e is None:
            return bulk(None)
        e.updated = now
        return bulk(take(e.value))

    def _lpop(self, e, rest, now):
        return self._pop(e, now, deque.popleft)

    def _rpop(self, e, rest, now):
        return self._pop(e, now, deque.pop)

    def _lrange(self, e, bounds, now):
        if e is None:
            return array([])
        lo, hi = clamp(*bounds, len(e.value))
        return array(list(e.value)[lo : hi + 1] if lo <= hi else [])

    def _sadd(self, e, rest, now):
        members = self._make("set", {}, now).value
        n = len(members)
        members.update(dict.fromkeys(rest))
        return integer(len(members) - n)

    def _srem(self, e, rest, now):
        return self._remove(e, rest, now, lambda x: e.value.pop(x))

    def _smembers(self, e, rest, now):
        return array(sorted(e.value, key=str.encode) if e else [])

    def _sismember(self, e, rest, now):
        return integer(int(e is not None and rest[0] in e.value))

    def _scard(self, e, rest, now):
        return integer(len(e.value) if e else 0)

    _zcard = _scard

    def _zadd(self, e, pairs, now):
        scores = self._make("zset", {}, now).value
        n = len(scores)
        scores.update(pairs)
        return integer(len(scores) - n)

    def _zrange(self, e, bounds, now):
        if e is None:
            return array([])
        lo, hi = clamp(*bounds, len(e.value))
        ranked = sorted(e.value, key=lambda m: (math.isnan(e.value[m]), e.value[m] if not math.isnan(e.value[m]) else 0.0, m.encode()))
        return array(ranked[lo : hi + 1] if lo <= hi else [])

    def _zremrangebyscore(self, e, bounds, now):
        low, high = bounds
        return self._remove(e, [m for m, s in e.value.items() if low <= s <= high] if e else [], now, lambda x: e.value.pop(x))


OUT = f"seq bigint, pos bigint, sub bigint, parts boolean, reply {REPLY}, state struct<key:string,type:string,expires_at_us:bigint,created_at_us:bigint,updated_at_us:bigint,member:string,value:string,idx:bigint,score:double>, life struct<type:string,from_ts:bigint,from_seq:bigint,from_pos:bigint,to_ts:bigint,to_seq:bigint,to_pos:bigint,deadline:bigint>"
_REPLY = pa.struct([("kind", pa.string()), ("int", pa.int64()), ("str", pa.string()), ("arr", pa.list_(pa.string()))])
_STATE = pa.struct([("key", pa.string()), ("type", pa.string()), ("expires_at_us", pa.int64()), ("created_at_us", pa.int64()), ("updated_at_us", pa.int64()), ("member", pa.string()), ("value", pa.string()), ("idx", pa.int64()), ("score", pa.float64())])
_LIFE = pa.struct([("type", pa.string())] + [(n, pa.int64()) for n in ("from_ts", "from_seq", "from_pos", "to_ts", "to_seq", "to_pos", "deadline")])


def state_rows(name: str, e: Entry) -> Iterator[dict]:
    """One row per element: of a string its value, of a collection its members."""
    head = {"key": name, "type": e.type, "expires_at_us": e.expires, "created_at_us": e.created, "updated_at_us": e.updated}
    if e.type == "string":
        yield head | {"value": e.value}
    elif e.type == "list":
        yield from (head | {"idx": i, "value": v} for i, v in enumerate(e.value))
    else:
        yield from (head | {"member": m, "value": v if e.type == "hash" else None, "score": v if e.type == "zset" else None} for m, v in e.value.items())


def fold_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, seq, pos, sub, ts_us, cmd, rest) sorted by key, seq, pos and sub -> rows of OUT."""
    name, key, open_life, rows = None, None, None, []  # open_life: type, deadline, (ts, seq, pos) of its start

    def flush():
        types = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), _REPLY, _STATE, _LIFE)
        out = pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["seq", "pos", "sub", "parts", "reply", "state", "life"])
        rows.clear()
        return out

    def end_life(ts=None, seq=None, pos=None):
        if open_life is not None:
            kind, deadline, start = open_life
            rows.append((None, None, None, None, None, None, dict(zip(("from_ts", "from_seq", "from_pos"), start, strict=True)) | {"type": kind, "to_ts": ts, "to_seq": seq, "to_pos": pos, "deadline": deadline}))

    def close():
        end_life()
        if key is not None and key.entry is not None:
            for s in state_rows(name, key.entry):
                rows.append((None, None, None, None, None, s, None))
                if len(rows) > 20_000:
                    yield flush()

    for b in batches:
        for k, seq, pos, sub, ts, cmd, rest in zip(*(b.column(c).to_pylist() for c in ("key", "seq", "pos", "sub", "ts_us", "cmd", "rest")), strict=True):
            if key is None or k != name:
                yield from close()
                name, key, open_life = k, Key(), None
            kind, n, s, arr = key.step(cmd, k, rest, ts)
            rows.append((seq, pos, sub, cmd in MANY, {"kind": kind, "int": n, "str": s, "arr": arr}, None, None))
            e = key.entry
            now = None if e is None else (e.type, e.expires)
            if now != (None if open_life is None else open_life[:2]):
                end_life(ts, seq, pos)
                open_life = None if now is None else (*now, (ts, seq, pos))
            if len(rows) > 20_000:
                yield flush()
    yield from close()
    if rows:
        yield flush()


def fold(commands: DataFrame) -> DataFrame:
    """commands: key, seq, pos, sub (together unique), ts_us, cmd, rest -> OUT rows: replies, final state elements and lifetimes."""
    return commands.repartition("key").sortWithinPartitions("key", "seq", "pos", "sub").mapInArrow(fold_sorted, OUT)


def relations(folded: DataFrame, now_us) -> dict[str, DataFrame]:
    """The state relations at now_us."""
    s = folded.filter("state is not null").select("state.*").filter(F.col("expires_at_us").isNull() | (F.col("expires_at_us") > now_us))
    of = lambda t: s.filter(F.col("type") == t)
    return {
        "keys": s.select("key", "type", "expires_at_us", "created_at_us", "updated_at_us").distinct(),
        "strings": of("string").select("key", "value"),
        "hash_fields": of("hash").select("key", F.col("member").alias("field"), "value"),
        "list_items": of("list").select("key", F.col("idx").alias("pos"), "value"),
        "set_members": of("set").select("key", "member"),
        "zset_members": of("zset").select("key", "member", "score"),
    }
