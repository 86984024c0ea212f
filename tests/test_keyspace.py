import os
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from keyloom.functions.parse import clamp, clamp_columns, float_column, incremented, int_column, parse_float, parse_int, wrap
from keyloom.model import LOG
from keyloom.operators import collections, lists, pubsub
from keyloom.plans.fold import ARITY, Key, arity_error, relations
from keyloom.plans.queries import ORACLES, QUERIES
from keyloom.plans.session import run_log
from keyloom.sources.resp import as_log, commands, encode_command, encode_reply, read_captures

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def replies(spark, log):
    """log: (conn, cmd, args...) at one second each -> wire replies by seq."""
    rows = [(i, i * 1_000_000, c, cmd, list(args)) for i, (c, cmd, *args) in enumerate(log)]
    out, folded = run_log(spark.createDataFrame(rows, LOG))
    got = {}
    for r in out.select("seq", "pos", encode_reply(F.col("reply")).alias("r")).orderBy("seq", "pos").collect():
        got.setdefault(r.seq, []).append(r.r.replace("\r\n", " ").strip())
    return [got.get(i) for i in range(len(rows))], folded


def one(spark, log):
    return [r[0] if r else None for r in replies(spark, [("c", *x) for x in log])[0]]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    def rows(cols, data):
        order = sorted(range(len(cols)), key=cols.__getitem__)
        return sorted(tuple(str(r[i]) for i in order) for r in data)

    got = QUERIES[name](spark, SF)
    want = con.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_whole_keyspace(spark):
    """The _all queries read every event, customer and order, and meet live, expired and missing keys."""
    n = {t: spark.read.parquet(f"{SF}/{t}.parquet").count() for t in ("events", "customer", "orders")}
    assert QUERIES["expire_all"](spark, SF).count() == n["events"]
    ttl = [r.ttl for r in QUERIES["type_and_ttl_all"](spark, SF).collect()]
    # order ids are dense from 1 and more than the customers'
    assert len(ttl) == n["orders"] > n["customer"] and {-1, -2} < set(ttl) and max(ttl) > 0
    info = QUERIES["info_all"](spark, SF).first()
    # two of three keys have no deadline
    assert n["events"] * 2 // 3 < info.total_keys < n["events"] and sum(info[1:]) == info.total_keys
    got = QUERIES["exists_and_del_all"](spark, SF).agg(F.sum("exists_reply").alias("e"), F.sum("del_reply").alias("d")).first()
    assert 3 * n["orders"] > got.e > got.d > 30


def test_batches_of_large_order_keys(spark, tmp_path):
    keys = [(1, 5), (1, 9_999_998), (1, 9_999_999), (2, 10_000_000), (2, 7), (3, 25_000_000), (7, 30_000_001), (11, 9_999_998)]
    spark.createDataFrame(keys, "o_custkey bigint, o_orderkey bigint").write.parquet(str(tmp_path / "orders.parquet"))
    own = duckdb.connect()
    own.sql(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    got = QUERIES["multi_exec_discard"](spark, str(tmp_path)).select("seq", "pos", "reply").collect()
    assert sorted(map(tuple, got)) == sorted(own.sql(f"select seq, pos, reply from ({ORACLES['multi_exec_discard']})").fetchall())


W, I = "-WRONGTYPE Operation against a key holding the wrong kind of value", "-ERR value is not an integer or out of range"


def check(spark, cases):
    """cases: (reply, command, argument...) in order."""
    got = one(spark, [c[1:] for c in cases])
    assert [(g, *c[1:]) for g, c in zip(got, cases)] == cases


def test_strings_and_types(spark):
    check(spark, [
        ("+OK", "SET", "lamp", "dim"), ("+OK", "SET", "lamp", "bright", "EX", "1"), (":-2", "TTL", "lamp"), ("$-1", "GET", "lamp"), (":1", "SADD", "bag", "pen"), (W, "GET", "bag"),
        ("-ERR key is required", "SET", "", "v"), ("-ERR key is required", "GET", ""), (":0", "DEL", ""), (":1", "INCR", "n"), ("+OK", "SET", "n", "41"), (":42", "INCR", "n"), ("+OK", "SET", "n", "4 2"), (I, "INCR", "n"),
        (W, "INCR", "bag"), ("+OK", "SET", "n", "9223372036854775807"), (":-9223372036854775808", "INCR", "n"), ("-ERR syntax error", "SET", "k", "v", "NX"), ("-ERR syntax error", "SET", "k", "v", "EX"), (I, "SET", "k", "v", "EX", "0"),
        ("+OK", "SET", "k", "v", "ex", "5", "PX", "1500"), ("$1 v", "GET", "k"), ("$-1", "GET", "k"), ("-ERR invalid expire time in 'SETEX' command", "SETEX", "k", "x", "v"), ("+OK", "SETEX", "k", "9", "v"),
        ("+OK", "SET", "bag", "text now"), ("+string", "TYPE", "bag"), ("-ERR invalid expire time in 'EXPIRE' command", "EXPIRE", "bag", "0"), (I, "EXPIRE", "bag", "z"), (":1", "EXPIRE", "bag", "7200"), (":7199", "TTL", "bag"),
        (":0", "EXPIRE", "none", "5"), (":-2", "TTL", "none"), ("-ERR invalid expire time in 'SETEX' command", "SETEX", "k", "9223372037", "v"),
    ])


def test_collections(spark):
    check(spark, [
        (":2", "HSET", "shop", "city", "Ulm", "size", "9"), (":1", "HSET", "shop", "size", "12", "open", "y"), ("$2 12", "HGET", "shop", "size"), ("*6 $4 city $3 Ulm $4 open $1 y $4 size $2 12", "HGETALL", "shop"),
        (":1", "HDEL", "shop", "size", "size", "x"), ("-ERR wrong number of arguments for 'HSET' command", "HSET", "shop", "odd"), (":2", "HDEL", "shop", "city", "open"), ("+none", "TYPE", "shop"),
        (":2", "LPUSH", "trip", "q2", "q1"), (":3", "RPUSH", "trip", "q3"), ("*3 $2 q1 $2 q2 $2 q3", "LRANGE", "trip", "0", "2"), ("*2 $2 q2 $2 q3", "LRANGE", "trip", "-2", "-1"), ("*0", "LRANGE", "trip", "5", "9"), (I, "LRANGE", "trip", "x", "1"),
        ("$2 q1", "LPOP", "trip"), ("$2 q3", "RPOP", "trip"), ("$2 q2", "LPOP", "trip"), ("$-1", "LPOP", "trip"), (":0", "EXISTS", "trip"),
        (":2", "SADD", "herd", "yak", "emu", "yak"), ("*2 $3 emu $3 yak", "SMEMBERS", "herd"), (":1", "SREM", "herd", "yak", "zz"), (":1", "SISMEMBER", "herd", "emu"), (":1", "SCARD", "herd"),
        (":3", "ZADD", "race", "310", "Ada", "0x1.9p8", "Bo", "-7.5", "Cyd"), (":3", "ZCARD", "race"), ("*3 $3 Cyd $3 Ada $2 Bo", "ZRANGE", "race", "0", "-1"), (":1", "ZADD", "race", "-9", "Bo", "-2", "Dee", "-1", "Dee"),
        ("*2 $3 Dee $3 Ada", "ZRANGE", "race", "-2", "-1"), ("-ERR value is not a valid float", "ZADD", "race", "0x9", "m"), (":1", "ZADD", "race", "nan", "odd"), (":3", "ZREMRANGEBYSCORE", "race", "-inf", "-1"),
        ("-ERR min is not a float", "ZREMRANGEBYSCORE", "race", "(1", "2"), ("-ERR max is not a float", "ZREMRANGEBYSCORE", "race", "1", "y"), ("*2 $3 Ada $3 odd", "ZRANGE", "race", "0", "-1"), (":1", "ZREMRANGEBYSCORE", "race", "0", "inf"), (W, "ZCARD", "herd"),
    ])


def test_last_put_of_a_field_wins(spark):
    fields = spark.createDataFrame([("a", "x", "1"), ("a", "y", "2")], "key string, member string, value string")
    new = spark.createDataFrame([("a", "y", "3", 7), ("a", "y", "4", 9), ("a", "y", "5", 8), ("b", "x", "6", 1)], "key string, member string, value string, seq bigint")
    assert sorted(map(tuple, collections.put(fields, new).collect())) == [("a", "x", "1"), ("a", "y", "4"), ("b", "x", "6")]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_slow_subscribers_are_dropped(spark, seed):
    r = random.Random(seed)
    subs, pubs, drains, want = [], [], [], []
    open_, waiting, gone = {}, {}, {}
    for seq in range(1, 900):
        pick, who, ch = r.random(), f"s{r.randrange(6)}", f"ch{r.randrange(2)}"
        if pick < 0.08 and (who, ch) not in open_:
            open_[who, ch] = seq
        elif pick < 0.14 and (who, ch) in open_:
            subs.append((who, ch, open_.pop((who, ch)), seq))
        elif pick < 0.5:
            n = r.randrange(1, 5)
            drains.append((who, seq, n))
            waiting[who] = max(0, waiting.get(who, 0) - n)
        else:
            pubs.append((seq, ch, f"m{seq}"))
            for s, c in open_:
                if c == ch and s not in gone:
                    if waiting.get(s, 0) == 4:
                        gone[s] = seq
                    else:
                        waiting[s] = waiting.get(s, 0) + 1
                        want.append((s, ch, seq, f"m{seq}"))
    subs += [(s, c, a, None) for (s, c), a in open_.items()]
    p, s = spark.createDataFrame(pubs, "seq bigint, channel string, payload string"), spark.createDataFrame(subs, "sub string, channel string, from_seq bigint, to_seq bigint")
    d = spark.createDataFrame(drains, "sub string, seq bigint, n int")
    assert sorted(map(tuple, pubsub.deliveries_with_eviction(p, s, d, 4).collect())) == sorted(want) and gone
    every = [(x, c, q, m) for q, c, m in pubs for x, ch, a, b in subs if ch == c and a < q and (b is None or q < b)]
    assert sorted(map(tuple, pubsub.deliveries(p, s).collect())) == sorted(every)
    counts = {x.seq: x.reply for x in pubsub.publish_counts(p, s).collect()}
    assert counts == {q: sum(e[2] == q for e in every) for q, *_ in pubs}
    assert not pubsub.deliveries(p.limit(0), s).count() and not pubsub.publish_counts(p, s.limit(0)).filter("reply <> 0").count()


def test_evictions_are_told_without_making_deliveries(spark):
    r = random.Random(5)
    pubs = [(q, q // 3, f"ch{r.randrange(3)}", f"m{q}") for q in range(0, 600, 2) for _ in range(1 + (q % 14 == 0))]
    subs, drains = [], [(f"s{r.randrange(8)}", r.randrange(-20, 640), r.choice([0, 1, 2, 7, 300, None])) for _ in range(400)]
    for _ in range(40):  # they may overlap, be empty, or begin and end at a message, which may also be a drain's
        a = r.randrange(-10, 600)
        subs.append((f"s{r.randrange(9)}", f"ch{r.randrange(4)}", a, r.choice([None, a - 2, a, a + 1, a + 2, a + 90, a + 300]), r.choice([10, 90, 500])))
    p = spark.createDataFrame(pubs, "seq bigint, ts_us bigint, channel string, payload string")
    s = spark.createDataFrame(subs, "sub string, channel string, from_seq bigint, to_seq bigint, to_ts bigint")
    d = spark.createDataFrame(drains, "sub string, seq bigint, n int")
    for timed, buffer in ((False, 0), (False, 3), (True, 3), (False, 40)):
        want = {}
        for who in {x[0] for x in subs}:
            steps = [(q, 1, 1) for q, at, ch, _ in pubs for x, c, a, b, t in subs if x == who and c == ch and a < q and (b is None or q < b) and (not timed or at <= t)]
            waits = 0
            for q, message, n in sorted(steps + [(q, 0, n or 0) for x, q, n in drains if x == who]):
                waits = waits + 1 if message else max(0, waits - n)
                if waits > buffer:
                    want[who] = q
                    break
        got = {x.sub: x.seq for x in pubsub.evictions(p, s if timed else s.drop("to_ts"), d, buffer).collect()}
        assert got == want and want
    assert not pubsub.evictions(p.limit(0), s.drop("to_ts"), d, 3).count() and not pubsub.evictions(p, s.limit(0).drop("to_ts"), d, 3).count()
    assert {x.sub for x in pubsub.evictions(p, s.drop("to_ts"), d.limit(0), 3).collect()} >= set(want)


def test_idle_connections_are_dropped(spark):
    r = random.Random(41)
    edges, pubs, activity, want = [], [], [], []
    open_, heard, gone, ts = set(), {}, set(), 0
    for seq in range(1, 700):
        ts += r.randrange(0, 30)
        pick, who, ch = r.random(), f"s{r.randrange(9)}", f"ch{r.randrange(2)}"
        gone |= {s for s, at in heard.items() if ts - at > 200}
        open_ = {(s, c) for s, c in open_ if s not in gone}
        if pick < 0.5:
            pubs.append((seq, ts, ch, f"m{seq}"))
            want += [(s, c, seq, f"m{seq}") for s, c in open_ if c == ch]
            continue
        activity.append((who, seq, ts))
        if who not in gone:
            heard[who] = ts
        if pick < 0.85:
            op = "SUB" if pick < 0.75 else "UNSUB"
            edges.append((who, ch, seq, ts, op))
            if who not in gone:
                (open_.add if op == "SUB" else open_.discard)((who, ch))
    p = spark.createDataFrame(pubs, "seq bigint, ts_us bigint, channel string, payload string")
    e = spark.createDataFrame(edges, "sub string, channel string, seq bigint, ts_us bigint, op string")
    a = spark.createDataFrame(activity, "sub string, seq bigint, ts_us bigint")
    got = pubsub.deliveries(p, pubsub.intervals_until_idle(e, a, 200))
    assert sorted(map(tuple, got.collect())) == sorted(want) and 0 < len(gone) and want
    nobody = pubsub.intervals_until_idle(e.limit(0), a.limit(0), 200)
    assert pubsub.deliveries(p, nobody).count() == 0 and pubsub.deliveries(p.limit(0), pubsub.intervals_until_idle(e, a, 200)).count() == 0


def test_batches_subscriptions_and_info(spark):
    log = [
        ("a", "MULTI"), ("b", "SET", "x", "1"), ("a", "SET", "k", "v"), ("a", "SADD", "s", "m"), ("a", "multi"), ("a", "NOPE"), ("b", "GET", "k"), ("a", "SUBSCRIBE", "news", ""), ("a", "EXEC"), ("b", "PUBLISH", "news", "hi"),
        ("a", "GET", "k"), ("a", "PING"), ("b", "INFO"), ("a", "UNSUBSCRIBE"), ("a", "GET", "k"), ("b", "PUBLISH", "news", "hi"), ("b", "DEL", "k", "k", "x"), ("b", "EXISTS", "s", "s"), ("b", "MULTI"), ("b", "INCR", "n"),
        ("b", "DISCARD"), ("b", "EXISTS", "n"), ("a", "MULTI"), ("a", "EXEC"), ("a", "SUBSCRIBE", "q"), ("a", "QUIT"), ("b", "PUBLISH", "q", "x"), ("a", "PING"), ("b", "INFO"),
    ]
    got, folded = replies(spark, log)
    info = "# Server  # Keyspace total_keys:{} string_keys:{} hash_keys:0 list_keys:0 set_keys:1  # PubSub channels:{} subscribers:{}"
    only = "-ERR only (P)SUBSCRIBE / (P)UNSUBSCRIBE / PING are allowed in this context"
    flat = [g and [x.split(" ", 1)[1].strip().replace("  ", " ") if x.startswith("$") and "Server" in x else x for x in g] for g in got]
    assert flat[:12] == [
        ["+OK"], ["+OK"], ["+QUEUED"], ["+QUEUED"], ["-ERR MULTI calls can not be nested"], ["+QUEUED"], ["$-1"], ["*3 $9 subscribe $4 news :1", "*3 $9 subscribe $0  :1"],
        ["*3", "+OK", ":1", "-ERR unknown command 'NOPE'"], [":1"], [only], ["+PONG"],
    ]
    assert flat[12] == [info.format(3, 2, 1, 1).replace("  ", " ")]
    assert flat[13:28] == [["*3 $11 unsubscribe $4 news :0"], ["$1 v"], [":0"], [":2"], [":2"], ["+OK"], ["+QUEUED"], ["+OK"], [":0"], ["+OK"], ["*0"], ["*3 $9 subscribe $1 q :1"], ["+OK"], [":0"], None]
    assert flat[28] == [info.format(1, 0, 0, 0).replace("  ", " ")]
    assert [r.key for r in relations(folded, F.lit(10**9))["set_members"].collect()] == ["s"]


def simulate(log):
    """The log one command at a time, on a dictionary of keys."""
    keys, out = {}, []
    for seq, ts, cmd, args in log:
        if arity_error(cmd, len(args)):
            continue
        if cmd in ("DEL", "EXISTS"):
            out.append((seq, ("int", sum(keys.setdefault(k, Key()).step(cmd, k, [], ts)[1] for k in args), None, None)))
        else:
            out.append((seq, keys.setdefault(args[0], Key()).step(cmd, args[0], args[1:], ts)))
    return dict(out)


def random_log(seed, n=1500):
    r = random.Random(seed)
    v = lambda: r.choice(["a", "b", "c", "1", "7", ""])
    make = {"SET": lambda: [v(), *r.choice([[], ["EX", "3"], ["PX", "2500"]])], "SETEX": lambda: ["2", v()], "EXPIRE": lambda: [r.choice(["1", "4", "0", "x"])], "HSET": lambda: [v(), v()], "HGET": lambda: [v()], "HDEL": lambda: [v(), v()], "LPUSH": lambda: [v(), v()],
            "RPUSH": lambda: [v()], "LRANGE": lambda: [str(r.randrange(-4, 4)), str(r.randrange(-4, 4))], "SADD": lambda: [v(), v()], "SREM": lambda: [v()], "SISMEMBER": lambda: [v()], "ZADD": lambda: [r.choice(["1", "2.5", "inf", "nan", "bad"]), v()],
            "ZRANGE": lambda: [str(r.randrange(-3, 3)), str(r.randrange(-3, 3))], "ZREMRANGEBYSCORE": lambda: [r.choice(["-inf", "1", "2"]), r.choice(["2", "inf", "nan"])], "DEL": lambda: r.choice([[], ["k1"], ["k1", "k1"]]), "EXISTS": lambda: ["k0", "k0"]}
    names = [c for c in ARITY if c not in ("PING", "PUBLISH")]
    return [(i, i * 700_000, c, [f"k{r.randrange(5)}", *make.get(c, list)()]) for i in range(n) for c in (r.choice(names),)]


@pytest.mark.parametrize("seed", [1, 2])
def test_engine_equals_simulation(spark, seed):
    log = random_log(seed)
    out, _ = run_log(spark.createDataFrame([(s, t, "c", c, a) for s, t, c, a in log], LOG))
    assert {r.seq: tuple(r.reply) for r in out.collect()} == simulate(log)


def test_info_equals_simulation(spark):
    """Counts over buckets of time and of seq, deadlines that pass on and between commands, and seqs near the end of their type."""
    r, base = random.Random(6), 2**62
    log, want, keys, subs = [], {}, {}, {}
    for i, (_, ts, cmd, args) in enumerate(random_log(6)):
        seq, conn = base + i * 10_000, "c"
        pick = r.random()
        if pick < 0.05:
            live = [e.type for k in keys.values() if (e := k.live(ts)) is not None]
            held = [c for c in subs.values() if c]
            want[seq] = tuple(map(str, (len(live), *(live.count(t) for t in ("string", "hash", "list", "set")), len(set().union(*held)), len(held))))
            cmd, args = "INFO", []
        elif pick < 0.15:
            conn, cmd, args = f"s{r.randrange(4)}", r.choice(["SUBSCRIBE", "SUBSCRIBE", "UNSUBSCRIBE"]), [f"ch{r.randrange(4)}" for _ in range(r.randrange(1, 3))]
            if r.random() < 0.1:
                cmd, args = "UNSUBSCRIBE", []
            now = subs.setdefault(conn, set())
            now.update(args) if cmd == "SUBSCRIBE" else now.difference_update(args or set(now))
        elif not arity_error(cmd, len(args)):
            for k in args if cmd in ("DEL", "EXISTS") else args[:1]:
                keys.setdefault(k, Key()).step(cmd, k, [] if cmd in ("DEL", "EXISTS") else args[1:], ts)
        log.append((seq, ts, conn, cmd, args))
    out, _ = run_log(spark.createDataFrame(log, LOG))
    got = {x.seq: tuple(re.findall(r":(\d+)", x.reply.str)) for x in out.filter("reply.str like '# Server%'").collect()}
    assert len(want) > 40 and got == want


def test_stream_equals_fold(spark, tmp_path):
    from keyloom.model import SESSION
    from keyloom.streaming.keyspace import stream_replies

    log = [x for x in random_log(3, 300) if x[2] not in ("DEL", "EXISTS") and not arity_error(x[2], len(x[3]))]
    schema = "key string, seq bigint, ts_us bigint, cmd string, rest array<string>"
    rows = [(a[0], s, t, c, a[1:]) for s, t, c, a in log]
    for i, part in enumerate((rows[:150], rows[150:], rows[:5])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    for k, v in SESSION.items():
        spark.conf.set(k, v)
    got = {}
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = stream_replies(stream).writeStream.foreachBatch(lambda df, n: got.update({(n, r.seq): tuple(r.reply) for r in df.collect()})).option("checkpointLocation", str(tmp_path / "cp")).outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    kept = {s: r for (_, s), r in got.items() if r[0] != "late"}
    assert kept == simulate(log) and sum(r[0] == "late" for r in got.values()) == 5


def test_wire_format(spark, tmp_path):
    data = encode_command("set", "k", "a\r\nb") + b"PING\r\n" + b"*2\r\n$3\r\nGET\r\n+k\r\n" + b"*1\r\n$-1\r\n"
    assert list(commands(data)) == [("SET", [b"k", b"a\r\nb"]), ("PING", []), ("GET", [b"k"]), ("", [])]
    for bad in (b"*abc\r\n", b"\r\n", b"*0\r\n", b"*1\r\n:5\r\n", b"*1\r\n$-2\r\n", b"PING\n", b"*1\r\n$1\r\nab\r\n", b"*1\r\n*1\r\n$1\r\na\r\n"):
        assert [c for c, _ in commands(b"PING\r\n" + bad + b"PING\r\n")] == ["PING", "ERROR"], bad
    assert list(commands(b"*1\r\n$4\r\nPI")) == []
    for folder in ("x", "y"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "conn1").write_bytes(data)
    got = read_captures(spark, str(tmp_path / "*")).orderBy("conn_id", "i").collect()
    assert [(r.conn_id.rsplit("/", 2)[1], r.i, r.cmd) for r in got] == [(x, i, c) for x in "xy" for i, c in enumerate(("SET", "PING", "GET", ""))]


def test_captures_keep_bytes_and_run(spark, tmp_path):
    values = [b"plain", "caf\u00e9".encode(), b"\xff\x00\xfe", b"back\\slash", b"\\xFF", b""]
    data = b"".join(b"*3\r\n$3\r\nSET\r\n$2\r\nk%d\r\n$%d\r\n%s\r\n" % (i, len(v), v) for i, v in enumerate(values))
    (tmp_path / "a").write_bytes(data)
    (tmp_path / "b").write_bytes(b"".join(b"GET k%d\r\n" % i for i in range(len(values))) + b"\r\n")
    os.utime(tmp_path / "a", (1_000, 1_000))
    captures = read_captures(spark, str(tmp_path))
    assert [bytes(r.args[1]) for r in captures.filter("cmd = 'SET'").orderBy("i").collect()] == values
    log = as_log(captures)
    assert sorted(r.seq for r in log.collect()) == list(range(2 * len(values) + 1))
    got = [r.reply.str for r in run_log(log)[0].orderBy("seq").collect()]
    assert got == ["OK"] * len(values) + ["plain", "caf\u00e9", "\\xFF\x00\\xFE", "back\\\\slash", "\\\\xFF", "", "ERR unknown command 'ERROR'"]


def test_parsers_agree(spark):
    texts = ["0", "-5", "+7", " 5", "5 ", "1.5", "", "9223372036854775807", "9223372036854775808", "inf", "-Infinity", "NaN", "1e400", "1e5", ".5", "5.", "1d", "0x1", "abc", "0x1p4", "-0X1.8p-1", "0x.8p2", "0x1p9999", "0xp1", "0x1.p1"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", int_column(F.col("t")).alias("i"), float_column(F.col("t")).alias("f"), incremented(int_column(F.col("t"))).alias("n")).collect()
    for r in got:
        assert r.i == parse_int(r.t) and str(r.f) == str(parse_float(r.t)), r
        assert r.n == (None if r.i is None else wrap(r.i + 1))


def test_ranges(spark):
    cases = [(n, a, b) for n in range(5) for a in range(-7, 8) for b in range(-7, 8)]
    lo, hi = clamp_columns(F.col("a"), F.col("b"), F.col("n"))
    items = F.transform(F.when(F.col("n") > 0, F.sequence(F.lit(1), F.col("n"))).otherwise(F.array().cast("array<int>")), lambda x: x)
    got = spark.createDataFrame(cases, "n int, a int, b int").select("n", "a", "b", lo.alias("lo"), hi.alias("hi"), lists.lrange_array(items, F.col("a"), F.col("b")).alias("s")).collect()
    for r in got:
        lo, hi = clamp(r.a, r.b, r.n)
        want = list(range(1, r.n + 1))[lo : hi + 1] if lo <= hi else []
        assert r.s == want and (list(range(1, r.n + 1))[r.lo : r.hi + 1] if r.lo <= r.hi else []) == want


def test_messages_are_encoded_before_they_are_delivered(spark):
    from keyloom.plans.queries import messages

    above, below = messages(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().split("Join Inner", 1)
    assert "concat(*3" not in above and "concat(*3" in below
