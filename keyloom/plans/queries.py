"""Registered queries over the analytic tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.functions import patterns
from keyloom.functions.parse import incremented, int_column, ttl_column
from keyloom.operators import collections, keys, lists, pubsub, strings
from keyloom.plans.fold import relations
from keyloom.plans.session import run_log
from keyloom.sources.resp import encode_command_column, encode_message, encode_reply, parse_streams
from keyloom.sources.tables import command_log, events, score_log, subscriber_log, table, typed_log

HOUR = 3_600_000_000
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


E = "e AS (SELECT CAST(user_id AS VARCHAR) AS key, event_id AS seq, epoch_us(ts) AS ts_us, event_type, value FROM events)"


def _string_log(spark, sf):
    e = events(spark, sf)
    t = F.col("event_type")
    op = F.when(t.isin("signup", "purchase"), "SET").when(t == "error", "DEL").otherwise("GET")
    return e.select("key", "seq", "ts_us", op.alias("op"), F.col("seq").cast("string").alias("value"), F.when(t == "signup", F.lit(12 * HOUR)).alias("ttl_us"))


L1 = E + f""", l AS (SELECT *, CASE WHEN event_type IN ('signup', 'purchase') THEN 'SET' WHEN event_type = 'error' THEN 'DEL' ELSE 'GET' END AS op, CASE WHEN event_type = 'signup' THEN {12 * HOUR} END AS ttl FROM e)"""


@query(f"""WITH {L1}, w AS (SELECT *, last_value(CASE WHEN op <> 'GET' THEN seq END IGNORE NULLS) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS wseq FROM l WHERE true)
SELECT w.key, w.seq, CASE WHEN l.op = 'SET' AND (l.ttl IS NULL OR w.ts_us < l.ts_us + l.ttl) THEN CAST(l.seq AS VARCHAR) END AS reply
FROM w LEFT JOIN l ON l.key = w.key AND l.seq = w.wseq WHERE w.op = 'GET'""")
def get_replies(spark, sf):
    """GET against SET, SETEX, DEL and expiry in one log."""
    return strings.replay_strings(_string_log(spark, sf)).filter("op = 'GET'").select("key", "seq", F.col("value_before").alias("reply"))


@query(f"""WITH {L1}, w AS (SELECT *, last_value(CASE WHEN op <> 'GET' THEN seq END IGNORE NULLS) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS wseq FROM l)
SELECT w.key, w.seq, CASE WHEN l.op = 'SET' AND (l.ttl IS NULL OR w.ts_us < l.ts_us + l.ttl) THEN 1 ELSE 0 END AS reply
FROM w LEFT JOIN l ON l.key = w.key AND l.seq = w.wseq WHERE w.op = 'DEL'""")
def del_replies(spark, sf):
    """DEL removes a live key or none."""
    return strings.replay_strings(_string_log(spark, sf)).filter("op = 'DEL'").select("key", "seq", F.col("live_before").cast("int").alias("reply"))


@query(f"""WITH {L1}, w AS (SELECT *, last_value(CASE WHEN op <> 'GET' THEN seq END IGNORE NULLS) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS wseq FROM l)
SELECT w.key, w.seq, CASE WHEN l.op IS NULL OR l.op <> 'SET' OR w.ts_us >= l.ts_us + l.ttl THEN -2 WHEN l.ttl IS NULL THEN -1 ELSE (l.ts_us + l.ttl - w.ts_us) // 1000000 END AS reply
FROM w LEFT JOIN l ON l.key = w.key AND l.seq = w.wseq WHERE w.op = 'GET'""")
def ttl_replies(spark, sf):
    """TTL where the log reads: -2, -1 or whole seconds."""
    x = strings.replay_strings(_string_log(spark, sf)).filter("op = 'GET'")
    return x.select("key", "seq", ttl_column(F.col("live_before"), F.col("deadline_before"), F.col("ts_us")).alias("reply"))


@query(f"""WITH {L1}, w AS (SELECT key, arg_max(op, seq) AS op, arg_max(seq, seq) AS seq, arg_max(ts_us + coalesce(ttl, 0), seq) AS until, arg_max(coalesce(ttl, -1), seq) AS ttl FROM l WHERE op <> 'GET' GROUP BY key)
SELECT key, CAST(seq AS VARCHAR) AS value, CASE WHEN ttl >= 0 THEN until END AS expires_at_us FROM w WHERE op = 'SET' AND (ttl < 0 OR (SELECT max(ts_us) FROM e) < until)""")
def string_snapshot(spark, sf):
    """SET, SETEX and DEL as the state they leave."""
    now = events(spark, sf).agg(F.max("ts_us").alias("now"))
    # now is one row: an aggregate without keys
    return strings.snapshot_strings(_string_log(spark, sf), F.lit(0)).join(F.broadcast(now)).filter("expires_at_us is null or now < expires_at_us").select("key", "value", "expires_at_us")


@query(f"WITH {E} SELECT key, seq, row_number() OVER (PARTITION BY key ORDER BY seq) AS reply FROM e")
def incr(spark, sf):
    return strings.incr_replies(events(spark, sf).select("key", "seq"))


@query("""WITH v(t) AS (VALUES ('10'), ('-3'), ('+7'), (' 5 '), ('1.5'), ('hello'), (''), ('9223372036854775807'), ('9223372036854775808'))
SELECT t AS value, CASE WHEN regexp_full_match(t, '[+-]?[0-9]+') AND try_cast(t AS BIGINT) IS NOT NULL THEN CAST(CASE WHEN try_cast(t AS BIGINT) = 9223372036854775807 THEN -9223372036854775808 ELSE try_cast(t AS BIGINT) + 1 END AS VARCHAR) END AS reply FROM v""")
def incr_parsing(spark, sf):
    """INCR on text: strict integers, wrap-around; null stands for the not-an-integer error."""
    v = spark.createDataFrame([(x,) for x in ("10", "-3", "+7", " 5 ", "1.5", "hello", "", "9223372036854775807", "9223372036854775808")], "value string")
    return v.select("value", incremented(int_column(F.col("value"))).cast("string").alias("reply"))


def _requests(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(F.col("o_custkey").alias("req"), F.explode(F.array(*[x.cast("string") for x in (F.col("o_orderkey") % 40, F.col("o_custkey") % 40, F.lit(7))])).alias("key"))


def _some_keys(spark, sf):
    """Keys of all types with deadlines, from rows of several tables."""
    e = events(spark, sf).filter("seq < 30")
    kind = F.element_at(F.array(*map(F.lit, keys.TYPES)), (F.col("seq") % 5 + 1).cast("int"))
    return e.select(F.col("seq").cast("string").alias("key"), kind.alias("type"), F.when(F.col("seq") % 3 == 0, F.col("seq") * 1_000_000).alias("expires_at_us"), F.lit(0).cast("bigint").alias("updated_at_us"))


NOW = 10_500_000
K = f"""k AS (SELECT CAST(event_id AS VARCHAR) AS key, ['string', 'hash', 'list', 'set', 'zset'][event_id % 5 + 1] AS type, CASE WHEN event_id % 3 = 0 THEN event_id * 1000000 END AS x FROM events WHERE event_id < 30),
a AS (SELECT * FROM k WHERE x IS NULL OR {NOW} < x)"""


@query(f"""WITH {K}, q AS (SELECT o_custkey AS req, CAST(unnest([o_orderkey % 40, o_custkey % 40, 7]) AS VARCHAR) AS key FROM orders)
SELECT req, count(a.key) AS exists_reply, count(DISTINCT a.key) AS del_reply FROM q LEFT JOIN a USING (key) GROUP BY req""")
def exists_and_del(spark, sf):
    """EXISTS counts repeated keys, DEL doesn't."""
    return keys.exists_counts(_requests(spark, sf), _some_keys(spark, sf), F.lit(NOW))


@query(f"""WITH {K}, q AS (SELECT DISTINCT CAST(c_custkey % 45 AS VARCHAR) AS key FROM customer)
SELECT q.key, coalesce(type, 'none') AS type, CASE WHEN a.key IS NULL THEN -2 WHEN x IS NULL THEN -1 ELSE (x - {NOW}) // 1000000 END AS ttl FROM q LEFT JOIN a USING (key)""")
def type_and_ttl(spark, sf):
    q = table(spark, sf, "customer").select((F.col("c_custkey") % 45).cast("string").alias("key")).distinct()
    return keys.type_and_ttl(q, _some_keys(spark, sf), F.lit(NOW))


@query(f"""WITH {K} SELECT k.key, CASE WHEN k.x IS NULL OR {NOW} < k.x THEN CASE WHEN CAST(k.key AS BIGINT) % 2 = 0 THEN {NOW} + 60000000 ELSE x END ELSE x END AS expires_at_us,
CAST((k.x IS NULL OR {NOW} < k.x) AND CAST(k.key AS BIGINT) % 2 = 0 AS BIGINT) AS reply FROM k""")
def expire(spark, sf):
    k = _some_keys(spark, sf)
    asked = k.filter(F.col("key").cast("bigint") % 2 == 0).select("key", F.lit(60).cast("bigint").alias("seconds"))
    return keys.expire(k, asked, F.lit(NOW)).select("key", "expires_at_us", "reply")


@query(f"""WITH {K} SELECT count(*) AS total_keys, count(*) FILTER (type = 'string') AS string_keys, count(*) FILTER (type = 'hash') AS hash_keys, count(*) FILTER (type = 'list') AS list_keys,
count(*) FILTER (type = 'set') AS set_keys, count(*) FILTER (type = 'zset') AS zset_keys FROM a""")
def info(spark, sf):
    return keys.info(_some_keys(spark, sf), F.lit(NOW))


def _all_keys(spark, sf):
    """A key of every event; each third has a deadline, half a day after it."""
    e = events(spark, sf)
    kind = F.element_at(F.array(*map(F.lit, keys.TYPES)), (F.col("seq") % 5 + 1).cast("int"))
    return e.select(F.col("seq").cast("string").alias("key"), kind.alias("type"), F.when(F.col("seq") % 3 == 0, F.col("ts_us") + 12 * HOUR).alias("expires_at_us"), F.lit(0).cast("bigint").alias("updated_at_us"))


def _mid(spark, sf):
    """The middle of the events' time: deadlines lie before and after it."""
    return events(spark, sf).agg(F.expr("(min(ts_us) + max(ts_us)) div 2")).scalar()


KA = f"""n AS (SELECT (min(epoch_us(ts)) + max(epoch_us(ts))) // 2 AS now FROM events),
k AS (SELECT CAST(event_id AS VARCHAR) AS key, ['string', 'hash', 'list', 'set', 'zset'][event_id % 5 + 1] AS type, CASE WHEN event_id % 3 = 0 THEN epoch_us(ts) + {12 * HOUR} END AS x FROM events),
a AS (SELECT k.*, now FROM k, n WHERE x IS NULL OR now < x)"""


@query(f"""WITH {KA}, q AS (SELECT o_custkey AS req, CAST(unnest([o_orderkey, o_custkey, 7]) AS VARCHAR) AS key FROM orders)
SELECT req, count(a.key) AS exists_reply, count(DISTINCT a.key) AS del_reply FROM q LEFT JOIN a USING (key) GROUP BY req""")
def exists_and_del_all(spark, sf):
    """exists_and_del over a key of every event."""
    o = table(spark, sf, "orders")
    asked = o.select(F.col("o_custkey").alias("req"), F.explode(F.array(*[x.cast("string") for x in (F.col("o_orderkey"), F.col("o_custkey"), F.lit(7))])).alias("key"))
    return keys.exists_counts(asked, _all_keys(spark, sf), _mid(spark, sf))


@query(f"""WITH {KA}, q AS (SELECT CAST(c_custkey AS VARCHAR) AS key FROM customer UNION SELECT CAST(o_orderkey AS VARCHAR) FROM orders)
SELECT q.key, coalesce(type, 'none') AS type, CASE WHEN a.key IS NULL THEN -2 WHEN x IS NULL THEN -1 ELSE (x - a.now) // 1000000 END AS ttl FROM q LEFT JOIN a USING (key)""")
def type_and_ttl_all(spark, sf):
    """type_and_ttl over a key of every event, asked for every customer's and order's id."""
    ids = [table(spark, sf, t).select(F.col(c).cast("string").alias("key")) for t, c in (("customer", "c_custkey"), ("orders", "o_orderkey"))]
    return keys.type_and_ttl(ids[0].unionByName(ids[1]).distinct(), _all_keys(spark, sf), _mid(spark, sf))


@query(f"""WITH {KA} SELECT k.key, CASE WHEN (x IS NULL OR now < x) AND CAST(k.key AS BIGINT) % 2 = 0 THEN now + 60000000 ELSE x END AS expires_at_us,
CAST((x IS NULL OR now < x) AND CAST(k.key AS BIGINT) % 2 = 0 AS BIGINT) AS reply FROM k, n""")
def expire_all(spark, sf):
    """expire over a key of every event."""
    k = _all_keys(spark, sf)
    asked = k.filter(F.col("key").cast("bigint") % 2 == 0).select("key", F.lit(60).cast("bigint").alias("seconds"))
    return keys.expire(k, asked, _mid(spark, sf)).select("key", "expires_at_us", "reply")


@query(f"""WITH {KA} SELECT count(*) AS total_keys, count(*) FILTER (type = 'string') AS string_keys, count(*) FILTER (type = 'hash') AS hash_keys, count(*) FILTER (type = 'list') AS list_keys,
count(*) FILTER (type = 'set') AS set_keys, count(*) FILTER (type = 'zset') AS zset_keys FROM a""")
def info_all(spark, sf):
    """info over a key of every event."""
    return keys.info(_all_keys(spark, sf), _mid(spark, sf))


@query("SELECT chr(35) || ' Server' || chr(13) || chr(10) || chr(35) || ' Keyspace' || chr(13) || chr(10) || 'total_keys:6' || chr(13) || chr(10) || 'string_keys:1' || chr(13) || chr(10) || 'hash_keys:2' || chr(13) || chr(10) || 'list_keys:0' || chr(13) || chr(10) || 'set_keys:3' || chr(13) || chr(10) || chr(13) || chr(10) || chr(35) || ' PubSub' || chr(13) || chr(10) || 'channels:4' || chr(13) || chr(10) || 'subscribers:5' || chr(13) || chr(10) AS reply")
def info_text(spark, sf):
    return spark.range(1).select(keys.info_text(*map(F.lit, (6, 1, 2, 0, 3, 4, 5))).alias("reply"))


def _member_log(spark, sf):
    e = events(spark, sf)
    return e.select(F.col("event_type").alias("key"), F.col("key").alias("member"), "seq", F.lit("PUT").alias("op"), "value")


def _mixed_members(spark, sf):
    e = events(spark, sf)
    op = F.when(F.col("event_type").isin("click", "view"), "PUT").otherwise("CUT")
    return e.select((F.col("seq") % 10).cast("string").alias("key"), F.col("key").alias("member"), "seq", op.alias("op"), "value")


@query(f"WITH {E} SELECT event_type AS key, key AS member, seq, CAST(row_number() OVER (PARTITION BY event_type, key ORDER BY seq) = 1 AS BIGINT) AS reply FROM e")
def sadd_replies(spark, sf):
    return collections.member_replies(_member_log(spark, sf)).select("key", "member", "seq", F.col("changed").alias("reply"))


MIXED = E + ", m AS (SELECT CAST(seq % 10 AS VARCHAR) AS key, key AS member, seq, CASE WHEN event_type IN ('click', 'view') THEN 'PUT' ELSE 'CUT' END AS op, value FROM e)"
REPLIES = MIXED + ", b AS (SELECT *, lag(op) OVER (PARTITION BY key, member ORDER BY seq) AS p FROM m)"


@query(f"WITH {REPLIES} SELECT key, member, seq, CAST(CASE WHEN op = 'PUT' THEN p IS NULL OR p = 'CUT' ELSE coalesce(p, '') = 'PUT' END AS BIGINT) AS reply FROM b")
def sadd_srem_replies(spark, sf):
    """SADD and SREM (or HSET and HDEL) in one log."""
    return collections.member_replies(_mixed_members(spark, sf)).select("key", "member", "seq", F.col("changed").alias("reply"))


@query(f"WITH {MIXED} SELECT key, member, arg_max(CAST(value AS VARCHAR), seq) AS v FROM (SELECT key, member, seq, seq AS value, op FROM m) GROUP BY key, member HAVING arg_max(op, seq) = 'PUT'")
def hset_hdel_snapshot(spark, sf):
    log = _mixed_members(spark, sf).withColumn("value", F.col("seq").cast("string"))
    return collections.snapshot(log, "value").select("key", "member", F.col("value").alias("v"))


@query(f"WITH {MIXED}, s AS (SELECT key, member FROM m GROUP BY key, member HAVING arg_max(op, seq) = 'PUT') SELECT key, member, row_number() OVER (PARTITION BY key ORDER BY member) - 1 AS idx FROM s")
def smembers(spark, sf):
    return collections.sorted_members(collections.snapshot(_mixed_members(spark, sf), "seq").select("key", "member"))


@query("SELECT lang AS key, count(*) AS card FROM documents GROUP BY lang")
def scard(spark, sf):
    return collections.card(table(spark, sf, "documents").select(F.col("lang").alias("key"), F.col("doc_id").alias("member")).distinct())


@query("SELECT 'en' AS key, CAST(l.doc_id AS VARCHAR) AS member, CAST(coalesce(d.lang = 'en', false) AS BIGINT) AS reply FROM labels l LEFT JOIN documents d USING (doc_id)")
def sismember(spark, sf):
    members = table(spark, sf, "documents").select(F.col("lang").alias("key"), F.col("doc_id").cast("string").alias("member"))
    return collections.is_member(table(spark, sf, "labels").select(F.lit("en").alias("key"), F.col("doc_id").cast("string").alias("member")), members)


@query("SELECT lang AS key, CAST(doc_id AS VARCHAR) AS member FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def srem(spark, sf):
    members = table(spark, sf, "documents").select(F.col("lang").alias("key"), F.col("doc_id").cast("string").alias("member"))
    gone = table(spark, sf, "labels").filter("quality = 0").select(F.col("doc_id").cast("string").alias("member"))
    return collections.remove(members, members.join(gone, "member", "left_semi").select("key", "member"))


def _hashes(spark, sf):
    c = table(spark, sf, "customer")
    fields = F.array(*[F.struct(F.lit(f).alias("member"), F.col(f"c_{f}").cast("string").alias("value")) for f in ("name", "mktsegment", "nationkey")])
    return c.select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("key"), F.explode(fields).alias("f")).select("key", "f.*")


H = "h AS (SELECT 'customer:' || c_custkey AS key, unnest(['name', 'mktsegment', 'nationkey']) AS member, unnest([c_name, c_mktsegment, CAST(c_nationkey AS VARCHAR)]) AS value FROM customer)"


@query(f"WITH {H} SELECT key, array_to_string(list(member || '=' || value ORDER BY member), ',') AS reply FROM h GROUP BY key")
def hgetall(spark, sf):
    flat = collections.hgetall(_hashes(spark, sf))
    pairs = F.transform(F.sequence(F.lit(0), F.size("reply") - 2, F.lit(2)), lambda i: F.concat(F.get("reply", i), F.lit("="), F.get("reply", i + 1)))
    return flat.select("key", F.array_join(pairs, ",").alias("reply"))


@query(f"WITH {H}, q AS (SELECT 'customer:' || o_custkey AS key, CASE WHEN o_orderkey % 3 = 0 THEN 'absent' ELSE 'mktsegment' END AS member, o_orderkey FROM orders) SELECT o_orderkey AS seq, value AS reply FROM q LEFT JOIN h USING (key, member)")
def hget(spark, sf):
    q = table(spark, sf, "orders").select(F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")).alias("key"), F.when(F.col("o_orderkey") % 3 == 0, "absent").otherwise("mktsegment").alias("member"), F.col("o_orderkey").alias("seq"))
    return q.join(_hashes(spark, sf), ["key", "member"], "left").select("seq", F.col("value").alias("reply"))


@query(f"WITH {H} SELECT key, count(*) AS card FROM h WHERE NOT (member = 'name' AND CAST(substr(key, 10) AS BIGINT) % 2 = 0) GROUP BY key")
def hdel(spark, sf):
    gone = table(spark, sf, "customer").filter("c_custkey % 2 = 0").select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("key"), F.lit("name").alias("member"))
    return collections.card(collections.remove(_hashes(spark, sf), gone))


@query(f"WITH {H} SELECT key, member, CASE WHEN member = 'name' AND CAST(substr(key, 10) AS BIGINT) % 5 = 0 THEN 'renamed' ELSE value END AS value FROM h")
def hset(spark, sf):
    new = table(spark, sf, "customer").filter("c_custkey % 5 = 0").select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("key"), F.lit("name").alias("member"), F.lit("renamed").alias("value"))
    return collections.put(_hashes(spark, sf), new)


def _board(spark, sf):
    e = events(spark, sf).select(F.lit("board").alias("key"), F.col("key").alias("member"), "seq", F.lit("PUT").alias("op"), F.col("value").alias("score"))
    return collections.snapshot(e, "score")


Z = E + ", z AS (SELECT key AS member, arg_max(value, seq) AS score FROM e GROUP BY key)"


@query(f"WITH {Z} SELECT * FROM (SELECT row_number() OVER (ORDER BY score, member) - 1 AS idx, member, score FROM z) WHERE idx <= 9")
def zrange_leaderboard(spark, sf):
    """ZADD keeps the last score, ZRANGE 0 9 the lowest ten."""
    return collections.zrange(_board(spark, sf), 0, 9).select("idx", "member", "score")


@query(f"WITH {Z}, r AS (SELECT row_number() OVER (ORDER BY score DESC, member DESC) AS r, member, score FROM z) SELECT 10 - r AS idx, member, score FROM r WHERE r <= 10 AND r >= 2")
def zrange_from_end(spark, sf):
    return collections.zrange(_board(spark, sf), -10, -2).select("idx", "member", "score")


@query(f"WITH {Z}, r AS (SELECT row_number() OVER (ORDER BY score, member) - 1 AS r, count(*) OVER () AS n, member, score FROM z) SELECT r - 5 AS idx, member, score FROM r WHERE r >= 5 AND r <= n - 6")
def zrange_mixed(spark, sf):
    return collections.zrange(_board(spark, sf), 5, -6).select("idx", "member", "score")


@query("SELECT event_type AS key, count(DISTINCT user_id) AS card FROM events GROUP BY event_type")
def zcard(spark, sf):
    return collections.card(collections.snapshot(_member_log(spark, sf).withColumnRenamed("value", "score"), "score"))


@query("WITH z AS (SELECT event_type AS key, user_id, arg_max(value, event_id) AS s FROM events GROUP BY 1, 2) SELECT key, count(*) FILTER (s >= 10 AND s <= 50) AS removed, count(*) FILTER (NOT (s >= 10 AND s <= 50)) AS stay FROM z GROUP BY key")
def zremrangebyscore(spark, sf):
    z = collections.snapshot(_member_log(spark, sf).withColumnRenamed("value", "score"), "score")
    stay, gone = collections.zremrangebyscore(z, F.lit(10.0), F.lit(50.0))
    return gone.join(collections.card(stay).withColumnRenamed("card", "stay"), "key", "left").withColumn("stay", F.coalesce("stay", F.lit(0)))


@query(f"WITH {E} SELECT key, seq, count(*) OVER (PARTITION BY key ORDER BY ts_us RANGE BETWEEN {24 * HOUR - 1} PRECEDING AND CURRENT ROW) AS hits FROM e")
def rate_limit(spark, sf):
    """ZADD, ZREMRANGEBYSCORE and ZCARD as a sliding day."""
    return patterns.sliding_counts(events(spark, sf).select("key", "seq", "ts_us"), 24 * HOUR).select("key", "seq", "hits")


@query(f"""WITH {E}, g AS (SELECT *, CASE WHEN ts_us < lag(ts_us) OVER w + {6 * HOUR} THEN 0 ELSE 1 END AS f FROM e WINDOW w AS (PARTITION BY key ORDER BY ts_us)),
s AS (SELECT *, sum(f) OVER (PARTITION BY key ORDER BY ts_us) AS session FROM g) SELECT key, CAST(session AS BIGINT) AS session, min(ts_us) AS online_from, max(ts_us) + {6 * HOUR} AS online_to, count(*) AS beats FROM s GROUP BY key, session""")
def presence(spark, sf):
    """HSET and EXPIRE heartbeats."""
    return patterns.presence(events(spark, sf).select("key", "ts_us"), 6 * HOUR)


def _list_log(spark, sf):
    e = events(spark, sf)
    return e.select("key", "seq", F.when(F.col("event_type").isin("click", "view"), "PUSH").otherwise("POP").alias("op"), F.col("seq").alias("item"))


Q = E + """, l AS (SELECT key, seq, CASE WHEN event_type IN ('click', 'view') THEN 1 ELSE -1 END AS d FROM e),
s AS (SELECT *, sum(d) OVER (PARTITION BY key ORDER BY seq) AS s FROM l), m AS (SELECT *, least(0, min(s) OVER (PARTITION BY key ORDER BY seq)) AS m FROM s),
o AS (SELECT *, d < 0 AND m = coalesce(lag(m) OVER (PARTITION BY key ORDER BY seq), 0) AS ok FROM m),
n AS (SELECT *, sum(CASE WHEN d > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY seq) AS pushes, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY seq) AS pops FROM o)"""


@query(f"WITH {Q} SELECT n.key, n.seq, CAST(n.s - n.m AS BIGINT) AS len, p.seq AS popped FROM n LEFT JOIN n p ON n.ok AND p.d > 0 AND p.key = n.key AND p.pushes = n.pops")
def rpush_lpop_queue(spark, sf):
    return lists.queue_replies(_list_log(spark, sf)).select("key", "seq", "len", "popped")


@query(f"""WITH {Q}, v AS (SELECT key, seq, d, ok, s - m AS len, CASE WHEN d > 0 THEN s - m WHEN ok THEN s - m + 1 END AS level FROM n)
SELECT key, seq, CAST(len AS BIGINT) AS len, CASE WHEN ok THEN lag(seq) OVER (PARTITION BY key, level ORDER BY seq) END AS popped FROM v""")
def rpush_rpop_stack(spark, sf):
    return lists.stack_replies(_list_log(spark, sf)).select("key", "seq", "len", "popped")


def _turns(spark, sf):
    return table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("key"), F.col("turn").alias("seq"), F.col("text").alias("value"))


T = "t AS (SELECT CAST(conv_id AS VARCHAR) AS key, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, count(*) OVER (PARTITION BY conv_id) AS n, text AS value FROM conversations)"


@query(f"WITH {T} SELECT key, pos - greatest(n - 3, 0) AS idx, value FROM t WHERE pos >= n - 3")
def rpush_lrange(spark, sf):
    """RPUSH then LRANGE -3 -1."""
    return lists.lrange(lists.rpushed(_turns(spark, sf)).select("key", "pos", "value"), F.lit(-3), F.lit(-1))


@query(f"WITH {T} SELECT key, n - 1 - pos AS idx, value FROM t WHERE n - 1 - pos <= 1")
def lpush_lrange(spark, sf):
    """LPUSH then LRANGE 0 1."""
    return lists.lrange(lists.lpushed(_turns(spark, sf)).select("key", "pos", "value"), F.lit(0), F.lit(1))


def _pubsub(spark, sf):
    e = events(spark, sf).withColumn("channel", F.concat(F.lit("c"), (F.col("key").cast("bigint") % 4).cast("string")))
    subs = e.filter(F.col("event_type").isin("signup", "error")).select(F.col("key").alias("sub"), "channel", "seq", F.when(F.col("event_type") == "signup", "SUB").otherwise("UNSUB").alias("op"))
    return pubsub.intervals(subs), e.filter("event_type = 'purchase'").select("seq", "channel", F.col("seq").cast("string").alias("payload"))


P = E + """, c AS (SELECT key AS sub, 'c' || (CAST(key AS BIGINT) % 4) AS channel, seq, event_type FROM e),
x AS (SELECT *, coalesce(lag(event_type) OVER (PARTITION BY sub ORDER BY seq), 'error') AS p FROM c WHERE event_type IN ('signup', 'error')),
i AS (SELECT sub, channel, seq AS a, event_type, lead(seq) OVER (PARTITION BY sub ORDER BY seq) AS b FROM x WHERE event_type <> p)"""


@query(f"WITH {P} SELECT c.channel, c.seq, count(i.sub) AS reply FROM c LEFT JOIN i ON i.event_type = 'signup' AND i.channel = c.channel AND i.a < c.seq AND (i.b IS NULL OR c.seq < i.b) WHERE c.event_type = 'purchase' GROUP BY 1, 2")
def publish_counts(spark, sf):
    """SUBSCRIBE, UNSUBSCRIBE, and what PUBLISH returns."""
    subs, pubs = _pubsub(spark, sf)
    return pubsub.publish_counts(pubs, subs)


@query(f"WITH {P} SELECT i.sub, c.channel, c.seq, CAST(c.seq AS VARCHAR) AS payload FROM c JOIN i ON i.event_type = 'signup' AND i.channel = c.channel AND i.a < c.seq AND (i.b IS NULL OR c.seq < i.b) WHERE c.event_type = 'purchase'")
def deliveries(spark, sf):
    subs, pubs = _pubsub(spark, sf)
    return pubsub.deliveries(pubs, subs)


#: Two days without a command.
IDLE_US = 172_800_000_000


@query(f"""WITH {E}, a AS (SELECT *, lead(ts_us) OVER (PARTITION BY key ORDER BY seq) AS n FROM e),
d AS (SELECT key, min(ts_us) + {IDLE_US} AS gone FROM a WHERE n IS NULL OR n - ts_us > {IDLE_US} GROUP BY 1),
c AS (SELECT e.key AS sub, 'c' || (CAST(e.key AS BIGINT) % 4) AS channel, seq, event_type, ts_us, gone FROM e JOIN d ON e.key = d.key),
x AS (SELECT *, coalesce(lag(event_type) OVER (PARTITION BY sub ORDER BY seq), 'error') AS p FROM c WHERE event_type IN ('signup', 'error') AND ts_us <= gone),
i AS (SELECT *, lead(seq) OVER (PARTITION BY sub ORDER BY seq) AS b FROM x WHERE event_type <> p)
SELECT i.sub, c.channel, c.seq, CAST(c.seq AS VARCHAR) AS payload FROM c JOIN i ON i.event_type = 'signup' AND i.channel = c.channel AND i.seq < c.seq AND (i.b IS NULL OR c.seq < i.b)
AND c.ts_us <= i.gone WHERE c.event_type = 'purchase'""")
def deliveries_until_idle(spark, sf):
    """Deliveries to connections that the idle timeout ends; every event is a command of its user's connection."""
    e = events(spark, sf).withColumn("channel", F.concat(F.lit("c"), (F.col("key").cast("bigint") % 4).cast("string"))).withColumnRenamed("key", "sub")
    edges = e.filter(F.col("event_type").isin("signup", "error")).select("sub", "channel", "seq", "ts_us", F.when(F.col("event_type") == "signup", "SUB").otherwise("UNSUB").alias("op"))
    pubs = e.filter("event_type = 'purchase'").select("seq", "ts_us", "channel", F.col("seq").cast("string").alias("payload"))
    return pubsub.deliveries(pubs, pubsub.intervals_until_idle(edges, e.select("sub", "seq", "ts_us"), IDLE_US))


@query(f"WITH {P} SELECT count(DISTINCT channel) AS channels, count(DISTINCT sub) AS subscribers FROM i WHERE event_type = 'signup' AND b IS NULL")
def hub_stats(spark, sf):
    return pubsub.hub_stats(_pubsub(spark, sf)[0])


def _batch_width(spark, sf):
    """Numbers of the log that a customer takes: a MULTI, any order and an end."""
    # one number, read first: as a subquery it would stand in each of the log's many copies in the plan
    return F.lit((table(spark, sf, "orders").agg(F.max("o_orderkey").cast("bigint")).first()[0] or 0) + 3)


def _batches(spark, sf):
    """Each customer's orders are a batch of INCR, ended by EXEC, DISCARD (every 7th customer) or nothing (every 11th)."""
    o, wide = table(spark, sf, "orders").select("o_custkey", "o_orderkey"), _batch_width(spark, sf)
    line = lambda df, n, cmd, args: df.select((F.col("o_custkey") * wide + n).alias("seq"), F.lit(0).cast("bigint").alias("ts_us"), F.col("o_custkey").cast("string").alias("conn_id"), cmd.alias("cmd"), args.alias("args"))
    none = F.array().cast("array<string>")
    who = o.select("o_custkey").distinct()
    end = F.when(F.col("o_custkey") % 7 == 0, "DISCARD").when(F.col("o_custkey") % 11 == 0, "PING").otherwise("EXEC")
    return line(who, F.lit(0), F.lit("MULTI"), none).unionByName(line(o, F.col("o_orderkey") + 1, F.lit("INCR"), F.array(F.concat(F.lit("k"), F.col("o_custkey").cast("string"))))).unionByName(line(who, wide - 1, end, none))


@query("""WITH o AS (SELECT o_custkey AS c, o_orderkey AS k FROM orders), w AS (SELECT DISTINCT c, CASE WHEN c % 7 = 0 THEN 'DISCARD' WHEN c % 11 = 0 THEN 'PING' ELSE 'EXEC' END AS e FROM o)
SELECT c * 10000000 AS seq, 0 AS pos, '+OK' AS reply FROM w
UNION ALL SELECT c * 10000000 + k + 1, 0, '+QUEUED' FROM o
UNION ALL SELECT c * 10000000 + 9999999, CASE e WHEN 'EXEC' THEN -1 ELSE 0 END, CASE e WHEN 'DISCARD' THEN '+OK' WHEN 'PING' THEN '+QUEUED' ELSE '*' || (SELECT count(*) FROM o WHERE o.c = w.c) END FROM w
UNION ALL SELECT c * 10000000 + 9999999, row_number() OVER (PARTITION BY c ORDER BY k) - 1, ':' || row_number() OVER (PARTITION BY c ORDER BY k) FROM o JOIN w USING (c) WHERE e = 'EXEC'""")
def multi_exec_discard(spark, sf):
    replies, _ = run_log(_batches(spark, sf))
    # the SQL's numbers, which may meet for large order keys, are given after the log has run
    wide = _batch_width(spark, sf)
    n = F.pmod("seq", wide)
    return replies.select((F.call_function("div", F.col("seq"), wide) * 10_000_000 + F.when(n == wide - 1, 9_999_999).otherwise(n)).alias("seq"), "pos", F.regexp_replace(encode_reply(F.col("reply")), "\r\n", "").alias("reply"))


CRLF = "chr(13) || chr(10)"
BULK = lambda x: f"'$' || octet_length(encode({x})) || {CRLF} || {x} || {CRLF}"
NIL = f"'$-1' || {CRLF}"
INT = lambda x: f"':' || ({x}) || {CRLF}"

#: One family of keys after the other; counters and deques are order-dependent and go through their commands one by one.
MIXED = f"""WITH RECURSIVE {E}, m AS (SELECT *, seq % 16 AS k FROM e),
sw AS (SELECT key, seq, k, ts_us, last_value(CASE WHEN k IN (0, 13) THEN seq END IGNORE NULLS) OVER w AS wseq, last_value(CASE WHEN k IN (0, 13) THEN ts_us END IGNORE NULLS) OVER w AS wts
  FROM m WHERE k IN (0, 2, 13) WINDOW w AS (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
sa AS (SELECT *, coalesce(wseq % 16 = 0 AND ts_us < wts + 86400000000, false) AS alive FROM sw),
nl AS (SELECT key, seq, k, ts_us, row_number() OVER (PARTITION BY key ORDER BY seq) AS i FROM m WHERE k IN (1, 3, 13, 15)),
nr AS (SELECT DISTINCT key, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS BIGINT) AS k, CAST(NULL AS BIGINT) AS v, CAST(NULL AS BIGINT) AS dl, CAST(NULL AS BIGINT) AS r FROM nl
  UNION ALL SELECT key, i, seq, k, CASE k WHEN 1 THEN coalesce(a, 0) + 1 WHEN 13 THEN NULL ELSE a END, CASE WHEN a IS NULL OR k = 13 THEN NULL WHEN k = 3 THEN ts_us + 43200000000 ELSE dl END,
    CASE k WHEN 1 THEN coalesce(a, 0) + 1 WHEN 15 THEN CASE WHEN a IS NULL THEN -2 WHEN dl IS NULL THEN -1 ELSE (dl - ts_us) // 1000000 END ELSE CAST(a IS NOT NULL AS BIGINT) END
  FROM (SELECT nl.*, CASE WHEN nr.dl IS NULL OR nl.ts_us < nr.dl THEN nr.v END AS a, nr.dl FROM nr JOIN nl ON nl.key = nr.key AND nl.i = nr.i + 1)),
hl AS (SELECT key, seq, k, lag(k) OVER (PARTITION BY key, event_type ORDER BY seq) AS p FROM m WHERE k IN (4, 5)),
hr AS (SELECT key, seq, k, CASE WHEN k = 4 THEN CAST(p IS DISTINCT FROM 4 AS BIGINT) ELSE CAST(coalesce(p = 4, false) AS BIGINT) END AS r FROM hl),
hx AS (SELECT key, seq, k, sum(d) OVER (PARTITION BY key ORDER BY seq) > 0 AS held FROM (SELECT key, seq, k, CASE k WHEN 4 THEN r ELSE -r END AS d FROM hr UNION ALL SELECT key, seq, k, 0 FROM m WHERE k = 14)),
ll AS (SELECT key, seq, k, event_type, row_number() OVER (PARTITION BY key ORDER BY seq) AS i FROM m WHERE k IN (6, 7, 8, 9, 14)),
lr AS (SELECT DISTINCT key, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS q, CAST(NULL AS VARCHAR) AS popped FROM ll
  UNION ALL SELECT ll.key, ll.i, ll.seq, ll.k, CASE ll.k WHEN 6 THEN list_append(q, CAST(ll.seq AS VARCHAR)) WHEN 7 THEN list_concat([ll.event_type, CAST(ll.seq AS VARCHAR)], q) WHEN 8 THEN q[2:] WHEN 9 THEN q[:len(q) - 1] ELSE q END, CASE ll.k WHEN 8 THEN q[1] WHEN 9 THEN q[len(q)] END
  FROM lr JOIN ll ON ll.key = lr.key AND ll.i = lr.i + 1),
tr AS (SELECT seq, CAST(row_number() OVER (PARTITION BY event_type, key ORDER BY seq) = 1 AS BIGINT) AS r FROM m WHERE k = 10),
zw AS (SELECT key, seq, k, max(CASE WHEN k = 12 THEN seq END) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cut, CASE WHEN k = 11 THEN lag(seq) OVER u END AS p, CASE WHEN k = 11 THEN lead(seq) OVER u END AS nx
  FROM m WHERE k IN (11, 12) WINDOW u AS (PARTITION BY k, key ORDER BY seq)),
zr AS (SELECT seq, CAST(p IS NULL OR coalesce(cut >= p + 2000, false) AS BIGINT) AS r FROM zw WHERE k = 11
  UNION ALL SELECT c.seq, count(a.seq) FROM zw c LEFT JOIN zw a ON a.k = 11 AND a.seq <= c.seq - 2000 AND (c.cut IS NULL OR a.seq > c.cut - 2000) AND (a.nx IS NULL OR a.nx > c.seq) WHERE c.k = 12 GROUP BY c.seq),
x AS (SELECT seq, '+OK' || {CRLF} AS reply FROM m WHERE k = 0
  UNION ALL SELECT seq, CASE WHEN alive THEN {BULK("CAST(wseq AS VARCHAR)")} ELSE {NIL} END FROM sa WHERE k = 2
  UNION ALL SELECT seq, {INT("r")} FROM nr WHERE k IN (1, 3, 15) UNION ALL SELECT seq, {INT("r")} FROM hr UNION ALL SELECT seq, {INT("r")} FROM tr UNION ALL SELECT seq, {INT("r")} FROM zr
  UNION ALL SELECT seq, {INT("len(q)")} FROM lr WHERE k IN (6, 7) UNION ALL SELECT seq, CASE WHEN popped IS NULL THEN {NIL} ELSE {BULK("popped")} END FROM lr WHERE k IN (8, 9)
  UNION ALL SELECT nr.seq, {INT("nr.r + CAST(sa.alive AS BIGINT)")} FROM nr JOIN sa ON sa.seq = nr.seq WHERE nr.k = 13
  UNION ALL SELECT hx.seq, {INT("2 * CAST(hx.held AS BIGINT) + CAST(len(lr.q) > 0 AS BIGINT)")} FROM hx JOIN lr ON lr.seq = hx.seq WHERE hx.k = 14)
SELECT seq, 0 AS pos, reply FROM x"""


@query(MIXED)
def mixed_log_replies(spark, sf):
    """Every event as one of 16 commands, through the whole engine (conditional deletes and deadlines are order-dependent)."""
    replies, _ = run_log(command_log(spark, sf))
    return replies.select("seq", "pos", encode_reply(F.col("reply")).alias("reply"))


WRONG = f"'-WRONGTYPE Operation against a key holding the wrong kind of value' || {CRLF}"


@query(f"""WITH RECURSIVE {E}, l AS (SELECT key, seq, ts_us, event_type, seq % 10 AS k, row_number() OVER (PARTITION BY key ORDER BY seq) AS i FROM e),
r AS (SELECT DISTINCT key, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS BIGINT) AS v, CAST(NULL AS BIGINT) AS dl, CAST(NULL AS VARCHAR[]) AS s, CAST(NULL AS VARCHAR) AS reply FROM l
  UNION ALL SELECT key, i, seq, CASE WHEN k IN (0, 1) THEN seq WHEN k = 5 THEN NULL WHEN k IN (2, 9) AND s IS NULL THEN coalesce(a, 0) + 1 ELSE a END,
    CASE WHEN k = 1 THEN ts_us + 7200000000 WHEN k IN (0, 5) OR a IS NULL THEN NULL ELSE dl END,
    CASE WHEN k IN (0, 1, 5) THEN NULL WHEN k = 4 AND a IS NULL THEN CASE WHEN s IS NULL THEN [event_type] WHEN list_contains(s, event_type) THEN s ELSE list_append(s, event_type) END ELSE s END,
    CASE WHEN k IN (0, 1) THEN '+OK' || {CRLF} WHEN k = 6 THEN '-ERR value is not an integer or out of range' || {CRLF} WHEN k = 7 THEN '-ERR syntax error' || {CRLF}
      WHEN k = 8 THEN '+' || CASE WHEN a IS NOT NULL THEN 'string' WHEN s IS NOT NULL THEN 'set' ELSE 'none' END || {CRLF} WHEN k = 5 THEN {INT("CAST(a IS NOT NULL OR s IS NOT NULL AS BIGINT)")}
      WHEN k = 4 THEN CASE WHEN a IS NOT NULL THEN {WRONG} ELSE {INT("CAST(s IS NULL OR NOT list_contains(s, event_type) AS BIGINT)")} END
      WHEN s IS NOT NULL THEN {WRONG} WHEN k = 3 THEN CASE WHEN a IS NULL THEN {NIL} ELSE {BULK("CAST(a AS VARCHAR)")} END ELSE {INT("coalesce(a, 0) + 1")} END
  FROM (SELECT l.*, CASE WHEN r.dl IS NULL OR l.ts_us < r.dl THEN r.v END AS a, r.dl, r.s FROM r JOIN l ON l.key = r.key AND l.i = r.i + 1))
SELECT seq, reply FROM r WHERE i > 0""")
def typed_log_replies(spark, sf):
    """SET with options, INCR on what SET and INCR left, sets on the same keys: wrong types, syntax and number errors."""
    return run_log(typed_log(spark, sf))[0].select("seq", encode_reply(F.col("reply")).alias("reply"))


@query(f"""WITH {E}, l AS (SELECT *, seq % 7 < 5 AS ok FROM e), f AS (SELECT event_type, key, min(seq) AS seq FROM l WHERE ok GROUP BY 1, 2)
SELECT l.seq, CASE WHEN NOT ok THEN '-ERR value is not a valid float' || {CRLF} ELSE {INT("CAST(f.seq = l.seq AS BIGINT)")} END AS reply FROM l LEFT JOIN f ON f.event_type = l.event_type AND f.key = l.key""")
def zadd_replies(spark, sf):
    """ZADD in a log, with infinite, NaN, hexadecimal, overflowing and wrong scores."""
    return run_log(score_log(spark, sf))[0].select("seq", encode_reply(F.col("reply")).alias("reply"))


@query(f"""WITH {E}, l AS (SELECT * FROM e), z AS (SELECT event_type AS key, key AS member, arg_max(seq, seq) AS seq FROM l WHERE seq % 7 < 5 GROUP BY 1, 2),
s AS (SELECT key, member, CASE seq % 7 WHEN 0 THEN CAST(seq AS DOUBLE) WHEN 1 THEN 'inf'::DOUBLE WHEN 2 THEN '-inf'::DOUBLE WHEN 3 THEN NULL ELSE 24.0 END AS score FROM z)
SELECT key, member, CAST(row_number() OVER (PARTITION BY key ORDER BY score NULLS LAST, member) - 1 AS BIGINT) AS idx FROM s""")
def zset_order(spark, sf):
    """The sorted sets that score_log leaves: infinities at the ends, NaN after them."""
    z = relations(run_log(score_log(spark, sf))[1], F.lit(0))["zset_members"]
    return collections.zrange(z, 0, -1).select("key", "member", "idx")


PUSH = lambda word, n: f"'*3' || {CRLF} || {BULK(word)} || {BULK('channel')} || {INT(n)}"


@query(f"""WITH {P}, s AS (SELECT a AS f, b, sub, channel FROM i WHERE event_type = 'signup'),
q AS (SELECT c.*, coalesce(last_value(CASE WHEN event_type IN ('signup', 'error') THEN event_type END IGNORE NULLS) OVER (PARTITION BY sub ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 'signup', false) AS subscribed FROM c),
n AS (SELECT p.seq, count(s.sub) FILTER (s.channel = p.channel) AS here, count(s.sub) AS subs, count(DISTINCT s.channel) AS channels FROM c p LEFT JOIN s ON s.f < p.seq AND (s.b IS NULL OR p.seq < s.b) WHERE p.event_type = 'purchase' GROUP BY p.seq)
SELECT seq, CASE event_type WHEN 'signup' THEN {PUSH("'subscribe'", "1")} WHEN 'error' THEN {PUSH("'unsubscribe'", "0")} WHEN 'view' THEN '+PONG' || {CRLF}
  ELSE CASE WHEN subscribed THEN '-ERR only (P)SUBSCRIBE / (P)UNSUBSCRIBE / PING are allowed in this context' || {CRLF} ELSE {NIL} END END AS reply FROM q WHERE event_type <> 'purchase'
UNION ALL SELECT seq, CASE WHEN seq % 8 <> 0 THEN {INT("here")} ELSE {BULK("'# Server' || " + CRLF + " || '# Keyspace' || " + CRLF + " || 'total_keys:0' || " + CRLF + " || 'string_keys:0' || " + CRLF + " || 'hash_keys:0' || " + CRLF + " || 'list_keys:0' || " + CRLF + " || 'set_keys:0' || " + CRLF + " || " + CRLF + " || '# PubSub' || " + CRLF + " || 'channels:' || channels || " + CRLF + " || 'subscribers:' || subs || " + CRLF)} END FROM n""")
def subscriber_replies(spark, sf):
    """Every user a connection: SUBSCRIBE, UNSUBSCRIBE, what is allowed in between, PUBLISH and INFO, through the whole engine."""
    return run_log(subscriber_log(spark, sf))[0].select("seq", encode_reply(F.col("reply")).alias("reply"))


@query(f"""WITH {P}, d AS (SELECT i.sub, c.channel, c.seq FROM c JOIN i ON i.event_type = 'signup' AND i.channel = c.channel AND i.a < c.seq AND (i.b IS NULL OR c.seq < i.b) WHERE c.event_type = 'purchase')
SELECT sub, seq, '*3' || {CRLF} || {BULK("'message'")} || {BULK("channel")} || {BULK("CAST(seq AS VARCHAR)")} AS message FROM d""")
def messages(spark, sf):
    """What each subscriber is sent, as wire text."""
    subs, pubs = _pubsub(spark, sf)
    encoded = pubs.withColumn("payload", encode_message(F.col("channel"), F.col("payload")))  # once a message, not once a delivery
    return pubsub.deliveries(encoded, subs).select("sub", "seq", F.col("payload").alias("message"))


@query(f"""WITH {P}, d AS (SELECT i.sub, c.channel, c.seq FROM c JOIN i ON i.event_type = 'signup' AND i.channel = c.channel AND i.a < c.seq AND (i.b IS NULL OR c.seq < i.b) WHERE c.event_type = 'purchase'),
st AS (SELECT sub, seq, 1 AS d FROM d UNION ALL SELECT sub, seq, -3 FROM c WHERE event_type = 'view'),
su AS (SELECT *, sum(d) OVER (PARTITION BY sub ORDER BY seq ROWS UNBOUNDED PRECEDING) AS s FROM st), wa AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY sub ORDER BY seq ROWS UNBOUNDED PRECEDING)) AS wait FROM su),
g AS (SELECT sub, min(seq) AS gone FROM wa WHERE d = 1 AND wait > 2 GROUP BY sub)
SELECT d.sub, d.channel, d.seq FROM d LEFT JOIN g USING (sub) WHERE gone IS NULL OR d.seq < gone""")
def deliveries_with_eviction(spark, sf):
    """Subscribers with a buffer of 2 messages that take up to 3 out whenever they view something."""
    subs, pubs = _pubsub(spark, sf)
    drains = events(spark, sf).filter("event_type = 'view'").select(F.col("key").alias("sub"), "seq", F.lit(3).alias("n"))
    return pubsub.deliveries_with_eviction(pubs, subs, drains, 2).select("sub", "channel", "seq")


@query(f"""WITH {E} SELECT CAST(seq AS VARCHAR) AS conn_id, 0 AS i, 'SET' AS cmd, key || '|' || event_type || chr(13) || chr(10) AS args FROM e
UNION ALL SELECT CAST(seq AS VARCHAR), 1, 'GET', key FROM e UNION ALL SELECT CAST(seq AS VARCHAR), 2, 'ERROR', 'empty command' FROM e WHERE seq % 3 = 0""")
def wire_round_trip(spark, sf):
    """Commands of every event as bytes, with an inline command behind and a protocol error behind some, parsed again."""
    e = events(spark, sf)
    data = F.concat(encode_command_column(F.lit("set"), F.col("key"), F.concat("event_type", F.lit("\r\n"))), F.lit("get "), "key", F.lit("\r\n"), F.when(F.col("seq") % 3 == 0, "*0\r\nPING\r\n").otherwise(""))
    got = parse_streams(e.select(F.col("seq").cast("string").alias("conn_id"), data.cast("binary").alias("content")))
    return got.select("conn_id", F.col("i").cast("int").alias("i"), "cmd", F.array_join(F.transform("args", lambda a: a.cast("string")), "|").alias("args"))


@query("""WITH l(seq, cmd, a) AS (VALUES (1, 'PING', NULL), (2, 'PING', 'hi'), (3, 'COMMAND', 'x'), (4, 'FOO', NULL), (5, 'EXEC', NULL), (6, 'DISCARD', NULL), (7, 'GET', NULL), (8, 'QUIT', NULL))
SELECT seq, CASE cmd WHEN 'PING' THEN CASE WHEN a IS NULL THEN '+PONG' ELSE '$2hi' END WHEN 'COMMAND' THEN '+OK' WHEN 'QUIT' THEN '+OK' WHEN 'FOO' THEN '-ERR unknown command ''FOO''' WHEN 'GET' THEN '-ERR wrong number of arguments for ''GET'' command' ELSE '-ERR ' || cmd || ' without MULTI' END AS reply FROM l""")
def connection_replies(spark, sf):
    """PING, COMMAND, QUIT, unknown commands and arity; what follows QUIT gets no reply."""
    rows = [(1, "ping", []), (2, "PING", ["hi"]), (3, "Command", ["x"]), (4, "foo", []), (5, "EXEC", []), (6, "DISCARD", []), (7, "GET", []), (8, "QUIT", []), (9, "PING", [])]
    log = spark.createDataFrame([(s, s, "c", c, a) for s, c, a in rows], "seq bigint, ts_us bigint, conn_id string, cmd string, args array<string>")
    return run_log(log)[0].select(F.col("seq").cast("int").alias("seq"), F.regexp_replace(encode_reply(F.col("reply")), "\r\n", "").alias("reply"))


@query("""WITH v(seq, pos, reply) AS (VALUES (1, 0, 'subscribe a 1'), (1, 1, 'subscribe b 2'), (1, 2, 'subscribe a 2'), (3, 0, 'unsubscribe a 1'), (3, 1, 'unsubscribe b 0'), (4, 0, 'unsubscribe z 0'), (5, 0, 'subscribe c 1'), (6, 0, 'subscribe d 2'), (7, 0, 'unsubscribe c 1'), (7, 1, 'unsubscribe d 0'), (8, 0, 'unsubscribe  0')) SELECT * FROM v""")
def subscribe_replies(spark, sf):
    rows = [(1, "SUBSCRIBE", ["a", "b", "a"]), (3, "UNSUBSCRIBE", ["a", "b", "x"]), (4, "UNSUBSCRIBE", ["z"]), (5, "SUBSCRIBE", ["c"]), (6, "SUBSCRIBE", ["d"]), (7, "UNSUBSCRIBE", []), (8, "UNSUBSCRIBE", [])]
    log = spark.createDataFrame([(s, s, "c", c, a) for s, c, a in rows], "seq bigint, ts_us bigint, conn_id string, cmd string, args array<string>")
    out = run_log(log)[0]
    return out.select(F.col("seq").cast("int").alias("seq"), F.col("pos").cast("int").alias("pos"), F.concat_ws(" ", F.col("reply.arr")[0], F.col("reply.arr")[1], F.col("reply.int").cast("string")).alias("reply"))
