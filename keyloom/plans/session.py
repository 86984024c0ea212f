"""Whole logs: connection rules (batches, subscriptions), routing, the fold, and every command's reply.

All connection state is closed form. In a batch: the last of MULTI, EXEC, DISCARD and QUIT before a row is a
MULTI. Subscribed: the running number of open channels is above zero. A queued command runs at its
EXEC's place and time, one batch without others in between. INFO relies on times that never fall along seq.

The log with its connection state, and the fold, are written once to the shared folder; every kind of reply is read
from there. What a log has no command for isn't planned: without connection commands nothing is dealt by connection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions.shared import cut
from keyloom.operators.keys import info_text, totals_before
from keyloom.plans.fold import ARITY, fold

CONTROL = ("MULTI", "EXEC", "DISCARD", "QUIT", "SUBSCRIBE", "UNSUBSCRIBE")
KEYED = tuple(c for c in ARITY if c not in ("PING", "PUBLISH"))
SUB_ONLY = "ERR only (P)SUBSCRIBE / (P)UNSUBSCRIBE / PING are allowed in this context"


def reply(kind: str, *, n: Column | None = None, s: Column | None = None, arr: Column | None = None) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"), (n if n is not None else F.lit(None)).cast("bigint").alias("int"), (s if s is not None else F.lit(None)).cast("string").alias("str"),
        (arr if arr is not None else F.lit(None)).cast("array<string>").alias("arr"),
    )


def error(text: Column | str) -> Column:
    return reply("error", s=F.lit(text) if isinstance(text, str) else text)


def connections(log: DataFrame) -> DataFrame:
    """The log up to each connection's QUIT, with in_tx, tx (seq of its MULTI), end_cmd, end_seq and end_ts of the batch's end."""
    w = Window.partitionBy("conn_id").orderBy("seq")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    # what follows, read backwards: a frame up to the end of the partition would be evaluated anew for every row
    after = Window.partitionBy("conn_id").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    mark = F.when(F.col("cmd").isin("MULTI", "EXEC", "DISCARD", "QUIT"), F.col("cmd"))
    end = F.when(F.col("cmd").isin("EXEC", "DISCARD", "QUIT"), F.struct("cmd", "seq", "ts_us"))
    x = log.withColumn("cmd", F.upper("cmd")).withColumn("quit", F.coalesce(F.count_if(F.col("cmd") == "QUIT").over(before), F.lit(0))).filter("quit = 0").drop("quit")
    x = x.withColumns({"in_tx": F.coalesce(F.last(mark, True).over(before) == "MULTI", F.lit(False)), "ends": F.last(end, True).over(after)})
    start = F.when((F.col("cmd") == "MULTI") & ~F.col("in_tx"), F.col("seq"))
    x = x.withColumn("tx", F.when(F.col("in_tx"), F.last(start, True).over(before)))
    return x.select("*", F.col("ends.cmd").alias("end_cmd"), F.col("ends.seq").alias("end_seq"), F.col("ends.ts_us").alias("end_ts")).drop("ends")


def subscription_steps(conns: DataFrame) -> DataFrame:
    """One row per (UN)SUBSCRIBE argument with the channels open before and after it, and its reply.

    An UNSUBSCRIBE without arguments closes all channels, so it starts a new epoch; its own replies name
    the channels open then, in order of subscription.
    """
    subs = conns.filter(F.col("cmd").isin("SUBSCRIBE", "UNSUBSCRIBE", "QUIT"))
    everything = ((F.col("cmd") == "UNSUBSCRIBE") & (F.size("args") == 0)) | (F.col("cmd") == "QUIT")
    w = Window.partitionBy("conn_id").orderBy("seq")
    subs = subs.withColumn("reset", everything).withColumn("epoch", F.coalesce(F.count_if("reset").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = subs.filter("not reset").select("conn_id", "epoch", "seq", "ts_us", "cmd", F.posexplode("args").alias("i", "channel"))
    at = Window.partitionBy("conn_id", "epoch", "channel").orderBy("seq", "i")
    was = F.coalesce(F.lag("cmd").over(at) == "SUBSCRIBE", F.lit(False)) & (F.col("channel") != "")
    rows = rows.withColumn("was", was)
    d = F.when(F.col("channel") == "", 0).when((F.col("cmd") == "SUBSCRIBE") & ~F.col("was"), 1).when((F.col("cmd") == "UNSUBSCRIBE") & F.col("was"), -1).otherwise(0)
    o = Window.partitionBy("conn_id", "epoch").orderBy("seq", "i")
    rows = rows.withColumn("d", d).withColumn("open", F.sum("d").over(o)).withColumn("before", F.col("open") - F.col("d"))
    # an UNSUBSCRIBE stops answering once nothing is left, if something was open before it
    in_cmd = Window.partitionBy("conn_id", "seq").orderBy("i")
    first_open = F.first("before").over(in_cmd)
    emptied = F.coalesce(F.max(F.when(F.col("open") == 0, 1)).over(in_cmd.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 1
    return rows.withColumn("told", ~((F.col("cmd") == "UNSUBSCRIBE") & (first_open > 0) & emptied)), subs.filter("reset").select("conn_id", "epoch", "seq", "ts_us", "cmd")


def subscription_replies(rows: DataFrame, resets: DataFrame) -> DataFrame:
    """seq, pos, reply of SUBSCRIBE and UNSUBSCRIBE."""
    text = F.lower("cmd")
    each = rows.filter("told").select("seq", F.col("i").cast("bigint").alias("pos"), reply("push", n=F.col("open"), arr=F.array(text, F.col("channel"))).alias("reply"))
    last = Window.partitionBy("conn_id", "epoch", "channel")
    held = rows.withColumn("latest", F.max(F.struct("seq", "i")).over(last)).filter((F.col("latest.seq") == F.col("seq")) & (F.col("latest.i") == F.col("i")) & (F.col("cmd") == "SUBSCRIBE") & (F.col("channel") != ""))
    opened = rows.filter("d = 1").groupBy("conn_id", "epoch", "channel").agg(F.max(F.struct("seq", "i")).alias("opened"))
    held = held.select("conn_id", "epoch", "channel").join(opened, ["conn_id", "epoch", "channel"])
    n = F.count(F.lit(1)).over(Window.partitionBy("conn_id", "epoch"))
    held = held.withColumns({"pos": (F.row_number().over(Window.partitionBy("conn_id", "epoch").orderBy("opened")) - 1).cast("bigint"), "n": n})
    every = resets.filter("cmd = 'UNSUBSCRIBE'").join(held, ["conn_id", "epoch"], "left").select(
        "seq", F.coalesce("pos", F.lit(0)).alias("pos"), reply("push", n=F.coalesce(F.col("n") - F.col("pos") - 1, F.lit(0)), arr=F.array(F.lit("unsubscribe"), F.coalesce("channel", F.lit("")))).alias("reply")
    )
    return each.unionByName(every)


def subscription_intervals(rows: DataFrame, resets: DataFrame) -> DataFrame:
    """sub, channel, from_seq, to_seq of every open channel."""
    at = Window.partitionBy("conn_id", "epoch", "channel").orderBy("seq", "i")
    edges = rows.filter("d <> 0").withColumn("to_seq", F.lead("seq").over(at)).filter("d = 1")
    return edges.join(resets.select("conn_id", "epoch", F.col("seq").alias("reset_seq")), ["conn_id", "epoch"], "left").select(
        F.col("conn_id").alias("sub"), "channel", F.col("seq").alias("from_seq"), F.coalesce("to_seq", "reset_seq").alias("to_seq")
    )


#: Microseconds of log, and numbers of the log, whose changes are summed before INFO counts them.
INFO_US, INFO_SEQ = 60_000_000, 1 << 20


def key_edges(folded: DataFrame) -> DataFrame:
    """Changes of the number of keys by type, in order of (ts_us, rank, seq, pos). A deadline passes before the commands of its moment."""
    at = lambda d, ts, rank, seq, pos: F.struct(F.lit(d).cast("bigint").alias("d"), ts.alias("ts_us"), F.lit(rank).alias("rank"), seq.cast("bigint").alias("seq"), pos.cast("bigint").alias("pos"))
    life = folded.filter("life is not null").select("life.*")
    expires = F.col("deadline").isNotNull() & (F.col("to_ts").isNull() | (F.col("to_ts") >= F.col("deadline")))
    end = F.when(expires, at(-1, F.col("deadline"), 0, F.lit(0), F.lit(0))).when(F.col("to_ts").isNotNull(), at(-1, F.col("to_ts"), 1, F.col("to_seq"), F.col("to_pos")))
    edges = life.select("type", F.explode(F.array_compact(F.array(at(1, F.col("from_ts"), 1, F.col("from_seq"), F.col("from_pos")), end))).alias("e")).select("type", "e.*")
    return edges.select("ts_us", "rank", "seq", "pos", F.expr(f"ts_us div {INFO_US}").alias("bucket"), F.col("d").alias("total"), *[F.when(F.col("type") == t, F.col("d")).otherwise(F.lit(0)).cast("bigint").alias(t) for t in ("string", "hash", "list", "set")])


def occupancy(edges: DataFrame, by: str, name: str) -> DataFrame:
    """seq and +1 or -1 where a channel (or a subscriber) gets its first or loses its last subscription; edges: seq, d, sub, channel."""
    n = F.sum("d").over(Window.partitionBy(by).orderBy("seq"))
    turns = edges.groupBy(by, "seq").agg(F.sum("d").alias("d")).select("seq", ((n > 0).cast("bigint") - (n - F.col("d") > 0).cast("bigint")).alias(name))
    return turns.filter(F.col(name) != 0)


def _arity_error() -> Column:
    n = F.size("args")
    bad = F.lit(False)
    for cmd, (least, most, step) in ARITY.items():
        wrong = (n < least) | ((n - least) % step != 0) | (F.lit(False) if most is None else n > most)
        bad = F.when(F.col("cmd") == cmd, wrong).otherwise(bad)
    return bad


def _found(log: DataFrame) -> set[str]:
    """Which of the commands that need plans of their own are in the log."""
    names = (*CONTROL, "PUBLISH", "INFO")
    got = log.select(F.upper("cmd").alias("cmd")).agg(*[F.bool_or(F.col("cmd") == c).alias(c) for c in names]).first()
    return {c for c in names if got[c]}


def _instant() -> Column:
    """The reply that a connection gives without running the command, else null."""
    ok = reply("simple", s=F.lit("OK"))
    return (
        F.when(F.col("cmd") == "QUIT", ok)
        .when((F.col("cmd") == "SUBSCRIBE") & (F.size("args") == 0), error("ERR wrong number of arguments for 'SUBSCRIBE' command"))
        .when(F.col("cmd").isin("SUBSCRIBE", "UNSUBSCRIBE"), F.lit(None))
        .when(F.col("cmd") == "MULTI", F.when(F.col("in_tx"), error("ERR MULTI calls can not be nested")).otherwise(ok))
        .when(F.col("cmd") == "EXEC", F.when(~F.col("in_tx"), error("ERR EXEC without MULTI")))
        .when(F.col("cmd") == "DISCARD", F.when(F.col("in_tx"), ok).otherwise(error("ERR DISCARD without MULTI")))
        .when(F.col("in_tx"), reply("simple", s=F.lit("QUEUED")))
        .when(F.col("subscribed") & (F.col("cmd") != "PING"), error(SUB_ONLY))
    )


def _plain() -> Column:
    """The reply of a command that needs no data, else null."""
    known = F.col("cmd").isin(*ARITY, "COMMAND", "INFO")
    return (
        F.when(~known, error(F.concat(F.lit("ERR unknown command '"), F.col("cmd"), F.lit("'"))))
        .when(_arity_error(), error(F.concat(F.lit("ERR wrong number of arguments for '"), F.col("cmd"), F.lit("' command"))))
        .when(F.col("cmd") == "PING", F.when(F.size("args") == 0, reply("simple", s=F.lit("PONG"))).otherwise(reply("bulk", s=F.get("args", F.lit(0)))))
        .when(F.col("cmd") == "COMMAND", reply("simple", s=F.lit("OK")))
    )


def run_log(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(replies, folded). replies: seq, pos, reply; a (UN)SUBSCRIBE has one per channel, an EXEC one per queued
    command (pos from 0; size in the EXEC's own row, pos -1), every other command one at pos 0. folded: see plans.fold."""
    has = _found(log)
    batches, subscribes = has & {"MULTI", "EXEC", "DISCARD"}, has & {"SUBSCRIBE", "UNSUBSCRIBE"}
    control = F.col("cmd").isin(*CONTROL)
    zero = F.lit(0).cast("bigint")
    if has & set(CONTROL):
        x = cut(connections(log))
    else:
        none = {n: F.lit(None).cast(t) for n, t in (("tx", "bigint"), ("end_cmd", "string"), ("end_seq", "bigint"), ("end_ts", "bigint"))}
        # written too: a log may be made by expressions that would be repeated wherever a command is told
        x = cut(log.withColumn("cmd", F.upper("cmd"))).withColumns({"in_tx": F.lit(False)} | none)
    parts = []
    if subscribes:
        steps, resets = (cut(df) for df in subscription_steps(x))
        parts.append(subscription_replies(steps, resets))
        # channels open before each row of a connection that ever subscribes
        edges = steps.select("conn_id", "seq", "d").unionByName(resets.join(steps.groupBy("conn_id", "epoch").agg(F.sum("d").alias("d")), ["conn_id", "epoch"]).select("conn_id", "seq", (-F.col("d")).alias("d")))
        per_row = edges.groupBy("conn_id", "seq").agg(F.sum("d").alias("d"))
        w = Window.partitionBy("conn_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
        x = x.join(per_row, ["conn_id", "seq"], "left").withColumn("subscribed", F.coalesce(F.sum("d").over(w), F.lit(0)) > 0).drop("d")
    else:
        x = x.withColumn("subscribed", F.lit(False))
    x = x.withColumns({"instant": _instant(), "queued": F.col("in_tx") & ~control})
    x = cut(x) if subscribes else x

    # what the data side executes: place (at), reply address (seq, pos), time
    runs = x.filter((F.col("queued") & (F.col("end_cmd") == "EXEC")) | (F.col("instant").isNull() & ~control))
    if has & set(CONTROL):
        parts.append(x.filter("instant is not null").select("seq", zero.alias("pos"), F.col("instant").alias("reply")))
    if batches:
        # a batch is one place of the order: its commands share the seq of EXEC and follow each other
        pos = F.when(F.col("queued"), F.row_number().over(Window.partitionBy("conn_id", "tx", "queued").orderBy("seq")) - 1).otherwise(zero).cast("bigint")
        # commands outside of batches aren't numbered, so they are left where they are
        alone = runs.filter("not queued").select("cmd", "args", zero.alias("pos"), "seq", "ts_us")
        inside = runs.filter("queued").select("cmd", "args", pos.alias("pos"), F.col("end_seq").alias("seq"), F.col("end_ts").alias("ts_us"))
        execs = x.filter((F.col("cmd") == "EXEC") & F.col("in_tx")).select("seq").join(inside.groupBy("seq").agg(F.count(F.lit(1)).alias("n")), "seq", "left")
        parts.append(execs.select("seq", F.lit(-1).cast("bigint").alias("pos"), reply("batch", n=F.coalesce("n", F.lit(0))).alias("reply")))
        runs = alone.unionByName(inside)
    else:
        runs = runs.select("cmd", "args", zero.alias("pos"), "seq", "ts_us")
    runs = runs.withColumn("plain", _plain())
    runs = cut(runs) if batches else runs
    parts.append(runs.filter("plain is not null").select("seq", "pos", F.col("plain").alias("reply")))

    keyed = runs.filter(F.col("plain").isNull() & F.col("cmd").isin(*KEYED))
    many = F.col("cmd").isin("DEL", "EXISTS")
    keyed = keyed.select("seq", "pos", "ts_us", "cmd", "args", F.posexplode(F.when(many, F.col("args")).otherwise(F.slice("args", 1, 1))).alias("sub", "key"))
    rest = F.when(F.col("cmd").isin("DEL", "EXISTS"), F.array().cast("array<string>")).otherwise(F.slice("args", 2, F.greatest(F.size("args") - 1, F.lit(1))))
    folded = cut(fold(keyed.select("key", "seq", "pos", F.col("sub").cast("bigint").alias("sub"), "ts_us", "cmd", rest.alias("rest"))))
    got = folded.filter("reply is not null")
    # DEL and EXISTS are summed over their keys, and told by their parts; every other command has one
    summed = got.filter("parts").groupBy("seq", "pos").agg(F.sum("reply.int").cast("bigint").alias("n")).select("seq", "pos", reply("int", n=F.col("n")).alias("reply"))
    parts += [got.filter("not parts").select("seq", "pos", "reply"), summed]

    spans = cut(subscription_intervals(steps, resets)) if subscribes else None
    if "PUBLISH" in has:
        pubs = runs.filter(F.col("plain").isNull() & (F.col("cmd") == "PUBLISH")).select("seq", "pos", F.col("args")[0].alias("channel"))
        parts.append(_published(pubs, spans) if subscribes else pubs.select("seq", "pos", reply("int", n=zero).alias("reply")))
    if "INFO" in has:
        parts.append(_told(runs, folded, spans))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out, folded


def _edges(spans: DataFrame) -> DataFrame:
    """sub, channel, seq, d: where a subscription begins (1) and ends (-1)."""
    return spans.select("sub", "channel", F.col("from_seq").alias("seq"), F.lit(1).alias("d")).unionByName(spans.filter("to_seq is not null").select("sub", "channel", F.col("to_seq").alias("seq"), F.lit(-1).alias("d")))


def _published(pubs: DataFrame, spans: DataFrame) -> DataFrame:
    """Replies of PUBLISH: subscribers at its place, as totals of the channel's edges up to it."""
    by_seq = F.expr(f"seq div {INFO_SEQ}")
    points = pubs.select("channel", "seq", "pos", by_seq.alias("bucket"))
    edges = _edges(spans).select("channel", "seq", F.lit(-2).cast("bigint").alias("pos"), F.col("d").cast("bigint").alias("n"), by_seq.alias("bucket"))
    return totals_before(points, edges, ["seq", "pos"], ["n"], by=["channel"]).select("seq", "pos", reply("int", n=F.col("n")).alias("reply"))


def _told(runs: DataFrame, folded: DataFrame, spans: DataFrame | None) -> DataFrame:
    """Replies of INFO."""
    infos = runs.filter(F.col("plain").isNull() & (F.col("cmd") == "INFO")).select("seq", "pos", "ts_us", F.lit(1).alias("rank"))
    out = totals_before(infos.withColumn("bucket", F.expr(f"ts_us div {INFO_US}")), key_edges(folded), ["ts_us", "rank", "seq", "pos"], ["total", "string", "hash", "list", "set"])
    if spans is None:
        out = out.withColumns({"channels": F.lit(0), "subscribers": F.lit(0)})
    else:
        by_seq, edge = F.expr(f"seq div {INFO_SEQ}"), _edges(spans)
        hub = occupancy(edge, "channel", "channels").unionByName(occupancy(edge, "sub", "subscribers"), allowMissingColumns=True).fillna(0)
        out = out.join(totals_before(infos.select("seq", "pos", by_seq.alias("bucket")), hub.withColumn("bucket", by_seq), ["seq"], ["channels", "subscribers"]), ["seq", "pos"])
    return out.select("seq", "pos", reply("bulk", s=info_text(*(F.col(c) for c in ("total", "string", "hash", "list", "set", "channels", "subscribers")))).alias("reply"))
