"""The feedback loop: records to deltas, deltas to weights, cold decay, backfill."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notegraph.functions.text import round4
from notegraph.settings import DEFAULT, Settings
from notegraph.sources.readers import feedback_window

EVENTS = ("consumed", "consumed_unsatisfied", "ignored", "legacy")


def record(session_id: Column, ts: Column, query: Column, satisfied: Column, consumed: Column, ignored: Column, cap: int = 20) -> list[Column]:
    """Columns of one record: consumed edges once each, ignored ones without those; the count is before the cap."""
    used = F.array_distinct(consumed)
    left = F.filter(ignored, lambda e: ~F.array_contains(used, e))
    return [
        session_id.alias("session_id"), ts.alias("ts"), query.alias("query"), satisfied.alias("satisfied"), used.alias("consumed_edges"),
        F.slice(left, 1, cap).alias("ignored_edges"), F.size(used).alias("consumed_count"), F.size(left).alias("ignored_count"),
    ]


def parse_edge(text: Column) -> Column:
    """``from||to||type`` as a struct; null unless it has three parts and a known type."""
    p = F.split(text, "\\|\\|")
    good = (F.size(p) == 3) & F.get(p, F.lit(2)).isin("pre", "sim") & (F.get(p, F.lit(0)) != "") & (F.get(p, F.lit(1)) != "")
    return F.when(good, F.struct(F.get(p, F.lit(0)).alias("from"), F.get(p, F.lit(1)).alias("to"), F.get(p, F.lit(2)).alias("type")))


def edge_rows(records: DataFrame) -> DataFrame:
    """Records, of a table or a stream, to one row an edge: ts, pos, src, dst, event."""
    none = F.array().cast("array<struct<`from`:string,`to`:string,`type`:string>>")
    arm = lambda c, event: F.transform(F.coalesce(c, none), lambda e: F.struct(e["from"].alias("src"), e["to"].alias("dst"), event.alias("event")))
    happy = F.when(F.coalesce("satisfied", F.lit(True)), "consumed").otherwise("consumed_unsatisfied")
    every = F.concat(arm(F.col("consumed_edges"), happy), arm(F.col("ignored_edges"), F.lit("ignored")), arm(F.col("edges_used"), F.lit("legacy")))
    rows = records.select("ts", F.posexplode(every).alias("pos", "e")).select("ts", "pos", "e.src", "e.dst", "e.event")
    return rows.where((F.coalesce("src", F.lit("")) != "") & (F.coalesce("dst", F.lit("")) != ""))


def edge_events(records: DataFrame) -> DataFrame:
    """Records to one row an edge: src, dst, event, ord (log order)."""
    return edge_rows(records).select("src", "dst", "event", F.struct("ts", "pos").alias("ord"))


def amount_of(e: Column, s: Settings = DEFAULT) -> Column:
    """What one event adds to a weight."""
    return (
        F.when(e == "consumed", s.consumed_delta).when(e == "legacy", s.consumed_delta)
        .when(e == "consumed_unsatisfied", -s.ignored_delta / 2).otherwise(-s.ignored_delta)
    )


def deltas(events: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """events(src, dst, event, ord) -> src, dst, delta, use_count_delta, source.

    The label is the last consumption's, else the first other event's.
    """
    e, amount = F.col("event"), amount_of(F.col("event"), s)
    consumed = e.isin("consumed", "consumed_unsatisfied")
    label = F.coalesce(
        F.max_by(F.when(consumed, e), F.when(consumed, F.col("ord"))),
        F.min_by(F.when(e == "legacy", "consumed_legacy").otherwise(e), "ord"),
    )
    return events.groupBy("src", "dst").agg(round4(F.sum(amount)).alias("delta"), F.count_if(e != "ignored").cast("int").alias("use_count_delta"), label.alias("source"))


def apply_deltas(weights: DataFrame, delta: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """The next snapshot of weights(src, dst, type, weight, use_count, last_updated, last_touch), with ``change``.

    change: created, updated, capped_max, capped_min, or null where no feedback came. A
    null weight is a stored 0.5; null use_count is none.
    """
    both = weights.join(delta.select("src", "dst", "delta", "use_count_delta"), ["src", "dst"], "full")
    touched, new = F.col("delta").isNotNull(), F.col("weight").isNull() & F.col("type").isNull()
    raw = F.coalesce("weight", F.lit(0.5)) + F.coalesce("delta", F.lit(0.0))
    clamped = round4(F.greatest(F.lit(s.min_weight), F.least(F.lit(s.max_weight), raw)))
    change = F.when(new, "created").when(raw >= s.max_weight, "capped_max").when(raw <= s.min_weight, "capped_min").otherwise("updated")
    now = F.lit(s.now)
    return both.select(
        "src", "dst", F.coalesce("type", F.lit("unknown")).alias("type"), F.when(touched, clamped).otherwise(F.col("weight")).alias("weight"),
        (F.coalesce("use_count", F.lit(0)) + F.coalesce("use_count_delta", F.lit(0))).cast("int").alias("use_count"),
        F.when(touched, now).otherwise(F.col("last_updated")).alias("last_updated"), F.when(touched, now).otherwise(F.col("last_touch")).alias("last_touch"),
        F.when(touched, change).alias("change"),
    )


def apply_stats(applied: DataFrame) -> DataFrame:
    c = F.col("change")
    return applied.agg(
        F.count_if(c.isNotNull() & (c != "created")).alias("updated"), F.count_if(c == "created").alias("created"),
        F.count_if(c == "capped_max").alias("capped_max"), F.count_if(c == "capped_min").alias("capped_min"),
    )


def cold_decay(weights: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Edges not updated for ``cold_days`` lose a share of their weight, on every run; undated ones are dated now."""
    cold = F.col("last_updated") < s.now - s.cold_days * 86400.0
    lower = round4(F.greatest(F.lit(s.min_weight), F.coalesce("weight", F.lit(0.5)) * s.cold_factor))
    return weights.withColumns({
        "weight": F.when(cold, lower).otherwise(F.col("weight")), "decayed_at": F.when(cold, F.lit(s.now)),
        "last_updated": F.coalesce("last_updated", F.lit(s.now)),
    })


def decay_stats(decayed: DataFrame) -> DataFrame:
    """Of cold_decay's result: total_weights, decayed."""
    return decayed.agg(F.count("*").alias("total_weights"), F.count_if(F.col("decayed_at").isNotNull()).alias("decayed"))


def cycle(
    weights: DataFrame, records: DataFrame, s: Settings = DEFAULT, decay_only: bool = False, no_decay: bool = False, since_days: int | None = None, last_applied=None,
    decay_days: int | None = None, dry_run: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """One run: the deltas of the records of the last days, then cold decay -> (next weights, report of one row).

    report: records, updated, created, capped_max, capped_min, total_weights, decayed. A dry
    run reports (every edge with a delta counts as updated) and returns the weights as they
    were. Nothing is written; the caller keeps or drops the result.
    """
    s = s if decay_days is None else replace(s, cold_days=decay_days)
    used = records.limit(0) if decay_only else records
    if since_days is not None or last_applied is not None:
        used = feedback_window(used, F.lit(s.now).cast("timestamp"), s.cold_days if since_days is None else since_days, last_applied)
    delta = deltas(edge_events(used), s)
    applied = apply_deltas(weights, delta, s)
    if dry_run:
        none = F.lit(0).cast("long")
        stats = delta.agg(F.count("*").alias("updated")).select("updated", none.alias("created"), none.alias("capped_max"), none.alias("capped_min"))
        after = weights
    else:
        stats, after = apply_stats(applied), applied.drop("change")
    decayed = cold_decay(after, s) if not no_decay else after.withColumn("decayed_at", F.lit(None).cast("double"))
    report = used.agg(F.count("*").alias("records")).crossJoin(stats).crossJoin(decay_stats(decayed))
    return (weights if dry_run else decayed if not no_decay else after), report


def map_items(edges: DataFrame, matched: DataFrame, items: DataFrame) -> DataFrame:
    """Retrieved titles to graph edges: items(session, title, kind), matched(session, name) -> session, src, dst, type.

    Edges come from matched notes; a similar title without one takes the first edge that leads to it.
    """
    e = edges.select("src", F.col("dst").alias("title"), "kind", "edge_ord")
    titled = items.where("title <> ''").select("session", "title", "kind").distinct()
    direct = titled.join(e, ["title", "kind"]).join(matched.select("session", F.col("name").alias("src")).distinct(), ["session", "src"], "left_semi")
    first = e.where("kind = 'sim'").groupBy("title", "kind").agg(F.min("src").alias("src"))
    rest = titled.where("kind = 'sim'").join(direct.select("session", "title", "kind"), ["session", "title", "kind"], "left_anti").join(first, ["title", "kind"])
    cols = ["session", "src", F.col("title").alias("dst"), F.col("kind").alias("type")]
    return direct.select(*cols).unionByName(rest.select(*cols))


def backfill(weights: DataFrame, modified: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """last_touch, where there is none, from the later of both ends' file times, else now. modified(name, mtime).

    filled: skipped, filled_mtime or filled_now, by where last_touch comes from.
    """
    m = modified.groupBy("name").agg(F.max("mtime").alias("mtime"))
    out = weights.join(m.select(F.col("name").alias("src"), F.col("mtime").alias("_a")), "src", "left").join(m.select(F.col("name").alias("dst"), F.col("mtime").alias("_b")), "dst", "left")
    own, file = F.when(F.col("last_touch") != 0, F.col("last_touch")), F.greatest("_a", "_b")
    filled = F.when(own.isNotNull(), "skipped").when(file.isNotNull(), "filled_mtime").otherwise("filled_now")
    return out.withColumns({"filled": filled, "last_touch": F.coalesce(own, file, F.lit(s.now))}).drop("_a", "_b")


def backfill_stats(filled: DataFrame) -> DataFrame:
    """Of backfill's result: total, filled_mtime, filled_now, skipped."""
    return filled.agg(F.count("*").alias("total"), *(F.count_if(F.col("filled") == c).alias(c) for c in ("filled_mtime", "filled_now", "skipped")))


def stored_weight(json: Column, default: float = 0.5) -> Column:
    """A stored weight that is a number or an object with a ``weight``; the default where it is neither."""
    return F.coalesce(json.try_cast("double"), F.get_json_object(json, "$.weight").try_cast("double"), F.lit(default))


def latest(table: DataFrame, key: list[str], order: str) -> DataFrame:
    r = F.row_number().over(Window.partitionBy(*key).orderBy(F.col(order).desc()))
    return table.withColumn("_r", r).where("_r = 1").drop("_r")
