"""PageRank, spreading activation, and fusion of score maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notegraph.functions.text import round4
from notegraph.operators.lineage import cut as _cut


def pagerank(edges: DataFrame, damping: float = 0.85, max_iter: int = 100, tol: float = 1e-6, every: int = 5) -> DataFrame:
    """name, pagerank over the undirected, unweighted graph; notes without edges leak their mass.

    On convergence the vector before the last step is returned. Rounds run ``every`` at a
    time as one plan, whose vectors are cut and whose changes reach the driver, a number a round.
    """
    both = edges.select("src", "dst").union(edges.select("dst", "src")).distinct()
    degree = both.groupBy("src").agg(F.count("*").alias("degree"))
    links = _cut(both.join(degree, "src"))
    nodes = _cut(edges.select(F.col("src").alias("name")).union(edges.select("dst")).distinct())
    n = nodes.count()
    if not n:
        return nodes.withColumn("pagerank", F.lit(0.0))
    rank = nodes.withColumn("r0", F.lit(1.0 / n))
    for start in range(0, max_iter, every):
        rounds = min(every, max_iter - start)
        held, step = rank, rank.select("name", F.col("r0").alias("pr"))
        for i in range(1, rounds + 1):
            # Every node is at the end of some edge, as edges go both ways.
            flow = links.join(step, links["src"] == step["name"]).groupBy(F.col("dst").alias("name")).agg(F.sum(F.col("pr") / F.col("degree")).alias("inflow"))
            step = flow.select("name", ((1 - damping) / n + damping * F.col("inflow")).alias("pr"))
            held = held.join(step.withColumnRenamed("pr", f"r{i}"), "name")
        held = _cut(held)
        changes = held.agg(*(F.sum(F.abs(F.col(f"r{i}") - F.col(f"r{i - 1}"))) for i in range(1, rounds + 1))).first()
        settled = next((i for i, c in enumerate(changes) if c < tol), None)
        rank = held.select("name", F.col(f"r{rounds if settled is None else settled}").alias("r0"))
        if settled is not None:
            break
    return rank.select("name", F.round("r0", 6).alias("pagerank"))


def adjacency(edges: DataFrame) -> DataFrame:
    """src, dst, w: prerequisites one way, similarities both ways, the greater weight where they meet."""
    pre = edges.where("kind = 'pre'").select("src", "dst", "w")
    sim = edges.where("kind = 'sim'").select("src", "dst", "w")
    every = pre.unionAll(sim).unionAll(sim.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    return every.groupBy("src", "dst").agg(F.max("w").alias("w")).where("w > 0")


def activation_rounds(
    anchors: DataFrame, edges: DataFrame, rounds: int = 3, alpha: float = 3.0, keep: float = 0.95, spread: float = 0.8, beta: float = 0.15,
    top_m: int = 7, gamma: float = 4.0, theta: float = 1.5,
) -> list[DataFrame]:
    """State (query_id, name, a) after each round, the anchors' energy first; only non-zero states are rows.

    A round keeps part of each note's energy, adds what flows in over edges divided by the
    fan-out, and takes from each note what the most active ones are above it. The last
    round squashes; a note at rest would come out at one small constant, below any
    threshold, so resting notes need no rows.
    """
    adj = _cut(adjacency(edges))
    nodes = adj.select(F.col("src").alias("name")).union(adj.select("dst")).distinct()
    n_nodes = nodes.agg(F.count("*").alias("n_nodes"))
    fan = adj.groupBy("src").agg(F.count("*").alias("fan"))
    out = _cut(adj.join(fan, "src"))
    state = anchors.join(nodes, "name", "left_semi").select("query_id", "name", (F.col("score") * alpha).alias("a")).where("a <> 0")
    states = [state]
    for r in range(rounds):
        flow = state.join(out, state["name"] == out["src"]).select("query_id", F.col("dst").alias("name"), (spread * F.col("w") * F.col("a") / F.col("fan")).alias("u"))
        u = state.select("query_id", "name", (F.col("a") * keep).alias("u")).unionAll(flow).groupBy("query_id", "name").agg(F.sum("u").alias("u"))
        u = _cut(u)
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("u").desc(), "name"))
        tops = u.withColumn("_r", rank).where(F.col("_r") <= top_m).groupBy("query_id").agg(F.collect_list("u").alias("tops"))
        pressure = F.aggregate("tops", F.lit(0.0), lambda s, x: s + F.greatest(x - F.col("u"), F.lit(0.0)))
        held = u.join(tops, "query_id").crossJoin(F.broadcast(n_nodes))
        u_hat = F.when(F.col("n_nodes") <= top_m, F.col("u")).otherwise(F.greatest(F.lit(0.0), F.col("u") - beta * pressure))
        squashed = 1 / (1 + F.exp(-gamma * (u_hat - theta)))
        state = held.select("query_id", "name", (squashed if r == rounds - 1 else F.greatest(u_hat, F.lit(0.0))).alias("a"))
        if r < rounds - 1:
            state = state.where("a > 0")
        state = _cut(state)
        states.append(state)
    return states


def activate(anchors: DataFrame, edges: DataFrame, k: int = 10, dormant: float = 0.05, **options) -> DataFrame:
    """query_id, rank, name, activation of the most active notes."""
    last = activation_rounds(anchors, edges, **options)[-1].where(F.col("a") > dormant)
    r = F.row_number().over(Window.partitionBy("query_id").orderBy(round4(F.col("a")).desc(), "name"))
    return last.withColumn("rank", r).where(F.col("rank") <= k).select("query_id", "rank", "name", round4(F.col("a")).alias("activation"))


def activation_trace(anchors: DataFrame, edges: DataFrame, k: int = 10, **options) -> DataFrame:
    """query_id, round, rank, name, activation of each round's most active notes."""
    out = None
    for i, state in enumerate(activation_rounds(anchors, edges, **options)):
        r = F.row_number().over(Window.partitionBy("query_id").orderBy(round4(F.col("a")).desc(), "name"))
        one = state.where("a > 0.001").withColumn("rank", r).where(F.col("rank") <= k).select("query_id", F.lit(i).alias("round"), "rank", "name", round4(F.col("a")).alias("activation"))
        out = one if out is None else out.unionByName(one)
    return out


def mixture(semantic: float = 0.4, activation: float = 0.4, pagerank: float = 0.2) -> tuple[float, float, float]:
    """Shares that add up to one; they are scaled if off by more than a hundredth."""
    total = semantic + activation + pagerank
    return (semantic, activation, pagerank) if abs(total - 1) <= 0.01 else (semantic / total, activation / total, pagerank / total)


def pagerank_heads(pagerank: DataFrame, n: int, shares: list[float], tenths: bool = False) -> DataFrame:
    """name, pagerank of the n first notes by each share's part of a score, as it is rounded, and then name; with ``tenths`` by each tenth too."""
    parts = [s * F.col("pagerank") for s in shares] + [F.lit(c) * F.col("pagerank") / 10 for c in range(1, 11)] * tenths
    tops = [pagerank.select("name", "pagerank").orderBy(round4(x).desc(), "name").limit(n) for x in parts]
    out = tops[0]
    for t in tops[1:]:
        out = out.unionAll(t)
    return out.distinct()


def joined_scores(semantic: DataFrame, activation: DataFrame, pagerank: DataFrame, shares: tuple[float, float, float] = (0.4, 0.4, 0.2), k: int = 10, tenths: bool = False) -> DataFrame:
    """query_id, name, sem, act, pr with 0 for what is missing: all that can be among the k best of a query by these shares, or with ``tenths`` by any in tenths.

    These are the notes that the query's own lists name, and of the others, which have PageRank alone, the head of one list for
    all queries: k notes of it, and as many more as a query's own lists may take from it.
    """
    a = semantic.select("query_id", "name", F.col("score").alias("sem"))
    b = activation.select("query_id", "name", F.col("activation").alias("act"))
    on = ["query_id", "name"]
    named = _cut(a.join(b, on, "full"))
    longest = named.groupBy("query_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    heads = F.broadcast(pagerank_heads(pagerank, k + longest, [mixture(*shares)[2]], tenths))  # of a length that one query's lists bound
    own = named.join(pagerank.select("name", F.col("pagerank").alias("pr")), "name", "left")
    rest = named.select("query_id").distinct().crossJoin(heads).join(named.select(*on), on, "left_anti").select(*on, F.lit(0.0).alias("sem"), F.lit(0.0).alias("act"), F.col("pagerank").alias("pr"))
    return own.select(*on, "sem", "act", "pr").unionByName(rest).fillna(0.0, ["sem", "act", "pr"])


def fuse(scores: DataFrame, shares: tuple[float, float, float] = (0.4, 0.4, 0.2), k: int = 10) -> DataFrame:
    """query_id, rank, name, score of the best by weighted sum; scores are those joined for these shares."""
    s1, s2, s3 = mixture(*shares)
    combined = round4(s1 * F.col("sem") + s2 * F.col("act") + s3 * F.col("pr"))
    raw = s1 * F.col("sem") + s2 * F.col("act") + s3 * F.col("pr")
    r = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "name"))
    return scores.where(raw > 0).select("query_id", "name", combined.alias("score"), *("sem act pr".split())).withColumn("rank", r).where(F.col("rank") <= k)


def fuse_structured(semantic: DataFrame, activation: DataFrame, pagerank: DataFrame, shares: tuple[float, float, float] = (0.4, 0.4, 0.2), k: int = 10) -> DataFrame:
    """Fusion of engines' own outputs: semantic(query_id, id, score, payload), activation(query_id, name, activation), pagerank(name, pagerank).

    The best carry the payload of their semantic hit, where there is one; an id that repeats has its last payload by score.
    """
    hits = semantic.groupBy("query_id", F.col("id").alias("name")).agg(F.max_by(F.struct("score", "payload"), "score").alias("h")).select("query_id", "name", "h.score", "h.payload")
    fused = fuse(joined_scores(hits.select("query_id", "name", "score"), activation, pagerank, shares, k), shares, k)
    return fused.join(hits.select("query_id", "name", "payload"), ["query_id", "name"], "left")


def grid(scores: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """Mean reciprocal rank of every mixture in tenths: l1, l2, l3, mrr. scores are those joined with ``tenths``; relevant(query_id, name)."""
    spark = scores.sparkSession
    shares = [(i, a, b, 10 - a - b) for i, (a, b) in enumerate((a, b) for a in range(11) for b in range(11 - a))]
    mixes = F.broadcast(spark.createDataFrame(shares, "mix int, a int, b int, c int"))
    raw = (F.col("a") * F.col("sem") + F.col("b") * F.col("act") + F.col("c") * F.col("pr")) / 10
    mixed = scores.crossJoin(mixes).withColumn("raw", raw).where("raw > 0").withColumn("score", round4(F.col("raw")))
    r = F.row_number().over(Window.partitionBy("mix", "query_id").orderBy(F.col("score").desc(), "name"))
    hits = mixed.withColumn("rank", r).where(F.col("rank") <= k).join(relevant, ["query_id", "name"], "left_semi")
    first = hits.groupBy("mix", "query_id").agg((1 / F.min("rank")).alias("rr"))
    n = relevant.select("query_id").distinct().agg(F.count("*").alias("n"))
    sums = mixes.join(first.groupBy("mix").agg(F.sum("rr").alias("s")), "mix", "left").crossJoin(n)
    return sums.select((F.col("a") / 10).alias("l1"), (F.col("b") / 10).alias("l2"), (F.col("c") / 10).alias("l3"), round4(F.coalesce("s", F.lit(0.0)) / F.col("n")).alias("mrr"))
