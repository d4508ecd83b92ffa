"""The prerequisite and similarity graphs: candidate edges, caps, weights, merges.

Edges are rows (src, dst, kind, edge_ord); weights are keyed by (src, dst) alone, so a
similarity edge replaces the weight of a prerequisite edge of the same pair.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notegraph.functions.decay import tag_of
from notegraph.functions.text import jaccard, overlap, tokens
from notegraph.operators.allpairs import Alike, Nearest, Pairs, counted, ends, exactly_least, folded, index, overlap_least
from notegraph.operators.lineage import stored
from notegraph.operators.substrings import contained
from notegraph.settings import DEFAULT, Settings

def last_by_name(notes: DataFrame) -> DataFrame:
    """One note a name: the last wins, at the place of the first."""
    w = Window.partitionBy("name")
    ranked = notes.withColumns({"_r": F.row_number().over(w.orderBy(F.col("note_ord").desc())), "_first": F.min("note_ord").over(w)})
    return ranked.where("_r = 1").drop("_r", "note_ord").withColumnRenamed("_first", "note_ord")


def exact_links(links: DataFrame, names: DataFrame) -> DataFrame:
    """links(src, target) whose target is a note's name."""
    return links.join(names.select(F.col("name").alias("target")).distinct(), "target", "left_semi").select("src", F.col("target").alias("dst")).distinct()


def partial_targets(links: DataFrame, names: DataFrame, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """Links to no name: (target, dst) for all names that contain the target or lie in it, whatever the case, and (target, src) of their links.

    With ``exact`` links to a name count as well. A frequent target is in most names, so pairs of src and dst would be as many as the square of the notes.
    """
    known = names.select("name").distinct()
    open_ = links if exact else links.join(known.select(F.col("name").alias("target")), "target", "left_anti")
    open_ = stored(open_.select("target", "src").distinct())
    targets = open_.select("target").distinct()
    inside = contained(targets.select(F.col("target").alias("n"), F.lower("target").alias("s")), known.select(F.col("name").alias("h"), F.lower("name").alias("t")))
    around = contained(known.select(F.col("name").alias("n"), F.lower("name").alias("s")), targets.select(F.col("target").alias("h"), F.lower("target").alias("t")))
    pairs = stored(inside.select(F.col("n").alias("target"), F.col("h").alias("dst")).union(around.select(F.col("h").alias("target"), F.col("n").alias("dst"))).distinct())
    return pairs, open_.join(pairs.select("target"), "target", "left_semi")


def partial_links(links: DataFrame, names: DataFrame) -> DataFrame:
    """(src, dst) of ``partial_targets``: each src with its targets meets each dst with its own within tasks, so that no pair is shuffled or told apart."""
    pairs, members = partial_targets(links, names)
    listed = lambda df, end: df.groupBy(F.col(end).alias("id")).agg(F.collect_set(F.xxhash64("target")).alias("targets"))
    if pairs.isEmpty():  # as of most graphs, which are spared the passes
        return members.select("src", F.col("src").alias("dst")).limit(0)
    rules, told = {"targets": overlap_least(1)}, lambda x, y, r, c, both: ends(x, y, r, c)
    return folded(stored(listed(members, "src")), listed(pairs, "dst"), ["targets"], lambda block: Pairs(block, rules, told, ["src", "dst"], own=True), "src string, dst string")


def with_tokens(notes: DataFrame) -> DataFrame:
    """name, note_ord, dir, tags in order, tokens as 64-bit hashes."""
    words = F.transform(tokens(F.substring("summary", 1, 500)), lambda w: F.xxhash64(w))
    return notes.select("name", "note_ord", "dir", F.array_sort(F.array_distinct("tags")).alias("tags"), words.alias("tokens"))


def _rare_first(t: DataFrame) -> DataFrame:
    """Notes with their tokens by how many notes of the directory have them."""
    posted = t.select("dir", "name", "note_ord", F.explode("tokens").alias("w"))
    often = posted.groupBy("dir", "w").agg(F.count("*").alias("c"))
    order = F.transform(F.array_sort(F.collect_list(F.struct("c", "w"))), lambda x: x["w"])
    ranked = posted.join(often, ["dir", "w"]).groupBy("name", "note_ord").agg(order.alias("tokens"))
    none = F.array().cast("array<bigint>")
    return t.drop("tokens").join(ranked, ["name", "note_ord"], "left").withColumn("tokens", F.coalesce("tokens", none))


def _measured(a: DataFrame, b: DataFrame, on: Column, once) -> DataFrame:
    """Pairs of postings(key, n: the note), each from one of its shared keys alone: src, dst, tag_jaccard, token_overlap."""
    left, right = F.col("l.n"), F.col("r.n")
    pairs = a.alias("l").join(b.alias("r"), on & (left["name"] != right["name"]) & once(left, right))
    return pairs.select(left["name"].alias("src"), right["name"].alias("dst"), jaccard(left["tags"], right["tags"]).alias("tag_jaccard"), overlap(left["tokens"], right["tokens"]).alias("token_overlap"))


def _by_tags(t: DataFrame, least: float, *within: str) -> DataFrame:
    """Pairs of different notes of which the Jaccard index of tags is at least ``least``: src, dst, tag_jaccard, token_overlap.

    Sets of tags are compared once each, however many notes have them. An index of t takes t / (1 + t) of both
    sizes in shared tags. Where one is enough both sets are small: such a key carries both sizes, so that a tag
    meets only sets it can suffice for. Where it is not, the key is two tags. Each pair of sets comes from its first
    shared tag, or two, and then names its notes.
    """
    tags, none = F.col("tags"), F.array().cast("array<struct<key:array<string>,own:int,other:int>>")
    share = least / (1 + least)
    most = int(1 / share + 1e-9)
    partners = F.sequence(F.lit(1), F.lit(most) - F.size(tags))
    post = lambda key, own, other: F.struct(key.alias("key"), own.cast("int").alias("own"), other.cast("int").alias("other"))
    single = F.flatten(F.transform(tags, lambda x: F.transform(partners, lambda m: post(F.array(x), F.size(tags), m))))
    double = F.flatten(F.transform(tags, lambda x, i: F.transform(F.slice(tags, i + 2, F.size(tags)), lambda y: post(F.array(x, y), F.lit(0), F.lit(0)))))
    every = F.concat(F.when(F.size(tags) < most, single).otherwise(none), F.when(F.size(tags) > 1, double).otherwise(none))
    posted = t.select(*within, "tags").distinct().select(*within, "tags", F.explode(every).alias("p")).select(*within, "tags", "p.*")
    on = (F.col("l.key") == F.col("r.key")) & (F.col("l.own") == F.col("r.other")) & (F.col("l.other") == F.col("r.own"))
    for c in within:
        on = on & (F.col(f"l.{c}") == F.col(f"r.{c}"))
    left, right = F.col("l.tags"), F.col("r.tags")
    needed = F.when(F.size(left) + F.size(right) <= most, 1).otherwise(2)
    once = (F.size("l.key") == needed) & (F.slice(F.array_intersect(left, right), 1, needed) == F.col("l.key"))
    sets = posted.alias("l").join(posted.alias("r"), on & once & (jaccard(left, right) >= least))
    pairs = sets.select(*(F.col(f"l.{c}").alias(c) for c in within), left.alias("a"), right.alias("b"), jaccard(left, right).alias("tag_jaccard"))
    side = lambda key, note: t.select(*within, F.col("tags").alias(key), F.struct("name", "tokens").alias(note))
    both = pairs.join(side("a", "x"), [*within, "a"]).join(side("b", "y"), [*within, "b"]).where("x.name <> y.name")
    return both.select(F.col("x.name").alias("src"), F.col("y.name").alias("dst"), "tag_jaccard", overlap(F.col("x.tokens"), F.col("y.tokens")).alias("token_overlap"))


def same_dir_pairs(notes: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Pairs of one directory with common words or tags: src, dst, tag_jaccard, token_overlap.

    Pairs with enough common words share one that is not among either note's most frequent
    ones, and come from their rarest shared word; others come from their first shared tag, or two.
    """
    t = _rare_first(with_tokens(notes))
    note = F.struct("name", "tags", "tokens").alias("n")
    most = s.same_dir_overlap
    by_word = t.select("dir", F.explode(F.slice("tokens", 1, F.greatest(F.size("tokens") - (most - 1), F.lit(0)))).alias("key"), note)
    on = (F.col("l.dir") == F.col("r.dir")) & (F.col("l.key") == F.col("r.key"))

    def words(left, right):
        shared = F.array_intersect(left["tokens"], right["tokens"])
        return (F.size(shared) >= most) & (F.get(shared, F.lit(0)) == F.col("l.key"))

    few = _by_tags(t, s.same_dir_jaccard, "dir").where(F.col("token_overlap") < most)
    return _measured(by_word, by_word, on, words).unionAll(few)


def same_dir_links(notes: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """The rows of ``same_dir_pairs``, the index rounded at four places and the overlap a long, as tasks find them; none is shuffled."""
    none = F.array().cast("array<bigint>")
    t = with_tokens(notes).select(F.col("name").alias("id"), F.col("dir").alias("within"), F.coalesce("tokens", none).alias("tokens"), F.coalesce(F.transform("tags", lambda x: F.xxhash64(x)), none).alias("tags"))
    rules = {"tokens": overlap_least(s.same_dir_overlap), "tags": exactly_least(s.same_dir_jaccard)}

    def told(x, y, r, c, both):
        return [*ends(x, y, r, c), pa.array(index(x, y, r, c, "tags", both["tags"])), pa.array(both["tokens"])]

    names = ["src", "dst", "tag_jaccard", "token_overlap"]
    return folded(None, t.where("id is not null and within is not null"), list(rules), lambda block: Pairs(block, rules, told, names), "src string, dst string, tag_jaccard double, token_overlap long", within=True)


def same_dir_degrees(notes: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Of each note of notes with names of their own: src, class_id (the first name of equal directory, tags and tokens), and over its ``same_dir_pairs`` n_links and token_overlap in all."""
    none = F.array().cast("array<bigint>")
    t = with_tokens(notes).select(F.col("name").alias("id"), F.col("dir").alias("within"), F.coalesce("tokens", none).alias("tokens"), F.coalesce(F.transform("tags", lambda x: F.xxhash64(x)), none).alias("tags"))
    found = counted(t, {"tokens": overlap_least(s.same_dir_overlap), "tags": exactly_least(s.same_dir_jaccard)})
    return found.select(F.col("id").alias("src"), "class_id", "n_links", F.col("n_shared").alias("token_overlap"))


def tag_pairs(notes: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Pairs of like tags, from any directory."""
    close = (F.col("tag_jaccard") >= s.tag_jaccard) | (F.col("token_overlap") >= s.tag_overlap)
    return _by_tags(with_tokens(notes), s.tag_jaccard_low).where(close)


def tag_links(notes: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """The rows of ``tag_pairs``, the index rounded at four places and the overlap a long, as tasks find them among notes with a common key; none is shuffled."""
    none = F.array().cast("array<bigint>")
    t = with_tokens(notes).where("name is not null").select(F.col("name").alias("id"), F.array_sort(F.coalesce(F.transform("tags", lambda x: F.xxhash64(x)), none)).alias("tags"), F.coalesce("tokens", none).alias("tokens"))
    low = min(s.tag_jaccard_low, s.tag_jaccard)

    def near(j, o):
        return (j >= s.tag_jaccard) | (o >= s.tag_overlap)

    t = t.where(F.size("tags") > 0).withColumn("keys", tag_keys(F.col("tags"), low))
    return folded(None, t, ["tags", "tokens", "keys"], lambda block: Alike(block, near, low), "src string, dst string, tag_jaccard double, token_overlap long", side=Alike.SIDE)


def dated_links(names: DataFrame, years: tuple) -> DataFrame:
    """Names equal but for dates: the earlier lists the later, if it is of one of the years."""
    date = "\\d{4}-\\d{2}-\\d{2}"
    n = names.select("name", F.regexp_replace("name", date, "").alias("stem"), F.regexp_extract("name", date, 0).alias("d")).where("d <> ''").distinct()
    a, b = n.alias("a"), n.alias("b")
    in_years = F.col("a.name").rlike("-(" + "|".join(years) + ")-")
    return a.join(b, (F.col("a.stem") == F.col("b.stem")) & (F.col("a.d") < F.col("b.d"))).where(in_years).select(F.col("a.name").alias("src"), F.col("b.name").alias("dst"))


def cap_prerequisites(edges: DataFrame, cap: int) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("src").orderBy("dst"))
    return edges.select("src", "dst").distinct().withColumn("edge_ord", r).where(F.col("edge_ord") <= cap).select("src", "dst", F.lit("pre").alias("kind"), "edge_ord")


def cap_similarities(pairs: DataFrame, cap: int) -> DataFrame:
    """The best of each source by 10 * tag_jaccard + 0.5 * token_overlap, then name; keeps both measures."""
    best = F.row_number().over(Window.partitionBy("src").orderBy((F.col("tag_jaccard") * 10 + F.col("token_overlap") * 0.5).desc(), "dst"))
    return pairs.distinct().withColumn("edge_ord", best).where(F.col("edge_ord") <= cap).select("src", "dst", F.lit("sim").alias("kind"), "edge_ord", "tag_jaccard", "token_overlap")


def tag_keys(tags: Column, least: float) -> Column:
    """Of a sorted set of tags, keys of which any two sets with a Jaccard index of ``least`` share one: every two tags, and of small sets each with both sizes."""
    most = int((1 + least) / least + 1e-9)
    partners = F.sequence(F.lit(1), F.greatest(F.lit(most) - F.size(tags), F.lit(1)))
    single = F.flatten(F.transform(tags, lambda x: F.transform(partners, lambda m: F.xxhash64(x, F.least(F.size(tags), m), F.greatest(F.size(tags), m)))))
    double = F.flatten(F.transform(tags, lambda x, i: F.transform(F.slice(tags, i + 2, F.greatest(F.size(tags), F.lit(1))), lambda y: F.xxhash64(x, y))))
    return F.array_distinct(F.concat(F.when(F.size(tags) < most, single).otherwise(F.array().cast("array<bigint>")), double))


def nearest(notes: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """The capped similarities of notes of different names, as ``cap_similarities`` has them of all pairs, which are never rows.

    Notes of equal directory, tags and tokens are one class, named by its first name. Of each class the best classes are
    found by a fold over all; as a note is left out of its own list, one more than the cap is kept, and so many
    names of a class can matter.
    """
    none = F.array().cast("array<bigint>")
    hashed = F.transform("tags", lambda x: F.xxhash64(x))
    t = with_tokens(notes).select("name", F.col("dir").alias("within"), F.array_sort(F.coalesce(hashed, none)).alias("tags"), F.array_sort(F.coalesce("tokens", none)).alias("tokens"))
    shape, cap = ["within", "tags", "tokens"], s.similarity_cap
    t = stored(t)
    classes = stored(t.groupBy(*shape).agg(F.min("name").alias("id")))
    on = t["within"].eqNullSafe(classes["within"]) & (t["tags"] == classes["tags"]) & (t["tokens"] == classes["tokens"])
    members = stored(t.join(classes, on).select("id", "name"))

    def near(same, j, o):
        return (same & ((o >= s.same_dir_overlap) | (j >= s.same_dir_jaccard))) | (j >= s.tag_jaccard) | ((j >= s.tag_jaccard_low) & (o >= s.tag_overlap))

    low = min(s.same_dir_jaccard, s.tag_jaccard_low, s.tag_jaccard)
    # A note without a directory is of none; the mark of that is unlike any other's.
    table = classes.withColumn("keys", tag_keys(F.col("tags"), low)).withColumn("within", F.coalesce(F.concat(F.lit("d"), "within"), F.concat(F.lit("n"), "id")))
    best = folded(None, table, ["tags", "tokens", "keys"], lambda block: Nearest(block, near, low, s.same_dir_overlap, cap + 1), "id string, other string, tag_jaccard double, token_overlap int", by_id=True, side=Nearest.SIDE)
    # A class of one note is no partner of its own, but is found there; so it takes one place at most.
    first = F.row_number().over(Window.partitionBy("id").orderBy("name"))
    names = members.withColumn("_r", first).where(F.col("_r") <= cap + 1).select(F.col("id").alias("other"), F.col("name").alias("dst"))
    score = (F.col("tag_jaccard") * 10 + F.col("token_overlap") * 0.5).desc()
    listed = best.join(names, "other").withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy(score, "dst"))).where(F.col("_r") <= cap + 1)
    pairs = members.withColumnRenamed("name", "src").join(listed.drop("_r", "other"), "id").where("src <> dst")
    return cap_similarities(pairs.select("src", "dst", "tag_jaccard", "token_overlap"), cap)


def build(notes: DataFrame, links: DataFrame, s: Settings = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(edges, weights) of notes and their links(src, target)."""
    notes = stored(last_by_name(notes.select("name", "note_ord", "dir", "tags", "summary")))  # read many times
    pre = cap_prerequisites(exact_links(links, notes).union(partial_links(links, notes)).union(dated_links(notes, s.dated_years)), s.prerequisite_cap)
    # Read by both tables.
    sim = stored(nearest(notes, s))
    edges = pre.union(sim.select("src", "dst", "kind", "edge_ord"))
    return edges, edge_weights(pre, sim, notes)


def similarity_weight(tag_jaccard: Column, token_overlap: Column) -> Column:
    return F.greatest(F.lit(0.35), F.least(tag_jaccard * 0.7 + F.least(token_overlap / 20, F.lit(0.3)), F.lit(1.0)))


def edge_weights(pre: DataFrame, sim: DataFrame, notes: DataFrame) -> DataFrame:
    """src, dst, type, weight, use_count, tag: of a pair of both kinds the similarity stands."""
    w = sim.select("src", "dst", F.lit("similarity").alias("type"), similarity_weight(F.col("tag_jaccard"), F.col("token_overlap")).alias("weight"))
    only = pre.join(sim.select("src", "dst"), ["src", "dst"], "left_anti")
    w = only.select("src", "dst", F.lit("prerequisite").alias("type"), F.lit(1.0).alias("weight")).union(w)
    return tag_edges(w.withColumn("use_count", F.lit(0)), notes)


def tag_edges(edges: DataFrame, notes: DataFrame, stored: str | None = None) -> DataFrame:
    """edges with ``tag`` from both ends' notes (or as stored, where it is)."""
    t = notes.select("name", "tags")
    out = edges.join(t.select(F.col("name").alias("src"), F.col("tags").alias("_a")), "src", "left").join(t.select(F.col("name").alias("dst"), F.col("tags").alias("_b")), "dst", "left")
    none = F.array().cast("array<string>")
    both = F.concat(F.coalesce("_a", none), F.coalesce("_b", none))
    return out.withColumn("tag", tag_of(both, F.col(stored) if stored else None)).drop("_a", "_b")


def degree(edges: DataFrame, top: int = 10) -> DataFrame:
    return edges.groupBy("src").agg(F.count("*").alias("out_degree")).orderBy(F.col("out_degree").desc(), "src").limit(top)


def stats(edges: DataFrame) -> DataFrame:
    """Edges of either kind, and nodes that are a source."""
    return edges.agg(F.count_if(F.col("kind") == "pre").alias("prerequisite_edges"), F.count_if(F.col("kind") == "sim").alias("similarity_edges"), F.count_distinct("src").alias("nodes"))


def merge_pairs(edges: DataFrame, weights: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Adds pairs(src, dst, kind) that are not there; a weight only where the pair has none. Caps do not apply."""
    new = pairs.distinct().join(edges, ["src", "dst", "kind"], "left_anti")
    after = edges.groupBy("src", "kind").agg(F.max("edge_ord").alias("m"))
    place = F.row_number().over(Window.partitionBy("src", "kind").orderBy("dst"))
    placed = new.join(after, ["src", "kind"], "left").withColumn("edge_ord", (F.coalesce("m", F.lit(0)) + place).cast("int"))
    made = pairs.groupBy("src", "dst").agg(F.min("kind").alias("kind")).join(weights, ["src", "dst"], "left_anti").select(
        "src", "dst", F.when(F.col("kind") == "pre", "prerequisite").otherwise("similarity").alias("type"),
        F.when(F.col("kind") == "pre", 0.9).otherwise(0.7).alias("weight"), F.lit(0).alias("use_count"), F.lit("llm").alias("source"),
    )
    all_weights = weights.withColumn("source", F.lit(None).cast("string")).unionByName(made, allowMissingColumns=True)
    return edges.unionByName(placed.select("src", "dst", "kind", "edge_ord")), all_weights


def merge_named(edges: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Adds found(src, dst, kind, reason, strength); also returns the new edges' notes, not their weights."""
    one = found.groupBy("src", "dst", "kind").agg(F.min_by(F.struct("reason", "strength"), F.struct("reason", "strength")).alias("m"))
    new = one.join(edges, ["src", "dst", "kind"], "left_anti")
    after = edges.groupBy("src", "kind").agg(F.max("edge_ord").alias("e"))
    place = F.row_number().over(Window.partitionBy("src", "kind").orderBy("dst"))
    placed = new.join(after, ["src", "kind"], "left").withColumn("edge_ord", (F.coalesce("e", F.lit(0)) + place).cast("int")).select("src", "dst", "kind", "edge_ord")
    mark = F.when(F.col("kind") == "pre", "→").otherwise("↔")
    notes = new.select(
        F.concat("src", mark, "dst").alias("edge"), F.when(F.col("kind") == "pre", "prerequisite").otherwise("similarity").alias("type"), F.lit("LLM").alias("source"),
        F.col("m.reason").alias("reason"), F.when(F.col("kind") == "sim", F.coalesce("m.strength", F.lit("medium"))).alias("strength"),
    )
    return edges.unionByName(placed), notes


def carry_over(new: DataFrame, old: DataFrame, wholesale: bool = True) -> DataFrame:
    """Weights after a rebuild: the old table as it is, or the new one with old rows where pairs remain."""
    if wholesale:
        return old
    kept = old.join(new.select("src", "dst"), ["src", "dst"], "left_semi")
    return kept.unionByName(new.join(old.select("src", "dst"), ["src", "dst"], "left_anti"), allowMissingColumns=True)
