"""SimHash fingerprints and near-duplicate groups by bit-sliced comparison.

A fingerprint's bit is set if more than half of the text's word shingles have it set
in their XXH64. Two fingerprints link at ``radius`` or fewer differing bits. With the
64 bits cut into bands, linked fingerprints agree in all but ``radius`` of them, so each
distinct fingerprint is dealt to one bucket for every choice of all bands but ``radius``,
and every link shows up in some bucket. The more fingerprints there are, the more bands
are cut, so that a bucket's key grows and its size does not. Within a bucket the
fingerprints lie as bit planes, 64 to a machine word; distances of many are counted
at once with carry-save counters, and a block is abandoned once all of it is beyond
the radius. Of a bucket's links only a spanning forest leaves the task: the point
nearest the bucket's majority is compared first, and then points outside the largest
group so far are compared with the whole bucket, until all that were not are in one
group, as links within a group change nothing. Buckets over ``TILE`` fingerprints are
cut into tiles that are compared by different tasks. Nothing is capped; only distinct
fingerprints are compared, so exact copies cost nothing.

Edge cases: null, empty and blank texts have fingerprint zero and link like any
other. A very long text has all its shingles counted. A bit set in exactly half of the
shingles (a tie) is 0. Rows that repeat share a fingerprint. Texts of one id are told
apart by what they hold; a component's id is the least of its ids, and null only if no
row of it has one. Empty tables give empty results; columns other than doc_id and text
are ignored by ``fingerprints`` and passed through by ``drop_near_duplicates``, whatever
they are called.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegraph.llm.common import ROW_KEY, ROW_KEY_SCHEMA, cut, id_of, one_row_of, row_key
from notegraph.llm.components import connected_components

RADIUS = 4
SHINGLE = 4
SEED = 42
TILE = 20_000
_BUCKET = 256
_ROWS_A_TASK = 500_000
_SMALL = 16
_BLOCK_WORDS = 64


# ----------------------------------------------------------------- fingerprints


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    tokens = text.lower().split()  # of bytes: ASCII only, both
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = [0, *(gaps + 1).tolist()]
    ends = [*gaps.tolist(), len(joined)]
    ends = ends[min(shingle, len(tokens)) - 1 :]
    digest = xxhash.xxh64_digest
    raw = b"".join([digest(joined[s:e], SEED) for s, e in zip(starts, ends)])
    counts = np.zeros(64, np.int64)
    rows = np.frombuffer(raw, np.uint8).reshape(-1, 8)
    for i in range(0, len(rows), 255 * 64):
        counts += np.unpackbits(rows[i : i + 255 * 64], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(rows)).tobytes(), "big")


def _fingerprints(shingle: int, batches):
    for batch in batches:
        texts = batch.column(3)
        fps = np.fromiter((fingerprint((t.as_py() or "").encode(), shingle) for t in texts), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(fps.view(np.int64))], names=[*ROW_KEY, "fp"])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Per row of docs(doc_id, text): its row key, fp (64 bits as a long)."""
    rows = docs.select(*row_key(F.col("doc_id"), F.col("text")), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(partial(_fingerprints, shingle), f"{ROW_KEY_SCHEMA}, fp long")


# ----------------------------------------------------------- bit-sliced buckets


def bit_planes(points: np.ndarray) -> np.ndarray:
    """(64, words): bit i of plane b is bit b of point i; the last word is padded by the last point."""
    n = -(-len(points) // 64) * 64
    padded = np.concatenate([points, np.repeat(points[-1:], n - len(points))])
    bits = np.unpackbits(padded.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


def near(planes: np.ndarray, queries: np.ndarray, radius: int) -> np.ndarray:
    """Boolean (queries, 64 * words): which points are within the radius (at most 6) of each query."""
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    words = planes.shape[1]
    found = np.zeros((len(queries), words), np.uint64)
    masks = np.where((queries[None, :] >> np.arange(64, dtype=np.uint64)[:, None]) & np.uint64(1), full, np.uint64(0))
    for lo in range(0, words, _BLOCK_WORDS):
        block = planes[:, lo : lo + _BLOCK_WORDS]
        ones, twos, fours, over = (np.zeros((len(queries), block.shape[1]), np.uint64) for _ in range(4))
        for b in range(64):
            carry = block[b][None, :] ^ masks[b][:, None]
            carry, ones = ones & carry, ones ^ carry
            carry, twos = twos & carry, twos ^ carry
            carry, fours = fours & carry, fours ^ carry
            over |= carry
            if b % 8 == 7:
                beyond = over | _above(ones, twos, fours, radius)
                if (beyond == full).all():
                    break
        else:
            found[:, lo : lo + _BLOCK_WORDS] = ~beyond
    return np.unpackbits(np.ascontiguousarray(found.astype("<u8")).view(np.uint8), axis=1, bitorder="little").astype(bool)


def _above(ones: np.ndarray, twos: np.ndarray, fours: np.ndarray, radius: int) -> np.ndarray:
    """Where the three-bit count is over the radius."""
    out = np.zeros_like(ones)
    for value in range(radius + 1, 8):
        out |= (ones if value & 1 else ~ones) & (twos if value & 2 else ~twos) & (fours if value & 4 else ~fours)
    return out


def forest(queries: np.ndarray, points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (a, b) that join what links between a query and a point join; points hold the queries too."""
    planes, n = bit_planes(points), len(points)
    label = np.arange(n)
    where = {int(p): i for i, p in enumerate(points)}
    query = np.zeros(n, bool)
    query[[where[int(q)] for q in queries]] = True
    asked = np.zeros(n, bool)

    def absorb(i: int, hits: np.ndarray) -> None:
        roots = np.unique(label[np.append(np.flatnonzero(hits[:n]), i)])
        if len(roots) > 1:
            label[np.isin(label, roots)] = roots[0]

    bits = np.unpackbits(points.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    centre = int(np.argmin((bits != (bits.sum(0) * 2 > n)).sum(1)))
    absorb(centre, near(planes, points[centre : centre + 1], radius)[0])
    asked[centre] = True
    while True:
        # A link not seen yet is between a query and a point that are both unasked.
        rest = np.flatnonzero(~asked)
        todo = rest[query[rest]]
        roots, sizes = np.unique(label[rest], return_counts=True)
        if not len(todo) or len(roots) == 1:
            break
        others = rest[label[rest] != roots[np.argmax(sizes)]]
        now = others[query[others]]
        if not len(now):  # the queries left are of one group, and others are only points
            now = min(todo, others, key=len)
        now = now[:32]
        asked[now] = True
        for i, hits in zip(now, near(planes, points[now], radius)):
            absorb(i, hits[:n] if query[i] else hits[:n] & query)
    moved = np.flatnonzero(label != np.arange(n))
    return points[moved], points[label[moved]]


def _link_partition(radius: int, batches):
    tables = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
    if not tables:
        return
    t = pa.concat_tables(tables)
    band, key, fp = (t.column(c).to_numpy() for c in ("band", "key", "fp"))
    query = t.column("query").to_numpy(zero_copy_only=False).astype(bool)
    fp = fp.view(np.uint64)
    order = np.lexsort((fp, key, band))
    band, key, fp, query = band[order], key[order], fp[order], query[order]
    new = np.ones(len(fp), bool)
    new[1:] = (band[1:] != band[:-1]) | (key[1:] != key[:-1])
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(fp)))
    left, right = [], []
    group = np.repeat(np.arange(len(starts)), sizes)
    small = np.flatnonzero(np.repeat(sizes <= _SMALL, sizes))
    for d in range(1, _SMALL):
        i = small[small + d < len(fp)]
        i = i[group[i] == group[i + d]]
        if not len(i):
            break
        i = i[(np.bitwise_count(fp[i] ^ fp[i + d]) <= radius) & (query[i] | query[i + d])]
        left.append(fp[i])
        right.append(fp[i + d])
    for k in np.flatnonzero(sizes > _SMALL):
        s = slice(starts[k], starts[k] + sizes[k])
        a, b = forest(fp[s][query[s]], fp[s], radius)
        left.append(a)
        right.append(b)
    a, b = np.concatenate(left or [fp[:0]]), np.concatenate(right or [fp[:0]])
    pairs = np.unique(np.stack([a, b], 1), axis=0) if len(a) else np.zeros((0, 2), np.uint64)
    for i in range(0, len(pairs), 100_000):
        p = pairs[i : i + 100_000].view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(p[:, 0].copy()), pa.array(p[:, 1].copy())], names=["a", "b"])


def _band_bits(bands: int) -> list[int]:
    """A mask per band, of nearly equal widths."""
    cuts = [64 * i // bands for i in range(bands + 1)]
    return [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(cuts, cuts[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def bands_for(n: int, radius: int) -> int:
    """The fewest bands by which n evenly spread fingerprints would fall into buckets of at most ``_BUCKET``."""
    return next(b for b in range(radius + 2, 64) if b == 63 or n >> (64 * (b - radius) // b) <= _BUCKET)


def _linked(rows: DataFrame, n: int, radius: int) -> DataFrame:
    """Edges of n rows(band, key, fp, query), bucket by bucket; a task holds a bounded number of rows."""
    dealt = rows.repartition(-(-n // _ROWS_A_TASK) or 1, "band", "key")
    return dealt.mapInArrow(partial(_link_partition, radius), "a long, b long")


def near_links(fps: DataFrame, radius: int = RADIUS, bands: int | None = None, tile: int = TILE) -> DataFrame:
    """fps(fp), distinct -> edges (a, b) whose components are those of all links within the radius."""
    n = fps.count()
    bands = bands or bands_for(n, radius)
    if not 0 <= radius < min(bands, 7):
        raise ValueError("the radius must be under the number of bands, and at most 6")
    masks = [_signed(sum(m)) for m in combinations(_band_bits(bands), bands - radius)]
    keys = F.array(*(F.struct(F.lit(i).alias("band"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)))
    dealt = fps.select("fp", F.explode(keys).alias("k")).select("fp", "k.band", "k.key")
    # Large buckets are rare: their keys are counted first, and joined as a table that may be empty.
    hot = cut(dealt.groupBy("band", "key").count().where(F.col("count") > tile).withColumnRenamed("count", "n"))
    if hot.isEmpty():
        return _linked(dealt.select("band", "key", "fp", F.lit(True).alias("query")), n * len(masks), radius).distinct()
    every = dealt.join(hot, ["band", "key"], "left")
    cold = every.where("n is null").select("band", "key", "fp", F.lit(True).alias("query"))
    return _linked(cold, n * len(masks), radius).unionAll(_tiled(every.where("n is not null"), radius, tile)).distinct()


def _tiled(rows: DataFrame, radius: int, tile: int) -> DataFrame:
    """Edges of large buckets: all near the centre link to it; what is left meets every tile."""
    rows = cut(rows.withColumn("tile", F.pmod(F.xxhash64("fp"), F.ceil(F.col("n") / tile))))
    bit = lambda b: F.expr(f"case when sum(shiftright(fp, {b}) & 1) * 2 > count(*) then shiftleft(1L, {b}) else 0L end")
    sums = bit(0)
    for b in range(1, 64):
        sums = sums.bitwiseOR(bit(b))
    majority = rows.groupBy("band", "key").agg(sums.alias("majority"))
    apart = lambda x, y: F.bit_count(F.col(x).bitwiseXOR(F.col(y)))
    centre = rows.join(majority, ["band", "key"]).groupBy("band", "key").agg(F.min_by("fp", F.struct(apart("fp", "majority"), "fp")).alias("centre"))
    rows = cut(rows.join(centre, ["band", "key"]))
    inside = apart("fp", "centre") <= radius
    star = rows.where(inside & (F.col("fp") != F.col("centre"))).select(F.col("fp").alias("a"), F.col("centre").alias("b"))
    left = rows.where(~inside)
    count = left.groupBy("band", "key").agg(F.ceil(F.count("*") / tile).alias("groups"))
    tiles = F.ceil(F.col("n") / tile)
    # A query goes to every tile; a point of a tile meets every group of queries.
    asked = left.join(count, ["band", "key"]).select(
        "band", "key", "fp", F.lit(True).alias("query"), F.pmod(F.xxhash64("fp", F.lit(7)), F.col("groups")).alias("group"),
        F.explode(F.sequence(F.lit(0).cast("long"), tiles - 1)).alias("tile"),
    )
    met = rows.join(count, ["band", "key"]).select(
        "band", "key", "fp", F.lit(False).alias("query"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("group"), "tile"
    )
    both = asked.select("band", "key", "group", "tile", "fp", "query").unionByName(met).groupBy("band", "key", "group", "tile", "fp").agg(F.max("query").alias("query"))
    tagged = cut(both.select(F.xxhash64("band", "key").alias("key"), F.xxhash64("group", "tile").alias("band"), "fp", "query"))
    return star.unionAll(_linked(tagged, tagged.count(), radius))


# ------------------------------------------------------------------- components


def near_components(fp_rows: DataFrame, radius: int = RADIUS, bands: int | None = None, tile: int = TILE) -> DataFrame:
    """fp_rows(row key, fp) -> those columns, doc_id, label (names the component), component_id, keeps.

    keeps: the key of the row that stands for the component.
    """
    fps = cut(fp_rows.groupBy("fp").agg(F.min(F.struct(*ROW_KEY)).alias("least")))
    labels = connected_components(near_links(fps.select("fp"), radius, bands, tile))
    named = fps.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    # Cut, so that the join below has plain exchanges on both sides, which may split a large component.
    whole = cut(named.groupBy("label").agg(F.min("least").alias("keeps")))
    by_fp = named.join(whole, "label").select("fp", "label", "keeps")
    return fp_rows.join(by_fp, "fp").select(
        *ROW_KEY, id_of(F.col("no_id"), F.col("id")).alias("doc_id"), "fp", "label", id_of(F.col("keeps.no_id"), F.col("keeps.id")).alias("component_id"), "keeps"
    )


def drop_near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """docs with one row of each component: that of the least doc_id."""
    held = near_components(cut(fingerprints(docs, shingle)), radius)
    kept = held.select("keeps.*").distinct()
    return one_row_of(docs, kept)


def digest(components: DataFrame) -> DataFrame:
    return components.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
