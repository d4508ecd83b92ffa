"""Near-duplicates by the Jaccard similarity of texts' sets of five-word shingles.

Texts whose sets have a similarity of at least ``SHARE`` link; of each component of
links one row stays. Texts of equal sets are one node throughout. Every candidate is
verified with the exact sets, and there are three sources of candidates:

1. SimHash fingerprints of the sets, compared bit-sliced as in ``simhash``: they find
   texts that are nearly the same. A similarity of 0.8 is about ten differing bits,
   which no radius that can be banded reaches, so they cannot find all links.
2. MinHash keys, ``BANDS`` of ``ROWS`` minima each, so that a pair of exactly 0.8
   shares no key with a probability of 1.3e-7. In a key's bucket all nodes are compared
   with one centre, the node that meets most others over all its keys. What that links
   is one component and needs no more comparison.
3. Buckets that still hold several components go with their sets to tasks of at most
   ``2 * TILE`` nodes, where all nodes outside the main component are compared with all
   others at once, and a spanning forest of the links comes back. No pair leaves a task.

So a bucket of near copies makes about as many rows as it has nodes, and nothing is capped.

Words are split at ASCII white space with ASCII case folded, as for fingerprints. Edge
cases: a text of fewer than five words is one shingle; null, empty and blank texts
equal each other. A very long text has as many shingles as it has, all of which count.
Rows that repeat are one row. A row without doc_id stays only where a component has no
other; of rows with one id (a tie) that of the least text hash stays. An empty table
gives an empty result; all columns are passed through, whatever they are called.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegraph.llm.common import LOWER, ROW_KEY, ROW_KEY_SCHEMA, WHITE, Roller, map_blocks, mix, one_row_of, owners, row_key, stored, words
from notegraph.llm import simhash
from notegraph.llm.components import connected_components

SHINGLE = 5
SHARE = (4, 5)
BANDS = 40
ROWS = 5
TILE = 1000
#: Of hashes that a tile's half holds, about.
TILE_BYTES = 16 << 20
_COLUMNS = 4096
_ROWS_A_TASK = 4000
_RNG = np.random.Generator(np.random.PCG64(2026))
_PLACES = _RNG.integers(1, 2**63, SHINGLE, dtype=np.uint64) | np.uint64(1)
_TIMES = _RNG.integers(1, 2**31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_PLUS = _RNG.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)
_FOLD = np.random.Generator(np.random.PCG64(2027)).integers(1, 2**63, ROWS, dtype=np.uint64) | np.uint64(1)


def shingles(off: np.ndarray, data: np.ndarray) -> list[np.ndarray]:
    """Per text of a block the sorted distinct hashes of its shingles, one at least."""
    low = LOWER[data]
    roller = Roller(0)
    start, end, per = words(low, off, ~WHITE)
    hashes = roller.spans(roller.prefix(low), start, end)
    n = len(hashes)
    doc = owners(per)
    total = np.zeros(n, np.uint64)
    for k, c in enumerate(_PLACES):
        same = np.zeros(n, bool)
        same[: n - k] = doc[k:] == doc[: n - k]
        i = np.flatnonzero(same)
        total[i] += hashes[i + k] * c
    total = mix(total)
    at = np.concatenate([[0], np.cumsum(per)])
    return [np.unique(total[a : a + max(1, m - SHINGLE + 1)]) if m else np.zeros(1, np.uint64) for a, m in zip(at, per)]


def _sketches(batch, off, data):
    sets = shingles(off, data)
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    high = (mix(np.concatenate(sets)) >> np.uint64(32)).astype(np.uint32)
    keys = np.empty((len(sets), BANDS), np.uint64)
    for band in range(BANDS):
        folded = np.full(len(sets), (band * 0x9E3779B97F4A7C15) % (1 << 64), np.uint64)
        for r in range(ROWS):
            k = band * ROWS + r
            folded += np.minimum.reduceat(high * _TIMES[k] + _PLUS[k], starts).astype(np.uint64) * _FOLD[r]
        keys[:, band] = mix(folded)
    nodes = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64)
    bits = np.unpackbits(np.concatenate(sets).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    majority = np.add.reduceat(bits, starts, axis=0, dtype=np.int64) * 2 > sizes[:, None]
    fps = np.ascontiguousarray(np.packbits(majority, axis=1, bitorder="little")).view("<i8")[:, 0]
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * BANDS, pa.int32()), pa.array(keys.reshape(-1).view(np.int64)))
    cols = [*batch.columns[:3], pa.array(nodes.view(np.int64)), pa.array(sizes.astype(np.int64)), pa.array(fps), lists]
    return pa.RecordBatch.from_arrays(cols, names=[*ROW_KEY, "node", "n", "fp", "keys"])


def _sets(batch, off, data):
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in shingles(off, data)], pa.binary())], names=["node", "hashes"])


def _linked(batches):
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3)):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(both * SHARE[1] >= SHARE[0] * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def joined(label: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links between nodes of different labels, as many as join what the links join."""
    main = Counter(label.tolist()).most_common(1)[0][0]
    asks = np.flatnonzero(label != main)
    if not len(asks):
        return []
    sizes = np.array([len(s) for s in sets])
    node = np.repeat(np.arange(len(sets)), sizes)
    _, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = often > 1
    node, column = node[shared[column]], (np.cumsum(shared) - 1)[column[shared[column]]]
    both = np.zeros((len(asks), len(sets)), np.float32)
    for lo in range(0, int(shared.sum()), _COLUMNS):
        part = (column >= lo) & (column < lo + _COLUMNS)
        has = np.zeros((len(sets), _COLUMNS), np.float32)
        has[node[part], column[part] - lo] = 1
        both += has[asks] @ has.T
    near = both * (SHARE[0] + SHARE[1]) >= SHARE[0] * (sizes[asks][:, None] + sizes[None, :])
    root = {x: x for x in set(label.tolist())}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i, x in enumerate(asks):
        for y in np.flatnonzero(near[i] & (label != label[x])):
            a, b = find(label[x].item()), find(label[y].item())
            if a != b:
                root[a] = b
                out.append((x, y))
    return out


def _joined(batches):
    """Rows of (key, i, j) in order -> links of each group."""
    held, name = [], None

    def links():
        node, label = np.array([r[0] for r in held]), np.array([r[1] for r in held])
        pairs = joined(label, [r[2] for r in held])
        a, b = (np.array([node[p[k]] for p in pairs], np.int64) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    for batch in batches:
        keys = zip(*(batch.column(k).to_pylist() for k in range(3)))
        for key, node, label, hashes in zip(keys, batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5)):
            if key != name and held:
                yield links()
                held = []
            name = key
            held.append((node, label, np.frombuffer(hashes.as_buffer(), np.uint64)))
    if held:
        yield links()


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs(a, b) those similar enough; either may be a hot node."""
    second = pairs.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
    both = second.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a").select("a", "b", "x", "y")
    return stored(both.mapInArrow(_linked, "a long, b long"))


def _pair(x, y) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _close(n, m):
    """Sizes without which no pair is similar enough."""
    return F.least(n, m) * SHARE[1] >= F.greatest(n, m) * SHARE[0]


def _by_fingerprint(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes that fingerprints join: equal ones as a star, near ones by the bit-sliced comparison."""
    fps = stored(nodes.groupBy("fp").agg(F.min("node").alias("first")))
    equal = nodes.join(fps, "fp").where("node <> first").select(*_pair("first", "node"))
    near = simhash.near_links(fps.select("fp"))
    ends = fps.select(F.col("fp").alias("b"), F.col("first").alias("y"))
    return equal.unionAll(near.join(fps.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(ends, "b").select(*_pair("x", "y")))


def _by_centre(members: DataFrame) -> DataFrame:
    """Pairs of each bucket's centre with the others of members(key, node, n, met), met being the bucket's size."""
    popular = stored(members.groupBy("node").agg(F.sum("met").alias("popularity")))
    centre = members.join(popular, "node").groupBy("key").agg(F.max(F.struct("popularity", "node", "n")).alias("c"))
    met = members.join(stored(centre), "key").where((F.col("node") != F.col("c.node")) & _close(F.col("n"), F.col("c.n")))
    return met.select(*_pair("c.node", "node"))


def _dealt(open_: DataFrame) -> DataFrame:
    """Buckets of open_(key, node, n, label) in tiles (key, i, j): halves of about TILE nodes and TILE_BYTES of hashes at most, every two of which meet."""
    halves = F.greatest(F.ceil(F.count("*") / TILE), F.ceil(F.sum("n") * 8 / TILE_BYTES))
    tiles = stored(open_.groupBy("key").agg(halves.alias("tiles")))
    own = F.pmod(F.xxhash64("node"), F.col("tiles"))
    others = F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)
    placed = open_.join(tiles, "key").select("key", "node", "n", "label", own.alias("own"), F.explode(others).alias("other"))
    return stored(placed.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "n", "label"))


def _in_blocks(open_: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) within buckets of several labels: open_(key, node, n, label), a row a node and bucket."""
    dealt = _dealt(open_)
    parts = -(-dealt.count() // _ROWS_A_TASK) or 1
    full = dealt.drop("n").join(sets, "node").select("key", "i", "j", "node", "label", "hashes")
    return stored(full.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_joined, "a long, b long"))


def components(docs: DataFrame) -> DataFrame:
    """Of docs(doc_id, text), per distinct set of shingles: node, least (the first row of it), label (names the component)."""
    texts = docs.select(*row_key(F.col("doc_id"), F.col("text")), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sketched = texts.mapInArrow(map_blocks(_sketches), f"{ROW_KEY_SCHEMA}, node long, n long, fp long, keys array<long>")
    one = [F.min(F.struct(*ROW_KEY)).alias("least"), F.min("n").alias("n"), F.min("fp").alias("fp"), F.min("keys").alias("keys")]
    nodes = stored(sketched.groupBy("node").agg(*one))
    dealt = nodes.select("node", "n", F.explode("keys").alias("key"))
    shared = stored(dealt.groupBy("key").agg(F.count("*").alias("met")).where("met > 1"))
    members = stored(dealt.join(shared, "key"))
    needed = nodes.join(members.select("node").distinct(), "node").select("node", "least.*")
    # A row that repeats has its text once.
    wanted = texts.join(needed, ROW_KEY).groupBy("node").agg(F.first("text").alias("text"))
    sets = stored(wanted.mapInArrow(map_blocks(_sets), "node long, hashes binary"))

    links = _verified(_by_centre(members).unionAll(_by_fingerprint(nodes)).distinct(), sets)
    labels = connected_components(links)
    named = stored(members.join(labels, "node", "left").select("key", "node", "n", F.coalesce("label", "node").alias("label")))
    apart = stored(named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key"))
    more = _in_blocks(named.join(apart, "key").select("key", "node", "n", "label"), sets)
    every = labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionAll(more)
    final = connected_components(every)
    return nodes.select("node", "least").join(final, "node", "left").select("node", "least", F.coalesce("label", "node").alias("label"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: that of the least doc_id."""
    kept = components(docs).groupBy("label").agg(F.min("least").alias("keeps")).select("keeps.*")
    return one_row_of(docs, kept)
