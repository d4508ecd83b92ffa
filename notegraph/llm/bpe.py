"""Byte-level BPE encoding and decoding by overlapping chunks.

A text of up to ``chunk_chars`` code points is one chunk and is encoded where it
lies. A longer text becomes rows of overlapping chunks, dealt out over the cluster;
each is pre-tokenised and its pieces are encoded on their own. Chunks are stitched
at the first place in their overlap that is a pre-token boundary in both: from there
on the pattern sees the same text, so both agree. A boundary counts only if its
match ended ``_LOOKAHEAD`` code points before the cut, which is more than the
pattern ever looks ahead. Where no boundary is shared (one pre-token as long as the
overlap) the seam is pre-tokenised again from the last boundary that holds.
Decoding concatenates the raw bytes of the ids.

Edge cases: a null text is the empty text, with no ids. A very long text is many chunks,
whose ids meet again in one task. Of merges that tie in rank the leftmost comes first, as
the ranks say; of shared boundaries the first is the seam. Rows that repeat, or whose
doc_id is null, are encoded row by row. Empty tables give empty results; columns other
than doc_id and text are ignored, whatever they are called.
"""

from __future__ import annotations

import base64
import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegraph.llm.common import text_key

CHUNK_CHARS = 1 << 16
OVERLAP_CHARS = 1 << 10
_LOOKAHEAD = 4
_CACHED_PIECES = 100_000


def load_ranks(lines: list[str]) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class Codec:
    """Encodes pre-tokens, remembering recent ones, and decodes ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = regex.compile(pattern)
        self.bpe = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.raw = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            self.raw[i] = token
        self.cache: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def ids(self, piece: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if len(self.cache) >= _CACHED_PIECES:
            self.cache.clear()
        out = np.asarray(self.bpe.encode_ordinary(piece), "<u4").tobytes()
        if len(piece) < 64:
            self.cache[piece] = out
        return out

    def encode(self, pieces: list[str]) -> list[bytes]:
        got = list(map(self.cache.get, pieces))
        for i, x in enumerate(got):
            if x is None:
                got[i] = self.cache.get(pieces[i]) or self.ids(pieces[i])
        return got

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.raw.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def codec(ranks_path: str, pattern: str) -> Codec:
    """One codec a worker process; the rank file is part of the installed tokenizer package."""
    held = codec.__dict__.setdefault("held", {})
    if (ranks_path, pattern) not in held:
        with open(ranks_path) as f:
            held[ranks_path, pattern] = Codec(load_ranks(f.readlines()), pattern)
    return held[ranks_path, pattern]


def _result(c: Codec, doc_ids: pa.Array, ids: list[bytes], decoded: bool) -> pa.RecordBatch:
    more = {"decoded": pa.array([c.decode(x) for x in ids], pa.binary())} if decoded else {}
    return pa.RecordBatch.from_pydict({"doc_id": doc_ids, "ids": pa.array(ids, pa.binary()), **more})


def _encode_whole(ranks_path: str, pattern: str, decoded: bool):
    def run(batches):
        c = codec(ranks_path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield _result(c, part.column(0), [b"".join(c.encode(c.pieces(t.as_py() or ""))) for t in part.column(1)], decoded)

    return run


def _encode_chunk(ranks_path: str, pattern: str):
    def run(batches):
        c = codec(ranks_path, pattern)
        at = {n: i for i, n in enumerate(("doc_id", "text_key", "n_chunks", "chunk", "start", "text"))}
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                pieces = c.pieces(row.column(at["text"])[0].as_py())
                ids = c.encode(pieces)
                lens = np.fromiter(map(len, pieces), np.int32, len(pieces))
                sizes = np.fromiter(map(len, ids), np.int32, len(ids))
                yield pa.RecordBatch.from_arrays(
                    [*row.columns, pa.array([lens.tobytes()], pa.binary()), pa.array([sizes.tobytes()], pa.binary()), pa.array([b"".join(ids)], pa.binary())],
                    names=[*at, "lens", "sizes", "ids"],
                )

    return run


def stitch(chunks: list[dict], c: Codec) -> bytes:
    """Ids of a text from its chunks in order: start, text, lens, sizes, ids."""
    out: list[bytes] = []
    parsed = []
    for x in chunks:
        ends = np.cumsum(np.frombuffer(x["lens"], np.int32), dtype=np.int64) + x["start"]
        cuts = np.concatenate([[0], np.cumsum(np.frombuffer(x["sizes"], np.int32), dtype=np.int64)])
        parsed.append({"start": x["start"], "end": x["start"] + len(x["text"]), "text": x["text"], "bounds": np.concatenate([[x["start"]], ends]), "cuts": cuts, "ids": x["ids"]})
    pos, cur = 0, parsed[0]
    for nxt in [*parsed[1:], None]:
        k = int(np.searchsorted(cur["bounds"], pos))
        if nxt is None:
            out.append(cur["ids"][cur["cuts"][k] :])
            break
        holds = cur["bounds"][k:]
        holds = holds[holds <= cur["end"] - _LOOKAHEAD]
        shared = holds[np.isin(holds, nxt["bounds"][1:])]
        shared = shared[shared > nxt["start"]]
        if len(shared):
            pos = int(shared[0])
            out.append(cur["ids"][cur["cuts"][k] : cur["cuts"][int(np.searchsorted(cur["bounds"], pos))]])
            cur = nxt
            continue
        pos_new = int(holds[-1]) if len(holds) else pos
        out.append(cur["ids"][cur["cuts"][k] : cur["cuts"][int(np.searchsorted(cur["bounds"], pos_new))]])
        text = cur["text"][pos_new - cur["start"] :] + nxt["text"][cur["end"] - nxt["start"] :]
        pieces = c.pieces(text)
        ids = c.encode(pieces)
        bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))]) + pos_new
        cuts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))])
        pos, cur = pos_new, {"start": pos_new, "end": nxt["end"], "text": text, "bounds": bounds, "cuts": cuts, "ids": b"".join(ids)}
    return b"".join(out)


def _stitch_group(ranks_path: str, pattern: str, decoded: bool):
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.select(["chunk", "start", "text", "lens", "sizes", "ids"]).to_pylist(), key=lambda r: r["chunk"])
        copies = sum(r["chunk"] == 0 for r in rows)  # rows that repeat share a group
        c = codec(ranks_path, pattern)
        ids = stitch(rows[::copies], c)
        doc = table.column("doc_id")[0].as_py()
        return pa.Table.from_batches([_result(c, pa.array([doc] * copies, pa.int64()), [ids] * copies, decoded)])

    return run


def encode(docs: DataFrame, ranks_path: str, pattern: str, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS, decoded: bool = False) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, ids binary (little-endian unsigned 32-bit).

    With ``decoded`` the ids are decoded by the worker that made them, as ``decode`` would.
    """
    if not _LOOKAHEAD < overlap_chars < chunk_chars:
        raise ValueError("chunks must be longer than their overlap")
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = F.length("text")
    schema = "doc_id long, ids binary" + ", decoded binary" * decoded
    whole = rows.where(n <= chunk_chars).mapInArrow(_encode_whole(ranks_path, pattern, decoded), schema)
    chunks = (
        rows.where(n > chunk_chars)
        .withColumns({"text_key": text_key(F.col("text")), "n_chunks": F.ceil((n - overlap_chars) / (chunk_chars - overlap_chars)).cast("int")})
        .select("doc_id", "text_key", "n_chunks", "text", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)).alias("chunk"))
        .withColumn("start", (F.col("chunk").cast("long") * (chunk_chars - overlap_chars)))
        .select("doc_id", "text_key", "n_chunks", "chunk", "start", F.substring("text", (F.col("start") + 1).cast("int"), F.lit(chunk_chars)).alias("text"))
        .repartition(F.col("doc_id"), F.col("text_key"), F.col("chunk"))
        .mapInArrow(
            _encode_chunk(ranks_path, pattern),
            "doc_id long, text_key long, n_chunks int, chunk int, start long, text string, lens binary, sizes binary, ids binary",
        )
    )
    long = chunks.groupBy("doc_id", "text_key").applyInArrow(_stitch_group(ranks_path, pattern, decoded), schema)
    return whole.unionByName(long)


def _decode(ranks_path: str, pattern: str):
    def run(batches):
        c = codec(ranks_path, pattern)
        for batch in batches:
            at = batch.schema.get_field_index("ids")
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                raw = [c.decode(x.as_py() or b"") for x in part.column(at)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(raw, pa.binary())], names=[*batch.schema.names, "decoded"])

    return run


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """encoded(…, ids) with ``decoded``, the raw bytes."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(_decode(ranks_path, pattern), f"{schema}, decoded binary")


def digest(decoded: DataFrame, *more: str) -> DataFrame:
    return decoded.select(
        "doc_id", *more, (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
