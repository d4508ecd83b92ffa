"""The pipeline's stages against plain versions of what they decide."""

import random

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from notegraph.llm import bpe, pii, quality, queries

from . import brute
from .test_jaccard import plain_groups

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, results = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        results.append((before.collect(), docs))
    for before, after in results[:-1]:
        assert after.columns == columns

    before, after = results[0]
    model = quality.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    verdict = {r["doc_id"]: r["kept"] for r in quality.judge(spark.read.parquet(f"{SF}/documents.parquet"), model).collect()}
    kept = {r["doc_id"] for r in after.collect()}
    assert kept == {i for i, k in verdict.items() if k}
    for r in before:
        n, _, _, _, repeat = brute.quality_base(r["text"])
        assert not (r["doc_id"] in kept and (n < 20 or 100 * repeat > 30 * n))

    before, after = results[1]
    groups = plain_groups([(r["doc_id"], r["text"]) for r in before])
    assert sorted(r["doc_id"] for r in after.collect()) == sorted({min(i for i in groups if groups[i] == c) for c in set(groups.values())})

    before, after = results[2]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = [r["doc_id"] for r, x in zip(before, brute.decontaminate([r["text"] for r in before], items)) if not x[1]]
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(clean)

    before, after = results[3]
    auto = pii.automaton()
    want = {r["doc_id"]: pii.redact(r["text"], pii.find_spans(r["text"], auto)) for r in before}
    rows = after.collect()
    assert {r["doc_id"]: r["text"] for r in rows} == want and all(len(r["text"]) == r["n_chars"] for r in rows)
    assert not any(brute.pii_base(r["text"]) for r in rows)

    before, after = results[4]
    bpe_ = bpe.codec(public_tokenizers.path(queries.RANKS), public_tokenizers.PATTERN).bpe
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], bytes(r["ids"])) for r in after.collect()}
    for r in before:
        ids = np.array(bpe_.encode_ordinary(r["text"]), "<u4")
        assert got[r["doc_id"]] == (len(ids), brute.sha(ids.tobytes()), brute.sha(r["text"].encode()), ids.tobytes())
    assert len(got) == len(before)
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()) == sorted(got)


def words(rng, n):
    return " ".join(rng.choice("river stone light under quiet house garden winter summer morning".split()) + str(rng.randint(0, 99)) for _ in range(n))


def test_stages_on_odd_rows(spark, tmp_path):
    rng = random.Random(8)
    a, b, long = words(rng, 40), words(rng, 60), words(rng, 20_000)
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    rows = [
        (9001, None), (9002, ""), (9003, " \n"), (9004, "too few words"), (9005, a), (9005, a), (9006, a), (None, a), (None, b), (None, b), (None, words(rng, 50)), (9007, long), (9007, words(rng, 30)),
        (9008, f"{words(rng, 30)} {item} {words(rng, 30)}"), (2**63 - 1, f'{words(rng, 30)} token = "abcdef0123456789" mail x.y@z.org {words(rng, 9)}'), (9009, "same words here " * 40),
    ]
    docs = spark.createDataFrame([(i, t, None if k % 3 else "en", None, None if t is None else len(t)) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    extra = ["id", "text_key", "no_id", "_row", "node", "label", "c0", "n_words", "n_hit", "matches", "kept", "count"]
    docs = docs.withColumns({c: F.lit(c) for c in extra})
    columns, results = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, docs.limit(0), SF).count() == 0
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        results.append(docs.collect())
        assert k == 4 or (docs.columns == columns and all(r[c] == c for r in results[-1] for c in extra))
    named = lambda rows: sorted((repr(r["doc_id"]), r["text"]) for r in rows)

    good = []
    for i, t in rows:
        n, _, _, _, repeat = brute.quality_base(t)
        if n >= 20 and 100 * repeat <= 30 * n:
            good.append((i, t))
    assert named(results[0]) == sorted((repr(i), t) for i, t in good)
    one = {}
    for i, t in sorted(good, key=lambda r: (r[0] is None, r[0] or 0)):
        one.setdefault(t, i)
    assert named(results[1]) == sorted((repr(i), t) for t, i in one.items())
    assert named(results[2]) == sorted((repr(i), t) for t, i in one.items() if i != 9008)
    last = next(r for r in results[3] if r["doc_id"] == 2**63 - 1)
    assert "<SECRET>" in last["text"] and "<EMAIL>" in last["text"] and "abcdef" not in last["text"] and last["n_chars"] == len(last["text"])
    bpe_ = bpe.codec(public_tokenizers.path(queries.RANKS), public_tokenizers.PATTERN).bpe
    assert sorted(bytes(r["ids"]) for r in results[4]) == sorted(np.array(bpe_.encode_ordinary(r["text"]), "<u4").tobytes() for r in results[3])
