"""Sinks: tables, logs, result files, and text for people."""

from __future__ import annotations

import re
import uuid
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_postings(index: DataFrame, name: str, path: str, buckets: int = 64) -> None:
    """The n-gram index as a table bucketed by feature, so that searches join it without a shuffle."""
    index.write.mode("overwrite").option("path", path).bucketBy(buckets, "feature").sortBy("feature").saveAsTable(name)


def append_feedback(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


def file_name(query: str) -> str:
    return re.sub(r"[^\w一-鿿-]+", "_", query).strip("_")[:50] or "query"


def save_results(hits: DataFrame, folder: str, query: str) -> str:
    """Hits of one query as JSON in a folder of its name."""
    path = f"{folder.rstrip('/')}/{file_name(query)}"
    hits.write.mode("overwrite").json(path)
    return path


def save_report(metrics: DataFrame, folder: str, stamp: str) -> str:
    path = f"{folder.rstrip('/')}/eval-{stamp}"
    metrics.withColumn("stamp", F.lit(stamp)).write.mode("overwrite").json(path)
    return path


def save_prompts(prompts: DataFrame, folder: str) -> str:
    """Prompts for a provider that is not at hand, as JSON lines."""
    path = f"{folder.rstrip('/')}/prompts"
    prompts.write.mode("overwrite").json(path)
    return path


def save_state(state: DataFrame, folder: str, name: str = "import-state") -> str:
    """A one-row state as JSON, over the last one."""
    path = f"{folder.rstrip('/')}/{name}"
    state.coalesce(1).write.mode("overwrite").json(path)
    return path


def write_notes(files: DataFrame, root: str) -> int:
    """New notes(path below root, text) as files, by the tasks that hold them; one that is there is not touched. How many were written.

    Each is written under another name and moved into place, so that a task that fails leaves no half of one.
    """
    root = root if "://" in root else f"file://{root}"

    def run(batches):
        for batch in batches:
            n = 0
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, at = pyarrow.fs.FileSystem.from_uri(f"{root.rstrip('/')}/{quote(path)}")
                if fs.get_file_info(at).type == pyarrow.fs.FileType.NotFound:
                    folder, _, name = at.rpartition("/")
                    fs.create_dir(folder)
                    part = f"{folder}/.{uuid.uuid4().hex}.tmp"
                    with fs.open_output_stream(part) as out:
                        out.write((text or "").encode())
                    fs.move(part, f"{folder}/{name}")
                    n += 1
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return files.select("path", "text").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def write_pagerank(ranks: DataFrame, path: str) -> None:
    """PageRank as a table of its own: name, pagerank, the greatest first, so that readers of the best read little."""
    ranks.select("name", "pagerank").orderBy(F.col("pagerank").desc(), "name").write.mode("overwrite").parquet(path)


def with_pagerank(notes: DataFrame, ranks: DataFrame) -> DataFrame:
    """notes with ``pagerank``, 0 for those that no edge touches."""
    return notes.drop("pagerank").join(ranks.select("name", "pagerank"), "name", "left").fillna(0.0, ["pagerank"])


def feedback_report(report: Row, edges: Row, dry_run: bool = False) -> str:
    """Text of feedback.cycle's report and graph.stats' row."""
    head = f"===== {'[DRY-RUN] ' if dry_run else ''}weights after feedback ====="
    lines = [head, *(f"  {label + ':':<16}{report[c]}" for label, c in (("records", "records"), ("updated", "updated"), ("created", "created"), ("capped at most", "capped_max"), ("capped at least", "capped_min"), ("weights", "total_weights"), ("decayed", "decayed")))]
    return "\n".join([*lines, f"  {'edges:':<16}{edges['prerequisite_edges']} prerequisite, {edges['similarity_edges']} similarity"])


def eval_report(rows: list[Row], averages: Row, mode: str) -> str:
    """Text of evaluate.metrics' collected rows and evaluate.averages' row."""
    mark = lambda r: "ok " if r["f1"] >= 0.5 else "low" if r["f1"] > 0 else "-- "
    lines = [f"{mark(r)} [{r['query_id']}] mrr {r['mrr']:.2f}  p {r['precision']:.2f}  r {r['recall']:.2f}  {'rank ' + str(r['first_hit_rank']) if r['first_hit_rank'] else 'not found'}" for r in sorted(rows, key=lambda r: r["query_id"])]
    a = averages
    return "\n".join([*lines, f"{mode}: precision {a['mean_precision']:.3f}  recall {a['mean_recall']:.3f}  mrr {a['mean_mrr']:.3f}  f1 {a['mean_f1']:.3f}  hits {a['hits']}/{a['n']}  without recall {a['zero_recall']}/{a['n']}"])


def listing(rows: list[Row]) -> str:
    """Collected search rows, one a line: rank, score, title, source."""
    line = lambda r: f"{r['rank']:>2}. {r['score']:.3f}  {r['title']}  [{r['source']}]"
    return "\n".join(map(line, sorted(rows, key=lambda r: r["rank"])))


def reading_path(rows: list[Row]) -> str:
    """Collected prerequisite rows from the deepest to the start."""
    return " → ".join(r["name"] for r in sorted(rows, key=lambda r: (-r["depth"], -r["rank_score"], r["name"])))
