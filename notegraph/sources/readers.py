"""Scans: a directory of Markdown, feedback logs, listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HIDDEN = "(^|/)\\."
EDGE = "struct<`from`:string,`to`:string,`type`:string>"
FEEDBACK = (
    "session_id string, `timestamp` string, ts string, query string, satisfied boolean, confidence string, "
    f"consumed_edges array<{EDGE}>, ignored_edges array<{EDGE}>, edges_used array<{EDGE}>"
)


def _relative(path, root: str):
    return F.regexp_replace(F.regexp_replace(path, "^file:/*", "/"), "^" + root.rstrip("/").replace("file:", "").replace(".", "\\.") + "/", "")


def read_notes(spark: SparkSession, root: str) -> DataFrame:
    """path, text, modified, length of every ``*.md`` below root outside dot directories."""
    raw = (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").option("ignoreCorruptFiles", True)
        .text(root, wholetext=True).select(_relative(F.col("_metadata.file_path"), root).alias("path"), F.col("value").alias("text"),
                           F.col("_metadata.file_modification_time").alias("modified"), F.col("_metadata.file_size").alias("length"))
    )
    return raw.where(~F.col("path").rlike(HIDDEN))


def list_notes(spark: SparkSession, root: str) -> DataFrame:
    """path, modified, length without reading any content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root)
    return files.select(_relative(F.col("path"), root).alias("path"), F.col("modificationTime").alias("modified"), "length").where(~F.col("path").rlike(HIDDEN))


def event_time(text):
    """ISO time; one without an offset is of UTC+8."""
    zoned = F.when(text.rlike("(Z|[+-]\\d{2}:?\\d{2})$"), text).otherwise(F.concat(text, F.lit("+08:00")))
    return F.try_to_timestamp(zoned)


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    """Feedback records with a readable time; broken lines drop out."""
    raw = spark.read.schema(FEEDBACK).option("mode", "DROPMALFORMED").json(path)
    return raw.withColumn("ts", event_time(F.coalesce("timestamp", "ts"))).drop("timestamp").where("ts is not null")


def feedback_window(feedback: DataFrame, now, days: int = 30, last_applied=None) -> DataFrame:
    """Records from ``days`` before now on, or from the last applied one if that is later."""
    floor = F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS")
    if last_applied is not None:
        floor = F.greatest(floor, F.lit(last_applied).cast("timestamp"))
    return feedback.where(F.col("ts") >= floor)


def read_eval(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation queries from a JSON array: id, query, type, relevant (names), notes."""
    return spark.read.schema("id int, query string, type string, relevant array<string>, notes string").option("multiLine", True).json(path)


def relevant_names(queries: DataFrame) -> DataFrame:
    """Evaluation queries to query_id, name, a row for each relevant note."""
    return queries.select(F.col("id").cast("long").alias("query_id"), F.explode("relevant").alias("name"))


def loose_date(text):
    """A time from the first 19 characters, in one of three forms; null if it fits none."""
    t = F.substring(text, 1, 19)
    forms = (("^\\d{4}-\\d{2}-\\d{2}$", "yyyy-MM-dd"), ("^\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}$", "yyyy-MM-dd'T'HH:mm:ss"), ("^\\d{4}-\\d{2}-\\d{2} \\d{2}:\\d{2}:\\d{2}$", "yyyy-MM-dd HH:mm:ss"))
    return F.coalesce(*(F.when(t.rlike(shape), F.try_to_timestamp(t, F.lit(form))) for shape, form in forms))


def listing_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, change (added, removed, changed) between two listings (path, modified, length)."""
    a, b = old.select("path", F.struct("modified", "length").alias("a")), new.select("path", F.struct("modified", "length").alias("b"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return a.join(b, "path", "full").select("path", change.alias("change")).where("change is not null")
