"""Search as a table function of SQL: ``SELECT * FROM search('graph engine', 5)``, or lateral, of a column of queries."""

from __future__ import annotations

from pyspark.sql import SparkSession

from notegraph.operators import index


def _grams(s: str, n: int) -> str:
    return f"IF(length({s}) >= {n}, array_distinct(transform(sequence(1, greatest(length({s}) - {n} + 1, 1)), i -> substr({s}, i, {n}))), array())"


_WORDS = r"filter(split(regexp_replace(lower(q), R'(?U)[^一-鿿\w]', ' '), ' '), w -> length(w) >= 2)"
_TERMS = f"array_distinct(flatten(transform({_WORDS}, w -> array_union(array(w), {_grams('w', 2)}))))"
_CHARS = f"array_union({_grams('lower(q)', 2)}, {_grams('lower(q)', 3)})"
#: The features of the text q, as ``search.postings`` names them.
FEATURES = f"concat(transform({_CHARS}, x -> struct('gram' AS kind, x AS feature)), transform({_TERMS}, x -> struct('term' AS kind, x AS feature)))"


def register(spark: SparkSession, held: index.StoredIndex, name: str = "search") -> None:
    """Makes name(q, k) a temporary table function over a stored index: rank, note_ord, score of the k best notes for the text q."""
    for part, df in (("blocks", held.blocks), ("features", held.features), ("notes", held.n_notes)):
        df.createOrReplaceTempView(f"{name}_{part}")
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION {name}(q STRING, k INT) RETURNS TABLE(rank INT, note_ord BIGINT, score DOUBLE) RETURN
      WITH asked AS (SELECT inline({FEATURES}) AS (kind, feature)),
      weighed AS (SELECT kind, feature, ln((n - df + 0.5D) / (df + 0.5D) + 1) * IF(kind = 'term', 2, 1) AS w FROM asked JOIN {name}_features USING (kind, feature) CROSS JOIN {name}_notes),
      posted AS (SELECT block * {index.BLOCK} + place AS note_ord, w FROM weighed JOIN {name}_blocks USING (kind, feature) LATERAL VIEW explode(places) AS place),
      scored AS (SELECT note_ord, floor(sum(w) * 1e4D + 0.5D) / 1e4D AS score FROM posted GROUP BY note_ord)
      SELECT CAST(rank AS INT), note_ord, score FROM (SELECT row_number() OVER (ORDER BY score DESC, note_ord) AS rank, note_ord, score FROM scored) WHERE rank <= k""")
