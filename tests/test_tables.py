"""Test tables as notes: odd rows, and what goes to the join with labels."""

import pytest
from pyspark.sql import functions as F

from notegraph.operators import search
from notegraph.sources import tables

TEXTS = [None, "", "\n", "\nsecond line", "one line", "first line of all\nsecond\n", "a\r\nb", "x" * 900, "y" * 70 + "\n" + "z" * 600, "数据 模型 数的\n二", "😀 face\n" + "😀" * 600]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, text, "en", None if i == 4 else "src1", len(text or "")) for i, text in enumerate(TEXTS)] + [(None, "no number", "en", "src2", 9), (1234567, "seven digits", "en", "src2", 12), (4, "again 4", "en", "src2", 7)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(4, 1, 1), (5, 0, 1), (6, 1, None), (77, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_odd_rows_as_notes(spark, folder):
    got = {(r.note_ord, r.text): r for r in tables.notes(spark, folder).collect()}
    assert len(got) == len(TEXTS) + 3
    for (i, text), r in got.items():
        line = None if text is None else text.split("\n")[0][:60]
        assert r.summary == (None if text is None else text[:500])
        assert r.name == (None if i is None or line is None else f"{str(i)[:6]:0>6}-{line}")
        assert r.path == (None if r.name is None or r.dir is None else f"{r.dir}/{r.name}.md")
        marks = {4: {"decree", "ephemeral"}, 5: {"ephemeral"}, 6: {"decree"}}.get(i, set())
        assert text is None and r.tags is None or marks <= set(r.tags)
    assert got[5, TEXTS[5]].tags == ["ephemeral", "first", "line"]


def test_no_whole_text_is_joined_unasked(spark, folder):
    """Of counts of features and the like only the heads of texts meet the labels."""
    notes = tables.notes(spark, folder)
    for df, whole in [(search.feature_counts(notes), False), (notes.select("path", "tags"), False), (notes.select("tags", F.length("text")), True)]:
        plan = df._jdf.queryExecution().optimizedPlan()
        while plan.nodeName() != "Join":
            plan = plan.children().apply(0)
        left = plan.children().apply(0).output()
        assert ("text" in [left.apply(i).name() for i in range(left.size())]) == whole
