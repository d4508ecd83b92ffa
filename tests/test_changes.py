"""A folder's changes as a stream, over restarts."""

import os

import pytest

from notegraph.streaming import changes


def test_changes_over_restarts(spark, tmp_path):
    notes, out, checkpoint = tmp_path / "notes", str(tmp_path / "out"), str(tmp_path / "cp")
    (notes / "sub").mkdir(parents=True)
    (notes / ".obsidian").mkdir()
    seen = []

    def run():
        q = changes.note_changes(spark, str(notes)).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination(120)
        rows = sorted((r.path, r.change, r.length) for r in spark.read.schema(changes.SCHEMA).parquet(out).collect())
        new = list(rows)
        for r in seen:
            new.remove(r)
        seen[:] = rows
        return new

    (notes / "a.md").write_text("one")
    (notes / "sub" / "b é.md").write_text("two!")
    (notes / ".obsidian" / "c.md").write_text("hidden")
    (notes / "d.txt").write_text("no note")
    assert run() == [("a.md", "added", 3), ("sub/b é.md", "added", 4)]
    assert run() == []
    (notes / "a.md").write_text("one more")
    (notes / "sub" / "b é.md").unlink()
    (notes / "e.md").write_text("")
    assert run() == [("a.md", "changed", 8), ("e.md", "added", 0), ("sub/b é.md", "removed", None)]
    os.utime(notes / "e.md", (1, 1))
    (notes / "sub" / "b é.md").write_text("back")
    assert run() == [("e.md", "changed", 0), ("sub/b é.md", "added", 4)]
    for p in ("a.md", "e.md", "sub/b é.md"):
        (notes / p).unlink()
    assert [r[1] for r in run()] == ["removed"] * 3 and run() == []


def test_difference_and_bound(tmp_path):
    old, new = {"a": [1, 1], "b": [1, 1], "c": [1, 1]}, {"a": [1, 1], "b": [2, 1], "d": [1, 2]}
    assert changes.difference(old, new) == [("b", "changed", 2, 1), ("c", "removed", None, None), ("d", "added", 1, 2)]
    for i in range(3):
        (tmp_path / f"{i}.md").write_text("x")
    assert len(changes.listing(str(tmp_path), 3)) == 3 and changes.listing(str(tmp_path / "none"), 3) == {}
    with pytest.raises(ValueError, match="more than 2"):
        changes.listing(str(tmp_path), 2)
