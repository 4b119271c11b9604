"""A workspace end to end: index, edit, delete, search, status."""

import os

import pytest

from corpusforge.workspace import Workspace


@pytest.fixture
def project(tmp_path):
    root = tmp_path / "proj"
    root.mkdir()
    (root / "test.js").write_text('function hello() {\n  console.info("hello world");\n}\n\n// embedder fixture\nmodule.exports = { hello };')
    (root / "utils.py").write_text('def add(a, b):\n    """Adds two numbers"""\n    return a + b\n\nif __name__ == "__main__":\n    print(add(2, 3))')
    (root / "README.md").write_text("# Test Project\n\nThis is a test.")
    for f in root.iterdir():
        os.utime(f, (1_600_000_000, 1_600_000_000))
    return root


def test_life_of_an_index(spark, project, tmp_path):
    w = Workspace(spark, str(project), f"file://{tmp_path}/cache")
    assert w.search("anything").count() == 0
    first = w.index()
    assert (first.mode, first.files, first.processed, first.chunks) == ("initial", 3, 3, 3)
    again = w.index()
    assert (again.processed, again.deleted, again.chunks) == (0, 0, 3)

    (project / "new.js").write_text("function uniqueTokenXyz() { return hello(); } // a new file with some text")
    os.utime(project / "new.js", (1_600_000_001, 1_600_000_001))
    assert w.index().processed == 1
    assert "uniqueTokenXyz" in w.search_markdown("uniqueTokenXyz", 3) and "new.js" in w.search_markdown("uniqueTokenXyz", 3)
    (project / "new.js").write_text("function otherName() { return hello(); } // the file was edited since then")
    os.utime(project / "new.js", (1_600_000_002, 1_600_000_002))
    assert w.index().processed == 1 and w.chunks().where("content like '%uniqueTokenXyz%'").count() == 0
    (project / "new.js").unlink()
    gone = w.index()
    assert gone.deleted == 1 and gone.chunks == 3

    assert w.find_similar((project / "utils.py").read_text(), min_similarity=0).where("file like '%utils.py'").count() == 0
    assert w.find_similar("def add(a, b): return a + b", min_similarity=0).first()["file"].endswith("utils.py")
    assert w.truncated(16).selectExpr("size(vector) as n").first()["n"] == 16
    assert w.ann_config("rebuild").first()["count"] == 3 and w.ann_config("set", 1).first()["nprobe"] == 1
    assert w.resources().count() == 3
    assert w.status().first()["reason"] == "recent_activity"
    assert w.index(force=True).mode == "full"
    other = Workspace(spark, str(project), f"file://{tmp_path}/cache", model="another")
    assert other.chunks().count() == 0 and other.index().mode == "full"
    w.clear()
    assert w.chunks().count() == 0
    with pytest.raises(ValueError):
        w.set_workspace("/Applications/x/y")
    assert w.package("pip:requests").first()["registry"] == "pypi"


def test_failed_embedding_keeps_the_old_file(spark, project, tmp_path):
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    cache = f"file://{tmp_path}/cache"
    assert Workspace(spark, str(project), cache).index().chunks == 3
    (project / "utils.py").write_text("def changed_function_of_some_length(): pass  # bad")
    os.utime(project / "utils.py", (1_600_000_009, 1_600_000_009))

    def broken(c):
        return F.lit(None).cast(T.ArrayType(T.FloatType()))

    w = Workspace(spark, str(project), cache, provider=broken)
    assert w.index().chunks == 3 and w.chunks().where("content like '%Adds two%'").count() == 1
    fixed = Workspace(spark, str(project), cache)
    assert fixed.index().processed == 1 and fixed.chunks().where("content like '%changed_function%'").count() == 1
