"""The listing of folder trees."""

import os

import pytest
from pyspark.sql import functions as F

from corpusforge.sources import crawl, files
from corpusforge.workspace import Workspace

NAMES = ["a.py", "_app.js", ".eslintrc.js", "pkg/__init__.py", "pkg/b.py", "__tests__/x.js", "src/_private/y.js", "src/main.js"]


def put(root, names):
    for name in names:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(f"// {name}\nfunction nothing() {{ return 'a line of some length'; }}")


def names_of(df):
    return sorted(r["relative"] for r in df.collect())


def test_no_name_is_lost(spark, tmp_path):
    put(tmp_path, NAMES)
    assert names_of(files.discover(spark, str(tmp_path), ["py", "js"])) == sorted(NAMES)
    assert names_of(files.scan(spark, f"file://{tmp_path}/")) == sorted(NAMES)
    row = files.scan(spark, str(tmp_path)).where("relative = 'pkg/__init__.py'").first()
    stat = os.stat(tmp_path / "pkg/__init__.py")
    assert (row["file"], row["size"], row["mtime_ms"]) == (f"{tmp_path}/pkg/__init__.py", stat.st_size, stat.st_mtime_ns // 1_000_000)


@pytest.mark.parametrize("budget", [1, 3, 1000])
def test_rounds_make_no_difference(spark, tmp_path, budget):
    deep = ["/".join(f"d{i}" for i in range(n)) + f"/f{n}.py" for n in range(1, 9)] + [f"wide{i}/x.py" for i in range(15)]
    put(tmp_path, NAMES + deep)
    assert names_of(crawl.crawl(spark, str(tmp_path), budget=budget)) == sorted(NAMES + deep)


def test_pruned_folders_are_not_entered(spark, tmp_path):
    put(tmp_path, [*NAMES, "node_modules/x/a.js", "src/.git/b.js", "dist/a/c.js", "gen/d.js", "src/gen/e.js"])
    for name in ("node_modules/x", "dist/a"):
        (tmp_path / name).chmod(0)  # entering them would be seen: an unreadable folder has no files
    found = names_of(crawl.crawl(spark, str(tmp_path), ["dist/**"], ["gen/"]))
    assert found == sorted(NAMES)
    for name in ("node_modules/x", "dist/a"):
        (tmp_path / name).chmod(0o755)
    kept = names_of(files.discover(spark, str(tmp_path), ["js"], ignore_lines=["gen/*", "!gen/d.js"]))
    assert "gen/d.js" in kept and "src/gen/e.js" in kept and "dist/a/c.js" in kept


def test_links_and_missing_folders(spark, tmp_path):
    put(tmp_path, ["a/x.py"])
    (tmp_path / "a/loop").symlink_to(tmp_path)
    (tmp_path / "link.py").symlink_to(tmp_path / "a/x.py")
    assert names_of(files.scan(spark, str(tmp_path))) == ["a/x.py", "link.py"]
    assert files.scan(spark, str(tmp_path / "none")).count() == 0


def test_workspace_indexes_all_names(spark, tmp_path):
    put(tmp_path / "p", NAMES)
    w = Workspace(spark, str(tmp_path / "p"), f"file://{tmp_path}/cache")
    assert w.index().files == len(NAMES)
    assert w.chunks().select(F.col("file")).distinct().count() == len(NAMES)


def test_the_roots_ignore_file_holds(spark, tmp_path):
    put(tmp_path / "p", ["a.py", "gen/b.py", "c.log.py"])
    (tmp_path / "p/.gitignore").write_text("# made\ngen/\n*.log.py\n")
    assert files.ignore_file(f"file://{tmp_path}/p") == ["# made", "gen/", "*.log.py"] and files.ignore_file(str(tmp_path)) == []
    w = Workspace(spark, str(tmp_path / "p"), f"file://{tmp_path}/cache")
    assert w.index().files == 1
    assert Workspace(spark, str(tmp_path / "p"), f"file://{tmp_path}/other", ignore_lines=["gen/"]).index().files == 2


def test_the_querys_tree_takes_no_disk(spark, sf):
    from corpusforge.plans.queries import crawl_tree
    from corpusforge.sources import shared

    found = {r["relative"]: r["size"] for r in crawl_tree(spark, sf).collect()}
    root = shared._STORED[(spark.sparkContext.applicationId, f"{sf} tree")].removeprefix("file://")
    stats = {n: os.stat(f"{root}/{n}") for n in found}
    assert {n: s.st_size for n, s in stats.items()} == found and sum(found.values()) > 0
    assert sum(s.st_blocks for s in stats.values()) == 0
