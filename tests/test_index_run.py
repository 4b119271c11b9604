"""What a first index run does not do: void, join or search what can't be there."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from corpusforge import workspace
from corpusforge.functions import code
from corpusforge.sources import files
from corpusforge.workspace import Workspace


def write(path, text, at):
    path.write_text(text)
    os.utime(path, (at, at))


def test_new_files_void_nothing(spark, tmp_path, monkeypatch):
    root = tmp_path / "p"
    root.mkdir()
    for i in range(30):
        write(root / f"f{i}.py", "\n".join(f"def function_{i}_{j}(argument):\n    return argument + {j}  # words" for j in range(1 + 40 * (i % 3))), 1_600_000_000)
    write(root / "empty.py", "", 1_600_000_000)
    monkeypatch.setattr(workspace, "FILES_A_BATCH", 10)
    w = Workspace(spark, str(root), f"file://{tmp_path}/cache")
    w.index()
    assert len(w.store.meta().layers) == 4 and not list((tmp_path / "cache").rglob("touched"))
    assert "Join" not in w.chunks()._jdf.queryExecution().optimizedPlan().toString()
    rows = sorted((r["chunk_id"], r["file"], r["start_line"]) for r in w.chunks().collect())
    assert [r[0] for r in rows] == list(range(len(rows))) and len(rows) == w._total() > 40
    lines = {}
    for _, file, line in rows:  # a file's chunks have ids in a row, in order
        lines.setdefault(file, []).append(line)
    assert all(x == sorted(x) for x in lines.values()) and len(lines) == 30 == len([f for f, g in zip(rows, [(0, "", 0), *rows]) if f[1] != g[1]])

    write(root / "f4.py", "def edited_function(argument):\n    return argument  # other words", 1_600_000_009)
    (root / "f5.py").unlink()
    assert w.index().processed == 1
    held = w.chunks().select("file").distinct().collect()
    assert len(held) == 29 and w.chunks().where("file like '%/f4.py'").count() == 1 and w._total() == w.chunks().count()


def test_read_files_hands_on_pieces_with_their_columns(spark, tmp_path):
    rows = []
    for i, size in enumerate([700_000, 0, 700_000, 5, 2_000_000, 900_000]):
        (tmp_path / f"{i}.txt").write_bytes(bytes([97 + i]) * size)
        rows.append((f"{tmp_path}/{i}.txt", i, None if i == 3 else f"k{i}"))
    rows.append((f"{tmp_path}/none.txt", 9, "k9"))
    listed = spark.createDataFrame([*rows, (None, 1, "x")], "file string, n int, k string").coalesce(1)
    got = {r["n"]: r for r in files.read_files(listed, 1 << 20, keep=("n", "k")).collect()}
    assert {n: (r["file"], r["k"]) for n, r in got.items()} == {n: (f, k) for f, n, k in rows}
    assert [(got[n]["status"], len(got[n]["content"]) if got[n]["content"] is not None else None) for n in (0, 1, 2, 3, 4, 5, 9)] == [("", 700_000), ("", 0), ("", 700_000), ("", 5), ("too_large", None), ("", 900_000), ("stat_failed", None)]
    assert got[5]["content"][:1] == "f" and got[2]["content"][-1:] == "c"


@pytest.mark.parametrize("patterns", [*code.DEFINITIONS.values(), code.SYMBOLS, [code.CALL]])
def test_patterns_search_only_texts_that_can_match(spark, patterns):
    rng = random.Random(5)
    words = ["function", "class", "const x =", "async", "def", "func", "fn", "impl", "public", "name", "(a)", "(", ")", "{", "=>", ":", "<T>", "\n", " ", "if (x) {", "f(a) {", "const f = (a) => b"]
    texts = ["", "plain words", *(" ".join(rng.choice(words) for _ in range(rng.randint(1, 12))) for _ in range(300))]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for p in patterns:
        assert code.needed(p)
        tight = F.regexp_extract_all("t", F.lit(code.without_backtracking(p)), F.lit(1))
        rows = df.select("t", code._found(F.col("t"), p).alias("found"), tight.alias("all")).collect()
        assert all(r["found"] == r["all"] for r in rows) and any(r["all"] for r in rows)
        assert all(x in r["t"] for r in rows if r["all"] for x in code.needed(p))
    plan = df.select(code._all(F.col("t"), patterns).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall("(?i)contains", plan)) >= len(patterns)
