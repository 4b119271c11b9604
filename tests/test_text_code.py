"""Token estimates, chunking, code extraction, paths and settings."""

import pytest
from pyspark.sql import functions as F

from corpusforge.functions import code, paths, registry
from corpusforge.functions import text as T
from corpusforge.functions import vector as V
from corpusforge.operators import graph, projects
from corpusforge.operators.chunking import count_tokens, smart_chunk
from corpusforge.sources.jsonc import parse_jsonc


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<float>' if isinstance(v, list) else 'string'}" for k, v in values.items()))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text", ["", "hello world", "a(b);{c}", "naïve — ﻿x", "astral 😀😀 end", "x" * 41, " \t\n", "日本語 text"])
def test_token_expression_equals_scanner(spark, text):
    want = count_tokens(text) + 2 if text else 0
    assert one(spark, T.token_estimate("t"), t=text) == want


def test_token_values(spark):
    assert one(spark, T.token_estimate("t"), t="hello world") == 6
    assert T.chunking_params() == {"max_tokens": 512, "target_tokens": 435, "overlap_tokens": 78}


def test_chunker_fixtures():
    assert smart_chunk("", "a.js") == []
    many = "\n".join(f"function function_{i}() {{ return {i}; }}" for i in range(500))
    chunks = smart_chunk(many, "a.js")
    assert len(chunks) > 1 and chunks[0]["start_line"] == 1 and chunks[-1]["end_line"] == 500
    assert all(b["start_line"] <= a["end_line"] + 1 for a, b in zip(chunks, chunks[1:], strict=False))
    two = smart_chunk("\n".join(["alpha beta gamma delta"] * 3), "a.js", max_tokens=18, target_tokens=15, overlap_tokens=3)
    assert len(two) > 1 and len(two[0]["text"].strip()) > 20
    parts = smart_chunk("short\n" + "x" * 60, "a.js", max_tokens=50, target_tokens=30, overlap_tokens=5, count=len)
    assert all(c["text"] != "short" for c in parts) and parts
    assert len(smart_chunk("\n".join("word " * 30 for _ in range(200)), "a.txt", max_chunks=3)) == 4


def test_chunker_keeps_every_line():
    body = "\n".join(f"line {i} " + "w " * (i % 9) + ("don't" if i % 7 == 0 else "") for i in range(400))
    seen = set()
    for c in smart_chunk(body, "x.py"):
        assert c["text"].split("\n") == body.split("\n")[c["start_line"] - 1 : c["end_line"]]
        seen.update(range(c["start_line"], c["end_line"] + 1))
    assert seen == set(range(1, 401))


@pytest.mark.parametrize(
    ("content", "path", "names"),
    [
        ("function foo() {}\nasync function bar() {}\nconst baz = () => {}\nlet qux = async () => {}", "a.js", {"foo", "bar", "baz", "qux"}),
        ("def my_function():\n  pass\nclass MyClass:\n  def method(self): pass", "a.py", {"my_function", "MyClass", "method"}),
        ("func (s *Server) Start() {}", "a.go", {"Start"}),
        ("impl Server { fn start() {} }", "a.rs", {"Server", "start"}),
        ("public class Main { public static void main(String[] a) {} }", "A.java", {"Main", "main"}),
        ("function odd() {}", "a.zig", {"odd"}),
    ],
)
def test_definitions(spark, content, path, names):
    assert names <= set(one(spark, code.definitions("c", "p"), c=content, p=path))


def test_calls(spark):
    assert set(one(spark, code.calls("c", "p"), c="foo(); bar.baz(); await asyncFunc();", p="a.js")) == {"foo", "baz", "asyncFunc"}
    text = 'if (x) { for (;;) {} } while (y) {} "quoted(1)"; // gone(2)\n/* lost(3) */ kept(4)'
    assert one(spark, code.calls("c", "p"), c=text, p="a.js") == ["kept"]
    assert one(spark, code.calls("c", "p"), c='# gone(1)\n"""doc(2)"""\nreal(3)', p="a.py") == ["real"]
    data = one(spark, code.call_data("c", "p"), c="function me() { me(); other(); }", p="a.js")
    assert data["calls"] == ["other"] and data["definitions"] == ["me"]
    assert set(one(spark, code.symbols("c"), c="function alpha() {} class Beta {} const gamma = 1")) == {"alpha", "Beta", "gamma"}


def test_graph_hops(spark):
    data = spark.createDataFrame([("a", ["funcA"], ["funcB"]), ("b", ["funcB"], ["funcC"]), ("c", ["funcC"], [])], "file string, definitions array<string>, calls array<string>")
    edges = graph.call_edges(data)
    near = lambda s, h: {r["file"]: r["proximity"] for r in graph.related_files(*edges, spark.createDataFrame([(s,)], "symbol string"), h).collect()}
    assert near("funcB", 1) == {"a": 1.0, "b": 1.0, "c": 0.5}
    assert near("funcB", -1) == {}
    assert near("funcA", 2) == {"a": 1.0, "b": 0.5, "c": pytest.approx(1 / 3)}
    kept, gone = graph.prune_call_data(data, data.where("file <> 'c'"))
    assert kept.count() == 2 and gone.first()["pruned"] == 1


def test_vectors(spark):
    assert one(spark, V.dot("a", "b"), a=[1.0, 2.0, 3.0], b=[4.0, 5.0, 6.0]) == 32
    assert one(spark, V.slice_normalize("v", 2), v=[3.0, 4.0, 5.0, 6.0]) == pytest.approx([0.6, 0.8])
    assert one(spark, V.slice_normalize("v", 2), v=[0.0, 0.0, 0.0]) == [0.0, 0.0]
    assert one(spark, V.slice_normalize("v", 5), v=[1.0, 2.0]) == [1.0, 2.0]
    assert one(spark, V.store_round("v"), v=[float("nan"), float("inf"), 0.1234567]) == [0, 0, pytest.approx(0.123457)]
    assert V.candidates(2, 10, 4, 6, 2) == 4 and V.candidates(5, 2) == 2


@pytest.mark.parametrize(("path", "out"), [("skip.js", True), ("a/skip.js", True), ("dir/file.js", True), ("x/dir/y/f.js", True), ("keep.js", False)])
def test_exclude(spark, path, out):
    assert one(spark, paths.exclude_predicate("p", ["skip.js", "**/dir/**"]), p=path) is out


@pytest.mark.parametrize(("path", "out"), [("a.log", True), ("keep.log", False), ("build/x", True), ("src/build/x", True), ("top", True), ("sub/top", False), ("# c", False)])
def test_gitignore(spark, path, out):
    assert one(spark, paths.gitignore_predicate("p", ["# comment", "", "*.log", "!keep.log", "build/", "/top"]), p=path) is out


def test_paths(spark):
    assert one(spark, paths.uri_to_path(paths.path_to_uri("p")), p="/a b/c+d/é.py") == "/a b/c+d/é.py"
    assert one(spark, paths.is_inside("p", "/root/x"), p="/root/x/y") and not one(spark, paths.is_inside("p", "/root/x"), p="/root/xy")
    assert not one(spark, paths.is_inside("p", "/root/x"), p="/root/x/../y")


def test_projects(spark):
    seen = lambda *p: {r["type"] for r in projects.detect_projects(spark.createDataFrame([(x,) for x in p], "path string")).collect()}
    assert seen("app.csproj", "a/b/c/package.json", "node_modules/x/go.mod") == {"dotnet"}


def test_registry(spark):
    assert one(spark, registry.detect_registry("p"), p="go:example.com/x")["registry"] == "go"
    assert one(spark, registry.registry_url(F.lit("maven"), "p"), p="nothing") is None


def test_jsonc():
    assert parse_jsonc('{"a": "x // y, }", /* c */ "b": [1, 2, ], // end\n}') == {"a": "x // y, }", "b": [1, 2]}


def test_table_function_equals_chunk_files(spark, sf):
    from corpusforge.operators.chunking import chunk_files, register_smart_chunk

    register_smart_chunk(spark)
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("concat('f', doc_id, '.py') as file", "text as content")
    options = {"max_tokens": 60, "target_tokens": 40, "overlap_tokens": 5}
    want = {tuple(r) for r in chunk_files(docs, **options).select("file", "chunk_no", "text", "start_line", "end_line", "token_count").collect()}
    got = spark.sql("SELECT f.file, c.* FROM {docs} f, LATERAL smart_chunk(f.content, f.file, max_tokens => 60, target_tokens => 40, overlap_tokens => 5) c", docs=docs)
    assert {tuple(r) for r in got.collect()} == want and want
    assert spark.sql("SELECT * FROM smart_chunk(CAST(NULL AS STRING), 'a.py')").count() == 0
