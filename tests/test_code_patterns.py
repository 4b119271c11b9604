"""Patterns that don't try again find what the plain ones find."""

import time

import pytest
from pyspark.sql import functions as F

from corpusforge.functions import code
from corpusforge.sources.shared import spread

TEXTS = [
    "function f(a) { g(b) }\n  async  h (x)\n{ }\nclass K { m(a, b) { n() } }", "1foo(a) {} a1b(c){ $x(1) a$b(2) { } é(x) { éy(z){", "const p = async (a) => 1; let q=(b)=>2; var $z = (c) => {}",
    "open(( [^)] x) { y ( \n ) \n {", "  \n\n  name(\n)\n{", "call(no end", "'a\\'b' \"c(d)\" `e(f)` 'unclosed(g) \"x\\\ny\" \\\" z(", "",
]


@pytest.mark.parametrize("pattern", [*code.DEFINITIONS["javascript"], *code.SYMBOLS, code.CALL])
def test_equal_matches(spark, pattern):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    find = lambda p: F.regexp_extract_all("t", F.lit(p), F.lit(1))
    assert rows.where(find(pattern) != find(code.without_backtracking(pattern))).count() == 0


def test_long_names_take_no_square_of_time(spark):
    text = spark.range(1).select(F.repeat(F.lit("a"), 60_000).alias("t"))
    start = time.monotonic()
    assert text.select(F.size(code.definitions("t", F.lit("x.js"))).alias("n")).first()["n"] == 0
    assert time.monotonic() - start < 10


def test_pieces_of_a_table_are_bounded(spark):
    assert spread(spark.range(100, numPartitions=4), 10).rdd.getNumPartitions() == 10
