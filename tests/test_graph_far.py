"""Related files beyond one hop."""

import pytest

from corpusforge.operators.graph import related_files
from corpusforge.sources import stores


def edges(spark, rows):
    return spark.createDataFrame(rows, "symbol string, file string")


@pytest.mark.parametrize("hops", [2, 5, 9])
def test_chain_and_cycle(spark, hops):
    """File i defines s(i) and calls s(i + 1); the last one calls the first's symbol again."""
    n = 8
    defines, calls = edges(spark, [(f"s{i}", f"f{i}") for i in range(n)]), edges(spark, [(f"s{(i + 1) % n}", f"f{i}") for i in range(n)])
    got = {r["file"]: r["proximity"] for r in related_files(defines, calls, spark.createDataFrame([("s0",)], "symbol string"), hops).collect()}
    # s0 is defined by f0 and called by f7: hop 0.  Each further hop adds the next file of both sides.
    want, front = {}, {"s0"}
    for hop in range(hops + 1):
        files = {f"f{i}" for i in range(n) if f"s{i}" in front or f"s{(i + 1) % n}" in front}
        for f in files:
            want.setdefault(f, 1 / (hop + 1))
        front = {f"s{(i + 1) % n}" for i in range(n) if f"f{i}" in files}
    assert got == want


def test_plan_does_not_grow(spark):
    defines, calls = edges(spark, [(f"s{i}", f"f{i}") for i in range(12)]), edges(spark, [(f"s{i + 1}", f"f{i}") for i in range(12)])
    size = [len(related_files(defines, calls, spark.createDataFrame([("s0",)], "symbol string"), h)._jdf.queryExecution().optimizedPlan().toString().splitlines()) for h in (4, 8)]
    assert size[1] <= size[0] + 8


def test_json_ids_are_dense(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"f{i}", 1, 2, str(i), [1.0]) for i in range(40)], stores.CHUNK_SCHEMA).repartition(5)
    stores.write_json_store(rows, f"file://{tmp_path}/j")
    assert sorted(r["chunk_id"] for r in stores.read_json_store(spark, f"file://{tmp_path}/j").collect()) == list(range(40))
