"""Tasks of the language model hold one row of an Arrow batch as Python objects."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from corpusforge.llm import lm_scoring

ROWS, LONG = 40, 1_000_000


def documents():
    return pa.RecordBatch.from_pydict({"doc_id": pa.array([str(i) for i in range(ROWS)]), "part": pa.array([lm_scoring.KEPT] * ROWS, pa.int32()), "text": pa.array(["a" * LONG] * ROWS)})


def stored():
    """Rows with long ids."""
    words, tokens = lm_scoring.pack_words([b"", b"x"]), lm_scoring.pack(np.array([1, 1, 0]))
    return pa.RecordBatch.from_pylist([{"batch": i, "development": False, "docs": [f"{i:03}" * (LONG // 3)], "parts": [lm_scoring.KEPT], "sizes": [3], "words": words, "tokens": tokens, "n": 3, "n_development": 0, "n_kept": 1} for i in range(ROWS)])


@pytest.mark.parametrize("batch, run, rows", [(documents(), lambda: lm_scoring._batches(pa.string()), 1), (stored(), lambda: lm_scoring._questions(3, 32, 1), 3 * ROWS)], ids=["texts", "batches"])
def test_one_row_at_a_time_is_python(monkeypatch, batch, run, rows):
    monkeypatch.setattr(lm_scoring.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0))
    tracemalloc.start()
    try:
        got = sum(b.num_rows for b in run()(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert got == rows and peak < ROWS * LONG / 4
