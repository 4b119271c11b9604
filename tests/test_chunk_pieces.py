"""Chunks of many files in one batch."""

import pyarrow as pa

from corpusforge.operators import chunking


class Files:
    """Stands in for a DataFrame; gives the function that tasks run."""

    def selectExpr(self, *_):
        return self

    def mapInArrow(self, run, _):
        return run


def test_chunks_of_a_batch_are_handed_on_in_pieces(monkeypatch):
    monkeypatch.setattr(chunking, "PIECE_CHARS", 20_000)
    files = [(f"f{i}.md", "\n".join(f"line {i} {j} of some words" for j in range(60))) for i in range(60)] + [("null.md", None), (None, "no name, but a text long enough")]
    batch = pa.RecordBatch.from_pylist([{"file": f, "content": c} for f, c in files])
    pieces = list(chunking.chunk_files(Files())(iter([batch, batch.slice(60)])))
    assert len(pieces) > 4 and all(sum(map(len, p.column("text").to_pylist())) < 25_000 for p in pieces)
    want = [(f, no, c["text"], c["start_line"], c["end_line"], c["token_count"]) for f, body in files + files[60:] if body for no, c in enumerate(chunking.smart_chunk(body, f or ""))]
    assert [tuple(r.values()) for p in pieces for r in p.to_pylist()] == want
