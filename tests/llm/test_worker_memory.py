"""What a Python worker holds does not follow the number of rows that Spark hands it at a time."""

import random
import tracemalloc

import pyarrow as pa

from glacierlens.llm import neardup, words
from tests.llm.conftest import awkward_rows, prose


def _batch(texts):
    ids = pa.array(range(len(texts)), pa.int64())
    return pa.RecordBatch.from_arrays([ids, pa.array(texts, pa.string()), ids, ids], names=["doc_id", "text", "a", "b"])


def test_signatures_are_made_in_bounded_memory(monkeypatch):
    rnd = random.Random(5)
    page = prose(rnd, 2000, 900)
    batch = _batch([page[rnd.randrange(4000) :] for _ in range(1200)])
    monkeypatch.setattr(words, "_kept", {})
    tracemalloc.start()
    try:
        n = sum(out.num_rows for out in neardup._signed(batch))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n == 1200 and batch.nbytes > 4 << 20
    assert peak < 64 << 20, peak


def test_buffers_do_not_change_signatures(monkeypatch):
    batch = _batch([row[1] for row in awkward_rows()])

    def rows():
        return [r for out in neardup._signed(batch) for r in out.to_pylist()]

    want = rows()
    assert len(want) == batch.num_rows
    for size in (1, 300, 1 << 30):
        monkeypatch.setattr(neardup, "TEXT_BYTES", size)
        monkeypatch.setattr(words, "_kept", {})
        assert rows() == want


def test_buffers_hold_every_row_once():
    column = pa.array(["ab", None, "", "x" * 50, "é"], pa.string())
    assert [x for _, texts in words.buffers(column, 6) for x in texts] == [b"ab", b"", b"", b"x" * 50, "é".encode()]
    assert [first for first, _ in words.buffers(column, 6)] == [0, 3, 4] and not list(words.buffers(column[:0], 6))
