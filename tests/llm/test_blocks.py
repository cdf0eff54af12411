"""Batches cut by bytes of text."""

import pyarrow as pa

from wordmill.llm import blocks


def test_small_batches_hold_the_same_rows():
    texts = [None, "", "é" * 50, "x" * 500, None, "ab", "c" * 90, "d" * 10] * 7
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    got = list(blocks.small(iter([batch, batch.slice(0, 0)]), 100))
    assert [x for b in got for x in b.to_pylist()] == batch.to_pylist()
    assert all(b.num_rows == 1 or sum(len(t.encode()) for t in b.column("text").to_pylist() if t) <= 100 + 500 for b in got) and len(got) > 10
    other = pa.RecordBatch.from_arrays([pa.array([1, 2])], ["word"])
    assert list(blocks.small(iter([other]), 1)) == [other]


def test_frugal_tasks_give_what_they_gave():
    @blocks.frugal
    def task(batches):
        for b in batches:
            yield b.num_rows

    batch = pa.RecordBatch.from_arrays([pa.array(["a" * blocks.PIECE] * 9)], ["text"])
    assert sum(task(iter([batch]))) == 9 and len(list(task(iter([batch])))) == 3
