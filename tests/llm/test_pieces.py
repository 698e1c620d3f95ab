"""Pieces of Arrow batches hold all rows, in order, and no more bytes than they may."""

from __future__ import annotations

import pyarrow as pa
import pytest

from tidemark.llm.pieces import pieces


@pytest.mark.parametrize("size", [1, 7, 100, 10**6])
@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_pieces_hold_all_rows(size, kind):
    texts = ["", None, "é" * 5, "x" * 300, "x" * 300, None, "ab", "", "c" * 40] * 3
    batches = [pa.RecordBatch.from_arrays([pa.array(range(len(t)), pa.int64()), pa.array(t, kind)], names=["id", "text"]) for t in (texts, [], [None], texts[:4])]
    got = list(pieces(iter(batches), 1, size))
    assert [r for p in got for r in p.to_pylist()] == [r for b in batches for r in b.to_pylist()]
    assert all(p.num_rows for p in got)
    for p in got:
        lengths = [len((t or "").encode()) for t in p.column(1).to_pylist()]
        assert sum(lengths) - max(lengths) <= size


def test_a_scope_removes_tables(spark, tmp_path):
    import os

    from tidemark.llm.common import materialise, scope

    there = lambda table: os.path.exists(table._written_at.removeprefix("file://"))
    with scope() as held:
        one = materialise(spark.range(3), "one")
        kept = materialise(one, "kept", keep=True)
        with pytest.raises(RuntimeError), scope():
            two = materialise(spark.range(3), "two")
            raise RuntimeError
        assert held == [one] and there(one) and not there(two)
    assert not there(one) and there(kept) and kept.count() == 3
