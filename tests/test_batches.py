import pyarrow as pa
import pytest

from seqloom.functions.batches import bounded, pieces


@pytest.mark.parametrize("sizes", [[], [5], [1] * 1000, [10] * 99 + [50_000] + [10] * 99, [30_000] * 7])
def test_pieces_keep_order_and_bounds(sizes):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(sizes)), pa.int64()), pa.array(["x" * n for n in sizes], pa.string())], ["a", "b"])
    found = list(pieces(batch, 64, 40_000))
    assert [x for p in found for x in p.column(0).to_pylist()] == list(range(len(sizes))) and found[0].schema == batch.schema
    assert all(p.num_rows <= 64 and (p.num_rows == 1 or p.nbytes <= 40_000) for p in found if p.num_rows)
    seen = list(bounded(lambda batches: (b.slice(0, 1) for b in batches), 64, 40_000)(iter([batch, batch])))
    assert len(seen) == 2 * len(found)
