"""What a task of a band pass holds of one Arrow batch."""

import numpy as np
import pyarrow as pa

from foliolake.operators import stencil
from foliolake.operators.stencil import group_tables, list_of

ROWS, PAGE_ROWS, WIDTH = 10_000, 50, 64


def batches(cuts, keys=None):
    key = np.arange(ROWS) // PAGE_ROWS if keys is None else keys
    table = pa.table({"page_id": pa.array(key), "y": np.arange(ROWS) % PAGE_ROWS})
    return [table.slice(lo, hi - lo).to_batches()[0] for lo, hi in zip([0, *cuts], [*cuts, ROWS])]


def test_results_of_a_batch_leave_in_portions():
    def widened(groups):  # forty bytes and more for each byte that comes in
        return [pa.table({"y": t.column("y"), "out": list_of(np.zeros((t.num_rows, 5 * WIDTH)), pa.float64())}) for t in groups]

    class Rows:  # the frame that map_groups is called on
        def repartition(self, *_):
            return self

        sortWithinPartitions = repartition

        def mapInArrow(self, run, _):
            return run

    base = pa.total_allocated_bytes()
    rows = most = 0
    for out in stencil.map_groups(Rows(), ["page_id"], ["y"], widened, "")(iter(batches([]))):
        rows, most = rows + out.num_rows, max(most, pa.total_allocated_bytes() - base)
    assert rows == ROWS and most < 8 << 20  # all of them at once are 25 MB


def test_groups_over_batches():
    for cuts in ([1, 49, 50, 51, 4000, 4010, 4020, 9999], [50, 100], []):
        groups = [t for ts in group_tables(iter(batches(cuts)), ["page_id"]) for t in ts]
        assert [t.num_rows for t in groups] == [PAGE_ROWS] * (ROWS // PAGE_ROWS)
        assert all((t.column("y").to_numpy() == np.arange(PAGE_ROWS)).all() for t in groups)
    nulls = pa.array([None] * 70 + [7] * (ROWS - 70), pa.int64())
    groups = [t for ts in group_tables(iter(batches([30, 70, 100], nulls)), ["page_id"]) for t in ts]
    assert [t.num_rows for t in groups] == [70, ROWS - 70]
    assert list(group_tables(iter([]), ["page_id"])) == []


def test_a_group_is_not_copied_with_its_batch():
    whole, after = batches([5010])
    base = pa.total_allocated_bytes()
    groups = group_tables(iter([whole, after]), ["page_id"])
    next(groups)
    assert sum(t.num_rows for t in next(groups)) == ROWS - 5010 - PAGE_ROWS + 10 and pa.total_allocated_bytes() - base < 16_000
