"""Runs of equal values in sorted Arrow batches."""

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def sorted_runs(batches: Iterator[pa.RecordBatch], columns: Sequence[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Batches cut where one of the sorted columns changes, with the values of those columns."""
    for batch in batches:
        if not batch.num_rows:
            continue
        changed = np.zeros(batch.num_rows - 1, dtype=bool)
        for name in columns:
            column = batch.column(name)
            now, before = column.slice(1), column.slice(0, batch.num_rows - 1)
            changed |= pc.fill_null(pc.not_equal(now, before), False).to_numpy(zero_copy_only=False)
            changed |= now.is_null().to_numpy(zero_copy_only=False) != before.is_null().to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(changed) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield tuple(batch.column(name)[a].as_py() for name in columns), batch.slice(a, b - a)
