"""Arrow batches in slices, so that long texts do not pile up in a Python worker."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Rows worked on at a time, whatever batch size the session has.
ROWS = 500


def sliced(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most so many rows; an empty batch is passed on."""
    for batch in batches:
        for at in range(0, max(batch.num_rows, 1), rows):
            yield batch.slice(at, rows)
