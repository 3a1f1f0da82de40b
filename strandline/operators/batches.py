"""Arrow batches of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of texts that Python takes at once, unless one text has more, and rows.
BYTES, ROWS = 4 << 20, 512


def by_bytes(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of a piece have at most so many bytes; a larger text is a piece of its own."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            stop = max(at + 1, min(at + ROWS, int(np.searchsorted(ends, before + BYTES, "right"))))
            yield batch.slice(at, stop - at)
            at = stop
