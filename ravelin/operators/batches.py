"""Arrow batches in pieces, for tasks that hand texts to Python."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MOST = 2 << 20


def in_pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = MOST) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in their order, in pieces of ``most`` bytes of the texts in ``column`` and the rest of the last text.

    Spark fills a batch with 10,000 rows, whatever their length. What a task makes of a piece is all that it holds beside the batch.
    """
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        cuts = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // most)) + 1
        for start, end in pairwise([0, *cuts.tolist(), b.num_rows]):
            if end > start:
                yield b.slice(start, end - start)
