"""Arrow functions that take a few rows at a time.

Spark hands a worker batches of ten thousand rows; what an Arrow function makes of a batch is taken from parts of it, so
that a worker's memory doesn't grow with the rows of its task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows, and bytes of text beyond the first row, in a part.
ROWS, BYTES = 256, 2_000_000


def cuts(column: pa.Array) -> Iterator[tuple[int, int]]:
    """(start, length) of the parts of a column of texts or bytes."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0))
    at = 0
    while at < len(sizes):
        n = max(1, int(np.searchsorted(np.cumsum(sizes[at : at + ROWS]), BYTES, "right")))
        yield at, n
        at += n


def in_parts(run: Callable[[list], list], kind: T.DataType):
    """A function of a column from one of a list of its values."""
    from pyspark.sql.pandas.types import to_arrow_type

    made = to_arrow_type(kind)

    @F.arrow_udf(kind)
    def column(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for at, n in cuts(batch):
                yield pa.array(run(batch.slice(at, n).to_pylist()), made)

    return column
