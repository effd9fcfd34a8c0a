"""What the operators share: scratch tables in the cluster's shared folder, size-checked broadcasts, Arrow slices."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from siteaudit.sources.scratch import cut, scratch, small  # noqa: F401  the operators' own names for them

#: White space of the contracts: space and the ASCII controls 9 to 13.
SPACES = "[\\x20\\x09-\\x0D]+"


def text_of(col: str | Column) -> Column:
    """A null text counts as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256, chars: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that what a Python worker holds doesn't follow Spark's batch size or a few long texts."""
    for batch in batches:
        step = max(1, min(rows, math.ceil(chars * batch.num_rows / max(1, batch.nbytes))))
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)


def words_pattern() -> re.Pattern:
    """Letters and digits of any script, as one word."""
    return re.compile(r"[^\W_]+")
