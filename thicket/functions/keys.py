"""Keys of records and references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any sort that may surround a key.
_EDGE = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def key(col: Column | str) -> Column:
    """Keys are equal after trimming white space and ignoring letter case; blank is null."""
    c = F.col(col) if isinstance(col, str) else col
    k = F.lower(F.regexp_replace(c, _EDGE, ""))
    return F.when(k != "", k)
