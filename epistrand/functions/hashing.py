"""FNV-1a, 64 bit, as a column: the public-domain hash of Fowler, Noll and Vo, for ids that other tools compute too."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The offset basis and the prime of the 64-bit variant.
OFFSET, PRIME = 14695981039346656037, 1099511628211


def fnv1a_64(data: list[bytes]) -> np.ndarray:
    """Hashes of byte strings, octet by octet over all of them at once."""
    sizes = np.fromiter(map(len, data), np.int64, len(data))
    order = np.argsort(-sizes, kind="stable")
    h = np.full(len(data), OFFSET, np.uint64)
    flat = np.frombuffer(b"".join(data), np.uint8).astype(np.uint64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(data) else sizes
    longest = int(sizes.max()) if len(data) else 0
    for i in range(longest):
        live = order[: np.searchsorted(-sizes[order], -i, "left")]  # those longer than i
        h[live] = (h[live] ^ flat[starts[live] + i]) * np.uint64(PRIME)
    return h


@F.pandas_udf(StringType())
def fnv1a_hex(data: pd.Series) -> pd.Series:
    """16 upper-case hex digits of the hash of a binary column; null stays null."""
    out = pd.Series([None] * len(data), dtype=object)
    there = np.flatnonzero(data.notna().to_numpy())
    if len(there):
        out.iloc[there] = [f"{int(x):016X}" for x in fnv1a_64([bytes(v) for v in data.iloc[there]])]
    return out


def site_bytes(pos: Column, code: Column) -> Column:
    """Hex of a site as pattern ids take it: the position in four bytes, little end first, and the code of its context character."""
    h = F.lpad(F.hex(pos.cast("long")), 8, "0")
    little = F.concat(*[F.substring(h, i, 2) for i in (7, 5, 3, 1)])
    index = F.shiftright(F.ascii(code) + 2, 2).bitwiseAND(15)
    return F.concat(little, F.lpad(F.hex(index.cast("long")), 2, "0"))
