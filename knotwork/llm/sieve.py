"""A filter of bounded size that holds many 64-bit names, to send only rows that may be wanted.

It has ``SIEVE`` bits whatever the input, so it can be broadcast. A name that was put in always
passes; others pass by chance, which costs traffic and no result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIEVE = 1 << 26
_PAGE = SIEVE >> 10


def sieve(bits: DataFrame) -> np.ndarray:
    """Packed bits of ``bits(bit)``, names modulo ``SIEVE``; put together in pages on the executors."""

    def pack(table: pa.Table) -> pa.Table:
        page = np.zeros(_PAGE, np.uint8)
        page[table.column("bit").to_numpy() % _PAGE] = 1
        return pa.table([pa.array([table.column("page")[0].as_py()], pa.int32()), pa.array([np.packbits(page).tobytes()], pa.binary())], names=["page", "bits"])

    paged = bits.distinct().withColumn("page", F.floor(F.col("bit") / _PAGE).cast("int"))
    out = np.zeros(SIEVE // 8, np.uint8)
    # 8 MB in one job; an iterator would run a job for every partition
    for r in paged.groupBy("page").applyInArrow(pack, "page int, bits binary").collect():
        out[r.page * (_PAGE // 8) : (r.page + 1) * (_PAGE // 8)] = np.frombuffer(r.bits, np.uint8)
    return out


def passes(filter_: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Which of some uint64 names the filter lets pass."""
    at = (names % np.uint64(SIEVE)).astype(np.int64)
    return (filter_[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
