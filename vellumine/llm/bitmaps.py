"""Bitmaps of bounded size put together by executors and sent to all of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BLOCK_BITS = 16


def gathered(positions: DataFrame, rows: int, bits: int) -> list[np.ndarray]:
    """A packed bitmap of ``2**bits`` bits for each row, from (row, bit); bit 0 is a byte's highest.

    Executors pack 8 KB blocks, so the driver gets the bitmaps' own size and never the positions.
    """
    bits = max(bits, _BLOCK_BITS)

    def pack(table: pa.Table) -> pa.Table:
        block = np.zeros(1 << _BLOCK_BITS, bool)
        block[table.column("at").to_numpy()] = True
        return pa.table({"row": table.column("row")[:1], "block": table.column("block")[:1], "bytes": pa.array([np.packbits(block).tobytes()], pa.binary())})

    placed = positions.select("row", F.shiftright("bit", _BLOCK_BITS).cast("int").alias("block"), F.col("bit").bitwiseAND(F.lit((1 << _BLOCK_BITS) - 1)).cast("int").alias("at")).distinct()
    out = [np.zeros(1 << (bits - 3), np.uint8) for _ in range(rows)]
    size = 1 << (_BLOCK_BITS - 3)
    for r in placed.groupBy("row", "block").applyInArrow(pack, "row int, block int, bytes binary").toLocalIterator():
        out[r["row"]][r["block"] * size : (r["block"] + 1) * size] = np.frombuffer(r["bytes"], np.uint8)
    return out


def has(bitmap: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """Whether each bit (uint64) is set."""
    return ((bitmap[(bit >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (bit & np.uint64(7)).astype(np.uint8))) & 1).astype(bool)
