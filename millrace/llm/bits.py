"""Sets of 64-bit keys in a bitmap of fixed size: what isn't in the set may be let through, nothing that is in it is lost."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 25


def set_in(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    low = key & np.uint64((1 << BITS) - 1)
    return (bits[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63))) & np.uint64(1) > 0


def bitmap(keys: DataFrame, bits: int = BITS) -> np.ndarray:
    """A set of the keys' low bits: 2 ** (bits - 3) bytes at any size of the input."""
    rows = keys.select((F.col("key").bitwiseAND((1 << bits) - 1)).alias("low")).groupBy(F.shiftright("low", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(low & 63 as int))")).alias("set")).toPandas()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[rows["at"].to_numpy()] = rows["set"].to_numpy()
    return out.view(np.uint64)


def having(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows whose key may be among the keys (key): a filter before a join, so that the join moves little."""
    shared = rows.sparkSession.sparkContext.broadcast(bitmap(keys).tobytes())
    at = rows.columns.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint64)
        for batch in batches:
            yield batch.filter(pa.array(set_in(bits, batch.column(at).to_numpy().view(np.uint64))))

    return rows.mapInArrow(run, rows.schema)
