"""Bit tables of fixed size which keep rows out of an exchange.

A join of whole texts with a few keys would shuffle all texts.  Here the keys are marked in a
bit table, and rows whose bit is not set go on where they are: they surely have no partner.
Only the others are shuffled and decided exactly.  With very many keys the table fills and
sifts less; results never depend on it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 26  # 8 MB


def _place(key: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key), 64 - BITS)


def likely(keys: DataFrame, column: str, key: Column) -> Column:
    """Condition on other rows: may their ``key`` be one of ``keys[column]``?  Both must have
    the same type; a null is a key like others."""
    place = _place(F.col(column))
    words = keys.select(F.shiftright(place, 6).alias("word"), F.expr("1L").alias("one"), place.bitwiseAND(63).cast("int").alias("at"))
    found = words.groupBy("word").agg(F.bit_or(F.expr("shiftleft(one, at)")).alias("bits")).toPandas()  # at most 2 ^ 20 rows
    table = np.zeros(1 << (BITS - 6), np.uint64)
    table[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).view(np.uint64)
    shared = keys.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def is_set(places: pd.Series) -> pd.Series:
        at = places.to_numpy(np.int64)
        return pd.Series((shared.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0)

    return is_set(_place(key))
