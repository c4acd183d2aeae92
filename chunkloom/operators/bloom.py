"""Approximate membership: a Bloom filter over weak hashes, built by an aggregate and tested by joins.

Exact joins need none (Spark makes its own at run time); this one is for filters that are kept with an index.
"""

from __future__ import annotations

from math import ceil, log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkloom.functions.scalars import mixed

HASHES = 7


def bits_for(items: int, rate: float) -> int:
    """-n ln p / ln(2)^2, in whole 64-bit words."""
    return -(-max(64, ceil(-items * log(rate) / log(2) ** 2)) // 64) * 64


def positions(weak: Column, bits: int) -> Column:
    """HASHES bit positions of a weak hash (a long taken as unsigned): (h + i mix(h) + i^2) mod bits in 64-bit arithmetic."""

    @F.pandas_udf("array<long>")
    def places(x: pd.Series) -> pd.Series:
        h = x.to_numpy(np.int64).view(np.uint64)
        with np.errstate(over="ignore"):
            step = mixed(h)
            every = np.column_stack([(h + np.uint64(i) * step + np.uint64(i * i)) % np.uint64(bits) for i in range(HASHES)])
        return pd.Series(list(every.astype(np.int64)))

    return places(weak)


def build(rows: DataFrame, column: str, bits: int) -> DataFrame:
    """(word, value): the filter's words that aren't zero. Bits are or-ed before and after the shuffle, at most bits / 64 rows come out."""
    p = rows.select(F.explode(positions(F.col(column), bits)).alias("p"))
    one = F.expr("shiftleft(1L, cast(p & 63 as int))")
    return p.groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(one).alias("value"))


def maybe(rows: DataFrame, column: str, words: DataFrame, bits: int) -> DataFrame:
    """Adds maybe: false means certainly absent. Different hashes are tested once, by an equi-join of hash and bit, so a filter of any size works; a null hash is absent."""
    key = rows.where(F.col(column).isNotNull()).select(F.col(column).alias("__key")).distinct()
    p = key.select("__key", F.explode(positions(F.col("__key"), bits)).alias("p"))
    j = p.join(words, F.shiftright("p", 6) == F.col("word"), "left")
    hit = F.coalesce(F.expr("(value & shiftleft(1L, cast(p & 63 as int))) <> 0"), F.lit(False))
    every = j.groupBy("__key").agg(F.min(hit).alias("maybe"))
    return rows.join(every, rows[column] == F.col("__key"), "left").withColumn("maybe", F.coalesce("maybe", F.lit(False))).drop("__key")
