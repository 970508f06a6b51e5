"""Shared helpers: table access, lineage cuts in the cluster's shared folder, word rules."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.lineage import cut, scratch, shared_dir

__all__ = ["SPACES", "WORD", "IdFilter", "cut", "lookup", "masked", "n_words", "scratch", "shared_dir", "slices", "table", "unmasked"]

#: The six ASCII white-space characters that separate words. bytes.split() splits at exactly these.
SPACES = " \t\n\x0b\x0c\r"
#: Java pattern of a word.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def masked(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with its columns renamed by place, so that none can clash with working columns, and
    the new name of each."""
    names = {n: f"_c{i}" for i, n in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def unmasked(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.select(*(F.col(new).alias(old) for old, new in names.items()))


def lookup(df: DataFrame, most_rows: int = 10_000) -> DataFrame:
    """A broadcast hint if df has at most most_rows rows, else df itself: the join is then a
    sort-merge join whose skewed partitions adaptive execution splits. df must be cheap to count."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def n_words(text: Column) -> Column:
    """Number of words; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def slices(batch: pa.RecordBatch, *names: str, most_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose columns names hold about most_bytes together (one row at
    least), so that what Python makes of them at a time is bounded by bytes, not by rows."""
    sizes = np.zeros(batch.num_rows, np.int64)
    for n in names:
        sizes += pc.fill_null(pc.binary_length(batch.column(n)), 0).to_numpy(zero_copy_only=False)
    ends = np.flatnonzero(np.diff(np.cumsum(sizes) // most_bytes)) + 1
    at = 0
    for end in [*ends.tolist(), batch.num_rows]:
        if end > at:
            yield batch.slice(at, end - at)
        at = end
    pa.default_memory_pool().release_unused()


class IdFilter:
    """A Bloom filter of the ids of a DataFrame, of a fixed size at any number of ids: each task
    sends the words of bits it sets, and the 2**bits bits are what is broadcast. Rows that it
    lets through must still be joined; the more ids, the more of those are in vain."""

    def __init__(self, ids: DataFrame, *names: str, bits: int = 26):
        self.names, self.mask = names, (1 << bits) - 1
        place = F.explode(F.array(*(F.shiftright(F.xxhash64(*names), 32 * k).bitwiseAND(F.lit(self.mask)) for k in (0, 1))))
        words = ids.select(place.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("held"))
        table = np.zeros(1 << (bits - 6), np.int64)
        found = words.toArrow()
        table[found.column("word").to_numpy()] = found.column("held").to_numpy()
        self.table = ids.sparkSession.sparkContext.broadcast(table)

    def __call__(self) -> Column:
        """A condition on the columns names: false means that no id is the row's."""
        table, mask = self.table, self.mask

        @F.pandas_udf("boolean")
        def held(h: pd.Series) -> pd.Series:
            x, out = h.to_numpy(np.int64), np.ones(len(h), bool)
            for at in (x & mask, (x >> 32) & mask):
                out &= (table.value[at >> 6] >> (at & 63)) & 1 == 1
            return pd.Series(out)

        return held(F.xxhash64(*self.names))
