"""Suffix arrays, longest common prefixes and longest common subsequences of strings.

The three algorithms have no built-in form, so they run in Arrow-batched UDFs; everything else on arrays is built in.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType, StringType


def suffix_positions(text: str | None) -> np.ndarray:
    """Start of every suffix of the UTF-8 bytes and a final zero byte, in order, by prefix doubling."""
    data = np.frombuffer((text or "").removesuffix("\0").encode() + b"\0", np.uint8)
    n = len(data)
    rank = data.astype(np.int64)
    order = np.argsort(rank, kind="stable")
    step = 1
    while True:
        second = np.full(n, -1, np.int64)
        second[: max(0, n - step)] = rank[step:]
        order = np.lexsort((second, rank))
        a, b = rank[order], second[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum((a[1:] != a[:-1]) | (b[1:] != b[:-1]))])
        rank = new
        step *= 2
        if rank.max() == n - 1 or step >= 2 * n:
            return order


def common_prefixes(text: str | None, suffixes: Sequence[int]) -> list[int]:
    """Length of the common prefix of each suffix with the one before it; 0 for the first."""
    data = (text or "").removesuffix("\0").encode() + b"\0"
    n = len(data)
    place = [0] * n
    for i, s in enumerate(suffixes):
        place[s] = i
    out = [0] * n
    h = 0
    for i in range(n):
        if place[i]:
            j = suffixes[place[i] - 1]
            while i + h < n and j + h < n and data[i + h] == data[j + h]:
                h += 1
            out[place[i]] = h
            h = max(0, h - 1)
        else:
            h = 0
    return out


def _row(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    row = np.zeros(len(b) + 1, np.int64)
    for x in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(b == x, row[:-1] + 1, 0)))
    return row


def longest_common(a: str | None, b: str | None) -> str:
    """One longest common subsequence, in memory linear in the texts (divide and conquer)."""
    x, y = (np.array([ord(c) for c in t or ""], np.int64) for t in (a, b))

    def solve(p: np.ndarray, q: np.ndarray) -> list[int]:
        if not len(p) or not len(q):
            return []
        if len(p) == 1:
            return [int(p[0])] if (q == p[0]).any() else []
        half = len(p) // 2
        cut = int(np.argmax(_row(p[:half], q) + _row(p[half:][::-1], q[::-1])[::-1]))
        return solve(p[:half], q[:cut]) + solve(p[half:], q[cut:])

    return "".join(map(chr, solve(x, y)))


@pandas_udf(ArrayType(IntegerType()))
def suffix_array(text: pd.Series) -> pd.Series:
    return text.map(lambda t: suffix_positions(t).astype(np.int32))


@pandas_udf(ArrayType(IntegerType()))
def lcp_array(text: pd.Series, suffixes: pd.Series) -> pd.Series:
    return pd.Series([common_prefixes(t, s.tolist()) for t, s in zip(text, suffixes, strict=True)])


@pandas_udf(StringType())
def lcs(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([longest_common(x, y) for x, y in zip(a, b, strict=True)], dtype=object)


def suffix_array_file(path: str) -> DataFrame:
    """(text, suffix_array) of a whole file."""
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("text"), suffix_array("value").alias("suffix_array"))


class SArrays:
    """Arrays of whole numbers, one a row, keyed by ``row``."""

    def __init__(self, df: DataFrame, row: str = "row", values: str = "values"):
        self.df = df.select(F.col(row).cast("long").alias("row"), F.col(values).cast("array<long>").alias("values"))

    @classmethod
    def of_strings(cls, df: DataFrame, row: str, text: str) -> SArrays:
        return cls(df.select(F.col(row).alias("row"), suffix_array(text).alias("values")))

    @classmethod
    def attach(cls, name: str) -> SArrays:
        spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
        return cls(spark.table(name))

    def _compared(self, other: SArrays | Sequence[int], test) -> DataFrame:
        if isinstance(other, SArrays):
            right = other.df.toDF("_row", "_values")
            both = self.df.join(right, F.col("row") == F.col("_row"))
            return both.select("row", test(F.col("values"), F.col("_values")).alias("result"))
        return self.df.select("row", test(F.col("values"), F.array(*(F.lit(int(x)) for x in other)).cast("array<long>")).alias("result"))

    def __eq__(self, other) -> DataFrame:  # type: ignore[override]
        """(row, result): element by element with other arrays, or every row with one array."""
        return self._compared(other, lambda a, b: a == b)

    def __ne__(self, other) -> DataFrame:  # type: ignore[override]
        return self._compared(other, lambda a, b: a != b)

    __hash__ = None  # type: ignore[assignment]

    def __getitem__(self, key: int | slice | Sequence[int] | Column) -> SArrays:
        """Rows by number, by slice, by numbers, or by a condition on ``row`` and ``values``."""
        row = F.col("row")
        if isinstance(key, Column):
            return SArrays(self.df.where(key))
        if isinstance(key, slice):
            n = None if (key.start or 0) >= 0 and (key.stop or 0) >= 0 else self.df.count()
            start, stop, step = key.indices(n) if n is not None else (key.start or 0, key.stop if key.stop is not None else (1 << 62), key.step or 1)
            if step < 1:
                raise ValueError("steps must be positive")
            return SArrays(self.df.where((row >= start) & (row < stop) & ((row - start) % step == 0)))
        return SArrays(self.df.where(row.isin([key] if isinstance(key, int) else [int(k) for k in key])))

    def get_lengths(self) -> DataFrame:
        return self.df.select("row", F.size("values").alias("length"))

    def in1d(self, other: SArrays, invert: bool = False) -> DataFrame:
        """(row, result): is the array among those of ``other``?"""
        known = other.df.select(F.col("values").alias("_v")).distinct().withColumn("_in", F.lit(True))
        found = self.df.join(known, F.col("values") == F.col("_v"), "left")
        hit = F.coalesce("_in", F.lit(False))
        return found.select("row", (~hit if invert else hit).alias("result"))

    def save(self, path: str) -> None:
        self.df.write.mode("errorifexists").parquet(path)

    def register(self, name: str) -> None:
        self.df.createOrReplaceTempView(name)

    def unregister(self, name: str) -> None:
        self.df.sparkSession.catalog.dropTempView(name)

    def info(self) -> dict[str, int]:
        r = self.df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("values")).alias("values")).first()
        return {"rows": r["n"], "values": r["values"] or 0}

    def to_list(self) -> list[list[int]]:
        return [list(r["values"]) for r in self.df.orderBy("row").collect()]
