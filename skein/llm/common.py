"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def batches(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Apply ``f`` to each Arrow batch of ``df``; ``f`` is made once per task by calling ``f()`` if it is a factory."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out = f(batch)
            if isinstance(out, pa.RecordBatch):
                yield out
            else:
                yield from out

    return df.mapInArrow(run, schema)


def cuts(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Cut rows of the given sizes into runs (start, end) of about ``most`` in total; a larger row stands alone."""
    start = total = 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > most:
            yield start, i
            start = i
            total = 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def whole_groups(it: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, list[int]]]:
    """From batches sorted by ``keys``: tables of whole groups, and the rows at which their groups begin (and the end).

    Only the group that may go on in the next batch is held back.
    """
    held: list[pa.RecordBatch] = []
    for batch in it:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_pylist() for k in keys]
        rows = list(zip(*columns, strict=True))
        cut = len(rows)
        while cut and rows[cut - 1] == rows[-1]:
            cut -= 1
        if held and tuple(held[-1].column(k)[-1].as_py() for k in keys) != rows[0]:
            yield _begun(held, keys)
            held = []
        if cut:
            yield _begun([*held, batch.slice(0, cut)], keys)
            held = []
        held.append(batch.slice(cut))
    if held:
        yield _begun(held, keys)


def _begun(batches_: list[pa.RecordBatch], keys: list[str]) -> tuple[pa.Table, list[int]]:
    table_ = pa.Table.from_batches(batches_).combine_chunks()
    rows = list(zip(*(table_.column(k).to_pylist() for k in keys), strict=True))
    return table_, [i for i in range(len(rows)) if not i or rows[i] != rows[i - 1]] + [len(rows)]
