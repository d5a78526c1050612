"""SimHash near-duplicates by anchor-point covering (operator 9).

A text is lower-cased in A-Z and cut at ``[\\x20\\x09-\\x0D]+``; its shingles are three words, repeats included
(with fewer words: all of them; with none: fingerprint zero). A bit of the 64-bit fingerprint is set if it is
set in over half of the shingles' XXH64 hashes (seed 42).

Anchors are the product of two binary Golay codes over bits 0-22 and 23-45. Each Golay code is perfect with
covering radius 3, so a fingerprint has exactly one home anchor, within 3 bits in either half. A fingerprint at
most ``threshold`` bits from it then lies within 3 + a and 3 + b bits of that anchor, a + b <= threshold. Every
distinct fingerprint is therefore replicated to all anchors within covering radius plus threshold (61 on average
for two bits), meets the homes of each, and is compared there over all 64 bits. No pair is missed, each pair is
met once, and an anchor holds a 2^22-th of random fingerprints. Copies share a fingerprint and are compared once.

Null texts count as empty. Rows with a null id keep a fingerprint; their component is that of their class (null if no
row of it has an id). Rows repeat as often as they came; other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import batches
from skein.plans.components import star_components
from skein.session import materialize

#: Shingles that are counted at a time; bounds the memory for one very long text.
BLOCK = 1 << 16
#: Generator polynomial of the binary Golay code. Fixed value.
GOLAY = 0xC75
RADIUS = 3


def fingerprint(text: str | None, size: int = 3, seed: int = 42) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    starts = ends - lens
    k = min(size, len(words))
    n = len(words) - k + 1
    starts, ends = starts[:n], ends[k - 1 :]
    totals = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, BLOCK):
        hashes = np.array([digest(joined[s:e], seed) for s, e in zip(starts[at : at + BLOCK].tolist(), ends[at : at + BLOCK].tolist(), strict=True)], dtype="<u8")
        totals += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(totals * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) for every row; ``fp`` is the fingerprint as a signed long."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t.as_py()) for t in batch.column(1)], dtype=np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["id", "fp"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return batches(rows, run, "id long, fp long")


@cache
def _patterns() -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """By syndrome: bit patterns of up to 5 bits, light ones first; and how many have at most 3, 4 and 5 bits."""
    weights = range(RADIUS + 3)
    words = np.array([sum(1 << b for b in c) for w in weights for c in combinations(range(23), w)], np.int64)
    weight = np.array([w for w in weights for _ in combinations(range(23), w)])
    syndromes = _syndrome(words)
    order = np.lexsort((weight, syndromes))
    words, weight, syndromes = words[order], weight[order], syndromes[order]
    first = np.searchsorted(syndromes, np.arange(2048))
    upto = {w: np.bincount(syndromes[weight <= w], minlength=2048) for w in (3, 4, 5)}
    return words, {w: (first, n) for w, n in upto.items()}


def _syndrome(words: np.ndarray) -> np.ndarray:
    rest = words.astype(np.int64).copy()
    for bit in range(22, 10, -1):
        rest ^= ((rest >> bit) & 1) * (GOLAY << (bit - 11))
    return rest


def _near(half: np.ndarray, weight: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, codeword) for the codewords within ``weight`` bits of each 23-bit value."""
    words, by = _patterns()
    first, count = by[weight]
    s = _syndrome(half)
    n = count[s]
    row = np.repeat(np.arange(len(half)), n)
    at = np.repeat(first[s] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return row, half[row] ^ words[at]


def _product(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], rows: int) -> tuple[np.ndarray, np.ndarray]:
    """All combinations, row by row, of two lists that are sorted by row."""
    na, nb = np.bincount(a[0], minlength=rows), np.bincount(b[0], minlength=rows)
    first = np.cumsum(nb) - nb
    times = nb[a[0]]
    left = np.repeat(np.arange(len(a[0])), times)
    right = np.repeat(first[a[0]] - (np.cumsum(times) - times), times) + np.arange(times.sum())
    return a[0][left], a[1][left] | (b[1][right] << 23)


def anchors(fps: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor): the home anchors for reach 0, else all anchors within covering radius plus ``reach``."""
    low, high = fps & 0x7FFFFF, (fps >> 23) & 0x7FFFFF
    found = [_product(_near(low, RADIUS + x), _near(high, RADIUS + reach - x), len(fps)) for x in range(reach + 1)]
    both = np.unique(np.stack([np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])], 1), axis=0) if reach else np.stack(found[0], 1)
    return both[:, 0], both[:, 1]


def _placed(fps: DataFrame, reach: int, name: str) -> DataFrame:
    def run(batch: pa.RecordBatch):
        values = batch.column(0).to_numpy()
        for at in range(0, len(values), 4096):
            part = values[at : at + 4096]
            row, anchor = anchors(part, reach)
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(part[row])], ["anchor", name])

    # the table of classes may be one file, and each row becomes dozens: spread it over the cluster first
    spread = fps.select("fp").repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    return batches(spread, run, f"anchor long, {name} long")


def links(fps: DataFrame, threshold: int = 2) -> DataFrame:
    """(a, b) with a < b for every pair of distinct fingerprints that differ in 1 to ``threshold`` bits (0 to 2)."""
    if not 0 <= threshold <= 2:
        raise ValueError("the patterns cover thresholds from 0 to 2")
    homes = _placed(fps, 0, "a")
    around = _placed(fps, threshold, "b")
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold)
    # merged, never broadcast: Spark takes a table of anchors for as small as the fingerprints, of which it has dozens of rows each
    return homes.hint("merge").join(around.hint("merge"), (homes["anchor"] == around["anchor"]) & near).select("a", "b")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 2) -> DataFrame:
    """(id, fingerprint, component_id) for every row; a component is what links of ``threshold`` bits connect."""
    marked = materialize(fingerprints(df, id_col, text_col), "fingerprints")
    classes = materialize(marked.groupBy("fp").agg(F.min("id").alias("least")), "classes")
    roots = star_components(links(classes, threshold), "a", "b")
    rooted = classes.join(roots, F.col("fp") == F.col("id"), "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    rooted = materialize(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "of")
    known = rooted.join(least, F.col("root") == F.col("of")).select(F.col("fp").alias("key"), "component_id")
    out = marked.join(known, F.col("fp") == F.col("key"), "left")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 2) -> DataFrame:
    """The rows of ``df`` whose id is the smallest of their near-duplicate component; rows without an id stay."""
    found = near_duplicates(df, id_col, text_col, threshold)
    away = found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("_away")).distinct()
    return df.join(away, df[id_col] == F.col("_away"), "left_anti")
