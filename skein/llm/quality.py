"""Quality classifier by nearest-neighbour voting (operator 1).

Terms of a text are hashed byte trigrams, trigrams of character classes, and counts of words and word pairs that
repeat. Term frequencies (square root, idf) of a bounded sample of labelled texts give a truncated singular value
decomposition: the latent-semantic space. The labelled vectors are broadcast; every text is projected, its
exact cosine with all of them is computed in blocks, and its nearest ``NEIGHBOURS`` vote with weights that grow
with similarity.

Only the sample is bounded (``MAX_LABELLED`` rows, half of them at most from either label, those with the smallest
hash of their id); whole texts are scored, all of them. Label, language, source and id are no inputs of a score.

Null and empty texts have no terms; they score the share of label 1 among such labelled texts, or else among all. Of neighbours that are
equally near the earlier in the model's order counts. Of a repeated label the smallest counts, null labels don't count.
Without any labelled text every score is 0.5. Rows repeat as often as they came; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import batches

#: Labelled texts that the model holds at most; also the bound of what is broadcast.
MAX_LABELLED = 4096
NEIGHBOURS = 24
RANK = 64
#: A score from here on predicts label 1.
CUT = 0.7

_HASHED = 1024
_CLASSES = 12
_SHAPES = _CLASSES**3
_COUNTS = 4
TERMS = _HASHED + _SHAPES + _COUNTS
#: Weight of each family of terms in a vector.
_FAMILY = np.concatenate([np.full(_HASHED, 0.4), np.full(_SHAPES, 1.0), np.full(_COUNTS, 1.5)]).astype(np.float32)
_BLOCK = 1 << 20
_ROWS = 256


def _tables() -> tuple[np.ndarray, np.ndarray]:
    lower = np.arange(256, dtype=np.uint32)
    lower[65:91] += 32
    kind = np.full(256, 9, np.uint16)
    kind[97:123], kind[65:91], kind[48:58], kind[32] = 0, 1, 2, 3
    for chars, k in ((b"\t\n\r\x0b\x0c", 4), (b".;:", 5), (b",'-", 6), (b"!?", 7), (b"|", 8), (b"\"()[]{}<>", 10)):
        kind[list(chars)] = k
    kind[128:] = 11
    return lower, kind


_LOWER, _KIND = _tables()


def terms(text: str | None) -> np.ndarray:
    """Square roots of the term frequencies of a whole text, each family scaled by its own total."""
    out = np.zeros(TERMS, np.float32)
    raw = (text or "").encode()
    if not raw:
        return out
    data = np.frombuffer(raw, np.uint8)
    hashed, shapes = np.zeros(_HASHED), np.zeros(_SHAPES)
    for at in range(0, len(data), _BLOCK):
        part = data[max(0, at - 2) : at + _BLOCK]
        if len(part) < 3:
            continue
        x, k = _LOWER[part], _KIND[part]
        mixed = ((x[:-2] * np.uint32(961) + x[1:-1] * np.uint32(31) + x[2:]) * np.uint32(2654435761)) >> np.uint32(22)
        hashed += np.bincount(mixed, minlength=_HASHED)
        shapes += np.bincount(k[:-2] * np.uint16(_CLASSES * _CLASSES) + k[1:-1] * np.uint16(_CLASSES) + k[2:], minlength=_SHAPES)
    words = raw.split()
    n = max(1, len(words))
    again = sum(map(bytes.__eq__, words, words[1:]))
    pairs = len(words) - 1 - len(set(zip(words, words[1:], strict=False))) if len(words) > 1 else 0
    out[:_HASHED] = np.sqrt(hashed / max(1, hashed.sum()))
    out[_HASHED : _HASHED + _SHAPES] = np.sqrt(shapes / max(1, shapes.sum()))
    out[-_COUNTS:] = np.sqrt([again / n, pairs / n, raw.count(b"|") / n, 1 / n])
    return out


class Model:
    """Projection, labelled vectors and labels; small and of bounded size. ``own``: the rows may be overwritten."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, own: bool = False):
        self.labels = labels.astype(np.float32)
        alike = self.labels[~rows.any(1)] if len(rows) else self.labels
        self.blank = float((alike if len(alike) else self.labels).mean()) if len(rows) else 0.5
        n = max(1, len(rows))
        self.idf = (np.log((1 + n) / (1 + (rows > 0).sum(0))) + 0.3).astype(np.float32) * _FAMILY
        weighted = np.multiply(rows, self.idf, out=rows if own else None)
        for at in range(0, len(weighted), _ROWS):
            weighted[at : at + _ROWS] = self._unit(weighted[at : at + _ROWS])
        rank = min(RANK, *weighted.shape) if len(rows) else 0
        if rank:
            rng = np.random.default_rng(0)
            basis = weighted.T @ (weighted @ rng.standard_normal((TERMS, rank + 16), np.float32))
            for _ in range(4):
                basis, _ = np.linalg.qr(weighted.T @ (weighted @ basis))
            _, _, right = np.linalg.svd(weighted @ basis, full_matrices=False)
            self.project = (basis @ right.T[:, :rank]).astype(np.float32)
            self.vectors = self._unit(weighted @ self.project)

    @staticmethod
    def _unit(rows: np.ndarray) -> np.ndarray:
        return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """A score for each row of terms; rows without any term score the share of label 1 of their kind."""
        if not len(self.labels):
            return np.full(len(rows), 0.5)
        cosines = self._unit(self._unit(rows * self.idf) @ self.project) @ self.vectors.T
        k = min(NEIGHBOURS, len(self.labels))
        ordered = np.arange(len(self.labels)) * 1e-12 - cosines  # less than cosines differ by, so it only settles ties
        near = np.argpartition(ordered, k - 1, axis=1)[:, :k]
        weights = np.maximum(np.take_along_axis(cosines, near, 1), 1e-6).astype(np.float64) ** 12
        votes = (weights * self.labels[near]).sum(1) / weights.sum(1)
        return np.where(rows.any(1), np.clip(votes, 0, 1), self.blank)


def held_out(id_col: str) -> F.Column:
    """True for the quarter of the ids whose labels are never learnt."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = MAX_LABELLED) -> Model:
    """Learn from at most ``max_labelled`` labelled rows of ``df`` that aren't held out."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).cast("int").alias("_label"))
    present = known.join(df.select(F.col(id_col).alias("_id")), "_id", "left_semi")
    half = max_labelled // 2
    picked = [r for y in (0, 1) for r in present.where(F.col("_label") == y).orderBy(F.xxhash64("_id"), "_id").limit(half).collect()]
    spark = df.sparkSession
    chosen = F.broadcast(spark.createDataFrame([(r["_id"], r["_label"]) for r in picked], "_id long, _label int"))
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).join(chosen, "_id").dropDuplicates(["_id"]).select("_text", "_label")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [terms(t.as_py()).astype(np.float16).tobytes() for t in batch.column(0)]
        return pa.RecordBatch.from_arrays([pa.array(made, pa.binary()), batch.column(1)], ["terms", "label"])

    got = batches(rows, run, "terms binary, label int").toArrow() if picked else None
    if got is None or not got.num_rows:
        return Model(np.empty((0, TERMS), np.float32), np.empty(0))
    # one array of floats is all that the driver holds beside the rows as they came
    found = [np.frombuffer(t.as_buffer(), np.float16) for t in got.column("terms")]
    labels_ = got.column("label").to_numpy()
    order = np.lexsort((*np.array([f[:3] for f in found], np.float32).T, labels_))
    made = np.empty((len(found), TERMS), np.float32)
    for i, n in enumerate(order.tolist()):
        made[i] = found[n]
    del found, got
    return Model(made, labels_[order], own=True)


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) for every row of ``df``."""
    kind = dict(df.dtypes)[id_col]
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    scored = batches(rows, _scorer(df.sparkSession.sparkContext.broadcast(model)), f"id {kind}, score double")
    out = scored.select("id", held_out("id").alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
    return out.withColumnRenamed("id", id_col)


def _scorer(shared, keep: bool = False):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        model, texts = shared.value, batch.column("text" if not keep else "_text")
        found = [np.empty(0)]
        for at in range(0, batch.num_rows, _ROWS):
            found.append(model.scores(np.stack([terms(t.as_py()) for t in texts.slice(at, _ROWS)])))
        scores = pa.array(np.concatenate(found), pa.float64())
        if keep:
            return batch.append_column("_score", scores)
        return pa.RecordBatch.from_arrays([batch.column(0), scores], ["id", "score"])

    return run


def keep_good(df: DataFrame, model: Model, text_col: str = "text", cut: float = CUT) -> DataFrame:
    """The rows of ``df`` that score ``cut`` or more, with all their columns."""
    names = df.columns
    plain = df.toDF(*(f"c{i}" for i in range(len(names))))
    rows = plain.withColumn("_text", F.col(f"c{names.index(text_col)}").cast("string"))
    kinds = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    scored = batches(rows, _scorer(df.sparkSession.sparkContext.broadcast(model), True), f"{kinds}, _score double")
    return scored.where(F.col("_score") >= cut).drop("_text", "_score").toDF(*names)
