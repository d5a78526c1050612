"""BPE encoding and decoding with a table of distinct words (operator 4).

Spark splits a text into words with the tokenizer's own pattern (``regexp_extract_all`` in the JVM). Each task
keeps a distinct-word table: Arrow's dictionary encoding numbers the words of a batch, each word that the table
lacks is encoded once, and the ids are joined back by position. Decoding is a join of ids with the
id-to-piece table, by position again.

The table is kept per task and emptied beyond ``TABLE_WORDS`` words, and batches are cut by bytes, so memory is bounded. One
table for the corpus would have to move every occurrence of a word twice; the README has the figures.

Null texts count as empty and give no ids. A special token's string inside a text is that special token, as the
tokenizers library reads it; files whose added tokens strip or need word boundaries are refused. Rows repeat as often as they came; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import cuts

#: Words that a task's table holds at most before it is emptied.
TABLE_WORDS = 1 << 17
#: Bytes of words that are encoded at once; a longer text is encoded alone.
SLICE_BYTES = 1 << 20

#: White space as Unicode has it, spelt out because Java's \s means ASCII only.
_WS = r"\t-\r\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: The byte-level pretokenizer's pattern. Fixed value.
WORD = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


def _spec(path: str) -> dict:
    """The tokenizer file, refused if its method isn't the one of this module."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec["pre_tokenizer"] or {}
    if spec["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
        raise ValueError("a byte-level BPE without normalizer and prefix space is needed")
    odd = [t["content"] for t in spec.get("added_tokens") or [] if any(t.get(k) for k in ("lstrip", "rstrip", "single_word", "normalized"))]
    if odd:
        raise ValueError(f"added tokens that strip, normalize or need word boundaries aren't supported: {odd}")
    return spec


@lru_cache(maxsize=2)
def special_tokens(path: str) -> tuple[str, ...]:
    """All that the driver needs of the file; tables of its vocabulary are only made in the workers."""
    return tuple(t["content"] for t in _spec(path).get("added_tokens") or [])


class Vocabulary:
    """A byte-level BPE read from a tokenizers JSON file: ids of a word, and the bytes of an id."""

    def __init__(self, path: str):
        spec = _spec(path)
        model = spec["model"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.chars = byte_chars()
        back = {c: b for b, c in enumerate(self.chars)}
        vocab = {k: v for k, v in model["vocab"].items() if k not in self.special}
        ranks = {bytes(back[c] for c in k): v for k, v in vocab.items()}
        self.pieces: list[bytes] = [b""] * (max([*model["vocab"].values(), *self.special.values()]) + 1)
        for k, v in ranks.items():
            self.pieces[v] = k
        for k, v in self.special.items():
            self.pieces[v] = k.encode()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        merged = [vocab[a + b] for a, b in pairs]
        if merged == sorted(merged) and len(ranks) == 256 + len(set(merged)):
            import tiktoken

            core = tiktoken.Encoding("own", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe
            self.encode_word = core.encode_single_piece
        else:  # merge order isn't id order
            from tokenizers import Tokenizer

            own = Tokenizer.from_file(path).model
            self.encode_word = lambda word: [t.id for t in own.tokenize("".join(self.chars[b] for b in word))]
        self.piece_column = pa.array(self.pieces, pa.large_binary())
        self.number_column = pa.array([b"%d," % i for i in range(len(self.pieces))], pa.large_binary())


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def words_of(text: Column, special: list[str]) -> Column:
    """The words of a text in order; special tokens are words of their own."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    found = lambda s: F.regexp_extract_all(s, F.lit(WORD), F.lit(0))
    if not special:
        return found(text)
    if len(special) > 1:
        raise ValueError("one special token at most")
    parts = F.split(text, re.escape(special[0]), -1)
    whole = F.transform(parts, lambda s, i: F.when(i == 0, found(s)).otherwise(F.concat(F.array(F.lit(special[0])), found(s))))
    return F.when(F.contains(text, F.lit(special[0])), F.flatten(whole)).otherwise(found(text))


class Table:
    """Distinct words and their ids, all ids in one array."""

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.at, self.ids, self.ends = vocab, {}, array("i"), array("q", [0])
        for word, i in vocab.special.items():
            self._add(word, [i])

    def _add(self, word: str, ids: list[int]) -> int:
        self.at[word] = n = len(self.ends) - 1
        self.ids.extend(ids)
        self.ends.append(len(self.ids))
        return n

    def places(self, words: list[str]) -> np.ndarray:
        """Where each word stands in the table; words that it lacks are encoded once."""
        at, encode_word = self.at, self.vocab.encode_word
        return np.fromiter((at[w] if w in at else self._add(w, encode_word(w.encode())) for w in words), np.int64, len(words))

    def encode(self, words: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of lists of words on end, and where each list's ids end (with a leading zero)."""
        bounds = words.offsets.to_numpy()
        coded = words.flatten().dictionary_encode()
        places = self.places(coded.dictionary.to_pylist())
        ends = np.frombuffer(self.ends, np.int64)
        starts, counts = ends[places], ends[places + 1] - ends[places]
        at = coded.indices.to_numpy()
        n = counts[at]
        after = np.concatenate([[0], np.cumsum(n)])
        source = np.repeat(starts[at] - after[:-1], n) + np.arange(after[-1])
        return np.frombuffer(self.ids, np.int32)[source], after[bounds - bounds[0]]


def _joined(column: pa.Array, ids: np.ndarray, bounds: np.ndarray) -> Iterator[bytes]:
    """The entries of ``column`` at the ids between each two bounds, on end."""
    taken = column.take(pa.array(ids))
    ends = np.frombuffer(taken.buffers()[1], np.int64)[: len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
    raw = memoryview(taken.buffers()[2] or b"") if len(ids) else memoryview(b"")
    for s, e in zip(ends[bounds[:-1]].tolist(), ends[bounds[1:]].tolist(), strict=True):
        yield bytes(raw[s:e])


def _digests(vocab: Vocabulary, ids: np.ndarray, bounds: np.ndarray) -> tuple[pa.Array, pa.Array, list[str]]:
    """For each text: how many ids, the digest of their decimal numbers, and what they decode to."""
    digests = [hashlib.sha256(raw[:-1]).hexdigest() for raw in _joined(vocab.number_column, ids, bounds)]
    texts = [raw.decode("utf-8", "replace") for raw in _joined(vocab.piece_column, ids, bounds)]
    return pa.array(np.diff(bounds), pa.int64()), pa.array(digests, pa.string()), texts


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Pieces of (id, words) of about SLICE_BYTES."""
    words = batch.column(1)
    inner = words.values
    ends = np.frombuffer(inner.buffers()[1], np.int32)[inner.offset : inner.offset + len(inner) + 1].astype(np.int64) if len(inner) else np.zeros(1, np.int64)
    sizes = np.diff(ends[words.offsets.to_numpy()])
    for start, end in cuts(sizes, SLICE_BYTES):
        yield batch.slice(start, end - start)


def _worded(df: DataFrame, path: str, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), words_of(F.col(text_col), list(special_tokens(path))).alias("words"))


def _encoded(it: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(row ids, token ids, bounds) of every slice; the table lives as long as the task."""
    table = Table(vocabulary(path))
    for batch in it:
        for part in _slices(batch):
            yield part.column(0), *table.encode(part.column(1))
            if len(table.at) > TABLE_WORDS:
                table = Table(vocabulary(path))


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) for every row of ``df``, as ``Tokenizer.encode(text, add_special_tokens=False)``."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, ids, bounds in _encoded(it, path):
            if bounds[-1] >= 1 << 31:
                raise ValueError("over two billion ids in one text")
            yield pa.RecordBatch.from_arrays([rows, pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))], ["id", "ids"])

    rows = _worded(df, path, id_col, text_col)
    return rows.mapInArrow(run, f"id {dict(df.dtypes)[id_col]}, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, n_tokens, ids_sha256, text) for every row of ids: pieces are joined to ids by position."""
    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            lists = batch.column(1)
            ends = lists.offsets.to_numpy().astype(np.int64)
            flat = lists.values.to_numpy()
            for start, end in cuts(np.diff(ends) * 4, SLICE_BYTES):
                own = ends[start : end + 1]
                count, digest, texts = _digests(vocabulary(path), flat[own[0] : own[-1]], own - own[0])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), count, digest, pa.array(texts, pa.string())], ["id", "n_tokens", "ids_sha256", "text"])

    return rows.mapInArrow(run, f"id {dict(encoded.dtypes)[id_col]}, n_tokens long, ids_sha256 string, text string").withColumnRenamed("id", id_col)


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): ``encode`` and then ``decode`` in one worker, so that ids and texts don't travel."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, ids, bounds in _encoded(it, path):
            count, digest, texts = _digests(vocabulary(path), ids, bounds)
            decoded = pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string())
            yield pa.RecordBatch.from_arrays([rows, count, digest, decoded], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = _worded(df, path, id_col, text_col)
    return rows.mapInArrow(run, f"id {dict(df.dtypes)[id_col]}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
