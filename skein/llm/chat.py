"""Chat formatting by columnar byte assembly (operator 8).

Each turn becomes ``<|im_start|>role\\ntext<|im_end|>\\n``. For a batch of turns, sorted by conversation, the lengths
of header, text and tail are taken from Arrow's offsets, cumulated to the place of each segment in the output, and
turned into scatter indices with numpy; header and text bytes are then copied into one preallocated buffer, which
becomes an Arrow string array without another copy. Indices are made for ``SCATTER_BYTES`` at a time and conversations are formatted
``GROUP_BYTES`` at a time, so that memory beyond the texts is bounded. The loss mask is the list of (start, end) in code points
of the assistant's texts.

Control strings inside roles and texts get a backslash after their first character, and backslashes are doubled; a
line feed in a role is written as backslash and n. ``parse`` undoes this, so every text comes back unchanged.

Null texts and roles count as empty. Turns are ordered by turn (null first), then role and text; repeated rows repeat
a turn. Rows with a null conversation id form one conversation. A conversation is one output value, so its turns
meet in one task, streamed in Arrow batches; one over ``MOST_BYTES``, more than a string can hold, is an error that names it. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import cuts

#: Bytes that get scatter indices at once; of conversations that are formatted at once; of one formatted conversation at most.
SCATTER_BYTES, GROUP_BYTES, MOST_BYTES = 1 << 20, 32 << 20, (1 << 31) - 1
#: Strings that mark turns here or in other common templates. Fixed values.
CONTROLS = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
START, END = "<|im_start|>", "<|im_end|>"
LEARNT = "assistant"

_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)
_SCHEMA = "conv_id long, n_turns long, formatted string, loss array<struct<start:long,end:long>>"
_ARROW = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def escape(texts: pa.Array) -> pa.Array:
    """Escape control strings and backslashes in a whole string array."""
    texts = pc.replace_substring(texts, "\\", "\\\\")
    for c in CONTROLS:
        texts = pc.replace_substring(texts, c, f"{c[0]}\\{c[1:]}")
    return texts


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def unescape_role(role: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], role)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    return [(unescape_role(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def _bytes(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array on end, and the length of each string."""
    ends = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + len(strings) + 1]
    data = strings.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and len(strings) else np.empty(0, np.uint8)
    return raw, np.diff(ends).astype(np.int64)


def _scatter(out: np.ndarray, raw: np.ndarray, lengths: np.ndarray, to: np.ndarray) -> None:
    """Copy segments of ``raw`` to the places ``to`` of ``out``."""
    ends = np.cumsum(lengths)
    for i, j in cuts(lengths, SCATTER_BYTES):
        first, end = int(ends[i] - lengths[i]), int(ends[j - 1])
        if j == i + 1:
            out[to[i] : to[i] + lengths[i]] = raw[first:end]
        else:
            out[np.repeat(to[i:j] - (ends[i:j] - lengths[i:j]), lengths[i:j]) + np.arange(first, end)] = raw[first:end]


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One buffer with all turns; bytes per turn; and in code points per turn, its length and where its text starts."""
    roles = pc.replace_substring(escape(pc.fill_null(roles, "")), "\n", "\\n")
    texts = escape(pc.fill_null(texts, ""))
    head = pc.binary_join_element_wise(START, roles, "\n", "")
    n = len(texts)
    raw_head, head_len = _bytes(head)
    raw_text, text_len = _bytes(texts)
    tail = np.frombuffer(f"{END}\n".encode(), np.uint8)
    turn_len = head_len + text_len + len(tail)
    at = np.cumsum(turn_len) - turn_len
    out = np.empty(int(turn_len.sum()), np.uint8)
    _scatter(out, raw_head, head_len, at)
    _scatter(out, raw_text, text_len, at + head_len)
    _scatter(out, np.tile(tail, n), np.full(n, len(tail), np.int64), at + head_len + text_len)
    head_chars = pc.utf8_length(head).to_numpy(zero_copy_only=False).astype(np.int64)
    text_chars = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    return out, turn_len, head_chars + text_chars + len(tail), head_chars


def _starts(ids: pa.Array) -> np.ndarray:
    """The rows at which a conversation begins, and the number of rows."""
    change = np.ones(len(ids) + 1, bool)
    values, null = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False), pc.is_null(ids).to_numpy(zero_copy_only=False)
    change[1:-1] = (values[1:] != values[:-1]) | (null[1:] != null[:-1])
    return np.flatnonzero(change)


def _groups(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Format whole conversations, sorted by conv_id, GROUP_BYTES at a time."""
    length = lambda c: pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(np.concatenate([[0], *(length(b.column(1)) + length(b.column(2)) for b in held)]), dtype=np.int64)
    rows = pa.Table.from_batches(held)
    bounds = _starts(rows.column("conv_id").combine_chunks())
    for i, j in cuts(np.diff(total[bounds]), GROUP_BYTES):
        part = rows.slice(bounds[i], bounds[j] - bounds[i])
        if total[bounds[j]] - total[bounds[i]] > MOST_BYTES:
            raise ValueError(f"conversation {part.column('conv_id')[0]} is longer than {MOST_BYTES} bytes")
        yield _format(part)


def _format(rows: pa.Table) -> pa.RecordBatch:
    """Format the whole conversations in ``rows``, sorted by conv_id."""
    ids = rows.column("conv_id").combine_chunks()
    roles, texts = rows.column("role").combine_chunks(), rows.column("text").combine_chunks()
    out, turn_bytes, turn_chars, text_at = assemble(roles, texts)
    bounds = _starts(ids)
    first, turns = bounds[:-1], np.diff(bounds)
    conv = np.repeat(np.arange(len(first)), turns)
    ends = np.concatenate([[0], np.cumsum(turn_bytes)])
    if len(out) > MOST_BYTES:
        raise ValueError(f"conversation {ids[0]} is longer than {MOST_BYTES} bytes when formatted")
    formatted = pa.StringArray.from_buffers(len(first), pa.py_buffer(ends[bounds].astype(np.int32)), pa.py_buffer(out))
    char_end = np.cumsum(turn_chars)
    char_at = char_end - turn_chars
    char_at -= char_at[first][conv]
    learnt = pc.fill_null(pc.equal(roles, LEARNT), False).to_numpy(zero_copy_only=False)
    start = (char_at + text_at)[learnt]
    end = (char_at + turn_chars - len(END) - 1)[learnt]
    spans = pa.StructArray.from_arrays([pa.array(start), pa.array(end)], ["start", "end"])
    counts = np.bincount(conv[learnt], minlength=len(first))
    loss = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), spans)
    return pa.RecordBatch.from_arrays([ids.take(pa.array(first)), pa.array(turns, pa.int64()), formatted, loss], schema=_ARROW)


def format_chats(df: DataFrame) -> DataFrame:
    """(conv_id, n_turns, formatted, loss) for each conversation of (conv_id, turn, role, text) rows."""
    rows = df.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of the conversation that may go on in the next batch
        for batch in it:
            if not batch.num_rows:
                continue
            ids = batch.column(0)
            same = pc.fill_null(pc.equal(ids, ids[-1]), False) if ids[-1].is_valid else pc.is_null(ids)
            cut = batch.num_rows - same.to_numpy(zero_copy_only=False)[::-1].cumprod().sum().item()
            if held and held[-1].column(0)[-1] != ids[0]:
                yield from _groups(held)
                held = []
            if cut:
                yield from _groups([*held, batch.slice(0, cut)])
                held, batch = [], batch.slice(cut)
            held.append(batch)
        if held:
            yield from _groups(held)

    return rows.mapInArrow(run, _SCHEMA)


def chat_digest(formatted: DataFrame) -> DataFrame:
    """The digest columns of the contract, read back from the formatted conversations."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = []
            for r in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                turns = parse(r["formatted"])
                learnt = "".join(unescape(r["formatted"][s["start"] : s["end"]]) for s in r["loss"])
                whole = "".join(f"{role}\n{text}\n" for role, text in turns)
                rows.append((r["conv_id"], len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), len(r["formatted"])))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)], names)

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _sql_escape(column: str) -> str:
    out = f"replace(coalesce({column}, ''), '\\', '\\\\')"
    for c in CONTROLS:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


#: The query's rows, for DuckDB.
ORACLE = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = '{LEARNT}' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = '{LEARNT}' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  CAST(sum(length({_sql_escape("role")}) + length(role) - length(replace(role, chr(10), '')) + length({_sql_escape("text")}) + {len(START) + len(END) + 2}) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""
