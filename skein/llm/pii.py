"""Personal data by anchor expansion (operator 2).

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits, URL schemes and the words that
announce an identifier. From each anchor a deterministic local parser expands to the span's two boundaries and
validates it, so text without anchors costs one automaton step a character.

Base kinds are the leftmost non-overlapping matches per kind of

* email ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``
* ip ``[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)``, kept if every part is at most 255
* card ``[0-9]([\\x20-]?[0-9])+``, kept if it has 12 to 19 digits and passes Luhn
* phone ``\\+[0-9][\\x20().0-9-]+[0-9]``, kept if it has 9 to 15 digits

A match that fails its test is dropped and its characters are used up: there are no retries. The method adds
``url`` (scheme and host), ``iban`` (cue "IBAN", check digits valid) and ``secret`` (cue such as "token", then
``=`` or ``:`` and a value of 16 characters or more); within each of these kinds, too, spans don't overlap: a cue inside a span is
part of it. So time is linear in the text. Offsets are code points, ends exclusive.

Null texts count as empty and have no spans; rows repeat as often as they came; other columns are ignored.
"""

from __future__ import annotations

import re
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import batches

#: Base kinds in the order of ties, then those that anchor expansion adds.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "iban", "secret")

#: Words that announce an identifier, by the kind that they announce. Fixed values.
CUES = {
    "://": "url",
    "IBAN": "iban",
    "Iban": "iban",
    "iban": "iban",
    "token": "secret",
    "Token": "secret",
    "TOKEN": "secret",
    "api_key": "secret",
    "API_KEY": "secret",
    "apikey": "secret",
    "secret": "secret",
    "SECRET": "secret",
    "password": "secret",
    "PASSWORD": "secret",
    "passwd": "secret",
}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_DIGITS = re.compile(r"[0-9]++")
_IP = re.compile(r"([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+(?::[0-9]++)?+(?:[/?#][^\s<>\"']*+)?+")
_IBAN = re.compile(r"[\x20:=#]{0,3}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){10,30})")
_SECRET = re.compile(r"[\x20\"']{0,3}[:=][\x20]{0,3}[\"']?([A-Za-z0-9_+/=.-]{16,})")


@cache
def _automaton():
    import ahocorasick

    auto = ahocorasick.Automaton()
    for d in "0123456789":
        auto.add_word(d, ("digit", 1))
    auto.add_word("@", ("at", 1))
    auto.add_word("+", ("plus", 1))
    for cue, kind in CUES.items():
        auto.add_word(cue, (kind, len(cue)))
    auto.make_automaton()
    return auto


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else (n * 2 - 9 if n > 4 else n * 2)
    return total % 10 == 0


def _iban(text: str, at: int) -> tuple[int, int] | None:
    m = _IBAN.match(text, at)
    if not m:
        return None
    start, raw = m.start(1), m[1]
    for end in range(len(raw), 14, -1):  # at most 65 characters
        code = raw[:end].replace(" ", "")
        if raw[end - 1] != " " and 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1:
            return start, start + end
    return None


def find(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every span, by start and then kind in the order of KINDS."""
    text = text or ""
    spans: list[tuple[int, int, str]] = []
    email_end = run_end = ip_end = card_end = phone_end = url_end = iban_end = secret_end = 0
    for last, (what, n) in _automaton().iter(text):
        at = last - n + 1
        if what == "digit":
            if at >= run_end:
                run_end = _DIGITS.match(text, at).end()
                if at >= ip_end and (m := _IP.match(text, at)):
                    ip_end = m.end()
                    if all(len(p := x.lstrip("0")) <= 3 and int(p or "0") <= 255 for x in m.groups()):
                        spans.append((at, ip_end, "ip"))
            if at >= card_end and (m := _CARD.match(text, at)):
                card_end = m.end()
                code = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(code) <= 19 and luhn(code):
                    spans.append((at, card_end, "card"))
        elif what == "at":
            start = at
            while start > email_end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                email_end = m.end()
                spans.append((start, email_end, "email"))
        elif what == "plus":
            if at >= phone_end and (m := _PHONE.match(text, at)):
                phone_end = m.end()
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    spans.append((at, phone_end, "phone"))
        elif what == "url":
            start = at
            while start > url_end and at - start < 16 and text[start - 1] in _SCHEME:
                start -= 1
            while start < at and not text[start].isalpha():
                start += 1
            if start < at and (m := _HOST.match(text, last + 1)):
                url_end = m.end()
                spans.append((start, url_end, "url"))
        elif what == "iban":
            if at >= iban_end and (found := _iban(text, last + 1)):
                iban_end = found[1]
                spans.append((*found, "iban"))
        elif at >= secret_end and (m := _SECRET.match(text, last + 1)):
            secret_end = m.end()
            spans.append((*m.span(1), "secret"))
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(set(spans), key=lambda s: (s[0], order[s[2]], s[1]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: its id and ``spans``, an array of (start, end, kind)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [[{"start": s, "end": e, "kind": k} for s, e, k in find(t.as_py())] for t in batch.column(1)]
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["id", "spans"])

    kind = dict(df.dtypes)[id_col]
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return batches(rows, run, f"id {kind}, spans array<struct<start:long,end:long,kind:string>>").withColumnRenamed("id", id_col)


def redact(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    """``text`` with every span replaced by its kind in square brackets; of overlapping spans the first covers."""
    if text is None:
        return None
    out, done = [], 0
    for s, e, k in spans:
        if s >= done:
            out += [text[done:s], f"[{k.upper()}]"]
        done = max(done, e)
    return "".join([*out, text[done:]])


def pii_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The digest columns of the contract, derived from ``find_pii``'s spans."""
    label = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select(
        id_col,
        *(of(k).alias(f"n_{k}") for k in BASE),
        F.sha2(F.array_join(F.transform(base, label), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", label), ",").alias("spans"),
        *(of(k).alias(f"n_{k}") for k in KINDS[len(BASE) :]),
        F.size(F.filter("spans", lambda s: s["kind"] != "url")).cast("long").alias("n_personal"),
    )
