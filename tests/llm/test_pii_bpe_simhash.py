"""Operators 2, 4 and 9 against plain versions."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skein.llm import bpe, pii, simhash

SCHEMA = "doc_id long, text string, id string, words int, fp string, spans int"


def plain(text):
    out = []
    for kind, pattern in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                "card": 12 <= len(digits) <= 19 and pii.luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], pii.BASE.index(s[2])))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab1234567890@.+-_ ()%é😀:/", max_size=60))
def test_base_spans_are_the_regular_expressions_matches(text):
    assert [s for s in pii.find(text) if s[2] in pii.BASE] == plain(text)


def test_spans_and_their_extras():
    text = "mail a.b@c-d.example.org or a@b@c.de, 4785 3805 9239 1139; 10.0.0.256 152.143.123.131 +49 (30) 1234567 http://x.yz/a?b iban: DE89 3704 0044 0532 0130 00 token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\""
    kinds = [k for _, _, k in pii.find(text)]
    assert kinds.count("email") == 2 and kinds.count("ip") == 1 and kinds.count("phone") == 1
    assert {"url", "iban", "secret"} <= set(kinds)
    assert "[EMAIL]" in pii.redact(text, pii.find(text)) and pii.redact(None, []) is None


def test_repeated_cues_take_linear_time():
    import time

    for piece in ("token=", "IBAN ", "a@", "1.", "+1(", "://", "x://a.b/", "1-", "secret: ", "a.b@c."):
        text = piece * (2_000_000 // len(piece))
        began = time.process_time()
        found = pii.find(text)
        assert time.process_time() - began < 60, piece
        for kind in pii.KINDS:
            own = [s for s in found if s[2] == kind]
            assert all(a[1] <= b[0] for a, b in zip(own, own[1:], strict=False)), (piece, kind)
    assert [k for *_, k in pii.find("token=" * 100_000)] == ["secret"]


def test_pii_rows(spark):
    rows = [(1, None, "x", 1, "y", 2), (2, "", None, None, None, None), (None, "a@b.cd", "x", 1, "y", 2), (3, "x " * 200000 + "a@b.cd", "x", 1, "y", 2), (3, "q@r.st", "x", 1, "y", 2), (3, "q@r.st", "x", 1, "y", 2)]
    got = pii.pii_digest(pii.find_pii(spark.createDataFrame(rows, SCHEMA))).collect()
    assert len(got) == 6 and {r.spans for r in got} == {"", "email:0:6", "email:400000:400006"}
    assert all(r.base_sha256 == hashlib.sha256(r.spans.encode()).hexdigest() for r in got)
    assert pii.pii_digest(pii.find_pii(spark.createDataFrame([], SCHEMA))).count() == 0


@pytest.fixture(scope="module")
def tok():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return path, t


TEXTS = [None, "", " ", "  two  spaces\n\n\ttab ", "It's we'll 'S don’t", "a<|endoftext|>b <|endoftext|> ", "é日本語😀 　x\x85y\x1c z", "x" * 5000, "1²½Ⅷ३ abc_def", "​zero line", "a\r\nb\x00c", "<|endoftext|>", "é ﻿"]


def test_bpe_is_the_librarys(spark, tok):
    path, t = tok
    rows = [(i, x, "x", 1, "y", 2) for i, x in enumerate(TEXTS + ["same words"] * 3 + ["the and " * 60000])]
    df = bpe.encode(spark.createDataFrame(rows, SCHEMA), path)
    got = {r.doc_id: list(r.ids) for r in df.collect()}
    back = {r.doc_id: r for r in bpe.decode(df, path).collect()}
    for i, x, *_ in rows:
        want = t.encode(x or "", add_special_tokens=False).ids
        assert got[i] == want, x
        assert back[i].text == t.decode(want, skip_special_tokens=False)
        assert back[i].n_tokens == len(want) and back[i].ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
    assert bpe.decode(bpe.encode(spark.createDataFrame([], SCHEMA), path), path).count() == 0
    both = {r.doc_id: r for r in bpe.round_trip(spark.createDataFrame(rows, SCHEMA), path).collect()}
    assert all((both[i].n_tokens, both[i].ids_sha256, both[i].decoded_sha256) == (b.n_tokens, b.ids_sha256, hashlib.sha256(b.text.encode()).hexdigest()) for i, b in back.items())
    assert len(both) == len(back) and bpe.round_trip(spark.createDataFrame([], SCHEMA), path).count() == 0


def test_slices_and_emptied_tables_change_nothing(tok, monkeypatch):
    import pyarrow as pa

    path, _ = tok
    lists = [["The", " the"], [], [" the", " cat", " sat"] * 5, [], ["x" * 300], [" The"]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(lists, pa.list_(pa.string()))], ["id", "words"])
    whole = [(rows.to_pylist(), np.split(ids, bounds[1:-1])) for rows, ids, bounds in bpe._encoded([batch, batch.slice(2)], path)]
    flat = lambda parts: [(i, x.tolist()) for rows, own in parts for i, x in zip(rows, own, strict=True)]
    monkeypatch.setattr(bpe, "SLICE_BYTES", 4)
    monkeypatch.setattr(bpe, "TABLE_WORDS", 1)
    again = [(rows.to_pylist(), np.split(ids, bounds[1:-1])) for rows, ids, bounds in bpe._encoded([batch, batch.slice(2)], path)]
    assert len(again) > len(whole) and flat(again) == flat(whole)


def test_odd_added_tokens_are_refused(tok, tmp_path):
    import json

    spec = json.loads(open(tok[0], encoding="utf-8").read())
    spec["added_tokens"][0]["lstrip"] = True
    (tmp_path / "t.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="added tokens"):
        bpe.Vocabulary(str(tmp_path / "t.json"))


def test_every_piece_is_its_own_id(tok):
    path, t = tok
    v = bpe.vocabulary(path)
    assert all(v.encode_word(p) == [i] for i, p in enumerate(v.pieces) if i not in v.special.values())


def slow_fingerprint(text):
    import xxhash

    words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    k = min(3, len(words))
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aBÉc \t\n\x1c ", max_size=40))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_golay_code_is_perfect_and_covers():
    words, by = simhash._patterns()
    assert (by[3][1] == 1).all()
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 62, 3000)
    flips = np.array([sum(1 << int(b) for b in rng.choice(46, 2, False)) for _ in x])
    home = dict(zip(*simhash.anchors(x, 0), strict=True))
    around = set(zip(*(v.tolist() for v in simhash.anchors(x ^ flips, 2)), strict=True))
    assert all((i, int(home[i])) in around for i in range(len(x)))


def test_near_duplicates_against_all_pairs(spark):
    import random

    r = random.Random(3)
    base = [" ".join(r.choice("alpha beta gamma delta eps zeta eta theta".split()) for _ in range(60)) for _ in range(20)]
    rows = [(i, t, "x", 1, "y", 2) for i, t in enumerate(base + base[:5] + [b + " tail" for b in base] + [None, "", " ", "one", "ONE", "a b"])]
    rows += [rows[3], (None, base[2], "x", 1, "y", 2), (None, "nobody else", "x", 1, "y", 2)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    fps = [(i, simhash.fingerprint(t)) for i, t, *_ in rows]
    comp = {}
    for i, f in fps:
        group, todo = set(), [f]
        while todo:
            x = todo.pop()
            if x not in group:
                group.add(x)
                todo += [y for _, y in fps if bin(x ^ y).count("1") <= 2]
        comp[f] = min([j for j, y in fps if y in group and j is not None], default=None)
    assert sorted((str(g.doc_id), g.fingerprint, str(g.component_id)) for g in got) == sorted((str(i), f"{f:016x}", str(comp[f])) for i, f in fps)
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    kept = simhash.keep_first(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(str(k.doc_id) for k in kept if k.doc_id is not None) == sorted(str(i) for i, f in fps if i is not None and comp[f] == i)


def test_anchors_are_never_broadcast(spark):
    # few fingerprints look small to the planner, but each has dozens of anchors, which would all meet in the driver
    fps = spark.range(2000).select(F.xxhash64("id").alias("fp"))
    twins = fps.limit(20).select(F.col("fp").bitwiseXOR(F.lit(5)).alias("fp"))
    found = simhash.links(fps.unionAll(twins))
    assert len(found.collect()) == 20
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
