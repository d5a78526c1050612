"""Operators 5 and 6 against all pairs."""

import random

import numpy as np
import pytest

from skein.llm import embeddings, lines


def slow_lines(rows, min_words=1):
    """(row index, position) of every line that an earlier line is similar to."""
    seen, gone = [], set()
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    for i in order:
        for p, line in enumerate((rows[i][1] or "").split("\n")):
            t = set(line.lower().split())
            if len(t) < min_words:
                continue
            if any(len(t & s) * 5 >= len(t | s) * 4 for s in seen):
                gone.add((i, p))
            seen.append(t)
    return gone


def documents(seed, n=60):
    r = random.Random(seed)
    words = ["the", "of", "and", *(f"w{i}" for i in range(300))]
    line = lambda k: " ".join(r.choice(words) for _ in range(k))
    pool = [line(r.randrange(5, 60)) for _ in range(25)]
    out = []
    for i in range(n):
        own = []
        for _ in range(r.randrange(1, 7)):
            x = r.choice(pool) if r.random() < 0.5 else line(r.randrange(1, 40))
            parts = x.split()
            if r.random() < 0.4:
                parts[r.randrange(len(parts))] = r.choice(words)
            if r.random() < 0.2:
                r.shuffle(parts)
            own.append("  ".join(parts).upper() if r.random() < 0.1 else " ".join(parts))
        out.append((i, "\n".join(own)))
    return out


SCHEMA = "doc_id long, text string, n int, k string, same int"


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_lines_against_all_pairs(spark, seed):
    rows = documents(seed) + [(100, None), (101, ""), (102, "\n\n"), (103, "long words here again and " * 40000), (104, "a b c d e\na b c d e\n a  b\tc d e ")]
    got = {r.doc_id: r for r in lines.dedup_lines(spark.createDataFrame([(*x, 1, "k", 2) for x in rows], SCHEMA)).collect()}
    gone = slow_lines(rows)
    assert len(got) == len(rows) and gone
    for i, (d, text) in enumerate(rows):
        want = None if text is None else "\n".join(x for p, x in enumerate(text.split("\n")) if (i, p) not in gone)
        assert got[d].text == want, d
        assert got[d]._removed == sum(a == i for a, _ in gone)


def test_line_keys_and_empty_tables(spark):
    one, two = "alpha beta gamma delta eps", "un deux trois quatre cinq"
    rows = [(None, one), (None, one), (1, f"{one}\n{two}"), (1, f"{two} six\nother words stand in here"), (1, two)]
    df = spark.createDataFrame([(*x, 1, "k", 2) for x in rows], SCHEMA)
    out = lines.dedup_lines(df)
    texts = sorted((str(r.doc_id), r.text) for r in out.collect())
    assert out.columns == [*df.columns, "_removed"]
    assert [t for d, t in texts if d == "None"] == [one, one]  # repeated rows are decided alike
    kept = [x for d, t in texts if d == "1" for x in t.split("\n") if x]
    assert one not in kept and "other words stand in here" in kept
    assert sum(set(x.split()) >= set(two.split()) for x in kept) == 1  # one of the three alike is the first
    assert lines.dedup_lines(df.limit(0)).count() == 0


def test_the_order_of_tokens_changes_nothing(spark, monkeypatch):
    from pyspark.sql import functions as F

    rows = documents(9)
    df = spark.createDataFrame([(*x, 1, "k", 2) for x in rows], SCHEMA)
    key = lambda d: sorted((r.doc_id, r.text) for r in d.collect())
    full = key(lines.dedup_lines(df))
    monkeypatch.setattr(lines, "_bands", lambda *_: F.array_repeat(F.lit(0).cast("long"), lines.BUCKETS))
    assert key(lines.dedup_lines(df)) == full


def test_joins_by_shuffle_and_long_lines_change_nothing(spark, monkeypatch):
    """Nothing is broadcast, most lines have 128 parity bits, and candidates are verified in many rounds."""
    rows = documents(4) + [(200 + i, " ".join(f"w{j % 211}" for j in range(i, i + 150))) for i in range(0, 60, 4)]
    df = spark.createDataFrame([(*x, 1, "k", 2) for x in rows], SCHEMA)
    for name, value in (("BROADCAST_BYTES", 0), ("WIDE", 20), ("ROUNDS", (1, 2, 3))):
        monkeypatch.setattr(lines, name, value)
    got = {r.doc_id: r._removed for r in lines.dedup_lines(df).collect()}
    gone = slow_lines(rows)
    assert got == {d: sum(a == i for a, _ in gone) for i, (d, _) in enumerate(rows)} and max(got[d] for d in got if d >= 200)


@pytest.mark.parametrize("size", [5, 40])
def test_only_large_groups_have_leaders_and_words_are_made_once(spark, monkeypatch, size):
    seen, own = [], lines._leader_pairs
    monkeypatch.setattr(lines, "_leader_pairs", lambda *a: seen.append(own(*a)) or seen.append(seen[0].count()) or seen[0])
    filters, write = [], lines.materialize
    monkeypatch.setattr(lines, "materialize", lambda df, name: (name == "similar" and filters.append(df._jdf.queryExecution().optimizedPlan().toString())) or write(df, name))
    base = [f"w{i}" for i in range(20)]
    rows = [(i, " ".join([*base[: i % 20], f"x{i}", *base[i % 20 + 1 :]])) for i in range(size)]
    got = {r.doc_id: r._removed for r in lines.dedup_lines(spark.createDataFrame([(*x, 1, "k", 2) for x in rows], SCHEMA)).collect()}
    gone = slow_lines(rows)
    assert got == {d: sum(a == i for a, _ in gone) for i, (d, _) in enumerate(rows)} and sum(got.values())
    assert (seen[1] > 0) == (size > 16)
    assert filters and all(p.count("array_intersect") <= 1 and "lower" not in p for p in filters)


# --- operator 5


def slow_links(rows, cut=0.98):
    good = []
    for i, v, label in rows:
        ok = v is not None and label is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
        good.append(None if not ok else np.array(v, float) / np.linalg.norm(np.array(v, float) / np.abs(v).max()) / np.abs(v).max())
    n = len(rows)
    links = [[j for j in range(n) if j != i and good[i] is not None and good[j] is not None and rows[i][2] == rows[j][2] and len(good[i]) == len(good[j]) and good[i] @ good[j] >= cut] for i in range(n)]
    out = []
    for i in range(n):
        group, todo = set(), [i]
        while todo:
            x = todo.pop()
            if x not in group:
                group.add(x)
                todo += links[x]
        least = min((rows[j][0] for j in group if rows[j][0] is not None), default=None)
        out.append((rows[i][0], len(links[i]), least, rows[i][0] is not None and rows[i][0] == least))
    return out


def test_links_against_all_pairs(spark):
    r = np.random.default_rng(3)
    base = r.standard_normal((40, 16))
    rows = [(i, v.tolist(), int(i % 3)) for i, v in enumerate(base)]
    for c, size in ((0, 70), (1, 12), (2, 3), (3, 2)):
        rows += [(len(rows) + k, (base[c] + 0.02 * r.standard_normal(16)).tolist(), c % 3) for k in range(size)]
    rows += [(len(rows) + k, (base[5] * (k + 1)).tolist(), 2) for k in range(30)]  # scaled copies
    chain = base[6] / np.linalg.norm(base[6])
    other = np.roll(chain, 1) - chain * (np.roll(chain, 1) @ chain)
    other /= np.linalg.norm(other)
    rows += [(len(rows) + k, (chain * np.cos(0.15 * k) + other * np.sin(0.15 * k)).tolist(), 0) for k in range(1, 9)]
    n = len(rows)
    odd = [(n, None, 1), (n + 1, [], 1), (n + 2, [0.0] * 16, 1), (n + 3, [float("nan")] + [1.0] * 15, 1), (n + 4, [None] + [1.0] * 15, 1), (n + 5, base[0].tolist(), None), (n + 6, [1e-300] * 16, 1), (n + 7, [1e300] * 16, 1), (n + 8, [1.0] * 5, 1), (None, base[0].tolist(), 0), (0, base[0].tolist(), 0)]
    rows += odd
    df = spark.createDataFrame([(*x, 1, "u", 2.0) for x in rows], "vec_id long, embedding array<double>, label int, u int, unit string, sim double")
    report = {}
    got = embeddings.near_duplicates(df, report=report)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"] and report["recall"] >= 0.9
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(map(key, map(tuple, got.collect()))) == sorted(map(key, slow_links(rows)))


def test_adjacent_groups_that_fill_their_lists(spark):
    """Two groups of 20 with inner cosine near 1 and 0.98 to 0.99 between them: every list of ten stays in its group."""
    r = np.random.default_rng(7)
    a, b = np.linalg.qr(r.standard_normal((64, 2)))[0].T
    turn = np.arccos(0.9885)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(r.standard_normal((60, 64)))]
    for c in (a, a * np.cos(turn) + b * np.sin(turn)):
        rows += [(len(rows) + k, (c + 0.002 * r.standard_normal(64)).tolist(), 0) for k in range(20)]
    want = slow_links(rows)
    assert [n for _, n, *_ in want[60:]] == [39] * 40 and len({c for _, _, c, _ in want[60:]}) == 1
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_one_large_group_does_not_hide_lost_pairs(spark, monkeypatch):
    """Lists without the links of pairs: the links of one group are 99 % of all, but a quarter of the classes lack theirs."""
    r = np.random.default_rng(8)
    base = r.standard_normal((11, 64))
    rows = [(k, (base[0] + 0.05 * r.standard_normal(64)).tolist(), 0) for k in range(60)]
    rows += [(60 + 2 * p + k, (base[p + 1] + 0.05 * k * r.standard_normal(64)).tolist(), 0) for p in range(10) for k in range(2)]
    want = slow_links(rows)
    assert [n for _, n, *_ in want] == [59] * 60 + [1] * 20
    real = embeddings._descend
    monkeypatch.setattr(embeddings, "_descend", lambda *a: real(*a).where("size(filter(near, x -> x.sim >= 0.98)) > 1"))
    monkeypatch.setattr(embeddings, "TRIES", 1)
    report = {}
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), report=report)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert report["recall"] == report["whole"] == 1.0


def test_empty_and_lone(spark):
    kind = "vec_id long, embedding array<float>, label int"
    assert embeddings.near_duplicates(spark.createDataFrame([], kind)).count() == 0
    got = embeddings.near_duplicates(spark.createDataFrame([(7, [1.0, 0.0], 1), (8, None, 1)], kind)).collect()
    assert sorted(map(tuple, got)) == [(7, 0, 7, True), (8, 0, 8, True)]


def test_wide_lines_are_gone_before_pairs_are_made(spark, monkeypatch):
    from pathlib import Path

    from skein.session import shared_dir

    def there():
        return {p.name.split("-")[1] for p in Path(shared_dir(spark).removeprefix("file://")).glob("skein-*")}

    before, seen, own = there(), [], lines._open_pairs
    monkeypatch.setattr(lines, "_open_pairs", lambda *a: seen.append(there() - before) or own(*a))
    rows = documents(4, 20)
    got = lines.dedup_lines(spark.createDataFrame([(*x, 1, "k", 2) for x in rows], SCHEMA)).collect()
    assert sum(g._removed for g in got) == len(slow_lines(rows))
    assert "lines" not in seen[0] and "leader" not in seen[0] and "stands" in seen[0]


def test_bands_are_counted_over_some_rows_and_change_nothing(spark, monkeypatch):
    rows = documents(4)
    df = spark.createDataFrame([(*x, 1, "k", 2) for x in rows], SCHEMA).localCheckpoint()
    key = lambda d: sorted((r.doc_id, r.text) for r in d.collect())
    some = lines._bands(df, "doc_id", "text")
    monkeypatch.setattr(lines, "COUNTED", 1)
    every = lines._bands(df, "doc_id", "text")
    total = lambda b: sum(2 ** (x / 2) for x in df.limit(1).select(b.alias("b")).first().b if x)
    assert 0 < total(some) < total(every) / 3
    whole = key(lines.dedup_lines(df))
    monkeypatch.setattr(lines, "COUNTED", 8)
    assert key(lines.dedup_lines(df)) == whole
