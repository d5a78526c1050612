"""Operators 3 and 10."""

import gzip
import io
import re
from collections import Counter

import pytest

from skein.llm import decontaminate, warc


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def slow(docs, items, size=5, cut=0.8):
    found = {}
    for d, text in docs:
        w = words(text)
        for i, item in items:
            v = words(item)
            if not v or not w:
                continue
            k = min(size, len(v))
            grams = lambda x, k=k: Counter(tuple(x[j : j + k]) for j in range(len(x) - k + 1))
            for s in range(max(1, len(w) - len(v) + 1)):
                a, b = grams(w[s : s + len(v)]), grams(v)
                if a and (j := sum((a & b).values()) / sum((a | b).values())) >= cut:
                    found[d, i] = max(found.get((d, i), 0), j)
    return found


def test_windows_against_brute_force(spark):
    import random

    r = random.Random(2)
    some = lambda n: " ".join(r.choice("alpha beta gamma delta eps zeta eta theta iota kappa lambda mu nu xi".split()) for _ in range(n))
    items = [(i, some(30 + i % 7)) for i in range(12)] + [(20, "tiny item"), (21, None), (22, ""), (23, "Just Five Words Right here"), (24, "same same same same same same same same")]
    docs = [(i, some(80) + ". " + items[i % 12][1].upper().replace(" ", ", ") + "! " + some(50)) for i in range(12)]
    docs += [(12, items[0][1]), (13, " ".join(items[1][1].split()[2:])), (14, "a " + items[2][1].replace(" ", " x ", 1)), (15, None), (16, ""), (17, "the tiny item is here"), (18, some(400)), (19, "just five words right here"), (20, "same " * 40), (21, (some(3000) + " ") * 5 + items[3][1])]
    rows = [(d, t, 1, "x", 2) for d, t in docs] + [(12, items[0][1], 1, "x", 2), (12, items[5][1], 1, "x", 2), (None, items[4][1], 1, "x", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, item int, words string, n int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id): x.similarity for x in decontaminate.contaminated(df, bench).collect()}
    want = slow([(d, t) for d, t, *_ in rows], items)
    assert got == pytest.approx(want)
    left = decontaminate.decontaminate(df, bench)
    bad = {d for d, _ in want}
    assert left.columns == df.columns and sorted(x.doc_id for x in left.collect()) == sorted(d for d, *_ in rows if d not in bad)


def test_items_with_swapped_halves(spark):
    """The best window lies between the diagonals of the two halves."""
    item = [f"w{i}" for i in range(60)]
    more = lambda k, n: [f"x{k}y{i}" for i in range(n)]
    swapped, turned = item[30:] + item[:30], item[45:] + item[:45]
    docs = [(1, more(1, 80) + swapped + more(2, 70)), (2, turned), (3, more(3, 9) + turned), (4, swapped + more(4, 5)), (5, more(5, 80) + item[:30] + more(6, 70)), (6, item[4:])]
    docs, items = [(d, " ".join(w)) for d, w in docs], [(7, " ".join(item))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = slow(docs, items)
    assert {d for d, _ in want} == {1, 2, 3, 4, 6}
    got = {(x.doc_id, x.item_id): x.similarity for x in decontaminate.contaminated(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == pytest.approx(want)


def test_nothing_to_find(spark):
    df = spark.createDataFrame([(1, "some words in a text here")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(df, none).count() == 1
    assert decontaminate.contaminated(df.limit(0), df.withColumnRenamed("doc_id", "item_id")).count() == 0


def test_fingerprints_within_the_radius_meet(spark):
    """Every pair of fingerprints within RADIUS bits shares an entry and a probe."""
    import random

    r = random.Random(1)
    pairs = []
    for _ in range(300):
        x = r.getrandbits(64)
        y = x
        for b in r.sample(range(64), r.randrange(decontaminate.RADIUS + 1)):
            y ^= 1 << b
        pairs.append((x - (1 << 64) if x >> 63 else x, y - (1 << 64) if y >> 63 else y))
    df = spark.createDataFrame(pairs, "fp long, other long").coalesce(1)
    from pyspark.sql import functions as F

    entries = df.select("fp", "other", decontaminate._blocks("fp", True).alias("e"))
    probes = df.select(F.col("fp").alias("f"), decontaminate._blocks("other", False).alias("p"))
    met = entries.join(probes, (F.col("fp") == F.col("f")) & (F.col("e") == F.col("p"))).select("fp").distinct()
    assert met.count() == len({x for x, _ in pairs})


# --- operator 10


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, record_type string, payload int")


ROWS = [(1, "http://a/1", "<p>one</p>"), (2, "http://a/2", "<p>two</p>"), (3, None, "<p>one</p>"), (4, "http://a/\r\nX: y", None), (5, "u", ""), (6, "u", "é" * 3_000_00), (7, "u", "<p>one</p>"), (None, "u", "<p>one</p>"), (None, "u", "<p>lone</p>"), (7, "u", "<p>one</p>")]


def test_round_trip(spark):
    got = sorted(warc.round_trip(pages(spark, ROWS)).collect(), key=str)
    best = {}
    for i, _, h in ROWS:
        if i is not None:
            best[h or ""] = max(best.get(h or "", i), i)
    want = []
    for i, _, h in ROWS:
        body, top = (h or "").encode(), best.get(h or "")
        again = top is not None and top != i
        want.append((i, len(body), warc.digest(body), "revisit" if again else "response", top if again else None))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert warc.round_trip(pages(spark, [])).count() == 0


def test_small_payloads_are_not_revisited(spark):
    got = warc.round_trip(pages(spark, ROWS), min_bytes=11).collect()
    assert {r.record_type for r in got} == {"response"}


def test_push_down_skips_payloads(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/w"
    warc.archive(pages(spark, ROWS), folder)
    df = warc.read_archive(spark, folder)
    only = df.where("record_type = 'revisit'")
    assert only.count() == 4 and df.where("page_id in (2, 6)").count() == 2
    assert df.where("record_type = 'response' and target_uri = 'u' and page_id > 6").count() == 2  # the last predicate stays with Spark
    assert warc.read_archive(spark, folder, payload=False).where("payload is not null").count() == 0
    assert warc.read_archive(spark, folder, types=("response",)).count() == len(ROWS) - 4
    reader = warc._Reader({"path": folder})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    assert [type(f) for f in reader.pushFilters([EqualTo(("record_type",), "revisit"), GreaterThan(("page_id",), 1)])] == [GreaterThan]
    monkeypatch.setattr(warc, "_payload", lambda *_: pytest.fail("a payload was decoded"))
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 4


def test_uncommitted_files_are_no_records(spark, tmp_path):
    folder = f"file://{tmp_path}/w"
    warc.archive(pages(spark, ROWS[:2]), folder)
    (tmp_path / "w" / "lost.warc.gz").write_bytes(b"half a rec")
    warc.archive(pages(spark, ROWS[1:3]), folder)
    assert warc.read_archive(spark, folder).count() == 4


def test_other_writers_archives(spark, tmp_path):
    (tmp_path / "w").mkdir()
    plain = [warc.record(1, "http://x", "response", b"a" * 9000, None), warc.record(2, None, "revisit", b"bb", 1), warc.record(3, "u", "response", b"", None)]
    (tmp_path / "w" / "a.warc").write_bytes(b"".join(plain))
    zipped = io.BytesIO()
    for p in plain:
        zipped.write(gzip.compress(p))
    (tmp_path / "w" / "b.warc.gz").write_bytes(zipped.getvalue())
    got = warc.read_archive(spark, str(tmp_path / "w")).select("page_id", "payload").collect()
    assert Counter((r.page_id, None if r.payload is None else len(r.payload)) for r in got) == Counter({(1, 9000): 2, (2, None): 2, (3, 0): 2})
    assert gzip.decompress(warc.gzip_member(b"abc" * 9)) == b"abc" * 9
