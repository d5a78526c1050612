"""The pipeline against its stages done by brute force on a small folder of tables."""

import hashlib
import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
public = pytest.importorskip("public_tokenizers")

from test_decontaminate_warc import slow  # noqa: E402
from test_lines_embeddings import slow_lines  # noqa: E402

from skein.llm import quality, simhash  # noqa: E402


def test_against_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    r = random.Random(8)
    words = [a + b for a in ("th", "er", "on", "an", "re", "in", "st", "nd") for b in ("a", "e", "ing", "ed", "ly", "ion", "or", "es")]
    line = lambda n: " ".join(r.choice(words) for _ in range(n)).capitalize() + "."
    items = [(i, line(35)) for i in range(4)]
    docs = [(i, "\n".join(line(30) for _ in range(3))) for i in range(40)]
    docs += [(100 + i, docs[i][1] + "\n" + line(12)) for i in range(4)]  # repeated lines
    docs += [(200 + i, line(20) + "\n" + items[i][1] + "\n" + line(20)) for i in range(4)]  # benchmark items
    docs += [(300 + i, " ".join(w.upper() + "!!" for w in line(60).split())) for i in range(20)]  # poor
    docs += [(400, None), (401, ""), (402, "short one"), (403, "short one")]
    docs = [(i, t, "en", "s", len(t or "")) for i, t in docs]
    labels = [(i, int(i < 300), 0) for i, *_ in docs if i < 400]
    for name, rows, kind in (("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", items, "item_id long, text string")):
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")

    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = quality.fit(df, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    import numpy as np

    kept = [(i, t) for i, t, *_ in docs if model.scores(np.stack([quality.terms(t)]))[0] >= quality.CUT]
    assert {i for i, _ in kept} >= set(range(40)) and not any(300 <= i < 320 for i, _ in kept)
    gone = slow_lines(kept)
    cut = []
    for k, (i, t) in enumerate(kept):
        own = (t or "").split("\n")
        left = "\n".join(x for p, x in enumerate(own) if (k, p) not in gone)
        if left.strip() or not any((k, p) in gone for p in range(len(own))):
            cut.append((i, left))
    fps = [(i, simhash.fingerprint(t), t) for i, t in cut]
    least = {}
    for i, f, _ in fps:
        group, todo = set(), [f]
        while todo:
            x = todo.pop()
            if x not in group:
                group.add(x)
                todo += [y for _, y, _ in fps if (x ^ y).bit_count() <= 2]
        least[i] = min(j for j, y, _ in fps if y in group)
    single = [(i, t) for i, _, t in fps if least[i] == i]
    bad = {d for d, _ in slow(single, items)}
    assert bad == {200, 201, 202, 203}
    t = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    want = sorted((i, len(ids := t.encode(x, add_special_tokens=False).ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(x.encode()).hexdigest()) for i, x in single if i not in bad)
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())) == want


def test_third_stage_does_not_broadcast_anchors(spark, monkeypatch):
    plans, own = [], simhash.star_components

    def seen(edges, *names):
        edges.collect()
        plans.append(edges._jdf.queryExecution().executedPlan().toString())
        return own(edges, *names)

    monkeypatch.setattr(simhash, "star_components", seen)
    docs = spark.createDataFrame([(i, f"some words {i // 2} of text {i // 2}") for i in range(40)], "doc_id long, text string")
    assert corpus_pipeline.simhash_near_dedup(spark, docs, "").count() == 20
    assert len(plans) == 1 and "BroadcastHashJoin" not in plans[0]


def test_driver_collects_its_garbage_before_tables_are_written(spark, monkeypatch):
    from skein import session

    full = lambda: list(spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans())[-1].getCollectionCount()
    monkeypatch.setattr(session, "HEAP_SHARE", 0.0)
    before = full()
    session.discard(session.materialize(spark.range(3)))
    assert full() > before
    monkeypatch.setattr(session, "HEAP_SHARE", 1.0)
    assert not session.collect_garbage(spark)


def test_driver_holds_one_array_of_labelled_terms():
    import tracemalloc

    import numpy as np

    r = np.random.default_rng(3)
    rows = (r.random((3000, quality.TERMS), np.float32) * (r.random((3000, quality.TERMS), np.float32) < 0.2)).astype(np.float32)
    labels, size = np.arange(3000) % 2, rows.nbytes
    plain = quality.Model(rows, labels)
    tracemalloc.start()
    try:
        lean = quality.Model(rows, labels, own=True)
        assert tracemalloc.get_traced_memory()[1] < size / 2
    finally:
        tracemalloc.stop()
    assert all(np.array_equal(getattr(plain, k), getattr(lean, k)) for k in ("idf", "project", "vectors"))


def test_driver_makes_no_vocabulary(spark, monkeypatch):
    from skein.llm import bpe

    def made(path):
        raise AssertionError("a table of the vocabulary on the driver")

    monkeypatch.setattr(bpe, "vocabulary", made)
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    assert corpus_pipeline.bpe_encoding(spark, docs, "").columns[0] == "doc_id"
