"""Benchmark decontamination with SimHash windows (operator 3), in DataFrame functions only.

Words are runs of letters, marks and digits, lower-cased; shingles are ``SIZE`` words (an item with fewer words is one
shingle). A window is as many words of a document as a benchmark item has, at any place. Only windows are taken that hold
as many positions with shingles of the item as ``THRESHOLD`` needs: the shared weight can't be more than those.

A window's fingerprint is the SimHash of its shingles. Fingerprints of windows and of items of the same length are
compared by multi-index Hamming blocks: 64 bits are cut into ``BLOCKS`` blocks, and an item is entered under its own
value of each block and every value one bit away. Two fingerprints within ``RADIUS = 2 * BLOCKS - 1`` bits agree on some
block up to one bit, so every such pair meets. Candidates are then verified by exact similarity of the weighted
shingles, weights being counts: shared weight over united weight, ``THRESHOLD`` or more.

Null and empty texts have no words and match nothing, as do items without words. Null ids are kept as they are.
Rows that repeat, or share an id, are told apart by their text. Other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.session import discard, materialize

SIZE = 5
THRESHOLD = 0.8
BLOCKS = 10
RADIUS = 2 * BLOCKS - 1
_WORD = r"[\p{L}\p{M}\p{N}]+"


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(_WORD), F.lit(0))


def _hashes(size: int) -> Column:
    """Hashes of the shingles of the array column ``words``, by position."""
    at = lambda i: F.xxhash64(*(F.get("words", i + k) for k in range(size)))
    return F.when(F.size("words") >= size, F.transform(F.sequence(F.lit(0), F.size("words") - size), at)).otherwise(F.array().cast("array<bigint>"))


def _fingerprints(rows: DataFrame, *keys: str) -> DataFrame:
    """SimHash (``fp``) and count (``total``) of the ``h`` of each group.

    32 sums hold the 64 bit counts, two in each long, so that partial sums combine before the shuffle.
    """
    lanes = F.lit(0x0000000100000001).cast("long")
    sums = [F.sum(F.shiftrightunsigned("h", b).bitwiseAND(lanes)).alias(f"_s{b}") for b in range(32)]
    made = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), *sums)
    low = F.lit(0xFFFFFFFF).cast("long")
    fp = F.lit(0).cast("long")
    for b in range(32):
        for half in (0, 1):
            count = F.shiftrightunsigned(f"_s{b}", 32 * half).bitwiseAND(low)
            fp = fp.bitwiseOR(F.shiftleft((count * 2 > F.col("total")).cast("long"), b + 32 * half))
    return made.select(*keys, "total", fp.alias("fp"))


def _blocks(fp: str, flips: bool) -> Column:
    """(block, value) for each block of a fingerprint; with ``flips`` also the values one bit away."""
    out = []
    for k in range(BLOCKS):
        first, end = 64 * k // BLOCKS, 64 * (k + 1) // BLOCKS
        value = F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << (end - first)) - 1).cast("long"))
        for bit in [None, *range(end - first)] if flips else [None]:
            out.append(F.struct(F.lit(k).alias("block"), (value if bit is None else value.bitwiseXOR(F.lit(1 << bit).cast("long"))).alias("value")))
    return F.explode(F.array(*out))


def items_of(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, length, size, at, h): the shingles of every item by position; ``size`` is words per shingle."""
    split = benchmark.select(F.col(id_col).alias("item"), _words(F.col(text_col)).alias("words")).where(F.size("words") > 0).distinct()
    whole = F.array(F.xxhash64(*(F.get("words", F.lit(k)) for k in range(SIZE))))
    short = [F.when(F.size("words") == k, F.array(F.xxhash64(*(F.get("words", F.lit(i)) for i in range(k))))) for k in range(1, SIZE)]
    hashes = F.coalesce(*short, F.when(F.size("words") == SIZE, whole), _hashes(SIZE))
    shape = split.select("item", F.size("words").alias("length"), F.least(F.size("words"), F.lit(SIZE)).alias("size"), hashes.alias("hashes"))
    return shape.select("item", "length", "size", F.posexplode("hashes").alias("at", "h"))


def matches(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc, text hash, item, start, similarity) for every window that reaches ``threshold``."""
    # written, so that the planner knows its size: benchmarks that are small are broadcast, others are joined by hash
    items = materialize(items_of(benchmark, item_id, item_text), "items")
    sizes = sorted(r[0] for r in items.select("size").distinct().collect()) or [SIZE]  # 1 to SIZE: five rows at most
    known = materialize(items.select("size", "h").distinct(), "known").select(F.col("size").alias("s"), F.col("h").alias("k"))

    texts = df.select(F.col(id_col).alias("doc"), F.xxhash64(F.col(text_col).cast("string"), F.octet_length(F.col(text_col).cast("string"))).alias("text_hash"), F.col(text_col).cast("string").alias("text"))

    def shingles(rows: DataFrame) -> DataFrame:
        split = rows.select("doc", "text_hash", _words(F.col("text")).alias("words"))
        made = [split.select("doc", "text_hash", F.size("words").alias("n"), F.lit(s).alias("size"), F.posexplode(_hashes(s)).alias("p", "h")) for s in sizes]
        for more in made[1:]:
            made[0] = made[0].unionAll(more)
        return made[0]

    found = shingles(texts).join(known, (F.col("h") == F.col("k")) & (F.col("size") == F.col("s")), "left_semi")
    hits = materialize(found.distinct(), "hits")
    same = lambda a, b: a["doc"].eqNullSafe(b["doc"]) & (a["text_hash"] == b["text_hash"])

    # every window, kept inside the document, that holds enough positions with shingles of one item
    on = items.select("item", "length", F.col("size").alias("s"), F.col("h").alias("k")).distinct()
    places = hits.join(on, (F.col("h") == F.col("k")) & (F.col("size") == F.col("s"))).groupBy("doc", "text_hash", "n", "size", "length", "item").agg(F.array_sort(F.collect_set("p")).alias("at"))
    places = places.withColumn("words", F.least("n", "length")).withColumn("own", F.col("words") - F.col("size") + 1)
    least = F.ceil((F.col("own") + F.col("length") - F.col("size") + 1) * (threshold / (1 + threshold)) - 1e-9)
    places = places.withColumn("need", F.greatest(F.lit(1), least.cast("int"))).where(F.size("at") >= F.col("need"))
    runs = F.transform(F.sequence(F.lit(0), F.size("at") - F.col("need")), lambda i: F.struct(F.get("at", i).alias("first"), F.get("at", i + F.col("need") - 1).alias("last")))
    runs = F.filter(runs, lambda x: x["last"] - x["first"] < F.col("own"))
    starts = F.flatten(F.transform(runs, lambda x: F.sequence(F.greatest(F.lit(0), x["last"] - F.col("own") + 1), F.least(x["first"], F.col("n") - F.col("words")))))
    windows = places.select("doc", "text_hash", "size", "length", "words", F.explode(F.array_distinct(starts)).alias("start")).distinct()
    windows = materialize(windows, "windows")

    holders = materialize(hits.select(F.col("doc").alias("d"), F.col("text_hash").alias("t")).distinct(), "holders")
    inside = texts.join(holders, F.col("doc").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t")), "left_semi").dropDuplicates(["doc", "text_hash"])
    spread = windows.select(F.col("doc").alias("d"), F.col("text_hash").alias("t"), F.col("size").alias("s"), "length", "start", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("words") - F.col("size"))).alias("q"))
    by_place = F.col("doc").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t")) & (F.col("p") == F.col("q")) & (F.col("size") == F.col("s"))
    # the planner sees the size of the windows, not of their places, so it must not choose to broadcast them
    content = materialize(shingles(inside).join(spread.hint("merge"), by_place).select("doc", "text_hash", "size", "length", "start", "h"), "content")

    window_fp = _fingerprints(content, "doc", "text_hash", "size", "length", "start")
    item_fp = _fingerprints(items, "item", "size", "length")
    entries = item_fp.select("item", F.col("length").alias("l"), F.col("fp").alias("item_fp"), F.col("total").alias("item_total"), _blocks("fp", True).alias("e"))
    probes = window_fp.select("doc", "text_hash", "size", "length", "start", "fp", "total", _blocks("fp", False).alias("b"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS
    meet = (F.col("length") == F.col("l")) & (F.col("b.block") == F.col("e.block")) & (F.col("b.value") == F.col("e.value")) & near
    candidates = probes.join(entries, meet).select("doc", "text_hash", "length", "start", "total", "item", "item_total").distinct()

    weights = content.groupBy("doc", "text_hash", "length", "start", "h").agg(F.count(F.lit(1)).alias("w"))
    item_weights = items.groupBy(F.col("item").alias("i"), F.col("h").alias("k")).agg(F.count(F.lit(1)).alias("v"))
    c, w = candidates.alias("c"), weights.alias("w")
    pair = c.join(w, F.col("c.doc").eqNullSafe(F.col("w.doc")) & (F.col("c.text_hash") == F.col("w.text_hash")) & (F.col("c.length") == F.col("w.length")) & (F.col("c.start") == F.col("w.start")))
    pair = pair.select("c.doc", "c.text_hash", "c.start", "c.length", "item", "total", "item_total", "h", "w.w")
    shared = pair.join(item_weights, F.col("item").eqNullSafe(F.col("i")) & (F.col("h") == F.col("k")))
    scored = shared.groupBy("doc", "text_hash", "item", "start", "length", "total", "item_total").agg(F.sum(F.least("w", "v")).alias("both"))
    similarity = F.col("both") / (F.col("total") + F.col("item_total") - F.col("both"))
    scored = scored.select("doc", "text_hash", "item", "start", similarity.alias("similarity"))
    out = materialize(scored.where(F.col("similarity") >= threshold), "matches")
    discard(items, known, hits, windows, holders, content)
    return out


def contaminated(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc id, item id, similarity, start): the best window of every document for each item that it contains."""
    found = matches(df, benchmark, id_col, text_col, item_id, item_text, threshold)
    best = found.groupBy("doc", "item").agg(F.max(F.struct(F.col("similarity"), (-F.col("start")).alias("s"))).alias("b"))
    return best.select(F.col("doc").alias(id_col), F.col("item").alias(item_id), F.col("b.similarity").alias("similarity"), (-F.col("b.s")).alias("start"))


def decontaminate(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``df`` without those whose text holds a benchmark item."""
    found = matches(df, benchmark, id_col, text_col, item_id, item_text, threshold)
    away = materialize(found.select(F.col("doc").alias("_d"), F.col("text_hash").alias("_t")).distinct(), "away")
    discard(found)
    own = F.xxhash64(F.col(text_col).cast("string"), F.octet_length(F.col(text_col).cast("string")))
    return df.join(away, F.col(id_col).eqNullSafe(F.col("_d")) & (own == F.col("_t")), "left_anti")


#: The query's rows, for DuckDB: every window that shares a shingle with an item is compared on words, without fingerprints.
ORACLE = """
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{M}\\p{N}]+') AS w FROM documents),
i AS (SELECT item_id, w, len(w) AS n, least(len(w), 5) AS k FROM (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{M}\\p{N}]+') AS w FROM benchmark) WHERE len(w) > 0),
ig AS (SELECT item_id, n, k, array_to_string(w[p:p + k - 1], ' ') AS g FROM (SELECT *, unnest(range(1, n - k + 2)) AS p FROM i)),
iv AS (SELECT item_id, n, k, g, count(*) AS v FROM ig GROUP BY ALL),
dg AS (SELECT doc_id, len(w) AS m, k, p, array_to_string(w[p:p + k - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM i))),
hits AS (SELECT DISTINCT doc_id, m, item_id, n, k, p FROM dg JOIN iv USING (k, g)),
win AS (
  SELECT DISTINCT doc_id, item_id, n, k, least(m, n) AS l, unnest(range(greatest(1, p + k - least(m, n)), least(p, m - least(m, n) + 1) + 1)) AS s FROM hits),
wv AS (
  SELECT win.doc_id, item_id, n, win.k, l, s, g, count(*) AS u FROM win JOIN dg ON dg.doc_id = win.doc_id AND dg.k = win.k AND p BETWEEN s AND s + l - win.k
  GROUP BY ALL),
both_ AS (SELECT doc_id, item_id, s, l - k + 1 + n - k + 1 AS total, sum(least(u, v)) AS shared FROM wv JOIN iv USING (item_id, n, k, g) GROUP BY doc_id, item_id, s, l, k, n),
scored AS (SELECT doc_id, item_id, s - 1 AS start, CAST(shared AS DOUBLE) / CAST(total - shared AS DOUBLE) AS similarity FROM both_)
SELECT doc_id, item_id, max(similarity) AS similarity, CAST(arg_min(start, {'a': -similarity, 'b': start}) AS INTEGER) AS start FROM scored WHERE similarity >= 0.8 GROUP BY doc_id, item_id
"""
