"""Embedding near-duplicates by NN-descent (operator 5).

1. Vectors are scaled to length one in double precision; equal ones with the same label are one class.
2. Every class gets a first neighbour list: for each of ``TABLES`` random sign codes the classes are sorted by (label, code),
   dealt out by range, and compared with the next ``WIDTH`` in that order.
3. NN-descent: each class's neighbours and (sampled by a grouped maximum) reverse neighbours are joined with each other, that
   is, neighbours of neighbours; a pair enters a list if it beats the list's last entry. Rounds go on until the lists gain
   next to nothing and no link.
4. Links are listed pairs with cosine >= threshold; their components come from distributed star rounds.
5. A list whose last entry is still a link is saturated and can't hold all links of its class. Such classes are compared with
   all classes of their label: in blocks of about ``BLOCK`` of one component, each with a centre and a radius, and a class of
   another component is compared with a block exactly unless it is too far from the centre to link with anything in it. What
   links so joins components.
6. Counts: a component is cut into blocks of about ``BLOCK`` classes and every two blocks of a component are compared exactly,
   each pair of blocks in a group of its own; only link counts leave a block, never pairs.
7. Audit: ``AUDIT`` classes are compared with all rows of their label in blocks. The recall is the mean, over those that have
   links, of the share of their links that was found; ``whole`` is the share of them that have all, so that none of their links
   leads to another component. If either is below ``TARGET``, more tables are added and steps 2 to 6 repeated; after ``TRIES``
   times every class is compared as in step 5. The recall is reported.

Vectors that are null, empty, zero, or hold null or non-finite components, and vectors with a null label, link with nothing.
Vectors of different lengths never link. Copies count as links of each other. Repeated ids are rows of their own; rows with a
null id count as links of others, and their component is that of their class. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import batches, whole_groups
from skein.plans.components import star_components
from skein.session import discard, materialize

THRESHOLD = 0.98
TABLES = 10
WIDTH = 6
NEIGHBOURS = 10
BLOCK = 256
CELL = 4096
ROUNDS = 6
AUDIT = 256
TARGET = 0.95
TRIES = 3


def unit(vector: list | None) -> bytes | None:
    """The vector scaled to length one, as doubles; None if it can link with nothing."""
    if not vector or any(x is None for x in vector):
        return None
    v = np.asarray(vector, np.float64)
    if not np.isfinite(v).all() or not (top := np.abs(v).max()):
        return None
    v = v / top  # so that squares neither overflow nor vanish
    return (v / np.sqrt((v * v).sum())).tobytes()


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.stack([np.frombuffer(x.as_buffer(), np.float64) for x in column])


def _classes(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    """All rows as (id, label, unit), and the classes (cls, label, dim, unit, copies, least)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [unit(v.as_py()) for v in batch.column(2)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.binary())], ["id", "label", "unit"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = materialize(batches(rows, run, "id long, label string, unit binary"), "units")
    known = rows.where("unit is not null and label is not null").groupBy("label", "unit").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("least"))
    known = known.select(F.monotonically_increasing_id().alias("cls"), "label", F.octet_length("unit").alias("dim"), "unit", "copies", "least")
    return rows, materialize(known, "classes")


def _seeds(classes: DataFrame, tables: int, bits: int, first: int) -> DataFrame:
    """(u, v, sim) from neighbours in the order of random sign codes."""

    def code(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        dims = np.array(batch.column("dim").to_pylist())
        for dim in np.unique(dims):
            part = batch.filter(pa.array(dims == dim))
            m = _matrix(part.column("unit"))
            for t in range(first, first + tables):
                planes = np.random.default_rng((t, int(dim))).standard_normal((m.shape[1], bits))
                codes = ((m @ planes) > 0) @ (1 << np.arange(bits, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), t), pa.int32()), part.column("label"), part.column("dim"), pa.array(codes, pa.int64()), part.column("cls"), part.column("unit")], ["t", "label", "dim", "code", "cls", "unit"])

    coded = batches(classes.select("cls", "label", "dim", "unit"), code, "t int, label string, dim int, code long, cls long, unit binary")
    order = ["t", "label", "dim", "code", "cls"]

    def compare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: pa.Table | None = None
        for batch in it:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([tail, rows]).combine_chunks() if tail is not None else rows
            tail = rows.slice(max(0, rows.num_rows - WIDTH))
            yield from _adjacent(rows)

    return coded.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(compare, "u long, v long, sim double")


def _adjacent(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    keys = list(zip(*(rows.column(c).to_pylist() for c in ("t", "label", "dim")), strict=True))
    starts = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]] + [len(keys)]
    ids = np.array(rows.column("cls").to_pylist(), np.int64)
    units = rows.column("unit")
    for s, e in zip(starts, starts[1:], strict=False):
        if e - s < 2:
            continue
        m = _matrix(units.slice(s, e - s))
        for gap in range(1, min(WIDTH, e - s - 1) + 1):
            sims = np.einsum("ij,ij->i", m[:-gap], m[gap:])
            a, b = ids[s : e - gap], ids[s + gap : e]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([a, b])), pa.array(np.concatenate([b, a])), pa.array(np.concatenate([sims, sims]))], ["u", "v", "sim"])


def _lists(edges: DataFrame, size: int) -> DataFrame:
    """(u, last, near): the ``size`` nearest of each class and the similarity of the last (-1 if there is room).

    What is gathered for one class is what a few tables or neighbours suggest, not its whole group.
    """
    near = F.slice(F.sort_array(F.collect_set(F.struct("sim", "v")), asc=False), 1, size)
    made = edges.groupBy("u").agg(near.alias("near"))
    last = F.when(F.size("near") < size, F.lit(-1.0)).otherwise(F.element_at("near", -1)["sim"])
    return made.select("u", last.alias("last"), "near")


def _edges(lists: DataFrame) -> DataFrame:
    return lists.select("u", F.explode("near").alias("n")).select("u", F.col("n.v").alias("v"), F.col("n.sim").alias("sim"))


def _round(classes: DataFrame, lists: DataFrame, size: int) -> DataFrame:
    """One step of NN-descent: compare the members of each class's neighbourhood with each other."""
    out = _edges(lists)
    # of all that list a class, the nearest per hash bucket: a bounded sample, combined on the map side
    back = out.groupBy("v", F.pmod(F.xxhash64("u"), F.lit(size)).alias("bucket")).agg(F.max(F.struct("sim", "u")).alias("m"))
    around = out.select(F.col("u").alias("x"), F.col("v").alias("m")).unionAll(back.select(F.col("v").alias("x"), F.col("m.u").alias("m"))).distinct()
    members = classes.select(F.col("cls"), "unit").join(lists.select("u", "last"), F.col("cls") == F.col("u"))
    told = around.join(members.select("cls", "unit", "last"), F.col("m") == F.col("cls")).select("x", "m", "last", "unit")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in whole_groups(it, ["x"]):
            ids, last = np.array(rows.column("m").to_pylist(), np.int64), np.array(rows.column("last").to_pylist())
            m = _matrix(rows.column("unit")) if len(set(map(len, rows.column("unit").to_pylist()))) == 1 else None
            us, vs, ss = [], [], []
            for s, e in zip(starts, starts[1:], strict=False):
                part = m[s:e] if m is not None else _matrix(rows.column("unit").slice(s, e - s))
                sims = part @ part.T
                np.fill_diagonal(sims, -2)
                i, j = np.nonzero(sims > last[s:e, None])
                us.append(ids[s + i])
                vs.append(ids[s + j])
                ss.append(sims[i, j])
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs)), pa.array(np.concatenate(ss))], ["u", "v", "sim"])

    found = told.repartition("x").sortWithinPartitions("x").mapInArrow(run, "u long, v long, sim double")
    best = found.groupBy("u", "v").agg(F.max("sim").alias("sim"))
    # both products of a pair may differ in the last bit; the list keeps one entry a neighbour
    return _lists(out.unionAll(best.select("u", "v", "sim")).groupBy("u", "v").agg(F.max("sim").alias("sim")), size)


def _descend(classes: DataFrame, seeds: DataFrame, size: int, rounds: int, threshold: float) -> DataFrame:
    lists = materialize(_lists(seeds.groupBy("u", "v").agg(F.max("sim").alias("sim")), size), "lists")
    links = F.size(F.filter("near", lambda x: x["sim"] >= threshold))
    quality = lambda d: tuple(x or 0 for x in d.agg(F.sum(F.aggregate("near", F.lit(0.0), lambda a, x: a + x["sim"])), F.sum(links)).first())
    before = quality(lists)
    for _ in range(rounds):
        new = materialize(_round(classes, lists, size), "lists")
        discard(lists)
        lists, after = new, quality(new)
        if after[0] - before[0] <= 1e-3 * abs(after[0]) and after[1] <= before[1]:
            break
        before = after
    return lists


def _forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a matrix of links: the root row of every row and column that has a link, as (rows, columns, roots of both)."""
    rows, cols = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
    near = near[np.ix_(rows, cols)]
    up = rows.copy()
    while len(rows):
        down = np.where(near, up[:, None], np.iinfo(np.int64).max).min(0)
        new = np.minimum(up, np.where(near, down[None], np.iinfo(np.int64).max).min(1))
        if (new == up).all():
            return rows, cols, np.concatenate([up, down])
        up = new
    return rows, cols, up


def _bridges(classes: DataFrame, member: DataFrame, asked: DataFrame, threshold: float) -> DataFrame:
    """(u, v): links that join the component of an ``asked`` class (cls) to any other class of its label, exactly.

    Of the links between a block and the classes that come near it only a spanning forest leaves the task.
    """
    home = classes.select("cls", "label", "dim", "unit").join(member.withColumnRenamed("cls", "_m"), F.col("cls") == F.col("_m"), "left")
    home = materialize(home.select("cls", "label", "dim", "unit", F.coalesce("component", "cls").alias("component")), "home")
    own = home.join(asked.select(F.col("cls").alias("_a")), F.col("cls") == F.col("_a"), "left_semi")
    sizes = own.groupBy(F.col("component").alias("_o")).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("cls", F.lit(11)), F.col("blocks")).cast("int").alias("block")
    blocks = materialize(own.join(sizes, F.col("component") == F.col("_o")).select("component", block, "label", "dim", "cls", "unit"), "blocks")

    def centre(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in whole_groups(it, ["component", "block"]):
            first = rows.take(pa.array(starts[:-1])).select(["component", "block", "label", "dim"])
            units, radii = [], []
            for s, e in zip(starts, starts[1:], strict=False):
                m = _matrix(rows.column("unit").slice(s, e - s))
                c = m.mean(0)
                c = c / n if (n := np.sqrt((c * c).sum())) > 1e-3 else m[0]
                units.append(c.tobytes())
                radii.append(float(np.arccos(np.clip(m @ c, -1, 1)).max()))
            made = first.append_column("unit", pa.array(units, pa.binary())).append_column("radius", pa.array(radii, pa.float64()))
            yield from made.to_batches()

    keys = ["component", "block"]
    made = blocks.repartition(*keys).sortWithinPartitions(*keys)
    hubs = materialize(made.mapInArrow(centre, "component long, block int, label string, dim int, unit binary, radius double"), "hubs")
    cells = home.groupBy(F.col("label").alias("_l"), F.col("dim").alias("_d")).agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("cells"))
    cells = materialize(cells.join(hubs.select("label", "dim").distinct(), (F.col("_l") == F.col("label")) & (F.col("_d") == F.col("dim")), "left_semi"), "cells")
    where = lambda d: d.join(cells, (F.col("label") == F.col("_l")) & (F.col("dim") == F.col("_d")))
    cell = F.pmod(F.xxhash64("cls", F.lit(13)), F.col("cells")).cast("int").alias("cell")
    guests = where(home).select("label", "dim", cell, F.lit(-1).alias("block"), "component", "cls", "unit", F.lit(-1.0).alias("radius"))
    hosts = where(hubs).select("label", "dim", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"), "block", "component", F.lit(-1).cast("long").alias("cls"), "unit", "radius")
    reach = float(np.arccos(threshold)) + 1e-6

    def visit(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in whole_groups(it, ["label", "dim", "cell"]):
            block, radius = np.array(rows.column("block").to_pylist()), np.array(rows.column("radius").to_pylist())
            ids, component = np.array(rows.column("cls").to_pylist(), np.int64), np.array(rows.column("component").to_pylist(), np.int64)
            for s, e in zip(starts, starts[1:], strict=False):
                m, host = _matrix(rows.column("unit").slice(s, e - s)), np.flatnonzero(block[s:e] >= 0)
                guest = np.flatnonzero(block[s:e] < 0)
                for k in range(0, len(host), BLOCK):
                    at = host[k : k + BLOCK]
                    close = np.arccos(np.clip(m[guest] @ m[at].T, -1, 1)) <= radius[s + at][None] + reach
                    i, j = np.nonzero(close & (component[s + guest][:, None] != component[s + at][None]))
                    yield pa.RecordBatch.from_arrays([pa.array(component[s + at[j]]), pa.array(block[s + at[j]].astype(np.int32)), pa.array(ids[s + guest[i]])], ["component", "block", "cls"])

    keys = ["label", "dim", "cell"]
    visits = guests.unionAll(hosts).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(visit, "component long, block int, cls long")
    visits = materialize(visits, "visits")
    parts = visits.groupBy(F.col("component").alias("_c"), F.col("block").alias("_b")).agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("parts"))
    at = lambda d: d.join(parts, (F.col("component") == F.col("_c")) & (F.col("block") == F.col("_b")))
    came = at(visits).join(home.select(F.col("cls").alias("_h"), "unit"), F.col("cls") == F.col("_h"))
    came = came.select("component", "block", F.pmod(F.xxhash64("cls", F.lit(17)), F.col("parts")).cast("int").alias("part"), F.lit(True).alias("guest"), "cls", "unit")
    stay = at(blocks).select("component", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("guest"), "cls", "unit")

    def compare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in whole_groups(it, ["component", "block", "part"]):
            guest, ids = np.array(rows.column("guest").to_pylist()), np.array(rows.column("cls").to_pylist(), np.int64)
            for s, e in zip(starts, starts[1:], strict=False):
                m, g = _matrix(rows.column("unit").slice(s, e - s)), guest[s:e]
                host, own = ids[s:e][~g], ids[s:e][g]
                near, cols, roots = _forest((m[~g] @ m[g].T) >= threshold)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([host[near], own[cols]])), pa.array(host[roots])], ["u", "v"])

    keys = ["component", "block", "part"]
    found = came.unionAll(stay).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(compare, "u long, v long")
    return materialize(found.where("u <> v").distinct(), "bridges")


def _count_links(classes: DataFrame, member: DataFrame, threshold: float) -> DataFrame:
    """(cls, others): linked copies of other classes, exactly, by comparing every two blocks of a component."""
    sizes = member.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    placed = member.join(sizes, "component").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    known = placed.join(classes.select(F.col("cls").alias("_c"), "unit", "copies"), F.col("cls") == F.col("_c"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = known.select("component", "cls", "block", "copies", "unit", other.alias("other"))
    dealt = dealt.select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "cls", "copies", "unit")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in whole_groups(it, ["component", "i", "j"]):
            ids, copies = np.array(rows.column("cls").to_pylist(), np.int64), np.array(rows.column("copies").to_pylist(), np.int64)
            block = np.array(rows.column("block").to_pylist())
            total = np.zeros(len(ids), np.int64)
            first, second = rows.column("i").to_pylist(), rows.column("j").to_pylist()
            for s, e in zip(starts, starts[1:], strict=False):
                m = _matrix(rows.column("unit").slice(s, e - s))
                near = (m @ m.T) >= threshold
                if first[s] == second[s]:
                    np.fill_diagonal(near, False)
                else:
                    near &= block[s:e, None] != block[None, s:e]
                total[s:e] = near @ copies[s:e]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], ["cls", "others"])

    keys = ["component", "i", "j"]
    counted = dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "cls long, others long")
    return counted.groupBy("cls").agg(F.sum("others").alias("others"))


def _audit(classes: DataFrame, found: DataFrame, threshold: float, queries: int) -> tuple[float, float]:
    """Of a bounded set of classes, those with links, against all rows of their label in blocks: mean share of links found, and share of classes with all."""
    asked = classes.orderBy(F.xxhash64("cls", F.lit(7))).limit(queries).select("cls", "label", "dim", "unit").toArrow()
    if not asked.num_rows:
        return 1.0, 1.0
    by: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
    keys = list(zip(asked.column("label").to_pylist(), asked.column("dim").to_pylist(), strict=True))
    for k in set(keys):
        rows = asked.filter(pa.array([x == k for x in keys]))
        by[k] = np.array(rows.column("cls").to_pylist(), np.int64), _matrix(rows.column("unit"))
    shared = classes.sparkSession.sparkContext.broadcast(by)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own = list(zip(batch.column("label").to_pylist(), batch.column("dim").to_pylist(), strict=True))
        ids, copies = np.array(batch.column("cls").to_pylist(), np.int64), np.array(batch.column("copies").to_pylist(), np.int64)
        for k in set(own) & set(shared.value):
            at = np.flatnonzero([x == k for x in own])
            queries_, m = shared.value[k]
            near = (m @ _matrix(batch.column("unit").take(pa.array(at))).T) >= threshold
            near &= queries_[:, None] != ids[at][None]
            yield pa.RecordBatch.from_arrays([pa.array(queries_), pa.array(near @ copies[at])], ["q", "n"])

    true = batches(classes.select("cls", "label", "dim", "copies", "unit"), run, "q long, n long").groupBy("q").agg(F.sum("n").alias("n"))
    share = (F.coalesce("others", F.lit(0)) / F.col("n")).alias("share")
    both = true.where("n > 0").join(found, F.col("q") == F.col("cls"), "left").select(share).agg(F.avg("share"), F.avg((F.col("share") >= 1).cast("int"))).first()
    return (1.0, 1.0) if both[0] is None else (both[0], both[1])


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, audit: int = AUDIT, report: dict | None = None) -> DataFrame:
    """(id, n_links, component_id, kept) for every row; ``report`` receives the audited recall, the share of whole classes and the tables used."""
    rows, classes = _classes(df, id_col, vector_col, label_col)
    n = classes.count()
    bits = min(48, max(8, n.bit_length() + 3))
    tables, seeds = TABLES, None
    for tried in range(TRIES):
        more = materialize(_seeds(classes, tables if not tried else TABLES, bits, 0 if not tried else tables - TABLES), "seeds")
        seeds = more if seeds is None else materialize(seeds.unionAll(more), "seeds")
        lists = _descend(classes, seeds, NEIGHBOURS, ROUNDS, threshold)
        linked = materialize(_edges(lists).where(F.col("sim") >= threshold).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "links")
        member = materialize(star_components(linked).select(F.col("id").alias("cls"), "component"), "members")
        full = lists.where(F.col("last") >= threshold).select(F.col("u").alias("cls"))
        if not full.isEmpty():
            linked = linked.unionAll(_bridges(classes, member, full, threshold))
            member = materialize(star_components(linked).select(F.col("id").alias("cls"), "component"), "members")
        found = materialize(_count_links(classes, member, threshold), "counts")
        recall, whole = _audit(classes, found, threshold, audit)
        if min(recall, whole) >= TARGET:
            break
        tables += TABLES if tried < TRIES - 1 else 0
    else:
        linked = linked.unionAll(_bridges(classes, member, classes, threshold))
        member = materialize(star_components(linked).select(F.col("id").alias("cls"), "component"), "members")
        found = materialize(_count_links(classes, member, threshold), "counts")
        recall, whole = _audit(classes, found, threshold, audit)
        if min(recall, whole) < TARGET:
            raise RuntimeError(f"recall {recall}, whole {whole} after comparing all pairs of a label")
    if report is not None:
        report.update(recall=recall, whole=whole, tables=tables, classes=n)
    known = classes.join(member.withColumnRenamed("cls", "_m"), F.col("cls") == F.col("_m"), "left").join(found.withColumnRenamed("cls", "_f"), F.col("cls") == F.col("_f"), "left")
    known = known.select("label", "unit", "least", F.coalesce("component", "cls").alias("root"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    known = materialize(known, "rooted")
    smallest = known.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "_root")
    named = known.join(smallest, F.col("root") == F.col("_root")).select(F.col("label").alias("_l"), F.col("unit").alias("_u"), "n_links", "component_id")
    out = rows.join(named, (F.col("label") == F.col("_l")) & (F.col("unit") == F.col("_u")), "left")
    component = F.when(F.col("unit").isNull() | F.col("label").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


#: The query's rows, for DuckDB; all pairs of a label, so for small tables.
ORACLE = """
WITH RECURSIVE good AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND list_sum(list_transform(embedding, lambda x: CASE WHEN x IS NULL OR NOT isfinite(x) THEN 1 ELSE 0 END)) = 0
    AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0
),
links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98
),
reach AS (
  SELECT u AS vec_id, u AS other FROM links
  UNION SELECT r.vec_id, l.v FROM reach r JOIN links l ON r.other = l.u
),
comp AS (SELECT vec_id, min(other) AS least FROM reach GROUP BY vec_id),
cnt AS (SELECT u AS vec_id, count(*) AS n FROM links GROUP BY u)
SELECT e.vec_id, CAST(coalesce(cnt.n, 0) AS BIGINT) AS n_links, coalesce(comp.least, e.vec_id) AS component_id,
  e.vec_id = coalesce(comp.least, e.vec_id) AS kept
FROM embeddings e LEFT JOIN comp USING (vec_id) LEFT JOIN cnt USING (vec_id)
"""
