"""Near-duplicate embeddings: sorted one-dimensional projections, collisions counted per pair, cosines verified."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import materialise
from corpusloom.llm.components import connected_components

SIMILARITY = 0.9
#: Share of pairs at exactly the similarity that must reach the count; closer pairs reach it more often.
RECALL = 0.999
#: Collisions that make a pair a candidate.
COUNT = 2
#: Half a window around a query's projection, in standard deviations of the difference of a pair at the similarity.
WIDTH = 2.0
#: Vectors that a cell of a projection's order holds on average at most, and vectors of one block of a crowded cell.
CELL, BLOCK = 512, 2048
_ROWS = 128


@dataclass(frozen=True)
class Plan:
    """How many projections are sorted, how each order is parted, and how wide a window is."""

    bits: int
    projections: int
    window: float


def collide(similarity: float, bits: int, width: float = WIDTH, window: float | None = None) -> float:
    """The chance that a pair of this cosine collides in one projection: its signs agree and it lies within the window.

    A random direction parts two unit vectors with chance angle / pi; their projections on another
    one differ by a normal value whose deviation is their distance.
    """
    distance = math.sqrt(max(0.0, 2 - 2 * similarity))
    inside = math.erf(width / math.sqrt(2)) if window is None else 1.0 if not distance else math.erf(window / distance / math.sqrt(2))
    return (1 - math.acos(min(1.0, similarity)) / math.pi) ** bits * inside


def at_least(count: int, tries: int, chance: float) -> float:
    """The chance of ``count`` or more of ``tries`` independent events."""
    return 1 - sum(math.comb(tries, k) * chance**k * (1 - chance) ** (tries - k) for k in range(count))


@lru_cache(maxsize=64)
def calibrate(vectors: int, similarity: float = SIMILARITY, recall: float = RECALL, count: int = COUNT) -> Plan:
    """The fewest projections with which a pair at exactly the similarity collides ``count`` times with chance ``recall``.

    A window of one projection's order alone holds a constant share of all vectors, so the order is
    first parted by the signs of further projections, as many as leave ``CELL`` vectors a cell. The
    projections needed grow with about the fifth root of the vectors.
    """
    bits = max(0, math.ceil(math.log2(max(vectors, 1) / CELL)))
    chance, tries = collide(similarity, bits), count
    while at_least(count, tries, chance) < recall:
        tries += 1
    return Plan(bits, tries, WIDTH * math.sqrt(2 - 2 * similarity))


@lru_cache(maxsize=4)
def directions(dim: int, plan: Plan) -> np.ndarray:
    """Random normal directions, a column each: for every projection its own and those of its signs. Fixed by their number."""
    return np.random.default_rng(dim).standard_normal((dim, plan.projections * (plan.bits + 1)))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one in double precision; scaled first, so that no square overflows or vanishes."""
    out = vectors.astype(np.float64)
    out /= np.abs(out).max(axis=1, keepdims=True)
    return out / np.sqrt((out * out).sum(axis=1, keepdims=True))


def project(units: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """Of each row (columns: projections) the sign cell and the projected value."""
    cells = np.empty((len(units), plan.projections), np.int64)
    values = np.empty((len(units), plan.projections), np.float32)
    powers = np.int64(1) << np.arange(plan.bits, dtype=np.int64)
    for at in range(0, len(units), 1024):
        found = (units[at : at + 1024] @ directions(units.shape[1], plan)).reshape(-1, plan.projections, plan.bits + 1)
        values[at : at + 1024] = found[:, :, 0]
        cells[at : at + 1024] = (found[:, :, 1:] > 0) @ powers
    return cells, values


def linked_pairs(units: np.ndarray, table: int, plan: Plan, similarity: float, count: int = COUNT, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one cell of the order ``table`` that are linked and meet in no earlier order.

    The rows are sorted by their projection and each is compared with those in its window. Their
    collisions in all orders are counted; a pair that has ``count`` of them is verified by its
    cosine. With ``side`` only pairs of different sides count.
    """
    cells, values = project(units, plan)
    if plan.bits < 31:
        cells = cells.astype(np.int32)
    order = np.argsort(values[:, table], kind="stable")
    own = values[order, table]
    cells, values = np.ascontiguousarray(cells[order].T), np.ascontiguousarray(values[order].T)
    side = None if side is None else side[order]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for at in range(0, len(order), _ROWS):
        end = min(at + _ROWS, len(order))
        far = int(np.searchsorted(own, own[end - 1] + np.float32(plan.window), "right"))
        mine, theirs = np.arange(at, end)[:, None], np.arange(at, far)[None, :]
        base = (theirs > mine) & (own[at:far][None, :] - own[at:end][:, None] <= plan.window)
        if side is not None:
            base &= side[at:end][:, None] != side[at:far][None, :]
        flat = np.zeros(base.size, np.int16)
        for t in range(plan.projections):
            if t == table:
                flat += base.reshape(-1)
                continue
            met = np.flatnonzero(base & (cells[t, at:end][:, None] == cells[t, at:far][None, :]))
            i, j = np.divmod(met, far - at)
            met = met[np.abs(values[t, at + i] - values[t, at + j]) <= plan.window]
            if t < table:  # an earlier order judges this pair
                base.reshape(-1)[met] = False
            else:
                flat[met] += 1
            if not base.any():
                break
        i, j = np.divmod(np.flatnonzero(base.reshape(-1) & (flat >= count)), far - at)
        i, j = order[at + i], order[at + j]
        for k in range(0, len(i), 4096):
            a, b = i[k : k + 4096], j[k : k + 4096]
            good = np.einsum("ij,ij->i", units[a], units[b]) >= similarity
            found.append((a[good], b[good]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def roots(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row that each row is connected with."""
    label = np.arange(size)
    while True:
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if (label == before).all():
            return label


def usable(v: Column) -> Column:
    """Not null or empty, finite in every component, and not zero."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def _judge(plan: Plan, similarity: float):
    """The Arrow map over rows sorted by (dim, table, cell, p, q): links of each vector within its group, and its root there."""

    def judge(key: tuple, parts: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        whole = pa.Table.from_batches(parts)
        if whole.num_rows < 2:
            return None
        dim, table, _, p, q = key
        units = unit(whole.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
        cid, n = whole.column("cid").to_numpy(), whole.column("n").to_numpy()
        a, b = linked_pairs(units, table, plan, similarity, side=None if p == q else whole.column("own").to_numpy())
        if not len(a):
            return None
        links = np.zeros(len(cid), np.int64)
        np.add.at(links, a, n[b])
        np.add.at(links, b, n[a])
        some = np.flatnonzero(links)
        root = roots(len(cid), a, b)
        return pa.RecordBatch.from_arrays([pa.array(cid[some]), pa.array(links[some]), pa.array(cid[root[some]])], ["cid", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("dim", "t", "cell", "p", "q")
        key, parts = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k).to_numpy() for k in names]
            starts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
            for s, e in zip([0, *starts.tolist()], [*starts.tolist(), batch.num_rows], strict=True):
                here = tuple(int(c[s]) for c in columns)
                if key != here:
                    if parts and (out := judge(key, parts)):
                        yield out
                    key, parts = here, []
                parts.append(batch.slice(s, e - s))
        if parts and (out := judge(key, parts)):
            yield out

    return run


def links_of(classes: DataFrame, plan: Plan, similarity: float = SIMILARITY) -> DataFrame:
    """``cid, links, root`` of the vectors ``cid, n, v`` (distinct, usable): several rows a vector, whose links add up.

    Each vector goes to one cell of every order. A cell of more than ``BLOCK`` vectors is dealt over
    tasks as pairs of blocks, so a task holds two blocks at most and none of the cell's pairs is
    lost. Every pair is judged in the first order in which it collides, so no pair is counted twice
    and none leaves its task: a group of near copies sends one row a vector and task.
    """

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                lists = part.column("v")
                sizes = np.array([len(x) for x in lists], np.int64)
                cells = np.zeros((len(sizes), plan.projections), np.int64)
                for dim in np.unique(sizes).tolist():
                    rows = np.flatnonzero(sizes == dim)
                    some = lists.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                    cells[rows] = project(unit(some), plan)[0]
                coded = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * plan.projections), pa.array(cells.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*part.columns, coded], [*part.schema.names, "cells"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema)
    coded = materialise(classes.mapInArrow(code, f"{schema}, cells array<bigint>"), "coded")
    where = F.posexplode("cells").alias("t", "cell")
    dim = F.size("v").alias("dim")
    crowded = coded.select(dim, where).groupBy("dim", "t", "cell").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > BLOCK)
    crowded = materialise(crowded.select("dim", "t", "cell", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")), "crowded")
    placed = coded.select("cid", "n", "v", dim, where).join(crowded, ["dim", "t", "cell"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = placed.withColumn("own", F.pmod(F.xxhash64("cid"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keyed = own.select("dim", "t", "cell", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "cid", "n", "v")
    key = ["dim", "t", "cell", "p", "q"]
    return keyed.repartition(*key).sortWithinPartitions(*key).mapInArrow(_judge(plan, similarity), "cid bigint, links bigint, root bigint")


def link_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """One row per vector: ``vec_id, n_links`` (others within the cosine), ``component_id`` (smallest id reachable), ``kept``.

    Equal vectors are one class, compared once and counted with all its rows. Classes collide where
    both lie in the same sign cell of a projection's order and within a window around one another's
    value; pairs with ``COUNT`` collisions are verified in double precision. A pair at exactly the
    similarity is found with chance ``recall``, closer ones with more; none below it is linked.

    Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing
    and stay. Vectors of different lengths don't link. Rows that repeat an id are separate vectors;
    a null id comes last, so it stands for a component only where there is no other. No rows give
    no rows. Further columns are not read.
    """
    element = vectors.schema[vec_col].dataType.elementType.typeName()
    v = F.col(vec_col) if element in ("float", "double") else F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("vec_id"), v.alias("raw")).withColumn("fine", usable(F.col("raw")))
    # Adding zero makes the negative zero equal to the other one.
    zero = F.lit(0).cast(element if element in ("float", "double") else "double")
    rows = rows.select("vec_id", F.when(F.col("fine"), F.transform("raw", lambda x: x + zero)).alias("v")).withColumn("h", F.xxhash64("v"))
    grouped = rows.where(F.col("v").isNotNull()).groupBy("h", "v").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("rep"))
    classes = materialise(grouped.withColumn("cid", F.monotonically_increasing_id()), "vector-classes")
    plan = calibrate(classes.count(), similarity, recall)
    links = materialise(links_of(classes.select("cid", "n", "v"), plan, similarity), "links")
    summed = links.groupBy("cid").agg(F.sum("links").alias("links"))
    found = connected_components(links.where("cid <> root"), "cid", "root").select(F.col("node").alias("cid"), "component")
    judged = classes.drop("v").join(summed, "cid", "left").join(found, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    first = judged.groupBy("component").agg(F.min("rep").alias("component_id"))
    judged = judged.join(first, "component").select("cid", "component_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    known = classes.select("cid", "h", "v").join(judged, "cid").drop("cid")
    out = rows.where(F.col("v").isNotNull()).join(known, ["h", "v"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(F.col("v").isNull()).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionAll(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
