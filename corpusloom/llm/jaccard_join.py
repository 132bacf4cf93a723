"""N-gram Jaccard join: a forest of sorted MinHash prefix tries finds candidates, the word shingles themselves decide."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import fresh, materialise, shingle_hashes, words
from corpusloom.llm.components import connected_components

SHINGLE = 5
SIMILARITY = 0.8
#: Tries of the forest, and labels of each: every trie sorts the texts by its own run of MinHash labels.
TREES, LABELS = 32, 10
#: Share of pairs of the least similarity that a text can be linked by which the forest must bring together.
RECALL = 0.999
#: Sets up to this size are searched by the least similarity that they can have, larger ones by the threshold.
SHORT = 512
#: Representatives, and shingles, that one task compares with one another or with as many others.
BLOCK, BLOCK_SHINGLES = 512, 400_000


def least_similarity(size: int, similarity: float = SIMILARITY) -> float | None:
    """The lowest similarity from the threshold on that a set of ``size`` shingles can have with another set; None if there is none.

    Sets of a and b with c in common have c / (a + b - c), so short texts can't be linked by just any value.
    """
    best = None
    for other in range(max(1, math.ceil(similarity * size - 1e-9)), math.floor(size / similarity + 1e-9) + 1):
        common = math.ceil(similarity * (size + other) / (1 + similarity) - 1e-9)
        if common <= min(size, other) and not common == size == other:
            found = common / (size + other - common)
            best = found if best is None else min(best, found)
    return best


@lru_cache(maxsize=4096)
def matched_depth(size: int, similarity: float = SIMILARITY, trees: int = TREES, labels: int = LABELS, recall: float = RECALL) -> int | None:
    """Labels of a matched prefix down to which a text of ``size`` shingles is searched; None if nothing can be linked to it.

    Two texts agree on one label with probability J, so on a prefix of d in one trie with J^d. The
    prefix starts at its full length and is shortened, one label at a time, until the forest
    reaches the recall for the least similarity that the text can be linked by: 1 - (1 - J^d)^trees.
    """
    least = least_similarity(size, similarity) if size <= SHORT else similarity
    if least is None:
        return None
    for depth in range(labels, 0, -1):
        if 1 - (1 - least**depth) ** trees >= recall:
            return depth
    raise ValueError("the recall needs more tries")


@lru_cache(maxsize=4096)
def depth_mask(size: int, similarity: float = SIMILARITY, trees: int = TREES, labels: int = LABELS, recall: float = RECALL) -> int:
    """The depths at which a text stands in the tries, as bits: its own, and those at which texts that may be linked to it search."""
    own = matched_depth(size, similarity, trees, labels, recall)
    if own is None:
        return 0
    low, high = max(1, math.ceil(similarity * size - 1e-9)), math.floor(size / similarity + 1e-9)
    found = {matched_depth(n, similarity, trees, labels, recall) for n in range(min(low, SHORT + 1), min(high, SHORT + 1) + 1)}
    return sum(1 << d for d in found | {own} if d is not None and d <= own)


class MinHasher:
    """MinHash labels of one byte by multiply-shift hashing of 32-bit shingle hashes; fixed by its seed.

    Different minima share a label once in 256: that adds a few candidates and loses none.
    """

    def __init__(self, count: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.a = (rng.integers(0, 2**31, count, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
        self.b = rng.integers(0, 2**32, count, dtype=np.uint32)[:, None]

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        low = (shingles >> np.uint64(32)).astype(np.uint32)
        out = np.full(len(self.a), np.uint32(0xFFFFFFFF))
        for at in range(0, len(low), 256):  # a long text must not make a large matrix
            out = np.minimum(out, (self.a * low[at : at + 256] + self.b).min(axis=1))
        # The minimum itself is small, so its bits are mixed before one byte of them is kept.
        mixed = (out ^ (out >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        return (mixed >> np.uint32(24)).astype(np.uint8)


def set_key(shingles: np.ndarray) -> bytes:
    """128 bits that stand for a set of shingles."""
    return xxhash.xxh3_128_digest(shingles.tobytes())


def signatures(rows: DataFrame, size: int, similarity: float, trees: int, labels: int, recall: float) -> DataFrame:
    """``doc_id, sum, set_key, shingles, depths, labels`` of every row of ``doc_id, sum, text``; texts without words have null keys.

    ``shingles`` counts them; ``depths`` is their ``depth_mask``; ``labels`` are those of all tries
    in a row, one byte each.
    """
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, sum bigint, set_key binary, shingles int, depths int, labels binary"

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, long = MinHasher(trees * labels), depth_mask(max(2 * SHORT, int(2 * SHORT / similarity)), similarity, trees, labels, recall)
        for batch in batches:
            keys, counts, found = [], [], []
            for text in batch.column("text").to_pylist():
                shingles = shingle_hashes(words(text), size)
                keys.append(set_key(shingles) if len(shingles) else None)
                counts.append(len(shingles))
                found.append(hasher(shingles).tobytes() if len(shingles) else None)
            masks = [depth_mask(n, similarity, trees, labels, recall) if n <= SHORT / similarity else long for n in counts]
            arrays = [batch.column("doc_id"), batch.column("sum"), pa.array(keys, pa.binary()), pa.array(counts, pa.int32()), pa.array(masks, pa.int32()), pa.array(found, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "sum", "set_key", "shingles", "depths", "labels"])

    return rows.mapInArrow(sign, schema)


def common_prefix(keys: np.ndarray) -> np.ndarray:
    """Labels that each key of a sorted matrix shares with the one before it; -1 for the first key and for another trie's."""
    same = keys[1:] == keys[:-1]
    shared = np.where(same.all(axis=1), same.shape[1], same.argmin(axis=1)) - 1
    return np.concatenate([[-1], shared])


def walk_tries(entries: DataFrame, labels: int) -> DataFrame:
    """``node, rep`` of every shortened prefix that a text shares with a neighbour, from ``key, rep, depths``.

    ``key`` is the number of a trie and the labels of a text in it, one byte each. All keys are
    sorted over the cluster, so each trie lies in order; what a text shares at most with any other,
    it shares with the one before or behind it. A text whose longest shared prefix is too short for
    a depth leaves the trie there; the others' prefixes are shortened to their depths. At the ends
    of a sorted partition the neighbour is unknown, so the text stays. Keys are sorted on by text,
    so that no task gets a key whole that very many texts have.
    """
    width = labels + 1

    def matched(batch: pa.RecordBatch, before: np.ndarray | None, after: np.ndarray | None) -> pa.RecordBatch:
        keys = _keys(batch, width)
        shared = common_prefix(np.concatenate([x for x in (before, keys, after) if x is not None]))
        back = shared[1:] if before is not None else np.append(labels, shared[1:])
        longest = np.maximum(back[: len(keys)], back[1:] if after is not None else np.append(back[1:], labels))
        mask = batch.column("depths").to_numpy()
        prefixes, at = [], []
        for depth in range(labels, 0, -1):
            here = np.flatnonzero((mask >> depth & 1 == 1) & (longest >= depth))
            prefixes += [k.tobytes() for k in keys[here, : depth + 1]]
            at.append(here)
        return pa.RecordBatch.from_arrays([pa.array(prefixes, pa.binary()), batch.column("rep").take(pa.array(np.concatenate(at)))], ["prefix", "rep"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                yield matched(held, before, _keys(batch, width)[:1])
                before = _keys(held, width)[-1:]
            held = batch
        if held is not None:
            yield matched(held, before, None)

    ordered = entries.repartitionByRange("key", "rep").sortWithinPartitions("key", "rep")
    return ordered.mapInArrow(walk, "prefix binary, rep bigint").select(F.xxhash64("prefix").alias("node"), "rep")


def _keys(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """The keys of a batch, all of one width, as a matrix of bytes."""
    keys = batch.column("key")
    first = np.frombuffer(keys.buffers()[1], np.int32)[keys.offset]
    return np.frombuffer(keys.buffers()[2], np.uint8)[first : first + width * len(keys)].reshape(-1, width)


def compare_block(left: list[np.ndarray], right: list[np.ndarray] | None, similarity: float) -> Iterator[tuple[int, np.ndarray]]:
    """For each set of ``left``, the positions in ``right`` (or behind it in ``left``) at or over the similarity.

    Exact: the sets are counted against one another by marking one set at a time.
    """
    within = right is None
    right = left if within else right
    if not len(left) or not len(right):
        return
    order = np.argsort([len(s) for s in right], kind="stable")
    sizes = np.array([len(right[k]) for k in order])
    vocabulary, ids = np.unique(np.concatenate([right[k] for k in order]), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    mark = np.zeros(len(vocabulary) + 1, bool)
    for i, own in enumerate(left):
        low = np.searchsorted(sizes, np.floor(similarity * len(own)), "left")
        high = np.searchsorted(sizes, np.ceil(len(own) / similarity), "right")
        if low == high:
            continue
        at = np.searchsorted(vocabulary, own)
        at = at[vocabulary[np.minimum(at, len(vocabulary) - 1)] == own]
        mark[at] = True
        common = np.add.reduceat(mark[ids[starts[low] : starts[high]]], starts[low:high] - starts[low], dtype=np.int64)
        mark[at] = False
        union = len(own) + sizes[low:high] - common
        hits = order[low:high][common >= similarity * union - 1e-9]
        hits = hits[hits > i] if within else hits
        if len(hits):
            yield i, hits


def _linked(sets: list[np.ndarray], block: np.ndarray, weight: np.ndarray, pair: tuple[int, int], similarity: float, counted: Callable[[int, np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of each member to classes and to documents, and for each a member of its tree of links.

    ``counted`` tells which links of a member count here, as others count elsewhere.
    """
    classes, documents = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)
    root = np.arange(len(sets))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    a, b = (np.flatnonzero(block == x) for x in pair)
    found = compare_block([sets[k] for k in a], None if pair[0] == pair[1] else [sets[k] for k in b], similarity)
    for i, hits in found:
        me, others = a[i], b[hits]
        if counted is not None:
            others = others[counted(me, others)]
        classes[me] += len(others)
        documents[me] += weight[others].sum()
        classes[others] += 1
        documents[others] += weight[me]
        for other in others:
            x, y = find(me), find(other)
            if x != y:
                root[max(x, y)] = min(x, y)
    return classes, documents, np.array([find(k) for k in range(len(sets))], np.int64)


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, trees: int = TREES, labels: int = LABELS, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """One row per document: ``doc_id, class_id, copy_id, n_links, n_class_links, first`` and ``sum``.

    Texts with the same set of shingles form one class of copies; classes are linked when their
    sets have a Jaccard similarity of at least ``similarity``. ``copy_id`` is the smallest id of
    the document's copies, ``class_id`` the smallest id of all documents that links connect to it.
    ``n_links`` counts the other documents linked to it, copies included, ``n_class_links`` the
    other classes. ``first`` is true for one row of each ``class_id`` (smallest id, then text
    hash, then row). ``sum`` is xxhash64 of the text, which tells rows apart that repeat an id.

    Candidates are classes that share a shortened prefix in any trie of the forest; every one of
    them is verified on the shingles, and no pair is ever a row. They meet in the connected
    components of shared prefixes, or, where that moves less, prefix by prefix; a component or
    prefix of any size is dealt out over many tasks in pairs of blocks.

    Words are lower-case runs of letters, digits and underscores; a text of fewer than five words
    has one shingle of all of them. A null or empty text, or one without words, is linked to
    nothing, itself included: it is its own class. Null ids come after all others. Rows that
    repeat id and text are copies of each other. No rows give no rows; further columns are not read.
    """
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("sum"), text.alias("text"))
    signed = materialise(signatures(rows, shingle, similarity, trees, labels, recall).withColumn("row_id", F.monotonically_increasing_id()), "signed")

    # Classes of copies: minima of numbers and counts, combined before the shuffle.
    rank = F.struct(F.col("doc_id").isNull().alias("nul"), "doc_id", "sum", "row_id")
    classes = materialise(signed.where("set_key IS NOT NULL").groupBy("set_key").agg(F.min(rank).alias("best"), F.count(F.lit(1)).alias("weight")).select("set_key", F.col("best.row_id").alias("rep"), F.col("best.doc_id").alias("rep_doc"), F.col("best.sum").alias("rep_sum"), "weight"), "classes")

    # The forest: one entry a class in every trie.
    reps = materialise(signed.join(classes.select(F.col("rep").alias("row_id")), "row_id", "left_semi").where("depths > 0").select(F.col("row_id").alias("rep"), "depths", "labels"), "reps")
    tries = F.array(*[F.concat(F.lit(bytes([k])), F.substring("labels", k * labels + 1, labels)) for k in range(trees)])
    nodes = materialise(walk_tries(reps.select(F.explode(tries).alias("key"), "rep", "depths"), labels), "nodes")
    sizes = nodes.groupBy("node").agg(F.min("rep").alias("head"), F.count(F.lit(1)).alias("members")).where("members > 1")
    # A node that very many texts share is split by the join, as it has one row on the other side.
    shared = materialise(nodes.join(sizes.hint("merge"), "node"), "shared")
    candidates = connected_components(shared.where("rep <> head").select(F.col("rep").alias("src"), F.col("head").alias("dst")))

    # Verification, by components or by prefixes.
    known = classes.select("rep", "set_key", "weight", F.col("rep_doc").alias("doc_id"), F.col("rep_sum").alias("sum"))
    wanted = materialise(known.join(candidates.withColumnRenamed("node", "rep"), "rep").join(signed.select(F.col("row_id").alias("rep"), "shingles"), "rep"), "wanted")
    units = materialise(meeting_places(wanted, shared, block), "units")
    links = materialise(verify(fetch_sets(rows, wanted, shingle), units, similarity), "links")

    # A class's numbers are the sums over its block pairs, its group the component of its links.
    joined = connected_components(links.where("rep <> root").select(F.col("rep").alias("src"), F.col("root").alias("dst")))
    counts = links.groupBy("rep").agg(F.sum("documents").alias("documents"), F.sum("classes").alias("n_class_links"))
    every = classes.join(counts, "rep", "left").join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    every = materialise(every.select("set_key", "rep", "rep_doc", "rep_sum", "weight", F.coalesce("component", "rep").alias("component"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("n_class_links", F.lit(0)).alias("n_class_links")), "every")
    heads = every.groupBy("component").agg(F.min(F.struct(F.col("rep_doc").isNull().alias("nul"), "rep_doc", "rep_sum", "rep")).alias("head"))
    named = materialise(every.join(heads, "component").select("set_key", F.col("rep_doc").alias("copy_id"), F.col("head.rep_doc").alias("class_id"), F.col("head.rep").alias("first_row"), (F.col("documents") + F.col("weight") - 1).alias("n_links"), "n_class_links"), "named")
    out = signed.select("doc_id", "sum", "row_id", "set_key").join(named, "set_key", "left")
    alone = F.col("copy_id").isNull() & F.col("first_row").isNull()
    own = lambda c: F.when(alone, F.col("doc_id")).otherwise(F.col(c)).alias(c)
    return out.select("doc_id", own("class_id"), own("copy_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_class_links", F.lit(0)).alias("n_class_links"), (alone | (F.col("row_id") == F.col("first_row"))).alias("first"), "sum")


def meeting_places(wanted: DataFrame, shared: DataFrame, block: int) -> DataFrame:
    """``rep, unit, blocks, nodes``: where each class is compared, a component or all its shared prefixes.

    A component that fits into one block is compared as a whole. Of a larger one both ways are
    costed by the classes that they move (members times blocks): all pairs of its blocks, or those
    within each prefix. So a long chain of texts costs by the prefixes it shares, in proportion to
    its texts, and texts that all resemble one another cost one comparison a pair. ``nodes`` is
    null for components; for prefixes it holds all those of the class, in order: a pair counts in
    the first that both have.
    """
    blocks = lambda members, shingles: F.ceil(F.greatest(members / block, shingles / BLOCK_SHINGLES)).cast("int")
    whole = wanted.groupBy("component").agg(F.count(F.lit(1)).alias("members"), F.sum("shingles").alias("size"))
    whole = materialise(whole.select("component", blocks(F.col("members"), F.col("size")).alias("blocks"), "members"), "components")
    # Only what large components hold is looked at by prefix.
    large = wanted.join(whole.where("blocks > 1").select("component", F.col("blocks").alias("whole_blocks"), "members"), "component").select("rep", "component", "shingles", "whole_blocks", F.col("members").alias("whole_members"))
    parts = materialise(shared.select("node", "rep").join(large, "rep"), "parts")
    prefixes = parts.groupBy("node").agg(F.first("component").alias("component"), F.first("whole_blocks").alias("whole_blocks"), F.first("whole_members").alias("whole_members"), F.count(F.lit(1)).alias("n"), F.sum("shingles").alias("size"))
    costed = materialise(prefixes.select("node", "component", "whole_blocks", "whole_members", "n", blocks(F.col("n"), F.col("size")).alias("node_blocks")), "prefixes")
    moved = costed.groupBy("component").agg(F.sum(F.col("n") * F.col("node_blocks")).alias("by_prefix"), (F.first("whole_members") * F.first("whole_blocks")).alias("by_component"))
    chosen = materialise(moved.where("by_prefix < by_component").select("component"), "chosen")
    split = parts.join(chosen, "component", "left_semi")
    own = split.groupBy("rep").agg(F.array_sort(F.collect_list("node")).alias("nodes"))
    by_prefix = split.select("rep", "node").join(costed.select("node", "node_blocks"), "node").join(own, "rep")
    by_component = wanted.join(chosen, "component", "left_anti").select("rep", "component").join(whole.drop("members"), "component")
    empty = F.lit(None).cast("array<bigint>")
    return by_component.select("rep", F.col("component").alias("unit"), "blocks", empty.alias("nodes")).unionByName(by_prefix.select("rep", F.col("node").alias("unit"), F.col("node_blocks").alias("blocks"), "nodes"))


def fetch_sets(rows: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """``rep, weight, shingles`` (sorted 64-bit hashes) of the wanted classes: their texts are read and cut once more."""
    # Merged at every size: a broadcast of the wanted ids would only fit small inputs.
    named = wanted.select("rep", "weight", "set_key", F.col("doc_id").alias("rep_doc"), F.col("sum").alias("rep_sum")).hint("merge")
    texts = rows.join(named, rows["doc_id"].eqNullSafe(named["rep_doc"]) & (rows["sum"] == named["rep_sum"])).select("rep", "weight", "set_key", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_hashes(words(t), shingle) for t in batch.column("text").to_pylist()]
            # A text of the same id whose hash agrees by chance is another one.
            right = [set_key(s) == k for s, k in zip(sets, batch.column("set_key").to_pylist(), strict=True)]
            arrays = [batch.column("rep"), batch.column("weight"), pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["rep", "weight", "shingles"]).filter(pa.array(right, pa.bool_()))

    return materialise(texts.mapInArrow(cut, "rep bigint, weight bigint, shingles binary"), "sets")


def verify(sets: DataFrame, units: DataFrame, similarity: float) -> DataFrame:
    """``rep, classes, documents, root`` of every block pair that holds ``rep``.

    A unit of one block goes to one task with other small ones, a larger one to a task for each
    pair of its blocks; a class is in at most as many of them as the unit has blocks.
    """
    bins = max(1, units.count() // BLOCK)
    # Rows that repeat id and text are one class.
    once = sets.dropDuplicates(["rep"])
    met = once.join(units.hint("merge"), "rep")
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    dealt = met.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = dealt.select("rep", "unit", "nodes", "block", "weight", "shingles", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"))

    def check(batch: pa.Table) -> pa.Table:
        out = {"rep": [], "classes": [], "documents": [], "root": []}
        table = batch.select(["unit", "p", "q", "rep", "block", "weight", "shingles", "nodes"]).to_pydict()
        groups: dict[tuple, list] = {}
        for unit, p, q, *row in zip(*table.values(), strict=True):
            groups.setdefault((unit, p, q), []).append(row)
        for (unit, p, q), found in groups.items():
            reps, block, weight, shingles, nodes = zip(*found, strict=True)
            own = [np.frombuffer(s, np.uint64) for s in shingles]
            first = None if nodes[0] is None else _first_shared([np.array(n, np.int64) for n in nodes], unit)
            classes, documents, root = _linked(own, np.array(block), np.array(weight, np.int64), (p, q), similarity, first)
            for name, values in (("rep", np.array(reps, np.int64)), ("classes", classes), ("documents", documents), ("root", np.array(reps, np.int64)[root])):
                out[name].append(values)
        schema = pa.schema([(name, pa.int64()) for name in out])
        return pa.table({name: np.concatenate(v) if v else np.empty(0, np.int64) for name, v in out.items()}, schema=schema)

    group = F.when(F.col("q") > 0, F.struct("unit", "p", "q")).otherwise(F.struct(F.pmod(F.xxhash64("unit"), F.lit(bins)).alias("unit"), F.lit(-1).alias("p"), F.lit(-1).alias("q")))
    return pairs.withColumn("task", group).groupBy("task").applyInArrow(check, "rep bigint, classes bigint, documents bigint, root bigint")


def _first_shared(nodes: list[np.ndarray], unit: int) -> Callable[[int, np.ndarray], np.ndarray]:
    """Whether ``unit`` is the first node that a class shares with each of others, all by position."""

    def first(one: int, others: np.ndarray) -> np.ndarray:
        mine = nodes[one][nodes[one] < unit]
        return np.array([not np.isin(mine, nodes[k], assume_unique=True).any() for k in others], bool)

    return first


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without near copies: of each ``class_id`` one row stays, with all its columns.

    The row that stays is the ``first`` of ``jaccard_join``; of rows that repeat its id and text,
    any one. Rows whose text is null, empty or without words all stay. No rows give no rows; no
    column of ``docs`` is changed, whatever its name.
    """
    at, own, alone = fresh(docs, "id"), fresh(docs, "sum"), fresh(docs, "alone")
    kept = jaccard_join(docs, id_col, text_col, **options).where("first").select(F.col("doc_id").alias(at), F.col("sum").alias(f"{own}_kept"))
    summed = docs.withColumn(own, F.xxhash64(F.col(text_col)))
    met = summed.join(kept, summed[id_col].eqNullSafe(kept[at]) & (summed[own] == kept[f"{own}_kept"]), "left_semi")
    worded = F.col(text_col).rlike(r"(?U)\w")
    # Rows that repeat id and text are copies: one stays. Those without words are no copies of each other.
    return met.withColumn(alone, F.when(F.coalesce(worded, F.lit(False)), F.lit(0)).otherwise(F.monotonically_increasing_id())).dropDuplicates([id_col, own, alone]).drop(own, alone)
