"""Toxicity: a chain of linear classifiers, each fed with what the earlier ones found."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import WORD, WordHashes
from corpusloom.llm.samples import TRAIN_ROWS, first_rows, labelled_sample

#: The chain's categories in order with the words that mark a training text as one; the last link is the labelled one.
#: No mark may be a common word of another language, as "die" is of German.
SEEDS = {
    "insult": ("idiot", "idiots", "moron", "morons", "stupid", "loser", "losers", "dumb", "fool"),
    "degradation": ("trash", "scum", "worthless", "vermin", "filth", "pathetic", "disgusting"),
    "threat": (
        *("kill", "hurt", "destroy", "attack", "shoot", "murder"),
        *("töten", "umbringen", "erschießen", "ermorden", "verprügeln"),
        *("tuer", "tuerai", "égorger", "assassiner", "massacrer"),
        *("matar", "mataré", "matarte", "asesinar", "degollar"),
    ),
}
LABEL = "toxic"
FOLDS, STEPS, SEED = 3, 80, 3
#: L1 penalty that chooses words, and the one under which the chosen ones are then fitted.
CHOOSE, REFIT = 4e-3, 1e-4
#: A hashed word counts if so many training texts have it; seed words that fewer have as their only mark are put into further ones.
LEAST_TEXTS = 8
#: Letters of a word's start, and how many distinct longer words with one start make a feature.
START, ALIKE = 5, (2, 4)
CUT = 0.5

_HASHES = WordHashes()


def features(text: str | None) -> np.ndarray:
    """Sorted distinct buckets of the words of the whole text, and of starts that several of its words share. Null counts as empty."""
    found = set(WORD.findall((text or "").lower()))
    starts = Counter([w[:START] for w in found if len(w) > START])
    return _buckets([*found, *(f"{s} {k}" for s, n in starts.items() if n > 1 for k in ALIKE if n >= k)])


def _buckets(keys: list[str]) -> np.ndarray:
    """Hashes of 63 bits, so that no seed word shares its bucket with another word."""
    return np.unique((np.fromiter(map(_HASHES.__getitem__, keys), np.uint64, len(keys)) >> np.uint64(1)).astype(np.int64))


def seeds(text: str | None) -> list[int]:
    found = set(WORD.findall((text or "").lower()))
    return [int(not found.isdisjoint(marks)) for marks in SEEDS.values()]


@dataclass
class Link:
    """One linear model: weights of some buckets, of the earlier links' probabilities, and a bias."""

    buckets: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    bias: float


@dataclass
class Chain:
    names: list[str]
    links: list[Link]

    def predict(self, at: np.ndarray) -> list[float]:
        """The categories' probabilities in order; each link sees those before it."""
        out: list[float] = []
        for link in self.links:
            where = np.searchsorted(link.buckets, at)
            hit = where < len(link.buckets)
            hit[hit] = link.buckets[where[hit]] == at[hit]
            margin = link.bias + link.weights[where[hit]].sum() + link.earlier @ np.array(out)
            out.append(float(1 / (1 + np.exp(-np.clip(margin, -40, 40)))))
        return out


class _Rows:
    """A sparse 0/1 matrix with some dense columns."""

    def __init__(self, cells: list[np.ndarray], width: int, dense: np.ndarray):
        self.n, self.width, self.dense = len(cells), width, dense
        self.column = np.concatenate(cells) if cells else np.empty(0, np.int64)
        self.row = np.repeat(np.arange(len(cells)), [len(c) for c in cells])

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[: self.width][self.column], self.n) + self.dense @ w[self.width :]

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(self.column, g[self.row], self.width), self.dense.T @ g])


def _logistic(rows: _Rows, y: np.ndarray, always: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights by the L1 penalty in two steps: choose columns besides those of ``always``, then fit them without its shrinkage."""
    w, _ = _penalised(rows, y, CHOOSE)
    some = np.union1d(np.flatnonzero(w), always)
    words_of, dense_of = some[some < rows.width], some[some >= rows.width] - rows.width
    renumber = np.full(rows.width, -1)
    renumber[words_of] = np.arange(len(words_of))
    column = renumber[rows.column]
    few = _Rows([], len(words_of), rows.dense[:, dense_of])
    few.n, few.column, few.row = rows.n, column[column >= 0], rows.row[column >= 0]
    fitted, bias = _penalised(few, y, REFIT)
    out = np.zeros(len(w))
    out[some] = fitted
    return out, bias


def _penalised(rows: _Rows, y: np.ndarray, penalty: float) -> tuple[np.ndarray, float]:
    """Accelerated proximal steps on the mean logistic loss. One class only: its share as bias."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    bias = float(np.log(share / (1 - share)))
    w = np.zeros(rows.width + rows.dense.shape[1])
    if not len(y) or y.min() == y.max() or not len(w):
        return w, bias
    # A step for each column by how often it occurs, which rare words need.
    often = np.concatenate([np.bincount(rows.column, minlength=rows.width), np.maximum((rows.dense**2).sum(axis=0), 1)]) / len(y)
    typical = max(np.bincount(rows.row, minlength=rows.n).mean(), 1.0)
    step = 1.0 / (np.sqrt(often) * np.sqrt(typical) * 0.5 + 1e-3)
    z, b, zb, t = w.copy(), bias, bias, 1.0
    for _ in range(STEPS):
        g = (1 / (1 + np.exp(-np.clip(rows.times(z) + zb, -40, 40))) - y) / len(y)
        new = z - step * rows.back(g)
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        new_b = zb - g.sum()
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, zb = new + (t - 1) / after * (new - w), new_b + (t - 1) / after * (new_b - b)
        w, b, t = new, new_b, after
    return w, float(b)


def train(rows: list[tuple[list[int], list[int]]], names: list[str], marks: dict[str, np.ndarray] | None = None) -> Chain:
    """Fit the chain on (buckets, category flags in order).

    Later links are trained on the earlier ones' out-of-fold probabilities: each text's come from
    models that did not see it, as they will for new texts. The links that are kept are fitted on
    all rows. Without rows every probability is a half.

    ``marks`` has the buckets of categories' seed words. A seed word always has a weight: one that
    fewer than ``LEAST_TEXTS`` texts hold as the only one of its category is put into further texts
    without the category, for its own link only, and these count as cases of it.
    """
    n, marks = len(rows), marks or {}
    found, texts = np.unique(np.concatenate([np.array(r[0], np.int64) for r in rows]) if n else np.empty(0, np.int64), return_counts=True)
    buckets = np.unique(np.concatenate([found[texts >= LEAST_TEXTS], *(marks.values() if n else ())]))
    cells = []
    for at, _ in rows:
        where = np.searchsorted(buckets, at)
        inside = where < len(buckets)
        where, at = where[inside], np.array(at, np.int64)[inside]
        cells.append(where[buckets[where] == at])
    flags = np.array([r[1] for r in rows], float).reshape(n, len(names))
    draw = np.random.default_rng(SEED)
    fold = draw.permutation(n) % FOLDS
    seen = np.zeros((n, 0))
    links = []
    for k, name in enumerate(names):
        always = np.searchsorted(buckets, marks[name]) if n and name in marks else np.empty(0, np.int64)
        free = np.flatnonzero(flags[:, k] == 0)
        alone = Counter(int(own[0]) for at in cells if len(own := np.intersect1d(at, always)) == 1)
        put = [(i, c) for c in always.tolist() for i in draw.choice(free, min(len(free), max(0, LEAST_TEXTS - alone[c])), replace=False)]
        source = np.concatenate([np.arange(n), np.array([i for i, _ in put], np.int64)])
        held = cells + [np.union1d(cells[i], [c]) for i, c in put]
        y, unseen = np.concatenate([flags[:, k], np.ones(len(put))]), np.full(n, 0.5)
        for f in range(FOLDS):
            own, rest = np.flatnonzero(fold == f), np.flatnonzero(fold[source] != f)
            if not len(own):
                continue
            w, b = _logistic(_Rows([held[i] for i in rest], len(buckets), seen[source[rest]]), y[rest], always)
            margin = _Rows([cells[i] for i in own], len(buckets), seen[own]).times(w) + b
            unseen[own] = 1 / (1 + np.exp(-np.clip(margin, -40, 40)))
        w, b = _logistic(_Rows(held, len(buckets), seen[source]), y, always)
        some = np.flatnonzero(w[: len(buckets)])
        links.append(Link(buckets[some], w[some], w[len(buckets) :], b))
        seen = np.column_stack([seen, unseen])
    return Chain(list(names), links)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = LABEL, limit: int = TRAIN_ROWS) -> Chain:
    """Learn from at most ``limit`` labelled documents; the seed words mark the unlabelled categories."""
    sample = labelled_sample(docs, labels, label, limit, id_col, text_col, all_folds=True).select("id", "text", "y")
    key = sample.schema["id"].dataType.simpleString()

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            flags = [[*seeds(t), int(y > 0)] for t, y in zip(texts, batch.column("y").to_pylist(), strict=True)]
            arrays = [batch.column("id"), pa.array([features(t) for t in texts], pa.list_(pa.int64())), pa.array(flags, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "at", "flags"])

    got = sample.mapInArrow(extract, f"id {key}, at array<bigint>, flags array<bigint>")
    rows = sorted((r.id, tuple(r.flags), tuple(r.at)) for r in first_rows(got, limit))
    return train([(list(at), list(flags)) for _, flags, at in rows], [*SEEDS, LABEL], {name: _buckets(list(words)) for name, words in SEEDS.items()})


def score_documents(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``p_<category>`` for each link, and ``is_toxic`` (the last probability reaches ``CUT``).

    A null or empty text has the chain's probabilities for no words. Null ids stay null; repeated
    rows are scored alike. No rows give no rows; further columns are not read. One pass, no shuffle.
    """
    sent = docs.sparkSession.sparkContext.broadcast(chain)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    names = [f"p_{n}" for n in chain.names]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([sent.value.predict(features(t.as_py())) for t in batch.column("text")]).reshape(-1, len(names))
            arrays = [batch.column("doc_id"), *(pa.array(found[:, k]) for k in range(len(names))), pa.array((found[:, -1] >= CUT).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *names, "is_toxic"])

    key = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(judge, f"doc_id {key}, {', '.join(f'{n} double' for n in names)}, is_toxic int")
