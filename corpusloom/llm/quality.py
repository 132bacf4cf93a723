"""Quality classifier: a factorisation machine over hashed words, structure and sizes."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import WORD, WordHashes
from corpusloom.llm.samples import TRAIN_ROWS, first_rows, held_out, labelled_sample

#: Buckets of hashed words (a power of two), and columns of the pairwise part.
BUCKETS, FACTORS = 1 << 14, 8
EPOCHS, RATE, RIDGE, SEED = 12, 0.08, 2e-4, 7
#: A document is rejected below this score.
CUT = 0.5

_HASHES = WordHashes()


def _classes() -> np.ndarray:
    """Kind of each character below U+3000: 0 other, 1 upper, 2 lower, 3 digit, 4 space, 5 line feed."""
    kinds = np.zeros(0x3000, np.int64)
    for k in range(len(kinds)):
        c = chr(k)
        kinds[k] = 5 if c == "\n" else 4 if c.isspace() else 1 if c.isupper() else 2 if c.isalpha() else 3 if c.isdigit() else 0
    return kinds


_KINDS = _classes()

STRUCTURE = ("log_chars", "log_words", "log_lines", "word_length", "upper", "digit", "space", "other", "distinct_words", "top_word", "distinct_lines", "short_words", "marked_words", "again", "long_words")


def structure(text: str) -> np.ndarray:
    """Statistics of the whole text, each about 0 to 1; all 0 for an empty one."""
    out = np.zeros(len(STRUCTURE))
    if not text:
        return out
    chars = len(text)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = np.bincount(_KINDS[np.minimum(codes, 0x2FFF)], minlength=6) / chars
    chunks, lines = text.split(), text.split("\n")
    counts = Counter(chunks)
    n = max(len(chunks), 1)
    lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
    marked = sum(v for c, v in counts.items() if not c[-1].isalnum())
    again = sum(a == b for a, b in zip(chunks, chunks[1:], strict=False))
    out[:] = (
        np.log1p(chars) / 12, np.log1p(n) / 10, np.log1p(len(lines)) / 8, lengths.mean() / 12 if len(chunks) else 0, kinds[1], kinds[3], kinds[4], kinds[0],
        len(counts) / n, max(counts.values(), default=0) / n, len(set(lines)) / len(lines), (lengths <= 3).sum() / n, marked / n, again / n, (lengths > 20).sum() / n,
    )
    return out


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Positions and values: damped word counts of unit length, then the structure. Null counts as empty."""
    text = text or ""
    counts = Counter(WORD.findall(text.lower()))
    at = np.fromiter(map(_HASHES.__getitem__, counts), np.uint64, len(counts)) & np.uint64(BUCKETS - 1)
    at, where = np.unique(at.astype(np.int64), return_inverse=True)
    value = np.log1p(np.bincount(where, np.fromiter(counts.values(), float, len(counts)), len(at)))
    value /= np.sqrt((value**2).sum()) or 1.0
    return np.concatenate([at, BUCKETS + np.arange(len(STRUCTURE))]), np.concatenate([value, structure(text)])


@dataclass
class Machine:
    """bias + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j, as a logistic score."""

    bias: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def inputs(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        x = x.copy()
        x[-len(STRUCTURE) :] = np.clip((x[-len(STRUCTURE) :] - self.mean) / self.scale, -4, 4) / 2
        return x

    def margin(self, at: np.ndarray, x: np.ndarray) -> tuple[float, np.ndarray]:
        """The linear-time form: the pairs are half of (sum v x)^2 - sum v^2 x^2, for each factor."""
        vx = self.v[at] * x[:, None]
        sums = vx.sum(axis=0)
        return float(self.bias + self.w[at] @ x + 0.5 * ((sums**2).sum() - (vx**2).sum())), sums

    def score(self, text: str | None) -> float:
        at, x = features(text)
        return float(1 / (1 + np.exp(-np.clip(self.margin(at, self.inputs(at, x))[0], -40, 40))))


def train(rows: list[tuple[list[int], list[float], int]]) -> Machine:
    """Fit by AdaGrad on the logistic loss, one row at a time in a fixed shuffled order.

    Without rows the score is 0.5 everywhere; with one class only it leans to that class.
    """
    size = BUCKETS + len(STRUCTURE)
    rng = np.random.default_rng(SEED)
    data = [(np.array(at), np.array(x, float), y) for at, x, y in rows]
    dense = np.array([x[-len(STRUCTURE) :] for _, x, _ in data]) if data else np.zeros((1, len(STRUCTURE)))
    m = Machine(0.0, np.zeros(size), rng.normal(0, 0.02, (size, FACTORS)), dense.mean(axis=0), np.maximum(dense.std(axis=0), 1e-3))
    data = [(at, m.inputs(at, x), y) for at, x, y in data]
    positive = sum(y for *_, y in data)
    m.bias = float(np.log((positive + 1) / (len(data) - positive + 1)))
    gw, gv, gb = np.full(size, 1e-2), np.full((size, FACTORS), 1e-2), 1e-2
    for _ in range(EPOCHS):
        for k in rng.permutation(len(data)):
            at, x, y = data[k]
            margin, sums = m.margin(at, x)
            g = 1 / (1 + np.exp(-np.clip(margin, -40, 40))) - y
            dw = g * x + RIDGE * m.w[at]
            own = m.v[at]
            dv = g * (x[:, None] * sums - own * (x**2)[:, None]) + RIDGE * own
            gw[at] += dw**2
            gv[at] += dv**2
            gb += g * g
            m.w[at] -= RATE * dw / np.sqrt(gw[at])
            m.v[at] -= RATE * 0.5 * dv / np.sqrt(gv[at])
            m.bias -= RATE * g / np.sqrt(gb)
    return m


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", limit: int = TRAIN_ROWS) -> Machine:
    """Learn from at most ``limit`` labelled documents that are not held out.

    Executors turn the texts into features; the driver gets those of the sample and fits.
    """
    sample = labelled_sample(docs, labels, label, limit, id_col, text_col).select("id", "text", "y")
    key = sample.schema["id"].dataType.simpleString()

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = [], []
            for text in batch.column("text"):
                a, b = features(text.as_py())
                at.append(a)
                x.append(b)
            arrays = [batch.column("id"), pa.array(at, pa.list_(pa.int64())), pa.array(x, pa.list_(pa.float64())), batch.column("y")]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "at", "x", "y"])

    got = sample.mapInArrow(extract, f"id {key}, at array<bigint>, x array<double>, y int")
    rows = sorted((r.id, r.y, tuple(r.at), tuple(r.x)) for r in first_rows(got, limit))
    return train([(list(at), list(x), int(y > 0)) for _, y, at, x in rows])


def score_documents(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document, read in one pass without a shuffle.

    A null or empty text is scored as a text without words. Null ids count as held out; repeated
    rows are scored alike. No rows give no rows; further columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(machine)
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    key = rows.schema["doc_id"].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = [sent.value.score(t.as_py()) for t in batch.column("text")]
            arrays = [batch.column("doc_id"), batch.column("held_out"), pa.array(score, pa.float64()), pa.array([int(s >= CUT) for s in score], pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(judge, f"doc_id {key}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, machine: Machine, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with a score of at least ``CUT``, with all their columns and without a shuffle.

    A null or empty text is scored as a text without words. Repeated rows are judged alike, null
    ids play no part. No rows give no rows; no column is changed, whatever its name.
    """
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([sent.value.score(t.as_py()) >= CUT for t in batch.column(text_col)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
