"""Alignment of two tokenizers' ids by windows between shared, space-marked token ends."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import materialise
from corpusloom.llm.packing import ranks_of, tokens_of

BYTE_FILE, PIECE_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Distinct windows, and bytes of their groups and links, that a worker remembers before it starts anew: they bound memory and change no result.
MEMO_WINDOWS, MEMO_BYTES = 500_000, 1 << 27
#: The one blank between two words; where further white space stands beside it, no window begins.
_WINDOW_START = re.compile(r"(?<=\S) (?=\S)")


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(BYTE_FILE), public_tokenizers.path(PIECE_FILE)


def piece_bytes(piece: str) -> bytes:
    """The bytes of a sentencepiece piece: U+2581 is a blank, ``<0xHH>`` one byte."""
    if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


class Pair:
    """Both tokenizers, the bytes of their ids, and the memo of window alignments.

    A window is a stretch of text up to a single blank between two words. Both tokenizers begin a
    token there, wherever the window stands: the first's pattern takes one blank along with what
    follows it, and the second's vocabulary has no piece with a blank behind another character
    (this is read from the file; else a text is one window). So each distinct window is encoded and
    aligned once a worker; tests hold the ids against those of whole texts.
    """

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.a = tokens_of(path_a)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        known = {k: raw for raw, k in ranks_of(path_a).items()}
        self.bytes_a = [known.get(k, b"") for k in range(max(known) + 1)]
        self.bytes_b = [piece_bytes(self.b.id_to_piece(k)) for k in range(self.b.get_piece_size())]
        self.size_a, self.size_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        # A piece with a blank behind another character would reach over words.
        self.by_word = not any(" " in x.lstrip(b" ").decode("latin-1") for x in self.bytes_b)
        # How an id is written: the first's within a group and at its end, then the second's.
        ids_a, ids_b = range(len(self.bytes_a)), range(len(self.bytes_b))
        self.names = [b"%d%s" % (k, mark) for ids, mark in ((ids_a, b","), (ids_a, b"|"), (ids_b, b","), (ids_b, b";")) for k in ids]
        self.name_sizes = np.array([len(x) for x in self.names], np.int64)
        self.forget()

    def forget(self) -> None:
        """Empty the memo: window -> number, and by number the groups as text, the link codes and both counts of tokens."""
        self.memo: dict[str, int] = {}
        self.texts: list[bytes] = []
        self.links: list[bytes] = []
        self.counts: list[tuple[int, int]] = []
        self.held = 0

    def windows(self, text: str) -> list[str]:
        """The windows of a text that is not empty; joined by blanks they are the text."""
        if not self.by_word:
            return [text]
        parts = text.split(" ")
        return _WINDOW_START.split(text) if "" in parts or list(map(str.strip, parts)) != parts else parts

    def encode(self, some: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids of both for windows as one text behind a blank; None where the tokens' bytes differ from these."""
        text = " ".join(some)
        raw = b" " + text.encode("utf-8", "surrogatepass")
        a = np.frombuffer(self.a(" " + text), "<u4")
        # Byte-level tokens are pieces of the text itself, so they differ from it only if some are missing.
        if int(self.size_a[a].sum()) != len(raw):
            return None
        b = self.b.encode(text, num_threads=1)
        return (a, np.array(b, np.uint32)) if b"".join(map(self.bytes_b.__getitem__, b)) == raw else None

    def encode_second(self, text: str) -> bytes | None:
        """The second tokenizer's ids of the whole text, made window by window."""
        found = [self.encode([w]) for w in self.windows(text)]
        return None if any(x is None for x in found) else b"".join(b.tobytes() for _, b in found)

    def learn(self, new: list[str]) -> None:
        """Encode and align windows and remember them; number -1 is one that a tokenizer doesn't give back."""
        # White space may only stand at a text's ends, where no window follows or comes before.
        inner = [w for w in new if w == w.strip()]
        for some in (inner, *([w] for w in new if w != w.strip())):
            if not some:
                continue
            if found := self.encode(some):
                self.align(some, *found)
            elif len(some) == 1:
                self.memo[some[0]] = -1
            else:
                for w in some:
                    self.learn([w])

    def align(self, some: list[str], a: np.ndarray, b: np.ndarray) -> None:
        """Cut the tokens into groups where both end, write these and their links, and keep each window's share."""
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        place = np.searchsorted(ends_a, ends_b)
        last_b = np.flatnonzero(ends_a[place] == ends_b)
        last_a = place[last_b]
        # In a group the first's tokens come before the second's; each stands behind those of the groups before.
        to_a, to_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        to_a[last_a] = to_b[last_b] = True
        sizes_a, sizes_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        written = np.empty(len(a) + len(b), np.int64)
        written[np.arange(len(a)) + np.repeat(last_b + 1 - sizes_b, sizes_a)] = a + np.int64(len(self.bytes_a)) * to_a
        written[np.arange(len(b)) + np.repeat(last_a + 1, sizes_b)] = 2 * len(self.bytes_a) + b + np.int64(len(self.bytes_b)) * to_b
        text = b"".join(map(self.names.__getitem__, written.tolist()))
        links = (a[last_a].astype(np.int64) * len(self.bytes_b) + b[last_b]).tobytes()
        closing = np.searchsorted(ends_b[last_b], np.cumsum([len(w.encode("utf-8", "surrogatepass")) + 1 for w in some]))
        bound_a, bound_b = last_a[closing] + 1, last_b[closing] + 1
        bytes_text = np.cumsum(self.name_sizes[written])[bound_a + bound_b - 1].tolist()
        bytes_links = (8 * (closing + 1)).tolist()
        self.memo.update(zip(some, range(len(self.texts), len(self.texts) + len(some)), strict=True))
        self.texts += [text[s:e] for s, e in zip([0, *bytes_text], bytes_text, strict=False)]
        self.links += [links[s:e] for s, e in zip([0, *bytes_links], bytes_links, strict=False)]
        self.counts += zip(np.diff(bound_a, prepend=0).tolist(), np.diff(bound_b, prepend=0).tolist(), strict=True)
        self.held += len(text) + len(links)

    def __call__(self, text: str | None) -> tuple[int, int, int, str, np.ndarray, np.ndarray]:
        """(tokens of the first, of the second, groups, their digest, distinct link codes, how often each stands)."""
        nothing = 0, 0, 0, "", np.empty(0, np.int64), np.empty(0, np.int64)
        if not text:
            return nothing
        if len(self.memo) > MEMO_WINDOWS or self.held > MEMO_BYTES:
            self.forget()
        parts, memo = self.windows(text), self.memo
        if new := [w for w in dict.fromkeys(parts) if w not in memo]:
            self.learn(new)
        numbers = list(map(memo.__getitem__, parts))
        often = Counter(numbers)
        if -1 in often:
            return nothing
        digest = hashlib.sha256(b"".join(map(self.texts.__getitem__, numbers))[:-1]).hexdigest()
        times = np.fromiter(often.values(), np.int64, len(often))
        n_a, n_b = (times @ np.array([self.counts[k] for k in often], np.int64)).tolist()
        links = [self.links[k] for k in often]
        each = np.repeat(times, [len(p) >> 3 for p in links])
        codes, place = np.unique(np.frombuffer(b"".join(links), np.int64), return_inverse=True)
        counts = np.bincount(place, weights=each, minlength=len(codes)).astype(np.int64)
        return n_a, n_b, int(counts.sum()), digest, codes, counts


@lru_cache(maxsize=4)
def pair_of(path_a: str, path_b: str) -> Pair:
    """The pair of two files, made once in each Python worker."""
    return Pair(path_a, path_b)


def align_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", paths: tuple[str, str] | None = None) -> DataFrame:
    """One row per document: ``doc_id, n_a, n_b, n_groups, groups_sha256, codes, counts``.

    ``codes`` are the distinct linked id pairs of the document (first id times the second's
    vocabulary, plus the second id), ``counts`` how often it links each. Both tokenizers read all of
    the text; its windows, between ends that both share, before tokens that begin with a blank in
    both, are encoded and aligned once and remembered.

    A null or empty text, and one that a tokenizer doesn't give back byte for byte, has no tokens:
    zeros, an empty digest and empty lists. Rows that repeat an id are judged each on its own, and
    null ids stay null. No rows give no rows. Further columns are not read.
    """
    first, second = paths or default_paths()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, codes array<bigint>, counts array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(first, second)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # lists of links are long
                part = batch.slice(at, 256)
                found = [pair(text.as_py()) for text in part.column("text")]
                offsets = np.concatenate([[0], np.cumsum([len(x[4]) for x in found])]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([x[k] for x in found]), pa.int64())) for k in (4, 5)]
                columns = [part.column("doc_id"), *(pa.array([x[k] for x in found], pa.int64()) for k in range(3)), pa.array([x[3] for x in found], pa.string()), *lists]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "codes", "counts"])

    return rows.mapInArrow(run, schema)


def pair_counts(aligned: DataFrame, second_size: int) -> DataFrame:
    """``code, n, best`` of every id pair that is linked: its links in all documents, and whether that is its second id's most (ties included)."""
    summed = aligned.select(F.explode(F.arrays_zip("codes", "counts")).alias("x")).groupBy(F.col("x.codes").alias("code")).agg(F.sum("x.counts").alias("n"))
    # Persisting isn't needed: a pair table is small, and it is read for the maxima and for itself.
    summed = materialise(summed, "pair-counts")
    own = F.pmod("code", F.lit(second_size))
    most = summed.groupBy(own.alias("b")).agg(F.max("n").alias("most"))
    return summed.join(most, own == F.col("b")).select("code", "n", (F.col("n") == F.col("most")).alias("best"))


def score_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", paths: tuple[str, str] | None = None) -> DataFrame:
    """One row per document: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    ``n_best`` counts the links of which no other pair of the same second id has more in all
    documents, ``count_sum`` sums the links' counts over all documents. As two tokens can only be
    linked where one ends as the other does, a pair is the end of one token's bytes: there are no
    more pairs than the vocabularies have bytes (about 0.6 million here), however large the
    corpus. That bounds the table that goes to every task. Odd rows are treated as in
    ``align_documents``.
    """
    paths = paths or default_paths()
    size = len(pair_of(*paths).bytes_b)
    aligned = materialise(align_documents(docs, id_col, text_col, paths), "aligned")
    known = pair_counts(aligned, size).orderBy("code").toArrow()
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(tuple(known.column(k).to_numpy() for k in ("code", "n", "best")))
    keep = ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256"]
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in aligned.schema if f.name in keep)}, n_links bigint, n_best bigint, count_sum bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, n, best = table.value
        for batch in batches:
            lists, counts = batch.column("codes"), batch.column("counts").flatten().to_numpy()
            sizes = np.array([len(x) for x in lists], np.int64)
            row = np.repeat(np.arange(batch.num_rows), sizes)
            place = np.searchsorted(codes, lists.flatten().to_numpy())
            summed = [np.zeros(batch.num_rows, np.int64) for _ in range(3)]
            for out, what in zip(summed, (counts, counts * best[place], counts * n[place]) if len(place) else (), strict=False):
                np.add.at(out, row, what)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *(pa.array(x, pa.int64()) for x in summed)], [*keep, "n_links", "n_best", "count_sum"])

    return aligned.mapInArrow(run, schema)
