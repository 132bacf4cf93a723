"""Packing documents into training sequences of even attention cost."""

from __future__ import annotations

import heapq
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "byte_bpe_50k.json"
LENGTH = 2048
END = 1
#: Estimated cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n.
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
#: Tokens that are packed together. A task holds so many, and one document; it bounds memory and
#: the spread of costs is balanced within it.
WINDOW_TOKENS = 2_000_000


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def special_ids(path: str) -> dict[str, int]:
    """The special strings of a vocabulary file and their ids."""
    with open(path, encoding="utf-8") as file:
        return {t["content"]: t["id"] for t in json.load(file).get("added_tokens", []) if t.get("special")}


def ranks_of(path: str) -> dict[bytes, int]:
    """The byte strings of a byte-level BPE vocabulary file and their ids.

    The file writes each byte as a printable character: those of Latin-1 that print stand for
    themselves, the others for the characters from 256 on.
    """
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printed]
    byte = {chr(b): b for b in printed} | {chr(256 + k): b for k, b in enumerate(others)}
    with open(path, encoding="utf-8") as file:
        found = json.load(file)
    special = {t["content"] for t in found.get("added_tokens", []) if t.get("special")}
    return {bytes(map(byte.__getitem__, word)): k for word, k in found["model"]["vocab"].items() if word not in special}


class Tokens:
    """The ids of a byte-level BPE vocabulary file, as little-endian unsigned 32-bit bytes.

    The ids are those that the tokenizers library gives for the file (tests hold them against each
    other): by its default with ``special``, which gives special strings their own ids, else with
    these read as ordinary text. They are made by the tiktoken library from the same vocabulary, in
    a third of the time.
    """

    def __init__(self, path: str, special: bool = False):
        import public_tokenizers
        import tiktoken

        self.encoding = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks_of(path), special_tokens=special_ids(path) if special else {})

    def __call__(self, text: str) -> bytes:
        return self.encoding.encode_to_numpy(text, allowed_special="all", disallowed_special=()).astype("<u4", copy=False).tobytes()


_TOKENS: dict[tuple[str, bool], Tokens] = {}


def tokens_of(path: str, special: bool = False) -> Tokens:
    """The tokenizer of a file, made once in each Python worker."""
    if (path, special) not in _TOKENS:
        _TOKENS[path, special] = Tokens(path, special)
    return _TOKENS[path, special]


def cost(n: int) -> float:
    return LINEAR * n + QUADRATIC * n * n


def pack(lengths: list[int], length: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents of the given token counts.

    What fills whole sequences is cut off each document. The rests are taken in descending order
    of cost and each goes to the sequence of lowest cost that still has room; a rest that no
    sequence has room for is cut over the emptiest ones. There are as few sequences as the tokens
    need, so only the last can be short.
    """
    pieces, rests, sequence = [], [], 0
    for k, n in enumerate(lengths):
        start = 0
        while n - start >= length:
            pieces.append((k, start, length, sequence, 0))
            sequence, start = sequence + 1, start + length
        if n > start:
            rests.append((n - start, k, start))
    rests.sort(key=lambda r: (-cost(r[0]), r[1]))
    total = sum(r[0] for r in rests)
    bins = -(-total // length)
    room = [length] * bins
    if total % length:
        room[-1] = total % length
    heap = [(0.0, b) for b in range(bins)]
    spent, late = [0.0] * bins, []

    def put(k: int, start: int, n: int, b: int, capacity: int) -> None:
        pieces.append((k, start, n, sequence + b, capacity - room[b]))
        room[b] -= n
        spent[b] += cost(n)

    full = [*room]
    for n, k, start in rests:
        aside = []
        while heap and room[heap[0][1]] < n:
            aside.append(heapq.heappop(heap))
        if heap:
            b = heapq.heappop(heap)[1]
            put(k, start, n, b, full[b])
            if room[b]:
                heapq.heappush(heap, (spent[b], b))
        else:
            late.append((n, k, start))
        # A sequence too full for this rest may take a shorter one.
        for entry in aside:
            heapq.heappush(heap, entry)
    open_bins = sorted((b for b in range(bins) if room[b]), key=lambda b: (-room[b], b))
    at = 0
    for n, k, start in late:
        while n:
            b = open_bins[at]
            part = min(n, room[b])
            put(k, start, part, b, full[b])
            n, start = n - part, start + part
            at += not room[b]
    return pieces


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` (and ``ids``).

    A document is the ids of its text, special strings read as such, and the id ``END``. Sequences of ``length`` tokens are
    filled; each id lies in exactly one piece. Tasks pack what they read, in windows of
    ``WINDOW_TOKENS``, without a shuffle; a window's short last sequence is carried into the next
    window, so a task leaves one at most. ``sequence_id`` is unique over the tasks, not dense.

    A null text counts as empty and gives the closing id alone. Rows that repeat an id are
    separate documents. No rows give no pieces. Further columns are not read. ``path`` is the
    tokenizer's file, at the same place on every machine.
    """
    path = path or tokenizer_path()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens_of(path, special=True)
        end = np.array([END], "<u4").tobytes()
        base = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        key = None
        window: list[tuple] = []  # (id, bytes, tokens of the document, start): documents, or the rest of one
        size = 0

        def flush(last: bool) -> pa.RecordBatch:
            nonlocal window, size, base
            pieces = pack([len(ids) // 4 for _, ids, _, _ in window], length)
            used = max((p[3] for p in pieces), default=-1) + 1
            carried = []
            filled: dict[int, int] = {}
            for p in pieces:
                filled[p[3]] = filled.get(p[3], 0) + p[2]
            if not last:
                short = {s for s, n in filled.items() if n < length}
                carried = [(window[p[0]][0], window[p[0]][1][4 * p[1] : 4 * (p[1] + p[2])], window[p[0]][2], window[p[0]][3] + p[1]) for p in pieces if p[3] in short]
                pieces = [p for p in pieces if p[3] not in short]
            cut = [window[k][1][4 * s : 4 * (s + n)] for k, s, n, _, _ in pieces]
            arrays = [
                pa.array([window[p[0]][0] for p in pieces], key),
                pa.array([window[p[0]][3] + p[1] for p in pieces], pa.int64()),
                pa.array([p[2] for p in pieces], pa.int64()),
                pa.array([zlib.crc32(c) for c in cut], pa.int64()),
                pa.array([window[p[0]][2] for p in pieces], pa.int64()),
                pa.array([base + p[3] for p in pieces], pa.int64()),
                pa.array([p[4] for p in pieces], pa.int64()),
                *([pa.array(cut, pa.binary())] if with_ids else []),
            ]
            base += used
            window, size = carried, sum(len(c[1]) // 4 for c in carried)
            return pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids])

        for batch in batches:
            key = batch.schema.field("doc_id").type
            for who, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = encode(text.as_py()) + end
                window.append((who, ids, len(ids) // 4, 0))
                size += len(ids) // 4
                if size >= WINDOW_TOKENS:
                    yield flush(False)
        if window:
            yield flush(True)

    return rows.mapInArrow(run, schema)
