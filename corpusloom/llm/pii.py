"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds to them."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Tokens of an entity at most, and of the pieces in which longer islands are learned from.
LONGEST, TRAIN_TOKENS = 16, 80
#: Documents and island pieces that the field is trained on at most, and passes over them.
TRAIN_ROWS, TRAIN_PIECES, EPOCHS, RATE, RIDGE = 256, 4096, 4, 0.3, 1e-3
#: Characters before a piece that go along with it, for the word before.
CONTEXT = 24
#: An added span must beat the reading without it by so much (log odds).
CAUTION = 2.0

_EMAIL_END = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_EMAIL_MORE = re.compile(r"[._-]*[A-Za-z0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits that does not lead to a match does not from its later digits either.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|\S")
_TRIGGER = re.compile(r"[0-9@]|\(at\)|\[at\]")
_LAST_WORD = re.compile(r"\S+\s+$")
_SPACE = re.compile(r"\s")
_DIGITS = re.compile(r"[0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches found from each @: its local part is the whole run before it, so no run is read twice."""
    low, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        found = _EMAIL_END.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            low = found.end()
        else:
            low = at + 1
        at = text.find("@", low)


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points by kind, then start; the patterns that always hold."""
    if not text:
        return []
    out = [("email", s, e) for s, e in _emails(text)]
    if _DIGITS.search(text):
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-9:]) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", m.start(), m.end()))
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return out


@dataclass
class Island:
    """A stretch of blank-separated chunks with digits, @ signs, (at) or [at], in tokens; the field reads these."""

    text: str
    start: int
    tokens: list[tuple[int, int]]  # in the whole text
    before: str  # the word before


def islands(text: str) -> Iterator[Island]:
    """Maximal runs of chunks that hold a digit, @, (at) or [at], each parted by one blank; all else can't be an entity."""
    pos = 0
    while m := _TRIGGER.search(text, pos):
        start = m.start()
        while start > pos and not text[start - 1].isspace():
            start -= 1
        end = m.end()
        while True:
            gap = _SPACE.search(text, end)
            end = gap.start() if gap else len(text)
            if not gap or end + 1 >= len(text):
                break
            after = _SPACE.search(text, end + 1)
            stop = after.start() if after else len(text)
            if not _TRIGGER.search(text, end + 1, stop):
                break
            end = stop
        before = text[max(0, start - 24) : start].split()
        yield Island(text, start, [t.span() for t in _TOKEN.finditer(text, start, end)], before[-1].lower().strip(":.,") if before else "")
        pos = end


def allowed(span: str) -> tuple[str, ...]:
    """Kinds that a segment may be at all: bounds on digits, letters and marks."""
    digits = sum(map(span.count, "0123456789"))
    if "@" in span or "(at)" in span or "[at]" in span:
        return ("email",) if digits < 20 and ("." in span or "dot" in span) and span[0].isalnum() and span[-1].isalnum() and " " not in span else ()
    if digits < 4 or re.search(r"[^0-9\[\]().+ /-]", span):
        return ()
    out = []
    runs = _DIGITS.findall(span)
    if len(runs) == 4 and span[0].isdigit() and span[-1].isdigit() and span.count(".") == 3 and all(len(r) <= 3 and int(r) <= 255 for r in runs):
        out.append("ip")
    if 13 <= digits <= 19 and span[0].isdigit() and span[-1].isdigit() and luhn("".join(runs)):
        out.append("card")
    if 9 <= digits <= 15 and span[0] in "+(0123456789" and span[-1].isdigit():
        out.append("phone")
    return tuple(out)


#: Marks around a rewritten email in training.
AROUND = (("", ""), ("", ","), ("", "."), ("(", ")"))
_SHAPE = (re.compile(r"[A-Za-z]+"), re.compile(r"[0-9]+"))


def segment_features(island: Island, start: int, end: int) -> list[str]:
    """Features of a whole candidate segment: its shape, sizes and neighbours."""
    text = island.text
    span = text[start:end]
    coarse = _SHAPE[1].sub("9", _SHAPE[0].sub("a", span))
    fine = _SHAPE[1].sub(lambda m: f"9{len(m[0])}", _SHAPE[0].sub("a", span))
    left = text[start - 1] if start else " "
    right = text[end] if end < len(text) else " "
    kind = lambda c: "s" if c.isspace() else "a" if c.isalpha() else "9" if c.isdigit() else c
    marks = "".join(sorted(set(_SHAPE[1].sub("", _SHAPE[0].sub("", span)))))
    # Whether an email with a written-out @ goes on before or after the segment.
    whole = ["e%d" % (left not in _LOCAL and not _EMAIL_MORE.match(text, end))] if "(at)" in span or "[at]" in span else []
    return [*whole, "1", f"c{coarse}" if len(coarse) < 40 else "c-", f"f{fine}" if len(fine) < 40 else "f-", f"l{kind(left)}", f"r{kind(right)}", f"m{marks}", f"n{len(_DIGITS.findall(span))}", f"s{span[0] if not span[0].isalnum() else 'x'}", f"w{island.before if start == island.start else '-'}"]


@dataclass
class Field:
    """Weights of (kind, feature); a token outside entities scores 0."""

    weights: dict[tuple[str, str], float]

    def candidates(self, island: Island, taken: Sequence[tuple[int, int]] = ()) -> list[list[tuple[int, str, list[str], float]]]:
        """By end token: (begin token, kind, features, score) of each segment that may be an entity and meets none of ``taken`` (sorted by end)."""
        out: list[list[tuple[int, str, list[str], float]]] = [[] for _ in range(len(island.tokens) + 1)]
        text, tokens = island.text, island.tokens
        for i, (s, _) in enumerate(tokens):
            if not (text[s].isascii() and (text[s].isalnum() or text[s] in "+(")):
                continue
            # The first span that ends behind the segment's start bounds its end.
            after = bisect_right(taken, s, key=lambda x: x[1])
            stop = taken[after][0] if after < len(taken) else len(text)
            for j in range(i + 1, min(len(tokens), i + LONGEST) + 1):
                e = tokens[j - 1][1]
                if e > stop:
                    break
                if not (text[e - 1].isascii() and text[e - 1].isalnum()):
                    continue
                kinds = allowed(text[s:e])
                if kinds:
                    names = segment_features(island, s, e)
                    out[j] += [(i, kind, names, sum(self.weights.get((kind, n), 0.0) for n in names)) for kind in kinds]
        return out

    def decode(self, island: Island, caution: float = CAUTION, taken: Sequence[tuple[int, int]] = ()) -> list[tuple[str, int, int]]:
        """The best segmentation beside ``taken``, boundaries and kinds together: segments of up to ``LONGEST`` tokens, or tokens outside."""
        found = self.candidates(island, taken)
        best, back = [0.0] * len(found), [None] * len(found)
        for j in range(1, len(found)):
            best[j] = best[j - 1]
            for i, kind, _, score in found[j]:
                if best[i] + score - caution > best[j]:
                    best[j], back[j] = best[i] + score - caution, (i, kind)
        out, j = [], len(found) - 1
        while j > 0:
            if back[j]:
                i, kind = back[j]
                out.append((kind, island.tokens[i][0], island.tokens[j - 1][1]))
                j = i
            else:
                j -= 1
        return out[::-1]


def _add(a: float, b: float) -> float:
    low, high = (a, b) if a < b else (b, a)
    return high + math.log1p(math.exp(low - high))


def chances(found: list[list[tuple[int, str, list[str], float]]]) -> list[list[float]]:
    """The probability of each candidate segment, by the forward and backward sums over all segmentations."""
    n = len(found)
    ahead, behind = [0.0] * n, [0.0] * n
    for j in range(1, n):
        ahead[j] = ahead[j - 1]
        for i, _, _, score in found[j]:
            ahead[j] = _add(ahead[j], ahead[i] + score)
    begins: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for j in range(1, n):
        for i, _, _, score in found[j]:
            begins[i].append((j, score))
    for i in range(n - 2, -1, -1):
        behind[i] = behind[i + 1]
        for j, score in begins[i]:
            behind[i] = _add(behind[i], behind[j] + score)
    return [[math.exp(min(0.0, ahead[i] + score + behind[j] - ahead[-1])) for i, _, _, score in found[j]] for j in range(n)]


def train(examples: list[tuple[Island, list[tuple[str, int, int]]]]) -> Field:
    """Maximise the likelihood of the given segmentations over all possible ones, by AdaGrad."""
    field = Field({})
    squares: dict[tuple[str, str], float] = {}
    for _ in range(EPOCHS):
        for island, gold in examples:
            found = field.candidates(island)
            right = set(gold)
            for j, chance in enumerate(chances(found)):
                for (i, kind, names, _), p in zip(found[j], chance, strict=True):
                    g = p - ((kind, island.tokens[i][0], island.tokens[j - 1][1]) in right)
                    if abs(g) > 1e-4:
                        for name in names:
                            key = (kind, name)
                            d = g + RIDGE * field.weights.get(key, 0.0)
                            squares[key] = squares.get(key, 1e-2) + d * d
                            field.weights[key] = field.weights.get(key, 0.0) - RATE * d / math.sqrt(squares[key])
    return field


def variants(kind: str, span: str) -> list[str]:
    """Ways to write an entity that the fixed patterns don't read; the field learns from them too."""
    if kind == "email":
        name, _, host = span.partition("@")
        return [f"{name}{at}{host}" for at in ("(at)", "[at]")]
    if kind == "ip":
        return [span.replace(".", "[.]"), span.replace(".", "(.)")]
    if kind == "card":
        digits = "".join(_DIGITS.findall(span))
        return [mark.join(digits[k : k + 4] for k in range(0, len(digits), 4)) for mark in (".", "/")]
    digits = "".join(_DIGITS.findall(span))[-10:]
    return [f"({digits[:3]}) {digits[3:6]}-{digits[6:]}", f"{digits[:3]}-{digits[3:6]}-{digits[6:]}"] if len(digits) == 10 else []


def pieces_of(text: str) -> Iterator[str]:
    """The islands of a text in pieces of ``TRAIN_TOKENS``, with what stands just before and after."""
    spans = sorted((s, e) for _, s, e in base_spans(text))
    for island in islands(text):
        k = 0
        while k < len(island.tokens):
            last = min(k + TRAIN_TOKENS, len(island.tokens)) - 1
            end = island.tokens[last][1]
            # A piece goes on to the end of a span that it would cut.
            at = bisect_right(spans, end - 1, key=lambda x: x[1])
            if at < len(spans) and spans[at][0] < end:
                end = spans[at][1]
            start = island.tokens[k][0]
            # The word before an island has no digits; what stands before a later piece belongs to the island.
            word = _LAST_WORD.search(text[max(0, start - CONTEXT) : start]) if k == 0 else None
            yield text[start - (len(word[0]) if word else 0) : min(len(text), end + 1)]
            while k < len(island.tokens) and island.tokens[k][1] <= end:
                k += 1


def examples_of(text: str) -> Iterator[tuple[Island, list[tuple[str, int, int]]]]:
    """Islands of a text with their fixed-pattern spans; and again with each span rewritten."""
    spans = base_spans(text)
    for island in islands(text):
        end = island.tokens[-1][1]
        own = [s for s in spans if s[1] >= island.start and s[2] <= end]
        yield island, own
        for kind, s, e in own:
            low, high = max(0, island.start - CONTEXT), min(len(text), end + 1)
            for other in variants(kind, text[s:e]):
                for left, right in AROUND if kind == "email" else AROUND[:1]:
                    changed = text[low:s] + left + other + right + text[e:high]
                    at = s - low + len(left)
                    others = [x for x in base_spans(changed) if x[2] <= at or x[1] >= at + len(other)]
                    for again in islands(changed):
                        if again.start <= at < again.tokens[-1][1]:
                            yield again, [(kind, at, at + len(other)), *(x for x in others if x[1] >= again.start and x[2] <= again.tokens[-1][1])]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = TRAIN_ROWS, pieces: int = TRAIN_PIECES) -> Field:
    """Train on at most ``pieces`` island pieces of about ``limit`` texts with digits or @ signs, chosen by hashes.

    The fixed patterns label them; numbers that no pattern reads teach the field what to leave.
    The texts are counted first, so that at any size about as many as needed are cut, on the
    executors; only the pieces leave them. Without such texts the field adds nothing.
    """
    text = F.col(text_col)
    some = docs.where(text.rlike("@[A-Za-z0-9]|[0-9]{3}")).select(F.pmod(F.xxhash64(F.lit(9), F.col(id_col), text), F.lit(1 << 40)).alias("h"), text.alias("text"))
    share = min(1.0, limit / max(some.count(), 1))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column("text").to_pylist():
                yield pa.RecordBatch.from_pydict({"piece": list(pieces_of(t))}, schema=pa.schema([("piece", pa.string())]))

    found = some.where(F.col("h") < int(share * (1 << 40))).mapInArrow(cut, "piece string")
    rows = found.orderBy(F.xxhash64(F.lit(9), "piece"), "piece").limit(pieces).collect()
    return train([x for r in rows for x in examples_of(r.piece)])


def all_spans(text: str | None, field: Field) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """The fixed-pattern spans, and these with what the field adds beside them: they stand fixed when it reads the rest."""
    base = base_spans(text)
    if not text:
        return base, base
    # Spans of two kinds may overlap; joined, they are in order of start and of end.
    taken: list[tuple[int, int]] = []
    for s, e in sorted((s, e) for _, s, e in base):
        if taken and s < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(e, taken[-1][1]))
        else:
            taken.append((s, e))
    added = [span for island in islands(text) for span in field.decode(island, taken=taken)]
    if not added:
        return base, base
    return base, sorted(base + added, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find_pii(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added`` of every document.

    The counts and the digest (sha256 of ``kind:start:end`` by kind and start) are those of the
    fixed patterns; ``spans`` also holds what the field adds. Positions are code points, ends
    exclusive. Added spans never overlap base ones. A null text counts as empty; repeated rows are
    read alike; null ids stay null. No rows give no rows; further columns are not read. One pass,
    no shuffle; long texts cost in proportion to their length.
    """
    sent = docs.sparkSession.sparkContext.broadcast(field)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    key = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[] for _ in KINDS]
            sums, spans, added = [], [], []
            for text in batch.column("text"):
                base, every = all_spans(text.as_py(), sent.value)
                for k, kind in enumerate(KINDS):
                    counts[k].append(sum(s[0] == kind for s in base))
                sums.append(hashlib.sha256(written(base).encode()).hexdigest())
                spans.append(written(every))
                added.append(len(every) - len(base))
            arrays = [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(sums, pa.string()), pa.array(spans, pa.string()), pa.array(added, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return rows.mapInArrow(read, f"doc_id {key}, {', '.join(f'n_{k} bigint' for k in KINDS)}, base_sha256 string, spans string, n_added bigint")


def redacted(text: str | None, spans: str) -> str | None:
    """The text with each written span replaced by its kind in brackets."""
    if not text or not spans:
        return text
    out, at = [], 0
    for kind, s, e in sorted(((k, int(s), int(e)) for k, s, e in (x.split(":") for x in spans.split(","))), key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
            at = e
    return "".join([*out, text[at:]])
