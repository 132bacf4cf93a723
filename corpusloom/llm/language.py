"""Language identification by compression with a dictionary for each language."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.samples import held_out

#: Texts of each language that its dictionary is cut from (about so many, by a hash), and its bytes.
SAMPLE_TEXTS, DICTIONARY_BYTES = 192, 1 << 17
#: Characters of a long text that may go into a dictionary.
SAMPLE_CHARS = 4096
#: Words are short, so matches of three bytes must count.
PARAMETERS = {"compression_level": 5, "strategy": zstandard.STRATEGY_GREEDY, "min_match": 3, "window_log": 18, "hash_log": 17, "chain_log": 17, "search_log": 3}
#: Bytes that are compressed at a time; a text's size is the sum over all of it.
PIECE = 2048
#: Unknown language: no letter at all.
UNKNOWN = "und"
#: A prediction counts as rejected if the second best language needs fewer bytes more than this.
MARGIN = 2
_NO_LETTER = re.compile(r"[\W\d_]+")


def letters(text: str | None) -> bytes:
    """Lower-case letters of the whole text, words parted by a blank; null has none."""
    return _NO_LETTER.sub(" ", (text or "").lower()).strip().encode("utf-8", "surrogatepass")


@dataclass
class Compressors:
    """Raw-content dictionaries by language, the most frequent language first."""

    dictionaries: dict[str, bytes]
    _made: list = field(default_factory=list, repr=False)

    def __getstate__(self):
        return {"dictionaries": self.dictionaries, "_made": []}

    def sizes(self, data: bytes) -> list[int]:
        if not self._made:
            for raw in self.dictionaries.values():
                own = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                how = zstandard.ZstdCompressionParameters(write_checksum=False, write_content_size=False, write_dict_id=False, **PARAMETERS)
                own.precompute_compress(compression_params=how)
                self._made.append(zstandard.ZstdCompressor(dict_data=own, compression_params=how))
        # A long text is its own dictionary soon; in pieces, each piece is compared with the languages.
        pieces = [data[k : k + PIECE] for k in range(0, len(data), PIECE)]
        return [sum(len(c.compress(p)) for p in pieces) for c in self._made]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected). Ties go to the more frequent language."""
        data = letters(text)
        if not data or not self.dictionaries:
            return UNKNOWN, 0.0, True
        sizes = self.sizes(data)
        names = list(self.dictionaries)
        best = min(range(len(names)), key=lambda k: (sizes[k], k))
        rest = [sizes[k] - sizes[best] for k in range(len(names)) if k != best]
        score = 1 / (1 + sum(math.exp(-min(d, 200) / 2) for d in rest))
        return names[best], score, bool(rest) and min(rest) < MARGIN


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE_TEXTS) -> Compressors:
    """Cut each language's dictionary from about ``sample`` texts that are not held out.

    The languages are counted over all rows; a text is taken if a hash of its id falls under its
    language's share, so the sample's size does not grow with the table. A long text gives a piece
    of ``SAMPLE_CHARS`` that begins where another hash of its id says. The pieces share a
    dictionary's bytes evenly; what short ones leave goes to longer ones. Null texts, null
    languages and languages of fewer than 8 bytes are left out; repeated rows are taken together.
    No rows give no dictionaries.
    """
    text = F.col(text_col)
    known = docs.where(F.col(lang_col).isNotNull() & text.isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), text.alias("text"))
    # One row a language; there are some thousands of languages at most.
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return Compressors({})
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, sample / n))])
    point = F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    begin = F.pmod(F.xxhash64(F.lit(6), "id"), F.greatest(F.lit(1), F.length("text") - SAMPLE_CHARS + 1)) + 1
    piece = F.substring("text", begin.cast("int"), F.lit(SAMPLE_CHARS)).alias("text")
    chosen = known.where(point < share[F.col("lang")]).select("lang", point.alias("point"), "id", piece)
    # Twice the expected number at most, whatever ids repeat.
    rows = chosen.orderBy("point", "lang", "id", "text").limit(2 * sample * len(counts)).collect()
    found: dict[str, list[bytes]] = {}
    for r in rows:
        data = letters(r.text)
        if data:
            found.setdefault(r.lang, []).append(data)
    out = {}
    for lang in sorted(counts, key=lambda name: (-counts[name], name)):
        raw = b" ".join(shares(found.get(lang, []), DICTIONARY_BYTES))[-DICTIONARY_BYTES:]
        if len(raw) >= 8:
            out[lang] = raw
    return Compressors(out)


def shares(data: list[bytes], room: int) -> list[bytes]:
    """Beginnings of all pieces in their order that fill ``room``: as long as one another, or whole."""
    even, left = 0, room
    for k, n in enumerate(sorted(map(len, data))):
        even = left // (len(data) - k)
        if n > even:
            break
        left -= n
    return [d[: max(even, 1)] for d in data] if sum(map(len, data)) > room else data


def identify(docs: DataFrame, model: Compressors, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected`` of every document, in one pass without a shuffle.

    ``lang_pred`` is the language whose dictionary makes the whole text smallest, ``und`` for a
    null text or one without letters. ``rejected`` marks narrow margins and ``und``. ``score`` is
    the best language's share when bytes count as evidence. Null ids count as held out; repeated
    rows are judged alike. No rows give no rows; further columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    key = rows.schema["doc_id"].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sent.value.predict(t.as_py()) for t in batch.column("text")]
            lang, score, rejected = zip(*found, strict=True) if found else ((), (), ())
            arrays = [batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return rows.mapInArrow(judge, f"doc_id {key}, held_out boolean, lang_pred string, score double, rejected boolean")
