"""Keyword terms as stemmed English phrases, and what such a term means in plain words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpusloom.functions import english

#: The units of a lower-case text, as ``english.units`` finds them.
UNIT = r"[\p{L}\p{N}][\p{L}\p{N}._%+-]*@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+|(?:[\p{L}\p{N}][\p{L}\p{N}-]*\.)+[a-z][a-z]+(?:/[^\s\"'<>]*)?|[\p{L}\p{N}]+(?:\.[\p{L}\p{N}]+)+|[\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)+|[\p{L}\p{N}]+"
#: A word that nothing joins to what follows is a unit of its own: most are, and need none of the longer forms tried.
_ALONE = r"[\p{L}\p{N}]++(?![._%+@-])"


def whole_units(text: Column) -> Column:
    """The words and units of a text in lower case, in order, without their parts; null has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"{_ALONE}|{UNIT}"), F.lit(0))


def unit_list(text: Column) -> Column:
    """The words and units of a text in lower case, in order; null has none."""
    found = whole_units(text)
    at = lambda u: F.locate("/", u)
    parts = lambda u: (
        F.when(F.contains(u, F.lit("@")), F.array(u))
        .when(F.contains(u, F.lit("/")), F.array(u, F.substring(u, F.lit(1), at(u) - 1), F.substring(u, at(u), F.length(u))))
        .when(F.contains(u, F.lit(".")) | ~F.contains(u, F.lit("-")), F.array(u))
        .otherwise(F.concat(F.array(u), F.split(u, "-")))
    )
    return F.flatten(F.transform(found, parts))


def posting_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``stem, url, positions`` of pages (``url, units``), stop words left out; a page's lists never leave its task.

    Each different unit of a batch is cut into its parts and stemmed once, and all its places follow as arrays.
    """
    for batch in batches:
        held = batch.column("units")
        coded = held.flatten().dictionary_encode()
        pieces = [english.parts(u) for u in coded.dictionary.to_pylist()]
        words = [w for p in pieces for w in p]
        known: dict[str, int] = {}
        stem_of = np.array([-1 if w in english.STOP else known.setdefault(english.stem(w), len(known)) for w in words], np.int64)
        size = np.array([len(p) for p in pieces], np.int64)
        unit = coded.indices.to_numpy(zero_copy_only=False)
        each = size[unit]
        # The parts of all units in order, and the page and place of each.
        part = np.repeat((np.cumsum(size) - size)[unit] - (np.cumsum(each) - each), each) + np.arange(each.sum())
        ends = np.concatenate([[0], np.cumsum(each)])[np.concatenate([[0], np.cumsum(held.value_lengths().to_numpy(zero_copy_only=False))])]
        page = np.repeat(np.arange(len(held)), np.diff(ends))
        at = np.arange(len(page)) - ends[page]
        stem = stem_of[part]
        kept = np.flatnonzero(stem >= 0)
        group = page[kept] * max(1, len(known)) + stem[kept]
        kept = kept[order := np.argsort(group, kind="stable")]
        first = np.flatnonzero(np.diff(group[order], prepend=-1))
        positions = pa.ListArray.from_arrays(pa.array(np.append(first, len(kept)), pa.int32()), pa.array(at[kept], pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array(list(known), pa.string()).take(pa.array(stem[kept[first]])), batch.column("url").take(pa.array(page[kept[first]])), positions], ["stem", "url", "positions"])


#: Folders that an index's posting lists are dealt over by stem.
BUCKETS = 256


class PhraseIndex:
    """A stored positional index: which stems stand where on which pages.

    ``postings/batch=n/bucket=b`` holds a row (``stem, url, positions``) for each stem of a page,
    sorted by stem, so a query reads the buckets of its own stems only, and of these the row groups
    that hold them. ``buckets`` is the same whenever an index is opened. ``pages/batch=n`` says which pages a batch put in (``url, digest``) or took out
    (a null digest); a page counts as its newest batch has it. A batch that is written again
    replaces itself, so a run that failed is run again.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("stem"), F.lit(self.buckets)).cast("int").alias("bucket")

    def _write(self, lists: DataFrame, batch: int) -> None:
        """Posting lists by bucket; a bucket that is too large for one task is split, as a common stem's would be."""
        dealt = lists.select("stem", "url", "positions", self._bucket()).hint("rebalance", F.col("bucket"))
        dealt.sortWithinPartitions("bucket", "stem").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings/batch={batch}")

    def _read(self, name: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def pages(self, before: int | None = None) -> DataFrame:
        """``url, batch, digest`` of the pages in the index, as of a batch's start."""
        rows = self._read("pages", "url string, digest string, batch int")
        rows = rows if before is None else rows.where(F.col("batch") < before)
        newest = rows.groupBy("url").agg(F.max(F.struct("batch", "digest")).alias("x"))
        return newest.select("url", "x.batch", "x.digest").where("digest IS NOT NULL")

    def add(self, pages: DataFrame, batch: int) -> None:
        """Put in the pages (``url, text``) that are new or whose text has changed; a null url is left out, of repeated urls one text counts (the greatest)."""
        one = pages.where("url IS NOT NULL").groupBy("url").agg(F.max(F.coalesce("text", F.lit(""))).alias("text"))
        held = self.pages(batch).select("url", F.col("digest").alias("held"))
        changed = one.withColumn("digest", F.sha2("text", 256)).join(held, "url", "left").where("NOT digest <=> held")
        self._write(changed.select("url", whole_units(F.col("text")).alias("units")).mapInArrow(posting_lists, "stem string, url string, positions array<int>"), batch)
        changed.select("url", "digest").write.mode("overwrite").parquet(f"{self.path}/pages/batch={batch}")

    def remove(self, urls: DataFrame, batch: int) -> None:
        """Take out pages (``url``); the batch must be one of its own."""
        gone = urls.select("url").where("url IS NOT NULL").distinct()
        gone.select("url", F.lit(None).cast("string").alias("digest")).write.mode("overwrite").parquet(f"{self.path}/pages/batch={batch}")

    def compact(self, path: str) -> PhraseIndex:
        """The index in one batch at a new path, without the lists of pages that were changed or taken out."""
        made = PhraseIndex(self.spark, path, self.buckets)
        live = self.pages()
        kept = self.postings().join(live.select("url", "batch"), ["url", "batch"], "left_semi")
        made._write(kept, 0)
        live.select("url", "digest").write.parquet(f"{made.path}/pages/batch=0")
        return made

    def postings(self, stems_of: list[str] | None = None) -> DataFrame:
        """Posting lists, of some stems or of all; what a list of stems doesn't need isn't read."""
        rows = self._read("postings", "stem string, url string, positions array<int>, batch int, bucket int")
        if stems_of is None:
            return rows
        known = self.spark.createDataFrame([(s,) for s in stems_of], "stem string")
        buckets = sorted({r.bucket for r in known.select(self._bucket()).distinct().collect()})
        return rows.where(F.col("bucket").isin(buckets) & F.col("stem").isin(stems_of))

    def search(self, terms: list[str], match: str = "any") -> DataFrame:
        """``url, hits``: pages that hold any (or all) of the terms as phrases, with the terms found in the order given.

        The stems of a term stand at its distances; a stop word within a term leaves room for any
        one word. Posting lists meet on page and start, so a page's text is not read. Terms of stop
        words alone are left out; if no term is left, no page matches. The terms are a user's own
        list; a stem may have any number of word forms.
        """
        asked = [(n, offset, stem) for n, t in enumerate(terms) for offset, stem in english.phrase(t)]
        counted = sorted({n for n, _, _ in asked})
        if not counted:
            return self.spark.createDataFrame([], "url string, hits array<string>")
        sizes = {n: len({o for m, o, _ in asked if m == n}) for n in counted}
        query = self.spark.createDataFrame([(n, o, s, sizes[n]) for n, o, s in asked], "n int, offset int, stem string, size int")
        lists = self.postings(sorted({s for _, _, s in asked})).join(query, "stem")
        single = lists.where("size = 1").select("n", "url", "batch")
        starts = lists.where("size > 1").select("n", "size", "offset", "url", "batch", F.explode("positions").alias("p")).groupBy("n", "size", "url", "batch", (F.col("p") - F.col("offset")).alias("start")).agg(F.count(F.lit(1)).alias("met"))
        found = single.unionAll(starts.where("met = size").select("n", "url", "batch")).distinct()
        live = found.join(self.pages().select("url", "batch"), ["url", "batch"], "left_semi")
        per = live.groupBy("url").agg(F.array_sort(F.collect_set("n")).alias("ns"))
        names = F.array(*map(F.lit, terms))
        hits = F.transform("ns", lambda n: F.element_at(names, n + 1))
        return per.where(F.size("ns") >= (1 if match == "any" else len(counted))).select("url", hits.alias("hits"))


def page_text() -> Column:
    """What a term is looked for in: title, description and text."""
    return F.concat_ws(" ", "title", "description", "search_text")


def _quoted(words: Column) -> Column:
    """“a”, “b” and “c”."""
    marked = F.transform(words, lambda w: F.concat(F.lit("“"), w, F.lit("”")))
    head = F.array_join(F.slice(marked, F.lit(1), F.greatest(F.size(marked) - 1, F.lit(0))), ", ")
    last = F.element_at(marked, -1)
    return F.when(F.size(marked) == 0, "").when(F.size(marked) == 1, last).otherwise(F.concat(head, F.lit(" and "), last))


# The sentences that users read.
ENDINGS = "Word endings don’t matter — different forms of the word match too."
CAPITALS = "Capital letters are ignored."
ONLY_STOP = "Every word here is a very common word that search ignores, so on its own this term won’t match anything. Try a more specific word."


def explain_terms(terms: DataFrame) -> DataFrame:
    """``term, content_words, stop_words, is_phrase, query, plain`` for a table ``id, term``.

    Words are split at white space. Blank and null terms are left out; of terms that differ only
    in capitals the one with the smallest id stays.
    """
    trimmed = terms.withColumn("term", F.regexp_replace("term", r"^\s+|\s+$", "")).where("term <> ''")
    once = trimmed.groupBy(F.lower("term").alias("k")).agg(F.min_by("term", F.struct("id", "term")).alias("term"))
    words = F.split("term", r"\s+")
    is_stop = lambda w: F.lower(w).isin(sorted(english.STOP))
    split = once.select("term", F.filter(words, lambda w: ~is_stop(w)).alias("content_words"), F.filter(words, is_stop).alias("stop_words"))
    n, stops = F.size("content_words"), F.size("stop_words")
    ignored = F.concat(F.when(stops > 1, " The common words ").otherwise(" The common word "), _quoted(F.col("stop_words")), F.when(stops > 1, " are ignored").otherwise(" is ignored"), F.when(n >= 2, ", and may sit between the other words.").otherwise("."))
    note = F.when(stops > 0, ignored).otherwise("")
    one = F.concat(F.lit("Matches a page that contains "), _quoted(F.col("content_words")), F.lit(f" anywhere in its text. {ENDINGS} {CAPITALS}"), note)
    more = F.concat(F.lit("A phrase. Matches a page where "), _quoted(F.col("content_words")), F.lit(f" appear together, in this order. {ENDINGS} {CAPITALS}"), note)

    @F.pandas_udf(StringType())
    def query(column: pd.Series) -> pd.Series:
        return column.map(english.normalised)

    return split.select("*", (n >= 2).alias("is_phrase"), query("term").alias("query"), F.when(n == 0, ONLY_STOP).when(n == 1, one).otherwise(more).alias("plain"))
