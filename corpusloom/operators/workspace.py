"""Saved selections: validation, suggestions, stored memberships, reviews and feedback."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.filters import effective_type, is_usable, keyword_text, page_key
from corpusloom.sources.scratch import cut

#: Letters of keywords that one automaton holds; more take a further pass over the pages.
KEYWORD_LETTERS = 8_000_000


def entries(text: Column) -> Column:
    """Entries of a list held as text: split at commas and line ends, trimmed, blanks dropped, each once."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), "[,\n]"), lambda x: F.trim(x))
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def validate(selections: DataFrame, longest: int) -> DataFrame:
    """``id, error`` of each fault of a selection: name required, too long or of other characters, no filter."""
    name = F.trim(F.coalesce("name", F.lit("")))
    none = reduce(lambda a, b: a & b, [F.size(entries(F.col(c))) == 0 for c in ("orgs", "types", "words")])
    faults = F.array_compact(F.array(
        F.when(name == "", "name is required"), F.when(F.length(name) > longest, "name is too long"),
        F.when((name != "") & ~name.rlike("^[A-Za-z0-9 #-]+$"), "name has other characters"), F.when(none, "no filter"),
    ))
    return selections.select("id", F.explode(faults).alias("error"))


def unknown_entries(selections: DataFrame, field: str, known: DataFrame, suggest: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``id, slug, suggestions`` of entries that ``known`` (slug) lacks; what ``suggest`` finds for them, joined by commas.

    ``suggest`` takes ``id, text`` and returns ``id, slug, rank``. An empty vocabulary checks nothing.
    """
    asked = selections.select("id", F.explode(entries(F.col(field))).alias("slug"))
    foreign = asked.join(known.select("slug").distinct(), "slug", "left_anti")
    if known.isEmpty():
        foreign = foreign.where(F.lit(False))
    near = suggest(foreign.select(F.col("slug").alias("id"), F.col("slug").alias("text")).distinct())
    joined = near.groupBy(F.col("id").alias("slug")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("slug").alias("s")))), lambda x: x["s"]), ",").alias("suggestions"))
    return foreign.join(joined, "slug", "left").select("id", "slug", "suggestions")


def params_changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """``id, changed``: do the filters differ as sets?"""
    same = lambda c: F.array_sort(entries(F.col(c))) == F.array_sort(entries(F.col(f"new_{c}")))
    met = old.join(new.select("id", *[F.col(c).alias(f"new_{c}") for c in ("orgs", "types", "words")]), "id")
    return met.select("id", (~(same("orgs") & same("types") & same("words"))).alias("changed"))


# Words that mean a document type.
SYNONYMS = {
    "news": "news_story", "press": "press_release", "forms": "form", "stats": "statistics",
    "guide": "detailed_guide", "guides": "detailed_guide", "policy": "policy_paper",
    "policies": "policy_paper", "regulations": "regulation", "consultations": "consultation",
    "publications": "publication", "notices": "notice", "speeches": "speech", "maps": "map",
}
# Words that say nothing about which organisation is meant.
COMMON = (
    "the", "of", "and", "for", "a", "an", "to", "in", "on", "with", "from", "that", "this",
    "have", "has", "you", "your", "our", "all", "any", "pages", "page", "step", "steps",
    "guide", "guides", "related", "about", "publish", "published", "document", "documents",
    "agency", "agencies", "department", "departments", "office", "offices", "service",
    "services", "authority", "board", "committee", "council", "team", "group", "unit",
)


def singular(word: Column) -> Column:
    """A rough singular: policies, cases, but not glass or its."""
    n = F.length(word)
    cut = F.when(word.endswith("ies") & (n > 4), F.concat(F.substring(word, F.lit(1), n - 3), F.lit("y")))
    return F.coalesce(cut, F.when(word.endswith("s") & ~word.endswith("ss") & (n > 3), F.substring(word, F.lit(1), n - 1)), word)


def suggest_types(asked: DataFrame, known: DataFrame) -> DataFrame:
    """``id, slug, rank``: types (``slug``) that a text (``id, text``) names: as a whole, by one of their words, singular or plural, or by a synonym.

    rank 0 is by words, 1 by a synonym alone. Texts without words, and null ones, name none.
    """
    said = asked.select("id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z_]+)"), F.lit(1)))).alias("word"))
    stems = said.union(said.select("id", singular(F.col("word")))).distinct()
    parts = known.select("slug", F.explode(F.array_distinct(F.concat(F.array("slug"), F.split("slug", "_")))).alias("word"))
    by_word = stems.join(parts, "word").select("id", "slug", F.lit(0).alias("rank"))
    pairs = known.sparkSession.createDataFrame(list(SYNONYMS.items()), "word string, slug string")
    by_synonym = said.join(pairs, "word").select("id", "slug", F.lit(1).alias("rank"))
    return by_word.union(by_synonym).groupBy("id", "slug").agg(F.min("rank").alias("rank"))


def suggest_organisations(asked: DataFrame, known: DataFrame, shortest: int = 4, limit: int = 20) -> DataFrame:
    """``id, slug, rank``: organisations (``slug, title, acronym``) that a text (``id, text``) names.

    A word of ``shortest`` letters or more names those whose slug or title holds it, any word those
    whose acronym it is; common words count for nothing. The first word comes first, then the
    shortest slug; an organisation counts by the first word that names it, and ``limit`` is the
    most a text gets. Pieces of slugs and titles are join keys, so no pair is compared that does
    not match. Null texts name none.
    """
    words_of = F.filter(F.regexp_extract_all(F.lower("text"), F.lit(r"([a-z0-9][a-z0-9&-]+)"), F.lit(1)), lambda w: ~w.isin(*COMMON))
    said = asked.select("id", F.posexplode(words_of).alias("pos", "piece"))
    pieces = lambda c: F.flatten(F.transform(F.sequence(F.lit(1), F.length(c) - (shortest - 1)), lambda i: F.transform(F.sequence(F.lit(shortest), F.length(c) - i + 1), lambda n: F.substring(c, i, n))))
    none = F.array().cast("array<string>")
    of = lambda name: F.when(F.length(name) >= shortest, pieces(F.lower(name))).otherwise(none)
    acronym = F.array_compact(F.array(F.lower("acronym")))
    keyed = known.select("slug", F.explode(F.array_distinct(F.concat(F.coalesce(of("slug"), none), F.coalesce(of("title"), none), acronym))).alias("piece"))
    found = said.join(keyed, "piece").groupBy("id", "slug").agg(F.min("pos").alias("pos"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("pos", F.length("slug"), "slug")))
    return ranked.where(F.col("rank") <= limit).select("id", "slug", "rank")


def keyword_hits(texts: DataFrame, words: DataFrame, letters: int = KEYWORD_LETTERS) -> DataFrame:
    """``url, word``: each word (``word``, lower case) that a page's text (``url, text``, lower case) holds, as a part of it, once.

    One automaton finds all words in one pass over a text. It goes to every task, so it holds
    words of ``letters`` letters in all; a longer list is dealt by hash over several, each of which
    takes a pass. Null texts and empty words hit nothing.
    """
    known = cut(words.select("word").where("word <> ''").distinct())
    size = known.agg(F.sum(F.length("word")).alias("n")).first().n or 0
    blocks = max(1, -(-size // letters))
    spark = texts.sparkSession

    def found(block: int) -> DataFrame:
        some = [r.word for r in known.where(F.pmod(F.xxhash64("word"), F.lit(blocks)) == block).collect()]  # bounded by ``letters``
        shared = spark.sparkContext.broadcast(some)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            machine = ahocorasick.Automaton()
            for word in shared.value:
                machine.add_word(word, word)
            machine.make_automaton()
            for batch in batches:
                urls, hits = [], []
                for url, text in zip(batch.column("url").to_pylist(), batch.column("text"), strict=True):
                    own = {word for _, word in machine.iter(text.as_py())} if text.is_valid and len(machine) else ()
                    urls += [url] * len(own)
                    hits += own
                yield pa.RecordBatch.from_arrays([pa.array(urls, pa.string()), pa.array(hits, pa.string())], ["url", "word"])

        return texts.select("url", "text").mapInArrow(run, "url string, word string")

    return reduce(DataFrame.unionAll, map(found, range(blocks)))


def refresh(pages: DataFrame, links: DataFrame, selections: DataFrame, most: int | None = None) -> DataFrame:
    """``category_id, content_id, url``: the members of every selection, in one pass over the pages.

    Selections (``id, orgs, types, words``) are rows, as many as there may be: each is looked up by
    its word and organisation, a star where it names none, and a page is entered under each of its
    words and organisations and under the stars; types are compared where both meet. So no pair is
    made that doesn't share a word and an organisation, and a selection's lists are multiplied only
    with each other. Selecting HTML publications keeps all of them, whatever their parents. An empty
    list filters nothing; a page without organisations meets selections that name none. More
    selections than ``most``, where it is given, are an error; none is left out.
    """
    if most is not None and selections.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} selections")
    lists = cut(selections.select(F.col("id").cast("long").alias("category_id"), *[entries(F.col(c)).alias(c) for c in ("orgs", "types", "words")]))
    star = lambda c: F.when(F.size(c) == 0, F.array(F.lit("*"))).otherwise(F.transform(c, lambda x: F.concat(F.lit("="), x)))
    low = F.array_distinct(F.transform("words", lambda w: F.lower(w)))
    asked = lists.select("category_id", "types", star(low).alias("words"), F.explode(star(F.col("orgs"))).alias("org")).select("category_id", "types", "org", F.explode("words").alias("word"))
    usable = pages.where(is_usable())
    words = lists.select(F.explode(low).alias("word"))
    hits = keyword_hits(usable.select("url", keyword_text().alias("text")), words)
    slugs = links.groupBy("url").agg(F.collect_set(F.concat(F.lit("="), "organisation_slug")).alias("held"))
    kinds = F.array_distinct(F.array_compact(F.array(effective_type(), F.when(F.col("document_type") == "html_publication", F.lit("html_publication")))))
    facts = usable.select("url", page_key().alias("content_id"), kinds.alias("kinds")).join(slugs, "url", "left")
    facts = cut(facts.select("url", "content_id", "kinds", F.explode(F.concat(F.array(F.lit("*")), F.coalesce("held", F.array().cast("array<string>")))).alias("org")))
    entered = facts.withColumn("word", F.lit("*")).unionByName(facts.join(hits.select("url", F.concat(F.lit("="), "word").alias("word")), "url"))
    met = entered.join(asked, ["word", "org"]).where((F.size("types") == 0) | F.arrays_overlap("types", "kinds"))
    return met.groupBy("category_id", "content_id").agg(F.min("url").alias("url"))


def overview(selections: DataFrame, members: DataFrame, counts: DataFrame) -> DataFrame:
    """Selections with their stored count (``id, pages_kept, computed_at``), null without one, and the size of their membership, zeros included; newest first."""
    n = members.groupBy(F.col("category_id").alias("id")).agg(F.count(F.lit(1)).alias("membership_count"))
    met = selections.join(counts, "id", "left").join(n, "id", "left")
    return met.select("id", "name", "created_at", "pages_kept", "computed_at", F.coalesce("membership_count", F.lit(0)).alias("membership_count")).orderBy(F.desc("created_at"), "id")


def page_of_results(rows: DataFrame, limit: int, offset: int) -> DataFrame:
    """A page of rows by url, with the number of all of them as ``total`` beside each."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.orderBy("url").offset(offset).limit(limit).crossJoin(F.broadcast(total))


def member_facts(members: DataFrame, pages: DataFrame, compared: DataFrame) -> DataFrame:
    """``category_id, members, computed_at, has_hits, types, has_comparison`` of each selection with members.

    ``members`` has ``category_id, url, hits, computed_at``; ``compared`` the ``category_id`` of
    stored comparisons. The latest build counts; hits are there if any row has them.
    """
    met = members.join(pages.select("url", "document_type"), "url", "left")
    types = F.array_join(F.array_sort(F.collect_set("document_type")), ",")
    facts = met.groupBy("category_id").agg(F.count(F.lit(1)).alias("members"), F.max("computed_at").alias("computed_at"), F.max(F.col("hits").isNotNull()).alias("has_hits"), types.alias("types"))
    there = compared.select("category_id", F.lit(True).alias("there")).distinct()
    return facts.join(there, "category_id", "left").withColumn("has_comparison", F.coalesce("there", F.lit(False))).drop("there")


def corpus_version(pages: DataFrame) -> DataFrame:
    """One row ``total, version``: usable pages, and a token that changes with their number or the time they were last seen."""
    own = pages.where(is_usable(withdrawn=True)).agg(F.count(F.lit(1)).alias("total"), F.max("last_seen_at").alias("last"))
    return own.select("total", F.substring(F.md5(F.concat_ws(":", F.col("total").cast("string"), "last")), 1, 8).alias("version"))


def delete_selection(tables: dict[str, DataFrame], category_id: int) -> dict[str, DataFrame]:
    """All tables without the selection's rows; rows of no selection stay. Tables without a category but with runs lose those of its runs (``runs``)."""
    gone = tables["runs"].where(F.col("category_id") == category_id).select("run_id")
    of = lambda df: df.where(~F.col("category_id").eqNullSafe(category_id)) if "category_id" in df.columns else df.join(gone, "run_id", "left_anti") if "run_id" in df.columns else df
    return {name: of(df) for name, df in tables.items()}


def input_mix(compared: DataFrame, held: DataFrame, floor: float) -> DataFrame:
    """Pages of the corpus that a run would see, by where they come from."""
    there = compared.join(held.select("url"), "url", "left_semi")
    n = lambda c: F.count(F.when(c, 1))
    over = F.coalesce(F.col("es_score") >= floor, F.lit(True))
    return there.agg(n(F.col("source") == "both").alias("n_both"), n(F.col("source") == "shortlister").alias("n_shortlister"), n((F.col("source") == "search") & over).alias("n_search"))


def search_pages_per_run(runs: DataFrame, results: DataFrame, compared: DataFrame, totals: DataFrame, shortlist_total: int) -> DataFrame:
    """``run_id, target, src_search, src_corpus``: what each run works towards, and where the pages it evaluated came from.

    ``runs`` has ``run_id, phase, source_run_id, scope_n``. A second phase works towards what its
    source run kept (null for an unknown one), a run over a list of its own towards that list, others
    towards the shortlist. Pages that only the search found are ``src_search``, the rest of the run's
    pages ``src_corpus``; both are null for a second phase.
    """
    only = compared.where("source = 'search'").select("url").distinct()
    found = results.join(only, "url", "left_semi").groupBy("run_id").agg(F.count(F.lit(1)).alias("found"))
    kept = totals.select(F.col("run_id").alias("source_run_id"), F.col("kept").alias("source_kept"))
    met = runs.join(found, "run_id", "left").join(totals.select("run_id", "pages"), "run_id", "left").join(kept, "source_run_id", "left")
    again, n = F.coalesce(F.lower("phase").contains("exclusion"), F.lit(False)), F.coalesce("found", F.lit(0))
    target = F.when(again, F.col("source_kept")).otherwise(F.coalesce(F.nullif(F.col("scope_n"), F.lit(0)), F.lit(shortlist_total)))
    return met.select("run_id", target.cast("bigint").alias("target"), F.when(~again, n).alias("src_search"), F.when(~again, F.greatest(F.lit(0), F.coalesce("pages", F.lit(0)) - n)).alias("src_corpus"))


def additions(compared: DataFrame, pages: DataFrame, links: DataFrame, registry: DataFrame, floor: float, forwarded: bool = False) -> DataFrame:
    """Search-only pages, those of the corpus first, then by url: ``url, title, document_type, phrases, es_score, organisations, in_corpus, forwarded``.

    ``organisations`` are titles (slugs where the registry has none), each once, in order.
    ``in_corpus``: fetched and no redirect. ``forwarded``: in the corpus and over the floor, or
    without a score; with ``forwarded`` only these.
    """
    only = compared.where("source = 'search'").select("url", "title", "document_type", "phrases", "es_score")
    titled = links.join(only.select("url"), "url", "left_semi").join(registry.select(F.col("slug").alias("organisation_slug"), F.col("title").alias("org_title")), "organisation_slug", "left")
    names = titled.groupBy("url").agg(F.array_join(F.array_sort(F.collect_set(F.coalesce("org_title", "organisation_slug"))), ", ").alias("organisations"))
    there = pages.where("content_hash IS NOT NULL AND NOT coalesce(is_redirect, false)").select("url", F.lit(True).alias("there")).distinct()
    in_corpus = F.coalesce("there", F.lit(False))
    met = only.join(names, "url", "left").join(there, "url", "left")
    out = met.select("url", "title", "document_type", "phrases", "es_score", F.coalesce("organisations", F.lit("")).alias("organisations"), in_corpus.alias("in_corpus"), (in_corpus & F.coalesce(F.col("es_score") >= floor, F.lit(True))).alias("forwarded"))
    return (out.where("forwarded") if forwarded else out).orderBy(F.desc("in_corpus"), "url")


def feedback(rows: DataFrame, newest: int = 500) -> DataFrame:
    """The ``newest`` rows, answers outside 1 to 5 as null."""
    stars = F.when(F.col("stars").between(1, 5), F.col("stars"))
    return rows.orderBy(F.desc("ts"), F.desc("id")).limit(newest).select("id", stars.alias("stars"))
