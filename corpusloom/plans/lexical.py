"""Queries over stemmed keyword phrases, with SQL where it can express them."""

from __future__ import annotations

import itertools
import uuid

from pyspark.sql import functions as F

from corpusloom.functions import english
from corpusloom.operators import filters, phrases
from corpusloom.plans.roles import CONTENT, content
from corpusloom.sources.scratch import checkpoint_dir

PHRASES = ["Thanedble the aneas", "the enat with ingor", "onreing", "of the"]


def indexed(s, d):
    """An index of all usable pages, filled in three batches: a third of them with other texts, then all, then without some."""
    index = phrases.PhraseIndex(s, f"{checkpoint_dir(s)}/phrases-{uuid.uuid4().hex}", 16)
    pages = content(s, d).where(filters.is_usable()).select("doc_id", "url", phrases.page_text().alias("text"))
    index.add(pages.where("doc_id % 3 = 0").withColumn("text", F.concat(F.lit("older "), "text", F.lit(" thanedble of aneas"))), 0)
    index.add(pages, 1)
    index.remove(pages.where("doc_id % 10 = 7"), 2)
    return index


def _found(rows):
    return rows.select("url", F.array_join("hits", ",").alias("hits"))


def f_keyword_phrase(s, d):
    return _found(indexed(s, d).search(PHRASES))


def f_keyword_phrase_all(s, d):
    index = indexed(s, d)
    return _found(index.search(["mail8.example.com", "enating", "the"], "all").unionAll(index.search(["anea", "Enat"], "all")))


def f_keyword_explain(s, d):
    """Every page's title as a term; the normalised query needs stems and is tested apart."""
    said = phrases.explain_terms(content(s, d).select(F.col("doc_id").alias("id"), F.col("title").alias("term")))
    return said.select("term", F.array_join("content_words", " ").alias("content_words"), F.array_join("stop_words", " ").alias("stop_words"), "is_phrase", "plain")


QUERIES = {f.__name__: f for f in (f_keyword_phrase, f_keyword_phrase_all, f_keyword_explain)}

_STOP = ", ".join(f"'{w}'" for w in sorted(english.STOP))
_QUOTE = "CASE len({c}) WHEN 0 THEN '' WHEN 1 THEN '“' || {c}[1] || '”' ELSE '“' || array_to_string({c}[1:-2], '”, “') || '” and “' || {c}[-1] || '”' END"
_TAIL = f"{phrases.ENDINGS} {phrases.CAPITALS}"

_ENDS = ("e", "s", "es", "ed", "ing", "ly", "er", "or", "at", "ation", "ment", "able")


def _forms(stem: str) -> str:
    """SQL's list of the words of a stem: the stem with up to three endings, where that is the stem again."""
    ends = ("".join(x) for n in range(4) for x in itertools.product(_ENDS, repeat=n))
    return ", ".join(f"'{w}'" for w in sorted({stem + e for e in ends}) if english.stem(w) == stem)


_UNITS = f"""{CONTENT}, u AS (SELECT url, regexp_extract_all(lower(coalesce(title, '') || ' ' || coalesce(description, '') || ' ' || coalesce(search_text, '')), '{phrases.UNIT.replace("'", "''")}') AS us FROM typed WHERE usable AND doc_id % 10 <> 7),
w AS (SELECT url, flatten(list_transform(us, lambda x: CASE WHEN contains(x, '@') THEN [x] WHEN contains(x, '/') THEN [x, split_part(x, '/', 1), substr(x, strpos(x, '/'))] WHEN contains(x, '.') OR NOT contains(x, '-') THEN [x] ELSE [x] || string_split(x, '-') END)) AS ws FROM u),
p AS (SELECT url, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w)"""

ORACLE_SQL = {
    "f_keyword_phrase": f"""WITH {_UNITS}, a AS (SELECT * FROM p WHERE word IN ({_forms("thanedbl")})), b AS (SELECT * FROM p WHERE word IN ({_forms("anea")})), c AS (SELECT * FROM p WHERE word IN ({_forms("enat")})), e AS (SELECT * FROM p WHERE word IN ({_forms("ingor")})),
h AS (SELECT a.url, 0 AS n FROM a JOIN b ON b.url = a.url AND b.i = a.i + 2 UNION SELECT c.url, 1 FROM c JOIN e ON e.url = c.url AND e.i = c.i + 2 UNION SELECT url, 2 FROM p WHERE word IN ({_forms("onr")}))
SELECT url, string_agg({PHRASES}[n + 1], ',' ORDER BY n) AS hits FROM h GROUP BY url""",
    "f_keyword_phrase_all": f"""WITH {_UNITS}, x AS (SELECT DISTINCT url FROM p WHERE word IN ({_forms("enat")})), y AS (SELECT DISTINCT url FROM p WHERE word = 'mail8.example.com'), z AS (SELECT DISTINCT url FROM p WHERE word IN ({_forms("anea")}))
SELECT url, 'mail8.example.com,enating' AS hits FROM x JOIN y USING (url) UNION ALL SELECT url, 'anea,Enat' FROM x JOIN z USING (url)""",
    "f_keyword_explain": f"""WITH {CONTENT}, t AS (SELECT doc_id, regexp_replace(title, '^\\s+|\\s+$', '', 'g') AS term FROM content),
once AS (SELECT arg_min(term, doc_id) AS term FROM t WHERE term <> '' GROUP BY lower(term)),
w AS (SELECT term, regexp_split_to_array(term, '\\s+') AS words FROM once),
c AS (SELECT term, list_filter(words, lambda x: lower(x) NOT IN ({_STOP})) AS c, list_filter(words, lambda x: lower(x) IN ({_STOP})) AS s FROM w),
q AS (SELECT *, {_QUOTE.format(c='c')} AS cq, {_QUOTE.format(c='s')} AS sq FROM c),
n AS (SELECT *, CASE WHEN len(s) = 0 THEN '' ELSE CASE WHEN len(s) > 1 THEN ' The common words ' ELSE ' The common word ' END || sq || CASE WHEN len(s) > 1 THEN ' are' ELSE ' is' END || ' ignored' || CASE WHEN len(c) >= 2 THEN ', and may sit between the other words.' ELSE '.' END END AS note FROM q)
SELECT term, array_to_string(c, ' ') AS content_words, array_to_string(s, ' ') AS stop_words, len(c) >= 2 AS is_phrase,
CASE len(c) WHEN 0 THEN '{phrases.ONLY_STOP}' WHEN 1 THEN 'Matches a page that contains ' || cq || ' anywhere in its text. {_TAIL}' || note ELSE 'A phrase. Matches a page where ' || cq || ' appear together, in this order. {_TAIL}' || note END AS plain FROM n""",
}
