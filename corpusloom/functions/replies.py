"""Decisions in the replies of models, read as variants by Spark's own expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Caps of what is stored, in characters and entries.
REASON, TOPIC, ENTRY, ENTRIES = 1000, 200, 500, 50


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def strip(text: Column) -> Column:
    """Without blanks of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def unfenced(reply: Column) -> Column:
    """A reply without the fence around it: its first line, and all from the last fence on, are left out."""
    inner = lambda text: F.regexp_replace(F.regexp_replace(text, r"\A```[^\n]*\n", ""), r"(?s)```(?!.*```).*\z", "")
    return let(strip(F.coalesce(reply, F.lit(""))), lambda text: F.when(text.startswith("```"), strip(inner(text))).otherwise(text))


def decision_object(reply: Column) -> Column:
    """The JSON object of a reply that holds its decision, as text; null if there is none.

    Of the reply's balanced spans (the whole reply where that is the object; braces within quotes
    don't count) the last that is JSON and has a ``keep``, else the last that is JSON. One fold over
    braces, quotes and escapes finds it, whose state is the two best spans so far, so its cost is
    in proportion to the reply.
    """
    return let(unfenced(reply), _last_object)


def _last_object(text: Column) -> Column:
    # Each step: what stands before a mark, and the mark; a backslash takes the next character along.
    steps = F.regexp_extract_all(text, F.lit(r"""(?s)([^{}"\\]*+(?:\\.|[{}"]|\\\z))"""), F.lit(1))
    null = F.lit(None).cast("string")
    start = F.struct(F.lit(1).alias("at"), F.lit(0).alias("depth"), F.lit(0).alias("open"), F.lit(False).alias("quoted"), null.alias("any"), null.alias("kept"))

    def step(s: Column, piece: Column) -> Column:
        end = s["at"] + F.length(piece)
        mark = F.right(piece, F.lit(1))
        # An escape is one within quotes only; outside, the character after a backslash counts as itself.
        escaped = F.substring(F.right(piece, F.lit(2)), 1, 1) == "\\"
        real = ~(escaped & s["quoted"])
        quote, opens, closes = real & (mark == '"'), real & ~s["quoted"] & (mark == "{"), real & ~s["quoted"] & (mark == "}") & (s["depth"] > 0)
        whole = closes & (s["depth"] == 1)
        span = F.when(whole, F.substring(text, s["open"], end - s["open"]))
        state = lambda good: F.struct(
            end.alias("at"),
            F.when(opens, s["depth"] + 1).when(closes, s["depth"] - 1).otherwise(s["depth"]).alias("depth"),
            F.when(opens & (s["depth"] == 0), end - 1).otherwise(s["open"]).alias("open"),
            F.when(quote, ~s["quoted"]).otherwise(s["quoted"]).alias("quoted"),
            F.coalesce(good, s["any"]).alias("any"),
            F.coalesce(F.when(has_keep(good), good), s["kept"]).alias("kept"),
        )
        return let(span, lambda x: let(F.when(is_object(x), x), state))

    return F.aggregate(steps, start, step, lambda s: F.coalesce(s["kept"], s["any"]))


def is_object(text: Column) -> Column:
    """Whether a text is one JSON object; null for null."""
    return F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT")


def has_keep(text: Column) -> Column:
    return F.try_variant_get(F.try_parse_json(text), "$.keep", "variant").isNotNull()


def kind(value: Column) -> Column:
    """The kind of a variant: BOOLEAN, BIGINT, DECIMAL..., STRING, ARRAY..., OBJECT..., VOID."""
    return F.schema_of_variant(value)


def truth(value: Column) -> Column:
    """Whether a variant is not false, zero or empty; null for a missing value and for the JSON null."""
    text, of = F.try_variant_get(value, "$", "string"), kind(value)
    return (
        F.when(value.isNull() | (of == "VOID"), F.lit(None).cast("boolean"))
        .when(of == "BOOLEAN", text == "true")
        .when(of == "STRING", text != "")
        .when(of.startswith("ARRAY"), text != "[]")
        .when(of.startswith("OBJECT"), text != "{}")
        .otherwise(text.try_cast("double") != 0)
    )


def shown(value: Column) -> Column:
    """A variant as text; booleans are capitalised, lists and objects JSON."""
    text = F.try_variant_get(value, "$", "string")
    return F.when(kind(value) == "BOOLEAN", F.initcap(text)).otherwise(text)


def listed(value: Column) -> Column:
    """A list's entries as texts, cut to the caps; a text is a list of one, anything else null."""
    entries = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda x: F.substring(F.coalesce(shown(x), F.lit("None")), 1, ENTRY))
    of = kind(value)
    return F.when(of == "STRING", F.array(F.substring(shown(value), 1, ENTRY))).when(of.startswith("ARRAY"), F.slice(entries, 1, ENTRIES))


def parse_decision(reply: Column) -> Column:
    """``keep, score, reason, primary_topic, where_hit, evidence`` of a reply; all null without a JSON object.

    ``keep`` is 1 or 0 by truth, null if it is missing; a score that is no number is null, a reason
    that is missing or false empty. Reason, topic and lists are cut to what is stored.
    """
    return let(F.try_parse_json(decision_object(reply)), _decision)


def _get(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", "variant")


def _decision(v: Column) -> Column:
    some, reason, topic = v.isNotNull(), _get(v, "reason"), strip(shown(_get(v, "primary_topic")))
    score = _get(v, "score")
    number = F.when(kind(score) == "BOOLEAN", (shown(score) == "True").cast("double")).otherwise(F.try_variant_get(score, "$", "string").try_cast("double"))
    return F.struct(
        truth(_get(v, "keep")).cast("int").alias("keep"),
        number.alias("score"),
        F.when(some, F.when(F.coalesce(truth(reason), F.lit(False)), F.substring(shown(reason), 1, REASON)).otherwise("")).alias("reason"),
        F.nullif(F.substring(topic, 1, TOPIC), F.lit("")).alias("primary_topic"),
        listed(_get(v, "where")).alias("where_hit"),
        listed(_get(v, "evidence")).alias("evidence"),
    )


def parse_exclusion(reply: Column) -> Column:
    """``keep, score, reason`` of a reply of the second phase; all null without a JSON object or a verdict.

    The reason is the reply's ``reason``, else its ``verdict_reason``, with the hit in brackets
    before it unless that is missing or none in any case. A second phase has no score.
    """
    return let(F.try_parse_json(decision_object(reply)), _exclusion)


def _exclusion(v: Column) -> Column:
    keep = truth(_get(v, "keep")).cast("int")
    said = lambda key: F.when(F.coalesce(truth(_get(v, key)), F.lit(False)), shown(_get(v, key)))
    hit = strip(F.coalesce(said("exclusion_hit"), F.lit("")))
    reason = F.substring(F.coalesce(said("reason"), said("verdict_reason"), F.lit("")), 1, REASON)
    tagged = F.when((hit != "") & (F.lower(hit) != "none"), strip(F.concat(F.lit("["), hit, F.lit("] "), reason))).otherwise(reason)
    return F.struct(keep.alias("keep"), F.lit(None).cast("double").alias("score"), F.when(keep.isNotNull(), tagged).alias("reason"))


# What a hit's tag is shown as, and what a reason without a known one is.
HITS = {"incidental": "Excluded as Incidental", "homonym": "Excluded as homonym", "wrong_domain": "Excluded as wrong domain"}
KEPT = "KEPT"


def exclusion_label(reason: Column) -> tuple[Column, Column]:
    """``label, text`` of a stored reason: the shown label of its leading tag and the rest; a missing or unknown tag is kept, and stays in the text. Null counts as empty."""
    text = F.coalesce(reason, F.lit(""))
    form = r"(?s)\A\s*\[([A-Za-z_]+)\]\s*(.*)\z"
    label = F.try_element_at(F.create_map(*[F.lit(x) for pair in HITS.items() for x in pair]), F.lower(F.regexp_extract(text, form, 1)))
    return F.coalesce(label, F.lit(KEPT)).alias("label"), F.when(label.isNotNull(), F.regexp_extract(text, form, 2)).otherwise(text).alias("text")


def exclusion_display(reason: Column) -> Column:
    """Label and text in two lines; an empty or missing reason stays as it is."""
    label, text = exclusion_label(reason)
    return F.when(F.coalesce(reason, F.lit("")) == "", reason).otherwise(F.concat(label, F.lit("\n"), text))


def quotes(text: Column) -> Column:
    """Quoted phrases of a text in order: in straight or curly double quotes, or in single ones at the edges of words.

    2 to 200 characters on one line; blanks and ``.,:;`` at the ends go, and then two are needed.
    Bare numbers don't count, and of phrases that differ in case only the first does. Null has none.
    """
    # Fixed value: the three styles.
    styles = r'''"([^"\n]{2,200})"|“([^”\n]{2,200})”|(?<![A-Za-z0-9])['‘]([^'’\n]{2,200}?)['’](?![A-Za-z0-9])'''
    source = F.coalesce(text, F.lit(""))
    inner = F.transform(F.regexp_extract_all(source, F.lit(styles), F.lit(0)), lambda q: F.regexp_replace(F.substring(q, F.lit(2), F.length(q) - 2), r"\A[ .,:;]+|[ .,:;]+\z", ""))
    good = F.filter(inner, lambda q: (F.length(q) >= 2) & ~q.rlike(r"\A(?U:\d)+\z"))
    return let(good, _first_of_each)


def _first_of_each(items: Column) -> Column:
    """Of items that differ in case only the first, in order: sorted by form and place, so that equal ones stand side by side."""
    keyed = F.array_sort(F.transform(items, lambda q, i: F.struct(F.lower(q).alias("low"), i.alias("at"), q.alias("q"))))
    first = lambda all_: F.filter(all_, lambda x, i: (i == 0) | (F.try_element_at(all_, F.greatest(i, F.lit(1)))["low"] != x["low"]))
    ordered = F.array_sort(F.transform(let(keyed, first), lambda x: F.struct(x["at"].alias("at"), x["q"].alias("q"))))
    return F.transform(ordered, lambda x: x["q"])
