"""Readability of a text as column expressions; nothing leaves the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.numbers import rounded

WORD = "[A-Za-z]+"
SENTENCE = "[.!?]+"
# The issue classes with their weights and terms, the star bands and the limits.
ISSUES = {
    "words_to_avoid": (2.0, (
        "advancing", "collaborate", "combating", "commit", "countering", "deploy", "dialogue", "disincentivise", "empower", "facilitate", "foster", "impactful",
        "initiate", "leverage", "liaise", "overarching", "pledge", "robust", "streamline", "strengthening", "tackling", "transform", "utilise", "utilize",
        "utilising", "utilizing", "endeavour", "commence", "purchase", "additional", "regarding", "aforementioned", "henceforth", "hereby", "notwithstanding",
    )),
    "phrases_to_avoid": (1.0, (
        "in order to", "going forward", "at this moment in time", "please note", "with regard to", "in respect of", "prior to", "in the event that",
        "a number of", "ring fenced", "ring-fenced", "best practice", "deep dive",
    )),
    "nominalisation": (3.0, (
        "implementation", "implementations", "completion", "completions", "provision", "provisions", "application", "applications", "utilisation", "utilisations",
        "consideration", "considerations", "requirement", "requirements", "assessment", "assessments", "notification", "notifications", "commencement", "commencements",
    )),
    "vague_language": (2.0, ("some", "many", "often", "regularly", "normally", "usually", "generally", "approximately", "soon", "quickly", "various", "several", "etc")),
    "unnecessary_words": (1.0, ("very", "really", "actually", "basically", "currently", "in fact", "it is important to note that", "it should be noted that")),
    "there_is_are": (1.0, ("there is", "there are")),
    "impersonal_it_is": (2.0, (
        "it is required", "it is necessary", "it is essential", "it is mandatory", "it is important", "it is expected",
        "it is recommended", "it is advisable", "it is possible", "it is prohibited", "it is forbidden",
    )),
    "gov_focused": (2.0, ("we", "us", "our")),
    "applicant": (3.0, ("applicant", "applicants")),
    "negative_phrasing": (2.0, ("you must not", "you should not", "you shouldn't")),
}
STARS = ((10.0, 5), (20.0, 4), (35.0, 3), (55.0, 2))
RATED_WORDS = 40
LONG_SENTENCE, LONG_WEIGHT = 25, 3.0


def words(text: Column) -> Column:
    """Runs of the letters A to Z of a text, in order; null has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), F.lit(1))


def syllables(word: Column) -> Column:
    """Vowel groups (y included) less a silent final e, at least 1."""
    low = F.lower(word)
    groups = F.regexp_count(low, F.lit("[aeiouy]+"))
    return F.greatest(F.lit(1), groups - F.when(low.endswith("e") & (groups > 1), 1).otherwise(0))


def sentence_count(text: Column) -> Column:
    """Runs of sentence marks, at least 1."""
    return F.greatest(F.lit(1), F.regexp_count(F.coalesce(text, F.lit("")), F.lit(SENTENCE)))


def grade(text: Column, found: Column | None = None) -> Column:
    """Flesch-Kincaid grade to one place; null under ten words. ``found`` is a column with the text's ``words``, where one has been made."""
    found = words(text) if found is None else found
    n = F.size(found)
    spoken = F.aggregate(found, F.lit(0), lambda total, w: total + syllables(w))
    return F.when(n >= 10, rounded(0.39 * n / sentence_count(text) + 11.8 * spoken / n - 15.59, 1))


def reading_age(of_grade: Column) -> Column:
    """Grade + 5, at least 5, to one place; null without a grade."""
    return F.when(of_grade.isNotNull(), rounded(F.greatest(F.lit(5.0), of_grade + 5), 1))


#: The classes' single words; all else of a class is a phrase.
SINGLE = {name: [t for t in terms if t.isalpha()] for name, (_, terms) in ISSUES.items()}


def _among(words_of: Column, some: list[str]) -> Column:
    return F.filter(words_of, lambda w: w.isin(some))


def listed_words(text: Column) -> Column:
    """The words of a text that any class lists, in order, lower-case."""
    every = sorted({t for terms in SINGLE.values() for t in terms})
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)), lambda w: w.isin(every))


def _phrase_count(low: Column, phrases: list[str]) -> Column:
    """Occurrences of phrases as whole words; the pattern is tried only where one stands in the text at all."""
    there = reduce(lambda a, b: a | b, map(low.contains, phrases))
    return F.when(there, F.regexp_count(low, F.lit(rf"(?<![\p{{L}}\p{{N}}_])(?:{'|'.join(phrases)})(?![\p{{L}}\p{{N}}_])"))).otherwise(0)


def issue_counts(text: Column, listed: Column | None = None) -> dict[str, Column]:
    """Occurrences of each class; whole words between other characters than letters, digits and _, longer terms first, without case.

    Single words are counted in ``listed_words``, phrases are looked for by pattern. ``listed`` is a
    column that holds these words already: made in a step before, the text is cut into words once
    and not for every class.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    marked = listed_words(text) if listed is None else listed
    out = {}
    for name, (_, terms) in ISSUES.items():
        single, phrases = SINGLE[name], sorted(set(terms) - set(SINGLE[name]), key=lambda t: (-len(t), t))
        words_of = F.size(_among(marked, single)) if single else F.lit(0)
        out[name] = words_of + _phrase_count(low, phrases) if phrases else words_of
    out["long_sentences"] = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), SENTENCE, -1), lambda s: F.regexp_count(s, F.lit(WORD)) > LONG_SENTENCE))
    return out


def impact(counts: dict[str, Column]) -> Column:
    """Sum of weight * log2(1 + n) over the classes, to two places."""
    weight = {name: w for name, (w, _) in ISSUES.items()} | {"long_sentences": LONG_WEIGHT}
    total = F.lit(0.0)
    for name, n in counts.items():
        total = total + weight[name] * F.log2(1 + n)
    return rounded(total, 2)


def stars(of_impact: Column, n_words: Column) -> Column:
    """5 to 1 from the impact per 1,000 words; null under 40 words."""
    rate, band = of_impact / (n_words / 1000.0), F.lit(1)
    for edge, n in reversed(STARS):
        band = F.when(rate <= edge, n).otherwise(band)
    return F.when(n_words >= RATED_WORDS, band)


# The classes' names, in the order in which ties go.
NAMES = {
    "words_to_avoid": "Words to avoid", "phrases_to_avoid": "Phrases to avoid", "long_sentences": "Over-long sentences", "nominalisation": "Nominalisations", "vague_language": "Vague language",
    "unnecessary_words": "Unnecessary words", "there_is_are": "There is / there are", "impersonal_it_is": "Impersonal ‘It is’", "gov_focused": "Government-focused (we/us/our)", "applicant": "Applicant vs you", "negative_phrasing": "Negative phrasing",
}


def findings(counts: dict[str, Column]) -> tuple[Column, Column]:
    """``Name: n`` of the classes that occur, most first, as one text (empty if there are none); and the total."""
    pairs = F.array(*[F.struct((-counts[key]).alias("m"), F.lit(k).alias("o"), F.lit(name).alias("k")) for k, (key, name) in enumerate(NAMES.items()) if key in counts])
    found = F.array_sort(F.filter(pairs, lambda x: x["m"] < 0))
    total = sum(counts.values(), F.lit(0))
    return F.array_join(F.transform(found, lambda x: F.concat(x["k"], F.lit(": "), (-x["m"]).cast("string"))), "; "), total
