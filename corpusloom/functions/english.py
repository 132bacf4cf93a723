"""English full-text words: tokens, stop words and Porter2 stems."""

from __future__ import annotations

import re
from functools import lru_cache

# The stop words of the Snowball project's English list, in its order.
STOP = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers
    herself it its itself they them their theirs themselves what which who whom this that these those am is are
    was were be been being have has had having do does did doing a an the and but if or because as until while
    of at by for with about against between into through during before after above below to from up down in out
    on off over under again further then once here there when where why how all any both each few more most
    other some such no nor not only own same so than too very s t can will just don should now""".split()
)

# The suffixes and exceptions of the published Porter2 algorithm.
_WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_KEPT = {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes"}
_KEPT_LATER = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful",
    "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less", "ogi": "og", "li": "",
}
_STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")

_TOKEN = re.compile(r"[^\W_]+")
_REGION = re.compile(r"[aeiouy][^aeiouy]")
_VOWEL = re.compile(r"[aeiouy]")
_SHORT_END = re.compile(r"(^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$")
_DOUBLE = re.compile(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$")


def tokens(text: str | None) -> list[str]:
    """Runs of letters and digits, in lower case."""
    return _TOKEN.findall((text or "").lower())


# What counts as one unit, in this order: e-mail addresses, web addresses, dotted numbers, hyphenated words, words.
_UNIT = re.compile(
    r"[^\W_](?:[^\W_]|[._%+-])*@(?:[^\W_]|-)+(?:\.(?:[^\W_]|-)+)+|(?:[^\W_](?:[^\W_]|-)*\.)+[a-z][a-z]+(?:/[^\s\"'<>]*)?|[^\W_]+(?:\.[^\W_]+)+|[^\W_]+(?:-[^\W_]+)+|[^\W_]+"
)


def parts(unit: str) -> list[str]:
    """A unit and what it is made of: a web address with a path is itself, its host and its path; a hyphenated word itself and its parts."""
    if "@" not in unit and "/" in unit:
        host, _, path = unit.partition("/")
        return [unit, host, "/" + path]
    return [unit, *unit.split("-")] if "-" in unit and not re.search("[@.]", unit) else [unit]


def units(text: str | None) -> list[str]:
    """The words and units of a text in lower case, each at the place of its own.

    E-mail addresses and dotted numbers are one unit; others are followed by their ``parts``.
    """
    return [p for u in _UNIT.findall((text or "").lower()) for p in parts(u)]


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def _short_end(word: str) -> bool:
    return bool(_SHORT_END.search(word))


@lru_cache(maxsize=50_000)
def stem(word: str) -> str:
    """The Porter2 stem of a lower-case word; words of other letters than a to z stay as they are."""
    if len(word) < 3 or not (word.isascii() and word.isalpha()) or word in _KEPT:
        return word
    if word in _WHOLE:
        return _WHOLE[word]
    w = re.sub(r"(^|(?<=[aeiouy]))y", "Y", word)
    head = next((p for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    met = _REGION.search(w)
    r1 = len(head) if head else met.end() if met else len(w)
    met = _REGION.search(w, r1)
    r2 = met.end() if met else len(w)

    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and _VOWEL.search(w[:-2]):
        w = w[:-1]
    if w in _KEPT_LATER:
        return w

    end = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end in ("eed", "eedly"):
        if len(w) - len(end) >= r1:
            w = w[: -len(end)] + "ee"
    elif end and _VOWEL.search(w[: -len(end)]):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _DOUBLE.search(w):
            w = w[:-1]
        elif len(w) <= r1 and _short_end(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"

    end = _longest(w, _STEP2)
    if end and len(w) - len(end) >= r1:
        before = w[: -len(end)]
        if end == "li":
            w = before if before[-1] in "cdeghkmnrt" else w
        elif end != "ogi" or before.endswith("l"):
            w = before + _STEP2[end]
    end = _longest(w, _STEP3)
    if end and len(w) - len(end) >= (r2 if end == "ative" else r1):
        w = w[: -len(end)] + _STEP3[end]
    end = _longest(w, _STEP4)
    if end and len(w) - len(end) >= r2 and (end != "ion" or w[-4] in "st"):
        w = w[: -len(end)]
    last = len(w) - 1
    if w.endswith("e") and (last >= r2 or last >= r1 and not _short_end(w[:-1])):
        w = w[:-1]
    elif w.endswith("ll") and last >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def phrase(term: str | None) -> list[tuple[int, str]]:
    """``(offset, stem)`` of a term's words; stop words are left out but keep their places."""
    at = [(i, stem(w)) for i, w in enumerate(units(term)) if w not in STOP]
    return [(i - at[0][0], s) for i, s in at]


def normalised(term: str | None) -> str | None:
    """A term as a phrase query, such as ``'food' <2> 'thought'``; null without words that count."""
    at, out, last = phrase(term), "", 0
    for i, s in at:
        out += (f" <{i - last}> " if i - last > 1 else " <-> ") * bool(out) + f"'{s}'"
        last = i
    return out or None
