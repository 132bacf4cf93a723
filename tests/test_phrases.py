"""Stems, phrases and explanations on known words."""

from corpusloom.functions.english import STOP, normalised, stem
from corpusloom.operators.phrases import explain_terms

STEMS = {
    "consigned": "consign", "generously": "generous", "generations": "generat", "skies": "sky", "dying": "die", "flies": "fli", "ties": "tie", "happy": "happi", "say": "say", "gas": "gas", "running": "run",
    "hoping": "hope", "hopping": "hop", "agreed": "agre", "bed": "bed", "relational": "relat", "nationally": "nation", "communities": "communiti", "sensibility": "sensibl", "formative": "format", "controlling": "control",
    "adjustable": "adjust", "probate": "probat", "cease": "ceas", "news": "news", "slurry": "slurri", "by": "by", "élan": "élan", "x2s": "x2s",
}


def test_stems():
    assert {w: stem(w) for w in STEMS} == STEMS
    assert len(STOP) == 127


def test_normalised():
    assert normalised("food for thought") == "'food' <2> 'thought'"
    assert normalised("The Export Health Certificates") == "'export' <-> 'health' <-> 'certif'"
    assert normalised("of the") is None and normalised("") is None and normalised(None) is None


def test_explain_terms(spark):
    rows = [(2, " Export of Goods "), (3, "export OF goods"), (4, "the"), (5, "Markings"), (6, " "), (7, None), (1, "to be or a b c")]
    said = {r.term: r for r in explain_terms(spark.createDataFrame(rows, "id int, term string")).collect()}
    assert set(said) == {"Export of Goods", "the", "Markings", "to be or a b c"}
    assert said["Export of Goods"].query == "'export' <2> 'good'" and said["Export of Goods"].is_phrase
    assert said["Export of Goods"].plain.endswith("The common word “of” is ignored, and may sit between the other words.")
    assert said["the"].query is None and said["the"].content_words == [] and not said["the"].is_phrase
    assert said["Markings"].plain.startswith("Matches a page that contains “Markings” anywhere")
    assert "The common words “to”, “be”, “or” and “a” are ignored" in said["to be or a b c"].plain
