"""Issue classes, impact and stars on sentences with known counts, and their SQL on the same rows."""

import duckdb

import __spark_entry__ as entry
from corpusloom.functions import readability

TEXTS = [
    "We must deploy it in order to help us. There are many applicants; it is required! You shouldn't utilise ring-fenced funds. Our _our our_ l'our ourselves <our>.",
    "It is important to note that it should be noted that the implementation and IMPLEMENTATIONS are very robust.",
    " ".join(["word"] * 26) + ". " + " ".join(["word"] * 25) + ".",
    "éour weé we1 we. in  order to",
    "",
    None,
]
WANT = [
    {"words_to_avoid": 2, "phrases_to_avoid": 2, "vague_language": 1, "there_is_are": 1, "impersonal_it_is": 1, "gov_focused": 5, "applicant": 1, "negative_phrasing": 1},
    {"words_to_avoid": 1, "nominalisation": 2, "unnecessary_words": 3, "impersonal_it_is": 1},
    {"long_sentences": 1},
    {"gov_focused": 1},
    {},
    {},
]


def test_issue_counts(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS, 1)), "doc_id long, text string").selectExpr("*", "'en' AS lang", "'web' AS source").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r.asDict() for r in entry.queries()["r_checks"](spark, str(tmp_path)).collect()}
    names = [*readability.ISSUES, "long_sentences"]
    assert [{k: got[i][k] for k in names if got[i][k]} for i in range(1, len(TEXTS) + 1)] == WANT
    assert got[3]["impact"] == 3.0 and got[3]["stars"] == 1 and got[1]["stars"] is None
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    c.execute("CREATE TABLE labels(doc_id BIGINT, quality INT, toxic INT)")
    found = c.execute(entry.oracle_sql()["r_checks"])
    columns = [x[0] for x in found.description]
    assert {r[0]: dict(zip(columns, r)) for r in found.fetchall()} == got
