"""The numbered queries: each operator over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import alignment, collocations, decontamination, embedding_dedup, exact_dedup, jaccard_join, language, line_dedup, packing, pii, quality, toxicity, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii_semi_markov_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return pii.find_pii(docs, pii.fit(docs))


def op2_toxicity_classifier_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op3_url_redirect_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return url_filter.filter_urls(pages, url_filter.page_edges(pages))


def op4_language_by_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language.identify(docs, language.fit(docs))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(_table(spark, sf_dir, "documents")).drop("first", "sum")


def op6_exact_dedup_digest_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents")).drop("n_chars", "row_id")


def op7_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op8_line_dedup_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.size("removed").cast("long").alias("n_removed"), F.array_join("removed", ",").alias("removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op9_quality_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score_documents(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.score_links(_table(spark, sf_dir, "documents"))


def op12_embedding_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link_vectors(_table(spark, sf_dir, "embeddings"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_pii_semi_markov_crf, op2_toxicity_classifier_chain, op3_url_redirect_equivalence, op4_language_by_compression, op5_ngram_jaccard_join, op6_exact_dedup_digest_index, op7_cost_balanced_packing, op8_line_dedup_windows, op9_quality_factorisation_machine, op10_benchmark_decontamination, op11_cross_tokenizer_alignment, op12_embedding_collision_counting, op13_phrase_collocations, pipeline)}

ORACLE_SQL = {
    "op3_url_redirect_equivalence": r"""
WITH split AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM split),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule,
    CASE WHEN host <> '' THEN regexp_replace(host, '^(www|m)\.', '') || regexp_replace(regexp_replace(path, '\.html$', ''), '/+$', '') END AS form
  FROM parts),
judged AS (SELECT *, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS own FROM ruled)
SELECT page_id, host, path, rule, coalesce(own,
  CASE WHEN bool_or(coalesce(own = 'allow', false)) OVER same THEN 'allow' WHEN form IS NOT NULL AND bool_or(coalesce(own = 'block', false)) OVER same THEN 'block' END, 'allow') AS verdict
FROM judged WINDOW same AS (PARTITION BY form)""",
    "op6_exact_dedup_digest_index": r"""
WITH rows AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
  count(*) OVER (PARTITION BY text_sha256) AS group_size,
  row_number() OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) = 1 AS kept, text_sha256 FROM rows""",
    "op8_line_dedup_windows": r"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
windows AS (
  SELECT doc_id, p, l[p + 1] AS a, l[p + 2] AS b, l[p + 3] AS c
  FROM (SELECT doc_id, l, unnest(range(0, len(l) - 2)) AS p FROM docs)),
ranked AS (SELECT doc_id, p, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, p) AS k FROM windows),
gone AS (SELECT DISTINCT doc_id, unnest([p, p + 1, p + 2]) AS pos FROM ranked WHERE k > 1),
lost AS (SELECT doc_id, list_sort(list(pos)) AS removed FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(l) AS n_lines, len(coalesce(removed, [])) AS n_removed, array_to_string(coalesce(removed, []), ',') AS removed,
  sha256(array_to_string([l[i + 1] for i in range(0, len(l)) if NOT list_contains(coalesce(removed, []), i)], chr(10))) AS text_sha256
FROM docs d LEFT JOIN lost USING (doc_id)""",
    "op12_embedding_collision_counting": """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE coalesce(len(embedding), 0) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reached AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reached.a, links.b FROM reached JOIN links ON reached.b = links.a),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a),
firsts AS (SELECT a, min(b) AS c FROM reached GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, c AS component_id, vec_id = c AS kept
FROM embeddings JOIN firsts ON firsts.a = vec_id LEFT JOIN counted ON counted.a = vec_id""",
    "op13_phrase_collocations": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
cut AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM cut),
grams AS (SELECT lang, w[i:i + d - 1] AS g FROM places, (SELECT unnest([1, 2, 3, 4, 5]) AS d) WHERE i + d - 1 <= len(w)),
f AS (SELECT lang, g, count(*) AS c FROM grams GROUP BY lang, g),
totals AS (SELECT lang, sum(c)::HUGEINT AS n FROM f WHERE len(g) = 1 GROUP BY lang),
candidates AS (SELECT lang, g, c AS a FROM f WHERE len(g) > 1 AND c >= 100),
inner_ones AS (
  SELECT DISTINCT lang, g[s:s + d - 1] AS g, a FROM candidates, (SELECT unnest([1, 2, 3, 4]) AS s), (SELECT unnest([2, 3, 4]) AS d)
  WHERE d < len(g) AND s + d - 1 <= len(g)),
left_over AS (SELECT c.* FROM candidates c WHERE NOT EXISTS (SELECT 1 FROM inner_ones i WHERE i.lang = c.lang AND i.g = c.g AND 100 * i.a >= 100 * c.a)),
cuts AS (
  SELECT x.lang, x.g, x.a, k, l.c AS l, r.c AS r, n, (1000::HUGEINT * x.a * n) // (l.c::HUGEINT * r.c) AS score
  FROM left_over x JOIN (SELECT unnest([1, 2, 3, 4]) AS k) ON k < len(x.g) JOIN f l ON l.lang = x.lang AND l.g = x.g[1:k] JOIN f r ON r.lang = x.lang AND r.g = x.g[k + 1:len(x.g)] JOIN totals t ON t.lang = x.lang),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, k) AS o FROM cuts),
ranked AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, n, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank FROM best WHERE o = 1)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000""",
}
