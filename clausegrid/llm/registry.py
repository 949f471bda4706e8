"""The queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from clausegrid.llm import alignment, ball_search, byte_bpe, divergence, embedding_dedup, language_id, license_scan, line_dedup, packing, quality, simhash, toxicity, warc
from clausegrid.llm.common import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def word_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = license_scan.scan(docs, license_scan.train(docs), keep=["doc_id"])
    best = F.array_max(F.transform("matches", lambda m: m["probability"]))
    return found.select("doc_id", "n_paragraphs", F.size("matches").cast("long").alias("n_matches"), F.array_join("licences", ",").alias("licences"), best.alias("probability"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), word_tokenizer_path())


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.assess(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = warc.build_derivatives(warc.responses(table(spark, sf_dir, "pages")))
    return made.select("page_id", "warc_type", "record_id", "refers_to", "target_uri", "source_payload_digest", "content_type", "block_digest", "content_length", F.sha2("block", 256).alias("block_sha256"))


def byte_tokenizer() -> tuple[str, str]:
    """The file of ranks and the pattern that goes with it."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = byte_bpe.encode(table(spark, sf_dir, "documents"), *byte_tokenizer(), keep=["doc_id"], decoded=True)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, keep=["doc_id"])


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs.where(language_id.learnable("doc_id", "text", "lang")))
    found = language_id.identify(docs, model, keep=["doc_id"])
    return found.select("doc_id", F.coalesce(language_id.remainder("doc_id") == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_search.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def aligned_tokenizers() -> tuple[str, str]:
    """The files of both sides."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), *aligned_tokenizers())


LINE_DEDUP_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (
  SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
shared AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
judged AS (
  SELECT keyed.*, shared.k IS NOT NULL AND keyed.doc_id <> shared.keeper AS dropped FROM keyed LEFT JOIN shared ON keyed.k = shared.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

QUALITY_SQL = r"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, size, i, list_aggregate(w[i : i + size - 1], 'string_agg', ' ') AS gram
  FROM base, unnest([5, 16, 101]) AS s(size), unnest(range(1, len(w) - size + 2)) AS p(i)),
repeated AS (
  SELECT doc_id, size, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, size, gram) > 1),
covered AS (
  SELECT doc_id, size, count(DISTINCT i + k) AS n FROM repeated, unnest(range(0, size)) AS o(k) GROUP BY doc_id, size),
sums AS (
  SELECT doc_id, coalesce(max(n) FILTER (WHERE size = 5), 0) AS n5, coalesce(max(n) FILTER (WHERE size = 16), 0) AS n16,
         coalesce(max(n) FILTER (WHERE size = 101), 0) AS n101 FROM covered GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM base)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
counts AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n5, 0) AS BIGINT) AS n_repeat_words,
         coalesce(n16, 0) AS n16, coalesce(n101, 0) AS n101
  FROM base LEFT JOIN sums USING (doc_id) LEFT JOIN lines USING (doc_id)),
judged AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n16 <= 0.1 * n_words AND n101 = 0 AS kept FROM judged
"""

EMBEDDING_SQL = """
WITH RECURSIVE usable AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
reach(vec_id, root) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT links.b, reach.root FROM reach JOIN links ON links.a = reach.vec_id),
least AS (SELECT vec_id, min(root) AS component_id FROM reach GROUP BY vec_id),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN least USING (vec_id) LEFT JOIN counts USING (vec_id)
"""

DIVERGENCE_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
occurring AS (
  SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (
  SELECT lang, term, count(*) AS total FROM occurring GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
counts AS (
  SELECT lang, source, term, count(*) AS n FROM occurring JOIN kept USING (lang, term) GROUP BY lang, source, term),
sources AS (
  SELECT DISTINCT lang, source FROM docs),
kinds AS (
  SELECT lang, count(*) AS v, sum(total) AS whole FROM kept GROUP BY lang),
sizes AS (
  SELECT sources.lang, sources.source, coalesce(sum(n), 0) AS total FROM sources LEFT JOIN counts USING (lang, source) GROUP BY ALL),
shares AS (
  SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n,
         1 + (1000000000 * (coalesce(c.n, 0) + 5)::HUGEINT) // (s.total + 5 * v)::HUGEINT AS p,
         1 + (1000000000 * (k.total + 5)::HUGEINT) // (whole + 5 * v)::HUGEINT AS q
  FROM sizes s JOIN kinds USING (lang) JOIN kept k ON k.lang = s.lang LEFT JOIN counts c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source),
differences AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (
  SELECT lang, source, 'pair' AS part, item, coalesce(value, 0) AS value FROM pairs LEFT JOIN differences USING (lang, source, item)
  UNION ALL SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
       CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM found QUALIFY part = 'pair' OR rank <= 50
"""

TOPK_SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scores QUALIFY rank <= 5
"""

QUERIES = {
    f.__name__: f
    for f in (op1_line_dedup, op2_license_scan, op3_best_fit_packing, op4_simhash_near_dedup, op5_embedding_near_dedup, op6_quality_rules, op7_warc, op8_byte_bpe, op9_toxicity, op10_language_id,
              op11_source_divergence, op12_exact_topk, op13_token_alignment)
}
ORACLES = {"op1_line_dedup": LINE_DEDUP_SQL, "op5_embedding_near_dedup": EMBEDDING_SQL, "op6_quality_rules": QUALITY_SQL, "op11_source_divergence": DIVERGENCE_SQL, "op12_exact_topk": TOPK_SQL}


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
