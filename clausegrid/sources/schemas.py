"""Explicit schemas of the engine's tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


PROVENANCE = T.StructType(_strings("oscal_catalog_version", "oscal_catalog_title", "version_label"))
CLAUSE = T.StructType([*_strings("id", "control_id", "title", "text", "kind", "part_name", "label", "parent_part_id"), T.StructField("has_prose", T.BooleanType()), T.StructField("used_descendants", T.BooleanType()), T.StructField("provenance", PROVENANCE)])
REWRITE = T.StructType([*_strings("dataset", "query_id"), T.StructField("query_ord", T.IntegerType()), *_strings("original_query"), T.StructField("rewrite_rank", T.IntegerType()), *_strings("rewritten_query", "model_id", "gen_params_json", "timestamp_et")])
GOLD = T.StructType(_strings("id", "question", "control_id", "gold_control_path", "odp_required", "resolution_policy", "gold_source_version"))
SPAN = T.StructType(_strings("source_id", "span_text"))
CONTRACT = T.StructType([*_strings("answer_text"), T.StructField("evidence_spans", T.ArrayType(SPAN)), *_strings("status"), T.StructField("odp_required_list", T.ArrayType(T.StringType())), *_strings("framework_version", "debug")])
CALL = T.StructType([*_strings("schema_version", "response_id", "query_id", "model_id", "content"), T.StructField("prompt_tokens", T.LongType()), T.StructField("completion_tokens", T.LongType()), T.StructField("latency_s", T.DoubleType())])
CONTEXT = T.StructType([*_strings("schema_version", "query_id", "framework_version", "question"), T.StructField("rewrites", T.ArrayType(T.StringType())), *_strings("context_sha256")])
