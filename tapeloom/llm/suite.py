"""Registered queries of the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tapeloom.llm import chat, fim, langid, lm, mixing, neardup, packing, resample, sadedup, simhash, sketchdedup, tokenfile, topk
from tapeloom.llm.common import documents
from tapeloom.session import shared_folder


def op1_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(documents(spark, folder))


def op2_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = sadedup.remove_repeats(documents(spark, folder))
    return kept.selectExpr("doc_id", "n_bytes", "n_removed", "n_spans", "sha2(kept, 256) AS kept_sha256")


def op3_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(documents(spark, folder)).selectExpr(
        "doc_id", "_source AS source", "_lang AS lang", "_topic AS topic", "_tokens AS n_tokens", "round(_probability, 6) AS probability", "_copies AS copies"
    )


def op4_language_identification(spark: SparkSession, folder: str) -> DataFrame:
    return langid.identify(documents(spark, folder))


def op5_deleted_interpolation_scores(spark: SparkSession, folder: str) -> DataFrame:
    return lm.score(documents(spark, folder))


def op6_simhash_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, folder)).select("doc_id", "fingerprint", "component_id")


def op7_sketched_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = sketchdedup.remove_repeats(documents(spark, folder))
    return kept.selectExpr("doc_id", "n_words", "n_removed", "sha2(kept, 256) AS kept_sha256")


def op8_cover_tree_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(spark.read.parquet(f"{folder}/embeddings.parquet"))


def op9_dual_tree_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(spark.read.parquet(f"{folder}/embeddings.parquet"), "vec_id % 20 = 0")


def op10_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{shared_folder(spark, 'tokens')}/t"
    tokenfile.write_tokens(documents(spark, folder), path)
    return tokenfile.digests(spark, path)


def op11_target_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return resample.resample(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


def op12_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    return fim.rearrange(documents(spark, folder), restore=True).selectExpr(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", "sha2(output, 256) AS output_sha256", "sha2(restored, 256) AS restored_sha256"
    )


def op13_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/conversations.parquet")
    hostile = spark.range(2).selectExpr("-1L AS conv_id", "id AS turn", "if(id = 0, 'user', 'assistant') AS role", f"{chat.quoted(chat.HOSTILE)} AS text")
    parts = chat.format_conversations(rows.select("conv_id", "turn", "role", "text").unionByName(hostile))
    return chat.read_back(parts).selectExpr(
        "conv_id", "n_turns", "sha2(turns_text, 256) AS turns_sha256", "loss_chars", "sha2(loss_text, 256) AS loss_sha256", "formatted_chars", "in_order", "complete"
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_suffix_array_dedup,
        op3_mix_sources,
        op4_language_identification,
        op5_deleted_interpolation_scores,
        op6_simhash_near_duplicates,
        op7_sketched_substring_dedup,
        op8_cover_tree_near_duplicates,
        op9_dual_tree_top_k,
        op10_token_files,
        op11_target_resampling,
        op12_fill_in_middle,
        op13_chat_formatting,
    )
}
BYTES_SQL = """
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
starts AS (SELECT doc_id, s, md5(substring(h, 2 * s - 1, 400)) AS k FROM (SELECT doc_id, h, UNNEST(range(1, length(h) // 2 - 198)) AS s FROM docs WHERE length(h) >= 400)),
found AS (SELECT doc_id, s FROM starts QUALIFY count(*) OVER (PARTITION BY k) > 1),
marked AS (SELECT doc_id, s, coalesce(s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) > 200, true)::INTEGER AS fresh FROM found),
runs AS (SELECT doc_id, min(s) AS low, max(s) + 199 AS high FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS g FROM marked) GROUP BY doc_id, g),
pieces AS (SELECT doc_id, coalesce(lag(high) OVER (PARTITION BY doc_id ORDER BY low), 0) + 1 AS a, low - 1 AS b FROM runs UNION ALL SELECT doc_id, max(high) + 1, NULL FROM runs GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(CASE WHEN b IS NULL THEN substring(h, 2 * a - 1) ELSE substring(h, 2 * a - 1, 2 * (b - a + 1)) END, '' ORDER BY a) AS h FROM pieces JOIN docs USING (doc_id) GROUP BY doc_id),
sums AS (SELECT doc_id, sum(high - low + 1) AS gone, count(*) AS spans FROM runs GROUP BY doc_id)
SELECT doc_id, (length(d.h) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k.h, d.h))) AS kept_sha256
FROM docs d LEFT JOIN kept k USING (doc_id) LEFT JOIN sums USING (doc_id)"""

SUBSTRING_SQL = r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS k FROM (SELECT doc_id, w, UNNEST(range(1, len(w) - 18)) AS s FROM docs WHERE len(w) >= 20)),
later AS (SELECT doc_id, s FROM windows QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, s) > 1),
gone AS (SELECT DISTINCT doc_id, UNNEST(range(s, s + 20)) AS pos FROM later),
spread AS (SELECT doc_id, UNNEST(w) AS word, UNNEST(range(1, len(w) + 1)) AS pos FROM docs),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS text FROM spread ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256 FROM docs LEFT JOIN kept k USING (doc_id)"""

VECTORS_SQL = """v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding))"""

NEAR_SQL = f"""
WITH RECURSIVE {VECTORS_SQL},
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS n, vec_id AS m FROM embeddings UNION SELECT r.n, l.b FROM reach r JOIN links l ON r.m = l.a)
SELECT n AS vec_id, coalesce(any_value(c), 0)::BIGINT AS n_links, min(m) AS component_id, n = min(m) AS kept
FROM reach LEFT JOIN (SELECT a, count(*) AS c FROM links GROUP BY a) ON a = n GROUP BY n"""

TOP_SQL = f"""
WITH {VECTORS_SQL}, f AS (SELECT vec_id, list_transform(e, lambda x: floor(64 * x)) AS e FROM v),
scores AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM f q JOIN f c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM scores QUALIFY rank <= 20"""

ORACLES: dict[str, str] = {
    "op2_suffix_array_dedup": BYTES_SQL,
    "op3_mix_sources": mixing.oracle(),
    "op7_sketched_substring_dedup": SUBSTRING_SQL,
    "op8_cover_tree_near_duplicates": NEAR_SQL,
    "op9_dual_tree_top_k": TOP_SQL,
    "op11_target_resampling": resample.RESAMPLE_SQL,
    "op12_fill_in_middle": fim.FIM_SQL,
    "op13_chat_formatting": chat.CHAT_SQL,
}
