"""The queries opN_<name> over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, collocations, decontaminate, forced_bpe, hard_negatives, html_text, jaccard_join, licenses, pii, ppm, quality_knn, quality_rules, token_counts
from .base import documents, fold

#: Rows of an Arrow batch: keeps a batch of very long texts small.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return jaccard_join.jaccard_join(documents(spark, sf_dir))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    counted = token_counts.count_tokens(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"), budget=2048)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("fit_units") < F.col("n_units")).alias("over_limit"), "n_units", "fit_units", "fit_tokens")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(quality_knn.learnable())
    scored = quality_knn.vote(documents(spark, sf_dir), labels)
    return scored.select("doc_id", F.coalesce(~quality_knn.learnable(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    judged = quality_rules.quality_rules(documents(spark, sf_dir))
    return judged.select("doc_id", *quality_rules.BASE, "base_failed", "kept", F.array_join("failed", ",").alias("failed"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return decontaminate.matches(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def is_kind(kind: str) -> Callable:
    return lambda found: found == kind


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(documents(spark, sf_dir).select("doc_id", "text"))
    base = F.filter("pii", lambda s: s["kind"].isin(*pii.BASE_KINDS))
    kinds = F.transform("pii", lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, is_kind(k))).cast("long").alias(f"n_{k}") for k in pii.BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.listed(base).cast("binary"), 256).alias("base_sha256"), pii.listed(F.col("pii")).alias("spans"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.length("text").cast("long"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    small_batches(spark)
    coded = byte_bpe.encode(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    scored = ppm.score_texts(documents(spark, sf_dir), fold("doc_id", 5) != 1)
    return scored.select("doc_id", F.coalesce(fold("doc_id", 5) == 1, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0, id_column="vec_id", vector_column="embedding")


def op12_forced_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    coded = forced_bpe.encode(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))
    listed = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return coded.select("doc_id", "n_tokens", F.sha2(listed.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return collocations.collocations(documents(spark, sf_dir))


def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op6_license_scan that SQL expresses."""
    return op6_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def license_base_sql() -> str:
    tests = [" AND ".join(f"w{n} = '{w}'" for n, w in enumerate(p.split())) for p in licenses.BASE_PHRASES]
    places = " UNION ALL ".join(f"SELECT rid, i - 1 AS place, '{label}' AS label FROM e WHERE {test}" for test, label in zip(tests, licenses.BASE_PHRASES.values(), strict=True))
    leads = ", ".join(f"lead(w, {n}) OVER o AS w{n}" for n in range(1, max(len(p.split()) for p in licenses.BASE_PHRASES)))
    return rf"""WITH w AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
 u AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM w), e AS (SELECT rid, i, w AS w0, {leads} FROM u WINDOW o AS (PARTITION BY rid ORDER BY i)), b AS ({places}),
 g AS (SELECT rid, count(*) AS n, min(place) AS a, max(place) AS z, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM b GROUP BY rid)
SELECT doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_base, a AS first_word, z AS last_word, coalesce(labels, '') AS base_labels FROM w LEFT JOIN g USING (rid)"""


def personal_data_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op7_personal_data that SQL expresses."""
    return op7_personal_data(spark, sf_dir).select("doc_id", *(f"n_{k}" for k in pii.BASE_KINDS), "base_sha256")


def personal_data_base_sql() -> str:
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN reverse({digits})[i]::INT ELSE (2 * reverse({digits})[i]::INT) // 10 + (2 * reverse({digits})[i]::INT) % 10 END)) % 10 = 0"
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
        "ip": (r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "list_bool_and(list_transform(string_split(m, '.'), lambda x: coalesce(TRY_CAST('0' || ltrim(x, '0') AS HUGEINT) <= 255, false)))"),
        "card": (r"[0-9](?:[\x20-]?[0-9])+", f"length({digits}) BETWEEN 14 AND 19 AND {luhn}"),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", f"length({digits}) BETWEEN 10 AND 15"),
    }
    found = " UNION ALL ".join(
        f"SELECT rid, {n} AS n, '{k}' AS kind, m, list_sum(list_transform(bs[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS a FROM (SELECT rid, ms, bs, unnest(ms) AS m, generate_subscripts(ms, 1) AS i FROM (SELECT rid, regexp_extract_all(t, '{p}') AS ms, regexp_split_to_array(t, '{p}') AS bs FROM d)) WHERE {ok}"
        for n, (k, (p, ok)) in enumerate(kinds.items())
    )
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in kinds)
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents), s AS ({found})
SELECT doc_id, {counts}, sha256(coalesce(string_agg(kind || ':' || CAST(CAST(a AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(a + length(m) AS BIGINT) AS VARCHAR), ',' ORDER BY a, n), '')) AS base_sha256 FROM d LEFT JOIN s USING (rid) GROUP BY rid, doc_id"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = [op1_jaccard_join, op2_token_counts, op3_quality_classifier, op4_quality_rules, op5_decontaminate, op6_license_scan, op7_personal_data, op8_main_text, op9_byte_bpe, op10_ppm_score, op11_hard_negatives, op12_forced_bpe, op13_collocations, license_base, personal_data_base]
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    """SQL that DuckDB runs on the same tables; what is left out is tested against brute force."""
    return {"op4_quality_rules": quality_rules.sql(), "op11_hard_negatives": hard_negatives.sql(), "op13_collocations": collocations.sql(), "license_base": license_base_sql(), "personal_data_base": personal_data_base_sql()}
