"""The queries of the training-data operators, with production parameters, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrella.llm import language_id, quality, segmentation
from terrella.llm.common import remainder
from terrella.llm.exact_dedup import exact_dedup
from terrella.llm.html_text import extract_pages
from terrella.llm.line_dedup import line_dedup
from terrella.llm.media import media_features
from terrella.llm.mixing import COPY, mixed
from terrella.llm.near_dedup import near_duplicates
from terrella.llm.personal_data import personal_data, report


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.train(docs, remainder(docs["doc_id"]) != 2, per_language=1500)
    out = language_id.identify(docs, model)
    return out.select(F.col("id").alias("doc_id"), F.coalesce(remainder(F.col("id")) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted")


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(personal_data(_read(spark, sf_dir, "documents").select("doc_id", "text")))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_pages(_read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", F.col("__text").alias("text"), F.length("__text").cast("long").alias("n_chars"))


#: A score of at least this is predicted to be of quality.
QUALITY_FROM = 0.7


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "labels")
    model = quality.train(docs, labels, remainder(labels["doc_id"]) != 2)
    out = quality.score(docs, model)
    return out.select("doc_id", F.coalesce(remainder(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= QUALITY_FROM).cast("int").alias("predicted"))


def op6_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    out = segmentation.sample(docs, segmentation.vocabulary(spark), k=2)
    return out.withColumnRenamed("id", "doc_id").withColumn("n_pieces", F.size("ids").cast("long"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup(docs, min_docs=10, min_chars=1, keep_text=False)
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.col("__kept").alias("kept_sha256"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_read(spark, sf_dir, "documents"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_read(spark, sf_dir, "documents").select("doc_id", "text"), words=4, percent=80)


#: Weights of sources in the training mix; sources that are not named have 1.
MIX_WEIGHTS = {"src0": 2.0, "src1": 0.5, "src2": 1.5}
MIX_SEED = 17


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixed(_read(spark, sf_dir, "documents"), MIX_WEIGHTS, seed=MIX_SEED)
    return out.select("doc_id", "text", "lang", "source", "n_chars", F.col(COPY).cast("long").alias("copy"))


QUERIES = {
    "op6_segmentation": op6_segmentation,
    "op10_near_dedup": op10_near_dedup,
    "op2_media_columns": op2_media_columns,
    "op3_personal_data": op3_personal_data,
    "op9_source_mixing": op9_source_mixing,
    "op1_language_id": op1_language_id,
    "op4_html_extraction": op4_html_extraction,
    "op5_quality_classifier": op5_quality_classifier,
    "op7_line_dedup": op7_line_dedup,
    "op8_exact_dedup": op8_exact_dedup,
}

# DuckDB's lower() also changes letters beyond A-Z, so translate() names the letters.
_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

_WEIGHT = "CASE source " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in MIX_WEIGHTS.items()) + " ELSE 1.0 END"
_UNIT = "('0x' || substr(md5('{seed}|0|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496"

ORACLE_SQL = {
    "op9_source_mixing": f"""
        WITH c AS (SELECT source, count(*)::DOUBLE AS n, ({_WEIGHT})::DOUBLE AS w FROM documents GROUP BY source),
        r AS (SELECT source, w / (sum(w) OVER ()) * (sum(n) OVER ()) / n AS rate FROM c),
        p AS (SELECT source, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS f FROM r, range(0, 200) t(k)),
        d AS (SELECT row_number() OVER () AS r, *, {_UNIT.format(seed=MIX_SEED)} AS u FROM documents),
        m AS (SELECT d.r, count(*) AS n FROM d JOIN p ON p.source IS NOT DISTINCT FROM d.source AND p.f <= d.u GROUP BY d.r)
        SELECT doc_id, text, lang, source, n_chars, unnest(range(1, n + 1))::BIGINT AS copy FROM d JOIN m USING (r)""",
    "op7_line_dedup": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        l AS (SELECT r, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS k FROM d),
        m AS (SELECT *, translate(trim(line, {_WS}), {_AZ}) AS key FROM l),
        hot AS (SELECT key FROM m WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10),
        j AS (SELECT m.*, hot.key IS NOT NULL AS gone FROM m LEFT JOIN hot ON m.key = hot.key)
        SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '')) AS kept_sha256
        FROM j GROUP BY r, doc_id""",
    "op8_exact_dedup": """
        WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS h, length(coalesce(text, '')) AS n FROM documents),
        w AS (SELECT doc_id, h, first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY h) AS c FROM d)
        SELECT doc_id, keep_id, c::BIGINT AS group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM w""",
}
