"""Queries over the test tables, one group for each problem, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import bpe, canonical, mixing, mojibake, pairs, sampling, termcounts
from tracewell.session import table, written

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.found(table(spark, d, "teacher"), table(spark, d, "bank_labels"))


def p1_unmatched(spark: SparkSession, d: str) -> DataFrame:
    return canonical.report(table(spark, d, "teacher"), table(spark, d, "bank_labels")).where("label_id = 0").select("kind", "value", "n")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return termcounts.found(table(spark, d, "teacher"))


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    return termcounts.counts(table(spark, d, "teacher"))


def p2_counts_in_batches(spark: SparkSession, d: str) -> DataFrame:
    return termcounts.in_batches(table(spark, d, "teacher"), spark).counts()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.found(table(spark, d, "predictions"), table(spark, d, "teacher"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.truncated(table(spark, d, "predictions"))


def p5_by_source(spark: SparkSession, d: str) -> DataFrame:
    return pairs.by_source(table(spark, d, "predictions"))


def p5_by_evidence(spark: SparkSession, d: str) -> DataFrame:
    return pairs.by_evidence(table(spark, d, "predictions"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return sampling.found(table(spark, d, "teacher"), table(spark, d, "sample_targets"))


def p6_sample(spark: SparkSession, d: str) -> DataFrame:
    r = sampling.teacher_records(table(spark, d, "teacher"))
    s = sampling.sample(r, table(spark, d, "sample_targets"), sampling.fifth(r))
    return s.select(F.col("key").alias("teacher_id"), "category", F.col("cell").alias("intent"), "target_id")


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    r = sampling.teacher_records(table(spark, d, "teacher"))
    t = table(spark, d, "sample_targets")
    return sampling.shortfalls(r, t, sampling.fifth(r)).select("target_id", "category", "intent", "need", "available", "missing")


def p6_quotas(spark: SparkSession, d: str) -> DataFrame:
    """What the sample draws for each target, beside what there was to draw from."""
    r = sampling.teacher_records(table(spark, d, "teacher"))
    return sampling.shortfalls(r, table(spark, d, "sample_targets"), sampling.fifth(r)).select("target_id", "need", "available", "quota")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encoded(table(spark, d, "documents"))


def _sized(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return written(bpe.encoded(docs, keep=["source"], counts_only=True).select(F.col("doc_id").alias("key"), "source", "n_tokens"), "sized")


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(_sized(spark, d), table(spark, d, "mix_targets")).withColumnRenamed("key", "doc_id")


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.report(_sized(spark, d), table(spark, d, "mix_targets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.found(table(spark, d, "documents"))


def p9_restored(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.repaired(table(spark, d, "documents"))


TERMS_SQL = """
with t as (select distinct on (teacher_id) teacher_id, route from teacher where teacher_id is not null order by teacher_id, ingested_at desc),
s as (select teacher_id, unnest(route.reasoning_path) as step from t),
v as (
  select teacher_id, 'category' as field, route.category as term from t where route.category is not null
  union all select teacher_id, 'step', step from s where step is not null
  union all select teacher_id, 'term', unnest(regexp_extract_all(lower(regexp_replace(regexp_replace(step, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([a-z])([A-Z])', '\\1 \\2', 'g')), '[a-z0-9]+')) from s where step is not null
),
c as (select field, term, cast(count(*) as bigint) as n_occurrences, cast(count(distinct teacher_id) as bigint) as n_records from v group by 1, 2)
"""


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_unmatched, p2_found, p2_counts, p2_counts_in_batches, p3_found, p5_found, p5_by_source, p5_by_evidence, p6_found, p6_sample, p6_report, p6_quotas, p7_ids, p8_mix, p8_report, p9_found, p9_restored)}


def oracle_sql() -> dict[str, str]:
    counts = TERMS_SQL + "select field, term, n_occurrences, n_records from c"
    marks = "case when n_records < 3 then 'rare' when n_records > 0.25 * (select count(*) from t) then 'common' end"
    targets = """
with t as (select distinct on (teacher_id) teacher_id, route.category as category, route.intent[1] as intent from teacher where teacher_id is not null order by teacher_id, route.category, route.intent[1]),
n as (select count(*) // 5 as n from t),
r as (
  select s.target_id, s.category, s.intent, cast(greatest(s.min_rows, (s.share_bp * (select n from n) + 9999) // 10000) as bigint) as need,
    (select count(*) from t where t.category = s.category and (s.intent is null or t.intent = s.intent)) as available
  from sample_targets s
)
"""
    return {
        "p6_found": targets + "select target_id from r where available < need",
        "p6_report": targets + "select target_id, category, intent, need, available, greatest(need - available, 0) as missing from r",
        "p2_counts": counts,
        "p2_counts_in_batches": counts,
        "p2_found": TERMS_SQL + f"select field, term, {marks} as mark from c where {marks} is not null",
    }
