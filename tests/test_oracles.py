"""Some queries against their SQL on the smallest tables: one of each kind; the driver compares them all."""

import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")

from tracewell.plans import catalogue as C  # noqa: E402

NAMES = [
    "score_predictions", "missed_predictions", "format_validity", "average_gap", "nearest_option", "guided_numbers", "teacher_scores", "teacher_choices", "answers_to_choices",
    "json_array_scan", "json_repair_scan", "training_scan", "vector_binary_scan", "response_shapes", "sorted_sink", "report_pivot", "once_each_stream", "resumed_stream",
    "random_donor", "randglobal_donor", "greedy_dedup", "canonical_names", "dbscan_by_joins", "route_topk_paths", "p4_found", "prompt_table",
]


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, float):
        return str(int(v)) if v == int(v) else repr(round(v, 6))
    return str(v)


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(map(plain, r)) for r in df[cols].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def tables(data):
    con = duckdb.connect()
    for t in os.listdir(data):
        con.execute(f"create view {t.split('.')[0]} as select * from read_parquet('{data}/{t}')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, data, tables, name):
    assert rows(C.queries()[name](spark, data).toPandas()) == rows(tables.execute(C.oracle_sql()[name]).df())


def test_every_sql_has_its_query():
    assert set(C.oracle_sql()) <= set(C.queries()) and len(C.oracle_sql()) > 120
