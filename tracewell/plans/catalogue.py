"""The queries of the engine's own operators over the test tables, and the SQL that checks them.

Every query runs over its whole tables, and so does its SQL. Floats are rounded to six places on both sides, counts are 64-bit, and
arrays are joined to text, so that results compare by value. Queries without SQL rest on embeddings, a reduction of dimensions, recursive
texts or the order of a stream's files; they are tested against brute force on small fixtures.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import answers as A
from tracewell.functions import loose as L
from tracewell.functions import text as T
from tracewell.operators import bank as B
from tracewell.operators import cluster, metrics, nested, providers, relations, routing, sampling
from tracewell.plans import prompts as P
from tracewell.plans import scoring_sql as Z
from tracewell.session import scratch_path, table, widened
from tracewell.sources import records, sinks

Query = Callable[[SparkSession, str], DataFrame]
_Q: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        _Q[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return put


def queries() -> dict[str, Query]:
    from tracewell.plans import roundtrips, rules  # noqa: F401  they put their queries here

    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)


_WS = r"[\s\x0b\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip_sql(x: str) -> str:
    """White space of any kind off both ends, in SQL."""
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def r6(c: Column | str) -> Column:
    return F.round(T.col(c).cast("double"), 6)


def big(*names: str) -> list[Column]:
    return [F.col(n).cast("bigint").alias(n) for n in names]


def once(df: DataFrame, key: str) -> DataFrame:
    """One delivery of each record: deliveries of a key are equal but for their arrival, the last one stands."""
    return relations.latest_per_key(df, key, "ingested_at")


def predictions(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return once(table(spark, d, "predictions").select("pred_id", *cols, "ingested_at"), "pred_id")


def judged(spark: SparkSession, d: str, judge: Callable[[DataFrame], DataFrame], *keep: str) -> DataFrame:
    """Predictions judged row by row before deliveries are told apart, so that only the verdicts are shuffled and no text."""
    return once(judge(table(spark, d, "predictions")).select("pred_id", *keep, "ingested_at"), "pred_id")


def teacher(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return once(table(spark, d, "teacher").select("teacher_id", *cols, "ingested_at"), "teacher_id")


PRED = "with p as (select * from (select *, row_number() over (partition by pred_id order by ingested_at desc) as rn from predictions) where rn = 1) "
TEACH = "with t as (select * from (select *, row_number() over (partition by teacher_id order by ingested_at desc) as rn from teacher) where rn = 1) "
STATS = """
, c as (select {by} x, count(*) as c from v group by all), g as (select {by} sum(c) as n, count(*) as k, sum(case when c >= 2 then c else 0 end) as two, max(c) as top, sum(c * log2(c)) as clog from c group by all)
select {by} cast(n as bigint) as n, cast(k as bigint) as k, round(1 - k / n, 6) as reuse, round(two / n, 6) as share2, round(greatest(log2(n) - clog / n, 0), 6) as entropy,
  round(case when k > 1 then greatest(log2(n) - clog / n, 0) / log2(k) else 0 end, 6) as entropy_norm, round(pow(2, greatest(log2(n) - clog / n, 0)), 4) as perplexity, round(top / n, 6) as top1
from g"""


def stats_row(df: DataFrame, *by: str) -> DataFrame:
    return df.select(*by, *big("n", "k"), *[r6(c).alias(c) for c in ("reuse", "share2", "entropy", "entropy_norm")], F.round("perplexity", 4).alias("perplexity"), r6("top1").alias("top1"))


# --- statistics of paths

EVENT_PATHS = "with v as (select string_agg(event_type, '>' order by ts, event_id) as x from events group by user_id, cast(ts as date))"


def event_paths(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("e"))
    return e.select("user_id", "day", F.transform("e", lambda x: x["event_type"]).alias("path"))


@query(EVENT_PATHS + STATS.format(by=""))
def path_stats_events(spark: SparkSession, d: str) -> DataFrame:
    return stats_row(metrics.path_stats(event_paths(spark, d), "path"))


@query(TEACH + ", v as (select model, array_to_string(route.reasoning_path, '>') as x from t where len(route.reasoning_path) > 0)" + STATS.format(by="model,"))
def path_stats_teacher(spark: SparkSession, d: str) -> DataFrame:
    t = teacher(spark, d, "model", "route").select("model", F.array_join("route.reasoning_path", ">").alias("path"), F.size("route.reasoning_path").alias("n")).where("n > 0")
    c = t.withColumn("path", F.concat(F.lit("="), "path"))
    return stats_row(metrics.path_stats(c, "path", "model"), "model")


@query("with v as (select unnest(reasoning_path) as x from bank)" + STATS.format(by=""))
def path_step_stats(spark: SparkSession, d: str) -> DataFrame:
    return stats_row(metrics.path_stats(table(spark, d, "bank").select(F.explode("reasoning_path").alias("step")), "step"))


@query(EVENT_PATHS + " select x as path, count(*) as n from v group by x order by n desc, x limit 1")
def most_frequent_path(spark: SparkSession, d: str) -> DataFrame:
    return metrics.most_frequent(event_paths(spark, d).select(F.array_join("path", ">").alias("path")), "path").select("path", *big("n"))


# --- vector routing

VECTORS = "with q as (select vec_id, embedding::double[] as v from embeddings where vec_id % 20 = 0), b as (select vec_id as pos, label, embedding::double[] as v from embeddings)"


def vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "embeddings")
    return e.where("vec_id % 20 = 0"), e.withColumnRenamed("vec_id", "pos")


def routed(spark: SparkSession, d: str) -> DataFrame:
    q, b = vectors(spark, d)
    return routing.route_argmax(q, b, q_id="vec_id", q_vec="embedding", i_pos="pos", i_vec="embedding", label=["label"], not_self=True)


@query(VECTORS + " select vec_id, label, round(s, 6) as score from (select q.vec_id, b.label, list_cosine_similarity(q.v, b.v) as s, row_number() over (partition by q.vec_id order by list_cosine_similarity(q.v, b.v) desc, b.pos) as r from q, b where q.vec_id <> b.pos) where r = 1")
def route_argmax(spark: SparkSession, d: str) -> DataFrame:
    return routed(spark, d).select("vec_id", "label", r6("score").alias("score"))


@query(VECTORS + """, a as (select vec_id, label from (select q.vec_id, b.label, row_number() over (partition by q.vec_id order by list_cosine_similarity(q.v, b.v) desc, b.pos) as r from q, b where q.vec_id <> b.pos) where r = 1)
select vec_id, label, cast(r as bigint) as rank, pos, round(s, 6) as score from (select a.vec_id, a.label, b.pos, list_cosine_similarity(q.v, b.v) as s, row_number() over (partition by a.vec_id order by list_cosine_similarity(q.v, b.v) desc, b.pos) as r
from a join q using (vec_id) join b using (label) where a.vec_id <> b.pos) where r <= 3""")  # fmt: skip
def route_topk_paths(spark: SparkSession, d: str) -> DataFrame:
    q, b = vectors(spark, d)
    a = routed(spark, d).select("vec_id", "label").join(q.select("vec_id", "embedding"), "vec_id")
    bank = b.select("label", "pos", F.col("embedding").alias("pv"), F.col("pos").alias("p"))
    return routing.top_k_paths(a, bank, q_id="vec_id", q_vec="embedding", keys=["label"], path="p", pos="pos", p_vec="pv", k=3, not_self=True).select("vec_id", "label", *big("rank"), F.col("p").alias("pos"), r6("score").alias("score"))


@query("with e as (select label, unnest(embedding::double[]) as x, generate_subscripts(embedding, 1) - 1 as i from embeddings) select label, cast(i as bigint) as i, round(avg(x), 6) as x from e group by label, i")
def mean_vector(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    m = routing.mean_vector(e.select("label", F.col("vec_id").alias("token")), e.select(F.col("vec_id").alias("token"), "embedding"), "label", "token", "embedding")
    return m.select("label", F.posexplode("embedding").alias("i", "x")).select("label", *big("i"), r6("x").alias("x"))


@query()
def dbscan_labels(spark: SparkSession, d: str) -> DataFrame:
    """M2, M3: PCA and DBSCAN of the vectors of each label."""
    return cluster.cluster_groups(table(spark, d, "embeddings"), group="label", key="vec_id", vec="embedding", eps=0.4)


DBSCAN = """with recursive e as (select label, vec_id as i, embedding::double[] as v from embeddings), near as (select a.label, a.i, b.i as j from e a join e b on a.label = b.label where list_distance(a.v, b.v) <= {eps}),
core as (select i, label from near group by all having count(*) >= {m}), link as (select near.i, near.j from near where i in (select i from core) and j in (select i from core)),
reach as (select i, i as c from core union select link.j, reach.c from reach join link on link.i = reach.i), comp as (select i, min(c) as c from reach group by i),
numbered as (select comp.i, dense_rank() over (partition by label order by c) - 1 as cluster from comp join core using (i)),
border as (select near.i, min(cluster) as cluster from near join numbered on numbered.i = near.j where near.i not in (select i from core) group by near.i)
select e.label, e.i as vec_id, cast(coalesce(numbered.cluster, border.cluster, -1) as bigint) as cluster from e left join numbered using (i) left join border using (i)"""
DBSCAN_SQL = DBSCAN.format(eps=1.2, m=4)


def dbscan_whole(spark: SparkSession, d: str, **how: int) -> DataFrame:
    c = cluster.cluster_groups(table(spark, d, "embeddings"), group="label", key="vec_id", vec="embedding", eps=1.2, min_samples=4, dims=None, **how)
    return c.select("label", "vec_id", *big("cluster"))


@query(DBSCAN_SQL)
def dbscan_vectors(spark: SparkSession, d: str) -> DataFrame:
    """M3: DBSCAN of the vectors of each label in their own space, groups small enough for one task."""
    return dbscan_whole(spark, d)


@query(DBSCAN_SQL)
def dbscan_by_joins(spark: SparkSession, d: str) -> DataFrame:
    """M3: the same clusters by joins of grid cells, as for groups of any size."""
    return dbscan_whole(spark, d, local=0)


# --- filters and joins between runs (P2, P3, J3-J7, J15, U-a)


@query(TEACH + "select teacher_id, category, intent, len(path)::bigint as n_steps from (select teacher_id, route.category as category, route.intent[1] as intent, route.reasoning_path as path from t where gold_matches_answer) where path is not null")
def gold_filter_strict(spark: SparkSession, d: str) -> DataFrame:
    t = B.gold_rows(teacher(spark, d, "route", "gold_matches_answer")).where("route.reasoning_path is not null")
    return t.select("teacher_id", "route.category", F.get("route.intent", F.lit(0)).alias("intent"), F.size("route.reasoning_path").cast("bigint").alias("n_steps"))


@query("select distinct id, dataset from questions where id not in (select index from predictions where index is not null)")
def resume_anti(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "questions").select("id", "dataset").distinct()
    return relations.not_done(q, table(spark, d, "predictions").select(F.col("index").alias("id")), "id")


@query(PRED + "select q.id, cast(greatest(20 - coalesce(n, 0), 0) as bigint) as need from (select distinct id from questions) q left join (select index as id, count(*) as n from p group by 1) using (id)")
def topup_need(spark: SparkSession, d: str) -> DataFrame:
    done = predictions(spark, d, "index").groupBy(F.col("index").alias("id")).agg(F.count("*").alias("n_done"))
    return relations.top_up(table(spark, d, "questions").select("id").distinct(), done, "id", 20).select("id", *big("need"))


@query(PRED + ", f as (select index as id, min(model_ans) as v from p where model_ans is not null group by 1) select q.id, coalesce(f.v, upper(q.dataset)) as ans from (select distinct id, dataset from questions) q left join f using (id)")
def reuse_or_compute(spark: SparkSession, d: str) -> DataFrame:
    f = predictions(spark, d, "index", "model_ans").where("model_ans is not null").groupBy(F.col("index").alias("id")).agg(F.min("model_ans").alias("ans"))
    return relations.reuse(table(spark, d, "questions").select("id", "dataset").distinct(), f, "id", "ans", F.upper("dataset")).select("id", "ans")


@query(PRED + "select index from p group by index having count(distinct run) = (select count(distinct run) from p)")
def shared_ids_all_runs(spark: SparkSession, d: str) -> DataFrame:
    return metrics.shared_ids(predictions(spark, d, "run", "index"), "run", "index")


SIGNED = f", n as (select {strip_sql('route.category')} as category, {strip_sql('route.intent[1]')} as intent, route.reasoning_path as path, min(teacher_id) as o from t where len(route.reasoning_path) > 0 group by all), f as (select * from n where category <> '' and intent <> '' and not exists (select 1 from bank b where b.category = n.category and b.intent = n.intent and b.reasoning_path = n.path))"
JOINED = "array_to_string(list_transform(path, lambda s: coalesce(s, '~')), '>')"


def signed(spark: SparkSession, d: str) -> DataFrame:
    return B.signatures(teacher(spark, d, "route"), F.col("route")).select("_sig.*", "teacher_id")


@query(TEACH + SIGNED + f" select category, intent, {JOINED} as path from f")
def new_signatures(spark: SparkSession, d: str) -> DataFrame:
    return B.new_signatures(signed(spark, d), table(spark, d, "bank")).select("category", "intent", F.array_join("reasoning_path", ">", "~").alias("path"))


@query(PRED + """, g as (select * from (select distinct dataset from p), (select distinct method from p), (select distinct model from p))
select g.dataset, g.method, g.model, cast(coalesce(n, 0) as bigint) as n from g left join (select dataset, method, model, count(*) as n from p group by all) using (dataset, method, model) where coalesce(n, 0) < 40""")
def grid_completeness(spark: SparkSession, d: str) -> DataFrame:
    p = predictions(spark, d, "dataset", "method", "model")
    keys = ["dataset", "method", "model"]
    return relations.incomplete(relations.grid(*[p.select(k) for k in keys]), p.groupBy(*keys).agg(F.count("*").alias("n")), keys, "n", 40).select(*keys, *big("n"))


# --- scoring


SCORED = PRED + "," + Z.cascade("p")
ROLLUP = "select {by}, cast(grouping({by}) as bigint) as is_total, cast(sum(ok::int) as bigint) as correct, count(*) as total from k group by rollup ({by})"


@query(SCORED + ROLLUP.format(by="source"))
def score_predictions(spark: SparkSession, d: str) -> DataFrame:
    """A1, A5: the whole cascade over all predictions, by source and overall."""
    used = ["pred_id", "source", "gold_ans", "model_response", "model_ans", "options", "ingested_at"]
    s = judged(spark, d, lambda p: A.with_match(widened(p.select(*used))), "source", "_ok")
    return metrics.accuracy_rollup(s, "source").select("source", *big("is_total", "correct", "total"))


@query(PRED + "," + Z.cascade("p", answers=False) + f"select pred_id, {Z.label('g')} as gold, case when ok then {Z.label('g')} else {Z.label('m')} end as pred, ok as correct from k")
def score_responses(spark: SparkSession, d: str) -> DataFrame:
    """A2: labels from the response texts alone."""
    used = ["pred_id", "gold_ans", "model_response", "options", "ingested_at"]
    return judged(spark, d, lambda p: metrics.labelled(A.with_match(widened(p.select(*used))), "pred_id", "ingested_at"), "gold", "pred", "correct").drop("ingested_at")


@query(SCORED + f"select pred_id, {Z.label('g')} as gold, {Z.label('m')} as pred from k where not ok")
def missed_predictions(spark: SparkSession, d: str) -> DataFrame:
    """A1: the predictions that don't match, with both answers as labels."""
    used = ["pred_id", "gold_ans", "model_response", "model_ans", "options", "ingested_at"]
    return judged(spark, d, lambda p: metrics.misses(A.with_match(widened(p.select(*used))), "pred_id", "ingested_at"), "gold", "pred").drop("ingested_at")


def norm_sql(n: str) -> str:
    """A normalised answer of the SQL cascade as text."""
    return f"case {n}.k when 'b' then case when {n}.v = 'true' then 'b:1' else 'b:0' end when 'n' then 'n:' || format('{{:.6f}}', {n}.n) when 's' then 's:' || {n}.v end"


def norm_text(n: Column) -> Column:
    return F.when(n["k"] == "b", F.when(n["b"], "b:1").otherwise("b:0")).when(n["k"] == "n", F.concat(F.lit("n:"), F.format_string("%.6f", n["n"]))).when(n["k"] == "s", F.concat(F.lit("s:"), n["s"]))


@query(PRED + "," + Z.normalised("p", g="gold_ans", m="model_ans") + f" select pred_id, {norm_sql('g')} as gold, {norm_sql('m')} as pred from k")
def normalize_match(spark: SparkSession, d: str) -> DataFrame:
    """F4, F6, F7 on all answers."""
    return predictions(spark, d, "gold_ans", "model_ans").select("pred_id", norm_text(A.normalize(A.raw("gold_ans"))).alias("gold"), norm_text(A.normalize(A.raw("model_ans"))).alias("pred"))


def scored(spark: SparkSession, d: str) -> DataFrame:
    """All predictions, judged by the whole cascade; an answer that can't be found is a miss."""
    used = ["pred_id", "dataset", "method", "run", "index", "gold_ans", "model_response", "model_ans", "options", "ingested_at"]
    return judged(spark, d, lambda p: A.with_match(widened(p.select(*used))), "dataset", "method", "run", "index", "_ok")


@query(SCORED + ROLLUP.format(by="dataset"))
def accuracy_rollup(spark: SparkSession, d: str) -> DataFrame:
    return metrics.accuracy_rollup(scored(spark, d), "dataset").select("dataset", *big("is_total", "correct", "total"))


VALID = PRED + "," + Z.validity("p") + "select method, count(*) as total, count(rj) as parsed"


@query(VALID + " from k group by 1")
def parse_rate(spark: SparkSession, d: str) -> DataFrame:
    return format_validity(spark, d).select("method", *big("total", "parsed"))


@query(VALID + ", count(rj) filter (where gold is not null) as parsed_gold, count(*) filter (where rj is not null and gold is not null and ok) as parsed_correct from k group by 1")
def format_validity(spark: SparkSession, d: str) -> DataFrame:
    used = ["pred_id", "method", "gold_ans", "model_response", "ingested_at"]
    checked = judged(spark, d, lambda p: metrics.with_validity(widened(p.select(*used)), "model_response"), "method", "_parsed", "_gold_there", "_parsed_ok")
    return metrics.format_validity(checked, "method")


@query(PRED + "," + Z.normalised("p", g="gold_ans") + f" select pred_id, {Z.label('g')} as gold from k")
def labels_canonical(spark: SparkSession, d: str) -> DataFrame:
    return predictions(spark, d, "gold_ans").select("pred_id", A.label(A.normalize(A.raw("gold_ans"))).alias("gold"))


RUNS = SCORED + ", v as (select dataset, method, run, avg(ok::int) * 100 as acc from k group by all) "


def runs(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).groupBy("dataset", "method", "run").agg((F.avg(F.col("_ok").cast("double")) * 100).alias("acc"))


@query(RUNS + "select dataset, method, round(avg(acc), 6) as mean, round(coalesce(stddev_samp(acc), 0), 6) as std, count(*) as n_runs from v group by 1, 2")
def mean_std_by_run(spark: SparkSession, d: str) -> DataFrame:
    return metrics.mean_std(runs(spark, d), "acc", "dataset", "method").select("dataset", "method", r6("mean").alias("mean"), r6("std").alias("std"), *big("n_runs"))


T_SQL = "case when df >= 100 then 1.984 " + " ".join(f"when df >= {a} and df < {b} then {metrics.T975[a]} + {metrics.T975[b] - metrics.T975[a]!r} * (df - {a}) / {float(b - a)}" for a, b in zip(sorted(metrics.T975), sorted(metrics.T975)[1:], strict=False)) + " end"
WELCH = f"""w as (select a.arm, a.m, a.n, b.m as bm, a.v / a.n as sa, b.v / b.n as sb, a.n as na, b.n as nb from a, a b where b.arm = 'CoT' and a.arm <> 'CoT' and a.n > 1),
x as (select *, case when sa + sb > 0 then (sa + sb) * (sa + sb) / (sa * sa / (na - 1) + sb * sb / (nb - 1)) else 1.0 end as df from w), y as (select *, ({T_SQL}) * sqrt(sa + sb) as h from x)
select arm as method, round(m, 6) as mean, round(bm, 6) as base_mean, round(m - bm, 6) as gap, round(m - bm - h, 5) as lo, round(m - bm + h, 5) as hi, (m - bm - h > 0 or m - bm + h < 0) as significant from y"""


def gap_row(df: DataFrame) -> DataFrame:
    return df.select("method", r6("mean").alias("mean"), r6("base_mean").alias("base_mean"), r6("gap").alias("gap"), F.round("lo", 5).alias("lo"), F.round("hi", 5).alias("hi"), "significant")


@query(RUNS + ", z as (select method, run, avg(acc) as acc from v group by 1, 2), a as (select method as arm, avg(acc) as m, var_samp(acc) as v, count(*) as n from z group by 1), " + WELCH)
def welch_gap(spark: SparkSession, d: str) -> DataFrame:
    z = runs(spark, d).groupBy("method", "run").agg(F.avg("acc").alias("acc"))
    return gap_row(metrics.welch_gaps(z, "acc", "method", "CoT"))


@query(RUNS + ", z as (select case when method = 'CoT' then method else 'pooled' end as method, acc from (select method, run, avg(acc) as acc from v group by 1, 2) where method in ('CoT', 'SGFT', 'DCoT')), a as (select method as arm, avg(acc) as m, var_samp(acc) as v, count(*) as n from z group by 1), " + WELCH)
def pooled_controls(spark: SparkSession, d: str) -> DataFrame:
    z = runs(spark, d).groupBy("method", "run").agg(F.avg("acc").alias("acc"))
    return gap_row(metrics.pooled(z, "acc", "method", ["SGFT", "DCoT"], "CoT"))


@query(SCORED + ", i as (select index from k group by index having count(distinct run) = (select count(distinct run) from k)) select run, round(avg(ok::int) * 100, 6) as accuracy, count(*) as n from k where index in (select index from i) group by run")
def run_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return metrics.run_accuracy(scored(spark, d), "run", "index").select("run", r6("accuracy").alias("accuracy"), *big("n"))


@query(SCORED + """, s2 as (select index, count(*) as n, sum(ok::int) as c from k group by 1), e as (select n, c, k from s2, (values (1), (3), (5)) t(k) where n >= k),
f as (select k, case when n - c < k then 1.0 when c = 0 then 0.0 else 1 - list_product(list_transform(range(cast(n - c + 1 as bigint), cast(n + 1 as bigint)), lambda i: 1.0 - k / i)) end as p from e) select cast(k as bigint) as k, round(avg(p), 6) as mean, count(*) as n_rows from f group by k""")
def pass_at_k(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d).groupBy("index").agg(F.count("*").alias("n"), F.sum(F.col("_ok").cast("long")).alias("c"))
    return metrics.pass_at_ks(s, [1, 3, 5]).select(*big("k"), r6("mean").alias("mean"), *big("n_rows"))


WORD = f"lower({Z.strip('{x}')})"
TRUTH = f"case when {WORD} in ('yes', 'true', '1') then 'yes' when {WORD} in ('no', 'false', '0') then 'no' else {WORD} end"
LETTER = f"upper({Z.strip('{x}')})[1]"
NUMERAL = f"case when regexp_full_match(replace({Z.strip('{x}')}, ',', ''), '{Z.FLOAT}') and isfinite(try_cast(replace(replace({Z.strip('{x}')}, ',', ''), '_', '') as double)) then try_cast(replace(replace({Z.strip('{x}')}, ',', ''), '_', '') as double)::varchar else lower(replace({Z.strip('{x}')}, ',', '')) end"


def normalised_sql(form: str, dataset: str) -> str:
    put = lambda c: form.replace("{x}", f"coalesce({c}, '')")
    return PRED + f"select source, count(*) as total, cast(sum(({put('model_ans')} = {put('gold_ans')})::int) as bigint) as correct from p where dataset = '{dataset}' group by 1"


def normalised(spark: SparkSession, d: str, dataset: str, task: str) -> DataFrame:
    p = predictions(spark, d, "source", "dataset", "gold_ans", "model_ans").where(F.col("dataset") == dataset)
    return metrics.normalised_accuracy(p, task, "source", "pred_id", []).select("source", *big("total", "correct"))


@query(normalised_sql(TRUTH, "yesno"))
def normalised_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return normalised(spark, d, "yesno", "truth")


@query(normalised_sql(NUMERAL, "wordmath"))
def normalised_accuracy_numbers(spark: SparkSession, d: str) -> DataFrame:
    return normalised(spark, d, "wordmath", "number")


@query(normalised_sql(LETTER, "quantmc"))
def normalised_accuracy_choices(spark: SparkSession, d: str) -> DataFrame:
    return normalised(spark, d, "quantmc", "choice")


@query("select x, round(t, 6) as t from (select x, " + T_SQL.replace("df", "x") + " as t from (select distinct cast(o_orderkey % 1300 as double) / 10 + 1 as x from orders))")
def t_table_bracket(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "orders").select(((F.col("o_orderkey") % 1300).cast("double") / 10 + 1).alias("x")).distinct()
    return x.select("x", r6(metrics.t975(F.col("x"))).alias("t"))


LINED = "regexp_replace(options, '\\s+\\(?([B-E])\\)\\s*', chr(10) || '\\1) ', 'g')"
OPTS = f"o as (select id, answer, regexp_extract_all({LINED}, '(?:^|\\n)\\s*\\(?([A-E])\\s*\\)\\s*([^\\n]+)', 1) as ks, regexp_extract_all({LINED}, '(?:^|\\n)\\s*\\(?([A-E])\\s*\\)\\s*([^\\n]+)', 2) as vs from (select distinct id, answer, options from questions where options is not null))"


def lined(c: str) -> Column:
    """The options of a question on a line each, in the first of the two styles."""
    return F.regexp_replace(F.regexp_replace(c, r"\s+\(?([B-E])\)\s*", "\n$1) "), r"^\(A\)\s*", "A) ")


def options(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "questions").where("options is not null").select("id", "answer", "options").distinct().withColumn("m", A.option_map(lined("options")))


@query(f"with {OPTS} select id, unnest(ks) as letter, trim(unnest(vs)) as value from o")
def option_map(spark: SparkSession, d: str) -> DataFrame:
    return options(spark, d).select("id", F.explode("m").alias("letter", "value"))


OPTION_VALUES = f"with {OPTS}, w as (select row_number() over () as n, id, ks, list_transform(vs, lambda v: {Z.strip('v')}) as vs from o), e as (select n, id, unnest(ks) as k, unnest(vs) as v, generate_subscripts(ks, 1) as i from w), u as (select n, id, k, arg_max(v, i) as v from e group by all),"


@query(OPTION_VALUES + Z.number_columns("v", "u") + ", r as (select n, k, abs(v_n - 10) as dist from u_5 where v_n is not null), g as (select n, min(dist) as dist from r group by n), b as (select n, min(k) as k from r join g using (n, dist) group by n having count(*) = 1) select id, k as letter from w left join b using (n)")
def nearest_option(spark: SparkSession, d: str) -> DataFrame:
    return options(spark, d).select("id", A.nearest_option(F.col("m"), F.lit(10.0)).alias("letter"))


@query(OPTION_VALUES + Z.number_columns("v", "u") + f", x as (select n, k, {Z.normal(Z.raw('v'), Z.strip('v'), 'v_n')} as o from u_5), y as (select n, any_value(o) as want from x where k = 'A' group by n), b as (select n, min(k) as k from x left join y using (n) where {Z.same('o', 'want')} group by n having count(*) = 1) select id, k as letter from w left join b using (n)")
def option_unique_match(spark: SparkSession, d: str) -> DataFrame:
    o = options(spark, d).withColumn("want", F.col("m")["A"])
    return o.select("id", A.option_match(F.col("m"), A.normalize(A.raw("want"))).alias("letter"))


@query(PRED + f"select pred_id, {Z.first_choice('model_response')} as choice from p")
def choice_extract(spark: SparkSession, d: str) -> DataFrame:
    return judged(spark, d, lambda p: p.withColumn("choice", A.first_choice(F.col("model_response"))), "choice").select("pred_id", "choice")


@query("""select doc_id, coalesce(nullif(regexp_extract_all(regexp_extract(text, '\\\\boxed\\{([^}]+)\\}', 1), '-?\\d+(?:\\.\\d+)?')[-1], ''), nullif(regexp_extract_all(regexp_extract(text, '(?i)(?:final answer|the final answer|answer is|answer:)\\s*([^\\n\\r]+)', 1), '-?\\d+(?:\\.\\d+)?')[-1], ''),
case when not regexp_matches(regexp_replace(text, '[\\x{00C0}-\\x{024F}\\x{0400}-\\x{04FF}\\x{4E00}-\\x{9FFF}]', 'x', 'g'), '(?i)\\b(true|false|yes|no)\\b') then regexp_extract_all(text, '-?\\d+(?:\\.\\d+)?')[-1] end) as n from documents where regexp_matches(text, '-?\\d') and text is not null""")
def final_numeric(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(F.col("text").rlike(r"-?\d")).select("doc_id", A.final_number(F.col("text")).alias("n"))


@query("with q as (select distinct id, answer from questions)," + Z.normalised("q", v="answer") + f" select id, answer, {norm_sql('v')} as value from k")
def number_coerce(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "questions").select("id", "answer").distinct()
    return q.select("id", "answer", norm_text(A.normalize(A.raw("answer"))).alias("value"))


LAST_NUMBER = r"replace(nullif(regexp_extract_all({x}, '-?\d+(?:[,\d]*)?(?:\.\d+)?')[-1], ''), ',', '')"
OBJECT = f"case when starts_with({Z.strip('{x}')}, '{{{{') and ends_with({Z.strip('{x}')}, '}}}}') and json_valid({Z.strip('{x}')}) then nullif(json_extract({Z.strip('{x}')}::json, '$.ans'), 'null') end".replace("{{{{", "{{").replace("}}}}", "}}")
MEMBER = "with_json as (select *, " + OBJECT.replace("{x}", "model_response").replace("{{", "{").replace("}}", "}") + " as j from p), with_text as (select *, " + Z.strip("(case when json_type(j) in ('OBJECT', 'ARRAY') then j::varchar else j->>'$' end)") + " as jt from with_json) "


@query(PRED + "," + MEMBER + "select pred_id, coalesce(" + LAST_NUMBER.format(x="case when contains(model_response, '####') then string_split(model_response, '####')[-1] end") + ", case when regexp_full_match(jt, '-?\\d+(?:\\.\\d+)?') then jt end, " + LAST_NUMBER.format(x="model_response") + ") as n from with_text")
def guided_numbers(spark: SparkSession, d: str) -> DataFrame:
    number = lambda p: widened(p.select("pred_id", "model_response", "ingested_at")).withColumn("n", A.guided_number(F.col("model_response")))
    return judged(spark, d, number, "n").select("pred_id", "n")


# --- the bank (A13-A15, A19, W5, J8, J9, P4-P9, U-b)

TAX = TEACH + f""", r as (select teacher_id, coalesce(nullif({strip_sql('route.category')}, ''), 'unknown') as category, route.intent as intents, route.reasoning_path as path from t where gold_matches_answer and route is not null and len(route.intent) > 0 and len(route.reasoning_path) > 0),
e as (select teacher_id, category, unnest(intents) as intent, generate_subscripts(intents, 1) as i, array_to_string(list_transform(path, lambda s: coalesce(s, '~')), '>') as path from r), v as (select teacher_id, category, {strip_sql('intent')} as intent, i, path from e where {strip_sql('intent')} <> '') """


def taxonomy(spark: SparkSession, d: str) -> DataFrame:
    t = B.taxonomy_rows(teacher(spark, d, "route", "gold_matches_answer", "response_payload"), "teacher_id")
    return t.withColumn("path", F.array_join("reasoning_path", ">", "~"))


@query(TAX + "select category, intent, count(*) as n, count(distinct path) as k, arg_min(path, teacher_id * 100 + i) as first_path from v group by 1, 2")
def bank_group_collect(spark: SparkSession, d: str) -> DataFrame:
    return taxonomy(spark, d).groupBy("category", "intent").agg(F.count("*").alias("n"), F.count_distinct("path").alias("k"), F.min_by("path", "_pos").alias("first_path"))


@query("select count(distinct category) as unique_categories, count(distinct intent) as unique_intents, count(distinct reasoning_path) as unique_reasoning_paths from bank")
def summary_global(spark: SparkSession, d: str) -> DataFrame:
    return B.summary_global(table(spark, d, "bank"))


@query("select count(distinct category) as unique_categories, count(distinct (category, intent)) as unique_intents, count(distinct (category, intent, reasoning_path)) as unique_reasoning_paths from bank")
def summary_scoped(spark: SparkSession, d: str) -> DataFrame:
    return B.summary_scoped(table(spark, d, "bank"))


@query(TAX + """, u as (select category, path, arg_min(case when len(string_split_regex(intent, '{ws}')) > 4 then array_to_string(string_split_regex(intent, '{ws}')[1:4], ' ') else intent end, (len(string_split_regex(intent, '{ws}')), length(intent), teacher_id, i)) as canonical from v group by 1, 2) select category, canonical, count(*) as n from u group by 1, 2""".replace("{ws}", _WS + "+"))
def canonical_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The canonical intent of the records of a category that share a path."""
    c = B.canonical_of(taxonomy(spark, d), ["category", "path"], "intent", "_pos")
    return c.groupBy("category", "canonical").agg(F.count("*").alias("n"))


@query("""with t as (select category, intent, path_pos, list_distinct(flatten(list_transform(reasoning_path, lambda s: list_transform(regexp_extract_all(s, '[A-Z]?[a-z]+|[0-9]+'), lambda x: lower(x))))) as w from bank)
select a.category, a.intent, cast(a.path_pos as bigint) as path_pos, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))), 6) as sim from t a join t b on a.category = b.category and a.intent = b.intent and b.path_pos = a.path_pos + 1""")
def jaccard_tokens(spark: SparkSession, d: str) -> DataFrame:
    """U-f, F1, F2: neighbouring paths of a bucket."""
    t = table(spark, d, "bank").select("category", "intent", "path_pos", F.array_distinct(T.path_tokens("reasoning_path")).alias("w"))
    b = t.select("category", "intent", (F.col("path_pos") - 1).alias("path_pos"), F.col("w").alias("w2"))
    return t.join(b, ["category", "intent", "path_pos"]).select("category", "intent", *big("path_pos"), r6(routing.jaccard(F.col("w"), F.col("w2"))).alias("sim"))


@query("select label_id, array_to_string(list_transform(regexp_extract_all(label, '[A-Z]?[a-z]+|[0-9]+'), lambda x: lower(x)), ' ') as tokens from bank_labels")
def tokenize_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "bank_labels").select("label_id", F.array_join(T.label_tokens("label"), " ").alias("tokens"))


GREEDY = """with recursive t as (select category, intent, path_pos, reasoning_path as path, list_distinct(flatten(list_transform(reasoning_path, lambda s: list_transform(regexp_extract_all(s, '[A-Z]?[a-z]+|[0-9]+'), lambda x: lower(x))))) as w,
  row_number() over (partition by category, intent order by path_pos) as i from bank),
f as (
  select category, intent, 0::bigint as i, 0 as path_pos, []::struct(path varchar[], w varchar[])[] as kept, true as keep, 0.0::double as score, null::varchar[] as near from (select distinct category, intent from bank)
  union all
  select category, intent, i, path_pos, case when score < 0.3 then list_append(kept, {'path': path, 'w': w}) else kept end, score < 0.3, score, near from (
    select *, coalesce(list_max(upto), 0.0) as score, case when list_max(upto) > 0 then kept[list_position(upto, list_max(upto))].path end as near from (
      select *, case when hit > 0 then sims[:hit] else sims end as upto from (
        select *, coalesce(list_position(list_transform(sims, lambda v: v >= 0.3), true), 0) as hit from (
          select t.category, t.intent, t.i, t.path_pos, t.path, t.w, f.kept, list_transform(f.kept, lambda k: coalesce(len(list_intersect(t.w, k.w)) / nullif(len(list_distinct(list_concat(t.w, k.w))), 0), 0.0)) as sims
          from f join t on t.category = f.category and t.intent = f.intent and t.i = f.i + 1))))
) """


@query(GREEDY + "select category, intent, cast(path_pos as bigint) as path_pos, keep as kept, round(score, 6) as score, array_to_string(near, '>') as near from f where i > 0")
def greedy_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Paths that are near to one kept before are removed, in order."""
    return routing.greedy_dedup(table(spark, d, "bank"), keys=["category", "intent"], path="reasoning_path", pos="path_pos", threshold=0.3).select(
        "category", "intent", *big("path_pos"), "kept", r6("score").alias("score"), F.array_join("near", ">").alias("near")
    )


@query(GREEDY + ", b as (select category, intent, count(*) filter (where not keep) as r from f where i > 0 group by all) select cast(sum(r) as bigint) as removed_paths, count(*) filter (where r = 0) as unchanged_buckets from b")
def dedup_stats(spark: SparkSession, d: str) -> DataFrame:
    """How many paths go, and how many buckets stay as they are."""
    kept = routing.greedy_dedup(table(spark, d, "bank"), keys=["category", "intent"], path="reasoning_path", pos="path_pos", threshold=0.3)
    return routing.dedup_stats(kept, ["category", "intent"]).select(*big("removed_paths", "unchanged_buckets"))


NAMED = TAX + """, m as (select category, intent, min(teacher_id * 100 + i) as pos from v group by 1, 2), c as (select *, length(intent) % 4 - 1 as cluster, string_split_regex(intent, '{ws}') as w from m),
f as (select *, min(pos) over (partition by category, cluster) as first from c), b as (select category, cluster, arg_min(intent, (len(w), length(intent), pos)) as best from c where cluster >= 0 group by 1, 2),
n as (select f.category, f.intent, f.pos, f.first, f.cluster, coalesce(best, f.intent) as form from f left join b on f.category = b.category and f.cluster = b.cluster),
k as (select *, case when len(string_split_regex(form, '{ws}')) > 4 then array_to_string(string_split_regex(form, '{ws}')[1:4], ' ') else form end as canonical, case when cluster < 0 then pos end as own from n),
h as (select category, canonical, max((first, coalesce(own, -1))) as holder from k group by 1, 2), d as (select k.category, k.intent, k.canonical, (first, coalesce(own, -1)) as place, holder from k join h using (category, canonical))
select category, intent, arg_max(canonical, place) as canonical from d where place = holder group by 1, 2""".replace("{ws}", _WS + "+")


@query(NAMED)
def canonical_names(spark: SparkSession, d: str) -> DataFrame:
    """The canonical names of clusters given by the lengths of the intents; a later cluster holds a name that two come to."""
    m = taxonomy(spark, d).groupBy("category", "intent").agg(F.min("_pos").alias("_pos"))
    return B.canonical_map(m, m.select("category", "_pos", (F.length("intent") % 4 - 1).alias("cluster")), "_pos")


@query()
def bank_build(spark: SparkSession, d: str) -> DataFrame:
    """From gold records to a bank, intents embedded offline by hashing."""
    rows = B.taxonomy_rows(teacher(spark, d, "route", "gold_matches_answer", "response_payload"), "teacher_id")
    return B.build_bank(rows, providers.embedded(rows, "intent")).select("category", "intent", *big("path_pos"), F.array_join("reasoning_path", ">", "~").alias("path"))


@query(TEACH + """select teacher_id, cast(greatest(len(path), 1) as bigint) as budget, case when len(path) <= 2 then 1 else 2 end::bigint as difficulty, array_to_string(list_transform(path, lambda s: coalesce(s, '~')), '>') as path
from (select teacher_id, case when len(route.reasoning_path) > 0 then route.reasoning_path when len(route.reasoning_path_options) > 0 then coalesce(route.reasoning_path_options[1], []) else [] end as path from t where route is not null)""")
def base_routes(spark: SparkSession, d: str) -> DataFrame:
    r = teacher(spark, d, "route").where("route is not null").select("teacher_id", B.base_route(F.col("route")).alias("b"))
    return r.select("teacher_id", *[F.col(f"b.{c}").cast("bigint").alias(c) for c in ("budget", "difficulty")], F.array_join("b.reasoning_path", ">", "~").alias("path"))


@query(TEACH + """select teacher_id, case when len(route.reasoning_path) > 0 and list_contains(route.reasoning_path_options, route.reasoning_path) then 'reasoning_path_bank' else 'llm_generated' end as source from t where route.reasoning_path is not null and len(route.reasoning_path_options) > 0""")
def path_sources(spark: SparkSession, d: str) -> DataFrame:
    """Whether the path of a record is one of its own options."""
    r = teacher(spark, d, "route").where("size(route.reasoning_path_options) > 0 and route.reasoning_path is not null")
    base = F.col("route").withField("reasoning_path", F.lit(None).cast("array<string>"))
    return r.select("teacher_id", B.path_source(F.col("route.reasoning_path"), base).alias("source"))


@query(TEACH + SIGNED + """, l as (select category, intent, max(path_pos) as last from bank group by all)
select category, intent, cast(path_pos as bigint) as path_pos, array_to_string(reasoning_path, '>') as path from bank union all select f.category, f.intent, coalesce(last, -1) + row_number() over (partition by f.category, f.intent order by o), """ + JOINED + """ from f left join l using (category, intent)""")
def merged_bank(spark: SparkSession, d: str) -> DataFrame:
    """U-b, U-c, U-d: the bank with the routes of all records that it lacks."""
    return B.merge_routes(table(spark, d, "bank"), signed(spark, d), "teacher_id").select("category", "intent", *big("path_pos"), F.array_join("reasoning_path", ">", "~").alias("path"))


@query("select category, intent, count(*) as n_paths from bank group by 1, 2")
def bank_tree(spark: SparkSession, d: str) -> DataFrame:
    return sinks.bank_tree(table(spark, d, "bank"))


@query("select category, intent, cast(path_pos as bigint) as path_pos, array_to_string(reasoning_path, '>') as path from bank")
def bank_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The bank to its nested JSON and back."""
    path = scratch_path(spark, "bank")
    sinks.bank_json(table(spark, d, "bank")).coalesce(1).write.text(path)
    return records.read_bank(spark, path).select("category", "intent", *big("path_pos"), F.array_join("reasoning_path", ">").alias("path"))


# --- samples and perturbed routes


@query("select lang, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (), 6) as percent from documents group by 1")
def category_histogram(spark: SparkSession, d: str) -> DataFrame:
    return metrics.histogram(table(spark, d, "documents"), "lang").select("lang", *big("n"), r6("percent").alias("percent"))


ALLOC = "c as (select {k} as k, count(*) as n, min({id}) as first from {t} group by 1), r as (select *, n * {x}.0 / sum(n) over () as raw from c), a as (select k, first, n, cast(floor(raw) as bigint) + (row_number() over (order by raw - floor(raw) desc, first) <= {x} - sum(cast(floor(raw) as bigint)) over ())::int as alloc from r)"


@query("with " + ALLOC.format(k="lang", id="doc_id", t="documents", x=100) + " select k as lang, n, cast(alloc as bigint) as alloc from a")
def proportional_alloc(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    return sampling.allocation(c, "n", 100, "first").select("lang", *big("n", "alloc"))


@query("with " + ALLOC.format(k="source", id="doc_id", t="documents", x=200) + " select doc_id, source from (select doc_id, source, alloc, row_number() over (partition by source order by md5('42|' || doc_id), doc_id) as r from documents join a on documents.source is not distinct from a.k) where r <= alloc")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.proportional_sample(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", 200)


@query("select id, dataset from (select distinct id, dataset from questions) order by id limit 30")
def train_selection(spark: SparkSession, d: str) -> DataFrame:
    return relations.first_by_text_id(table(spark, d, "questions").select("id", "dataset").distinct(), "id", 30)


@query("select doc_id, source from documents where doc_id >= 100 and doc_id < 250")
def slice_offset_limit(spark: SparkSession, d: str) -> DataFrame:
    return records.read_slice(table(spark, d, "documents").select("doc_id", "source").withColumn("_pos", F.col("doc_id")), 100, 150).drop("_pos")


@query("select id, count(*) as n from questions group by 1 having count(*) > 1")
def duplicate_ids(spark: SparkSession, d: str) -> DataFrame:
    return metrics.duplicates(table(spark, d, "questions"), "id").select("id", *big("n"))


@query("select count(*) as n_rows, count(distinct id) as n_ids from questions")
def count_ids(spark: SparkSession, d: str) -> DataFrame:
    return records.count_ids(table(spark, d, "questions").select("id"))


def perturb_input(spark: SparkSession, d: str) -> DataFrame:
    t = teacher(spark, d, "route").where("route is not null")
    return t.select("teacher_id", "route.category", F.get("route.intent", F.lit(0)).alias("intent"), "route.budget", F.filter("route.reasoning_path", lambda s: s.isNotNull()).alias("reasoning_path"))


DONORS = TEACH + """, r as (select teacher_id, route.category as category, route.intent[1] as intent, route.budget as budget, list_filter(route.reasoning_path, lambda s: s is not null) as path from t where route is not null),
b as (select path, arg_min({'category': category, 'intent': intent}, teacher_id) as meta from r where len(path) > 0 group by path),
d as (select path, {key} as k, md5('42|' || to_json({'_d': path})::varchar) as h, md5('42|' || {json}) as kh from b),
s as (select *, ('0x' || kh[1:4])::int % 64 as bk, ('0x' || h[1:4])::int % 64 as sl from d),
n as (select path, k, row_number() over (order by bk, kh, sl, h) - 1 as no from s),
g as (select k, min(no) as first, count(*) as same from n group by k),
a as (select r.*, coalesce(g.same, 0) as same, g.first, (select count(*) from n) as every, ('0x' || md5('42|' || teacher_id)[1:15])::bigint as x from r left join g on g.k is not distinct from {own}),
i as (select *, case when every > same then x % (every - same) else x % nullif(every, 0) end as drawn from a),
o as (select *, drawn + case when every > same and drawn >= first then same else 0 end as no from i) """
META = "'{\"_k\":{' || array_to_string(list_filter([case when meta.category is not null then '\"category\":' || to_json(meta.category)::varchar end, case when meta.intent is not null then '\"intent\":' || to_json(meta.intent)::varchar end], lambda x: x is not null), ',') || '}}'"


def donors_sql(key: str, json: str, own: str) -> str:
    return DONORS.replace("{key}", key).replace("{json}", json).replace("{own}", own)


@query(donors_sql("meta", META, "{'category': r.category, 'intent': r.intent}") + "select teacher_id, array_to_string(n.path[:greatest(coalesce(nullif(budget, 0), nullif(len(o.path), 0), 1), 1)], '>') as path from o left join n using (no)")
def random_donor(spark: SparkSession, d: str) -> DataFrame:
    """The path of a donor of another category or intent, cut to the budget."""
    return sampling.perturbed(perturb_input(spark, d), "random", "teacher_id", "teacher_id").select("teacher_id", F.array_join("reasoning_path", ">").alias("path"))


@query(donors_sql("path", "to_json({'_k': path})::varchar", "r.path") + "select teacher_id, array_to_string(n.path, '>') as path from o left join n using (no)")
def randglobal_donor(spark: SparkSession, d: str) -> DataFrame:
    """The path of any donor but the record's own."""
    return sampling.perturbed(perturb_input(spark, d), "randglobal", "teacher_id", "teacher_id").select("teacher_id", F.array_join("reasoning_path", ">").alias("path"))


# --- text quality, prompts and nested fields


@query("select distinct id, case when answer is null then '' when contains(answer, '####') then trim(split_part(answer, '####', 1)) else '' end as rationale, case when answer is null then '' when contains(answer, '####') then trim(split_part(answer, '####', 2)) else trim(answer) end as answer from questions")
def rationale_split(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "questions").select("id", "answer").distinct()
    return q.select("id", T.answer_of_marked("answer").alias("r")).select("id", "r.rationale", "r.answer")


STEP_SQL = r"case when text is null or not regexp_matches(text, '[^\s\x{00a0}\x{2000}-\x{200a}\x{3000}\x{0085}\x{1680}\x{2028}\x{2029}\x{202f}\x{205f}]') then 0 when len(regexp_extract_all(text, '(?im)^\s*(?:step\s+\d+[\s:\-]*|(?:\d+[\.\):])\s+|[-•*]\s+)')) >= 2 then len(regexp_extract_all(text, '(?im)^\s*(?:step\s+\d+[\s:\-]*|(?:\d+[\.\):])\s+|[-•*]\s+)')) else len(list_filter(string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]'), lambda x: regexp_matches(x, '[^\s\x{00a0}\x{2000}-\x{200a}\x{3000}\x{0085}\x{1680}\x{2028}\x{2029}\x{202f}\x{205f}]'))) end"


@query(f"select doc_id, cast({STEP_SQL} as bigint) as n from documents")
def step_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.step_count("text").cast("bigint").alias("n"))


def _reasons_sql() -> str:
    parts = [f"case when s < 2 then 'too_few_steps' end", "case when s > 6 then 'too_many_steps' end"]
    parts += ["case when regexp_matches(text, '" + p + f"') then '{name}' end" for name, p in T.REJECT_PATTERNS.items()]
    return "array_to_string(list_filter([" + ", ".join(parts) + "], lambda x: x is not null), ',')"


@query(f"with n as (select doc_id, text, {STEP_SQL} as s from documents) select doc_id, case when s = 0 then 'empty' else {_reasons_sql()} end as reasons from n")
def guidance_validate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.array_join(T.reject_reasons("text"), ",").alias("reasons"))


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events where json_extract_string(props, '$.k') is not null")
def json_nested_path(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k")).where("k is not null")


@query("select distinct id, trim(question) || case when options is null or trim(options) = '' or contains(trim(question), trim(options)) then '' else chr(10) || 'Options:' || chr(10) || trim(options) end as text from questions where question is not null")
def append_options(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "questions").where("question is not null").select("id", T.with_options("question", "options").alias("text")).distinct()


TASKS_SQL = "select distinct id, case when contains(lower(dataset), 'mc') or contains(lower(dataset), 'aqua') or contains(lower(dataset), 'arc') or contains(lower(dataset), 'gpqa') or contains(lower(dataset), 'choice') then 'choice' when contains(lower(dataset), 'strategy') or contains(lower(dataset), 'yesno') or contains(lower(dataset), 'bool') then 'text' else 'math' end as task from questions"


@query(TASKS_SQL)
def task_types(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "questions").select("id", P.task_of(F.col("dataset")).alias("task")).distinct()


def prompt_sql() -> str:
    """The prompts of all strategies, put together from the same parts."""
    lit = lambda t: "'" + t.replace("'", "''") + "'"
    with_options = "trim(question) || case when options is null or trim(options) = '' or contains(trim(question), trim(options)) then '' else chr(10) || 'Options:' || chr(10) || trim(options) end"
    parts = []
    for strategy in P.STRATEGIES:
        for task in P.TASKS:
            schema = "<A|B|C|D|E>" if task == "choice" else P.SCHEMAS[task]
            body = f'\n\n{P.PARTS[strategy]}\nReply in JSON: {{"rationale": {{...}}, "ans": {schema}}}\n{P.ANSWER_RULES[task]}'
            parts.append(f"select id, '{strategy}' as strategy, task, 'You are a careful tutor.' as system, 'Question:' || chr(10) || ({with_options}) || {lit(body)} as user from q where task = '{task}'")
    return f"with t as ({TASKS_SQL}), q as (select distinct id, dataset, question, answer, options, task from questions join t using (id)) " + " union all ".join(parts)


@query(prompt_sql())
def prompt_table(spark: SparkSession, d: str) -> DataFrame:
    """Prompts of all strategies for all questions."""
    q = table(spark, d, "questions").select("id", "dataset", "question", "answer", "options").distinct()
    return P.prompts(q, spark)


@query("select distinct '[INST] ' || 'You are a careful tutor.' || chr(10) || chr(10) || trim(question) || ' [/INST] ' || coalesce(answer, '') as chat, id from questions where question is not null")
def chat_messages(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "questions").where("question is not null").select("id", "question", "answer").distinct()
    return q.select("id", T.chat_text(T.chat(F.lit("You are a careful tutor."), T.strip("question"), F.coalesce("answer", F.lit("")))).alias("chat"))


@query("select doc_id, case when regexp_replace(regexp_replace(source, '[^0-9A-Za-z_.-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') <> '' then regexp_replace(regexp_replace(source, '[^0-9A-Za-z_.-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') else 'doc_' || printf('%05d', doc_id) end as name from documents")
def safe_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.safe_id("source", "doc", F.col("doc_id")).alias("name"))


@query("select distinct lower(w) as word, 100 as n from (select unnest(flatten(list_transform(reasoning_path, lambda s: regexp_extract_all(s, '[A-Z]?[a-z]+|[0-9]+')))) as w from bank)")
def word2vec_vocab(spark: SparkSession, d: str) -> DataFrame:
    """The vocabulary and vector sizes of word vectors trained on the tokens of the bank's paths."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    s = table(spark, d, "bank").select(T.path_tokens("reasoning_path").alias("w"))
    m = Word2Vec(vectorSize=100, windowSize=5, minCount=1, seed=42, inputCol="w", outputCol="v").fit(s)
    path = scratch_path(spark, "word2vec")
    m.getVectors().write.parquet(path)
    return spark.read.parquet(path).select("word", F.size(vector_to_array("vector")).alias("n"))


@query("select distinct coalesce(id, '') as id, coalesce(dataset, '') as dataset, coalesce(question, '') as question, coalesce(answer, '') as answer, coalesce(options, '') as options from questions")
def stringify_rows(spark: SparkSession, d: str) -> DataFrame:
    return sinks.stringified(table(spark, d, "questions").select("id", "dataset", "question", "answer", "options")).distinct()


@query()
def plain_rationales(spark: SparkSession, d: str) -> DataFrame:
    """the rationales of all teacher records as plain sentences."""
    return teacher(spark, d, "response_rationale").select("teacher_id", L.plain_text("response_rationale").alias("text"))


@query(RUNS + ", z as (select dataset, method, run, acc from v), a0 as (select dataset, method as arm, avg(acc) as m, var_samp(acc) as v, count(*) as n from z where method in ('CoT', 'SGFT') group by 1, 2), w as (select a.dataset, a.m - b.m as gap, a.v / a.n as sa, b.v / b.n as sb, a.n as na, b.n as nb from a0 a join a0 b on a.dataset = b.dataset and a.arm = 'SGFT' and b.arm = 'CoT' and a.n > 1 and b.n > 1), x as (select *, case when sa + sb > 0 then (sa + sb) * (sa + sb) / (sa * sa / (na - 1) + sb * sb / (nb - 1)) else 1.0 end as df from w), y as (select *, (" + T_SQL + ") * sqrt(sa + sb) as h from x) select round(avg(gap), 6) as gap, round(avg(gap) - sqrt(sum(h * h)) / count(*), 5) as lo, round(avg(gap) + sqrt(sum(h * h)) / count(*), 5) as hi from y")
def average_gap(spark: SparkSession, d: str) -> DataFrame:
    """The gap of one method against the baseline, averaged over the datasets."""
    gaps = metrics.welch_gaps(runs(spark, d).where(F.col("method").isin("CoT", "SGFT")), "acc", "method", "CoT", "dataset")
    return metrics.average_gap(gaps).select(r6("gap").alias("gap"), F.round("lo", 5).alias("lo"), F.round("hi", 5).alias("hi"))


REASONS = f", n as (select *, {STEP_SQL} as s from e), r as (select *, case when s = 0 then 'empty' else {_reasons_sql()} end as r from n) "
RETRY = chr(10) + "Only high-level steps."


@query(f"with q as (select distinct id, question from questions where question is not null), e as (select id, 1 as k, question as text from q union all select id, 2, question || '{RETRY}' from q)" + REASONS + "select a.id, a.r = '' or b.r = '' as valid, a.r <> '' as retried, case when a.r <> '' then b.r else '' end as reasons from r a join r b on a.id = b.id and a.k = 1 and b.k = 2")
def guided_replies(spark: SparkSession, d: str) -> DataFrame:
    """An offline provider asked for every question's guidance, checked, asked once more where it fails."""
    q = table(spark, d, "questions").where("question is not null").select("id", F.lit("Give steps.").alias("system"), F.col("question").alias("user")).distinct()
    return providers.validated(q, lambda: (lambda system, user: user), key="id", reasons=T.reject_reasons, retry_suffix=RETRY).select("id", "valid", "retried", F.array_join("reasons", ",").alias("reasons"))


@query("with e as (select text from documents)" + REASONS + "select count(*) as total, count(*) filter (where r = '') as accepted, count(*) filter (where r <> '') as rejected from r")
def accepted_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many guides are accepted and rejected."""
    n = providers.accepted_rejected(table(spark, d, "documents").select("doc_id", "text"), "text", T.reject_reasons)[2]
    return n.toDF("total", "accepted", "rejected")


# --- nested records (problem 4)

P4_SQL = r"""
with l as (select record_id, payload from (select *, row_number() over (partition by record_id order by (payload is not null) desc, received_at desc) as rn from second_round where record_id is not null) where rn = 1),
j as (select record_id, payload::json as p from l where case when json_valid(payload) then json_type(payload) = 'OBJECT' else false end),
o as (select record_id, p, case when json_type(p->'response_payload') = 'VARCHAR' then try_cast(p->>'response_payload' as json) else p->'response_payload' end as rp, p->'reasoning_path_final' as f from j),
b as (select record_id, p, f, coalesce(nullif(p->'reasoning_path_bank', 'null'), nullif(p->'route', 'null'), nullif(rp->'route', 'null')) as b0 from o),
r as (select record_id, p, case when json_type(b0) = 'VARCHAR' then (b0->>'$')::json else b0 end as b, case when json_type(f) = 'VARCHAR' then (f->>'$')::json else f end as f from b),
x as (select record_id, child, v from (select record_id, unnest(['bank_intent', 'bank_path', 'final_intent', 'final_path']) as child, unnest([b->'intent', b->'reasoning_path', f->'intent', f->'reasoning_path']) as v from r) where v is not null),
y as (select record_id, child, case when json_type(v) = 'VARCHAR' then case when trim(v->>'$') = '' then [] else [v] end when json_type(v) = 'ARRAY' then v::json[] else [] end as vs from x),
e as (select record_id, child, 0 as outer_pos, generate_subscripts(vs, 1) - 1 as pos, unnest(vs)->>'$' as name from y),
q as (select record_id, generate_subscripts(os, 1) - 1 as outer_pos, unnest(os) as ov from (select record_id, (b->'reasoning_path_options')::json[] as os from r where json_type(b->'reasoning_path_options') = 'ARRAY')),
w as (select record_id, 'bank_option' as child, outer_pos, generate_subscripts(vs, 1) - 1 as pos, unnest(vs)->>'$' as name from (select record_id, outer_pos, ov::json[] as vs from q where json_type(ov) = 'ARRAY')),
m as (select record_id, 'rationale' as child, 0 as outer_pos, generate_subscripts(ks, 1) - 1 as pos, unnest(ks) as name from (select record_id, json_keys(p->'rationale') as ks from r where json_type(p->'rationale') = 'OBJECT')),
n as (select record_id, generate_subscripts(vs, 1) - 1 as outer_pos, unnest(vs) as sv from (select record_id, (p->'rationale')::json[] as vs from r where json_type(p->'rationale') = 'ARRAY')),
s as (select record_id, 'check' as child, outer_pos, generate_subscripts(cs, 1) - 1 as pos, unnest(cs)->>'expr' as name from (select record_id, outer_pos, (sv->'checks')::json[] as cs from n where json_type(sv->'checks') = 'ARRAY')),
a as (select record_id, 'sample' as child, 0 as outer_pos, generate_subscripts(vs, 1) - 1 as pos, unnest(vs)->>'pred' as name from (select record_id, (p->'samples')::json[] as vs from r where json_type(p->'samples') = 'ARRAY'))
select record_id, child, cast(outer_pos as integer) as outer_pos, cast(pos as integer) as pos, name from (select * from e union all select * from w union all select * from m union all select record_id, 'rationale', 0, outer_pos, sv->>'step' from n union all select * from s union all select * from a)
"""


@query(P4_SQL)
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.second_round_children(table(spark, d, "second_round"))


P4_CHECKS = P4_SQL[: P4_SQL.index("select record_id, child, cast(outer_pos")] + ", z as (select record_id, outer_pos as step, generate_subscripts(cs, 1) - 1 as pos, unnest(cs) as c from (select record_id, outer_pos, (sv->'checks')::json[] as cs from n where json_type(sv->'checks') = 'ARRAY')) select record_id, cast(step as integer) as step, cast(pos as integer) as pos, c->>'expr' as expr, c->>'ok' as ok from z"


@query(P4_CHECKS)
def p4_checks(spark: SparkSession, d: str) -> DataFrame:
    """The checks of the steps as one table by pivot: (record_id, step, pos, expr, ok)."""
    t = nested.pivot(nested.second_round_triples(table(spark, d, "second_round")), "rationale[].checks[]", {"expr": "expr", "ok": "ok"})
    return t.select(F.col("key").alias("record_id"), F.get("ordinals", F.lit(0)).alias("step"), F.get("ordinals", F.lit(1)).alias("pos"), "expr", "ok")


@query()
def p4_columns(spark: SparkSession, d: str) -> DataFrame:
    """Which tables and columns the records hold."""
    return nested.explore(nested.second_round_triples(table(spark, d, "second_round")))


# --- a stream (T-a to T-d)


def grown(spark: SparkSession, d: str) -> "BankGrowth":  # noqa: F821
    """The teacher's routes as a stream into a bank that grows in steps."""
    from tracewell.streaming.growth import BankGrowth

    path = scratch_path(spark, "growth")
    once(table(spark, d, "teacher").select("teacher_id", "route", "gold_matches_answer", "ingested_at"), "teacher_id").select("route", "gold_matches_answer", F.col("teacher_id").alias("_at")).repartition(4).write.parquet(path + "/in")
    g = BankGrowth(spark, path, threshold=20)
    schema = spark.read.parquet(path + "/in").schema
    g.start(spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(path + "/in"), path + "/checkpoint").awaitTermination()
    return g


@query()
def bank_growth_stream(spark: SparkSession, d: str) -> DataFrame:
    """T-b, T-d: the summaries of the bank as it grows."""
    return spark.read.parquet(grown(spark, d).history).select("summary.*")


@query(TEACH + f"select distinct {strip_sql('route.category')} as category, {strip_sql('route.intent[1]')} as intent, {JOINED.replace('path', 'route.reasoning_path')} as path from t where gold_matches_answer and len(route.reasoning_path) > 0 and {strip_sql('route.category')} <> '' and {strip_sql('route.intent[1]')} <> ''")
def bank_growth_routes(spark: SparkSession, d: str) -> DataFrame:
    """T-b, T-c: all routes of the stream, each once, in the bank or still waiting."""
    g = grown(spark, d)
    both = g.bank.read().select(*B.KEY).unionByName(g.pending.read().select(*B.KEY))
    return both.select("category", "intent", F.array_join("reasoning_path", ">", "~").alias("path"))


__all__ = ["oracle_sql", "queries"]
