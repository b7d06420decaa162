"""Aggregates over scored predictions and paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions import answers as A

# The 97.5 % points of Student's t by degrees of freedom.
T975 = {
    1: 12.706, 2: 4.303, 3: 3.182, 4: 2.776, 5: 2.571, 6: 2.447, 7: 2.365, 8: 2.306, 9: 2.262, 10: 2.228, 12: 2.179,
    14: 2.145, 16: 2.120, 18: 2.101, 20: 2.086, 25: 2.060, 30: 2.042, 40: 2.021, 60: 2.000, 100: 1.984,
}


def accuracy(scored: DataFrame, *by: str) -> DataFrame:
    """A1: (by..., correct, total, accuracy) of rows with _ok. No rows: one row of 0, 0, null if nothing is grouped."""
    ok = F.coalesce(F.sum(F.col("_ok").cast("long")), F.lit(0))
    return scored.groupBy(*by).agg(ok.alias("correct"), F.count("*").alias("total"), F.try_divide(ok, F.count("*")).alias("accuracy"))


def accuracy_rollup(scored: DataFrame, file: str) -> DataFrame:
    """A5: accuracy by file and overall (file null, is_total true) in one aggregation."""
    ok = F.coalesce(F.sum(F.col("_ok").cast("long")), F.lit(0))
    return scored.rollup(file).agg(F.grouping(file).cast("int").alias("is_total"), ok.alias("correct"), F.count("*").alias("total"))


def misses(scored: DataFrame, *keep: str) -> DataFrame:
    """A1: the rows that don't match, with gold and prediction as labels.

    The verdict goes through a generator: a filter would be pushed below the columns it needs and work them out once more.
    """
    row = F.struct(F.col("_ok").alias("ok"), A.label(F.col("_g")).alias("gold"), A.label(F.col("_p")).alias("pred"))
    return scored.select(*keep, F.explode(F.filter(F.array(row), lambda r: ~r["ok"])).alias("_r")).select(*keep, "_r.gold", "_r.pred")


def labelled(scored: DataFrame, *keep: str) -> DataFrame:
    """A2: (keep..., gold, pred, correct); a matching prediction takes the label of the gold answer."""
    gold, pred = A.label(F.col("_g")), A.label(F.col("_p"))
    return scored.select(*keep, gold.alias("gold"), F.when(F.col("_ok"), gold).otherwise(pred).alias("pred"), F.col("_ok").alias("correct"))


def with_validity(df: DataFrame, response: str) -> DataFrame:
    """A3, A4: df with _parsed (a JSON answer parses), _gold_there and _parsed_ok (it matches)."""
    s = df.withColumn("_gold", A.gold_answer(df)).withColumn("_json", A.text_ans(F.col(response)))
    ok = A.matches(A.normalize(F.col("_gold")), A.normalize(F.col("_json")))
    return s.withColumns({"_parsed": F.col("_json").isNotNull(), "_gold_there": F.col("_gold").isNotNull(), "_parsed_ok": ok})


def format_validity(checked: DataFrame, *by: str) -> DataFrame:
    """A3, A4: (by..., total, parsed, parsed_gold, parsed_correct) of rows from with_validity()."""
    both = F.col("_parsed") & F.col("_gold_there")
    return checked.groupBy(*by).agg(F.count("*").alias("total"), F.count_if("_parsed").alias("parsed"), F.count_if(both).alias("parsed_gold"), F.count_if(both & F.col("_parsed_ok")).alias("parsed_correct"))


def mean_std(values: DataFrame, value: str, *by: str) -> DataFrame:
    """Mean and sample deviation over runs; a single run has deviation 0."""
    return values.groupBy(*by).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), F.count("*").alias("n_runs"))


def t975(df: Column) -> Column:
    """The 97.5 % point for a real number of degrees of freedom, interpolated between the table's keys; null below 1."""
    keys = sorted(T975)
    out = F.when(df >= keys[-1], F.lit(T975[keys[-1]]))
    for lo, hi in zip(keys, keys[1:], strict=False):
        out = out.when((df >= lo) & (df < hi), F.lit(T975[lo]) + F.lit(T975[hi] - T975[lo]) * (df - lo) / F.lit(float(hi - lo)))
    return out


def welch(m_a: Column, v_a: Column, n_a: Column, m_b: Column, v_b: Column, n_b: Column) -> Column:
    """struct(gap, lo, hi, df, significant) of a minus b by Welch's interval at 95 %; df is 1 where both variances are 0."""
    sa, sb = v_a / n_a, v_b / n_b

    def of(x: Column) -> Column:
        se2 = x["sa"] + x["sb"]
        df = F.when(se2 > 0, se2 * se2 / (x["sa"] * x["sa"] / (n_a - 1) + x["sb"] * x["sb"] / (n_b - 1))).otherwise(1.0)
        gap = m_a - m_b
        inner = lambda y: F.struct(gap.alias("gap"), (gap - y["h"]).alias("lo"), (gap + y["h"]).alias("hi"), y["df"].alias("df"), ((gap - y["h"] > 0) | (gap + y["h"] < 0)).alias("significant"))
        return A.let(A.let(df, lambda d: F.struct(d.alias("df"), (t975(d) * F.sqrt(se2)).alias("h"))), inner)

    return A.let(F.struct(sa.alias("sa"), sb.alias("sb")), of)


def welch_gaps(values: DataFrame, value: str, arm: str, baseline: str, *by: str) -> DataFrame:
    """(by..., arm, mean, std, n, base_mean, gap, lo, hi, df, significant) of every other arm against the baseline, within each `by`. An arm needs two values."""
    g = values.groupBy(*by, arm).agg(F.avg(value).alias("m"), F.var_samp(value).alias("v"), F.count(value).alias("n"))
    base = g.where(F.col(arm) == baseline).select(*by, F.col("m").alias("bm"), F.col("v").alias("bv"), F.col("n").alias("bn"))
    arms, base = g.where((F.col(arm) != baseline) & (F.col("n") > 1)), base.where("bn > 1")
    both = arms.join(base, [*by]) if by else arms.crossJoin(F.broadcast(base))
    c = F.col
    return both.select(*by, arm, c("m").alias("mean"), F.sqrt("v").alias("std"), "n", c("bm").alias("base_mean"), welch(c("m"), c("v"), c("n"), c("bm"), c("bv"), c("bn")).alias("w")).select(
        *by, arm, "mean", "std", "n", "base_mean", "w.*"
    )


def pooled(values: DataFrame, value: str, arm: str, controls: list[str], baseline: str) -> DataFrame:
    """The controls as one arm against the baseline."""
    both = values.where(F.col(arm).isin(*controls, baseline)).withColumn(arm, F.when(F.col(arm) == baseline, baseline).otherwise("pooled"))
    return welch_gaps(both, value, arm, baseline)


def average_gap(gaps: DataFrame) -> DataFrame:
    """The mean of several gaps, with half-widths combined as independent."""
    n = F.count("*")
    half = F.sqrt(F.sum(F.pow((F.col("hi") - F.col("lo")) / 2, F.lit(2)))) / n
    return gaps.agg(F.avg("gap").alias("gap"), half.alias("half")).select("gap", (F.col("gap") - F.col("half")).alias("lo"), (F.col("gap") + F.col("half")).alias("hi"))


def shared_ids(runs: DataFrame, run: str, key: str) -> DataFrame:
    """The ids that occur in every run."""
    n = runs.select(F.count_distinct(run).alias("_n"))
    per = runs.groupBy(key).agg(F.count_distinct(run).alias("_r"))
    return per.crossJoin(F.broadcast(n)).where("_r = _n").select(key)


def run_accuracy(scored: DataFrame, run: str, key: str) -> DataFrame:
    """Accuracy in per cent of each run on the ids that all runs share."""
    own = scored.join(shared_ids(scored, run, key), key, "left_semi")
    return own.groupBy(run).agg((F.avg(F.col("_ok").cast("double")) * 100).alias("accuracy"), F.count("*").alias("n"))


def path_stats(paths: DataFrame, path: str, *by: str) -> DataFrame:
    """A10: (by..., n, k, reuse, share2, entropy, entropy_norm, perplexity, top1) of paths (arrays or texts); null and empty ones are left out.

    Two levels: counts of each path, then sums over the counts; neither needs a path list in one place.
    """
    dtype = paths.schema[path].dataType.simpleString()
    real = paths.where(F.size(path) > 0) if dtype.startswith("array") else paths.where(F.length(path) > 0)
    c = real.groupBy(*by, path).agg(F.count("*").alias("_c"))
    g = c.groupBy(*by).agg(
        F.sum("_c").alias("n"), F.count("*").alias("k"), F.sum(F.when(F.col("_c") >= 2, F.col("_c")).otherwise(0)).alias("_two"), F.max("_c").alias("_top"), F.sum(F.col("_c") * F.log2("_c")).alias("_clog")
    )
    g = g.where("n > 0").withColumn("entropy", F.greatest(F.log2("n") - F.col("_clog") / F.col("n"), F.lit(0.0)))
    n, k = F.col("n"), F.col("k")
    return g.select(
        *by, "n", "k", (1 - k / n).alias("reuse"), (F.col("_two") / n).alias("share2"), "entropy", F.when(k > 1, F.col("entropy") / F.log2(k)).otherwise(0.0).alias("entropy_norm"),
        F.pow(F.lit(2.0), "entropy").alias("perplexity"), (F.col("_top") / n).alias("top1"),
    )


def most_frequent(df: DataFrame, value: str, *by: str) -> DataFrame:
    """The most frequent value and its count; ties go to the smaller value."""
    c = df.groupBy(*by, value).agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("_n"), F.col(value)))
    return c.groupBy(*by).agg(best.alias("b")).select(*by, F.col(f"b.{value}").alias(value), (-F.col("b._n")).alias("n"))


def pass_at_k(n: Column, c: Column, k: Column) -> Column:
    """1 - C(n-c, k) / C(n, k) as a product; 1 if fewer than k samples are wrong, null if k > n."""
    product = F.aggregate(F.sequence(n - c + 1, n), F.lit(1.0), lambda acc, i: acc * (1.0 - k / i))
    return F.when(k > n, F.lit(None).cast("double")).when(n - c < k, 1.0).when(c == 0, 0.0).otherwise(1.0 - product)


def pass_at_ks(samples: DataFrame, ks: list[int]) -> DataFrame:
    """(k, mean, n_rows) over rows (n, c) with n >= k."""
    e = samples.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).where("n >= k")
    return e.groupBy("k").agg(F.avg(pass_at_k(F.col("n"), F.col("c"), F.col("k"))).alias("mean"), F.count("*").alias("n_rows"))


def normalised_accuracy(df: DataFrame, task: str, file: str, order: str, meta: list[str]) -> DataFrame:
    """(file, correct, total, accuracy in per cent, meta of the file's first row) with a task's normaliser; a null prediction is empty."""
    norm = A.normalizer(task)
    ok = norm(F.coalesce(F.col("model_ans").cast("string"), F.lit(""))) == norm(F.coalesce(F.col("gold_ans").cast("string"), F.lit("")))
    return df.groupBy(file).agg(
        F.sum(ok.cast("long")).alias("correct"), F.count("*").alias("total"), (F.avg(ok.cast("double")) * 100).alias("accuracy"), *[F.min_by(m, order).alias(m) for m in meta]
    )


def histogram(df: DataFrame, key: str) -> DataFrame:
    """(key, n, percent)."""
    c = df.groupBy(key).agg(F.count("*").alias("n"))
    return c.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()))


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, with their number."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def assert_unique(df: DataFrame, key: str) -> DataFrame:
    """Df, or an error if a key occurs twice."""
    if bad := [r[key] for r in duplicates(df, key).limit(3).collect()]:
        raise ValueError(f"{key} is not unique, e.g. {bad}")
    return df


def markdown(df: DataFrame, max_rows: int = 1000) -> str:
    """K8: a small result as a Markdown table; more than max_rows rows are an error, not cut."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"more than {max_rows} rows are no report")
    cell = lambda x: f"{x:.3f}" if isinstance(x, float) else "" if x is None else str(x)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(cell, r)) + " |" for r in rows])
