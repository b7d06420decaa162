"""Proportional samples and perturbed routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.bank import gold_rows, ordered_distinct
from tracewell.operators.relations import random_other


def allocation(counts: DataFrame, n: str, target: int, pos: str) -> DataFrame:
    """Counts with alloc, the largest-remainder share of target; equal remainders go to the earlier pos. A total of 0 gives 0."""
    raw = F.col(n) * F.lit(float(target)) / F.sum(n).over(Window.partitionBy())
    c = counts.withColumn("_raw", F.coalesce(raw, F.lit(0.0))).withColumn("_base", F.floor("_raw").cast("long"))
    c = c.withColumn("_rest", F.lit(target) - F.sum("_base").over(Window.partitionBy()))
    rank = F.row_number().over(Window.orderBy(F.desc(F.col("_raw") - F.col("_base")), F.asc(pos)))
    total = F.sum(n).over(Window.partitionBy())
    return c.withColumn("_rank", rank).withColumn("alloc", F.when(total > 0, F.col("_base") + (F.col("_rank") <= F.col("_rest")).cast("long")).otherwise(0)).drop("_raw", "_base", "_rest", "_rank")


def hash_order(seed: int, key: str) -> Column:
    """A random order that every engine can compute."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))


def proportional_sample(df: DataFrame, category: str, key: str, target: int, seed: int = 42) -> DataFrame:
    """Target rows whose categories keep their shares, without replacement, by hash order. A target beyond the rows takes all.

    Rows of a category are cut down by hash slices first, so only the last slice of each category is ranked and a hot category is no
    sort in one task. The categories are few: one row for each is broadcast.
    """
    counts = df.groupBy(category).agg(F.count("*").alias("n"), F.min(key).alias("_first"))
    n_rows = counts.agg(F.sum("n")).first()[0] or 0
    a = allocation(counts, "n", min(target, n_rows), "_first").select(F.col(category).alias("_cat"), "alloc")
    d = df.withColumn("_h", hash_order(seed, key)).withColumn("_slice", F.conv(F.substring("_h", 1, 3), 16, 10).cast("int"))
    s = d.groupBy(category, "_slice").agg(F.count("*").alias("_m"))
    before = F.coalesce(F.sum("_m").over(Window.partitionBy(category).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = s.withColumn("_before", before).join(F.broadcast(a), F.col(category).eqNullSafe(F.col("_cat"))).where("_before < alloc").select(F.col(category).alias("_c2"), F.col("_slice").alias("_s2"), "_m", "_before", "alloc")
    own = d.join(F.broadcast(cut), F.col(category).eqNullSafe(F.col("_c2")) & (F.col("_slice") == F.col("_s2")))
    whole = own.where("_before + _m <= alloc")
    w = Window.partitionBy(category).orderBy("_h", key)
    part = own.where("_before + _m > alloc").withColumn("_r", F.row_number().over(w)).where("_before + _r <= alloc").drop("_r")
    return whole.unionByName(part).select(*df.columns)


def donor_bank(df: DataFrame, pos: str) -> DataFrame:
    """(reasoning_path, meta) of the first occurrence of each path that isn't empty."""
    return ordered_distinct(df.where("size(reasoning_path) > 0").select("reasoning_path", F.struct("category", "intent").alias("meta"), pos), ["reasoning_path"], pos)


def perturbed(df: DataFrame, mode: str, pos: str, key: str, seed: int = 42) -> DataFrame:
    """Df (category, intent, reasoning_path, budget) with the path of an ablation arm.

    empty: no path; random: a donor of another (category, intent), cut to the budget; randglobal: any other path; filtered: gold rows only.
    """
    if mode == "filtered":
        return gold_rows(df)
    if mode == "empty":
        return df.withColumn("reasoning_path", F.array().cast("array<string>"))
    donors = donor_bank(df, pos).withColumnRenamed("reasoning_path", "_path")
    if mode == "random":
        d = random_other(df.withColumn("_own", F.struct("category", "intent")), donors, key=key, own="_own", donor="_path", donor_key="meta", seed=seed)
        n = F.coalesce(F.nullif(F.col("budget"), F.lit(0)), F.nullif(F.size("reasoning_path"), F.lit(0)), F.lit(1))
        return d.withColumn("reasoning_path", F.slice("_path", F.lit(1), F.greatest(n, F.lit(1)))).drop("_own", "_path")
    if mode == "randglobal":
        d = random_other(df.withColumn("_own", F.col("reasoning_path")), donors.withColumn("_k", F.col("_path")), key=key, own="_own", donor="_path", donor_key="_k", seed=seed)
        return d.withColumn("reasoning_path", F.col("_path")).drop("_own", "_path")
    raise ValueError(f"unknown mode {mode!r}")
