"""Joins and set operations between runs, sinks and inputs (J3-J6, J10, J12, J15, U-a, U-d, U-e, P17, W3, W8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def not_done(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """J3, T-a: rows whose key isn't in the sink yet; a null key is never done."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def top_up(df: DataFrame, done: DataFrame, key: str, n: int, count: str = "n_done") -> DataFrame:
    """Df with `need`, how many of n samples are missing; the most that any row of the sink has counts."""
    d = done.groupBy(key).agg(F.max(count).alias("_n"))
    return df.join(d, key, "left").withColumn("need", F.greatest(F.lit(n) - F.coalesce("_n", F.lit(0)), F.lit(0)).cast("int")).drop("_n")


def reuse(df: DataFrame, finished: DataFrame, key: str, value: str, compute: Column) -> DataFrame:
    """Df with value from the finished rows (one for each key), else computed."""
    return df.join(finished.select(key, F.col(value).alias("_v"), F.lit(True).alias("_has")), key, "left").withColumn(value, F.when(F.col("_has"), F.col("_v")).otherwise(compute)).drop("_v", "_has")


def random_other(rows: DataFrame, donors: DataFrame, *, key: str, own: str, donor: str, donor_key: str, seed: int, slots: int = 64) -> DataFrame:
    """For each row one donor whose donor_key differs from the row's `own`, uniformly at random by hash (T18): (key, donor...).

    All donors are numbered so that those of a key stand together. A row draws one number among all donors but its own key's and steps
    over that run, so every other donor is as likely as any and no row meets all donors. Where all donors have the row's own key, it
    draws from them. The numbers come from counts by key and hash slice (`slots` of each), so neither the bank nor a hot key is one sort.
    """
    h = lambda *c: F.md5(F.concat_ws("|", F.lit(str(seed)), *c))
    d = donors.select(F.col(donor).alias("_d"), F.col(donor_key).alias("_k")).withColumn("_h", h(F.to_json(F.struct("_d"))))
    # hashes that every engine can compute
    d = d.withColumn("_kh", h(F.to_json(F.struct("_k")))).withColumn("_b", F.conv(F.substring("_kh", 1, 4), 16, 10).cast("int") % slots).withColumn("_s", F.conv(F.substring("_h", 1, 4), 16, 10).cast("int") % slots)
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    c = d.groupBy("_b", "_kh", "_k", "_s").agg(F.count("*").alias("_m"))
    blocks = c.groupBy("_b").agg(F.sum("_m").alias("_t")).select("_b", F.coalesce(F.sum("_t").over(before(Window.orderBy("_b"))), F.lit(0)).alias("_off"))
    c = c.withColumn("_at", F.coalesce(F.sum("_m").over(before(Window.partitionBy("_b").orderBy("_kh", "_s"))), F.lit(0)))
    c = c.join(F.broadcast(blocks), "_b").select(F.col("_k").alias("_ck"), F.col("_s").alias("_cs"), "_m", (F.col("_at") + F.col("_off")).alias("_at"))
    at = d.join(c, F.col("_k").eqNullSafe(F.col("_ck")) & (F.col("_s") == F.col("_cs")))
    numbered = at.select((F.col("_at") + F.row_number().over(Window.partitionBy("_k", "_s").orderBy("_h")) - 1).alias("_no"), F.col("_d").alias(donor))
    runs = c.groupBy("_ck").agg(F.min("_at").alias("_first"), F.sum("_m").alias("_same"))
    total = c.agg(F.coalesce(F.sum("_m"), F.lit(0)).alias("_all"))
    r = rows.join(runs, F.col(own).eqNullSafe(F.col("_ck")), "left").crossJoin(F.broadcast(total))
    others = F.col("_all") - F.coalesce("_same", F.lit(0))
    drawn = F.pmod(F.conv(F.substring(h(F.col(key).cast("string")), 1, 15), 16, 10).cast("bigint"), F.nullif(F.when(others > 0, others).otherwise(F.col("_all")), F.lit(0)))
    r = r.withColumn("_no", drawn).withColumn("_no", F.col("_no") + F.when((others > 0) & (F.col("_no") >= F.col("_first")), F.col("_same")).otherwise(0))
    return r.join(numbered, "_no", "left").select(*rows.columns, donor)


def grid(*axes: DataFrame) -> DataFrame:
    """All combinations of a few short lists."""
    out = axes[0].distinct()
    for a in axes[1:]:
        out = out.crossJoin(F.broadcast(a.distinct()))
    return out


def incomplete(cells: DataFrame, counted: DataFrame, keys: list[str], n: str, need: int) -> DataFrame:
    """J15, T-f: the cells of a grid with fewer than `need` rows."""
    return cells.join(counted.select(*keys, n), keys, "left").withColumn(n, F.coalesce(n, F.lit(0))).where(F.col(n) < need)


def first_by_text_id(df: DataFrame, key: str, n: int) -> DataFrame:
    """The n rows of lowest id as text; fewer rows than n are an error."""
    out = df.orderBy(F.col(key).cast("string")).limit(n)
    if out.count() < n:
        raise ValueError(f"{n} rows were asked for, fewer are there")
    return out


def enforce_same(recorded: DataFrame, current: DataFrame) -> None:
    """An error that names the first fields in which two one-row signatures differ."""
    a, b = recorded.first(), current.first()
    a, b = (a.asDict() if a else {}), (b.asDict() if b else {})
    if diff := [k for k in sorted({*a, *b}) if a.get(k) != b.get(k)]:
        raise ValueError("signatures differ in " + ", ".join(f"{k}: {a.get(k)!r} and {b.get(k)!r}" for k in diff))


def zipped(a: Column, b: Column) -> Column:
    """Two arrays side by side, up to the end of the shorter."""
    n = F.least(F.size(a), F.size(b))
    return F.arrays_zip(F.slice(a, 1, n).alias("a"), F.slice(b, 1, n).alias("b"))


def latest_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last delivery of each key, all columns; combined before the shuffle."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(key, "_r.*")


def numbered_rows(df: DataFrame, by: list[str], order: list[Column | str]) -> DataFrame:
    """A position from 1 within each group."""
    return df.withColumn("pos", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
