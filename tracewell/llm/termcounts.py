"""Frequency of every distinct value or term, kept up to date by signed deltas.

Method: only added, changed or deleted records are aggregated. A batch of deliveries is compared with the last version of its records;
each change gives signed values (+1 for the new version, -1 for the one it replaces), which are summed into per-term changes of
occurrences and of records and merged into the counts that persist. Both tables of the state are bucketed, the records by their key and
the counts by their term, so a merge shuffles the batch and its changes only, never the state.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.session import exists, scratch_path

COUNTS = "field string, term string, n_occurrences long, n_records long"


def step_terms(steps: Column) -> Column:
    """All terms of an array of steps, with repeats: cut between a-z and A-Z, lower-case, maximal runs of a-z and 0-9."""
    cut = lambda s: F.regexp_extract_all(F.lower(F.regexp_replace(s, "([a-z])(?=[A-Z])", "$1 ")), F.lit("([a-z0-9]+)"), F.lit(1))
    return F.flatten(F.transform(F.filter(steps, lambda s: s.isNotNull()), cut))


def route_values(route: Column) -> Column:
    """Array of (field, term) of one record, with repeats: whole category, whole steps, terms of the steps; nulls give none."""
    steps = F.filter(F.coalesce(route["reasoning_path"], F.array().cast("array<string>")), lambda s: s.isNotNull())
    tag = lambda field, xs: F.transform(xs, lambda x: F.struct(F.lit(field).alias("field"), x.alias("term")))
    category = F.filter(F.array(route["category"]), lambda s: s.isNotNull())
    return F.concat(tag("category", category), tag("step", steps), tag("term", step_terms(steps)))


def change_log(deliveries: DataFrame, key: str, order: list[str], values: Column) -> DataFrame:
    """(sign, values): +1 for each version of a record, -1 for the version it replaces.

    A delivery with the same values as the one before cancels out; a delivery whose values are null deletes the record.
    Rows with a null key are ignored. Ties in `order` are broken by the values themselves.
    """
    d = deliveries.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], values.alias("_values"))
    w = Window.partitionBy("_key").orderBy(*[f"_o{i}" for i in range(len(order))], F.xxhash64("_values"))
    v = d.withColumn("_before", F.lag("_values").over(w)).where(F.col("_before").isNull() | ~F.col("_before").eqNullSafe(F.col("_values")))
    signed = F.explode(F.array(F.struct(F.lit(1).alias("sign"), F.col("_values").alias("values")), F.struct(F.lit(-1).alias("sign"), F.col("_before").alias("values"))))
    return v.select(signed.alias("x")).select("x.*").where("values is not null")


def deltas(log: DataFrame) -> DataFrame:
    """(field, term, d_occurrences, d_records) of a change log; only changes are read, summed before the shuffle."""
    # within a record: each term once, with how often it occurs
    once = F.transform(
        F.array_distinct("values"),
        lambda x: F.struct(x["field"].alias("field"), x["term"].alias("term"), F.size(F.filter("values", lambda y: y == x)).alias("n")),
    )
    e = log.select("sign", F.explode(once).alias("e"))
    return e.groupBy("e.field", "e.term").agg(F.sum(F.col("sign") * F.col("e.n")).alias("d_occurrences"), F.sum(F.col("sign").cast("long")).alias("d_records"))


def merge(state: DataFrame | None, changes: DataFrame) -> DataFrame:
    """Counts after the changes; terms that no record holds any more go. No state: as an empty one.

    The changes are one row for each term, so the state meets them in a join on its buckets and isn't regrouped. Neither has null terms.
    """
    c = changes.select("field", "term", F.col("d_occurrences").cast("long").alias("n_occurrences"), F.col("d_records").cast("long").alias("n_records"))
    if state is not None:
        s = state.select(F.col("field").alias("f"), F.col("term").alias("t"), F.col("n_occurrences").alias("o"), F.col("n_records").alias("r"))
        add = lambda old, new: (F.coalesce(F.col(old), F.lit(0)) + F.coalesce(F.col(new), F.lit(0))).alias(new)
        c = s.join(c, (F.col("f") == F.col("field")) & (F.col("t") == F.col("term")), "full").select(F.coalesce("f", "field").alias("field"), F.coalesce("t", "term").alias("term"), add("o", "n_occurrences"), add("r", "n_records"))
    return c.where("n_records <> 0 or n_occurrences <> 0")


class TermCounts:
    """Counts that persist below a path, in versions: each batch reads the newest one and writes the next, then moves the pointer.

    A batch that dies half-way leaves the old version; one that comes again changes nothing, since its records are known already.
    buckets: parts of both tables, by default the number of shuffle partitions; fixed once the state exists.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.version, self.buckets = 0, buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.tables: dict[str, str] = {}
        if exists(spark, self.path + "/pointer"):
            newest = spark.read.json(self.path + "/pointer").orderBy(F.desc("version")).first()
            self.version, self.buckets = newest["version"], newest["buckets"]
            for kind, keys in (("records", "key"), ("counts", "field, term")):
                folder = f"{self.path}/{newest[kind]}"
                columns = ", ".join(f"`{c}` {t}" for c, t in spark.read.parquet(folder).dtypes)
                name = f"{kind}_{uuid.uuid4().hex}"
                spark.sql(f"create table {name} ({columns}) using parquet clustered by ({keys}) sorted by ({keys}) into {self.buckets} buckets location '{folder}'")
                self.tables[kind] = name

    def _put(self, df: DataFrame, kind: str, *keys: str) -> tuple[str, str]:
        """Write a bucketed table; returns its name and folder. Rows that lie by bucket already aren't moved."""
        folder, name = f"{kind}-{self.version + 1}-{uuid.uuid4().hex}", f"{kind}_{uuid.uuid4().hex}"
        df.write.bucketBy(self.buckets, *keys).sortBy(*keys).option("path", f"{self.path}/{folder}").saveAsTable(name)
        return name, folder

    def apply(self, batch: DataFrame, key: str, order: list[str], values: Column) -> None:
        """Take in deliveries. Of several versions of a record the last by `order` counts, ties by the values themselves; one older than the
        version known is ignored. Null values delete the record's terms; rows with a null key are ignored."""
        at = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
        last = batch.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), at.alias("at"), values.alias("values")).groupBy("key")
        last = last.agg(F.max_by(F.struct("at", "values"), F.struct("at", F.xxhash64("values"))).alias("b")).select("key", "b.*")
        if "records" in self.tables:
            known = self.spark.table(self.tables["records"]).select(F.col("key").alias("k"), F.col("at").alias("a"), F.col("values").alias("v"))
            both = known.join(last, F.col("k") == F.col("key"), "full")
            newer = F.col("key").isNotNull() & (F.col("k").isNull() | (F.col("at") >= F.col("a")))
            pick = lambda new, old: F.when(newer, F.col(new)).otherwise(F.col(old)).alias(new)
            changed = newer & F.col("k").isNotNull() & ~F.col("values").eqNullSafe(F.col("v"))
            records = both.select(F.coalesce("k", "key").alias("key"), pick("at", "a"), pick("values", "v"), F.when(changed, F.col("v")).alias("before"), F.when(changed | F.col("k").isNull(), True).otherwise(False).alias("changed"))
        else:
            records = last.select("key", "at", "values", F.lit(None).cast(last.schema["values"].dataType).alias("before"), F.lit(True).alias("changed"))
        name, folder = self._put(records, "records", "key")
        signed = F.explode(F.array(F.struct(F.lit(1).alias("sign"), F.col("values").alias("values")), F.struct(F.lit(-1).alias("sign"), F.col("before").alias("values"))))
        log = self.spark.table(name).where("changed").select(signed.alias("x")).select("x.*").where("values is not null")
        changes = deltas(log)
        counts = merge(self.counts() if "counts" in self.tables else None, changes)
        counts_name, counts_folder = self._put(counts, "counts", "field", "term")
        pointer = self.spark.createDataFrame([(self.version + 1, self.buckets, folder, counts_folder)], "version int, buckets int, records string, counts string")
        pointer.coalesce(1).write.mode("append").json(self.path + "/pointer")
        self.version += 1
        self.tables = {"records": name, "counts": counts_name}

    def counts(self) -> DataFrame:
        """(field, term, n_occurrences, n_records)."""
        return self.spark.table(self.tables["counts"]).select("field", "term", "n_occurrences", "n_records") if self.tables else self.spark.createDataFrame([], COUNTS)

    def n_records(self) -> DataFrame:
        """One row, n: the records known, those without values too."""
        return self.spark.table(self.tables["records"]).agg(F.count("*").alias("n")) if self.tables else self.spark.createDataFrame([(0,)], "n long")


def marks(counts: DataFrame, n_records: DataFrame, rare_below: int = 3, common_share: float = 0.25) -> DataFrame:
    """Counts with `mark`: rare, common or null. n_records: one row, one column (all records, those without values too)."""
    n = n_records.toDF("_n")
    mark = F.when(F.col("n_records") < rare_below, "rare").when(F.col("n_records") > common_share * F.col("_n"), "common")
    return counts.crossJoin(F.broadcast(n)).withColumn("mark", mark).drop("_n")


def teacher_log(teacher: DataFrame) -> DataFrame:
    return change_log(teacher, "teacher_id", ["ingested_at"], F.coalesce(route_values(F.col("route")), F.array().cast("array<struct<field:string,term:string>>")))


def counts(teacher: DataFrame) -> DataFrame:
    """Counts of all terms rebuilt from the whole log, to compare with. Deliveries of one record count once."""
    return merge(None, deltas(teacher_log(teacher)))


def teacher_values() -> Column:
    return F.coalesce(route_values(F.col("route")), F.array().cast("array<struct<field:string,term:string>>"))


def in_batches(teacher: DataFrame, spark: SparkSession, cut: str = "median") -> TermCounts:
    """The state after two batches: what arrived up to `cut` (a timestamp, or the median arrival), then what came later."""
    t = teacher.select("teacher_id", "route", "ingested_at").where("teacher_id is not null")
    at = t.agg(F.expr("percentile_approx(cast(ingested_at as timestamp), 0.5)").alias("_at")) if cut == "median" else spark.sql(f"select timestamp '{cut}' as _at")
    t = t.crossJoin(F.broadcast(at)).withColumn("_late", F.coalesce(F.col("ingested_at").cast("timestamp") > F.col("_at"), F.lit(False)))
    state = TermCounts(spark, scratch_path(spark, "termcounts"))
    for late in (False, True):
        state.apply(t.where(F.col("_late") == late), "teacher_id", ["ingested_at"], teacher_values())
    return state


def found(teacher: DataFrame) -> DataFrame:
    """p2_found: (field, term, mark) of the terms too rare or too common, by the counts that persist after the table's deliveries came in
    two batches. An empty table gives no row."""
    state = in_batches(teacher, teacher.sparkSession)
    return marks(state.counts(), state.n_records()).where("mark is not null").select("field", "term", "mark")
