"""Writers (K1-K12). All go through Spark's commit protocol: a folder appears whole or not at all."""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.operators.metrics import markdown


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists", order: str | None = None) -> None:
    """K1, K2, K3, K4: JSON lines; with order each file is sorted by it as text. Mode overwrite replaces, append adds."""
    out = df.repartitionByRange(F.col(order).cast("string")).sortWithinPartitions(F.col(order).cast("string")) if order else df
    out.write.mode(mode).json(path)


def write_text(df: DataFrame, text: str, path: str, mode: str = "append") -> None:
    """K5: raw texts, a blank line after each."""
    df.select(F.concat(F.col(text), F.lit("\n")).alias("value")).write.mode(mode).text(path)


def _files(df: DataFrame, path: str) -> tuple:
    """The file system of a path and a helper that makes paths of it."""
    make = df.sparkSession._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()), make


def write_json_array(df: DataFrame, path: str, order: str) -> None:
    """K3: one file that holds a JSON array in the order of a column, replaced as a whole: written beside it, then renamed.

    A JSON array has no parts, so the rows go through one task, one after the other; nothing is collected.
    """

    def array(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        started = False
        for pdf in batches:
            rows = list(pdf["value"])
            if rows:
                yield pd.DataFrame({"value": [("" if started or i else "[\n") + ("," if started or i else "") + r for i, r in enumerate(rows)]})
                started = True
        if started:
            yield pd.DataFrame({"value": ["]"]})

    beside = path + ".new"
    rows = df.repartitionByRange(1, order).sortWithinPartitions(order).select(F.to_json(F.struct(*df.columns)).alias("value"))
    rows.mapInPandas(array, "value string").write.mode("overwrite").text(beside)
    fs, make = _files(df, path)
    parts = [f.getPath() for f in fs.listStatus(make(beside)) if f.getPath().getName().startswith("part-") and f.getLen() > 0]
    if not parts:  # no rows, no task
        parts = [make(beside + "/empty")]
        out = fs.create(parts[0], True)
        out.write(b"[]\n")
        out.close()
    fs.delete(make(path), False)
    fs.rename(parts[0], make(path))
    fs.delete(make(beside), True)


def write_labels(labels: DataFrame, path: str, file: str = "file") -> None:
    """K6: the labels of each source file in a file of its own, <path>/<source>.labels.jsonl, as the tree of the sources is.

    The rows are written by source at once; then each part is renamed, which moves no data. Rows of a null source are left out.
    """
    own = labels.where(F.col(file).isNotNull())
    beside = path.rstrip("/") + ".new"
    rest = [c for c in labels.columns if c != file]
    own.withColumn("_name", F.base64(F.encode(F.col(file), "UTF-8"))).select("_name", *rest).repartition("_name").write.mode("overwrite").partitionBy("_name").json(beside)
    fs, make = _files(labels, path)
    for folder in fs.listStatus(make(beside)):
        name = folder.getPath().getName()
        if not name.startswith("_name="):
            continue
        source = base64.b64decode(unquote(name[6:])).decode("utf-8")
        for k, part in enumerate(p for p in fs.listStatus(folder.getPath()) if p.getPath().getName().startswith("part-")):
            to = make(f"{path.rstrip('/')}/{source}{'' if k == 0 else f'.{k}'}.labels.jsonl")
            fs.mkdirs(to.getParent())
            fs.delete(to, False)
            fs.rename(part.getPath(), to)
    fs.delete(make(beside), True)


def write_vectors(vectors: DataFrame, path: str, token: str = "token", vec: str = "vec") -> None:
    """Word vectors in the binary form of word2vec, in order of the token. A vocabulary is streamed through the driver, part by part."""
    n = vectors.agg(F.count("*").alias("n"), F.max(F.size(vec)).alias("d")).first()
    fs, make = _files(vectors, path)
    out = fs.create(make(path), True)
    try:
        out.write(f"{n['n']} {n['d'] or 0}\n".encode())
        for r in vectors.select(token, vec).orderBy(token).toLocalIterator(prefetchPartitions=True):
            out.write(r[0].encode() + b" " + struct.pack(f"<{len(r[1])}f", *r[1]) + b"\n")
    finally:
        out.close()


def write_report(df: DataFrame, path: str) -> None:
    """K7, K8: a small result as CSV, JSON and Markdown below a path."""
    small = df.coalesce(1)
    small.write.mode("overwrite").option("header", True).csv(path + "/csv")
    small.write.mode("overwrite").json(path + "/json")
    df.sparkSession.createDataFrame([(markdown(df),)], "value string").coalesce(1).write.mode("overwrite").text(path + "/md")


def pivoted(df: DataFrame, rows: str, columns: str, value: str) -> DataFrame:
    """K8: one row for each value of `rows`, one column for each of `columns` (in order of its text), for a report."""
    return df.groupBy(rows).pivot(columns).agg(F.first(value)).orderBy(rows)


def bank_json(bank: DataFrame) -> DataFrame:
    """K9: (value): the bank as one JSON text, {"taxonomy": {category: {intent: [paths]}}, "summary": {...}}, sorted by category and intent.

    A bank is a small curated table; its size is that of the result.
    """
    member = lambda name, value: F.concat(F.regexp_replace(F.to_json(F.array(name)), r"^\[|\]$", ""), F.lit(":"), value)
    listed = lambda pairs: F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(pairs), lambda x: x["json"]), ","), F.lit("}"))
    paths = F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("path_pos", "reasoning_path"))), lambda x: x["reasoning_path"]))
    i = bank.groupBy("category", "intent").agg(paths.alias("p"), F.count("*").alias("k"))
    c = i.groupBy("category").agg(listed(F.collect_list(F.struct("intent", member(F.col("intent"), F.col("p")).alias("json")))).alias("m"), F.count("*").alias("n"), F.sum("k").alias("k"))
    summary = F.to_json(F.struct(F.count("*").alias("unique_categories"), F.sum("n").alias("unique_intents"), F.sum("k").alias("unique_reasoning_paths")))
    tree = listed(F.collect_list(F.struct("category", member(F.col("category"), F.col("m")).alias("json"))))
    return c.agg(F.concat(F.lit('{"taxonomy":'), tree, F.lit(',"summary":'), summary, F.lit("}")).alias("value"))


def bank_tree(bank: DataFrame) -> DataFrame:
    """(category, intent, n_paths) in printing order."""
    return bank.groupBy("category", "intent").agg(F.count("*").alias("n_paths")).orderBy("category", "intent")


def append_history(summary: DataFrame, path: str, batch: int | None = None) -> None:
    """K10, T-d: a summary row with the time, appended. batch: a row of this number that is there already is replaced."""
    row = summary.select(F.current_timestamp().alias("ts"), F.struct(*summary.columns).alias("summary"))
    if batch is None:
        row.write.mode("append").parquet(path)
    else:
        row.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")


def latest_summary(history: DataFrame) -> DataFrame:
    """The newest summary."""
    return history.agg(F.max_by("summary", "ts").alias("s")).select("s.*")


def json_safe(c: Column, is_set: bool = False) -> Column:
    """Any value as JSON text, sets sorted."""
    return F.to_json(F.sort_array(c) if is_set else c)


def stringified(df: DataFrame) -> DataFrame:
    """All columns as text: null as empty, arrays, maps and structs as JSON, truth values with a capital."""

    def one(name: str, kind: str) -> Column:
        c = F.col(name)
        text = F.to_json(c) if kind.startswith(("array", "struct", "map")) else F.initcap(c.cast("string")) if kind == "boolean" else c.cast("string")
        return F.coalesce(text, F.lit("")).alias(name)

    return df.select(*[one(n, k) for n, k in df.dtypes])
