"""Readers of records in JSON, JSON lines, text and CSV (S1-S16, S20). Every reader keeps the order of the file in _pos.

JSON lines stay line-splittable: a line is parsed in the JVM by try_parse_json / from_json, whatever the file's size. Files that hold one
JSON array or a wrapper around one are a record each and are parsed whole, since their format has no split point.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracewell.functions.text import col, strip

INVISIBLE = "[﻿​-‍⁠\u0000]"


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(value, file, _pos): lines of text files, gz too (S9). _pos orders the lines of a file; it doesn't count them without gaps.

    Spark numbers rows by split, so _pos = offset-ordered id: splits of one file are numbered in order of offset.
    """
    t = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"))
    return t.withColumn("_pos", F.struct("_block", F.monotonically_increasing_id().alias("_row")))


def numbered(df: DataFrame) -> DataFrame:
    """_pos as 0, 1, 2, ... within each file. Two levels: counts by block, then numbers within a block; no file is sorted in one task."""
    blocks = df.groupBy("file", "_pos._block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = Window.partitionBy("file", "_block").orderBy("_row")
    d = df.withColumn("_row", F.col("_pos._row")).withColumn("_block", F.col("_pos._block"))
    d = d.withColumn("_i", F.row_number().over(within) - 1)
    return d.join(blocks, ["file", "_block"]).withColumn("_pos", F.col("_i") + F.col("_before")).drop("_row", "_block", "_i", "_before")


def as_object(text: Column) -> Column:
    """VARIANT of a text that is one JSON object, else null (S1, S2: malformed lines are skipped)."""
    t = strip(text)
    v = F.try_parse_json(t)
    return F.when(t.startswith("{") & t.endswith("}"), v)


def read_jsonl(spark: SparkSession, path: str | list[str], *, trailing_commas: bool = False, fail: bool = False) -> DataFrame:
    """(raw, data VARIANT, file, _pos) of JSON lines; blank lines are skipped, malformed ones too unless fail.

    A byte-order mark in front is taken off. fail: a malformed line is an error when the data is read, naming the line's file, and signs
    without width are taken out of the lines first (S4, S5).
    """
    d = lines(spark, path)
    raw = strip(F.regexp_replace("value", INVISIBLE if fail else "^\ufeff", ""))
    d = d.withColumn("raw", F.regexp_replace(raw, ",+$", "") if trailing_commas else raw).where("raw <> ''")
    d = d.withColumn("data", as_object(F.col("raw")))
    if fail:
        bad = F.raise_error(F.concat(F.lit("malformed JSON line in "), F.col("file"), F.lit(": "), F.substring("raw", 1, 80)))
        return d.withColumn("data", F.when(F.col("data").isNotNull(), F.col("data")).otherwise(F.try_parse_json(bad.cast("string")))).drop("value")
    return d.where("data is not null").drop("value")


def read_records(spark: SparkSession, path: str | list[str], *, wrapper_keys: tuple[str, ...] = ("data", "examples"), repair: bool = False) -> DataFrame:
    """(raw, file, _pos) of files that hold a JSON array, one object, a wrapper around an array, or JSON lines.

    A file whose first line is an object of its own and isn't the only line holds JSON lines and is read by lines; others are a record
    each. Items that aren't objects are dropped. repair: an array that ends early gets its trailing comma taken off and a
    bracket put on. Key order and duplicate keys of objects stay as they are written.
    """
    heads = lines(spark, path).where(strip("value") != "").groupBy("file").agg(F.min_by("value", "_pos").alias("first"), F.count("*").alias("n"))
    first = F.regexp_replace(strip(F.regexp_replace("first", "^\ufeff", "")), ",+$", "")
    kinds = heads.select("file", ((F.col("n") > 1) & as_object(first).isNotNull()).alias("by_line")).collect()
    by_line, whole = [r["file"] for r in kinds if r["by_line"]], [r["file"] for r in kinds if not r["by_line"]]
    parts = []
    if by_line:
        parts.append(numbered(read_jsonl(spark, by_line, trailing_commas=True)).select("raw", "file", F.col("_pos").cast("long").alias("_pos")))
    if whole:
        parts.append(_whole_files(spark, whole, wrapper_keys, repair))
    if not parts:
        return spark.createDataFrame([], "raw string, file string, _pos long")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _whole_files(spark: SparkSession, paths: list[str], wrapper_keys: tuple[str, ...], repair: bool) -> DataFrame:
    whole = spark.read.text(paths, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))

    def objects(text: str) -> list[str] | None:
        def of(x: object) -> list[str] | None:
            if isinstance(x, list):
                return [json.dumps(o, ensure_ascii=False) for o in x if isinstance(o, dict)]
            if isinstance(x, dict):
                inner = next((x[k] for k in wrapper_keys if isinstance(x.get(k), list)), None)
                return of(inner) if inner is not None else [json.dumps(x, ensure_ascii=False)]
            return []

        tries = [text] + ([text.rstrip().rstrip(",") + "]"] if repair and text.lstrip().startswith("[") else [])
        for t in tries:
            try:
                return of(json.loads(t))
            except ValueError:
                pass
        return None

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for text, file in zip(pdf["value"], pdf["file"], strict=True):
                found = objects(text)
                if found is None:
                    found = []
                    for line in text.splitlines():
                        try:
                            x = json.loads(line.strip().rstrip(",").lstrip("\ufeff"))
                        except ValueError:
                            continue
                        if isinstance(x, dict):
                            found.append(json.dumps(x, ensure_ascii=False))
                if found:
                    yield pd.DataFrame({"raw": found, "file": file, "_pos": range(len(found))})

    return whole.mapInPandas(parse, "raw string, file string, _pos long")


def typed(records: DataFrame, schema: StructType | str, raw: str = "raw") -> DataFrame:
    """The fields of JSON records by an explicit schema, with _keys: the members in the order of the text."""
    return records.withColumn("_keys", F.json_object_keys(raw)).withColumn("_r", F.from_json(raw, schema)).select(*[c for c in records.columns if c != raw], "_keys", "_r.*")


def read_slice(records: DataFrame, start: int = 0, n: int | None = None) -> DataFrame:
    """N records from position start on, in the order of _pos; fewer if there are no more."""
    s = records.where(F.col("_pos") >= start)
    return s.where(F.col("_pos") < start + n) if n is not None else s


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """(question, _pos) of JSON lines, stripped, blank ones left out."""
    q = strip(F.try_variant_get("data", "$.question", "string"))
    return read_jsonl(spark, path, fail=True).select(q.alias("question"), "_pos").where("question <> ''")


def training_rows(records: DataFrame) -> DataFrame:
    """response_rationale from rationale and response_ans from ans where they are missing; _rationale_keys keeps the key order. raw must hold objects."""
    v = F.try_parse_json("raw")
    part = lambda k: F.get_json_object("raw", f"$.{k}")
    r = F.coalesce(part("response_rationale"), part("rationale"))
    return records.withColumns({"response_rationale": r, "response_ans": F.coalesce(F.try_variant_get(v, "$.response_ans", "string"), F.try_variant_get(v, "$.ans", "string")), "_rationale_keys": F.json_object_keys(r)})


def guidance_rows(records: DataFrame, label: str) -> DataFrame:
    """(id, question, raw): id of the record or label_000000 by position, question with its options, blank questions left out."""
    v = F.try_parse_json("raw")
    text = lambda *ks: F.coalesce(*[F.nullif(strip(F.try_variant_get(v, f"$.{k}", "string")), F.lit("")) for k in ks])
    i = F.coalesce(text("id", "index", "qid"), F.concat(F.lit(label + "_"), F.lpad(F.col("_pos").cast("string"), 6, "0")))
    q, o = text("question"), text("options", "Options", "option", "Option")
    whole = F.when(o.isNotNull() & ~F.contains(q, o), F.concat(q, F.lit("\n"), o)).otherwise(q)
    return records.select(i.alias("id"), whole.alias("question"), "raw").where("question is not null")


def files(spark: SparkSession, path: str, glob: str = "*.jsonl", recursive: bool = True) -> DataFrame:
    """(path, length, modificationTime) of the files below a folder, without reading them."""
    r = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower())
    return r.load(path).select("path", "length", "modificationTime")


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """(id, _pos) of a file of one id a line; blank lines left out."""
    return lines(spark, path).select(strip("value").alias("id"), "_pos").where("id <> ''")


def count_ids(df: DataFrame, keys: tuple[str, ...] = ("index", "id", "question_id", "questionId")) -> DataFrame:
    """(n_rows, n_ids): an id is the first of the keys that is there, else the row's position counts."""
    have = [F.col(k).cast("string") for k in keys if k in df.columns]
    i = F.coalesce(*have) if have else F.lit(None).cast("string")
    return df.agg(F.count("*").alias("n_rows"), (F.count_distinct(i) + F.count_if(i.isNull())).alias("n_ids"))


BANK_JSON = "map<string,map<string,array<array<string>>>>"


def bank_rows(text: Column | str) -> Column:
    """A bank's JSON (bare, or under "taxonomy") as an array of (category, intent, path_pos, reasoning_path)."""
    t = col(text)
    inner = F.coalesce(F.get_json_object(t, "$.taxonomy"), t)
    m = F.map_entries(F.from_json(inner, BANK_JSON))
    rows = F.transform(
        m, lambda c: F.flatten(F.transform(F.map_entries(c["value"]), lambda i: F.transform(i["value"], lambda p, n: F.struct(c["key"].alias("category"), i["key"].alias("intent"), n.alias("path_pos"), p.alias("reasoning_path")))))
    )
    return F.flatten(rows)


def read_bank(spark: SparkSession, path: str) -> DataFrame:
    """The normalised bank of a JSON file."""
    return spark.read.text(path, wholetext=True).select(F.explode(bank_rows("value")).alias("r")).select("r.*")


def read_vectors(spark: SparkSession, path: str, binary: bool = False) -> DataFrame:
    """(token, vec) of word vectors, in text (a first line with only counts is skipped) or in the binary form of word2vec.

    A binary file has no split point: it is one record, read in a task of its own.
    """
    if binary:

        def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for data in pdf["content"]:
                    head, _, data = data.partition(b"\n")
                    n, width = map(int, head.split())
                    at, rows = 0, []
                    for _ in range(n):
                        end = data.index(b" ", at)
                        rows.append((data[at:end].lstrip(b"\n").decode("utf-8", "replace"), np.frombuffer(data, "<f4", width, end + 1)))
                        at = end + 1 + 4 * width
                        if len(rows) == 4096:
                            yield pd.DataFrame(rows, columns=["token", "vec"])
                            rows = []
                    yield pd.DataFrame(rows, columns=["token", "vec"])

        return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, "token string, vec array<float>")
    p = F.split(strip("value"), r"\s+")
    v = spark.read.text(path).select(p.alias("p")).where(F.size("p") > 2)
    return v.select(F.get("p", F.lit(0)).alias("token"), F.transform(F.slice("p", 2, F.size("p") - 1), lambda x: x.cast("float")).alias("vec"))


def finished(spark: SparkSession, path: str, key: str, samples: str | None = None) -> DataFrame:
    """(key, n) of the records in a sink of JSON lines that can be resumed: how often each id was written, or the size of its member `samples`
    (an array; the largest counts). A last line cut off by a crash is skipped, a record without the key too."""
    d = read_jsonl(spark, path).select(F.try_variant_get("data", f"$.{key}", "string").alias(key), F.size(F.try_variant_get("data", f"$.{samples}", "array<variant>")).alias("_n") if samples else F.lit(1).alias("_n"))
    return d.where(F.col(key).isNotNull()).groupBy(key).agg((F.max("_n") if samples else F.count("*")).cast("long").alias("n"))


def response_text(v: Column) -> Column:
    """The text of a model service's reply of any of the usual shapes, given as VARIANT: output_text, choices, output or content."""
    get = lambda p: F.try_variant_get(v, p, "string")
    parts = lambda p: F.nullif(F.array_join(F.transform(F.try_variant_get(v, p, "array<variant>"), lambda x: F.coalesce(F.try_variant_get(x, "$.text", "string"), F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")))), ""), F.lit(""))
    nested = F.nullif(
        F.array_join(F.flatten(F.transform(F.try_variant_get(v, "$.output", "array<variant>"), lambda o: F.transform(F.try_variant_get(o, "$.content", "array<variant>"), lambda x: F.try_variant_get(x, "$.text", "string")))), ""),
        F.lit(""),
    )
    return F.coalesce(get("$.output_text"), get("$.choices[0].message.content"), get("$.choices[0].text"), nested, parts("$.content"), F.when(F.schema_of_variant(F.try_variant_get(v, "$.content", "variant")) == "STRING", get("$.content")))
