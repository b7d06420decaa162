"""Queries of readers, writers and streams: a test table is written in each format, read back, and compared with itself by SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators import metrics, relations
from tracewell.plans import prompts as P
from tracewell.plans import scoring_sql as Z
from tracewell.plans.catalogue import PRED, SCORED, TEACH, big, predictions, query, scored, teacher
from tracewell.session import scratch_path, table
from tracewell.sources import records, sinks
from tracewell.streaming import growth

QUESTION = "id string, dataset string, question string, answer string, options string"
QUESTIONS = "select id, dataset, question, answer, options from questions"
FIELDS = ["id", "dataset", "question", "answer", "options"]


def questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "questions").select(*FIELDS)


def put(spark: SparkSession, df: DataFrame, name: str, **options: str) -> str:
    """Lines of text in a fresh folder."""
    path = scratch_path(spark, name)
    df.write.options(**options).text(path)
    return path


def lines_of(df: DataFrame, end: str = "") -> DataFrame:
    return df.select(F.concat(F.to_json(F.struct(*df.columns)), F.lit(end)).alias("value"))


def fields(df: DataFrame) -> DataFrame:
    return records.typed(df, QUESTION).select(*FIELDS)


# --- readers


@query(QUESTIONS)
def jsonl_scan(spark: SparkSession, d: str) -> DataFrame:
    """JSON lines among blank and malformed ones."""
    q = questions(spark, d)
    junk = q.select(F.explode(F.array(*map(F.lit, ("", "   ", '{"id": "cut', "[1, 2]", "not JSON")))).alias("value"))
    return fields(records.read_jsonl(spark, put(spark, lines_of(q).unionByName(junk), "jsonl")))


@query(QUESTIONS)
def jsonl_commas_scan(spark: SparkSession, d: str) -> DataFrame:
    """S3: a comma behind each line."""
    return fields(records.read_jsonl(spark, put(spark, lines_of(questions(spark, d), ","), "commas"), trailing_commas=True))


@query(QUESTIONS)
def jsonl_gz_scan(spark: SparkSession, d: str) -> DataFrame:
    """Compressed JSON lines."""
    return fields(records.read_jsonl(spark, put(spark, lines_of(questions(spark, d)), "gz", compression="gzip")))


@query(QUESTIONS)
def record_lines_scan(spark: SparkSession, d: str) -> DataFrame:
    """Files of records that turn out to hold JSON lines."""
    return fields(records.read_records(spark, put(spark, lines_of(questions(spark, d)), "records")))


ORDERED = "select *, row_number() over (order by id, question, answer, options) - 1 as pos from (select distinct id, dataset, question, answer, options from questions)"


def array_file(spark: SparkSession, d: str) -> str:
    """A JSON array of the distinct questions in a file of its own, in order."""
    path = scratch_path(spark, "array") + ".json"
    q = questions(spark, d).distinct().withColumn("_k", F.struct("id", "question", "answer", "options"))
    sinks.write_json_array(q.select(*FIELDS, "_k"), path, "_k")
    return path


@query(f"select id, dataset, question, answer, options, pos from ({ORDERED})")
def json_array_scan(spark: SparkSession, d: str) -> DataFrame:
    """A file of one JSON array, with the place of each item."""
    r = records.read_records(spark, array_file(spark, d))
    return records.typed(r, QUESTION).select(*FIELDS, *big("_pos")).withColumnRenamed("_pos", "pos")


@query(f"select id, question from ({ORDERED}) where pos >= 30 and pos < 90")
def json_slice_scan(spark: SparkSession, d: str) -> DataFrame:
    """A slice of the array below "data" in a wrapper object."""
    text = spark.read.text(array_file(spark, d), wholetext=True)
    path = put(spark, text.select(F.concat(F.lit('{"data": '), F.regexp_replace("value", "\n", " "), F.lit("}")).alias("value")), "wrapped")
    return records.typed(records.read_slice(records.read_records(spark, path), 30, 60), QUESTION).select("id", "question")


@query(f"select id, question from ({ORDERED})")
def json_repair_scan(spark: SparkSession, d: str) -> DataFrame:
    """An array that ends with a comma and no bracket."""
    text = spark.read.text(array_file(spark, d), wholetext=True)
    path = put(spark, text.select(F.concat(F.regexp_replace(F.regexp_replace("value", r"\]\s*$", ""), "\n", " "), F.lit(",")).alias("value")), "cut")
    return records.typed(records.read_records(spark, path, repair=True), QUESTION).select("id", "question")


@query(f"select id from ({ORDERED}) where pos >= 10 and pos < 60")
def jsonl_offset_scan(spark: SparkSession, d: str) -> DataFrame:
    """An offset and a limit over JSON lines, any malformed line an error."""
    q = questions(spark, d).distinct().repartitionByRange(1, "id", "question", "answer", "options").sortWithinPartitions("id", "question", "answer", "options")
    r = records.numbered(records.read_jsonl(spark, put(spark, lines_of(q), "offset"), fail=True))
    return records.typed(records.read_slice(r, 10, 50), QUESTION).select("id")


@query(f"select {Z.strip('question')} as question from questions where {Z.strip('question')} <> ''")
def question_scan(spark: SparkSession, d: str) -> DataFrame:
    """The questions of JSON lines, stripped."""
    padded = questions(spark, d).withColumn("question", F.concat(F.lit(" \t"), "question", F.lit(" ")))
    return records.read_questions(spark, put(spark, lines_of(padded), "questions")).select("question")


@query("select teacher_id, response_rationale, response_ans from teacher")
def training_scan(spark: SparkSession, d: str) -> DataFrame:
    """Rationale and answer under either of their names."""
    t = table(spark, d, "teacher").select("teacher_id", "response_rationale", "response_ans")
    short = t.where("teacher_id % 2 = 0").select("teacher_id", F.col("response_rationale").alias("rationale"), F.col("response_ans").alias("ans"))
    path = put(spark, lines_of(t.where("teacher_id % 2 = 1")).unionByName(lines_of(short)), "training")
    r = records.training_rows(records.read_records(spark, path))
    return r.select(F.get_json_object("raw", "$.teacher_id").cast("bigint").alias("teacher_id"), "response_rationale", "response_ans")


@query(f"select case when pos % 3 = 0 then 'ds_' || lpad(pos::varchar, 6, '0') else id end as id, {Z.strip('question')} || case when {Z.strip('options')} <> '' and not contains({Z.strip('question')}, {Z.strip('options')}) then chr(10) || {Z.strip('options')} else '' end as question from ({ORDERED}) where {Z.strip('question')} <> ''")
def guidance_scan(spark: SparkSession, d: str) -> DataFrame:
    """Records without an id take one by their place."""
    path = array_file(spark, d)
    r = records.read_records(spark, path)
    r = r.withColumn("raw", F.when(F.col("_pos") % 3 == 0, F.regexp_replace("raw", '"id": ', '"no_id": ')).otherwise(F.col("raw")))
    return records.guidance_rows(r, "ds").select("id", "question")


@query("select dataset, 1 as n_files from questions where dataset is not null group by 1")
def file_scan(spark: SparkSession, d: str) -> DataFrame:
    """The files below a folder, found by pattern."""
    path = scratch_path(spark, "files")
    questions(spark, d).where("dataset is not null").repartition(1).write.partitionBy("dataset").json(path)
    f = records.files(spark, path, "*.json")
    return f.groupBy(F.regexp_extract("path", "dataset=([^/]*)/", 1).alias("dataset")).agg(F.count("*").cast("int").alias("n_files"))


@query("select distinct id from questions")
def id_scan(spark: SparkSession, d: str) -> DataFrame:
    """A file of ids, blank lines left out."""
    q = questions(spark, d).select("id").distinct()
    path = put(spark, q.select(F.concat("id", F.lit(" ")).alias("value")).unionByName(q.select(F.lit("").alias("value"))), "ids")
    return records.id_list(spark, path).select("id")


VECTOR = "select 'v' || vec_id as token, len(embedding) as n, round(list_sum(embedding::double[]), 4) as total from embeddings"


def vector_rows(v: DataFrame) -> DataFrame:
    return v.select("token", F.size("vec").cast("bigint").alias("n"), F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double")), 4).alias("total"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("token"), F.col("embedding").cast("array<float>").alias("vec"))


@query(VECTOR)
def vector_text_scan(spark: SparkSession, d: str) -> DataFrame:
    """Word vectors as text."""
    v = vectors(spark, d)
    head = v.agg(F.concat_ws(" ", F.count("*"), F.max(F.size("vec"))).alias("value"))
    rows = v.select(F.concat_ws(" ", "token", F.array_join(F.transform("vec", lambda x: x.cast("string")), " ")).alias("value"))
    return vector_rows(records.read_vectors(spark, put(spark, head.unionByName(rows), "vectors")))


@query(VECTOR)
def vector_binary_scan(spark: SparkSession, d: str) -> DataFrame:
    """Word vectors in the binary form of word2vec."""
    path = scratch_path(spark, "vectors") + ".bin"
    sinks.write_vectors(vectors(spark, d), path)
    return vector_rows(records.read_vectors(spark, path, binary=True))


@query(PRED + "select index as id, count(*) as n from p where run <= 3 and index is not null group by 1")
def finished_scan(spark: SparkSession, d: str) -> DataFrame:
    """How often each id was written to a sink so far; the last line is cut off."""
    done = predictions(spark, d, "run", "index").where("run <= 3").select(F.col("index").alias("id"), "run")
    path = put(spark, lines_of(done).unionByName(spark.createDataFrame([('{"id": "wordmath',)], "value string")), "sink")
    return records.finished(spark, path, "id")


@query("select distinct id from questions where id not in (select index from predictions where run <= 3 and index is not null)")
def pending_scan(spark: SparkSession, d: str) -> DataFrame:
    """S16, J3, U-e: the inputs that a sink lacks."""
    path = put(spark, lines_of(predictions(spark, d, "run", "index").where("run <= 3").select(F.col("index").alias("id"))), "sink")
    return relations.not_done(questions(spark, d).select("id").distinct(), records.finished(spark, path, "id"), "id")


@query(PRED + "select pred_id, nullif(model_response, '') as text from p")
def response_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Replies in the shapes of several services, flattened to their text."""
    p = predictions(spark, d, "model_response").withColumn("t", F.col("model_response"))
    named = lambda k, v: F.struct(v.alias(k))
    part = F.array(named("text", F.col("t")))
    shapes = [named("output_text", F.col("t")), named("choices", F.array(named("message", named("content", F.col("t"))))), named("output", F.array(named("content", part))), named("content", part), named("content", F.col("t"))]
    reply = F.to_json(shapes[0])
    for k, s in enumerate(shapes[1:], 1):
        reply = F.when(F.col("pred_id") % len(shapes) == k, F.to_json(s)).otherwise(reply)
    return p.select("pred_id", F.nullif(records.response_text(F.try_parse_json(reply)), F.lit("")).alias("text"))


# --- writers


@query("select id, row_number() over (order by id) as n from (select distinct id from questions)")
def sorted_sink(spark: SparkSession, d: str) -> DataFrame:
    """A sink rewritten whole, in order of the id as text: the place of each line over all files."""
    path = scratch_path(spark, "sorted")
    ids = questions(spark, d).select("id").distinct()
    sinks.write_jsonl(ids.limit(5), path)
    sinks.write_jsonl(ids, path, mode="overwrite", order="id")
    r = records.numbered(records.read_jsonl(spark, path))
    sizes = r.groupBy("file").agg(F.count("*").alias("_n"))
    before = sizes.alias("a").join(sizes.alias("b"), F.col("b.file") < F.col("a.file"), "left").groupBy("a.file").agg(F.coalesce(F.sum("b._n"), F.lit(0)).alias("_before"))
    return r.join(F.broadcast(before), "file").select(F.try_variant_get("data", "$.id", "string").alias("id"), (F.col("_pos") + F.col("_before") + 1).alias("n"))


@query("select id, question from (select id, question from questions union all select id, question from questions where dataset = 'yesno')")
def appended_sink(spark: SparkSession, d: str) -> DataFrame:
    """K1, K4: JSON lines added to a sink."""
    path = scratch_path(spark, "appended")
    q = questions(spark, d).select("id", "dataset", "question")
    sinks.write_jsonl(q, path)
    sinks.write_jsonl(q.where("dataset = 'yesno'"), path, mode="append")
    return records.typed(records.read_jsonl(spark, path), QUESTION).select("id", "question")


@query("select id, 2 as n from questions")
def text_sink(spark: SparkSession, d: str) -> DataFrame:
    """K5: raw texts, twice, a blank line behind each."""
    path = scratch_path(spark, "texts")
    for _ in range(2):
        sinks.write_text(questions(spark, d), "id", path)
    t = spark.read.text(path)
    each = t.where("value <> ''").groupBy(F.col("value").alias("id")).agg(F.count("*").alias("n2"))
    blank = t.agg(F.count_if(F.col("value") == "").alias("blank"), F.count_if(F.col("value") != "").alias("full"))
    own = questions(spark, d).select("id").join(each, "id").crossJoin(F.broadcast(blank.where("blank = full")))
    copies = questions(spark, d).groupBy("id").agg(F.count("*").alias("c"))
    return own.join(copies, "id").select("id", (F.col("n2") / F.col("c")).cast("int").alias("n"))


@query(SCORED + "select source, count(*) as n, cast(sum(ok::int) as bigint) as n_correct from k where source is not null group by 1")
def label_tree_sink(spark: SparkSession, d: str) -> DataFrame:
    """K6: labels in a file for each source, in a tree like that of the sources."""
    from tracewell.functions import answers as A
    from tracewell.plans.catalogue import judged, widened

    used = ["pred_id", "source", "gold_ans", "model_response", "model_ans", "options", "ingested_at"]
    path = scratch_path(spark, "labels")
    labels = judged(spark, d, lambda p: metrics.labelled(A.with_match(widened(p.select(*used))), "pred_id", "source", "ingested_at"), "source", "gold", "pred", "correct").drop("ingested_at")
    sinks.write_labels(labels, path, "source")
    back = spark.read.schema("correct boolean").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.labels.jsonl").json(path).select("correct", F.col("_metadata.file_path").alias("file"))
    source = F.url_decode(F.regexp_extract("file", r"/labels-[0-9a-f]{32}/(.*?)\.labels\.jsonl$", 1))
    return back.groupBy(source.alias("source")).agg(F.count("*").alias("n"), F.count_if("correct").alias("n_correct"))


REPORT = SCORED + "select dataset, cast(sum(ok::int) as bigint) as correct, count(*) as total from k group by 1"


def report_path(spark: SparkSession, d: str) -> str:
    path = scratch_path(spark, "report")
    sinks.write_report(metrics.accuracy(scored(spark, d), "dataset").select("dataset", *big("correct", "total")), path)
    return path


@query(REPORT)
def report_csv(spark: SparkSession, d: str) -> DataFrame:
    """K7: a result as CSV."""
    return spark.read.schema("dataset string, correct bigint, total bigint").option("header", True).csv(report_path(spark, d) + "/csv")


@query(REPORT)
def report_json(spark: SparkSession, d: str) -> DataFrame:
    """K7: a result as JSON."""
    return spark.read.schema("dataset string, correct bigint, total bigint").json(report_path(spark, d) + "/json")


@query(PRED + """, c as (select dataset, method, count(*) as n from p group by all), g as (select d.dataset, m.method, n from (select distinct dataset from p) d cross join (select distinct method from p) m left join c on c.dataset is not distinct from d.dataset and c.method = m.method)
select '| ' || coalesce(dataset, '') || ' | ' || string_agg(coalesce(n::varchar, ''), ' | ' order by method) || ' |' as line from g group by dataset""")
def report_pivot(spark: SparkSession, d: str) -> DataFrame:
    """K8: a Markdown table with the methods as columns; its rows."""
    n = predictions(spark, d, "dataset", "method").groupBy("dataset", "method").agg(F.count("*").alias("n"))
    path = scratch_path(spark, "pivot")
    sinks.write_report(sinks.pivoted(n, "dataset", "method", "n"), path)
    t = spark.read.text(path + "/md")
    return t.where(F.col("value").startswith("| ") & ~F.col("value").startswith("| dataset")).select(F.col("value").alias("line"))


@query("select dataset, '[' || string_agg(run::varchar, ',' order by run) || ']' as runs from (select distinct dataset, run from predictions) group by 1")
def json_safe_sets(spark: SparkSession, d: str) -> DataFrame:
    """A set as a sorted JSON list."""
    return predictions(spark, d, "dataset", "run").groupBy("dataset").agg(F.collect_set("run").alias("r")).select("dataset", sinks.json_safe(F.col("r"), True).alias("runs"))


@query("select count(distinct (category, intent, reasoning_path)) as unique_reasoning_paths from bank")
def history_sink(spark: SparkSession, d: str) -> DataFrame:
    """K10, T-d: the newest of two summaries appended to a history."""
    from tracewell.operators.bank import summary_scoped

    path = scratch_path(spark, "history")
    b = table(spark, d, "bank")
    sinks.append_history(summary_scoped(b.where("path_pos = 0")), path)
    sinks.append_history(summary_scoped(b), path)
    return sinks.latest_summary(spark.read.parquet(path)).select("unique_reasoning_paths")


# --- streams (T-a, T-e, T-f, A24)


def arrivals(spark: SparkSession, df: DataFrame, parts: int = 4) -> DataFrame:
    """A table as a stream of several micro-batches."""
    path = scratch_path(spark, "arrivals")
    df.repartition(parts).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(path)


def drained(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """What a stream gives once all its input is in; complete mode: the last version."""
    spark = stream.sparkSession
    path = scratch_path(spark, name)

    def keep(df: DataFrame, batch_id: int) -> None:
        # a batch that comes again replaces what it wrote
        df.write.mode("overwrite").parquet(f"{path}/out/{'last' if mode == 'complete' else batch_id}")

    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", path + "/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(path + "/out")


@query("select dataset, count(distinct pred_id) as n from predictions group by 1")
def once_each_stream(spark: SparkSession, d: str) -> DataFrame:
    """T-a: each record of a stream once, however often it was delivered."""
    s = arrivals(spark, table(spark, d, "predictions").select("pred_id", "dataset", F.col("ingested_at").cast("timestamp").alias("ingested_at")))
    return drained(growth.once_each(s, "pred_id", "ingested_at", "3650 days").select("dataset"), "once", "append").groupBy("dataset").agg(F.count("*").alias("n"))


@query(SCORED + "select method, cast(sum(ok::int) as bigint) as correct, count(*) as total from k group by 1")
def running_accuracy_stream(spark: SparkSession, d: str) -> DataFrame:
    """Correct and total so far, over a stream of judged predictions."""
    return drained(growth.running_accuracy(arrivals(spark, scored(spark, d).select("method", "_ok")), "method"), "running", "complete")


@query("select cast(cast(ts as date) as varchar) as day, event_type, count(*) as n from events group by all")
def windowed_stream(spark: SparkSession, d: str) -> DataFrame:
    """Counts by event-time window over a stream."""
    s = arrivals(spark, table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type"))
    w = drained(growth.windowed_counts(s, "ts", "1 day", "3650 days", "event_type"), "windows", "complete")
    return w.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("select event_type, count(*) as n from events group by 1")
def resumed_stream(spark: SparkSession, d: str) -> DataFrame:
    """T-e: a stream stopped half-way and started again at its checkpoint reads the rest, and nothing twice."""
    e = table(spark, d, "events").select("event_id", "event_type")
    path = scratch_path(spark, "resumed")
    for odd in (0, 1):
        e.where(F.col("event_id") % 2 == odd).write.mode("append").parquet(path + "/in")
        s = spark.readStream.schema(e.schema).parquet(path + "/in")
        s.writeStream.format("parquet").option("path", path + "/out").option("checkpointLocation", path + "/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path + "/out").groupBy("event_type").agg(F.count("*").alias("n"))


@query(PRED + ", g as (select distinct a.dataset, b.method from p a, (select distinct method from p) b where a.dataset is not null) select dataset, method from g where not exists (select 1 from p where p.dataset = g.dataset and p.method = g.method and p.dataset <> 'yesno')")
def stale_cells(spark: SparkSession, d: str) -> DataFrame:
    """T-f: the cells of a grid that may be submitted again: those without a file (all files are new here)."""
    path = scratch_path(spark, "cells")
    p = predictions(spark, d, "dataset", "method", "model").where("dataset is not null")
    p.where("dataset <> 'yesno'").select("dataset", "method").distinct().repartition(1).withColumn("x", F.lit(1)).write.partitionBy("dataset", "method").json(path)
    cell = lambda k: F.url_decode(F.regexp_extract("path", f"/{k}=([^/]*)/", 1)).alias(k)
    f = records.files(spark, path, "*.json").select(cell("dataset"), cell("method"), "modificationTime")
    return growth.stale(relations.grid(p.select("dataset"), p.select("method")), f, ["dataset", "method"])


# --- rows and prompts


@query(f"select distinct array_to_string(list_filter([{Z.strip('question')}, {Z.strip('options')}], lambda x: x <> ''), chr(10)) as question, coalesce({Z.strip('answer')}, '') as answer, id from questions")
def dataset_rows(spark: SparkSession, d: str) -> DataFrame:
    """P10: questions given in two parts."""
    q = questions(spark, d).select(F.col("question").alias("Body"), F.col("options").alias("Question"), F.col("answer").alias("Answer"), F.col("id").alias("ID"))
    return P.dataset_row(q, "svamp").distinct()


@query(f"select distinct id, coalesce(nullif({Z.strip('options')}, ''), nullif({Z.strip('answer')}, ''), '') as text from questions")
def first_texts(spark: SparkSession, d: str) -> DataFrame:
    """The first of several texts that isn't blank."""
    from tracewell.functions import text as T

    return questions(spark, d).select("id", T.first_text("options", "answer").alias("text")).distinct()


@query(f"select doc_id, string_split_regex({Z.strip('text')}, '{Z.SPACE}+')[-1] as token from documents where {Z.strip('text')} <> ''")
def final_tokens(spark: SparkSession, d: str) -> DataFrame:
    """the last word of each text."""
    from tracewell.functions import text as T

    return table(spark, d, "documents").select("doc_id", T.final_token("text").alias("token")).where("token is not null")


@query(TEACH + "select teacher_id, unnest(a) as step, unnest(b) as option from (select teacher_id, list_transform(route.reasoning_path[:n], lambda x: coalesce(x, '~')) as a, list_transform(route.reasoning_path_options[1][:n], lambda x: coalesce(x, '~')) as b from (select *, case when route.reasoning_path is not null and route.reasoning_path_options[1] is not null then least(len(route.reasoning_path), len(route.reasoning_path_options[1])) end as n from t) where n > 0)")
def zipped_steps(spark: SparkSession, d: str) -> DataFrame:
    """The steps of a path beside those of the first option, up to the end of the shorter."""
    t = teacher(spark, d, "route").select("teacher_id", F.col("route.reasoning_path").alias("a"), F.get("route.reasoning_path_options", F.lit(0)).alias("b"))
    z = t.select("teacher_id", F.explode(relations.zipped(F.col("a"), F.col("b"))).alias("z"))
    return z.select("teacher_id", F.coalesce("z.a", F.lit("~")).alias("step"), F.coalesce("z.b", F.lit("~")).alias("option"))


@query(TEACH + "select teacher_id, 0 as n_steps from t where route is not null")
def empty_arm(spark: SparkSession, d: str) -> DataFrame:
    """R2: routes with an empty path."""
    from tracewell.operators.sampling import perturbed
    from tracewell.plans.catalogue import perturb_input

    return perturbed(perturb_input(spark, d), "empty", "teacher_id", "teacher_id").select("teacher_id", F.size("reasoning_path").alias("n_steps"))


@query(TEACH + """, o as (select teacher_id, route.reasoning_path as path, list_filter(route.reasoning_path_options, lambda x, i: i = list_position(route.reasoning_path_options, x)) as options from t where route is not null)
select teacher_id, cast(least(coalesce(len(options), 0), 2) as bigint) as n_options, options is null or len(options) = 0 as has_path from o where path is not null""")
def prompt_routes(spark: SparkSession, d: str) -> DataFrame:
    """Up to two distinct options instead of the path, where there are some."""
    from tracewell.operators import bank as B

    r = teacher(spark, d, "route").where("route.reasoning_path is not null").select("teacher_id", B.prompt_route(F.col("route"), 2).alias("r"))
    return r.select("teacher_id", F.coalesce(F.size("r.reasoning_path_options"), F.lit(0)).cast("bigint").alias("n_options"), F.col("r.reasoning_path").isNotNull().alias("has_path"))
