"""Prompts as a table of templates (F31-F33, U2, U4, C7, P10, P16). Wording is a parameter; what is built here is how prompts are put together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import text
from tracewell.functions.text import strip, with_choice_rule, with_options

TASKS = ("math", "text", "choice")
STRATEGIES = ("direct", "cot", "freeform", "structured", "diverse", "guided")

# Words in a dataset's name or path that give away its task, the first that fits counts.
TASK_HINTS = {"choice": ("mc", "aqua", "arc", "gpqa", "choice"), "text": ("strategy", "yesno", "bool"), "math": ("math", "gsm", "svamp", "word")}

PARTS = {
    "direct": "Give only the answer.",
    "cot": "Think step by step, then give the answer.",
    "freeform": "Choose named reasoning steps of your own and follow them.",
    "structured": "Follow the reasoning path of the route, one step for each name.",
    "diverse": "Give several different chains of reasoning, then the answer they agree on.",
    "guided": "Follow the solution guidance.",
}
ANSWER_RULES = text.ANSWER_RULES | {"choice": text.ANSWER_RULES["choice"].format(letters="A, B, C, D, E")}
SCHEMAS = {"math": "<numeric>", "text": "<bool>", "choice": "<A|B|C|D|E>"}
DETAILED = " Write each step in full sentences."


def templates(spark: SparkSession) -> DataFrame:
    """(strategy, task, detailed, system, instructions): one row for each kind of prompt; small by construction."""
    rows = [
        (s, t, d, "You are a careful tutor.", f'{PARTS[s]}{DETAILED if d else ""}\nReply in JSON: {{"rationale": {{...}}, "ans": {SCHEMAS[t]}}}\n{ANSWER_RULES[t]}')
        for s in STRATEGIES for t in TASKS for d in (False, True)
    ]
    return spark.createDataFrame(rows, "strategy string, task string, detailed boolean, system string, instructions string")


def task_of(name: Column) -> Column:
    """The task type from a dataset's name or path; math where nothing fits."""
    low = F.lower(name)
    out = None
    for task, hints in TASK_HINTS.items():
        hit = F.lit(False)
        for h in hints:
            hit = hit | F.contains(low, F.lit(h))
        out = F.when(hit, task) if out is None else out.when(hit, task)
    return out.otherwise("math")


def dataset_row(df: DataFrame, dataset: str) -> DataFrame:
    """P10: (question, answer, id) of a dataset's own fields; a truth value stays true/false."""
    text = lambda c: strip(F.coalesce(F.col(c).cast("string"), F.lit(""))) if c in df.columns else F.lit("")
    i = F.coalesce(*[F.col(c).cast("string") for c in ("id", "ID", "qid") if c in df.columns] or [F.lit(None).cast("string")])
    if dataset == "svamp":
        parts = F.filter(F.array(text("Body"), text("Question")), lambda x: x != "")
        return df.select(F.array_join(parts, "\n").alias("question"), text("Answer").alias("answer"), i.alias("id"))
    return df.select(text("question").alias("question"), text("answer").alias("answer"), i.alias("id"))


def prompts(questions: DataFrame, spark: SparkSession, *, strategies: tuple[str, ...] = STRATEGIES, detailed: bool = False, gold: bool = False) -> DataFrame:
    """(id, strategy, task, system, user) for each question and strategy; gold puts the reference answer in, for teachers.

    The templates are a few dozen rows and are broadcast. A choice task's placeholders become those of choices (F29).
    """
    t = templates(spark).where(F.col("strategy").isin(*strategies) & (F.col("detailed") == detailed))
    q = questions.withColumn("task", task_of(F.col("dataset"))).withColumn("question", with_options("question", "options"))
    body = F.concat(F.lit("Question:\n"), F.col("question"), F.lit("\n\n"), F.col("instructions"))
    if gold:
        body = F.concat(body, F.coalesce(F.concat(F.lit("\nReference answer: "), F.col("answer")), F.lit("")))
    j = q.join(F.broadcast(t), "task").withColumn("user", F.when(F.col("task") == "choice", with_choice_rule(body)).otherwise(body))
    return j.select("id", "strategy", "task", "system", "user")


def second_round_prompt(question: Column, route: Column, k: int) -> Column:
    """F32: the question with its route as JSON; for k > 1 the route holds options to choose from."""
    lead = F.lit("Choose the best of the reasoning paths and follow it.\n" if k > 1 else "Follow the reasoning path.\n")
    return F.concat(lead, F.lit("Question: "), question, F.lit("\nRoute: "), F.to_json(route))


def system_line(prompt: Column, k: int) -> Column:
    """the system prompt with its line on the path rewritten for several paths."""
    return F.replace(prompt, F.lit("Follow the reasoning path."), F.lit(f"Choose one of up to {k} reasoning paths.")) if k > 1 else prompt


def smoke_matrix(built: DataFrame, checks: dict[str, str]) -> DataFrame:
    """(strategy, task, check, n, n_ok): how many prompts of each kind hold each needed text."""
    c = F.explode(F.map_from_arrays(F.array(*map(F.lit, checks)), F.array(*map(F.lit, checks.values()))))
    e = built.select("strategy", "task", "user", c.alias("check", "needle"))
    return e.groupBy("strategy", "task", "check").agg(F.count("*").alias("n"), F.count_if(F.contains("user", F.col("needle"))).alias("n_ok"))
