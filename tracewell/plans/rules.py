"""Queries of the teacher's rules and of the baseline's extractors, each over every row, with the same rules in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import answers as A
from tracewell.functions import loose as L
from tracewell.operators import bank as B
from tracewell.plans import scoring_sql as Z
from tracewell.plans.catalogue import MEMBER, OPTION_VALUES, PRED, TEACH, judged, options, query, table, teacher, widened


def responses(spark: SparkSession, d: str, **columns) -> DataFrame:
    """Expressions on the response of each prediction, worked out before deliveries are told apart."""
    used = ["pred_id", "model_response", "model_ans", "ingested_at"]
    return judged(spark, d, lambda p: widened(p.select(*used)).select("pred_id", "ingested_at", *[c.alias(n) for n, c in columns.items()]), *columns).drop("ingested_at")


LOW = f"(lower({Z.strip('gold')}) = lower({Z.strip('response_ans')}))"


@query(TEACH + "," + Z.teacher_columns("gold", "t") + "," + Z.teacher_columns("response_ans", "t_t") + f", k as (select model, {Z.teacher_same('gold_v', 'response_ans_v', LOW)} as same, contains(lower(response_payload), lower({Z.strip('gold')})) as held from t_t_t) select model, count(*) as n, count(*) filter (where same) as ok, count(*) filter (where held) as contained from k group by 1")
def teacher_scores(spark: SparkSession, d: str) -> DataFrame:
    """the teacher's own rules on its answers."""
    t = teacher(spark, d, "gold", "response_ans", "response_payload", "model")
    ok = A.teacher_matches(F.col("gold"), F.col("response_ans"))
    return t.groupBy("model").agg(F.count("*").alias("n"), F.count_if(ok).alias("ok"), F.count_if(A.contained(F.col("gold"), F.col("response_payload"))).alias("contained"))


def reading_sql(v: str) -> str:
    return f"case {v}.k when 'b' then 'b:' || case when {v}.n = 1 then 'true' else 'false' end when 'n' then 'n:' || format('{{:.6f}}', {v}.n) else 's:' || {v}.s end"


def reading(n):
    return A.let(n, lambda n: F.when(n["k"] == "b", F.concat(F.lit("b:"), n["b"].cast("string"))).when(n["k"] == "n", F.concat(F.lit("n:"), F.format_string("%.6f", n["n"]))).when(n["k"] == "s", F.concat(F.lit("s:"), n["s"])))


@query(PRED + "," + Z.teacher_columns("gold_ans", "p") + f" select pred_id, {reading_sql('gold_ans_v')} as value from p_t")
def teacher_numbers(spark: SparkSession, d: str) -> DataFrame:
    """the teacher's reading of every gold answer."""
    return judged(spark, d, lambda p: p.select("pred_id", "ingested_at", reading(A.teacher_number(F.col("gold_ans"))).alias("value")), "value").drop("ingested_at")


def cleaned(x: str) -> str:
    return Z.strip(f"regexp_replace({Z.strip(Z.bare(x))}, '<[^>]+>', ' ', 'g')")


def lone_letter(x: str) -> str:
    return f"upper({Z.group(Z.plain(x), '(?i)' + chr(92) + 'b([A-E])' + chr(92) + 'b')})"


@query(PRED + f", c as (select pred_id, nullif({cleaned('model_ans')}, '') as tok from p), " + Z.teacher_columns("tok", "c") + f" select pred_id, case when {lone_letter('tok')} is not null then 's:' || {lone_letter('tok')} else {reading_sql('tok_v')} end as value from c_t")
def teacher_tokens(spark: SparkSession, d: str) -> DataFrame:
    """letter, truth value or number of a raw answer."""
    return responses(spark, d, value=reading(A.teacher_token(F.col("model_ans"))))


FIELD = r"""(?i)(?:"ans"|'ans'|\bans\b)\s*:\s*(?:"([^"]*)"|'([^']*)'|([^,}\n]+))"""
VALUE = f"regexp_replace({Z.group('r', FIELD, 0)}, {Z.q('(?i)^(?:' + chr(34) + 'ans' + chr(34) + '|' + chr(39) + 'ans' + chr(39) + '|ans)' + chr(92) + 's*:' + chr(92) + 's*')}, '')"
TAG = f"(case when regexp_matches(r, {Z.q(Z.FENCE_END)}) and regexp_matches(r, {Z.q(Z.FENCE)}) then {Z.strip(f'regexp_extract(r, {Z.q(Z.FENCE)}, 1)')} end)"
CHOICES = "coalesce(" + ", ".join([lone_letter(cleaned(TAG)), lone_letter(cleaned("v")), *[f"upper({Z.group(Z.plain('r'), p)})" for p in A.TEACHER_CUES]]) + ")"


@query(PRED + f", a as (select pred_id, model_response as r from p), b as (select *, {VALUE} as v from a) select pred_id, {CHOICES} as choice from b")
def teacher_choices(spark: SparkSession, d: str) -> DataFrame:
    """the choice of a response by answer tag, ans field or announcement."""
    return responses(spark, d, choice=A.teacher_choice(F.col("model_response")))


BRACES = "(case when instr({x}, '{{') > 0 and contains({x}, '}}') and length({x}) - instr(reverse({x}), '}}') + 1 > instr({x}, '{{') then substr({x}, instr({x}, '{{'), length({x}) - instr(reverse({x}), '}}') + 2 - instr({x}, '{{')) end)"
FENCED = r"(?s)```json\n(\{.*?\})\n```"


@query(PRED + f", a as (select pred_id, model_response as r from p) select pred_id, coalesce({Z.group('r', FENCED)}, {BRACES.format(x='r')}) as object from a")
def fenced_objects(spark: SparkSession, d: str) -> DataFrame:
    """The object in a fence, else between the outer braces."""
    return responses(spark, d, object=A.fenced(F.col("model_response")))


WHOLE = "(case when starts_with({x}, '{{') and ends_with({x}, '}}') and json_valid({x}) then {x}::json end)"
QUOTED = r"""regexp_replace(b, '"ans"\s*:\s*([0-9]+/[0-9]+)', '"ans": "\1"', 'g')"""


@query(PRED + f", a as (select pred_id, model_response as r, {BRACES.format(x='model_response')} as b from p), c as (select pred_id, {Z.strip('r')} as r, {Z.strip('b')} as b, {Z.strip(QUOTED)} as f from a), j as (select pred_id, coalesce({WHOLE.format(x='r')}, {WHOLE.format(x='b')}, {WHOLE.format(x='f')}) as j from c) select pred_id, j is not null as is_object, case when json_type(j->'ans') not in ('OBJECT', 'ARRAY', 'DOUBLE') then j->>'ans' end as ans from j")
def model_objects(spark: SparkSession, d: str) -> DataFrame:
    """The object of a reply, bare fractions put in quotes where that makes it parse."""
    v = A.model_json(F.col("model_response"))
    ans = A.let(A.json_value(F.try_variant_get(v, "$.ans", "variant")), lambda a: F.when(a["kind"].isin("s", "b") | ((a["kind"] == "n") & ~F.contains(a["text"], F.lit("."))), a["text"]))
    return responses(spark, d, is_object=v.isNotNull(), ans=ans)


@query("select distinct id, case when regexp_matches(a, '^[0-9]+/[0-9]+$') then '{\"ans\": \"' || a || '\"}' else '{\"ans\": ' || a || '}' end as json from (select id, replace(coalesce(answer, 'null'), chr(10), ' ') as a from questions)")
def quoted_fractions(spark: SparkSession, d: str) -> DataFrame:
    """A bare fraction behind the key is put in quotes."""
    q = table(spark, d, "questions").select("id", F.concat(F.lit('{"ans": '), F.replace(F.coalesce("answer", F.lit("null")), F.lit("\n"), F.lit(" ")), F.lit("}")).alias("j")).distinct()
    return q.select("id", F.regexp_replace(A.quoted_fraction(F.col("j")), r'^\{"ans": "([0-9]+/[0-9]+)"\}$', '{"ans": "$1"}').alias("json"))


@query(TEACH + "select teacher_id, route.category as category, route.intent[1] as intent, coalesce(len(route.reasoning_path), -1) as n_steps from t where route is not null")
def routes_of_text(spark: SparkSession, d: str) -> DataFrame:
    """Routes given as JSON text."""
    t = teacher(spark, d, "route").where("route is not null").select("teacher_id", B.route_of_text(F.to_json("route")).alias("r"))
    return t.select("teacher_id", "r.category", F.get("r.intent", F.lit(0)).alias("intent"), F.coalesce(F.size("r.reasoning_path"), F.lit(-1)).cast("bigint").alias("n_steps"))


@query(TEACH + f"select teacher_id, coalesce(case when {Z.strip('gold_ans')} <> '' then gold_ans end, case when {Z.strip('gold')} <> '' then gold end, case when {Z.strip('answer_from_dataset')} <> '' then answer_from_dataset end) as gold from t")
def gold_answers(spark: SparkSession, d: str) -> DataFrame:
    """The first gold column that isn't blank."""
    t = teacher(spark, d, "gold_ans", "gold", "answer_from_dataset")
    return t.select("teacher_id", A.gold_answer(t)["text"].alias("gold"))


# --- the baseline's extractors

ANSWER_IS = r"(?i)answer\s+is\s*[\(\[]?\s*([A-E])\s*[\)\]]?"
LONE = r"(?im)(?:^|[\s\(\[])\b([A-E])\b(?:\)|]|\s|$)"
LAST = "nullif(regexp_extract_all({x}, {p}, 1)[-1], '')"


@query(PRED + "," + MEMBER + f"select pred_id, coalesce(case when regexp_full_match(upper(jt), '[A-E]') then upper(jt) end, upper({LAST.format(x=Z.strip('model_response'), p=Z.q(ANSWER_IS))}), upper({LAST.format(x=Z.plain(Z.strip('model_response')), p=Z.q(LONE))})) as choice from with_text")
def guided_choices(spark: SparkSession, d: str) -> DataFrame:
    """the choice by the baseline's rules, the last match wins."""
    return responses(spark, d, choice=A.guided_choice(F.col("model_response")))


@query(PRED + "," + MEMBER + f", w as (select pred_id, lower(jt) as j, {LAST.format(x=Z.plain('lower(model_response)'), p=Z.q(chr(92) + 'b(yes|no|true|false)' + chr(92) + 'b'))} as w from with_text) select pred_id, case when j in ('yes', 'true', '1') then 'yes' when j in ('no', 'false', '0') then 'no' when w in ('yes', 'true') then 'yes' when w is not null then 'no' end as truth from w")
def guided_truths(spark: SparkSession, d: str) -> DataFrame:
    """yes or no by the baseline's rules."""
    return responses(spark, d, truth=A.guided_truth(F.col("model_response")))


S2 = Z.strip("model_response")
MATH = f"coalesce({Z.strip('(' + Z.group(S2, '####' + chr(92) + 's*([^' + chr(92) + 'n' + chr(92) + 'r]+)') + ')')}, replace({LAST.format(x=S2, p=Z.q('(-?' + chr(92) + 'd+(?:[' + chr(92) + '.,]' + chr(92) + 'd+)?)'))}, ',', ''), {S2})"
CHOICE = f"coalesce(upper({LAST.format(x=Z.plain(S2), p=Z.q('(?i)' + chr(92) + 'b([A-E])' + chr(92) + 'b'))}), {S2})"
TEXT = f"case {LAST.format(x='lower(' + S2 + ')', p=Z.q('(true|false)'))} when 'true' then 'True' when 'false' then 'False' else {S2} end"


@query(PRED + f"select pred_id, md5({MATH}) as math, md5({CHOICE}) as choice, md5({TEXT}) as text from p")
def second_stage_answers(spark: SparkSession, d: str) -> DataFrame:
    """the answer of an output by each task type (as hashes: without an answer it is the whole output)."""
    return responses(spark, d, **{task: F.md5(A.stage2_answer(F.col("model_response"), task)) for task in ("math", "choice", "text")})


# --- options


@query(OPTION_VALUES + Z.number_columns("v", "u") + ", " + Z.teacher_columns("v", "u_5") + ", q as (select n, answer from (select row_number() over () as n, answer from o)), " + Z.teacher_columns("answer", "q") + f""",
x as (select u_5_t.n, k, v, v_n, v_v, answer, answer_v from u_5_t join q_t using (n)),
one as (select n, min(k) as k from x where {Z.teacher_same('v_v', 'answer_v', f"lower({Z.strip('v')}) = lower({Z.strip('answer')})")} group by n having count(*) = 1),
far as (select n, k, abs(v_n - answer_v.n) as dist from x where answer_v.k = 'n' and v_n is not null), least_ as (select n, min(dist) as dist from far group by n),
near as (select n, min(k) as k from far join least_ using (n, dist) group by n having count(*) = 1)
select w.id, coalesce({lone_letter(Z.bare('q.answer'))}, one.k, near.k, q.answer) as choice from w join q using (n) left join one using (n) left join near using (n)""")
def answers_to_choices(spark: SparkSession, d: str) -> DataFrame:
    """the answer of a question as one of its options: by letter, by equal text, by nearest number."""
    from tracewell.plans.catalogue import lined

    return options(spark, d).select("id", A.answer_to_choice(F.col("answer"), lined("options")).alias("choice"))


NUMERAL = f"try_cast(case when regexp_full_match({Z.strip('answer')}, {Z.q(Z.FLOAT)}) then replace({Z.strip('answer')}, '_', '') end as double)"


@query(f"select distinct id, case when isfinite({NUMERAL}) and {NUMERAL} = floor({NUMERAL}) then {NUMERAL}::hugeint::varchar when isfinite({NUMERAL}) then {NUMERAL}::varchar when {Z.strip('answer')} = 'true' then 'True' when {Z.strip('answer')} = 'false' then 'False' when {Z.strip('answer')} = 'null' then '' else coalesce({Z.strip('answer')}, '') end as answer from questions")
def clean_answers(spark: SparkSession, d: str) -> DataFrame:
    """numbers in their plain form, else the text."""
    return table(spark, d, "questions").select("id", "answer").distinct().select("id", L.clean_answer(F.col("answer")).alias("answer"))




# --- replies parsed by the teacher's rules (G5, G6, P9), slugs (F30), system lines

OBJECT = f"coalesce({Z.group('r', FENCED)}, {BRACES.format(x='r')})"
ANS = "(case when json_type(j->'ans') in ('OBJECT', 'ARRAY') then (j->'ans')::varchar when (j->'ans') <> 'null' then j->>'ans' end)"


def token_sql(c: str) -> str:
    """The teacher's token of a cleaned text column c whose reading is {c}_v: kind, text, number."""
    return f"case when {c} is null or {c} = '' then null when {lone_letter(c)} is not null then {{'k': 's', 'n': null::double, 's': {lone_letter(c)}}} else {c}_v end"


@query(PRED + f""", a as (select pred_id, model_response as r from p), b as (select *, {OBJECT} as o, {VALUE} as v, {TAG} as tag from a), c as (select *, case when json_valid(o) then case when json_type(o::json) = 'OBJECT' then o::json end end as j from b),
d as (select *, {CHOICES} as choice, {cleaned(ANS)} as jt, {cleaned('tag')} as tt, nullif(regexp_extract_all(replace(r, ',', ''), {Z.q(A.NUMBER)})[-1], '') as ln from c), {Z.teacher_columns('jt', 'd')}, {Z.teacher_columns('tt', 'd_t')}, {Z.teacher_columns('ln', 'd_t_t')},
e as (select pred_id, j is not null as is_json, case when j is not null then {token_sql('jt')} when choice is not null then {{'k': 's', 'n': null::double, 's': choice}} else coalesce({token_sql('tt')}, ln_v) end as x from d_t_t_t)
select pred_id, x.k as kind, x.s as text, case when x.k = 'n' then x.n end as number, is_json from e""")
def parsed_replies(spark: SparkSession, d: str) -> DataFrame:
    """The answer of every response by the teacher's rules: from its object, else by tag, field, cue or last number."""
    r = L.parsed_output(F.col("model_response"))
    out = responses(spark, d, r=r)
    return out.select("pred_id", F.col("r.ans.k").alias("kind"), F.col("r.ans.s").alias("text"), F.col("r.ans.n").alias("number"), F.col("r.payload").isNotNull().alias("is_json"))


@query(PRED + f", a as (select pred_id, {Z.strip('model_response')} as r from p), j as (select pred_id, {WHOLE.format(x='r')} as j from a) select pred_id, case when (j->'rationale') <> 'null' and (j->'ans') <> 'null' then 'ok' else 'parse_error' end as status from j")
def parse_statuses(spark: SparkSession, d: str) -> DataFrame:
    """Whether a reply gave both a rationale and an answer."""
    t = A.strip(F.col("model_response"))
    whole = F.when(F.startswith(t, F.lit("{")) & F.endswith(t, F.lit("}")), F.try_parse_json(t))
    part = lambda k: A.json_value(F.try_variant_get(whole, f"$.{k}", "variant"))
    return responses(spark, d, status=B.parse_status(part("rationale"), part("ans")))


@query(f"select doc_id, regexp_replace(regexp_replace(lower({Z.strip('source')}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as slug from documents")
def slugs(spark: SparkSession, d: str) -> DataFrame:
    """the sources as names of files."""
    from tracewell.functions import text as T

    return table(spark, d, "documents").select("doc_id", T.slug("source").alias("slug"))


@query("select distinct id, question || ' ' || 'Choose one of up to 3 reasoning paths.' as prompt from questions")
def system_lines(spark: SparkSession, d: str) -> DataFrame:
    """a system prompt whose line on the path is rewritten for several paths."""
    from tracewell.plans import prompts as P

    return table(spark, d, "questions").select("id", P.system_line(F.concat("question", F.lit(" Follow the reasoning path.")), 3).alias("prompt")).distinct()
