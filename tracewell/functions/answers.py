"""Answer extraction, normalisation and matching as column expressions.

A raw answer is a struct(kind, text): kind s (text), n (number), b (truth value) or j (object or array), null if there is none. A
normalised answer is a struct(k, b, n, s) with k one of b, n, s. The cascade is staged by columns; within a stage a part used more than once
is bound by let(), whose lambda is evaluated outside whole-stage code generation, in the JVM. Nothing goes to Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.text import col, strip

RAW = "struct<kind:string,text:string>"
NORMAL = "struct<k:string,b:boolean,n:double,s:string>"

# How answers are written and announced.
NUMBER = r"-?\d+(?:\.\d+)?"
CHOICE = r"^[A-Ea-e]$"
TAG = r"(?is)(?:<|⟨)\s*answer\s*(?:>|⟩)(.*?)(?:<|⟨)\s*/\s*answer\s*(?:>|⟩)"
TAG_END = r"(?i)(?:<|⟨)\s*/\s*answer\s*(?:>|⟩)"
CUE = r"(?i)(?:final answer|the final answer|answer is|answer:)\s*([^\n\r]+)"
BOXED = r"\\boxed\{([^}]+)\}"
CHOICE_CUES = (r"(?i)<answer>\s*([A-E])\s*</answer>", r"(?i)\banswer\b(?:\s+|[:=\-]\s*)([A-E])\b", r"(?i)\boption\b(?:\s+|[:=\-]\s*)([A-E])\b")
NUMBER_CUES = tuple(rf"(?i)\b{w}\b(?:\s+|[:=\-]\s*)([1-5])(?:\.0+)?\b" for w in ("answer", "option", "choice"))
OPTION_LINE = r"(?i)(?:^|\n)\s*([A-E])\s*[\)\.\:\-]\s*([^\n\r]+)"
ANS_KEY = r"""(?i)(?:^|[\s{,])(?:"ans"|ans)\s*:\s*"""
# the value after an ans key: in double or single quotes with escapes, else up to a comma, brace or line end
ANS_VALUE = ANS_KEY + r"""(?:"([^"\\]*+(?:\\.[^"\\]*+)*+)(?:"|\\?$)|'([^'\\]*+(?:\\.[^'\\]*+)*+)(?:'|\\?$)|([^"'\s,}][^,}\n\r]*+))"""
BOUND = r"(?:\*\*|__|`+)?"
TEACHER_CUES = (
    rf"(?i)\banswer\b\s*[:\-]?\s*{BOUND}\s*\(?\s*([A-E])\s*\)?{BOUND}\b",
    rf"(?i)\bcorrect\s+(?:answer|choice|pair)\s+is\s*{BOUND}\s*\(?\s*([A-E])\s*\)?{BOUND}\b",
    rf"(?i)\boption\b\s*{BOUND}\s*\(?\s*([A-E])\s*\)?{BOUND}\b",
)
PY_FLOAT = r"(?i)^[+-]?(?:\d+(?:_\d+)*(?:\.(?:\d+(?:_\d+)*)?)?(?:e[+-]?\d+)?|\.\d+(?:_\d+)*(?:e[+-]?\d+)?|inf(?:inity)?|nan)$"


def let(x: Column, body: Callable[[Column], Column]) -> Column:
    """body(x) with x evaluated once, however often the body uses it: keeps the plan linear in the length of the cascade."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def first_group(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null if there is no match; an empty group is an empty text."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def raw(c: Column | str, kind: str = "s") -> Column:
    return let(col(c).cast("string"), lambda t: F.when(t.isNotNull(), F.struct(F.lit(kind).alias("kind"), t.alias("text"))))


def float_of(text: Column) -> Column:
    """A number in decimal notation as a careful reader takes it: no trailing d or f; underscores between digits are allowed (T5)."""
    return let(strip(text), lambda s: F.when(s.rlike(PY_FLOAT), F.replace(s, F.lit("_"), F.lit("")).try_cast("double")))


def fraction(text: Column) -> Column:
    r"""a/b, \frac{a}{b} or \fracab with an optional sign, as a finite double; else null."""
    part = lambda x: float_of(F.replace(x, F.lit(","), F.lit("")))

    def ratio(x: Column, p: str) -> Column:
        return let(F.try_divide(part(F.regexp_extract(x, p, 1)), part(F.regexp_extract(x, p, 2))), lambda v: F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v))

    def unsigned(c: Column) -> Column:
        braced, short, plain = r"^\\frac\s*\{([^{}]+)\}\s*\{([^{}]+)\}$", r"^\\frac([+-]?\d+(?:\.\d+)?)([+-]?\d+(?:\.\d+)?)$", r"^([+-]?\d+(?:\.\d+)?)\s*/\s*([+-]?\d+(?:\.\d+)?)$"
        tight = F.replace(c, F.lit(" "), F.lit(""))
        return F.when(c.rlike(braced), ratio(c, braced)).when(tight.rlike(short), ratio(tight, short)).when(c.rlike(plain), ratio(c, plain))

    # only texts with a slash or a fraction mark can be one
    c = F.when(text.rlike(r"/|\\frac"), F.replace(strip(text), F.lit("−"), F.lit("-")))
    return let(c, lambda c: F.when(c.startswith("-"), -1.0).otherwise(1.0) * let(strip(F.regexp_replace(c, r"^[+-]", "")), unsigned))


def number(text: Column) -> Column:
    """the number of a text: after the last ####, without final marks, as a fraction, a decimal, or its first number."""
    tail = lambda s: F.when(F.contains(s, F.lit("####")), strip(F.element_at(F.split(s, "####"), -1))).otherwise(s)
    body = lambda s: F.coalesce(fraction(s), float_of(s), F.regexp_extract(F.replace(s, F.lit(","), F.lit("")), NUMBER, 0).try_cast("double"))
    return let(F.regexp_replace(let(strip(text), tail), r"(?<![.,;:])[.,;:]++$", ""), body)


def normal(k: str, *, b: Column | None = None, n: Column | None = None, s: Column | None = None) -> Column:
    null = F.lit(None)
    return F.struct(
        F.lit(k).alias("k"), (b if b is not None else null.cast("boolean")).alias("b"), (n if n is not None else null.cast("double")).alias("n"), (s if s is not None else null.cast("string")).alias("s")
    )


def normalize(a: Column) -> Column:
    """truth value, choice letter, number, else lower-case text; null stays null."""

    def of(x: Column) -> Column:
        a, t, low = x["a"], x["t"], F.lower(x["t"])
        text = a["kind"] == "s"
        num = F.when(a["kind"] == "n", t.try_cast("double")).when(text, number(t))
        return (
            F.when(a.isNull(), F.lit(None).cast(NORMAL))
            .when(a["kind"] == "b", normal("b", b=low == "true"))
            .when(text & low.isin("yes", "no", "true", "false"), normal("b", b=low.isin("yes", "true")))
            .when(text & t.rlike(CHOICE), normal("s", s=F.upper(t)))
            .otherwise(let(num, lambda n: F.when(n.isNotNull(), normal("n", n=n)).otherwise(normal("s", s=low))))
        )

    return let(let(a, lambda v: F.struct(v.alias("a"), strip(v["text"]).alias("t"))), of)


def close(a: Column, b: Column, tol: float = 1e-6) -> Column:
    """Equal, or within tol absolutely or relatively; infinities only equal themselves, NaN nothing."""
    big = float("inf")
    near = F.abs(a - b) <= F.greatest(F.greatest(F.abs(a), F.abs(b)) * tol, F.lit(tol))
    return ~F.isnan(a) & ~F.isnan(b) & ((a == b) | ((F.abs(a) < big) & (F.abs(b) < big) & near))


def matches(gold: Column, pred: Column, tol: float = 1e-6) -> Column:
    """F9 on normalised answers. A truth value is also the number 0 or 1 (T1). Two missing answers match."""

    def of(x: Column) -> Column:
        g, p = x["g"], x["p"]
        num = lambda v: F.when(v["k"] == "b", v["b"].cast("double")).otherwise(v["n"])
        numeric = lambda v: v["k"].isin("b", "n")
        m = (
            F.when(g.isNull() | p.isNull(), g.isNull() & p.isNull())
            .when((g["k"] == "b") & (p["k"] == "b"), g["b"] == p["b"])
            .when((g["k"] == "s") & g["s"].rlike(CHOICE), (p["k"] == "s") & (g["s"] == F.upper(p["s"])))
            .when(numeric(g) & numeric(p), close(num(g), num(p), tol))
            .otherwise((g["k"] == p["k"]) & g["s"].eqNullSafe(p["s"]))
        )
        return F.coalesce(m, F.lit(False))

    return let(F.struct(gold.alias("g"), pred.alias("p")), of)


def twelve_digits(x: Column) -> Column:
    """A double with up to 12 significant digits, without trailing zeros; exponents of two digits beyond 1e-4 and 1e12."""

    def bare(t: Column) -> Column:
        return F.when(F.contains(t, F.lit(".")), F.regexp_replace(F.regexp_replace(t, r"0+$", ""), r"\.$", "")).otherwise(t)

    def of(v: Column) -> Column:
        x, e = v["x"], v["e"]
        exp = F.regexp_extract(e, r"e([+-]\d+)$", 1).cast("int")

        def plain(exp: Column) -> Column:
            # between 1e-4 and 1e12 the digits of the scientific form are written out with the point moved
            digits = F.regexp_replace(F.regexp_extract(e, r"^-?([\d.]+)e", 1), r"\.", "")
            whole = F.when(exp >= 0, F.concat(F.substring(digits, F.lit(1), exp + 1), F.lit("."), F.substring(digits, exp + 2, F.lit(20)))).otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -exp - 1), digits))
            return F.concat(F.when(x < 0, "-").otherwise(""), bare(whole))

        mant = bare(F.regexp_extract(e, r"^(-?[\d.]+)e", 1))
        science = lambda exp: F.concat(mant, F.lit("e"), F.when(exp < 0, "-").otherwise("+"), F.format_string("%02d", F.abs(exp)))
        return let(exp, lambda exp: F.when((exp < -4) | (exp >= 12), science(exp)).otherwise(plain(exp)))

    finite = let(F.struct(x.alias("x"), F.format_string("%.11e", x).alias("e")), of)
    return F.coalesce(F.when(F.isnan(x), "nan").when(F.abs(x) == float("inf"), F.when(x > 0, "inf").otherwise("-inf")).when(x == 0, "0"), finite)


def label(n: Column) -> Column:
    """F8: a normalised answer as a stable text."""
    return let(n, lambda n: F.when(n.isNull(), "__MISSING__").when(n["k"] == "b", n["b"].cast("string")).when(n["k"] == "n", twelve_digits(n["n"])).otherwise(n["s"]))


def unquoted(c: Column) -> Column:
    return F.regexp_replace(strip(c), "^[\"']++|(?<![\"'])[\"']++$", "")


def letter_of_digit(d: Column) -> Column:
    return F.try_element_at(F.array(*[F.lit(x) for x in "ABCDE"]), d.cast("int"))


def choice_of_number(a: Column) -> Column:
    """1-5 as a letter, from a text or a whole number; else null."""


    def of(a: Column) -> Column:
        digit = let(unquoted(a["text"]), lambda t: F.when(t.rlike(r"^[1-5](?:\.0+)?$"), letter_of_digit(F.substring(t, 1, 1))))
        whole = let(a["text"].try_cast("double"), lambda n: F.when((n == F.floor(n)) & n.between(1, 5), letter_of_digit(n)))
        return F.when(a["kind"] == "s", digit).when(a["kind"] == "n", whole)

    return let(a, of)


def choice_in_text(t: Column) -> Column:
    """a choice announced in free text, by letter first, then by number."""
    return let(t, lambda t: F.coalesce(*[F.upper(first_group(t, p)) for p in CHOICE_CUES], *[letter_of_digit(first_group(t, p)) for p in NUMBER_CUES]))


def first_choice(t: Column) -> Column:
    """F16: the first lone letter A-E."""
    return F.upper(let(unquoted(t), lambda u: first_group(u, r"(?i)\b([A-E])\b")))


def truth(t: Column) -> Column:
    """true/yes or false/no, marks around it aside."""
    return let(F.lower(F.regexp_replace(unquoted(t), r"^[^A-Za-z]+|[^A-Za-z]+$", "")), lambda w: F.when(w.isin("true", "yes"), True).when(w.isin("false", "no"), False))


def tagged(t: Column) -> Column:
    """what stands between answer tags."""
    return let(t, lambda t: F.when(t.rlike(TAG_END), strip(first_group(t, TAG))))


def last_number(t: Column) -> Column:
    return F.try_element_at(F.regexp_extract_all(t, F.lit(f"({NUMBER})"), F.lit(1)), F.lit(-1))


def final_number(t: Column) -> Column:
    """the last number in a box, after an answer cue, or, unless a truth word occurs, of the whole text; as text."""


    def of(t: Column) -> Column:
        open_ = F.when(~t.rlike(r"(?i)\b(true|false|yes|no)\b"), last_number(t))
        return F.when(t.rlike(NUMBER), F.coalesce(last_number(first_group(t, BOXED)), last_number(first_group(t, CUE)), open_))

    return let(t, of)


def option_map(t: Column) -> Column:
    """letter -> text of "A) text" lines; of a letter given twice the last counts. Null if there is none."""
    letters = lambda t: F.transform(F.regexp_extract_all(t, F.lit(OPTION_LINE), F.lit(1)), F.upper)
    values = lambda t: F.transform(F.regexp_extract_all(t, F.lit(OPTION_LINE), F.lit(2)), strip)
    last = lambda pairs: F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda q: q["k"] == p["k"]))
    pairs = let(t, lambda t: F.when(t.rlike(OPTION_LINE), F.arrays_zip(letters(t).alias("k"), values(t).alias("v"))))
    return let(pairs, lambda pairs: F.when(F.size(pairs) > 0, F.map_from_entries(last(pairs))))


def option_match(options: Column, pred: Column) -> Column:
    """The letter whose option text matches the normalised answer, if exactly one does."""
    hits = F.filter(F.map_entries(options), lambda e: matches(normalize(raw_text(e["value"])), pred))
    return let(hits, lambda h: F.when(F.size(h) == 1, F.get(h, F.lit(0))["key"]))


def raw_text(c: Column) -> Column:
    return F.struct(F.lit("s").alias("kind"), c.alias("text"))


def nearest_option(options: Column, n: Column) -> Column:
    """The letter of the numeric option nearest to n; null if two are equally near."""
    d = F.array_sort(F.filter(F.transform(F.map_entries(options), lambda e: F.struct(F.abs(number(e["value"]) - n).alias("d"), e["key"].alias("k"))), lambda e: e["d"].isNotNull()))
    return let(d, lambda d: F.when(F.get(d, F.lit(1)).isNull() | (F.get(d, F.lit(0))["d"] < F.get(d, F.lit(1))["d"]), F.get(d, F.lit(0))["k"]))


def json_value(v: Column) -> Column:
    """A VARIANT as a raw answer; null for a missing one or JSON null."""

    def of(v: Column) -> Column:
        kind = F.schema_of_variant(v)
        k = lambda kind: F.when(kind == "STRING", "s").when(kind == "BOOLEAN", "b").when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"), "n").otherwise("j")
        text = lambda k: F.when(k == "j", F.to_json(v)).otherwise(F.try_variant_get(v, "$", "string"))
        return let(kind, lambda kind: F.when(v.isNotNull() & (kind != "VOID"), let(k(kind), lambda k: F.struct(k.alias("kind"), text(k).alias("text")))))

    return let(v, of)


def json_ans(c: Column, key: str = "ans") -> Column:
    """The member of a text that is one JSON object, as a raw answer."""
    whole = let(strip(c), lambda t: F.when(t.startswith("{") & t.endswith("}"), F.try_parse_json(t)))
    return json_value(F.try_variant_get(whole, f"$.{key}", "variant"))


def braces(c: Column) -> Column:
    """From the first opening to the last closing brace."""


    def of(x: Column) -> Column:
        return F.when((x["a"] > 0) & (x["b"] > x["a"]), F.substring(x["c"], x["a"], x["b"] - x["a"] + 1))

    last = F.length(c) - F.instr(F.reverse(c), F.lit("}")) + 1
    return let(F.struct(c.alias("c"), F.instr(c, F.lit("{")).alias("a"), F.when(F.contains(c, F.lit("}")), last).alias("b")), of)


def undone(c: Column) -> Column:
    """The text with escaped quotes undone; null if there are none."""
    return F.when(F.contains(c, F.lit('\\"')), F.replace(c, F.lit('\\"'), F.lit('"')))


def embedded_ans(c: Column) -> Column:
    """G1: ans of a JSON object: the whole text, a JSON text in a JSON text, between the outer braces; also with escaped quotes undone."""

    def of(c: Column) -> Column:
        double = let(strip(c), lambda t: F.when(t.startswith('"') & t.endswith('"'), F.try_variant_get(F.try_parse_json(t), "$", "string")))
        tries = F.array(c, double, braces(c), undone(c), braces(undone(c)))
        # the first of the texts that holds an answer
        return F.aggregate(tries, F.lit(None).cast(RAW), lambda found, t: F.coalesce(found, json_ans(t)))

    return let(c, of)


def field_ans(c: Column) -> Column:
    """The first value that isn't blank after an ans key in JSON-like text, as text; backslashes of quoted values undone."""

    def of(x: Column) -> Column:
        group = lambda i: F.regexp_extract_all(x, F.lit(ANS_VALUE), F.lit(i))
        back = lambda v: F.regexp_replace(v, r"(?s)\\(.)", "$1")
        each = F.transform(F.arrays_zip(group(1).alias("a"), group(2).alias("b"), group(3).alias("c")), lambda v: F.concat(strip(back(v["a"])), strip(back(v["b"])), unquoted(v["c"])))
        return F.get(F.filter(each, lambda v: v != ""), F.lit(0))

    tries = F.filter(F.array(c, undone(c)), lambda t: t.rlike(ANS_KEY))
    return raw(F.aggregate(tries, F.lit(None).cast("string"), lambda found, t: F.coalesce(found, of(t))))


def text_ans(c: Column) -> Column:
    """G3 of one text: G1, then G2."""
    return let(c, lambda c: F.coalesce(embedded_ans(c), field_ans(c)))


def as_choice(a: Column, choice_task: Column) -> Column:
    """The choice map: for choice tasks a number 1-5, an announced choice or a lone letter becomes the letter."""


    def of(a: Column) -> Column:
        s = F.when(a["kind"] == "s", a["text"])
        return let(F.when(choice_task, F.coalesce(choice_of_number(a), choice_in_text(s), first_choice(s))), lambda x: F.when(x.isNotNull(), raw_text(x)).otherwise(a))

    return let(a, of)


def number_step(n: Column, choice_task: Column) -> Column:
    """A number found in text: as it is, or for choice tasks only if it is 1-5 (else the search goes on)."""
    return let(n, lambda n: F.when(choice_task, raw(choice_of_number(n))).otherwise(n))


def prose_answer(t: Column, choice_task: Column, coerce: bool = False) -> Column:
    """Answer tag, truth value after a cue, final number; with coerce also any number, in this order."""

    def in_tag(tag: Column) -> Column:
        return F.when(tag.isNotNull(), F.coalesce(raw(first_choice(tag)), F.when(choice_task, raw(choice_of_number(raw_text(tag)))), raw(truth(tag), "b"), raw_text(tag)))

    def of(t: Column) -> Column:
        steps = [let(tagged(t), in_tag), raw(truth(first_group(t, CUE)), "b"), number_step(raw(final_number(t)), choice_task)]
        return F.coalesce(*steps, *([number_step(raw(number(t), "n"), choice_task)] if coerce else []))

    return let(t, of)


def object_answer(t: Column, choice_task: Column) -> Column:
    """The cascade on a response that is an object, given as JSON text: ans, the texts of three members, then all of its text."""


    def of(t: Column) -> Column:
        member = lambda k: let(json_ans(t, k), lambda v: F.when(v["kind"] == "s", v["text"]))
        texts = F.array(*[member(k) for k in ("rationale", "response_rationale", "content")], t)
        first = F.aggregate(texts, F.lit(None).cast(RAW), lambda found, x: F.coalesce(found, prose_answer(x, choice_task)))
        return F.coalesce(as_choice(json_ans(t), choice_task), first)

    return let(t, of)


GOLD_KEYS = ("gold_ans", "gold_answer_extracted", "gold", "answer_from_dataset", "answer", "gold_answer")
OPTION_KEYS = ("options", "Options", "option", "Option")


def gold_answer(df: DataFrame, absent_is_null: bool = True) -> Column:
    """The first gold column; blank texts are skipped. A null stops the search unless absent_is_null (a column of a table can't
    tell a missing key from a null, so by default nulls are skipped, too). At last the number of gold_rationale, or its text.
    """
    out = F.lit(None).cast(RAW)
    if "gold_rationale" in df.columns:
        g = F.col("gold_rationale")
        out = F.when(strip(g) != "", F.coalesce(raw(number(g), "n"), raw(g)))
    for k in reversed([k for k in GOLD_KEYS if k in df.columns]):
        kind = {"boolean": "b", "string": "s"}.get(df.schema[k].dataType.simpleString(), "n")
        present = F.col(k).isNotNull() & (strip(F.col(k).cast("string")) != "") if kind == "s" else F.col(k).isNotNull()
        stop = F.lit(False) if absent_is_null else F.col(k).isNull()
        out = F.when(present | stop, raw(k, kind)).otherwise(out)
    return out


def column_raw(df: DataFrame, k: str) -> Column:
    return raw(k, {"boolean": "b", "string": "s"}.get(df.schema[k].dataType.simpleString(), "n"))


_BUILT: dict[tuple, list[tuple[str, Column]]] = {}


def staged(df: DataFrame, build: Callable[[DataFrame, bool], list[tuple[str, Column]]], object_responses: bool) -> DataFrame:
    """df with the columns that build() names, one after the other. They follow from the names and types of df alone and take thousands of
    calls to put together, so they are kept for the next table of the same columns."""
    key = (df.sparkSession.sparkContext.applicationId, build.__name__, tuple(df.dtypes), object_responses)
    if key not in _BUILT:
        _BUILT[key] = build(df, object_responses)
    for name, c in _BUILT[key]:
        df = df.withColumn(name, c)
    return df


def _answer_columns(df: DataFrame, object_responses: bool) -> list[tuple[str, Column]]:
    has = set(df.columns)
    opts = [F.col(k) for k in OPTION_KEYS if k in has]
    out = [("_gold", gold_answer(df)), ("_options", F.coalesce(*[option_map(o) for o in opts]) if opts else F.lit(None).cast("map<string,string>"))]
    out.append(("_choice", F.coalesce((F.col("_gold.kind") == "s") & strip(F.col("_gold.text")).rlike(CHOICE), F.lit(False)) | F.col("_options").isNotNull()))
    ct = F.col("_choice")
    steps = [as_choice(column_raw(df, k), ct) for k in ("model_ans", "pred_ans", "response_ans") if k in has]
    if "response_payload" in has:
        out.append(("_pj", text_ans(F.col("response_payload"))))
        steps += [as_choice(F.col("_pj"), ct), prose_answer(F.col("response_payload"), ct, coerce=True)]
    if "model_response" in has:
        if object_responses:
            steps.append(object_answer(F.col("model_response"), ct))
        else:
            out.append(("_rj", text_ans(F.col("model_response"))))
            steps += [as_choice(F.col("_rj"), ct), prose_answer(F.col("model_response"), ct)]
    if not has & {"model_response", "model_ans", "response_payload"}:
        steps += [as_choice(column_raw(df, k), ct) for k in ("ans", "response_ans", "pred_ans") if k in has]
        if "response_rationale" in has:
            steps.append(prose_answer(F.col("response_rationale"), ct, coerce=True))
    return [*out, ("_pred", F.coalesce(*steps) if steps else F.lit(None).cast(RAW))]


def with_answers(df: DataFrame, object_responses: bool = False) -> DataFrame:
    """df with _gold and _pred (raw answers) and _choice (choice task?), by the scorer's cascade over the columns that df has.

    object_responses: model_response holds objects as JSON text, not texts. Presence of a column stands for presence of a key.
    """
    return staged(df, _answer_columns, object_responses).drop("_pj", "_rj")


def _match_columns(df: DataFrame, object_responses: bool) -> list[tuple[str, Column]]:
    texts = [c for c in ("model_response", "response_payload", "response_rationale") if c in df.columns]
    letter = F.coalesce((F.col("_gold.kind") == "s") & strip(F.col("_gold.text")).rlike(CHOICE), F.lit(False))
    is_letter = (F.col("_p.k") == "s") & F.col("_p.s").rlike(CHOICE)
    text = F.when(F.col("_pred.kind") == "s", F.col("_pred.text"))
    from_rows = [choice_in_text(F.col(c)) for c in texts]
    repaired = F.coalesce(choice_of_number(F.col("_pred")), choice_in_text(text), option_match(F.col("_options"), F.col("_p")), *from_rows)
    fixed = F.when(letter & ~F.coalesce(is_letter, F.lit(False)) & repaired.isNotNull(), normal("s", s=repaired)).otherwise(F.col("_p"))
    ok = F.col("_g").isNotNull() & F.col("_p").isNotNull() & matches(F.col("_g"), F.col("_p"))
    return [("_g", normalize(F.col("_gold"))), ("_p", normalize(F.col("_pred"))), ("_p", fixed), ("_ok", ok)]


def with_match(df: DataFrame, object_responses: bool = False) -> DataFrame:
    """with_answers() plus the row-level repairs of choice answers (F38) and _ok: whether the prediction matches. No gold or no prediction: a miss."""
    return staged(with_answers(df, object_responses), _match_columns, object_responses)


# --- the teacher's side: other rules for numbers, tokens and equality


def teacher_number(text: Column) -> Column:
    """struct(k, b, n, s): truth word, number without currency or percent signs, or the text itself."""

    def of(text: Column) -> Column:
        c = F.replace(F.replace(strip(text), F.lit(","), F.lit("")), F.lit("−"), F.lit("-"))
        c = F.regexp_replace(F.regexp_replace(c, "^[$₹€£]+|[$₹€£]+$", ""), "%+$", "")
        n = let(c, lambda c: F.coalesce(fraction(c), float_of(c), first_group(c, r"^[^\d\-+]*([\-+]?\d+(?:\.\d+)?)[^\d]*$").try_cast("double")))
        low = F.lower(strip(text))
        truth_word = let(low, lambda w: F.when(w.isin("true", "false"), normal("b", b=w == "true")))
        return F.when(text.isNotNull(), F.coalesce(truth_word, let(n, lambda n: F.when(n.isNotNull(), normal("n", n=n)).otherwise(normal("s", s=text)))))

    return let(text, of)


def teacher_matches(gold: Column, pred: Column) -> Column:
    """F10 on texts: truth values by identity, numbers within 1e-9, else lower-case equality; a null never matches."""

    def of(x: Column) -> Column:
        g, p = x["g"], x["p"]
        return F.when((g["k"] == "b") & (p["k"] == "b"), g["b"] == p["b"]).when((g["k"] == "n") & (p["k"] == "n"), F.abs(g["n"] - p["n"]) < 1e-9).otherwise(x["same"])

    same = F.lower(strip(gold)) == F.lower(strip(pred))
    return F.coalesce(let(F.struct(teacher_number(gold).alias("g"), teacher_number(pred).alias("p"), same.alias("same")), of), F.lit(False))


def contained(gold: Column, payload: Column) -> Column:
    """the gold text occurs in the payload, case aside; an empty gold occurs everywhere."""
    return F.contains(F.lower(payload), F.lower(strip(gold)))


def teacher_token(t: Column) -> Column:
    """a raw token as letter, truth value or number; null if nothing is left of it."""
    letter = lambda c: F.upper(first_group(c, r"(?i)\b([A-E])\b"))
    of = lambda c: F.when(c != "", let(letter(c), lambda x: F.when(x.isNotNull(), normal("s", s=x)).otherwise(teacher_number(c))))
    return let(strip(F.regexp_replace(strip(unquoted(t)), r"<[^>]+>", " ")), of)


def teacher_choice(t: Column) -> Column:
    """answer tag, ans field, then announced letters, also in markdown."""
    one = lambda x: let(teacher_token(x)["s"], lambda s: F.when(s.rlike("^[A-E]$"), s))

    def of(t: Column) -> Column:
        field = first_group(t, r"""(?i)(?:"ans"|'ans'|\bans\b)\s*:\s*(?:"([^"]*)"|'([^']*)'|([^,}\n]+))""", 0)
        value = F.regexp_replace(field, r"""(?i)^(?:"ans"|'ans'|ans)\s*:\s*""", "")
        return F.coalesce(one(tagged(t)), one(value), *[F.upper(first_group(t, p)) for p in TEACHER_CUES])

    return let(t, of)


def answer_to_choice(answer: Column, options: Column) -> Column:
    """a letter in the answer, the one option with the same text, the nearest number; else the answer itself."""

    def of(m: Column) -> Column:
        hits = F.filter(F.map_entries(m), lambda e: teacher_matches(e["value"], answer))
        one = let(hits, lambda h: F.when(F.size(h) == 1, F.get(h, F.lit(0))["key"]))
        near = let(teacher_number(answer), lambda n: F.when(n["k"] == "n", nearest_option(m, n["n"])))
        return F.coalesce(let(unquoted(answer), lambda c: F.upper(first_group(c, r"(?i)\b([A-E])\b"))), one, near, answer)

    return let(option_map(options), of)


def quoted_fraction(json: Column) -> Column:
    """A bare fraction after "ans" put in quotes, so that the text parses."""
    return F.regexp_replace(json, r'"ans"\s*:\s*([0-9]+/[0-9]+)', '"ans": "$1"')


def fenced(t: Column) -> Column:
    """The object in a ```json fence, else from the first to the last brace."""
    return F.coalesce(first_group(t, r"(?s)```json\n(\{.*?\})\n```"), braces(t))


def model_json(t: Column) -> Column:
    """The object of a model's reply as VARIANT: the whole text, its braces, its braces with fractions quoted; else null."""
    b = braces(t)
    whole = lambda x: F.when(strip(x).startswith("{") & strip(x).endswith("}"), F.try_parse_json(strip(x)))
    return F.coalesce(whole(t), whole(b), whole(quoted_fraction(b)))


# --- extractors of the guidance baseline (F22-F24): the last match wins

GUIDED_NUMBER = r"(-?\d+(?:[,\d]*)?(?:\.\d+)?)"


def last_match(t: Column, pattern: str) -> Column:
    return F.try_element_at(F.regexp_extract_all(t, F.lit(pattern), F.lit(1)), F.lit(-1))


def guided_number(t: Column) -> Column:
    tail = F.when(F.contains(t, F.lit("####")), F.element_at(F.split(t, "####"), -1))
    j = F.when(strip(json_ans(t)["text"]).rlike(r"^-?\d+(?:\.\d+)?$"), strip(json_ans(t)["text"]))
    plain = lambda x: F.replace(last_match(x, GUIDED_NUMBER), F.lit(","), F.lit(""))
    return F.coalesce(plain(tail), j, plain(t))


def guided_choice(t: Column) -> Column:
    j = F.upper(strip(json_ans(t)["text"]))
    found = [F.upper(last_match(strip(t), p)) for p in (r"(?i)answer\s+is\s*[\(\[]?\s*([A-E])\s*[\)\]]?", r"(?im)(?:^|[\s\(\[])\b([A-E])\b(?:\)|]|\s|$)")]
    return F.coalesce(F.when(j.rlike("^[A-E]$"), j), *found)


def guided_truth(t: Column) -> Column:
    j = F.lower(strip(json_ans(t)["text"]))
    w = last_match(F.lower(t), r"\b(yes|no|true|false)\b")
    return F.coalesce(F.when(j.isin("yes", "true", "1"), "yes").when(j.isin("no", "false", "0"), "no"), F.when(w.isin("yes", "true"), "yes").when(w.isNotNull(), "no"))


def stage2_answer(t: Column, task: str) -> Column:
    """the answer of a second-stage output by task type (math, choice, text)."""
    s = strip(t)
    if task == "math":
        n = F.replace(last_match(s, r"(-?\d+(?:[\.,]\d+)?)"), F.lit(","), F.lit(""))
        return F.coalesce(strip(first_group(s, r"####\s*(.+)")), n, s)
    if task == "choice":
        return F.coalesce(F.upper(last_match(s, r"(?i)\b([A-E])\b")), s)
    if task == "text":
        w = last_match(F.lower(s), "(true|false)")
        return F.when(w == "true", "True").when(w == "false", "False").otherwise(s)
    return s


def norm_number(t: Column) -> Column:
    """whole numbers without decimals, else the shortest decimal, else lower-case text."""
    s = F.replace(strip(t), F.lit(","), F.lit(""))
    n = float_of(s)
    whole = (n == F.floor(n)) & (F.abs(n) < 9e18)
    return F.when(n.isNull() | F.isnan(n) | (F.abs(n) == float("inf")), F.lower(s)).when(whole, n.cast("bigint").cast("string")).otherwise(n.cast("string"))


def norm_choice(t: Column) -> Column:
    return F.substring(F.upper(strip(t)), 1, 1)


def norm_truth(t: Column) -> Column:
    s = F.lower(strip(t))
    return F.when(s.isin("yes", "true", "1"), "yes").when(s.isin("no", "false", "0"), "no").otherwise(s)


# U4: registries by task; an unknown key is an error, an unknown normaliser falls back to lower-case text
EXTRACTORS = {"number": guided_number, "choice": guided_choice, "truth": guided_truth}
NORMALIZERS = {"number": norm_number, "choice": norm_choice, "truth": norm_truth}


def extractor(task: str):
    if task not in EXTRACTORS:
        raise KeyError(f"no extractor for {task!r}; there are {sorted(EXTRACTORS)}")
    return EXTRACTORS[task]


def normalizer(task: str):
    return NORMALIZERS.get(task, lambda t: F.lower(strip(t)))
