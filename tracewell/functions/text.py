"""Text expressions: label tokens, trimming, splits, step counts, quality checks, prompts. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: what a token of a CamelCase or snake_case label is.
LABEL_TOKEN = r"[A-Z]+(?=[A-Z][a-z]|[0-9]|$)|[A-Z]?[a-z]+|[0-9]+"

# Signs of a solution in what should only be guidance, in the order in which they are reported. Only whether they occur
# counts, so digits before and after are not run through: a text of a million digits costs linear time.
REJECT_PATTERNS = {
    "contains_arithmetic": r"\d\s*[\+\-\*/]\s*\d",
    "contains_equation": r"\d\s*=\s*\d|=\s*\d\s*\d",
    "contains_final_answer_number": r"(?i)(therefore\s+the\s+answer\s+is|the\s+answer\s+is|final\s+answer[\s:=\-]|answer[\s:=\-])\s*[$£€]?\s*\d",
    "contains_choice_answer": r"(?im)(the\s+answer\s+is|answer\s+is)\s*[\(\[]?\s*[A-E]\s*[\)\]]?\s*[\.:]?\s*$",
    "contains_long_numbers": r"\b\d{5,}\b",
    "contains_unicode_math": r"[×÷∑∫√]|\d+\^[0-9]",
}
STEP_LINE = r"(?im)^[^\S\n]*(?:step\s+\d+[\s:\-]*|(?:\d+[\.\):])\s+|[-•*]\s+)"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without leading and trailing white space of any kind (F.trim takes off spaces only)."""
    return F.regexp_replace(col(c), r"(?U)^\s++|(?<!\s)\s++$", "")


def is_blank(c: Column | str) -> Column:
    return col(c).isNull() | (strip(c) == "")


def words(c: Column | str) -> Column:
    """White-space separated words; an empty array for a blank text."""
    return F.filter(F.split(strip(c), r"(?U)\s+"), lambda w: w != "")


def label_tokens(c: Column | str) -> Column:
    """lower-case tokens of a label. An all-capitals token counts only before Xx, a digit or the end."""
    return F.transform(F.regexp_extract_all(col(c), F.lit(LABEL_TOKEN), F.lit(0)), F.lower)


def path_tokens(path: Column | str) -> Column:
    """tokens of all steps of a path, in order."""
    return F.flatten(F.transform(col(path), lambda s: F.transform(F.regexp_extract_all(s, F.lit(LABEL_TOKEN), F.lit(0)), F.lower)))


def trim_words(c: Column | str, n: int = 4) -> Column:
    """the first n words; the text as it is if it has no more."""
    w = words(c)
    return F.when(F.size(w) > n, F.array_join(F.slice(w, 1, n), " ")).otherwise(col(c))


def answer_of_marked(c: Column | str) -> Column:
    """struct(rationale, answer) of "rationale #### answer"; without the mark all is answer."""
    p = F.split(F.coalesce(col(c), F.lit("")), "####")
    one = F.size(p) == 1
    return F.struct(F.when(one, "").otherwise(strip(p[0])).alias("rationale"), strip(F.when(one, p[0]).otherwise(F.try_element_at(p, F.lit(2)))).alias("answer"))


def rationale_of_marked(c: Column | str) -> Column:
    """F21, training side: without the mark all is rationale and the answer is empty."""
    p = F.split(F.coalesce(col(c), F.lit("")), "####")
    one = F.size(p) == 1
    return F.struct(strip(p[0]).alias("rationale"), F.when(one, "").otherwise(strip(F.try_element_at(p, F.lit(2)))).alias("answer"))


def final_token(c: Column | str) -> Column:
    """the last word of a text, null if it is blank."""
    return F.try_element_at(words(c), F.lit(-1))


def step_count(c: Column | str) -> Column:
    """marked steps if there are two or more, else lines that aren't blank; 0 for a blank text."""
    text = F.coalesce(col(c), F.lit(""))
    marked = F.regexp_count(text, F.lit(STEP_LINE))
    lines = F.size(F.filter(F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), lambda x: strip(x) != ""))
    return F.when(is_blank(c), 0).when(marked >= 2, marked).otherwise(lines).cast("int")


def reject_reasons(c: Column | str, least: int = 2, most: int = 6) -> Column:
    """why a solution guidance is rejected, as an array in fixed order; empty if it is valid. Null counts as empty."""
    n = step_count(c)
    found = [F.when(n < least, "too_few_steps"), F.when(n > most, "too_many_steps"), *[F.when(col(c).rlike(p), name) for name, p in REJECT_PATTERNS.items()]]
    return F.when(is_blank(c), F.array(F.lit("empty"))).otherwise(F.filter(F.array(*found), lambda x: x.isNotNull()))


def slug(c: Column | str) -> Column:
    """lower-case letters and digits with single hyphens between."""
    return F.regexp_replace(F.regexp_replace(F.lower(strip(c)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def safe_id(c: Column | str, stem: str, position: Column) -> Column:
    """An id with only 0-9A-Za-z_.-, or stem_00000 by position if nothing is left; longer positions keep all their digits."""
    s = F.regexp_replace(F.regexp_replace(col(c).cast("string"), r"[^0-9A-Za-z_.-]+", "_"), r"^[._]+|[._]+$", "")
    return F.when(F.coalesce(s, F.lit("")) != "", s).when(position.isNotNull(), F.format_string(stem.replace("%", "%%") + "_%05d", position.cast("bigint")))


def first_text(*cols: Column | str) -> Column:
    """The first text that isn't blank, stripped; empty if there is none."""
    return F.coalesce(*[F.when(~is_blank(c), strip(c)) for c in cols], F.lit(""))


def with_options(question: Column | str, options: Column | str) -> Column:
    """the question with its options on lines below, unless they are blank or already in it."""
    q, o = strip(question), strip(options)
    return F.when(is_blank(options) | F.contains(q, o), q).otherwise(F.concat(q, F.lit("\nOptions:\n"), o))


# how "ans" is to be given, by task: wording of our own
ANSWER_RULES = {"math": 'Put a bare number into "ans", without its unit.', "text": 'Put true or false into "ans".', "choice": 'Put the letter of one option into "ans": {letters}.'}


def with_choice_rule(prompt: Column | str, letters: str = "ABCDE") -> Column:
    """placeholders and rules for numbers or truth values replaced by those for choices."""
    schema = "<" + "|".join(letters) + ">"
    rule = ANSWER_RULES["choice"].format(letters=", ".join(letters))
    out = col(prompt)
    for old, new in (("<numeric>", schema), ("<bool>", schema), (ANSWER_RULES["math"], rule), (ANSWER_RULES["text"], rule)):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def chat(system: Column, user: Column, assistant: Column | None = None) -> Column:
    """a chat as an array of (role, content); the assistant's turn only for training."""
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.array(turn("system", system), turn("user", user), *([turn("assistant", assistant)] if assistant is not None else []))


def chat_text(messages: Column | str, generate: bool = False) -> Column:
    """a chat as one text, for models without a template of their own."""
    m = col(messages)
    of = lambda role: F.try_element_at(F.transform(F.filter(m, lambda x: x["role"] == role), lambda x: x["content"]), F.lit(1))
    head = F.concat(F.lit("[INST] "), F.coalesce(F.concat(of("system"), F.lit("\n\n")), F.lit("")), F.coalesce(of("user"), F.lit("")), F.lit(" [/INST]"))
    return head if generate else F.concat(head, F.coalesce(F.concat(F.lit(" "), of("assistant")), F.lit("")))
