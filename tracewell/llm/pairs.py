"""Broken prompt and response pairs, and text cut off by field limits.

Method: self-join by prefix. All sentences of the table are sorted by text without digits (a range shuffle, so that no common beginning makes a
hot group); the unfinished last sentence of a response is a shortened version if the next whole sentence in that order
begins with it and goes on. Lengths at which a source has far more values than around them are its limits. A response in prose that
ends openly is truncated if one of the two speaks for it: an open end alone is no evidence, since many writers leave the last stop
away. A cut mark or a JSON text that never closes speaks for itself. Shells, refusals, copies and other languages are told by
rules on the single pair, in the same pass, so that a pair has one defect.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from re import _parser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.session import widened, written

# Texts that stand for no answer.
PLACEHOLDERS = frozenset(
    ["n/a", "na", "none", "null", "nil", "nan", "undefined", "(no output)", "no output", "[empty]", "empty", "(empty)", "<empty>", "<none>", "[none]", "tbd", "todo", "no answer", "no response", "[no response]", "missing", "placeholder", "lorem ipsum"]
)

# Marks that a tool sets where it cuts.
CUT_MARK = re.compile(r"(?:\.\.\.|…|\ufffd|[\[(<]\s*(?:truncated|cut|snip|continued|\.\.\.|…)[^\])>]{0,20}[\])>]?)\s*[\"'”’]?\s*$", re.I)

# How answers are announced, in lower case.
ANSWER = (
    "####", "answer is", "answer:", "answer =", "answer=", "final answer", "we get ", "that leaves ", " is correct", "result is", "respuesta es", "respuesta:", "resultado es", "resultado:", "resposta é", "resposta:",
    "resultado é", "réponse est", "réponse :", "réponse:", "on obtient", "antwort lautet", "antwort ist", "antwort:", "das ergebnis", "ergebnis ist", "ergebnis:", "ответ", "получаем", "答案", "结果", "\\boxed",
)


def has_answer(text: str) -> bool:
    low = text.lower()
    for cue in ANSWER:
        if cue in low:
            return True
    return False


ANSWER_END = re.compile(r"(?:####|\b(?:final answer|answer|respuesta|resposta|réponse|antwort|ответ)\s*:|答案[:：])[ \t]*\S[^\n]{0,60}$", re.I)

# How speakers decline, by language.
REFUSAL = re.compile(
    r"\bi (?:cannot|can't|can not|am unable to|am not able to|won't be able|will not be able|must decline|decline to|refuse to|do not have the ability|don't have the ability|would rather not)\b"
    r"|\bi'm (?:unable|not able|not comfortable|not allowed|not permitted)\b|\bi am not (?:comfortable|allowed|permitted)\b|\bi'd rather not\b|\b(?:have to|must|will) pass on th|\blet's skip\b|\boutside (?:of )?what i\b|\bagainst my (?:guidelines|policy|rules)\b"
    r"|\bmy (?:training|instructions|guidelines|rules|policy)\b[^.]{0,20}\b(?:stop|stops|don't allow|do not allow|forbid|prevent|prevents|keep)\b|\bnot something i can\b|\brequest can't be completed\b|\brequest cannot be\b|\bleave it unanswered\b"
    r"|\bsomeone else should\b|\bno solution from me\b|\b(?:isn't|is not) permitted\b|\bas an? (?:ai|language model)\b"
    r"|\bno puedo\b|\bno me es posible\b|\blo siento\b|\bno estoy en condiciones\b|\bje ne peux pas\b|\bje ne suis pas (?:en mesure|autorisé)|\bdésolé|\bil m'est impossible\b"
    r"|\bkann ich\b[^.]{0,40}\bnicht\b|\btut mir leid\b|\bdarf ich keine\b|\bich kann\b[^.]{0,40}\bnicht\b|\bnão posso\b|\bnão consigo\b|\bdesculpe|\blamento\b|\bне могу\b|\bизвините|\bк сожалению\b|\bпростите\b|无法|抱歉|对不起|不能回答|не смогу",
    re.I,
)


def literals(pattern: str) -> list[str]:
    """Texts of which at least one stands in every match of a pattern: of each sequence the longest literal part, of alternatives that of each."""

    def best(parts: list) -> set[str]:
        options: list[set[str]] = []
        run = ""
        for op, arg in [*parts, (None, None)]:
            if str(op) == "LITERAL":
                run += chr(arg)
                continue
            if run:
                options.append({run})
                run = ""
            inner = {"BRANCH": lambda: arg[1], "SUBPATTERN": lambda: [arg[-1]], "MAX_REPEAT": lambda: [arg[2]] if arg[0] else []}.get(str(op), list)()
            found = [best(x) for x in inner]
            if found and all(found):
                options.append(set().union(*found))
        return max(options, key=lambda x: min(map(len, x)), default=set())

    found = best(list(_parser.parse(pattern)))
    return sorted(x for x in found if not any(y in x for y in found if y != x))


# a refusal holds one of these, which is looked up first; they follow from the pattern
REFUSAL_CUES = tuple(literals(REFUSAL.pattern))

# Frequent function words of each language, and the words that announce an answer.
WORDS = {
    "en": "a could within across same other any into over between every up down they you your i my me his her if let long short must been just where both away many much first the of and to in is that for it with as on are this by from at or an be which not each so we how what will after would does has have only one two out all than then more their there use answer was were when who",
    "de": "der die das und ist nicht ein eine einen mit von zu den dem des im auf für sich wir also wie viele insgesamt werden bleiben sind hat noch dass aus nach bis bei durch am zur zum über nur jede jeder antwort ergebnis lautet dazu möglich keine keiner kein es zunächst daraus folgt während ersten davon zusammen muss sein je dort",
    "fr": "le la les des du et est une un dans pour que qui ne pas sur avec au aux on par plus combien donc cela ce cette il elle se reste après chaque réponse obtient résultat ont été tout aucune ces sont puis déjà abord début",
    "es": "el la los las de del y es una un en para que por con no se al lo cuántos cuántas hay más cada después así tiene está respuesta resultado tanto ninguna son su ambas otra también entre",
    "pt": "o a os as do da dos das e é uma um em para que por com não se ao mais cada são então quantos há resposta resultado logo nenhuma está ou depois tem sobre portanto assim ninguém durante no na",
    "ru": "",
    "zh": "",
}

# Letters and signs that tell one of these languages from the others.
OWN_LETTERS = {"de": "ßäöü", "fr": "èœëîùû", "es": "ñ¿¡", "pt": "ãõ"}


def _weights() -> dict[str, list[tuple[str, float]]]:
    held: dict[str, list[str]] = {}
    for lang, ws in WORDS.items():
        for w in set(ws.split()):
            held.setdefault(w, []).append(lang)
    return {w: [(lang, 1.0 / len(langs)) for lang in langs] for w, langs in held.items()}


INVISIBLE = re.compile("[\x00-\x1f\x7f-\x9f\u00ad\u0600-\u0605\u061c\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufeff]")
LETTER_OR_DIGIT = re.compile(r"[^\W_]")
LETTER = re.compile(r"[^\W\d_]")
WORD = re.compile(r"[^\W\d_]+")
DENSE = re.compile("[\u2e80-\U0010ffff]")
HAN = re.compile("[\u3400-\u9fff]")
CYRILLIC = re.compile("[\u0400-\u04ff]")
FORMULA = re.compile(r"\\[a-zA-Z]+|\$[^$]*\$")
TOKEN = re.compile(r"\w+")
LEAD = re.compile(r"^\W*(?:question|frage|pregunta|pergunta|вопрос|q)\s*[:：]")
WORKED = re.compile(r"=\s*[-+]?\d")  # something is worked out


class Rules:
    """The rules on one pair; built once in each worker."""

    def __init__(self) -> None:
        self.words = _weights()
        self.known: dict[str, str] = {}
        self.bared: dict[str, tuple[list[str], Counter]] = {}

    def leaves(self, x: object) -> list[str]:
        if isinstance(x, dict):
            return [t for v in x.values() for t in self.leaves(v)]
        if isinstance(x, list):
            return [t for v in x for t in self.leaves(v)]
        return [] if x is None else [str(x)]

    def content(self, text: str) -> tuple[list[str], bool]:
        """The texts of a value (leaves of JSON, else itself), and whether it is JSON that doesn't end."""
        s = text.strip()
        if s.startswith("```"):
            body = re.sub(r"^```[a-z]*\s*", "", s)
            closed = body.rstrip().endswith("```")
            s = re.sub(r"\s*```$", "", body.rstrip()).strip()
            if not closed and s and s[0] not in "{[":
                return [s], False
        if s[:1] in "{[" and s[:1]:
            try:
                return self.leaves(json.loads(s, strict=False)), False
            except (ValueError, RecursionError):
                pass
            if re.match(r"[{\[]\s*(?:[\"{\[]|$)", s):
                try:
                    json.JSONDecoder(strict=False).raw_decode(s)
                except (ValueError, RecursionError):
                    return [s], True
        return [text], False

    def empty(self, text: str | None, parsed: tuple[list[str], bool] | None = None) -> bool:
        """Null, blank, a placeholder or a shell without content. parsed: content() of the text, if it is known."""
        if text is None:
            return True
        if len(text) > 40 and text[0].isalpha() and text[0].isascii():
            return False
        s = INVISIBLE.sub("", text).strip()
        if not s or (len(s) <= 40 and s.lower().strip("\"'`*_ ") in PLACEHOLDERS) or not LETTER_OR_DIGIT.search(s):
            return True
        if s[0] in "{[`<":
            if s[0] in "`<" and not re.sub(r"<[^<>]*>|```[a-z]*", "", s).strip():
                return True
            texts, open_json = parsed or self.content(text)
            if not open_json and s[0] != "<" and texts != [text]:
                return all(self.empty(t) for t in texts)
        return False

    def language(self, text: str) -> str:
        """The language of prose; empty if it can't be told."""
        if "\\" in text or "$" in text:
            text = FORMULA.sub(" ", text)
        if not text.isascii():
            zh, ru = len(HAN.findall(text)), len(CYRILLIC.findall(text))
            if zh or ru:
                other = len(LETTER.findall(text)) - zh - ru
                if zh * 3 > other:
                    return "zh"
                if ru > other:
                    return "ru"
        score: dict[str, float] = {}
        if not text.isascii():
            low = text.lower()
            for lang, letters in OWN_LETTERS.items():
                if n := sum(c in low for c in letters):
                    score[lang] = float(n)
        known = self.words
        for w in set(WORD.findall(text.lower())):  # a word said over and over is one sign of its language
            if w in known:
                for lang, x in known[w]:
                    score[lang] = score.get(lang, 0.0) + x
        if not score:
            return ""
        order = sorted(score.items(), key=lambda x: -x[1])
        if len(order) > 1 and order[1][1] > order[0][1] * 0.75:
            return ""
        return order[0][0] if order[0][1] >= 0.5 else ""

    def question_language(self, question: str) -> str:
        if question not in self.known:
            if len(self.known) > 50_000:
                self.known.clear()
            self.known[question] = self.language(question)
        return self.known[question]

    @staticmethod
    def bare(s: str) -> list[str]:
        return TOKEN.findall(LEAD.sub("", s.lower().replace("’", "'")))

    def asked(self, text: str) -> tuple[list[str], Counter]:
        """The words of a question or of options, with their numbers; many responses have the same."""
        got = self.bared.get(text)
        if got is None:
            if len(self.bared) > 50_000:
                self.bared.clear()
            q = self.bare(text)
            got = self.bared[text] = q, Counter(q)
        return got

    def copied(self, question: str | None, options: str | None, texts: list[str]) -> bool:
        """The words of the response are those of the question, but for a few left out or put in, and there is no answer."""
        size = sum(map(len, texts))
        if not question or size > 6 * len(question) + 2 * len(options or "") + 100 or 3 * size < len(question):
            return False
        text = " ".join(texts)
        if has_answer(text) and not has_answer(question):
            return False
        dense = not question.isascii() and bool(DENSE.search(question))
        q, asked = self.asked(question)
        if len(q) < 4 and not (len(question) >= 12 and dense):
            return False
        if dense:  # no spaces between words
            q = [c for c in question if c.isalnum()]
            asked = Counter(q)
            r = [c for t in texts for c in re.sub(r"^\W*问题[:：]", "", t) if c.isalnum()]
        else:
            r = [w for t in texts for w in self.bare(t)]
        if len(r) < 0.6 * len(q) or len(r) > 3.5 * len(q) + len((options or "").split()) + 4:
            return False
        offered = self.asked(options)[1] if options else {}
        if sum(w in asked or w in offered for w in r) < 0.88 * len(r):  # too many words of its own, however often each may occur
            return False
        have = Counter(r)
        times = max(1, round(len(r) / len(q)))
        allowed = Counter({w: n * times for w, n in asked.items()}) + Counter(offered)
        common = sum((have & allowed).values())
        covered = sum((have & asked).values())
        return common >= 0.88 * len(r) and covered >= 0.7 * len(q)

    @staticmethod
    def refusal(texts: list[str]) -> bool:
        """Declines, at any length, and neither announces an answer nor works anything out."""
        text = " ".join(t.strip() for t in texts).replace("’", "'")
        if WORKED.search(text):
            return False
        low = text.lower()
        if has_answer(low):
            return False
        for cue in REFUSAL_CUES:
            if cue in low:
                return bool(REFUSAL.search(low))
        return False

    @staticmethod
    def open_end(text: str, field: str) -> bool:
        """The value stops without an end: no final mark, no announced answer. Shorter ones than a phrase are taken for bare answers."""
        s = text.rstrip()
        if s.count("{") > s.count("}") or re.search(r"\\[a-zA-Z]*$", s):
            return True
        if field == "gold_ans":
            if s.count("(") > s.count(")"):
                return True
            return len(re.findall(r"[^\W\d_]{2,}", s)) >= 3 and not re.search(r"[.!?。！？:;)\]}\"'”»]$", s)
        if ANSWER_END.search(s[s.rfind("\n") + 1 :]):
            return False
        if re.search(r"[.!?。！？]$", s) or (re.search(r"[”»\])}\"'`]$|\S\*\*$", s) and (has_answer(s) or len(s) < 60)):
            return False
        return len(s) >= 25 or len(re.findall(r"[^\W\d_]+", s)) >= 4

    def judge(self, field: str, question: str | None, options: str | None, value: str | None) -> tuple[str | None, str | None]:
        """(defect, evidence) of a pair by itself; the defect "open" waits for evidence from other values, its second member is the defect
        that holds if there is none."""
        if value is None:
            return "empty", None
        texts, open_json = parsed = self.content(value)
        if self.empty(value, parsed):
            return "empty", None
        if open_json:
            return "truncated", "structure"
        texts = [t for t in texts if t and t.strip()]
        if self.refusal(texts):
            return "refusal", None
        if self.copied(question, options, texts):
            return "copied", None
        prose = texts == [value] or len(texts) == 1 and value.strip()[:1] not in "{["
        text = " ".join(texts)
        asked = self.question_language(question) if question else ""
        spoken = self.language(text) if asked and len(text) > 4 else ""
        other = "language" if asked and spoken and asked != spoken else None
        if field == "gold_ans" and other and value.count("(") <= value.count(")"):
            return "language", None
        if CUT_MARK.search(value.rstrip()[-100:]):  # a mark is shorter than that
            return "truncated", "mark"
        if prose and self.open_end(value, field):
            # gold answers are phrases without copies elsewhere: their own end decides
            return ("truncated", "end") if field == "gold_ans" else ("open", other)
        return other, None


# Where a text is cut into sentences, and a sentence into clauses: at a space after a mark, or at a sign of its own.
SENTENCE_ENDS, CLAUSE_ENDS, OWN_ENDS, DIGITS = '.!?"', ",:;", "\n。！？", "0123456789"
CUT, SUB = "\x01", "\x02"
LEAST_CLAUSE = 12  # signs; shorter clauses begin too many others


def marked(value: Column) -> Column:
    """The value without digits, with a sign of its own where sentences and clauses end."""
    v = F.translate(value, OWN_ENDS + DIGITS, CUT * len(OWN_ENDS))
    for ends, sign in ((SENTENCE_ENDS, CUT), (CLAUSE_ENDS, SUB)):
        for x in ends:
            v = F.replace(v, F.lit(x + " "), F.lit(x + sign))
    return v


def tails(value: str) -> tuple[str, str | None]:
    """The unfinished last sentence of a value and its last clause (null if that is short or the whole), both without digits."""
    v = value.strip(" \t\r\n").translate(str.maketrans(dict.fromkeys(OWN_ENDS, CUT) | dict.fromkeys(DIGITS)))
    for ends, sign in ((SENTENCE_ENDS, CUT), (CLAUSE_ENDS, SUB)):
        for x in ends:
            v = v.replace(x + " ", x + sign)
    last = v.rpartition(CUT)[2]
    s, c = last.replace(SUB, " "), last.rpartition(SUB)[2]
    return s, c if LEAST_CLAUSE <= len(c) < len(s) else None


JUDGED = "tbl string, row_id long, field string, source string, defect string, evidence string, tail string, clause string, n_chars int, n_bytes int"


def pair(tbl: str, row_id: str, field: str, value: str, *, question: str = "question", options: str = "options", source: str | None = None) -> list[Column]:
    src = F.col(source) if source else F.lit(None).cast("string")
    return [F.lit(tbl).alias("tbl"), F.col(row_id).cast("long").alias("row_id"), F.lit(field).alias("field"), src.alias("source"), F.col(question).alias("question"), F.col(options).alias("options"), F.col(value).alias("value")]


# a number, letter, truth value, root or fraction: never a defect, and not worth a trip to Python
PLAIN = r"^(?:[-+]?[0-9][0-9.,/]*|[A-Ea-e]|true|false|yes|no|\\sqrt\{[0-9]+\}|-?\\d?frac\{[0-9]+\}\{[0-9]+\})$"


def judged(pairs: DataFrame) -> DataFrame:
    """The pairs with a defect of their own or an open end; each row for itself, so that nothing is shuffled (but a table of fewer splits than cores)."""

    def classify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rules = Rules()
        names = [c.split()[0] for c in JUDGED.split(", ")]
        for pdf in batches:
            rows = []
            for t, i, f, src, q, o, v in zip(*(pdf[c] for c in ("tbl", "row_id", "field", "source", "question", "options", "value")), strict=True):
                defect, evidence = rules.judge(f, q, o, v)
                if defect == "open":
                    rows.append((t, i, f, src, defect, evidence, *tails(v), len(v), len(v.encode("utf-8", "replace"))))
                elif defect:
                    rows.append((t, i, f, src, defect, evidence, None, None, 0, 0))
            if rows:
                yield pd.DataFrame(rows, columns=names)

    return widened(pairs.where(F.col("value").isNull() | ~F.col("value").rlike(PLAIN))).mapInPandas(classify, JUDGED)


def sentences(values: DataFrame) -> DataFrame:
    """(text): the distinct finished sentences and clauses of all values, without digits. Distinct before the shuffle, too."""
    v = marked(F.rtrim("value"))
    parts = values.where("value is not null").select(F.split(v, CUT).alias("p"), F.right(v, F.lit(1)).isin(*".!?", CUT).alias("whole"))
    done = F.when(F.col("whole"), F.col("p")).otherwise(F.slice("p", F.lit(1), F.size("p") - 1))
    sentence = F.transform("p", lambda x: F.replace(x, F.lit(SUB), F.lit(" ")))
    # a list of one clause is the sentence itself
    clauses = F.flatten(F.transform(F.filter("p", lambda x: F.contains(x, F.lit(SUB))), lambda x: F.split(x, SUB)))
    texts = F.concat(sentence, F.filter(clauses, lambda c: F.length(c) >= LEAST_CLAUSE))
    return parts.select(done.alias("p")).select(F.explode(texts).alias("text")).where("text <> ''").distinct()


def shortened(unfinished: DataFrame, finished: DataFrame) -> DataFrame:
    """(text): the unfinished texts that are strict prefixes of a finished one.

    Both: text, each distinct. They are range-partitioned and sorted together; a text is a strict prefix of some finished one exactly if
    the next longer finished one in this order begins with it. Where that stands in a later task it is found from one row for each task,
    the first finished text of it. No text occurs twice, so no beginning and no repeat makes a hot task.
    """
    both = finished.select("text", F.lit(True).alias("done")).unionByName(unfinished.select("text", F.lit(False).alias("done")))
    # written first: a range shuffle reads its input twice
    ordered = written(both, "sentences").repartitionByRange("text").sortWithinPartitions("text", "done").withColumn("part", F.spark_partition_id())

    def neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[str] = []
        seen = False
        part = -1
        for pdf in batches:
            rows = []
            for p, text, done in zip(pdf["part"], pdf["text"], pdf["done"], strict=True):
                part = p
                if not done:
                    waiting.append(text)
                    continue
                if not seen:
                    rows.append(("first", p, text))
                    seen = True
                # an unfinished text equal to a finished one waits for the next
                rows += [("prefix", p, w) for w in waiting if w != text and text.startswith(w)]
                waiting = [w for w in waiting if w == text]
            if rows:
                yield pd.DataFrame(rows, columns=["kind", "part", "text"])
        if waiting:
            yield pd.DataFrame([("last", part, w) for w in waiting], columns=["kind", "part", "text"])

    got = written(ordered.mapInPandas(neighbours, "kind string, part int, text string"), "neighbours")
    firsts = got.where("kind = 'first'").agg(F.array_sort(F.collect_list(F.struct("part", "text"))).alias("_firsts"))
    last = got.where("kind = 'last'").crossJoin(F.broadcast(firsts))
    later = F.get(F.filter("_firsts", lambda x: (x["part"] > F.col("part")) & (x["text"] != F.col("text"))), F.lit(0))["text"]
    return got.where("kind = 'prefix'").select("text").unionByName(last.where(F.startswith(later, F.col("text"))).select("text"))


EVIDENCE = ("structure", "mark", "end", "prefix", "limit")


def defects(pairs: DataFrame, sizes: DataFrame | None = None, without: tuple[str, ...] = ()) -> DataFrame:
    """(tbl, row_id, field, defect, evidence), one row for each defective pair; repeated rows count once.

    pairs: all values with their questions. sizes: (source, value) to learn limits from. evidence: what speaks for a truncation (array of
    structure, mark, end, prefix, limit), null for other defects. without: kinds of evidence to leave out, to see what each adds.
    A null, blank or shell value is `empty`; a null question rules out `copied` and `language`.
    """
    j = written(judged(pairs), "judged")
    ends = j.where("defect = 'open'")
    own = j.where("defect <> 'open'").select("tbl", "row_id", "field", "defect", F.when(F.col("evidence").isNotNull(), F.array("evidence")).alias("evidence"))
    unfinished = ends.select(F.explode(F.filter(F.array("tail", "clause"), lambda x: x.isNotNull() & (x != ""))).alias("text")).distinct()
    short = shortened(unfinished, sentences(pairs.where("field <> 'gold_ans'"))) if "prefix" not in without else unfinished.limit(0)
    hit = short.select(F.col("text").alias("_text")).distinct()
    e = ends.join(hit, F.col("tail") == F.col("_text"), "left").withColumnRenamed("_text", "_tail").join(hit, F.col("clause") == F.col("_text"), "left").withColumnRenamed("_text", "_clause")
    if sizes is None or "limit" in without:
        e = e.withColumn("_limit", F.lit(False))
    else:
        lim = limits(sizes)
        # a text cut at a number of bytes ends up to three bytes before it, where its last sign had more
        reach = F.explode(F.when(F.col("unit") == "bytes", F.sequence(F.col("size_limit") - 3, F.col("size_limit"))).otherwise(F.array("size_limit")))
        at = lim.select(F.coalesce("source", F.lit("")).alias("_s"), "unit", reach.alias("_size")).distinct()
        places = F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("n_chars").alias("_size")), F.struct(F.lit("bytes").alias("unit"), F.col("n_bytes").alias("_size"))))
        on = ends.select("tbl", "row_id", "field", F.coalesce("source", F.lit("")).alias("_s"), places.alias("x")).select("tbl", "row_id", "field", "_s", "x.*").join(at, ["_s", "unit", "_size"])
        e = e.join(on.select("tbl", "row_id", "field", F.lit(True).alias("_limit")).distinct(), ["tbl", "row_id", "field"], "left")
    prefix = F.col("_tail").isNotNull() | F.col("_clause").isNotNull()
    evidence = F.array_compact(F.array(F.when(prefix, "prefix"), F.when(F.col("_limit"), "limit")))
    e = e.select("tbl", "row_id", "field", F.when(F.size(evidence) > 0, "truncated").otherwise(F.col("evidence")).alias("defect"), F.when(F.size(evidence) > 0, evidence).alias("evidence"))
    return own.unionByName(e.where("defect is not null")).distinct()


def prediction_pairs(predictions: DataFrame, *fields: str) -> DataFrame:
    out = None
    for f in fields:
        p = predictions.select(*pair("predictions", "pred_id", f, f, source="source"))
        out = p if out is None else out.unionByName(p)
    return out


def response_sizes(predictions: DataFrame) -> DataFrame:
    return predictions.select("source", F.col("model_response").alias("value"))


def found(predictions: DataFrame, teacher: DataFrame) -> DataFrame:
    """p3_found over both tables."""
    tp = teacher.select(*pair("teacher", "teacher_id", "response_rationale", "response_rationale"))
    pp = prediction_pairs(predictions, "model_response", "gold_ans")
    return defects(pp.unionByName(tp), response_sizes(predictions)).select("tbl", "row_id", "field", "defect")


def truncations(predictions: DataFrame, without: tuple[str, ...] = ()) -> DataFrame:
    """(pred_id, evidence) of predictions whose response was cut off."""
    d = defects(prediction_pairs(predictions, "model_response"), response_sizes(predictions), without)
    return d.where("defect = 'truncated'").select(F.col("row_id").alias("pred_id"), "evidence")


def truncated(predictions: DataFrame) -> DataFrame:
    """p5_found: predictions whose response was cut off."""
    return truncations(predictions).select("pred_id").distinct()


def by_evidence(predictions: DataFrame) -> DataFrame:
    """(evidence, n, n_alone): how many truncations each kind of evidence speaks for, and how many would be missed without it."""
    e = truncations(predictions).select(F.explode("evidence").alias("evidence"), (F.size("evidence") == 1).alias("alone"))
    return e.groupBy("evidence").agg(F.count("*").alias("n"), F.count_if("alone").alias("n_alone"))


def limits(values: DataFrame, least: int = 100, times: float = 8.0, window: int = 20, at_least: int = 5) -> DataFrame:
    """(source, unit, size_limit, n_at_limit): lengths, in chars or bytes, at which a source has far more values than around them.

    values: source, value. A limit is a length of at least `least` that holds at least `at_least` values and `times` as many
    as the mean of the `window` lengths on either side. Counts are summed before the shuffle; a source has few lengths.
    """
    size = F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.length("value").alias("len")), F.struct(F.lit("bytes").alias("unit"), F.octet_length("value").alias("len"))))
    n = values.select("source", size.alias("x")).select("source", "x.*").where(F.col("len") >= least).groupBy("source", "unit", "len").agg(F.count("*").alias("n"))
    w = Window.partitionBy("source", "unit").orderBy("len").rangeBetween(-window, window)
    around = (F.sum("n").over(w) - F.col("n")) / (2 * window)
    many = (F.col("n") >= at_least) & (F.col("n") >= times * F.greatest(F.col("around"), F.lit(0.2)))
    return n.withColumn("around", around).where(many).select("source", "unit", F.col("len").alias("size_limit"), F.col("n").alias("n_at_limit"))


def by_source(predictions: DataFrame) -> DataFrame:
    """How often each source truncates, and its most used size limit: (source, n, n_truncated, share, size_limit). A null source is one, too."""
    once = predictions.groupBy("pred_id").agg(F.min("source").alias("source"))
    rows = once.join(truncated(predictions).withColumn("cut", F.lit(1)), "pred_id", "left")
    n = rows.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.coalesce("cut", F.lit(0))).alias("n_truncated"))
    lim = limits(response_sizes(predictions)).groupBy("source").agg(F.max_by("size_limit", F.struct("n_at_limit", "unit", "size_limit")).alias("size_limit"))
    return n.join(lim, n["source"].eqNullSafe(lim["source"]), "left").select(n["source"], "n", "n_truncated", (F.col("n_truncated") / F.col("n")).alias("share"), "size_limit")
