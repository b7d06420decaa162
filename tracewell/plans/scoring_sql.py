"""The answer cascade stated in SQL, as a second implementation that the catalogue's queries are compared with.

It is staged by common table expressions, one step of the rules in each, over all rows of a table. A raw answer is a struct (k, t), its kind
and text; a normalised one a struct (k, v, n): kind b, n or s, the text, and the number (0 or 1 for a truth value).
"""

from __future__ import annotations

from tracewell.functions.answers import BOXED, CHOICE_CUES, CUE, NUMBER, NUMBER_CUES, OPTION_LINE

SPACE = r"[\s\x0b\x1c-\x1f\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# letters beyond ASCII: the regex engine here knows word bounds of ASCII only, so they are made ASCII letters first
LETTERS = r"[\x{00aa}\x{00b5}\x{00ba}\x{00c0}-\x{00d6}\x{00d8}-\x{00f6}\x{00f8}-\x{02c1}\x{0370}-\x{0373}\x{0376}-\x{037d}\x{0386}-\x{0481}\x{048a}-\x{0559}\x{0560}-\x{0588}\x{05d0}-\x{05ea}\x{0620}-\x{064a}\x{0904}-\x{0939}\x{1e00}-\x{1fff}\x{3041}-\x{3096}\x{30a1}-\x{30fa}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{ac00}-\x{d7a3}]"
FLOAT = r"(?i)[+-]?(?:\d+(?:_\d+)*(?:\.(?:\d+(?:_\d+)*)?)?(?:e[+-]?\d+)?|\.\d+(?:_\d+)*(?:e[+-]?\d+)?|inf(?:inity)?|nan)"
FENCE = r"(?is)(?:<|⟨)\s*answer\s*(?:>|⟩)(.*?)(?:<|⟨)\s*/\s*answer\s*(?:>|⟩)"
FENCE_END = r"(?i)(?:<|⟨)\s*/\s*answer\s*(?:>|⟩)"
KEY = r"""(?i)(?:^|[\s{,])(?:"ans"|ans)\s*:\s*"""
KEY_VALUE = KEY + r"""(?:"([^"\\]*(?:\\.[^"\\]*)*)(?:"|\\?$)|'([^'\\]*(?:\\.[^'\\]*)*)(?:'|\\?$)|([^"'\s,}][^,}\n\r]*))"""


def q(pattern: str) -> str:
    """A pattern as an SQL text."""
    return "'" + pattern.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def plain(x: str) -> str:
    return f"regexp_replace({x}, '{LETTERS}', 'x', 'g')"


def bare(x: str) -> str:
    """Without quotes around it."""
    return f"""regexp_replace({strip(x)}, '^["'']+|["'']+$', '', 'g')"""


def group(x: str, pattern: str, i: int = 1) -> str:
    """A group of the first match, null if there is none or it is empty."""
    return f"nullif(regexp_extract({x}, {q(pattern)}, {i}), '')"


def raw(x: str, kind: str = "s") -> str:
    return f"case when {x} is not null then {{'k': '{kind}', 't': {x}}} end"


def digit(x: str) -> str:
    return f"chr(64 + cast({x} as integer))"


def choice_of_number(a: str) -> str:
    n = f"try_cast({a}.t as double)"
    t = bare(f"{a}.t")
    return f"case when {a}.k = 's' then case when regexp_full_match({t}, '[1-5](?:\\.0+)?') then {digit(f'{t}[1]')} end when {a}.k = 'n' and {n} in (1, 2, 3, 4, 5) then {digit(n)} end"


def choice_in_text(x: str) -> str:
    p = plain(x)
    return "coalesce(" + ", ".join([f"upper({group(p, c)})" for c in CHOICE_CUES] + [digit(group(p, c)) for c in NUMBER_CUES]) + ")"


def first_choice(x: str) -> str:
    return f"upper({group(plain(bare(x)), '(?i)' + chr(92) + 'b([A-E])' + chr(92) + 'b')})"


def truth(x: str) -> str:
    w = f"lower(regexp_replace({bare(x)}, '^[^A-Za-z]+|[^A-Za-z]+$', '', 'g'))"
    return f"case when {w} in ('true', 'yes') then 'true' when {w} in ('false', 'no') then 'false' end"


def last_number(x: str) -> str:
    return f"nullif(regexp_extract_all({x}, {q(NUMBER)})[-1], '')"


def as_choice(a: str) -> str:
    """A raw answer as the letter it means in a choice task; needs the column ct."""
    s = f"(case when {a}.k = 's' then {a}.t end)"
    x = f"coalesce({choice_of_number(a)}, {choice_in_text(s)}, {first_choice(s)})"
    return f"case when {a} is null then null when ct and {x} is not null then {{'k': 's', 't': {x}}} else {a} end"


def as_float(t: str) -> str:
    return f"(case when regexp_full_match({t}, {q(FLOAT)}) then try_cast(replace({t}, '_', '') as double) end)"


def fraction_columns(s: str, of: str) -> str:
    """Stages {of}_b and {of}_f that take the stripped text column s of table `of` to a fraction: column {s}_f."""
    c = f"{s}_b"
    pair = lambda a, b: f"case when {as_float(b)} <> 0 and isfinite({as_float(a)} / {as_float(b)}) then {as_float(a)} / {as_float(b)} end"
    tight = f"replace({c}, ' ', '')"
    braced, short, slash = r"\\frac\s*\{([^{}]+)\}\s*\{([^{}]+)\}", r"\\frac([+-]?\d+(?:\.\d+)?)([+-]?\d+(?:\.\d+)?)", r"([+-]?\d+(?:\.\d+)?)\s*/\s*([+-]?\d+(?:\.\d+)?)"
    two = lambda t, p: pair(*[strip(f"replace(regexp_extract({t}, {q('^' + p + '$')}, {i}), ',', '')") for i in (1, 2)])
    return f"""
{of}_b as (select *, {strip(f"regexp_replace(case when regexp_matches({s}, '/|{chr(92) * 2}frac') then replace({strip(s)}, '−', '-') end, '^[+-]', '')")} as {c}, starts_with(replace({strip(s)}, '−', '-'), '-') as {s}_m from {of}),
{of}_f as (select *, case when {s}_m then -1.0 else 1.0 end * case when regexp_full_match({c}, {q(braced)}) then {two(c, braced)} when regexp_full_match({tight}, {q(short)}) then {two(tight, short)} when regexp_full_match({c}, {q(slash)}) then {two(c, slash)} end as {s}_f from {of}_b)"""


def number_columns(x: str, of: str) -> str:
    """Stages that take the text column `x` of table `of` to a number: the last is table {of}_5, with column {x}_n."""
    s = f"{x}_s"
    return f"""
{of}_1 as (select *, case when contains({x}, '####') then {strip(f"string_split({x}, '####')[-1]")} else {strip(x)} end as {x}_h from {of}),
{of}_2 as (select *, regexp_replace({x}_h, '[.,;:]+$', '') as {s} from {of}_1), {fraction_columns(s, f"{of}_2")},
{of}_5 as (select *, coalesce({s}_f, {as_float(strip(s))}, try_cast({group(f"replace({s}, ',', '')", NUMBER, 0)} as double)) as {x}_n from {of}_2_f)"""


def teacher_columns(x: str, of: str) -> str:
    """Stages that take the text column `x` of table `of` to the teacher's reading of it: table {of}_t, with column {x}_v (k, n, s)."""
    s, t = f"{x}_c", strip(x)
    plain_ = f"regexp_replace(regexp_replace(replace(replace({t}, ',', ''), '−', '-'), '^[$₹€£]+|[$₹€£]+$', '', 'g'), '%+$', '')"
    only = r"^[^\d\-+]*([\-+]?\d+(?:\.\d+)?)[^\d]*$"
    n = f"coalesce({s}_f, {as_float(strip(s))}, try_cast({group(s, only)} as double))"
    return f"""
{of}_c as (select *, {plain_} as {s} from {of}), {fraction_columns(s, f"{of}_c")},
{of}_t as (select *, case when {x} is null then null when lower({t}) in ('true', 'false') then {{'k': 'b', 'n': case when lower({t}) = 'true' then 1.0 else 0.0 end, 's': null::varchar}}
  when {n} is not null then {{'k': 'n', 'n': {n}, 's': null::varchar}} else {{'k': 's', 'n': null::double, 's': {x}}} end as {x}_v from {of}_c_f)"""


def teacher_same(g: str, p: str, low: str) -> str:
    """Whether two teacher's readings are equal; low: the lower-case texts' equality."""
    return f"coalesce(case when {g}.k = 'b' and {p}.k = 'b' then {g}.n = {p}.n when {g}.k = 'n' and {p}.k = 'n' then abs({g}.n - {p}.n) < 1e-9 else {low} end, false)"


def normal(a: str, t: str, n: str) -> str:
    """The normalised answer of raw answer a, whose stripped text is t and whose text's number is n."""
    low = f"lower({t})"
    num = f"case when {a}.k = 'n' then try_cast({t} as double) when {a}.k = 's' then {n} end"
    word = lambda w: f"{{'k': 'b', 'v': {w}, 'n': case when {w} = 'true' then 1.0 else 0.0 end}}"
    return f"""case when {a} is null then null when {a}.k = 'b' then {word(low)}
  when {a}.k = 's' and {low} in ('yes', 'true') then {word("'true'")} when {a}.k = 's' and {low} in ('no', 'false') then {word("'false'")}
  when {a}.k = 's' and regexp_full_match({t}, '[A-Ea-e]') then {{'k': 's', 'v': upper({t}), 'n': null::double}}
  when ({num}) is not null then {{'k': 'n', 'v': null::varchar, 'n': {num}}} else {{'k': 's', 'v': {low}, 'n': null::double}} end"""


def same(g: str, p: str) -> str:
    """Whether two normalised answers match; two missing ones do."""
    near = f"abs({g}.n - {p}.n) <= greatest(greatest(abs({g}.n), abs({p}.n)) * 1e-6, 1e-6)"
    close = f"(not isnan({g}.n) and not isnan({p}.n) and ({g}.n = {p}.n or (isfinite({g}.n) and isfinite({p}.n) and {near})))"
    return f"""coalesce(case when {g} is null or {p} is null then {g} is null and {p} is null when {g}.k = 'b' and {p}.k = 'b' then {g}.v = {p}.v
  when {g}.k = 's' and regexp_full_match({g}.v, '[A-Ea-e]') then {p}.k = 's' and {g}.v = upper({p}.v) when {g}.k in ('b', 'n') and {p}.k in ('b', 'n') then {close}
  else {g}.k = {p}.k and {g}.v is not distinct from {p}.v end, false)"""


def label(n: str) -> str:
    return f"case when {n} is null then '__MISSING__' when {n}.k = 'n' then case when isnan({n}.n) then 'nan' when {n}.n = 0 then '0' else format('{{:.12g}}', {n}.n) end else {n}.v end"


def json_answer(r: str, of: str) -> str:
    """Stages {of}_t to {of}_j: column rj, the answer of the JSON, or of the JSON-like text, in the text column r of table `of`."""
    back = f"""replace({r}, '\\"', '"')"""
    braces = lambda x: f"case when instr({x}, '{{') > 0 and length({x}) - instr(reverse({x}), '}}') + 1 > instr({x}, '{{') and contains({x}, '}}') then substr({x}, instr({x}, '{{'), length({x}) - instr(reverse({x}), '}}') + 2 - instr({x}, '{{')) end"
    undone = f"""(case when contains({r}, '\\"') then {back} end)"""
    inner = f"""case when starts_with({strip(r)}, '"') and ends_with({strip(r)}, '"') and json_valid({strip(r)}) then ({strip(r)}::json)->>'$' end"""
    member = f"case when starts_with({strip('x')}, '{{') and ends_with({strip('x')}, '}}') and json_valid({strip('x')}) then json_extract({strip('x')}::json, '$.ans') end"
    kind = "case json_type({j}) when 'VARCHAR' then 's' when 'BOOLEAN' then 'b' when 'OBJECT' then 'j' when 'ARRAY' then 'j' else 'n' end"
    undo = lambda v: f"regexp_replace({v}, '(?s)\\\\(.)', '\\1', 'g')"
    part = lambda i: f"list_transform(regexp_extract_all(x, {q(KEY_VALUE)}, {i}), lambda v: coalesce(v, ''))"
    each = lambda: f"list_filter(list_transform(range(1, len({part(1)}) + 1), lambda i: {strip(undo(part(1) + '[i]'))} || {strip(undo(part(2) + '[i]'))} || {bare(part(3) + '[i]')}), lambda v: v <> '')[1]"
    return f"""
{of}_t as (select *, [{r}, {inner}, {braces(r)}, {undone}, {braces(undone)}] as tries from {of}),
{of}_u as (select *, list_filter(list_transform(tries, lambda x: {member}), lambda j: j is not null and j::varchar <> 'null')[1] as j, list_filter(list_transform([{r}, {undone}], lambda x: case when regexp_matches(x, {q(KEY)}) then {each()} end), lambda v: v is not null)[1] as fa from {of}_t),
{of}_j as (select *, case when j is not null then {{'k': {kind.format(j='j')}, 't': case when json_type(j) in ('OBJECT', 'ARRAY') then j::varchar else j->>'$' end}} when fa is not null then {{'k': 's', 't': fa}} end as rj from {of}_u)"""


def cascade(source: str, answers: bool = True) -> str:
    """Stages from table `source` (gold_ans, model_response, options, and model_ans if answers) to table k with g, m (normalised gold and
    prediction) and ok."""
    tag_t = f"(case when regexp_matches(r, {q(FENCE_END)}) and regexp_matches(r, {q(FENCE)}) then {strip(f'regexp_extract(r, {q(FENCE)}, 1)')} end)"
    final = f"""case when regexp_matches(r, {q(NUMBER)}) then coalesce({last_number(f'regexp_extract(r, {q(BOXED)}, 1)')}, {last_number(f'regexp_extract(r, {q(CUE)}, 1)')}, case when not regexp_matches({plain('r')}, '(?i)\\b(true|false|yes|no)\\b') then {last_number('r')} end) end"""
    in_tag = f"case when tag is not null then coalesce({raw(first_choice('tag'))}, case when ct then {raw(choice_of_number('{0}'.format('tagged')))} end, {raw(truth('tag'), 'b')}, tagged) end"
    number = f"case when ct then {raw(choice_of_number('fin'))} else fin end"
    cue_truth = truth(group("r", CUE))
    first = as_choice("ma") if answers else "null"
    keys = f"list_transform(regexp_extract_all(options, {q(OPTION_LINE)}, 1), lambda x: upper(x))"
    values = f"list_transform(regexp_extract_all(options, {q(OPTION_LINE)}, 2), lambda x: {strip('x')})"
    return f"""
x0 as (select *, case when {strip('gold_ans')} <> '' then gold_ans end as gt, model_response as r, {raw('model_ans') if answers else 'null'} as ma, {keys} as oks, {values} as ovs from {source}),
x1 as (select *, {raw('gt')} as gold, coalesce(regexp_full_match({strip('gt')}, '[A-Ea-e]'), false) as letter from x0),
x2 as (select *, letter or coalesce(len(oks) > 0, false) as ct from x1), {json_answer('r', 'x2')},
x3 as (select *, {tag_t} as tag, {raw('(' + final + ')')} as fin, {cue_truth} as cue from x2_j),
x4 as (select *, {raw('tag')} as tagged from x3),
x5 as (select *, coalesce({first}, {as_choice('rj')}, {in_tag}, {raw('cue', 'b')}, {number}) as pred, {strip('gt')} as gs from x4),
x6 as (select *, {strip('pred.t')} as ps from x5), {number_columns('gs', 'x6')}, {number_columns('ps', 'x6_5')},
x7 as (select *, {normal('gold', 'gs', 'gs_n')} as g, {normal('pred', 'ps', 'ps_n')} as p from x6_5_5),
o0 as (select row_number() over () as row_no, * from x7),
o1 as (select row_no, oks, p, unnest(oks) as ok_, unnest(ovs) as ov, generate_subscripts(oks, 1) as oi from o0 where letter and len(oks) > 0),
o2 as (select row_no, ok_, p, arg_max(ov, oi) as ov from o1 group by all),
o3 as (select *, {strip('ov')} as os from o2), {number_columns('os', 'o3')},
o4 as (select row_no, ok_, p, {normal(raw('ov'), 'os', 'os_n')} as o from o3_5),
o5 as (select row_no, min(ok_) as hit from o4 where {same('o', 'p')} group by row_no having count(*) = 1),
x8 as (select o0.*, coalesce({choice_of_number('pred')}, {choice_in_text("(case when pred.k = 's' then pred.t end)")}, o5.hit, {choice_in_text('r')}) as fix from o0 left join o5 using (row_no)),
x9 as (select *, case when letter and not coalesce(p.k = 's' and regexp_full_match(p.v, '[A-Ea-e]'), false) and fix is not null then {{'k': 's', 'v': fix, 'n': null::double}} else p end as m from x8),
k as (select *, g is not null and m is not null and {same('g', 'm')} as ok from x9)"""


def validity(source: str) -> str:
    """Stages from table `source` (gold_ans, model_response) to table k with rj, gold and ok: whether the answer of the JSON matches."""
    return f"""
y0 as (select *, case when {strip('gold_ans')} <> '' then gold_ans end as gt, model_response as r from {source}), {json_answer('r', 'y0')},
y1 as (select *, {raw('gt')} as gold, {strip('gt')} as gs, {strip('rj.t')} as ps from y0_j), {number_columns('gs', 'y1')}, {number_columns('ps', 'y1_5')},
y2 as (select *, {normal('gold', 'gs', 'gs_n')} as g, {normal('rj', 'ps', 'ps_n')} as p from y1_5_5),
k as (select *, {same('g', 'p')} as ok from y2)"""


def normalised(source: str, **columns: str) -> str:
    """Stages from table `source` to table k with the normal form of text columns: name -> text column."""
    out, at = "", source
    for name, text in columns.items():
        out += f"\n{name}0 as (select *, {strip(text)} as {name}_t from {at}), {number_columns(name + '_t', name + '0')},\n{name}9 as (select *, {normal(raw(text), name + '_t', name + '_t_n')} as {name} from {name}0_5),"
        at = name + "9"
    return out + f"\nk as (select * from {at})"
