"""DuckDB SQL for the quality rules: the base counts and the same minimum-covariance-determinant steps."""

from __future__ import annotations

from .quality_rules import ANY, FEATURES, LEAST_GROUP, PAIRS, RIDGE, SHARE, STEPS, SYMBOLS, TAIL, chi2_quantile, consistency

KEYS = "g_lang, g_source, start"
X = [f"x{i}" for i in range(FEATURES)]
SHAPE = ", ".join([KEYS, *[f"m{i}" for i in range(FEATURES)], *[f"l_{i}_{j}" for i, j in PAIRS]])

BASE = f"""
docs as (select doc_id, row_number() over () as r, coalesce(text, '') as text, coalesce('=' || lang, '') as g_lang, coalesce('=' || source, '') as g_source from documents),
split as (select r, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines from docs),
grams as (select r, i, array_to_string(w[i:i + 2], ' ') as g from (select r, w, unnest(range(1, len(w) - 1)) as i from split)),
twice as (select r, i from grams qualify count(*) over (partition by r, g) > 1),
repeats as (select r, count(*) as n from (select distinct r, i + j as p from twice, range(0, 3) t(j)) group by r),
counts as (select r, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars, cast(len(lines) as bigint) as n_lines,
    cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, cast(coalesce(n, 0) as bigint) as n_repeat_words from split left join repeats using (r)),
base as (select *, cast(length(text) - length(translate(text, '{SYMBOLS}', '')) as bigint) as n_symbols, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from docs join counts using (r)),
vectors as (select r, g_lang, g_source, ln(n_words) as x0, 2 * ln(word_chars / n_words) as x1, 4 * sqrt(n_symbols / word_chars) as x2, n_repeat_words / n_words + n_dup_lines / greatest(n_lines, 1) as x3 from base where not base_failed),
sizes as (select *, sum(n) over (partition by g_lang) as n_lang, sum(n) over () as total from (select g_lang, g_source, count(*) as n from vectors group by all)),
uses as (select g_lang, g_source, case when n >= {LEAST_GROUP} or n_lang >= {LEAST_GROUP} then g_lang when total >= {LEAST_GROUP} then '{ANY}' end as use_lang,
    case when n >= {LEAST_GROUP} then g_source when n_lang >= {LEAST_GROUP} or total >= {LEAST_GROUP} then '{ANY}' end as use_source from sizes),
pools as (select distinct use_lang, use_source from uses where use_lang is not null),
fed as (select p.*, {', '.join(X)} from vectors v join pools p on p.use_lang = v.g_lang and p.use_source = v.g_source
    union all select p.*, {', '.join(X)} from vectors v join pools p on p.use_lang = v.g_lang and p.use_source = '{ANY}'
    union all select p.*, {', '.join(X)} from vectors v join pools p on p.use_lang = '{ANY}'),
starts as (select use_lang as g_lang, use_source as g_source, {', '.join(X)}, start from fed, (values (0), (1)) s(start))"""


def _factor(source: str, scale: float) -> str:
    """Shapes from the moments of some rows; later columns use earlier ones."""
    moments = ", ".join([*[f"avg({x}) as m{i}" for i, x in enumerate(X)], *[f"avg({X[i]} * {X[j]}) as s_{i}_{j}" for i, j in PAIRS]])
    out = [f"(s_{i}_{j} - m{i} * m{j}) * {scale!r} + {RIDGE if i == j else 0.0} as c_{i}_{j}" for i, j in PAIRS]
    for i, j in PAIRS:
        rest = " - ".join([f"c_{i}_{j}", *[f"l_{i}_{k} * l_{j}_{k}" for k in range(j)]])
        out.append(f"sqrt(greatest({rest}, 1e-12)) as l_{i}_{j}" if i == j else f"({rest}) / l_{j}_{j} as l_{i}_{j}")
    return f"select {SHAPE} from (select *, {', '.join(out)} from (select {KEYS}, {moments} from {source} group by all))"


def _distance(rows: str, shape: str) -> str:
    z = []
    for i in range(FEATURES):
        z.append(f"({' - '.join([f'x{i}', f'm{i}', *[f'l_{i}_{k} * z{k}' for k in range(i)]])}) / l_{i}_{i} as z{i}")
    return f"select *, {' + '.join(f'z{i} * z{i}' for i in range(FEATURES))} as d2 from (select {rows}.*, {', '.join(z)} from {rows} join {shape} using ({KEYS}))"


def _medians(source: str, value: str, name: str) -> str:
    bins = f"select {KEYS}, f, floor({value} * 256) as bin, count(*) as n from {source} group by all"
    run = f"select *, sum(n) over (partition by {KEYS}, f order by bin) as upto, sum(n) over (partition by {KEYS}, f) as total from ({bins})"
    return f"select {KEYS}, f, (min(bin) + 0.5) / 256 as {name} from ({run}) where upto * 2 >= total group by all"


def quality_sql() -> str:
    long = " union all ".join(f"select {KEYS}, {i} as f, x{i} as x from starts where start = 0" for i in range(FEATURES))
    first = ", ".join([*[f"max(q) filter (f = {i}) as m{i}" for i in range(FEATURES)], *[f"sqrt(pow(max(d) filter (f = {i}) * 1.4826, 2) + {RIDGE}) as l_{i}_{i}" if i == j else f"0.0 as l_{i}_{j}" for i, j in PAIRS]])
    steps = [
        f"long as ({long})",
        f"middle as ({_medians('long', 'x', 'q')})",
        f"away as (select {KEYS}, f, abs(x - q) as a from long join middle using ({KEYS}, f))",
        f"spread as ({_medians('away', 'a', 'd')})",
        f"robust as (select {SHAPE} from (select {KEYS}, {first} from middle join spread using ({KEYS}, f) group by {KEYS}))",
        "plain as (select * from starts where start = 1)",
        f"shape0 as (select * from robust union all {_factor('plain', 1.0)})",
    ]
    for s in range(STEPS):
        steps += [
            f"far{s} as (select *, floor(ln(d2 + 1e-9) * 64) as bin from ({_distance('starts', f'shape{s}')}))",
            f"run{s} as (select {KEYS}, bin, sum(count(*)) over (partition by {KEYS} order by bin) as upto, sum(count(*)) over (partition by {KEYS}) as total from far{s} group by {KEYS}, bin)",
            f"cut{s} as (select {KEYS}, min(bin) as cut from run{s} where upto >= ceil(total * {SHARE}) group by {KEYS})",
            f"near{s} as (select far{s}.* from far{s} join cut{s} using ({KEYS}) where bin <= cut)",
            f"shape{s + 1} as ({_factor(f'near{s}', consistency() if s == STEPS - 1 else 1.0)})",
        ]
    log_det = " + ".join(f"ln(l_{i}_{i})" for i in range(FEATURES))
    steps += [
        f"best as (select * from shape{STEPS} qualify row_number() over (partition by g_lang, g_source order by {log_det}, start) = 1)",
        f"mine as (select r, use_lang as g_lang, use_source as g_source, {', '.join(X)}, start from vectors v join uses using (g_lang, g_source) join (select g_lang as use_lang, g_source as use_source, start from best) b using (use_lang, use_source))",
        f"judged as ({_distance('mine', 'best')})",
    ]
    cutoff = chi2_quantile(1 - TAIL, FEATURES)
    return f"""with {BASE}, {", ".join(steps)}
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and coalesce(d2 <= {cutoff!r}, true) as kept from base left join judged using (r)"""
