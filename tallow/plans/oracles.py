"""DuckDB SQL for the registered queries."""

from __future__ import annotations

from ..functions.lexicon import FINDINGS, LANGUAGE_WORDS, OSTEOARTHRITIS, STRONG_WORDS, Cues
from ..operators.replies import DESCRIPTIONS
from ..operators.votes import mention_patterns
from . import views as V
from .weights import BIAS, DIM, GW, HEADS, PLANES, UW, VW

DOCS = "SELECT doc_id, lang, n_chars, text FROM documents"
GOLD = "SELECT doc_id, 'quality' AS col, quality::DOUBLE AS label FROM labels UNION ALL SELECT doc_id, 'toxic', toxic::DOUBLE FROM labels"


def _rule(chars: int, quiet: tuple[str, str], words: str) -> str:
    return f"SELECT doc_id, 'quality' AS col, CASE WHEN lang <> '{quiet[0]}' THEN (n_chars > {chars})::INT::DOUBLE END AS label FROM documents UNION ALL SELECT doc_id, 'toxic', CASE WHEN lang <> '{quiet[1]}' THEN regexp_matches(text, '{words}')::INT::DOUBLE END FROM documents"


A = _rule(400, ("fr", "de"), "idiot|moron|clown")
B = _rule(800, ("es", "en"), "idiot|scum|worthless")
JUDGED = f"SELECT a.doc_id, a.col, a.label, g.label AS gold, d.lang, d.text FROM ({A}) a LEFT JOIN ({GOLD}) g USING (doc_id, col) JOIN documents d USING (doc_id)"
ONE, TWO = "(n_chars % 101) / 101.0", "CASE WHEN lang <> 'fr' THEN (n_chars % 89) / 89.0 END"
SCORED = " UNION ALL ".join(f"SELECT doc_id, '{m}' AS model, '{c}' AS col, ({p})::DOUBLE AS p FROM documents" for m, p in (("m1", ONE), ("m2", TWO)) for c in V.COLUMNS)
AUC_CELLS = f"SELECT s.*, g.label AS y FROM ({SCORED}) s JOIN ({GOLD}) g USING (doc_id, col)"


def _auc(cells: str, by: str) -> str:
    return f"""SELECT {by}, count(*)::BIGINT AS n, round(CASE WHEN sum(y) > 0 AND sum(1 - y) > 0 THEN (sum(r * y) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)) END, 9) AS auc
FROM (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY p) + (count(*) OVER (PARTITION BY {by}, p) - 1) / 2.0 AS r FROM ({cells}) c WHERE p IS NOT NULL AND y IS NOT NULL) GROUP BY {by}"""


def _plain(text: str) -> str:
    return f"regexp_replace(replace(replace(replace(replace(replace(strip_accents(lower(coalesce({text}, ''))), 'ß', 'ss'), 'ı', 'i'), 'ø', 'o'), 'đ', 'd'), 'ł', 'l'), '\\s+', ' ', 'g')"


def _words(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _detected() -> str:
    fold = "replace(replace(strip_accents(lower(text)), 'ß', 'ss'), 'ı', 'i')"
    hits = [f"len(list_intersect(list_distinct(t), {_words(w)})) + {f'3 * len(list_intersect(list_distinct(t), {_words(STRONG_WORDS[k])}))' if k in STRONG_WORDS else 0}" for k, w in LANGUAGE_WORDS.items()]
    pairs = ", ".join(f"{{'n': {h}, 'lang': '{k}'}}" for h, k in zip(hits, LANGUAGE_WORDS, strict=True))
    return f"""SELECT doc_id, lang, CASE WHEN len(t) < 3 OR best = 0 OR len(top) > 1 THEN 'unknown' ELSE top[1].lang END AS detected FROM (
SELECT *, list_filter(s, lambda x: x.n = best) AS top FROM (SELECT *, list_max(list_transform(s, lambda x: x.n)) AS best FROM (
SELECT *, [{pairs}] AS s FROM (SELECT doc_id, lang, regexp_extract_all({fold}, '[a-z]+') AS t FROM documents))))"""


def _quoted(v) -> str:
    return "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)


def _in_turn(values: list, key: str) -> str:
    """The value numbered key modulo their number."""
    return f"([{', '.join(map(_quoted, values))}])[{key} % {len(values)} + 1]"


REPORTS = f"SELECT doc_id, concat_ws(chr(10), text, {_in_turn(V.REPORT_LINES, 'doc_id')}) AS text FROM documents"


def _negated(c) -> str:
    return f"regexp_matches(regexp_replace(c, '{c.exceptions}', ' ', 'g'), '{c.negation}')"


def _clauses(c=V.DEMO_CUES, docs: str = "documents") -> str:
    return f"""SELECT doc_id, c, {_negated(c)} AS neg, regexp_matches(c, '{c.hedges}') AS hedged, regexp_matches(c, '{c.significance}') AS sig
FROM (SELECT doc_id, trim(unnest(string_split_regex({_plain('text')}, '{c.clause_ends}'))) AS c FROM {docs}) WHERE c <> ''"""


def _vote(f) -> str:
    plain = "CASE WHEN hedged OR (neg AND sig) THEN NULL WHEN neg THEN 'neg' ELSE 'pos' END"
    out = f"WHEN regexp_matches(c, '{f.alone}') THEN {plain} " if f.alone else ""
    if f.structure:
        m, w = f"regexp_extract(c, '{f.structure}')", f.window
        p = f"(length(regexp_extract(c, '(?s)^(.*?)(?:{f.structure})', 1)) + 1)"
        lo, hi = f"greatest(0, {p} - 1 - {w})", f"least(length(c), {p} - 1 + length({m}) + {w})"
        near = lambda pat: f"CASE WHEN {lo} = 0 THEN regexp_matches(substring(c, 1, {hi}), '{pat}') ELSE regexp_matches(substring(c, {lo}, {hi} - {lo} + 1), '(?s)^.(?:.*?)(?:{pat})') END"
        there = f"regexp_matches(c, '{f.structure}')"
        out += f"WHEN {there} AND ({near(f.pathology)}) THEN {plain} WHEN {there} AND ({near(f.integrity)}) THEN CASE WHEN hedged THEN NULL WHEN neg THEN 'pos' ELSE 'neg' END "
        if f.mention_is_negative:
            out += f"WHEN {there} AND NOT hedged THEN 'neg' "
    return f"CASE {out}END"


def _votes(findings) -> str:
    return " UNION ALL ".join(f"SELECT doc_id, {_quoted(f.column)} AS col, {_vote(f)} AS vote, neg, hedged FROM clauses" for f in findings)


VOTES = _votes(V.DEMO_FINDINGS)
VERDICT = "CASE WHEN bool_or(coalesce(vote = 'pos', false)) AND NOT bool_or(coalesce(vote = 'neg', false)) THEN 1.0 WHEN bool_or(coalesce(vote = 'neg', false)) AND NOT bool_or(coalesce(vote = 'pos', false)) THEN 0.0 END::DOUBLE"


def _named(t: str, spec) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({t}, '{p}') THEN '{n}'" for n, p in spec.patterns) + " END"


def _lines(s, docs: str) -> str:
    plain = "trim(regexp_replace(replace(strip_accents(lower(x)), 'ß', 'ss'), '[ \\t]+', ' ', 'g'))"
    return f"""raw AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM {docs}),
l AS (SELECT doc_id, i, {plain} AS line FROM (SELECT doc_id, unnest(l) AS x, unnest(range(len(l))) AS i FROM raw)),
m AS (SELECT *, line LIKE '%{s.header_end}' AND length(line) <= {s.header_length} AS head FROM l WHERE line <> ''),
n AS (SELECT *, CASE WHEN head THEN {_named('line', s)} WHEN contains(line, ':') THEN {_named("split_part(line, ':', 1)", s)} END AS named FROM m),
o AS (SELECT *, last_value(named IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM n)"""


def _sections() -> str:
    return f"WITH {_lines(V.DEMO_SECTIONS, 'documents')} SELECT doc_id, count(*) AS n_lines, count(*) FILTER (head) AS headers, count(*) FILTER (section = 'first') AS first_lines, count(*) FILTER (section = 'second') AS second_lines FROM o GROUP BY doc_id"


def _compartments() -> str:
    c, s = Cues(), OSTEOARTHRITIS
    has = lambda p: f"regexp_matches(c, '{p}')"
    kind = f"CASE WHEN {has(s.uncertainty)} OR ({_negated(c)} AND {has(c.significance)}) THEN NULL WHEN {has(s.explicit)} OR ({has(s.cartilage)} AND {has(s.damage)}) THEN CASE WHEN {_negated(c)} THEN 'neg' ELSE 'pos' END WHEN {has(s.cartilage)} AND {has(s.intact)} THEN 'neg' END"
    columns = " UNION ALL ".join(f"SELECT doc_id, {_quoted(col)} AS col, CASE WHEN spot = '{n}' THEN vote END AS vote FROM k" for n, col in s.columns.items())
    return f"""WITH r AS ({REPORTS}), {_lines(s, 'r')},
c AS (SELECT doc_id, section, trim(unnest(string_split_regex(replace(line, ':', ' '), '{c.clause_ends}'))) AS c FROM o WHERE NOT head),
k AS (SELECT doc_id, {kind} AS vote, coalesce({_named('c', s)}, section) AS spot FROM c WHERE c <> '')
SELECT doc_id, col AS "column", {VERDICT} AS label FROM ({columns}) GROUP BY doc_id, col"""


def _findings() -> str:
    """Labels of the shipped findings and compartments, with a row for each document and column."""
    names = ", ".join(_quoted(n) for n in [*(f.column for f in FINDINGS), *OSTEOARTHRITIS.columns.values()])
    own = f'WITH clauses AS ({_clauses(Cues(), f"({REPORTS})")}) SELECT doc_id, col AS "column", {VERDICT} AS label FROM ({_votes(FINDINGS)}) GROUP BY doc_id, col'
    return f"""WITH f AS ({own}), g AS ({_compartments()}), a AS (SELECT * FROM f UNION ALL SELECT * FROM g)
SELECT d.doc_id, d."column", a.label, a.label IS NOT NULL AS mask FROM (SELECT DISTINCT doc_id, unnest([{names}]) AS "column" FROM documents) d LEFT JOIN a ON d."column" = a."column" AND a.doc_id = d.doc_id"""


def _mentions() -> str:
    """doc_id, column, mentioned of the reports."""
    cells = " UNION ALL ".join(f'SELECT doc_id, {_quoted(c)} AS "column", regexp_matches(t, {_quoted(p)}) AS mentioned FROM r' for c, p in mention_patterns().items())
    return f"WITH r AS MATERIALIZED (SELECT doc_id, {_plain('text')} AS t FROM ({REPORTS})) {cells}"


def _ceiling() -> str:
    return f"""SELECT g."column", count(*) AS n_gold, count(*) FILTER (gold = 1) AS n_pos, count(*) FILTER (gold = 1 AND mentioned) / nullif(count(*) FILTER (gold = 1), 0)::DOUBLE AS mention_rate_pos, avg(mentioned::INT) AS mention_rate_all, avg((y IS NOT NULL)::INT) AS labeler_coverage,
 count(*) FILTER (mentioned AND y = gold) / nullif(count(*) FILTER (mentioned AND y IS NOT NULL), 0)::DOUBLE AS acc_given_mention, count(*) FILTER (gold = 1 AND NOT mentioned) AS missed_unmentionable
FROM (SELECT doc_id, "column", label AS gold, CASE WHEN doc_id % 3 > 0 THEN label END AS y FROM ({_findings()})) g JOIN ({_mentions()}) m ON m.doc_id = g.doc_id AND m."column" = g."column" WHERE gold IS NOT NULL GROUP BY ALL"""


def _uniform(*parts: str) -> str:
    return f"(('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def _raw_series() -> str:
    """What raw metadata means, from the views' tables of meanings."""
    pick = lambda rows, k, key: _in_turn([r[k] for r in rows], key)
    plane = f"coalesce({pick(V.RAW_PLANES, 1, 'l_linenumber')}, {pick(V.RAW_DESCRIPTIONS, 1, 'l_partkey')}, {pick(V.RAW_IOP, 1, 'l_orderkey')})"
    contrast = f"coalesce({pick(V.RAW_FLUID, 1, 'l_suppkey')}, {pick(V.RAW_DESCRIPTIONS, 2, 'l_partkey')})"
    told = ["L", "L", "R", None, "R", "L", "R", None, None]
    side = f"coalesce({_in_turn(told, 'l_suppkey')}, CASE WHEN l_quantity - 25 > 20 THEN 'L' WHEN l_quantity - 25 < -20 THEN 'R' END)"
    return f"SELECT {plane} AS plane, {contrast} AS contrast, {side} AS side, coalesce({pick(V.RAW_FLUID, 0, 'l_suppkey')}, 'none') AS raw, {pick(V.RAW_FLUID, 1, 'l_suppkey')} = 'fluid' AS flag FROM lineitem"


def _scan_headers() -> str:
    pick = lambda rows, k: _in_turn([r[k] for r in rows], "user_id")
    told = ["L", "L", "R", None, "R", "L", "R", None, None]
    side = f"coalesce({_in_turn(told, 'user_id')}, CASE WHEN event_id % 101 - 50 > 20 THEN 'L' WHEN event_id % 101 - 50 < -20 THEN 'R' END)"
    return f"SELECT event_id, coalesce({pick(V.RAW_DESCRIPTIONS, 1)}, {pick(V.RAW_IOP, 1)}) AS plane, {pick(V.RAW_DESCRIPTIONS, 2)} AS contrast, {side} AS side, (event_id % 3 + 1)::INT AS frames FROM events"


SCAN_PIXELS = """WITH v AS (SELECT event_id, list_transform(range(6), lambda j: (event_id * 31 + ((event_id % 3 + 1) // 2 * 6 + j) * 7) % 4096) AS v FROM events),
i AS (SELECT event_id, CASE WHEN event_id % 4 = 1 THEN list_transform(v, lambda x: list_max(v) - x) ELSE v END AS v, CASE event_id % 5 WHEN 1 THEN 0.5 WHEN 3 THEN 2 ELSE 1 END::DOUBLE AS slope, -10.0 * (event_id % 7) AS intercept FROM v)
SELECT event_id, 6 AS size, CASE WHEN event_id % 11 <> 7 THEN v[1] * slope + intercept END::DOUBLE AS first, CASE WHEN event_id % 11 <> 7 THEN list_sum(v) * slope + 6 * intercept END::DOUBLE AS total FROM i"""


WEIGHTS = f"SELECT col, round(greatest(0, least(1, ((CASE WHEN col = 'quality' THEN 0.94 ELSE 0.67 END)::DOUBLE - 0.5) * 2)) * 4 * p * (1 - p), 9) AS weight FROM (SELECT col, avg(label) AS p FROM ({A}) GROUP BY col)"
TARGETS = f"""SELECT a.doc_id, a.col, coalesce(g.label, a.label) AS label, CASE WHEN coalesce(g.label, a.label) IS NULL THEN 0.0 WHEN g.label IS NOT NULL THEN 1.0 ELSE w.weight END::DOUBLE AS weight, g.label IS NOT NULL AS is_gold FROM ({A}) a JOIN ({WEIGHTS}) w USING (col) LEFT JOIN ({GOLD}) g USING (doc_id, col)"""
COMBINED = f"""SELECT doc_id, col, CASE WHEN k = 'conflict' THEN NULL ELSE coalesce(x, y) END AS label, CASE k WHEN 'agree' THEN 1.0 WHEN 'only_a' THEN 0.6 WHEN 'only_b' THEN 0.6 ELSE 0.0 END::DOUBLE AS weight, k AS provenance
FROM (SELECT *, CASE WHEN x IS NULL AND y IS NULL THEN 'none' WHEN y IS NULL THEN 'only_a' WHEN x IS NULL THEN 'only_b' WHEN x = y THEN 'agree' ELSE 'conflict' END AS k FROM (SELECT doc_id, col, a.label AS x, b.label AS y FROM ({A}) a FULL JOIN ({B}) b USING (doc_id, col)))"""
ORDER = "SELECT doc_id, row_number() OVER (ORDER BY md5(concat('0:', doc_id)), doc_id) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT doc_id FROM documents)"
FOLDS = f"SELECT doc_id, (CASE WHEN i < (n % 5) * (n // 5 + 1) THEN i // (n // 5 + 1) ELSE (n % 5) + (i - (n % 5) * (n // 5 + 1)) // greatest(n // 5, 1) END)::INT AS fold FROM ({ORDER})"
def _ranked(scored: str) -> str:
    return f"""SELECT doc_id, model, col, CASE WHEN p IS NULL THEN NULL WHEN n = 1 THEN 0.5 ELSE (r - 1) / (n - 1) END AS r FROM (SELECT *, rank() OVER (PARTITION BY model, col, p IS NULL ORDER BY p) + (count(*) OVER (PARTITION BY model, col, p) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY model, col) AS n FROM ({scored}))"""


SERIES = "SELECT l_orderkey AS study, lpad(l_linenumber::VARCHAR, 2, '0') || '-' || lpad(l_partkey::VARCHAR, 9, '0') AS uid, min(l_returnflag) AS plane, min(l_linestatus) AS contrast FROM lineitem GROUP BY 1, 2"
P1, P2, P3 = "plane = 'N' AND contrast = 'O'", "plane = 'R'", "contrast = 'F'"
PICKED = f"""WITH s AS ({SERIES}),
k1 AS (SELECT study, min(uid) AS uid FROM s WHERE {P1} GROUP BY study),
k2 AS (SELECT study, min(uid) AS uid FROM s ANTI JOIN k1 USING (study, uid) WHERE {P2} GROUP BY study),
k3 AS (SELECT study, min(uid) AS uid FROM s ANTI JOIN k1 USING (study, uid) ANTI JOIN k2 USING (study, uid) WHERE {P3} GROUP BY study),
o AS (SELECT *, 1 AS k FROM k1 UNION ALL SELECT *, 2 FROM k2 UNION ALL SELECT *, 3 FROM k3 UNION ALL SELECT study, uid, 4 FROM s ANTI JOIN k1 USING (study, uid) ANTI JOIN k2 USING (study, uid) ANTI JOIN k3 USING (study, uid)),
r AS (SELECT study, uid, row_number() OVER (PARTITION BY study ORDER BY k, uid) AS i FROM o)"""
CONTINUOUS = " UNION ALL ".join(f"SELECT doc_id, '{m}' AS model, '{c}' AS col, {_uniform(_quoted(m), _quoted(c), 'doc_id')} AS p FROM documents" for m in ("m1", "m2") for c in V.COLUMNS)
COUNTS = "SELECT user_id, count(*)::INT AS n FROM events GROUP BY user_id"


def _gate(x: str = "embedding") -> str:
    dot = lambda w: f"list_sum(list_transform(range({DIM}), lambda j: {x}[j + 1]::DOUBLE * ([{', '.join(map(str, w))}])[j + 1]))"
    return " + ".join(f"({g} * (exp(2 * {dot(v)}) - 1) / (exp(2 * {dot(v)}) + 1) / (1 + exp(-({dot(u)}))))" for v, u, g in zip(VW, UW, GW, strict=True))


def _attention() -> str:
    return f"""WITH s AS (SELECT label, embedding, {_gate()} AS s FROM embeddings), e AS (SELECT *, exp(s - max(s) OVER (PARTITION BY label)) AS e FROM s),
x AS (SELECT label, e, unnest(range(64))::INT AS dim, unnest(embedding)::DOUBLE AS v FROM e)
SELECT label, dim, round(sum(e * v) / sum(e), 6) AS value FROM x GROUP BY label, dim"""


def _two_levels() -> str:
    planes = f"([{', '.join('[' + ', '.join(map(str, v)) + ']' for _, v in sorted(PLANES.items()))}])[series % 3 + 1][dim + 1]"
    heads = " UNION ALL ".join(f"""SELECT label, '{c}' AS "column", round(1 / (1 + exp(-(sum(value * ([{', '.join(map(str, w))}])[dim + 1]) + {BIAS[c]}))), 6) AS p FROM p GROUP BY label""" for c, w in HEADS.items())
    return f"""WITH s AS (SELECT label, vec_id % 4 AS series, embedding, {_gate()} AS s FROM embeddings), e AS (SELECT *, exp(s - max(s) OVER (PARTITION BY label, series)) AS e FROM s),
x AS (SELECT label, series, e, unnest(range({DIM}))::INT AS dim, unnest(embedding)::DOUBLE AS v FROM e),
b AS (SELECT label, series, dim, sum(e * v) / sum(e) + {planes} AS v FROM x GROUP BY label, series, dim),
t AS (SELECT label, series, list(v ORDER BY dim) AS y FROM b GROUP BY label, series),
u AS (SELECT *, {_gate('y')} AS s FROM t), g AS (SELECT *, exp(s - max(s) OVER (PARTITION BY label)) AS e FROM u),
z AS (SELECT label, e, unnest(range({DIM}))::INT AS dim, unnest(y) AS v FROM g), p AS (SELECT label, dim, sum(e * v) / sum(e) AS value FROM z GROUP BY label, dim)
{heads}"""


def _windows() -> str:
    planes = f"([{', '.join('[' + ', '.join(map(str, v)) + ']' for _, v in sorted(PLANES.items()))}])[series % 3 + 1][dim + 1]"
    heads = " UNION ALL ".join(f"""SELECT label, o, '{c}' AS col, 1 / (1 + exp(-(sum(value * ([{', '.join(map(str, w))}])[dim + 1]) + {BIAS[c]}))) AS p FROM p GROUP BY label, o""" for c, w in HEADS.items())
    at = "CASE WHEN n > 1 THEN greatest(0, least(n - 1, round_even((k + o) * ((n - 1) / 4.0::DOUBLE), 0)::INT)) ELSE 0 END"
    return f"""WITH s AS (SELECT label, vec_id % 4 AS series, embedding, {_gate()} AS s, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY label, vec_id % 4) AS n FROM embeddings WINDOW w AS (PARTITION BY label, vec_id % 4 ORDER BY vec_id)),
w AS (SELECT label, series, o, {at} AS i FROM (SELECT DISTINCT label, series, n FROM s), range(5) AS t(k), (SELECT unnest([0.0::DOUBLE, 0.5::DOUBLE]) AS o)),
d AS (SELECT s.*, w.o FROM s JOIN w USING (label, series, i)),
e AS (SELECT *, exp(s - max(s) OVER (PARTITION BY label, series, o)) AS e FROM d),
x AS (SELECT label, series, o, e, unnest(range({DIM}))::INT AS dim, unnest(embedding)::DOUBLE AS v FROM e),
b AS (SELECT label, series, o, dim, sum(e * v) / sum(e) + {planes} AS v FROM x GROUP BY label, series, o, dim),
t AS (SELECT label, series, o, list(v ORDER BY dim) AS y FROM b GROUP BY label, series, o),
u AS (SELECT *, {_gate('y')} AS s FROM t), g AS (SELECT *, exp(s - max(s) OVER (PARTITION BY label, o)) AS e FROM u),
z AS (SELECT label, o, e, unnest(range({DIM}))::INT AS dim, unnest(y) AS v FROM g), p AS (SELECT label, o, dim, sum(e * v) / sum(e) AS value FROM z GROUP BY label, o, dim)
SELECT label, col AS "column", round(avg(p), 6) AS p FROM ({heads}) GROUP BY label, col"""


FLIP = """WITH e AS (SELECT vec_id, label, list_transform(range(16), lambda k: embedding[k + 1]::DOUBLE) AS x FROM embeddings)
SELECT vec_id, """ + ", ".join(f"round(CASE WHEN label >= 5 OR label % 4 = 3 THEN x[{k + 1}] WHEN label % 4 = 0 THEN x[{(3 - k // 4) * 4 + k % 4 + 1}] ELSE x[{k // 4 * 4 + 3 - k % 4 + 1}] END, 6) AS x{k}" for k in (0, 3, 12, 15)) + " FROM e"
PROMPT = "Read the report and answer with one JSON object. For each finding give 1 (present), 0 (absent) or null (not stated).\nFindings:\n- quality\n- toxic\nReport:\n"

FINDING_PROMPT = PROMPT.split("- quality")[0] + "".join(f"- {c}: {d}\n" for c, d in DESCRIPTIONS.items()) + "Report:\n"

MENTIONED = f"regexp_matches({_plain('text')}, 'trash|{V.DEMO_FINDINGS[0].alone}')"
SNIPPET = r"left(array_to_string(list_filter(string_split(regexp_replace(text, '([.;:\n])\s+', '\1' || chr(1), 'g'), chr(1)), lambda t: regexp_matches(" + _plain("t") + r", '\bidiot\b|\bscum\b|\bmoron\b'))[1:3], ' | '), 300)"

ORACLES = {
    "language_agreement": f"SELECT lang, count(*) AS n, count(*) FILTER (lang = detected) AS agreed, count(*) FILTER (detected = 'unknown') AS unknown FROM ({_detected()}) GROUP BY lang",
    "language_histogram": f"SELECT detected, count(*) AS n FROM ({_detected()}) GROUP BY detected ORDER BY n DESC, detected LIMIT 12",
    "normalized_text": f"SELECT doc_id, md5({_plain('text')}) AS plain_md5 FROM documents",
    "clause_votes": f"WITH clauses AS ({_clauses()}) SELECT col AS \"column\", count(*) AS n, count(*) FILTER (vote = 'pos') AS pos, count(*) FILTER (vote = 'neg') AS neg, count(*) FILTER (neg) AS negated, count(*) FILTER (hedged) AS hedged FROM (SELECT col, vote, neg, hedged FROM ({VOTES})) v GROUP BY col".replace("count(*) FILTER (neg) AS negated", "count(*) FILTER (v.neg) AS negated"),
    "report_labels": f"WITH clauses AS ({_clauses()}) SELECT doc_id, col AS \"column\", {VERDICT} AS label FROM ({VOTES}) GROUP BY doc_id, col",
    "section_scope": _sections(),
    "finding_labels": _findings(),
    "compartment_labels": _compartments(),
    "finding_mentions": f'SELECT "column", count(*) FILTER (mentioned) AS n FROM ({_mentions()}) GROUP BY "column"',
    "finding_ceiling": _ceiling(),
    "cells_with_text": f"SELECT g.doc_id, g.col AS \"column\", coalesce(length(d.text), 0)::INT AS n_chars FROM ({GOLD}) g LEFT JOIN (SELECT doc_id, text FROM documents WHERE lang = 'en') d USING (doc_id)",
    "labelled_documents": "SELECT d.doc_id FROM documents d JOIN labels l ON l.doc_id = d.doc_id AND (quality IS NOT NULL OR toxic IS NOT NULL)",
    "labelled_cells": f"SELECT count(*) FILTER (weight > 0) AS labelled, count(*) AS cells FROM ({TARGETS})",
    "mention_rate": f"SELECT round(sum((gold = 1 AND m)::INT) / greatest(sum((gold = 1)::INT), 1)::DOUBLE, 9) AS mention_rate, count(*) FILTER (gold = 1 AND NOT m) AS unmentioned, count(*) FILTER (gold = 1) AS positives FROM (SELECT *, {MENTIONED} AS m FROM ({JUDGED})) WHERE gold IS NOT NULL",
    "mention_ceiling": f"""SELECT col AS "column", count(*) AS n_gold, count(*) FILTER (gold = 1) AS n_pos, count(*) FILTER (gold = 1 AND m) / nullif(count(*) FILTER (gold = 1), 0)::DOUBLE AS mention_rate_pos, avg(m::INT) AS mention_rate_all, avg((label IS NOT NULL)::INT) AS labeler_coverage,
 count(*) FILTER (m AND label = gold) / nullif(count(*) FILTER (m AND label IS NOT NULL), 0)::DOUBLE AS acc_given_mention, count(*) FILTER (gold = 1 AND NOT m) AS missed_unmentionable FROM (SELECT *, {MENTIONED} AS m FROM ({JUDGED})) WHERE gold IS NOT NULL GROUP BY col""",
    "error_triage": f"""SELECT kind, doc_id, rank, {SNIPPET} AS snippet FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY doc_id)::INT AS rank FROM (SELECT *, CASE WHEN gold = 1 AND label IS NULL THEN 'MISSED' WHEN gold = 0 AND label = 1 THEN 'WRONG' WHEN gold = 1 AND label = 0 THEN 'FLIPPED' END AS kind FROM ({JUDGED}) WHERE col = 'toxic') WHERE kind IS NOT NULL) WHERE rank <= 6""",
    "label_coverage": f"SELECT col AS \"column\", count(label) AS labelled, count(*) FILTER (label = 1) AS positive, count(*) FILTER (label = 0) AS negative, round_even(count(label) * 100.0 / count(*), 1)::DOUBLE AS pct_of_corpus FROM ({A}) GROUP BY col",
    "labeler_scores": f"""SELECT col AS "column", count(gold) AS n_gold, count(label) AS n_pred, count(*) FILTER (o) AS n_overlap, count(*) FILTER (gold = 1) AS n_gold_pos, count(*) FILTER (label = 1) AS n_pred_pos, count(*) FILTER (gold = label) / nullif(count(*) FILTER (o), 0)::DOUBLE AS agreement,
 count(*) FILTER (gold = 1 AND label = 1) / nullif(count(*) FILTER (o AND label = 1), 0)::DOUBLE AS precision, count(*) FILTER (gold = 1 AND label = 1) / nullif(count(*) FILTER (o AND gold = 1), 0)::DOUBLE AS recall FROM (SELECT *, gold IS NOT NULL AND label IS NOT NULL AS o FROM ({JUDGED})) GROUP BY col""",
    "scores_by_language": f"SELECT lang, grouping(lang)::INT AS all_languages, count(DISTINCT doc_id) AS n_studies, count(*) FILTER (gold IS NOT NULL AND label IS NOT NULL) AS overlap_cells, count(*) FILTER (gold = label) / nullif(count(*) FILTER (gold IS NOT NULL AND label IS NOT NULL), 0)::DOUBLE AS agreement FROM ({JUDGED}) GROUP BY GROUPING SETS ((lang), ())",
    "build_targets": f"SELECT doc_id, col AS \"column\", label, weight, is_gold FROM ({TARGETS})",
    "trainable_documents": f"SELECT DISTINCT doc_id FROM ({TARGETS}) WHERE is_gold AND weight > 0",
    "label_weights": f"SELECT col AS \"column\", weight FROM ({WEIGHTS})",
    "combine_labels": f"SELECT doc_id, col AS \"column\", label, weight, provenance FROM ({COMBINED})",
    "provenance_counts": "SELECT col AS \"column\", " + ", ".join(f"count(*) FILTER (provenance = '{p}') AS \"{p}\"" for p in ("agree", "only_a", "only_b", "conflict", "none")) + f" FROM ({COMBINED}) GROUP BY col",
    "provenance_accuracy": f"SELECT k AS provenance, count(c.label) AS n, round(avg((c.label = g.label)::INT), 9) AS accuracy FROM (SELECT unnest(['agree', 'only_a', 'only_b', 'conflict']) AS k) LEFT JOIN (SELECT m.*  FROM ({COMBINED}) m SEMI JOIN ({GOLD}) USING (doc_id, col) WHERE label IS NOT NULL) c ON provenance = k LEFT JOIN ({GOLD}) g ON g.doc_id = c.doc_id AND g.col = c.col GROUP BY k",
    "masked_auc": _auc(AUC_CELLS, "model, col").replace("SELECT model, col, count", "SELECT model, col AS \"column\", count"),
    "macro_auc": f"SELECT model, round(avg(auc), 9) AS auc FROM ({_auc(AUC_CELLS, 'model, col').replace(', 9) AS auc', ', 15) AS auc')}) GROUP BY model",
    "continuous_auc": _auc(f"SELECT s.*, g.label AS y FROM ({CONTINUOUS}) s JOIN ({GOLD}) g USING (doc_id, col)", "model, col").replace("SELECT model, col, count", "SELECT model, col AS \"column\", count"),
    "kfold_assign": FOLDS,
    "holdout_split": f"SELECT doc_id, i < greatest(1, round_even(n * 0.2, 0)) AS is_validation FROM ({ORDER})",
    "oof_auc": _auc(f"SELECT x.*, fold FROM ({AUC_CELLS}) x JOIN ({FOLDS}) f USING (doc_id) WHERE model = 'm1'", "fold, col").replace("SELECT fold, col, count", "SELECT fold, col AS \"column\", count"),
    "rank_average": f"SELECT doc_id, col AS \"column\", round(0.5 + sum((coalesce(r, 0.5) - 0.5) * CASE model WHEN 'm1' THEN 2 ELSE 1 END) / 3, 9) AS p FROM ({_ranked(SCORED)}) GROUP BY doc_id, col",
    "continuous_rank_average": f"SELECT doc_id, col AS \"column\", round(0.5 + sum((r - 0.5) * CASE model WHEN 'm1' THEN 2 ELSE 1 END) / 3, 9) AS p FROM ({_ranked(CONTINUOUS)}) GROUP BY doc_id, col",
    "offset_average": f"SELECT doc_id, col AS \"column\", round(sum(p) / 2, 9) AS p FROM ({SCORED}) GROUP BY doc_id, col",
    "fold_union": f"SELECT doc_id, col AS \"column\", round(p, 9) AS p FROM ({SCORED}) WHERE model = 'm1'",
    "fold_overlap": f"SELECT DISTINCT doc_id FROM ({A}) a SEMI JOIN (SELECT * FROM ({B}) WHERE label IS NOT NULL) b USING (doc_id) SEMI JOIN (SELECT * FROM ({GOLD}) WHERE label IS NOT NULL) g USING (doc_id) WHERE label IS NOT NULL",
    "probability_average": f"SELECT doc_id, col AS \"column\", round(avg(p), 9) AS p FROM ({SCORED}) GROUP BY doc_id, col",
    "submission_fill": "SELECT DISTINCT d.doc_id, coalesce(quality, 0.5)::DOUBLE AS quality, coalesce(toxic, 0.5)::DOUBLE AS toxic FROM documents d LEFT JOIN labels USING (doc_id)",
    "series_select_top1": f"SELECT study, uid, r AS rank FROM (SELECT study, uid, r, row_number() OVER (PARTITION BY study ORDER BY r, uid) AS i FROM (SELECT *, CASE WHEN {P1} THEN 0 WHEN {P2} THEN 1 WHEN {P3} THEN 2 ELSE 3 END::INT AS r FROM ({SERIES}))) WHERE i = 1",
    "series_select_multi": f"{PICKED} SELECT study, string_agg(uid, ',' ORDER BY i) AS uids FROM r WHERE i <= 3 GROUP BY study",
    "slot_stack": f"{PICKED} SELECT q.study, q.slot::INT AS slot, r.uid, r.uid IS NOT NULL AS mask FROM (SELECT study, slot FROM (SELECT DISTINCT study FROM s), range(3) AS t(slot)) q LEFT JOIN r ON r.study = q.study AND r.i = q.slot + 1",
    "series_coverage": f"WITH s AS ({SERIES}), t AS (SELECT count(DISTINCT o_orderkey) AS total FROM orders) " + " UNION ALL ".join(f"SELECT '{n}' AS preference, (SELECT count(DISTINCT study) FROM s SEMI JOIN orders ON study = o_orderkey WHERE {p}) AS hits, total FROM t" for n, p in (("N_O", P1), ("R_any", P2), ("any_F", P3))),
    "slice_linspace": f"SELECT user_id, k::INT AS position, round_even(k * (n - 1) / 15.0, 0)::INT AS at FROM ({COUNTS}), range(16) AS t(k)",
    "slice_tta_windows": f"SELECT user_id, o AS \"offset\", k::INT AS position, CASE WHEN n > 1 THEN greatest(0, least(n - 1, round_even((k + o) * ((n - 1) / 7.0::DOUBLE), 0)::INT)) ELSE 0 END::INT AS at FROM ({COUNTS}), range(8) AS t(k), (SELECT unnest([0.0::DOUBLE, 0.5::DOUBLE]) AS o)",
    "slice_jitter": f"SELECT user_id, k::INT AS position, CASE WHEN n > 1 THEN greatest(0, least(n - 1, round_even((k + (0.25::DOUBLE + ({_uniform(_quoted('jitter'), 'user_id')} - 0.5) * 0.6)) * ((n - 1) / 7.0::DOUBLE), 0)::INT)) ELSE 0 END::INT AS at FROM ({COUNTS}), range(8) AS t(k)",
    "slice_positions": "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 3, CASE event_id % 3 WHEN 0 THEN value * 0.5 - 2 WHEN 1 THEN event_id % 17 ELSE event_id END, event_id)::INT AS position FROM events",
    "slice_dropout": f"WITH u AS (SELECT event_id, user_id, {_uniform('4', 'user_id', 'event_id')} AS u FROM events) SELECT event_id, count(*) OVER w <= 2 OR u >= 0.3 OR (max(u) OVER w < 0.3 AND u = max(u) OVER w) AS kept FROM u WINDOW w AS (PARTITION BY user_id)",
    "slice_noise": f"SELECT event_id, round(value / 1000.0 + 0.025 * sqrt(-2 * ln(1 - {_uniform('9', 'event_id', _quoted('u'))})) * cos(2 * pi() * {_uniform('9', 'event_id', _quoted('v'))}), 6) AS noisy FROM events",
    "scan_headers": _scan_headers(),
    "scan_pixels": SCAN_PIXELS,
    "truthy_flags": f"SELECT raw, flag, count(*) AS n FROM ({_raw_series()}) GROUP BY raw, flag",
    "series_metadata": f"SELECT plane, contrast, count(*) AS n FROM ({_raw_series()}) GROUP BY plane, contrast",
    "laterality_histogram": f"SELECT side, count(*) AS n, round(100.0 * (SELECT count(side) FROM ({_raw_series()})) / (SELECT count(*) FROM lineitem)::DOUBLE, 9) AS pct_known FROM ({_raw_series()}) GROUP BY side",
    "percentile_clip": """WITH e AS (SELECT event_id, user_id, CASE WHEN event_id % 10 = 3 THEN 0 WHEN user_id % 5 = 2 THEN 7 ELSE value END::DOUBLE AS value FROM events),
 q AS (SELECT user_id, quantile_cont(value, 0.01) AS a, quantile_cont(value, 0.99) AS b FROM e GROUP BY user_id),
 x AS (SELECT event_id, value, CASE WHEN b <= a THEN value ELSE a END AS lo, CASE WHEN b <= a THEN value ELSE b END AS hi FROM e JOIN q USING (user_id))
SELECT event_id, CASE WHEN hi <= lo THEN 0 ELSE round_even((greatest(least(value, hi), lo) - lo) / (hi - lo) * 255, 0)::INT END AS scaled FROM x""",
    "neighbor_stack": "SELECT event_id, coalesce(lag(value) OVER w, value) AS before, value, coalesce(lead(value) OVER w, value) AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "canonical_flip": FLIP,
    "slice_count_profile": "SELECT " + ", ".join(f"quantile_cont(n::DOUBLE, {p / 100}) AS p{p}" for p in (5, 25, 50, 75, 95)) + ", avg(n) AS mean, " + ", ".join(f"avg((n <= {k})::INT) AS le_{k}" for k in (12, 16, 20, 24, 32)) + f" FROM ({COUNTS})",
    "intensity_augment": "WITH g AS (SELECT event_id, user_id, pow(greatest(0.0, least(1.0, value / 1000.0)), 1.2) AS g FROM events), m AS (SELECT *, avg(g) OVER (PARTITION BY user_id) AS m FROM g) SELECT event_id, floor(greatest(0.0, least(1.0, (g - m) * 0.9 + m + 0.05)) * 255)::INT AS augmented FROM m",
    "coverage_semi_anti": "SELECT lang, count(l.doc_id) AS resolved, count(*) - count(l.doc_id) AS missing FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY lang",
    "attention_pool": _attention(),
    "two_level_pool": _two_levels(),
    "weighted_bce": f"SELECT \"column\", round(sum(w * l), 6) AS loss_sum, round(sum(w * l) / greatest(sum(w), 1), 9) AS loss_mean FROM (SELECT t.col AS \"column\", weight AS w, greatest(x, 0) - x * coalesce(label, 0) + ln(1 + exp(-abs(x))) AS l FROM ({TARGETS}) t JOIN (SELECT doc_id, col, p * 4 - 2 AS x FROM ({SCORED}) WHERE model = 'm1') USING (doc_id, col)) GROUP BY \"column\"",
    "bce_cells": f"SELECT doc_id, t.col AS \"column\", round(weight * (greatest(x, 0) - x * CASE WHEN weight > 0 THEN coalesce(label, 0) ELSE 0 END + ln(1 + exp(-abs(x)))), 9) AS loss FROM ({TARGETS}) t JOIN (SELECT doc_id, col, p * 4 - 2 AS x FROM ({SCORED}) WHERE model = 'm1') USING (doc_id, col)",
    "first_reports": f"SELECT doc_id, md5(text) AS text_md5 FROM ({REPORTS}) ORDER BY doc_id LIMIT 200",
    "train_then_validation": f"SELECT doc_id, min(part)::INT AS part FROM (SELECT doc_id, 0 AS part FROM ({A}) WHERE col = 'toxic' AND label IS NOT NULL UNION ALL SELECT doc_id, 1 FROM ({GOLD}) WHERE label IS NOT NULL) GROUP BY doc_id",
    "prediction_spread": f"SELECT col AS \"column\", round(stddev_pop(p), 9) AS std, stddev_pop(p) < 0.001 AS collapsed FROM ({SCORED}) WHERE model = 'm1' GROUP BY col",
    "json_reply_parse": "SELECT event_id, CASE json_type(props, '$.k') WHEN 'VARCHAR' THEN CASE lower(trim(json_extract_string(props, '$.k'))) WHEN '1' THEN 1 WHEN 'true' THEN 1 WHEN 'yes' THEN 1 WHEN 'present' THEN 1 WHEN '0' THEN 0 WHEN 'false' THEN 0 WHEN 'no' THEN 0 WHEN 'absent' THEN 0 END WHEN 'BOOLEAN' THEN (json_extract_string(props, '$.k') = 'true')::INT ELSE CASE WHEN try_cast(json_extract_string(props, '$.k') AS DOUBLE) IN (0, 1) THEN try_cast(json_extract_string(props, '$.k') AS DOUBLE) END END::DOUBLE AS k FROM events",
    "reply_labels": f"SELECT doc_id, CASE WHEN y = -1 THEN CASE WHEN n_chars % 3 < 2 THEN n_chars % 3 END ELSE y END::DOUBLE AS toxic FROM (SELECT doc_id, n_chars, {_in_turn([-1 if y == V.OWN else y for _, y in V.REPLIES], 'doc_id')} AS y FROM documents)",
    "prompt_render": f"SELECT doc_id, md5(concat('{PROMPT}', left(coalesce(text, ''), 6000))) AS prompt_md5 FROM documents",
    "shard_histogram": "SELECT left(sha1(doc_id::VARCHAR), 2) AS shard, count(*) AS n FROM documents GROUP BY 1",
    "config_keys": """SELECT left(sha1(concat('{"n_slices": ', p_size, ', "name": "', p_brand, '", "size": ', p_partkey % 3 * 112, '}')), 12) AS "key", count(*) AS n FROM part GROUP BY 1""",
    "required_studies": f"""WITH a AS (SELECT o_orderkey AS study FROM orders UNION ALL SELECT -o_orderkey - 1 FROM orders WHERE (-o_orderkey - 1) % 5 = 0), s AS (SELECT DISTINCT study FROM ({SERIES}) WHERE plane <> 'A')
SELECT count(*) AS required, count(s.study) AS resolved, count(*) - count(s.study) AS missing FROM a LEFT JOIN s ON s.study = a.study""",
    "prompt_findings": f"SELECT doc_id, md5(concat({_quoted(FINDING_PROMPT)}, left(text, 6000))) AS prompt_md5 FROM ({REPORTS})",
    "window_scores": _windows(),
}
