"""Votes of clauses on findings, and labels of texts from them.

A text is exploded into clauses once. The flags that all findings share (negated, hedged, significant) are columns of the clause; each finding adds
one vote column. Labels come from one aggregation by document, which Spark starts before its shuffle.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexicon import FINDINGS, OSTEOARTHRITIS, PROBES, Compartments, Cues, Finding
from ..functions.text import LINE_ENDS, STRETCH_ENDS, any_of, is_ascii, lines, loose, normalize, sentences, split_clauses, squeezed, tidied, unmarked

#: Java's Unicode classes, as texts hold Greek and Cyrillic. They are slow, and the same as the plain ones where a text is ASCII.
U = "(?U)"
#: Bytes of texts that are cut at once.
TEXT_BYTES = 1 << 22


def says(text: Column, pattern: str, ascii_: Column | None = None) -> Column:
    """Whether the text has the pattern, by Unicode's classes. An alternative of letters and blanks only is looked for as it is; one with a literal part is only matched against texts that hold it."""
    plain = is_ascii(text) if ascii_ is None else ascii_
    match = lambda p: F.when(plain, text.rlike(p)).otherwise(text.rlike(U + p))
    found, rest = [], []
    for a in reduced(pattern):
        run = literal_run(a)
        if len(run) < 3 and run != a:
            rest.append(a)
        else:
            found.append(text.contains(run) if run == a else text.contains(run) & match(a))
    if rest:
        found.append(match("|".join(rest)))
    return found[0] if len(found) == 1 else any_of(*found)


def alternatives(pattern: str) -> list[str]:
    """The top-level alternatives of a pattern."""
    depth, out = 0, [""]
    for token in re.findall(r"\\.|\[[^]]*\]|.", pattern, re.DOTALL):
        depth += (token == "(") - (token == ")")
        if token == "|" and not depth:
            out.append("")
        else:
            out[-1] += token
    return out


def literal_run(alternative: str) -> str:
    """The longest run of letters and blanks that any match of an alternative holds."""
    depth, sure = 0, ""
    for token in re.findall(r"\\.|\[[^]]*\]|.", alternative, re.DOTALL):
        depth += (token == "(") - (token == ")")
        # what stands in groups, classes and escapes isn't sure to be there
        sure += token if not depth and len(token) == 1 and token != ")" else "\0"
    letters = "a-z\u0370-\u03ff\u0400-\u04ff "
    return max(re.findall(f"[{letters}]+(?![{letters}?*{{])", sure), key=len, default="")


def reduced(pattern: str) -> list[str]:
    """The alternatives of a pattern without those whose matches all hold another one, of letters and blanks only."""
    known = list(dict.fromkeys(alternatives(pattern)))
    whole = [a for a in known if a and literal_run(a) == a]
    return [a for a in known if not any(w != a and w in literal_run(a) for w in whole)]


def shortest(runs: list[str]) -> list[str]:
    """The runs that hold no other one."""
    return [r for r in dict.fromkeys(runs) if not any(o != r and o in r for o in runs)]


def hinted(text: Column, patterns: list[str], words: bool = False) -> Column | None:
    """Whether the text holds a literal part of an alternative of any pattern, as every match does; None if one has no part of three signs. With words, a part's longest word is enough, so blanks may
    still be other white space."""
    parts = hints(patterns, words)
    return any_of(*[text.contains(x) for x in parts]) if parts else None


def hints(patterns: list[str], words: bool = False) -> list[str]:
    """The literal parts that hinted looks for; none at all if one alternative has no part of three signs."""
    parts = [literal_parts(p, 3) for p in patterns]
    if words:
        parts = [[max(x.split(), key=len, default="") for x in of] for of in parts]
    return shortest([x for of in parts for x in of]) if all(parts) else []


def literal_parts(pattern: str, least: int = 4) -> list[str]:
    """The literal run of each top-level alternative; none at all if one of them has no run of `least` signs."""
    runs = [literal_run(a) for a in alternatives(pattern)]
    return list(dict.fromkeys(runs)) if all(len(r) >= least for r in runs) else []


def negated(clause: Column, cues: Cues, ascii_: Column | None = None) -> Column:
    if not cues.exceptions:
        return says(clause, cues.negation, ascii_)
    # few clauses have a negation at all, so exceptions are only looked for in those
    return says(clause, cues.negation, ascii_) & F.regexp_replace(clause, U + cues.exceptions, " ").rlike(U + cues.negation)


def with_places(clauses: DataFrame, findings: list[Finding]) -> DataFrame:
    """Adds what votes need of each finding: `_alone`, whether its terms are there; and the first place of its structure, as `_part`, the text around it, and `_head`, whether
    that begins the clause. Each is a column, so that no match is computed twice."""
    c, ascii_ = F.col("clause"), F.col("ascii")
    at: dict[str, Column] = {}
    for k, f in enumerate(findings):
        if f.alone:
            at[f"_alone{k}"] = says(c, f.alone, ascii_)
        if f.structure:
            place = F.when(ascii_, F.regexp_instr(c, F.lit(f.structure))).otherwise(F.regexp_instr(c, F.lit(U + f.structure)))
            parts = literal_parts(f.structure, 3)
            at[f"_at{k}"] = F.when(any_of(*[c.contains(x) for x in parts]), place).otherwise(0) if parts else place
    part: dict[str, Column] = {}
    for k, f in enumerate(findings):
        if f.structure:
            p = F.col(f"_at{k}")
            lo = F.greatest(F.lit(0), p - 1 - f.window)
            hi = F.least(F.length(c), p - 1 + F.length(F.regexp_substr(c, F.lit(U + f.structure))) + f.window)
            part[f"_part{k}"] = F.when(p > 0, F.substring(c, F.greatest(lo, F.lit(1)), F.when(lo == 0, hi).otherwise(hi - lo + 1)))
            part[f"_head{k}"] = p <= 1 + f.window
    return clauses.withColumns(at).withColumns(part) if part else clauses.withColumns(at)


def vote(finding: Finding, k: int) -> Column:
    """'pos', 'neg' or null for a row of with_places, of the finding numbered k."""
    neg, hedged, significant = (F.col(n) for n in ("negated", "hedged", "significant"))
    plain = F.when(hedged | (neg & significant), F.lit(None)).when(neg, "neg").otherwise("pos")
    out = F.when(F.col(f"_alone{k}"), plain) if finding.alone else F.when(F.lit(False), F.lit(None).cast("string"))
    if finding.structure:
        part, head = F.col(f"_part{k}"), F.col(f"_head{k}")
        there = part.isNotNull()
        # a part inside the clause keeps the letter before it as context, and ends as if the clause did
        near = lambda pattern: F.when(head, says(part, pattern)).otherwise(part.rlike(f"(?sU)^.(?:.*?)(?:{pattern})"))
        intact = F.when(hedged, F.lit(None)).when(neg, "pos").otherwise("neg")
        out = out.when(there & near(finding.pathology), plain)
        out = out.when(there & near(finding.integrity), intact)
        if finding.mention_is_negative:
            out = out.when(there & ~hedged, "neg")
    return out


def clauses_of(docs: DataFrame, cues: Cues = Cues(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, clause_no, clause, ascii."""
    rows = docs.select(key, F.posexplode(split_clauses(normalize(F.col(text)), U + cues.clause_ends)).alias("clause_no", "clause"))
    return rows.withColumn("ascii", is_ascii(F.col("clause")))


def with_flags(clauses: DataFrame, cues: Cues, where: Column | None = None) -> DataFrame:
    """Adds the flags that all findings share; null where they don't matter."""
    c, ascii_ = F.col("clause"), F.col("ascii")
    flags = {"negated": negated(c, cues, ascii_), "hedged": says(c, cues.hedges, ascii_), "significant": says(c, cues.significance, ascii_)}
    return clauses.withColumns(flags if where is None else {n: F.when(where, f) for n, f in flags.items()})


def clause_table(docs: DataFrame, cues: Cues = Cues(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, clause_no, clause, ascii and the shared flags."""
    return with_flags(clauses_of(docs, cues, key, text), cues)


def verdict(positive: Column, negative: Column) -> Column:
    """1, 0, or null if there is no vote or both."""
    return F.when(positive & ~negative, 1.0).when(negative & ~positive, 0.0)


def long_labels(votes: DataFrame, columns: list[str], key: str = "doc_id", flags: dict[str, str] | None = None) -> DataFrame:
    """key, column, label from a table with one vote column (v0, v1, ...) a finding; and mentioned, whether any row has a column's flag, if flags are named."""
    sums = [f(F.coalesce(F.col(f"v{k}") == kind, F.lit(False))).alias(f"{kind}{k}") for k in range(len(columns)) for f, kind in ((F.bool_or, "pos"), (F.bool_or, "neg"))]
    wide = votes.groupBy(key).agg(*sums, *[F.bool_or(n).alias(n) for n in dict.fromkeys((flags or {}).values())])
    more = lambda c: [F.col(flags[c]).alias("mentioned")] if flags else []
    cells = F.array(*[F.struct(F.lit(c).alias("column"), verdict(F.col(f"pos{k}"), F.col(f"neg{k}")).alias("label"), *more(c)) for k, c in enumerate(columns)])
    return wide.select(key, F.explode(cells).alias("cell")).select(key, "cell.*")


def label_findings(docs: DataFrame, findings: list[Finding] = FINDINGS, cues: Cues = Cues(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, column, label of texts with at least one clause."""
    return long_labels(finding_votes(docs, findings, cues, key, text), [f.column for f in findings], key)


def finding_votes(docs: DataFrame, findings: list[Finding] = FINDINGS, cues: Cues = Cues(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, v0, v1, ...: a row a clause that may vote, and a text's first one, with its vote on each finding."""
    clauses = clauses_of(docs, cues, key, text)
    # a clause without a term has no vote; a text's first one stays, so that the text does
    hint = hinted(F.col("clause"), [p for f in findings for p in (f.alone, f.structure) if p])
    return cast_votes(clauses if hint is None else clauses.where((F.col("clause_no") == 0) | hint), findings, cues, [key])


def cast_votes(clauses: DataFrame, findings: list[Finding], cues: Cues, keep: list[str]) -> DataFrame:
    """The columns to keep, v0, v1, ...: votes of rows of clauses_of."""
    clauses = with_places(clauses, findings)
    there = [F.col(f"_alone{k}") if f.alone else F.lit(False) for k, f in enumerate(findings)] + [F.col(f"_at{k}") > 0 for k, f in enumerate(findings) if f.structure]
    clauses = with_flags(clauses, cues, any_of(*there))
    return clauses.select(*keep, *[vote(f, k).alias(f"v{k}") for k, f in enumerate(findings)])


def compartment(text: Column, spec: Compartments) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, pattern in spec.patterns:
        out = out.when(says(text, pattern), name)
    return out


def naming(line: Column, spec: Compartments) -> tuple[Column, Column]:
    """Whether a line is a header, and the compartment that it names."""
    header = line.endswith(spec.header_end) & (F.length(line) <= spec.header_length)
    label = F.substring_index(line, ":", 1)
    return header, F.when(header, compartment(line, spec)).when(line.contains(":"), compartment(label, spec))


def scoped_lines(docs: DataFrame, spec: Compartments = OSTEOARTHRITIS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, line_no, line, is_header, section: the compartment last named by a header or a line's label, at or above the line."""
    rows = docs.select(key, F.posexplode(lines(F.col(text))).alias("line_no", "line")).where("line <> ''")
    line = F.col("line")
    header, named = naming(line, spec)
    above = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("is_header", header).withColumn("named", named).withColumn("section", F.last("named", ignorenulls=True).over(above)).drop("named")


def label_compartments(docs: DataFrame, spec: Compartments = OSTEOARTHRITIS, cues: Cues = Cues(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, column, label of the columns that sections decide."""
    return long_labels(compartment_votes(docs, spec, cues, key, text), list(spec.columns.values()), key)


def compartment_votes(docs: DataFrame, spec: Compartments = OSTEOARTHRITIS, cues: Cues = Cues(), key: str = "doc_id", text: str = "text", first: int = 0) -> DataFrame:
    """key and a vote for each of the compartments' columns, named from v<first> on: a row a clause."""
    body = scoped_lines(docs, spec, key, text).where("NOT is_header")
    rows = body.select(key, "section", F.explode(split_clauses(F.replace(F.col("line"), F.lit(":"), F.lit(" ")), U + cues.clause_ends)).alias("clause"))
    kind, where = side(F.col("clause"), F.col("section"), spec, cues)
    votes = rows.select(key, kind.alias("kind"), where.alias("at"))
    return votes.select(key, *[F.when(F.col("at") == n, F.col("kind")).alias(f"v{first + k}") for k, n in enumerate(spec.columns)])


def side(c: Column, section: Column, spec: Compartments, cues: Cues) -> tuple[Column, Column]:
    """A clause's vote on cartilage and bone, 'pos', 'neg' or null, and its compartment: the one that it names, or the section's."""
    neg = negated(c, cues)
    cartilage = says(c, spec.cartilage)
    harmed = says(c, spec.explicit) | (cartilage & says(c, spec.damage))
    # most clauses are about something else, so that comes first
    sure = ~(says(c, spec.uncertainty) | (neg & says(c, cues.significance)))
    kind = F.when(harmed, F.when(sure, F.when(neg, "neg").otherwise("pos"))).when(cartilage & says(c, spec.intact) & sure, "neg")
    return kind, F.when(kind.isNotNull(), F.coalesce(compartment(c, spec), section))


def label_reports(docs: DataFrame, key: str = "doc_id", text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """Labels of every text and column, null where a text says nothing: key, column, label, mask."""
    out = long_labels(report_votes(docs, key, text), REPORT_COLUMNS, key).withColumn("mask", F.col("label").isNotNull())
    return out.where(F.col("column").isin(columns)) if columns else out


def labels_and_mentions(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """What label_reports and mentioned say of every text and column, in one pass: key, column, label, mentioned."""
    patterns = shared_patterns(REPORT_COLUMNS)
    return long_labels(report_votes(docs, key, text, patterns), REPORT_COLUMNS, key, patterns)


REPORT_COLUMNS = [*(f.column for f in FINDINGS), *OSTEOARTHRITIS.columns.values()]


def report_votes(docs: DataFrame, key: str, text: str, flags: dict[str, str] | None = None) -> DataFrame:
    """key and a vote for each of REPORT_COLUMNS: rows of stretches between marks and of lines that may vote, and one of each text with its flags (see shared_patterns).

    A text is put into plain form once, and only what may vote or names a section is dealt by text."""
    cues, spec = Cues(), OSTEOARTHRITIS
    rows = docs.select(key, F.lower(F.coalesce(text, F.lit(""))).alias("_lower"))
    names = list(dict.fromkeys((flags or {}).values()))
    if flags:
        rows = rows.withColumn("_plain", normalize(F.col("_lower")))
        rows = with_mentions(rows.withColumn("_ascii", is_ascii(F.col("_plain"))), flags)
    said = [p for f in FINDINGS for p in (f.alone, f.structure) if p]
    rows = cut(rows.select(key, *names, "_lower"), "_lower", said, [spec.explicit, spec.cartilage])
    kind, part = F.col("kind"), F.col("part")
    rows = rows.withColumn("part", F.when(kind == 0, squeezed(unmarked(part))).when(kind == 1, tidied(unmarked(part))).otherwise(part))
    header, named = naming(part, spec)
    above = Window.partitionBy(key).orderBy("kind", "no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"header": (kind == 1) & header, "named": F.when(kind == 1, named)}).withColumn("section", F.last("named", ignorenulls=True).over(above)).where("NOT header")
    clauses = split_clauses(F.when(kind == 1, F.replace(part, F.lit(":"), F.lit(" "))).otherwise(part), U + cues.clause_ends)
    rows = rows.select(key, *names, "kind", "section", F.explode(F.when(kind == 2, F.array(F.lit(""))).otherwise(clauses)).alias("of"))
    rows = rows.withColumns({"clause": F.when(kind == 0, F.col("of")), "ascii": is_ascii(F.col("of"))})
    rows = cast_votes(rows, FINDINGS, cues, [key, *names, "kind", "section", "of"])
    vote_, at = side(F.when(kind == 1, F.col("of")), F.col("section"), spec, cues)
    rows = rows.withColumns({"_vote": vote_, "_at": at})
    own = [f"v{k}" for k in range(len(FINDINGS))]
    return rows.select(key, *names, *own, *[F.when(F.col("_at") == n, F.col("_vote")).alias(f"v{len(own) + k}") for k, n in enumerate(spec.columns)])


def cut(rows: DataFrame, text: str, said: list[str], about: list[str]) -> DataFrame:
    """The other columns, kind, no, part, from texts in lower case: stretches between marks that may hold a literal part of what is said (kind 0); of texts that may hold a word of what lines are about,
    the lines that may hold one or have a colon (1); "" of every text (2). Parts keep their letters' marks and their white space.

    Arrow looks for all words in one pass, where each is a pass of its own in the JVM, and letters' marks can stay on till then."""
    words, topics = ("|".join(map(loose, hints(of, words=True))) for of in (said, about))
    others = [c for c in rows.columns if c != text]

    def run(batches):
        for whole in batches:
            step = max(1, whole.num_rows * TEXT_BYTES // max(whole.nbytes, 1))
            for at in range(0, whole.num_rows, step):
                yield from found(whole.slice(at, step))

    def found(b: pa.RecordBatch):
        of, no, part = parts_of(b.column(text), STRETCH_ENDS, f"{words}|{topics}")
        speaks = pc.match_substring_regex(part, words)
        yield made(b, 0, of.filter(speaks), no.filter(speaks), part.filter(speaks))
        talk = pc.unique(of.filter(pc.match_substring_regex(part, topics)))
        of, no, part = parts_of(b.column(text).take(talk), LINE_ENDS, f":|{topics}")
        yield made(b, 1, talk.take(of), no, part)
        every = pa.array(np.arange(b.num_rows))
        yield made(b, 2, every, every, pa.array([""] * b.num_rows, pa.string()))

    def parts_of(texts: pa.Array, ends: str, pattern: str) -> tuple[pa.Array, pa.Array, pa.Array]:
        """Of the parts that have the pattern: number of the text, of the part, and the part."""
        split = pc.split_pattern_regex(texts, ends)
        part = split.flatten()
        no = pc.indices_nonzero(pc.match_substring_regex(part, pattern))
        return pc.list_parent_indices(split).take(no), no, part.take(no)

    def made(b: pa.RecordBatch, kind: int, of: pa.Array, no: pa.Array, part: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({**{c: b.column(c).take(of) for c in others}, "kind": pa.array(np.full(len(of), kind, np.int32)), "no": no.cast(pa.int64()), "part": part})

    types = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in others), "kind int, no bigint, part string"]))


def mentions(text: Column, finding: Finding, extra: str = "") -> Column:
    """Whether the text names the finding at all; a finding without terms is never named."""
    parts = [p for p in (extra, finding.alone, finding.structure) if p]
    return any_of(*[says(normalize(text), p) for p in parts])


def mention_patterns(columns: list[str] | None = None) -> dict[str, str]:
    """For each column a pattern of its probes and of the finding's own terms; a compartment's terms are those of arthrosis and cartilage."""
    own = {f.column: [p for p in (f.alone, f.structure) if p] for f in FINDINGS} | {c: [OSTEOARTHRITIS.explicit, OSTEOARTHRITIS.cartilage] for c in OSTEOARTHRITIS.columns.values()}
    return {c: "|".join([*PROBES.get(c, []), *own.get(c, [])]) for c in columns or PROBES}


def mentioned(docs: DataFrame, columns: list[str] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, column, mentioned for every text and column: whether the text hints at the column at all. A text is put into plain form once."""
    plain = docs.select(key, normalize(F.col(text)).alias("_plain")).withColumn("_ascii", is_ascii(F.col("_plain")))
    flags = shared_patterns(columns)
    cells = [F.struct(F.lit(c).alias("column"), F.col(n).alias("mentioned")) for c, n in flags.items()]
    return with_mentions(plain, flags).select(key, F.explode(F.array(*cells)).alias("c")).select(key, "c.*")


def shared_patterns(columns: list[str] | None = None) -> dict[str, str]:
    """For each column the name of its flag; columns whose patterns come to the same share one."""
    patterns = {c: "|".join(reduced(p)) for c, p in mention_patterns(columns).items()}
    at = {p: c for c, p in reversed(patterns.items())}
    return {c: f"_has_{list(PROBES).index(at[p])}" for c, p in patterns.items()}


def with_mentions(plain: DataFrame, flags: dict[str, str]) -> DataFrame:
    """Adds the flags of columns to rows with _plain and _ascii."""
    patterns = mention_patterns(list(flags))
    first = {n: c for c, n in reversed(flags.items())}
    return plain.withColumns({n: says(F.col("_plain"), patterns[c], F.col("_ascii")) for n, c in first.items()})


def mention_table(cells: DataFrame) -> DataFrame:
    """From column, gold, label, mentioned: how far labels could go if every mention was read right."""
    g, m, y = F.col("gold"), F.col("mentioned"), F.col("label")
    pos = g == 1
    return (
        cells.where("gold IS NOT NULL")
        .groupBy("column")
        .agg(
            F.count("*").alias("n_gold"),
            F.count_if(pos).alias("n_pos"),
            F.try_divide(F.count_if(pos & m).cast("double"), F.count_if(pos)).alias("mention_rate_pos"),
            F.avg(m.cast("double")).alias("mention_rate_all"),
            F.avg(y.isNotNull().cast("double")).alias("labeler_coverage"),
            F.try_divide(F.count_if(m & (y == g)).cast("double"), F.count_if(m & y.isNotNull())).alias("acc_given_mention"),
            F.count_if(pos & ~m).alias("missed_unmentionable"),
        )
    )


def mention_rate(table: DataFrame) -> DataFrame:
    """From mention_table: the share of gold positives that their texts mention, over all columns, and how many are never mentioned."""
    pos = F.sum("n_pos")
    mentioned = F.sum(F.coalesce(F.col("mention_rate_pos") * F.col("n_pos"), F.lit(0.0)))
    return table.agg((mentioned / F.greatest(pos, F.lit(1))).alias("mention_rate"), F.sum("missed_unmentionable").alias("unmentioned"), pos.alias("positives"))


def with_texts(cells: DataFrame, texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Adds the text of each cell's key, "" where there is none."""
    return cells.join(texts.select(key, text), key, "left").withColumn(text, F.coalesce(text, F.lit("")))


def error_triage(cells: DataFrame, probe: str, keep: int = 6, key: str = "doc_id") -> DataFrame:
    """Up to `keep` examples of each kind of error, by key, with up to three sentences that match the probe."""
    g, p = F.col("gold"), F.col("label")
    kind = F.when((g == 1) & p.isNull(), "MISSED").when((g == 0) & (p == 1), "WRONG").when((g == 1) & (p == 0), "FLIPPED")
    ranked = cells.withColumn("kind", kind).where("kind IS NOT NULL").withColumn("rank", F.row_number().over(Window.partitionBy("kind").orderBy(key))).where(F.col("rank") <= keep)
    hits = F.slice(F.filter(sentences(F.col("text")), lambda s: normalize(s).rlike(U + probe)), 1, 3)
    return ranked.select("kind", key, "rank", F.substring(F.array_join(hits, " | "), 1, 300).alias("snippet"))
