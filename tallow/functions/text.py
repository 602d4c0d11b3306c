"""Text columns: plain form, lines, clauses, sentences, and the language of a text. All are built-in expressions."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .lexicon import CLAUSE_ENDS, LANGUAGE_WORDS, STRONG_WORDS


def _plain_letters() -> tuple[str, str]:
    """Letters that lose their marks, and what stays of each: single letters whose decomposition is one letter and marks."""
    source, target = ["ı", "ø", "đ", "ł"], ["i", "o", "d", "l"]
    for code in [*range(0xA0, 0x530), *range(0x1E00, 0x2000)]:
        c = chr(code)
        rest = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if len(rest) == 1 and rest != c:
            source.append(c)
            target.append(rest)
    return "".join(source), "".join(target)


_FROM, _TO = _plain_letters()
#: What has no decomposition but stands for a plain letter.
STROKES = "øđł"


#: For Arrow: line ends as Java's \R knows them, and marks between stretches of a text that isn't unmarked yet; line ends are white space there.
LINE_ENDS = r"\r\n|[\n-\r\x{85}\x{2028}\x{2029}]"
STRETCH_ENDS = "[.;:,%s]+" % "".join(a for a, b in zip(_FROM, _TO, strict=True) if b in ".;:,")
#: The letters that each plain letter stands for, and ß, which is two of them.
_MARKED = {c: "".join(a for a, b in zip(_FROM, _TO, strict=True) if b == c) for c in set(_TO)} | {"s": "ß" + "".join(a for a, b in zip(_FROM, _TO, strict=True) if b == "s")}


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def unmarked(text: Column, strokes: bool = True) -> Column:
    """Lower case without marks; a text in ASCII has none to take off."""
    source, target = (_FROM, _TO) if strokes else ("".join(c) for c in zip(*[(a, b) for a, b in zip(_FROM, _TO, strict=True) if a not in STROKES], strict=True))
    bare = F.regexp_replace(F.replace(F.translate(F.lower(text), source, target), F.lit("ß"), F.lit("ss")), r"\p{M}+", "")
    return F.when(is_ascii(text), F.lower(text)).otherwise(bare)


def loose(word: str) -> str:
    """A pattern for Arrow that a text in lower case has if its unmarked form holds the word; others may have it too."""
    letter = lambda k: f"[{word[k]}{_MARKED.get(word[k], '')}]" + "?" * (word[k - 1 : k + 1] == "ss")
    return r"[^\x00-\x7f]*".join(map(letter, range(len(word))))


def normalize(text: Column) -> Column:
    """Lower case without marks, white space as single spaces; null is empty. Ligatures keep their form (normalize_exact opens them)."""
    return squeezed(unmarked(F.coalesce(text, F.lit(""))))


def squeezed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", " ")


@F.pandas_udf(StringType())
def normalize_exact(text: pd.Series) -> pd.Series:
    """normalize with the full compatibility decomposition, for texts beyond Latin, Greek and Cyrillic letters."""
    plain = text.fillna("").str.lower().str.translate(str.maketrans({"ı": "i", "ß": "ss", "ø": "o", "đ": "d", "ł": "l"})).str.normalize("NFKD")
    return plain.map(lambda s: "".join(c for c in s if not unicodedata.combining(c))).str.replace(r"\s+", " ", regex=True)


def lines(text: Column) -> Column:
    """The plain form line by line; a null text has no lines."""
    return F.coalesce(F.transform(F.split(unmarked(text), r"\R"), tidied), F.array().cast("array<string>"))


def tidied(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, r"[ \t]+", " "))


def split_clauses(plain: Column, ends: str = CLAUSE_ENDS) -> Column:
    """Trimmed clauses that aren't empty."""
    return F.filter(F.transform(F.split(plain, ends), lambda s: F.trim(s)), lambda s: s != "")


def sentences(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?<=[.;:\n])\s+"), lambda s: F.trim(s) != "")


def with_language(rows: DataFrame, text: str = "text", name: str = "language", words: dict[str, list[str]] = LANGUAGE_WORDS, strong: dict[str, list[str]] = STRONG_WORDS) -> DataFrame:
    """Adds the language: el or ru by script; else the one with most distinct function words, a strong word counting three more. 'unknown' for fewer than
    three words, no hit, or a tie at the top. Words are runs of a to z once marks are gone; letters with strokes part them. A text is cut into words once, and only the few that any language lists are kept for counting. Each step is a
    column of its own, so that none is computed twice."""
    listed = sorted({w for of in (*words.values(), *strong.values()) for w in of})
    foreign = F.col("_plain").rlike(r"[\p{IsGreek}\p{IsCyrillic}]")
    count = lambda pattern: F.when(foreign, F.regexp_count("_plain", F.lit(pattern))).otherwise(0)
    hits = lambda of: F.size(F.array_intersect("_listed", F.array(*map(F.lit, of)))) if of else F.lit(0)
    scores = F.array(*[F.struct((hits(w) + 3 * hits(strong.get(k, []))).alias("n"), F.lit(k).alias("lang")) for k, w in words.items()])
    top, second = F.col("_ranked")[0], F.col("_ranked")[1]
    by_words = F.when((F.col("_n") < 3) | (top["n"] == 0) | (top["n"] == second["n"]), "unknown").otherwise(top["lang"])
    out = rows.withColumn("_plain", unmarked(F.coalesce(F.col(text), F.lit("")), strokes=False))
    out = out.withColumns({"_words": F.split("_plain", "[^a-z]+"), "_greek": count(r"\p{IsGreek}"), "_cyrillic": count(r"\p{IsCyrillic}"), "_latin": count(r"\p{IsLatin}")})
    # an empty part is first or last, so five parts show whether there are three words
    out = out.withColumns({"_n": F.size(F.filter(F.slice("_words", 1, 5), lambda w: w != "")), "_listed": F.array_intersect("_words", F.array(*map(F.lit, listed)))})
    out = out.withColumn("_ranked", F.sort_array(scores, asc=False))
    script = F.when((F.col("_greek") > F.col("_cyrillic")) & (F.col("_greek") > F.col("_latin")), "el").when((F.col("_cyrillic") > F.col("_greek")) & (F.col("_cyrillic") > F.col("_latin")), "ru")
    return out.withColumn(name, script.otherwise(by_words)).select(*[F.col(f"`{c}`") for c in rows.columns if c != name], name)


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
