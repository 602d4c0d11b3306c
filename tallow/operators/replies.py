"""Prompts for a language model, and labels from its replies. The model itself is a callable that the user brings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_CHARS = 6000
BATCH = 8


#: What each finding means, and what is easily taken for it.
DESCRIPTIONS = {
    "ACL": "partial or complete tear of the anterior cruciate ligament",
    "MCL": "sprain or tear of the medial collateral ligament",
    "Medial Meniscus": "tear of the medial meniscus; degeneration alone is none",
    "Lateral Meniscus": "tear of the lateral meniscus; degeneration alone is none",
    "Medial OA": "arthrosis or loss of cartilage between femur and tibia on the medial side",
    "Lateral OA": "arthrosis or loss of cartilage between femur and tibia on the lateral side",
    "PF OA": "arthrosis or loss of cartilage behind the patella or in the trochlea; a medial facet of the patella belongs here",
    "Effusion": "too much fluid in the joint",
    "Synovitis": "inflamed or thickened synovium",
    "Baker's": "cyst in the hollow of the knee",
    "Contusion": "bruised bone, or marrow edema after an injury",
    "Fracture": "any fracture, stress and avulsion fractures too",
}


def build_prompt(text: Column, columns: list[str], descriptions: dict[str, str] = DESCRIPTIONS) -> Column:
    """The question about a report, with a line for each finding and what it means, where that is known."""
    head = "Read the report and answer with one JSON object. For each finding give 1 (present), 0 (absent) or null (not stated).\nFindings:\n"
    told = "".join(f"- {c}: {descriptions[c]}\n" if c in descriptions else f"- {c}\n" for c in columns)
    return F.concat(F.lit(head + told + "Report:\n"), F.substring(F.coalesce(text, F.lit("")), 1, MOST_CHARS))


#: The words that count as an answer.
PRESENT, ABSENT = ["1", "yes", "true", "present"], ["0", "no", "false", "absent"]
#: Unicode's blanks, and the four separators of ASCII.
BLANKS = r"[\s\x1c-\x1f]"


def _folded(x: Column) -> Column:
    return F.lower(F.regexp_replace(x, f"(?U)^{BLANKS}+|{BLANKS}+$", ""))


def answer(value: Column) -> Column:
    """1.0 or 0.0 from a JSON value: the numbers 1 and 0, booleans, or an answer word; null for all else, so "1.0" as a string or 0.5 say nothing."""
    kind = F.schema_of_variant(value)
    number = F.try_variant_get(value, "$", "double")
    word = _folded(F.try_variant_get(value, "$", "string"))
    from_word = F.when(word.isin(PRESENT), 1.0).when(word.isin(ABSENT), 0.0)
    is_number = kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL")
    return F.when(is_number, F.when(number.isin(0.0, 1.0), number)).when(kind.isin("BOOLEAN", "STRING"), from_word)


def parse_reply(reply: Column, columns: list[str]) -> dict[str, Column]:
    """A label column for each name from the outermost braces, which must hold one JSON object and nothing else. Keys match whatever their case and outer
    blanks, the last one if several do; values keep their types. No reply is an error: what can't be read is null."""
    body = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    # the body has to be one object inside an array and inside an object: text that closes one of them early doesn't close the other
    strict = {"allowSingleQuotes": "false"}
    read = F.from_json(F.concat(F.lit("["), body, F.lit("]")), "array<map<string,variant>>", strict)
    whole = F.from_json(F.concat(F.lit('{"x":'), body, F.lit("}")), "map<string,string>", strict)
    cells = F.when((F.size(read) == 1) & (F.size(whole) == 1), F.map_entries(F.get(read, F.lit(0))))
    last = lambda c: F.element_at(F.filter(cells, lambda e: _folded(e["key"]) == c.strip().lower()), F.lit(-1))
    found = lambda c: F.when(F.exists(cells, lambda e: _folded(e["key"]) == c.strip().lower()), answer(last(c)["value"]))
    return {c: found(c) for c in columns}


def label_by_model(rows: DataFrame, generate: Callable[[list[str]], list[str]], columns: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, reply and a label a column; generate answers BATCH prompts at a time inside the tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), BATCH):
                part = b.iloc[lo : lo + BATCH]
                yield pd.DataFrame({"key": part["key"].to_numpy(), "reply": generate(part["prompt"].tolist())})

    prompts = rows.select(F.col(key).alias("key"), build_prompt(F.col(text), columns).alias("prompt"))
    kind = dict(prompts.dtypes)["key"]
    out = prompts.mapInPandas(run, f"key {kind}, reply string")
    return out.select(F.col("key").alias(key), "reply", *[c.alias(n) for n, c in parse_reply(F.col("reply"), columns).items()])
