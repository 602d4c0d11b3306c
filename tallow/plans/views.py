"""The driver's tables as the engine's concepts: reports, gold and pseudo labels, scores, series and slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lexicon import Compartments, Cues, Finding
from ..operators.series import uniform
from ..sources.tables import to_long

COLUMNS = ["quality", "toxic"]

#: Findings in the driver's invented prose: words that suffice alone, or structures with cues near by.
DEMO_FINDINGS = [
    Finding("insult", alone=r"\bidiot\b|\bmoron\b|\bscum\b|\bclown\b|\bworthless\b"),
    Finding("linked", structure=r"\bwith\b|\bmit\b|\bavec\b|\bcon\b", pathology=r"\bfor\b|\bund\b", integrity=r"\band\b|\best\b", window=20),
    Finding("named", structure=r"\bthat\b|\bdas\b", pathology=r"\bxx\b", integrity=r"\byy\b", mention_is_negative=True),
]
DEMO_CUES = Cues(negation=r"\b(?:not|at|nicht|pas|no)\b", exceptions=r"\bat the\b", hedges=r"\b(?:as|ou)\b", significance=r"\b(?:are|from)\b", clause_ends=r"[.;:]+|,|\b(?:but|aber)\b")
DEMO_SECTIONS = Compartments(columns={"first": "first", "second": "second"}, patterns=(("first", r"\bthat\b"), ("second", r"\bwith\b|\bmit\b")), header_end=".", header_length=400)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_long(table(spark, sf_dir, "labels"), COLUMNS)


def _rule(d: DataFrame, chars: int, quiet: tuple[str, str], words: str) -> DataFrame:
    q = F.when(F.col("lang") != quiet[0], (F.col("n_chars") > chars).cast("double"))
    t = F.when(F.col("lang") != quiet[1], F.col("text").rlike(words).cast("double"))
    return to_long(d.select("doc_id", q.alias("quality"), t.alias("toxic")), COLUMNS)


def rule_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A labeler by length and words; it abstains on some languages."""
    return _rule(documents(spark, sf_dir), 400, ("fr", "de"), "idiot|moron|clown")


def rule_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rule(documents(spark, sf_dir), 800, ("es", "en"), "idiot|scum|worthless")


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, column, label (of labeler a), gold, lang, text of every cell."""
    cells = rule_a(spark, sf_dir).join(gold(spark, sf_dir).select("doc_id", "column", F.col("label").alias("gold")), ["doc_id", "column"], "left")
    return cells.join(documents(spark, sf_dir).select("doc_id", "lang", "text"), "doc_id")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two models' scores of each cell; the second lacks a language."""
    d = documents(spark, sf_dir).select("doc_id", "lang", "n_chars")
    one = ((F.col("n_chars") % 101) / 101.0).alias("p")
    two = F.when(F.col("lang") != "fr", (F.col("n_chars") % 89) / 89.0).alias("p")
    rows = [d.select("doc_id", F.lit(m).alias("model"), F.lit(c).alias("column"), p) for m, p in (("m1", one), ("m2", two)) for c in COLUMNS]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as series of orders; equal keys are one series."""
    rows = table(spark, sf_dir, "lineitem")
    uid = F.concat_ws("-", F.lpad(F.col("l_linenumber").cast("string"), 2, "0"), F.lpad(F.col("l_partkey").cast("string"), 9, "0"))
    return rows.select(F.col("l_orderkey").alias("study"), uid.alias("uid"), F.col("l_returnflag").alias("plane"), F.col("l_linestatus").alias("contrast")).groupBy("study", "uid").agg(F.min("plane").alias("plane"), F.min("contrast").alias("contrast"))


def slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")


#: Own report sentences that documents are given in turn, so that the shipped findings have something to read.
REPORT_LINES = [
    "A large effusion distends the joint.",
    "Sin fractura visible.",
    "LATERAL SIDE:\nCartilage thinning.\nPATELLA:\nCartilage normal.",
    "The ACL is disrupted, medial meniscus preserved.",
    "Efuzyon yok. Kirik hatti goruldu.",
    "Suspected fracture of the patella.",
    "VKB durchtrennt. Kein relevanter Erguss.",
    "Popliteal cyst of 3 cm and florid synovitis.",
    "Voorste kruisband intact, botbreuk van de patella.",
    "Marrow edema after a direct impact.",
    "Medial cartilage: preserved. Osteophytes along the lateral joint line.",
    "Desgarro del menisco externo.",
    "An effusion was drained. Later without effusion.",
]


def in_turn(values: list, key: Column) -> Column:
    """The value numbered key modulo their number."""
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(key, F.lit(len(values))) + 1).cast("int"))


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.concat_ws("\n", "text", in_turn(REPORT_LINES, F.col("doc_id"))).alias("text"))


#: Stands for a document's own number in a reply, 0, 1 or 2, of which 2 is no answer.
OWN = "V"
#: Replies of a language model, and what each says of the column "toxic".
REPLIES = [
    ('{"toxic": 1}', 1.0),
    ('Sure: {"Toxic ": "absent", "quality": 1} done', 0.0),
    ('{"toxic": "1.0"}', None),
    ('{"toxic": 1.0}', 1.0),
    ('{"toxic": true} and more }', None),
    ('{"toxic": 1, "TOXIC": 0}', 0.0),
    ('{"toxic": 0.5}', None),
    ('{"toxic": null}', None),
    ("{'toxic': 1}", None),
    ('{"toxic": false}', 0.0),
    ('{"toxic": " YES "}', 1.0),
    ('[{"quality": 0}]', None),
    ('{"toxic": [1]}', None),
    ("", None),
    ('{"toxic": 1, "toxic": 0}', 0.0),
    ("no braces", None),
    ('{"toxic": 1}], [{"toxic": 0}', None),
    ('{"toxic": 1}}, {{"toxic": 0}', None),
    ('{"toxic": 1}, "x": {"toxic": 0}', None),
    ('{"toxic": "yes\u00a0"}', 1.0),
    ('{"\u2003TOXIC\u3000": "\u2009No\x85"}', 0.0),
    ('{"quality": {"toxic": 0}, "toxic": 1}', 1.0),
    ('{"toxic": V}', OWN),
    ('As asked:\n{"quality": null,\n "Toxic": "V"}\nDone.', OWN),
    ('{"toxic": V.0, "quality": V}', OWN),
]
#: Raw series metadata, and what it means: planes, fluid flags, descriptions with (plane, contrast).
RAW_PLANES = [("Sagittal ", "sagittal"), (None, None), ("oblique", None), ("AXIAL", "axial"), ("coronal", "coronal")]
RAW_FLUID = [("1", "fluid"), ("No", "other"), (None, None), ("maybe", None), ("TRUE", "fluid"), (" n ", "other"), ("0.0", "other")]
RAW_DESCRIPTIONS = [
    ("SAG PD FS", "sagittal", "fluid"), ("cor t1", "coronal", "other"), ("Ax T2", "axial", "fluid"), ("localizer", None, "other"), (None, None, "other"), ("T1 fat sat COR", "coronal", "fluid"), ("tra STIR", "axial", "fluid"),
    ("T1 contrast", None, "other"), ("relax scan", None, "other"), ("localizer score", None, "other"), ("offset scout", None, "other"), ("fatty marrow", None, "other"), ("cor TIRM", "coronal", "fluid"), ("KOR T2", "coronal", "fluid"),
    ("sg pd", "sagittal", "fluid"), ("dp_cr", "coronal", "fluid"), ("T2*-TRANSVERSAL", "axial", "fluid"), ("T1_TIRM sagital", "sagittal", "other"), ("pdw/SPAIR", None, "fluid"), ("t1 fs AXIAL", "axial", "fluid"), ("STI sgx", None, "fluid"), ("t21 fatsats", None, "fluid"), ("t21 fatty", None, "other"),
]
RAW_IOP = [([0.0, 1.0, 0.0, 0.0, 0.0, -1.0], "sagittal"), ([1.0, 0.0, 0.0, 0.0, 0.0, -1.0], "coronal"), ([1.0, 0.0, 0.0, 0.0, 1.0, 0.0], "axial"), ([1.0, 0.0, 0.0, 1.0, 0.0, 0.0], "unknown")]
RAW_SIDES = [("l", None, None), ("Left ", "R", None), (None, "RIGHT", "left"), ("leftish", None, None), (None, "R", None), (None, None, "LEFT KNEE"), (None, "x", "right"), (None, None, None), ("", "", "KNEE")]


def raw_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with raw metadata of series in turn."""
    pick = lambda rows, k, key: in_turn([r[k] for r in rows], F.col(key))
    iop = F.element_at(F.array(*[F.array(*map(F.lit, v)) for v, _ in RAW_IOP]), (F.pmod("l_orderkey", F.lit(len(RAW_IOP))) + 1).cast("int"))
    sides = [in_turn([r[k] for r in RAW_SIDES], F.col("l_suppkey")).alias(n) for k, n in enumerate(("image", "tag", "part"))]
    rows = table(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", pick(RAW_PLANES, 0, "l_linenumber").alias("plane"), pick(RAW_FLUID, 0, "l_suppkey").alias("fluid"), F.concat_ws("/", pick(RAW_DESCRIPTIONS, 0, "l_partkey"), "l_returnflag").alias("description"), iop.alias("iop"), *sides, (F.col("l_quantity") - 25).cast("double").alias("x"))


def scan_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as files of two by three samples in one to three frames; one in eleven lacks most of them."""
    e, u = F.col("event_id"), F.col("user_id")
    frames = (e % 3 + 1).cast("int")
    values = F.transform(F.sequence(F.lit(0), frames * 6 - 1), lambda j: F.pmod(e * 31 + j * 7, F.lit(4096)).cast("int"))
    pick = lambda rows, k: in_turn([r[k] for r in rows], u)
    iop = F.element_at(F.array(*[F.array(*map(F.lit, v)) for v, _ in RAW_IOP]), (F.pmod(u, F.lit(len(RAW_IOP))) + 1).cast("int"))
    return slices(spark, sf_dir).select(
        F.concat_ws("/", F.concat(F.lit("series-"), u), F.concat(e, F.lit(".scan"))).alias("path"),
        F.lit(2).alias("rows"), F.lit(3).alias("columns"), frames.alias("frames"), F.when(e % 11 == 7, F.slice(values, 1, 2)).otherwise(values).alias("values"),
        F.when(e % 4 == 1, "MONOCHROME1").otherwise("MONOCHROME2").alias("photometric"), F.element_at(F.array(F.lit(0.0), F.lit(0.5), F.lit(None), F.lit(2.0), F.lit(1.0)), (e % 5 + 1).cast("int")).alias("slope"), F.when(e % 7 > 0, (e % 7 * -10).cast("double")).alias("intercept"),
        pick(RAW_DESCRIPTIONS, 0).alias("description"), pick(RAW_SIDES, 0).alias("image_side"), pick(RAW_SIDES, 1).alias("side"), pick(RAW_SIDES, 2).alias("body_part"), iop.alias("orientation"), F.array(e % 101 - 50.0, F.lit(1.0), F.lit(2.5)).alias("position"),
    )


def event_of(path: str) -> Column:
    return F.regexp_extract(path, r"(\d+)\.scan$", 1).cast("bigint")


def continuous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two models' scores of each cell that hardly ever tie."""
    rows = documents(spark, sf_dir).select("doc_id", F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(c).alias("column")) for m in ("m1", "m2") for c in COLUMNS])).alias("x")).select("doc_id", "x.*")
    return rows.withColumn("p", uniform(F.col("model"), F.col("column"), F.col("doc_id")))
