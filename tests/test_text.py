from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallow.functions.text import normalize, normalize_exact, with_language
from tallow.operators.votes import label_reports

#: Own sentences: (report, column, label).
CASES = [
    # terms that suffice alone, with and without negation, in five languages
    ("A large effusion distends the joint.", "Effusion", 1.0),
    ("Hay un derrame abundante.", "Effusion", 1.0),
    ("Eklemde yaygin efuzyon vardir.", "Effusion", 1.0),
    ("Massiver Erguss im Recessus.", "Effusion", 1.0),
    ("Ruime hydrops.", "Effusion", 1.0),
    ("The knee is without effusion.", "Effusion", 0.0),
    ("Ausencia de derrame.", "Effusion", 0.0),
    ("Efuzyon yok.", "Effusion", 0.0),
    ("Ohne Erguss.", "Effusion", 0.0),
    ("Zonder hydrops.", "Effusion", 0.0),
    ("A fractured fibular head.", "Fracture", 1.0),
    ("Botbreuk van de patella.", "Fracture", 1.0),
    ("Kirik hatti goruldu.", "Fracture", 1.0),
    ("Negative for fracture.", "Fracture", 0.0),
    ("Se descarta fractura.", "Fracture", 0.0),
    ("Fraktur nicht erkennbar.", "Fracture", 0.0),
    # an exception inside the word keeps a positive positive
    ("A non-displaced fracture runs through the fibula.", "Fracture", 1.0),
    # hedges and negated significance leave a column open
    ("Suspected fracture of the patella.", "Fracture", None),
    ("Mogelijk een fractuur.", "Fracture", None),
    ("A tiny effusion.", "Effusion", None),
    ("Without a relevant effusion.", "Effusion", None),
    ("Kein relevanter Erguss.", "Effusion", None),
    # contradiction, and clauses that are read apart
    ("An effusion was drained. Later without effusion.", "Effusion", None),
    ("Without effusion, however a fracture is there.", "Effusion", 0.0),
    ("Without effusion, however a fracture is there.", "Fracture", 1.0),
    # structures need a cue near by; one is absent when only named
    ("The medial meniscus was imaged in two planes.", "Medial Meniscus", None),
    ("Radial tear through the body of the medial meniscus.", "Medial Meniscus", 1.0),
    ("Medial meniscus preserved, lateral meniscus ruptured.", "Medial Meniscus", 0.0),
    ("Medial meniscus preserved, lateral meniscus ruptured.", "Lateral Meniscus", 1.0),
    ("Desgarro del menisco externo.", "Lateral Meniscus", 1.0),
    ("Innenmeniskuslasion im Hinterhorn.", "Medial Meniscus", 1.0),
    ("Dis menisk saglam.", "Lateral Meniscus", 0.0),
    ("The ACL is disrupted.", "ACL", 1.0),
    ("VKB durchtrennt.", "ACL", 1.0),
    ("The ACL was assessed.", "ACL", 0.0),
    ("Voorste kruisband intact.", "ACL", 0.0),
    ("Medial collateral ligament normal.", "MCL", 0.0),
    ("Popliteal cyst of 3 cm.", "Baker's", 1.0),
    ("Florid synovitis.", "Synovitis", 1.0),
    ("Kontusion am Femurkondylus.", "Contusion", 1.0),
    ("Marrow edema after a direct impact.", "Contusion", 1.0),
    ("Marrow edema of the patella.", "Contusion", None),
    # compartments come from the clause, or from the last header above it
    ("Retropatellar chondropathy.", "PF OA", 1.0),
    ("Osteophytes along the lateral joint line.", "Lateral OA", 1.0),
    ("LATERAL SIDE:\nCartilage thinning.\nPATELLA:\nCartilage normal.", "Lateral OA", 1.0),
    ("LATERAL SIDE:\nCartilage thinning.\nPATELLA:\nCartilage normal.", "PF OA", 0.0),
    ("Fissures of the patellar cartilage on its medial facet.", "Medial OA", None),
    ("Fissures of the patellar cartilage on its medial facet.", "PF OA", 1.0),
    ("Kraakbeenverlies mediaal.", "Medial OA", 1.0),
    ("Medial cartilage: preserved.", "Medial OA", 0.0),
    ("Questionable cartilage defect, lateral.", "Lateral OA", None),
    # nothing to read
    ("", "Effusion", None),
    (None, "Fracture", None),
    ("?? 7/8 --", "ACL", None),
]


@pytest.fixture(scope="module")
def labelled(spark):
    docs = spark.createDataFrame([(k, t) for k, (t, _, _) in enumerate(CASES)], "doc_id long, text string")
    return {(r["doc_id"], r["column"]): r["label"] for r in label_reports(docs).collect()}


def test_reports(labelled):
    wrong = [(t, c, labelled[k, c], y) for k, (t, c, y) in enumerate(CASES) if labelled[k, c] != y]
    assert not wrong


def test_plain_form(spark):
    rows = ["Ödème CRÂNIEN", "Äußere  Bänder", "Straße  İı\nøđł Ελλάδα", None, ""]
    out = spark.createDataFrame([(t,) for t in rows], "t string").select(normalize(F.col("t")).alias("n"), normalize_exact("t").alias("x")).collect()
    assert [r.n for r in out] == [r.x for r in out]
    assert out[0].n == "odeme cranien" and out[1].n == "aussere bander" and out[3].n == ""


def test_language(spark):
    rows = [("the dog and the cat are in the house", "en"), ("der Hund und die Katze ist nicht da", "de"), ("Η εικόνα είναι καλή", "el"), ("Снимок сделан хорошо", "ru"), ("a b", "unknown"), (None, "unknown"), ("het is geen hond van mij", "nl")]
    got = with_language(spark.createDataFrame([(t,) for t, _ in rows], "t string"), "t", "l").collect()
    assert [r.l for r in got] == [y for _, y in rows]


def test_other_scripts_keep_the_guard(spark):
    """Alternatives in Greek and Cyrillic letters have literal parts too, and short or open ones don't take the guard from the rest."""
    from tallow.operators import votes

    assert votes.literal_parts(r"\bcruciat\w*|σταυρ|крест") == ["cruciat", "σταυρ", "крест"]
    assert votes.literal_run(r"abc?d{2}\w") == "" and votes.literal_run(r"(?:tear|rupture) of acl\w*") == " of acl"
    assert [p for p in votes.mention_patterns().values() if any(len(votes.literal_run(a)) < 3 for a in votes.alternatives(p))] == []
    pattern = r"\bcruciat\w*|υγρ|\bx[12]\b|\b(?:an|no)\b"
    texts = ["the cruciate", "το υγρο", "x2", "x3", "an end", "and", "", "ligament крест", None]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = [r.a for r in rows.select("k", votes.says(F.col("t"), pattern).alias("a")).orderBy("k").collect()]
    assert got == [True, True, True, False, True, False, False, False, None]


HOSTILE = [
    None, "", " \t\n", ".,;:", "but", ":\n:", "Effusion", "no effusion;but fracture,however ACL torn", "an effusion,but.no fracture", "joint:space loss, medial", "Medial:\tjoint\tspace loss",
    "LATERAL SIDE:\r\nCartilage\tthinning\rPATELLA: no cartilage loss", "Médial: chondropathie\nÖdem, Ergüsse; kıkırdak kaybı", "Το αρθρο, крестообразная связка: acl разрыв", "medial\nmeniscus\ttear", "acĺ torn. ́but acl intact",
    "Knorpel:\nVerlust\nmedial: Knorpel Verlust, aber Knorpel normal lateral", "bone bruise but no effusion " + "x " * 90 + "acl torn", "σταυρ", "λίγο υγρό", "straße acł torn, VKB gerissen; Riss",
]


def test_one_pass_reads_what_its_parts_read(spark):
    """Labels and mentions of one pass over the plain texts are those of clauses, lines and texts read one by one, on odd white space, marks and letters too."""
    from tallow.functions.text import split_clauses
    from tallow.operators import votes

    texts = [*HOSTILE, *(f"{a}{sep}{b}" for a in HOSTILE[6:] for b in HOSTILE[6:] for sep in ("\n", " but "))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    # plainly: every clause votes, no line and no clause is dropped
    clauses = votes.with_flags(votes.with_places(docs.select("doc_id", F.explode(split_clauses(normalize(F.col("text")), votes.U + votes.Cues().clause_ends)).alias("clause")).withColumn("ascii", votes.is_ascii(F.col("clause"))), votes.FINDINGS), votes.Cues())
    own = votes.long_labels(clauses.select("doc_id", *[votes.vote(f, k).alias(f"v{k}") for k, f in enumerate(votes.FINDINGS)]), [f.column for f in votes.FINDINGS])
    want = {(r.doc_id, r.column): r.label for r in own.collect()} | {(r.doc_id, r.column): r.label for r in votes.label_compartments(docs).collect()}
    hints = {c: "|".join(f"(?:{a})" for a in votes.alternatives(p)) for c, p in votes.mention_patterns().items()}
    seen = {r.doc_id: r for r in docs.select("doc_id", *[normalize(F.col("text")).rlike(votes.U + p).alias(c) for c, p in hints.items()]).collect()}
    got = votes.labels_and_mentions(docs).collect()
    assert len(got) == 12 * len(texts) and len({(r.doc_id, r.column) for r in got}) == len(got)
    assert [r for r in got if r.label != want.get((r.doc_id, r.column)) or r.mentioned != seen[r.doc_id][r.column]] == []
    assert {(r.doc_id, r.column): r.label for r in votes.label_reports(docs).collect()} == {(r.doc_id, r.column): r.label for r in got}
    assert {(r.doc_id, r.column): r.mentioned for r in votes.mentioned(docs).collect()} == {(r.doc_id, r.column): r.mentioned for r in got}
    assert sum(r.label is not None for r in got) > 500


def test_ceiling_reads_the_texts_once(spark, sf):
    from tallow.plans.registry import QUERIES

    for name in ("finding_ceiling", "finding_labels"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan parquet") == 1 and "Join" not in plan


def test_reports_are_cut_in_one_search(spark):
    """Only stretches and lines that may hold a term leave the one search for all words, and labels are those of clauses and lines read one by one, whatever marks and white space stand in a term."""
    import pyarrow as pa
    import pyarrow.compute as pc

    from tallow.functions.text import loose
    from tallow.operators import votes

    held = {"aussenmenisk": ["außenmenisk", "áußénmeniśk", "auśs࢘enmenisk"], "synovit": ["ßynovit", "ŝÿnòvit", "synovít́"], "kirik": ["kırık"], "erguss": ["erguß", "ergüsse"]}
    for word, texts in held.items():
        assert pc.all(pc.match_substring_regex(pa.array([word, *texts]), loose(word))).as_py(), word
        assert not pc.any(pc.match_substring_regex(pa.array(["", word[1:], word[:2] + "x" + word[2:]]), loose(word))).as_py(), word
    filler = "nothing of note, " * 400
    texts = [
        f"{filler}\nPATELLA:\n{filler}\nno cartilage loss. {filler}", f"{filler} Ergüß; {filler}", "the ACL is\x85torn;no effusion", "Médial: Cartílage thinńing\x0b\x0cPATELLA:\r\ncartilage\t\t normal\rLATERAL: chondr࢘opathy",
        "Kirik, KIRIK", "İnnenband gerissen; Riss", "medial\r\n 　meniscus, no.tear", "AĆĹ torn", "a࢘cl torn but no fracture", "Knorpel Verlust medial:\x1cΣΑΣ", "ﬁssur cartilage ﬀ: loss", None, "", "ß", "joint space loss: medial", filler,
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {(r.doc_id, r.column): r.label for part in (votes.label_findings(docs), votes.label_compartments(docs)) for r in part.collect()}
    got = votes.label_reports(docs).collect()
    assert len(got) == 12 * len(texts) and [r for r in got if r.label != want.get((r.doc_id, r.column))] == []
    assert sum(r.label is not None for r in got) > 10
    said = [p for f in votes.FINDINGS for p in (f.alone, f.structure) if p]
    spec = votes.OSTEOARTHRITIS
    rows = votes.cut(docs.select("doc_id", F.lower("text").alias("t")), "t", said, [spec.explicit, spec.cartilage])
    kinds = {k: sum(r.kind == k and r.doc_id in (0, 1, 15) for r in rows.collect()) for k in (0, 1, 2)}
    assert kinds == {0: 1, 1: 2, 2: 3}
