"""Hard negatives, line deduplication and source divergence: hostile rows against SQL and brute force, and the ways that only larger inputs take."""

from __future__ import annotations

import collections
import hashlib
import math
import random

import brute
import duckdb
import pytest
from pyspark.sql import functions as F

from tallow.llm import divergence, hard_negatives, line_dedup, oracles, queries


@pytest.fixture(scope="module")
def hostile(spark, sf, tmp_path_factory):
    """Nulls, ties, repeated and empty rows, a hot key, very long texts, and extra columns with clashing names."""
    out, rng = f"file://{tmp_path_factory.mktemp('audits')}", random.Random(3)
    lines = ["The same footer line, everywhere.", "\t the SAME footer line, everywhere.\r", "short", "äöüß éèê ñõã çğş łøđ žšč", "exactly nineteen ch", "exactly twenty chars", "İstanbul'da bir satır daha var", ""]
    rows = [(k % 70 if k % 9 else None, "\n".join(rng.choices(lines, k=rng.randrange(6))) + f"\nonly {k}", ["en", "de", None, ""][k % 4], ["a", "b", "c", None, "ä b"][k * k % 5]) for k in range(150)]
    rows += [(500 + k, f"alpha beta Gamma{k % 3} and {'delta ' * (k % 4)}", "en", f"s{k % 7}") for k in range(120)]
    rows += [(9000, None, "en", "a"), (9001, "", "xx", "lonely"), (9002, None, None, None), (9003, "\n\n", "en", "hot"), (9004, "word ÄÖ\x0bTAB\tÖ1x2 " * 30_000 + "\n" + lines[0], "en", "hot")]
    rows += [rows[3]] * 40
    spark.createDataFrame([(i, t, la, s, 0) for i, t, la, s in rows], "doc_id long, text string, lang string, source string, n_chars long").withColumns({"row": F.lit(1), "key": F.lit("x"), "p": F.lit("y"), "line": F.lit(0), "keep": F.lit(None).cast("string")}).repartition(5).write.parquet(f"{out}/documents.parquet")
    vec = lambda: [rng.choice([0.5, -0.25, 0.0, 0.001, rng.uniform(-1, 1)]) for _ in range(4)]
    vectors = [(k, vec(), k % 3) for k in range(0, 900, 3)] + [(100, vec(), 1)] * 2 + [(700, vec(), 2), (None, vec(), 1), (None, vec(), 0), (1001, None, 1), (1002, vec(), None), (1003, [0.1, None, 0.2, 0.3], 1), (1004, [math.nan, 0.1, 0.1, 0.1], 1), (1005, [math.inf, 0.1, 0.1, 0.1], 2), (1100, [0.0] * 4, 5), (-200, vec(), 1)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").withColumns({"id": F.lit("x"), "row": F.lit(0), "block": F.lit("b"), "v": F.lit(2.0)}).write.parquet(f"{out}/embeddings.parquet")
    return out


@pytest.fixture(scope="module")
def db(hostile):
    con = duckdb.connect()
    for name in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{hostile.removeprefix('file://')}/{name}.parquet/*.parquet'")
    return con


def by_sql(db, name, columns):
    return sorted(map(str, db.execute(f"SELECT {', '.join(columns)} FROM ({oracles.ORACLES[name]})").fetchall()))


def as_rows(df):
    return sorted(str(tuple(r)) for r in df.collect())


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_line_dedup", "op13_divergence"])
def test_sql_on_hostile_rows(spark, hostile, db, name):
    df = queries.QUERIES[name](spark, hostile)
    assert as_rows(df) == by_sql(db, name, df.columns)


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_line_dedup", "op13_divergence"])
def test_empty_tables(spark, hostile, tmp_path, name):
    for t in ("documents", "embeddings"):
        spark.read.parquet(f"{hostile}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert queries.QUERIES[name](spark, f"file://{tmp_path}").count() == 0


def test_hard_negatives_by_brute_force(spark, hostile, monkeypatch):
    """Small blocks and strips, so that runs are merged."""
    monkeypatch.setattr(hard_negatives, "BLOCK", 37)
    monkeypatch.setattr(hard_negatives, "STRIP", 3)
    monkeypatch.setattr(hard_negatives, "SCORES", 100)
    rows = [(r.vec_id, r.label, r.embedding) for r in spark.read.parquet(f"{hostile}/embeddings.parquet").collect()]
    got = queries.op11_hard_negatives(spark, hostile)
    assert as_rows(got) == sorted(map(str, brute.hard_negatives(rows)))


def test_vectors_of_several_lengths_and_large_components(spark):
    rows = spark.createDataFrame([(0, [1.0, 2.0], 1), (1, [1.0], 1), (2, [0.5, 0.0, 9.0], 2), (3, [], 1)], "vec_id long, embedding array<double>, label int")
    got = [tuple(r) for r in hard_negatives.mine_hard_negatives(rows, F.col("vec_id") == 0).collect()]
    assert got == [(0, 1, 1, 2, 65536, 32768)]
    for size in (3e5, 1e300):
        large = spark.createDataFrame([(0, [size], 1), (1, [size], 1), (2, [size], 2)], "vec_id long, embedding array<double>, label int")
        if size < 1e6:  # beyond 2**53 integers take the place of doubles
            assert hard_negatives.mine_hard_negatives(large, F.col("vec_id") == 0, high=100).first().negative_score == (256 * 300_000) ** 2
        else:
            with pytest.raises(Exception, match="2\\*\\*56"):
                hard_negatives.mine_hard_negatives(large, F.col("vec_id") == 0)


def test_a_hot_line_over_many_ranges(spark):
    """A key that fills several ranges, and one whose few documents meet the range's end."""
    rows = [(k, "a very common line of text\nand one more common line\n" + f"a line of document {k // 2} alone") for k in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 3, 40):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            got = [tuple(r) for r in line_dedup.dedup_lines(docs).orderBy("doc_id").collect()]
            assert got == brute.line_dedup(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("size", [1, 2, 3, 5, 8, 1000])
def test_streams_of_every_batch_and_range_size(size):
    """Rows of one sorted input, in batches of any size, in one to four ranges."""
    import pyarrow as pa

    rng = random.Random(size)
    rows = sorted({(rng.randrange(6), 0, -rng.randrange(5), rng.randrange(2), rng.randrange(4)) for _ in range(60)})
    per = collections.defaultdict(set)
    for h, _, d, _, _ in rows:
        per[h].add(-d)
    want = {(h, d, t, line) for h, _, d, t, line in rows if len(per[h]) >= 3 and -d < max(per[h])}
    for ranges in range(1, 5):
        step = -(-len(rows) // ranges)
        marks = []
        for low in range(0, len(rows), step):
            s, part = line_dedup.Stream(3), rows[low : low + step]
            for at in range(0, len(part), size):
                h, z, d, t, line = (list(x) for x in zip(*part[at : at + size], strict=True))
                s.batch(pa.RecordBatch.from_pydict({"doc_id": pa.array([-x for x in d], pa.int64()), "text_hash": pa.array(t, pa.int64()), "lines": pa.array([9] * len(h), pa.int32()), "line": pa.array(line, pa.int32()), "high": pa.array(h, pa.int64()), "low": pa.array(z, pa.int64())}))
            s.close(last=True)
            marks += [r for b in s.drain() for r in b.to_pylist()]
        # rows that go aren't told by key here, so positions are made unique by it below
        seen = collections.defaultdict(set)
        for r in marks:
            if r["kind"] == line_dedup.SEEN:
                seen[r["high"]].add(r["doc_id"])
        gone = {(r["high"], -r["doc_id"], r["text_hash"], r["line"]) for r in marks if r["kind"] == line_dedup.GONE}
        gone |= {(r["high"], -r["doc_id"], r["text_hash"], r["line"]) for r in marks if r["kind"] == line_dedup.OPEN and len(seen[r["high"]]) >= 3 and r["doc_id"] < max(seen[r["high"]])}
        assert gone == want


def test_bitmaps_give_back_the_text(spark, hostile):
    docs = spark.read.parquet(f"{hostile}/documents.parquet")
    maps = {(r.doc_id, r.text_hash): r for r in line_dedup.keep_bitmaps(docs).collect()}
    assert maps and all(r.n_dropped > 0 for r in maps.values())
    want = collections.Counter(brute.line_dedup([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]))
    got = collections.Counter()
    for r in line_dedup.keyed(docs).collect():
        text, lines, gone = line_dedup.kept_text(r.text.encode(), maps[r.doc_id, r.text_hash].keep if (r.doc_id, r.text_hash) in maps else None)
        got[r.doc_id, lines, gone, hashlib.sha256(text).hexdigest()] += 1
    assert got == want


def test_divergence_by_cells(spark, hostile, db, monkeypatch):
    monkeypatch.setattr(divergence, "CELL", 2)
    df = queries.op13_divergence(spark, hostile)
    assert as_rows(df) == by_sql(db, "op13_divergence", df.columns)


def test_divergence_by_brute_force(spark, hostile):
    docs = spark.read.parquet(f"{hostile}/documents.parquet")
    rows = [(r.text, r.lang, r.source) for r in docs.select("text", "lang", "source").collect()]
    for documents, terms in ((30, 50), (2, 3), (10_000, 50)):
        got = [tuple(r) for r in divergence.source_divergence(docs, documents, terms).collect()]
        assert sorted(got) == sorted(brute.divergence(rows, documents, terms))


def test_shares_are_exact(spark):
    rows = [(0, 1), (0, 15), (7, 29), (10**12, 3 * 10**12 + 7), (4 * 10**14, 9 * 10**15), (9 * 10**15 - 5, 9 * 10**15), (3, 999_999_937)]
    got = [r.x for r in spark.createDataFrame(rows, "c long, t long").coalesce(1).select(divergence.share(F.col("c"), F.col("t")).alias("x")).collect()]
    assert got == [1 + 10**9 * (c + 5) // t for c, t in rows]
