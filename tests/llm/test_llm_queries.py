"""The operators against plain versions, on the smallest tables with hostile rows added."""

from __future__ import annotations

import math
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallow.llm import oracles, packing, queries, substring_dedup, toxicity, warc
from tallow.llm import media as media_module

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def hostile(spark, sf, tmp_path_factory):
    """The tables with nulls, empty and repeated rows, ties, a long text and an extra column that clashes."""
    out = f"file://{tmp_path_factory.mktemp('hostile')}"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()
    rows = [tuple(r) for r in docs]
    long_text = " ".join(docs[k].text for k in range(40)) * 3
    passage = " ".join(f"Word{k}" for k in range(80))
    extra = [(None, "null id " + passage), (9001, None), (9002, ""), (9003, "  \n\t "), (9004, long_text), (9005, "x " + passage + " y"), (9006, "z " + passage), (9006, "other " + passage), (9007, passage), (9007, passage), (9008, "   a b İΣ")]
    rows += [(i, t, None, None, None) for i, t in extra]
    spark.createDataFrame(rows, SCHEMA).withColumn("_tk", F.lit(1)).withColumn("component_id", F.lit("c")).withColumn("row", F.lit(0)).write.parquet(f"{out}/documents.parquet")
    for name in ("labels", "benchmark", "pages"):
        spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(f"{out}/{name}.parquet")
    return out


@pytest.fixture(scope="module")
def empty(spark, sf, tmp_path_factory):
    out = f"file://{tmp_path_factory.mktemp('empty')}"
    for name in ("documents", "labels", "benchmark", "pages", "embeddings"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(f"{out}/{name}.parquet")
    return out


def texts(spark, folder):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]


def ordered(rows):
    return sorted([tuple(round(x, 5) if isinstance(x, float) else x for x in r) for r in rows], key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name,plain", [("op2_substring_dedup", brute.substring_dedup), ("op4_media", brute.media), ("op5_lm_score", brute.base_scores), ("op6_simhash", brute.simhash)])
def test_against_brute_force(spark, hostile, name, plain):
    want = plain(texts(spark, hostile))
    got = [tuple(r)[: len(want[0])] for r in queries.QUERIES[name](spark, hostile).collect()]
    assert ordered(got) == ordered(want)


def test_decontamination(spark, hostile):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{hostile}/benchmark.parquet").collect()]
    got = queries.op8_decontamination(spark, hostile).collect()
    assert ordered(map(tuple, got)) == ordered(brute.decontaminate(texts(spark, hostile), items))
    from tallow.llm.decontamination import decontaminate

    docs, bench = (spark.read.parquet(f"{hostile}/{n}.parquet") for n in ("documents", "benchmark"))
    assert ordered(map(tuple, decontaminate(docs, bench, block_windows=300).collect())) == ordered(map(tuple, got))


def test_packing(spark, hostile):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_vocabulary())
    rows = queries.op1_packing(spark, hostile).collect()
    want = []
    for i, t in texts(spark, hostile):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        want += [(i, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes())) for k in range(0, len(ids), 2048)]
    assert ordered((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == ordered(want)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for v in by.values():
        at = 0
        for offset, n in sorted(v):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(by) <= brute.best_fit_decreasing([r.length for r in rows], 2048) * 1.005 + 1


@pytest.mark.parametrize("kind", ["uniform", "middle", "short", "third", "mixed"])
def test_packing_rounds(spark, kind):
    """As few sequences as best-fit decreasing one piece after the other, within a half per cent, gapless, every piece once."""
    rng = np.random.default_rng(3)
    lengths = {"uniform": rng.integers(1, 2049, 3000), "middle": rng.integers(500, 900, 3000), "short": rng.integers(1, 60, 4000), "third": np.r_[np.full(1500, 700), rng.integers(1, 2049, 1500)], "mixed": np.minimum(rng.exponential(500, 3000).astype(int) + 1, 2048)}[kind]
    table = spark.createDataFrame([(i, 0, int(n), "x") for i, n in enumerate(lengths)], "doc_id long, piece int, length long, _rank string")
    by, seen = {}, set()
    for r in packing.pack(table).collect():
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
        seen.add((r.doc_id, r.length))
    assert seen == {(i, int(n)) for i, n in enumerate(lengths)}
    for v in by.values():
        ends = np.cumsum([n for _, n in sorted(v)])
        assert [o for o, _ in sorted(v)] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert len(by) <= brute.best_fit_decreasing(lengths.tolist(), 2048) * 1.005 + 1


def test_warc(spark, tmp_path):
    rows = [(1, "http://a/ b", "same"), (2, None, "same"), (3, "x", None), (4, "y", ""), (None, "z", "same"), (5, "u\nv", "<p>\x1f\x8b\x08</p>" * 50000), (6, "ü", "é" * 9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = f"file://{tmp_path}/archives"
    manifest = warc.write_archives(warc.with_revisits(pages), folder)
    for size in (1000, 4 << 20):
        back = warc.read_archives(manifest, size, with_payload=True).collect()
        got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back]
        assert ordered(got) == ordered(brute.warc([(i, h) for i, _, h in rows]))
    assert {r.page_id: r.payload for r in back if r.record_type == "response" and r.page_id}[5] == rows[5][2].encode()


def test_damaged_archives(spark, tmp_path):
    """A member that is cut off or changed, junk between members, and an archive with fewer records than its manifest are errors, whatever the ranges."""
    pages = spark.createDataFrame([(i, f"http://p/{i}", f"<p>{i}</p>" * 2000) for i in range(9)], "page_id long, url string, html string").coalesce(1)
    manifest = warc.write_archives(warc.with_revisits(pages).coalesce(1), f"file://{tmp_path}/whole").first()
    whole = open(manifest.path.removeprefix("file://"), "rb").read()
    starts = [k for k in range(len(whole)) if whole[k : k + 3] == warc.MAGIC]
    cases = {"cut": whole[:-40], "changed": whole[: starts[4] + 300] + bytes([whole[starts[4] + 300] ^ 255]) + whole[starts[4] + 301 :], "junk": whole[: starts[3]] + b"junk" + whole[starts[3] :]}
    for name, data in cases.items():
        path = tmp_path / f"{name}.warc.gz"
        path.write_bytes(data)
        for size in (500, 1 << 20):
            with pytest.raises(Exception, match="member|no record|EOF"):
                warc.read_archives(spark.createDataFrame([(f"file://{path}", len(data), 9)], "path string, bytes long, records long"), size).collect()
    fewer = spark.createDataFrame([(manifest.path, manifest.bytes, 10)], "path string, bytes long, records long")
    assert warc.missing_records(fewer, warc.read_archives(fewer)) == 1


def test_warc_on_hostile_pages(spark, tmp_path_factory):
    out = f"file://{tmp_path_factory.mktemp('pages')}"
    rows = [(1, None, None, "c"), (None, "u", "x", "c"), (2, "u", "", "c"), (2, "u", "", "d"), (3, "v", "é" * 200_000, "c"), (4, "w", "é" * 200_000, None)]
    spark.createDataFrame(rows, "page_id long, url string, html string, d string").write.parquet(f"{out}/pages.parquet")
    assert ordered(map(tuple, queries.op3_warc(spark, out).collect())) == ordered(brute.warc([(i, h) for i, _, h, _ in rows]))


def test_sniffing():
    import gzip

    wav, gz = media_module.to_wav(b"\0" * 64), gzip.compress(b"inside" * 20)
    assert media_module.sniff(wav) == [("audio/wav", 0, len(wav))]
    assert media_module.sniff(b"junk" + gz + b"BM" + b"%PDF-" + wav) == [("application/gzip", 4, len(gz)), ("audio/wav", 4 + len(gz) + 7, len(wav))]
    assert media_module.sniff(b"RIFF\xff\xff\xff\xffWAVE") == [] and media_module.sniff(b"") == []


PNG = b"\x89PNG\r\n\x1a\n" + b"".join(len(d).to_bytes(4, "big") + k + d + zlib.crc32(k + d).to_bytes(4, "big") for k, d in ((b"IHDR", bytes([0, 0, 0, 1, 0, 0, 0, 1, 8, 0, 0, 0, 0])), (b"IDAT", zlib.compress(b"\0\0")), (b"IEND", b"")))
BMP = b"BM" + (58).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + (1).to_bytes(4, "little") * 2 + b"\x01\0\x18\0" + bytes(24) + bytes(4)
GIF = b"GIF89a" + b"\x01\0\x01\0\x80\0\0" + bytes(6) + b"\x2c" + bytes(4) + b"\x01\0\x01\0\0" + b"\x02\x02\x44\x01\0" + b"\x3b"


def _flac():
    head = b"\xff\xf8\x19\x08\x00"
    frame = head + bytes([media_module.crc(head, media_module.CRC8, 8)]) + b"\0\1\2"
    frame += media_module.crc(frame, media_module.CRC16, 16).to_bytes(2, "big")
    info = (192).to_bytes(2, "big") * 2 + bytes(6) + (44100 << 44 | 15 << 36 | 192).to_bytes(8, "big") + bytes(16)
    return b"fLaC\x80\0\0\x22" + info + frame


def _ogg():
    pages = b""
    for k in (0, 1):
        page = b"OggS\0" + bytes([2 if k == 0 else 4]) + bytes(8) + b"\1\0\0\0" + k.to_bytes(4, "little") + bytes(4) + b"\1\5" + b"hello"
        pages += page[:22] + media_module.crc(page, media_module.CRC32, 32).to_bytes(4, "little") + page[26:]
    return pages


def _riff(kind):
    return b"RIFF" + (16).to_bytes(4, "little") + kind + b"abcd" + (3).to_bytes(4, "little") + b"xyz\0"


def _boxes():
    return (16).to_bytes(4, "big") + b"ftypisom" + bytes(4) + (1).to_bytes(4, "big") + b"mdat" + (20).to_bytes(8, "big") + b"data" + (8).to_bytes(4, "big") + b"moov"


JPEG = b"\xff\xd8\xff\xe0\0\4JF" + b"\xff\xda\0\3\0" + b"\1\2\xff\0\3\xff\xd0\4" + b"\xff\xd9"
PDF = b"%PDF-1.4\nbody\nstartxref\n9\n%%EOF\nupdate startxref\n20\n%%EOF"
SOUND = [("image/png", PNG), ("image/bmp", BMP), ("image/gif", GIF), ("image/jpeg", JPEG), ("image/webp", _riff(b"WEBP")), ("video/avi", _riff(b"AVI ")), ("audio/flac", _flac()), ("audio/ogg", _ogg()), ("video/mp4", _boxes()), ("application/pdf", PDF)]


def test_check_sums():
    assert media_module.crc(b"123456789", media_module.CRC8, 8) == 0xF4 and media_module.crc(b"123456789", media_module.CRC16, 16) == 0xFEE8


@pytest.mark.parametrize("kind,data", SOUND)
def test_validators(kind, data):
    """A sound sample is found with its length among other bytes; one that is cut off isn't found, nor one with a broken check sum."""
    assert media_module.sniff(b"ab" + data + b"tail") == [(kind, 2, len(data))]
    whole = media_module.to_wav(bytes(64))
    assert media_module.sniff(data + whole) == [(kind, 0, len(data)), ("audio/wav", len(data), len(whole))]
    assert (kind, 0, len(data)) not in media_module.sniff(data[:-1])
    if kind in ("image/png", "audio/flac", "audio/ogg"):
        assert not media_module.sniff(data[:-9] + bytes([data[-9] ^ 255]) + data[-8:])


def test_media_is_stored(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    out = media_module.media_column(docs)
    (path,) = {f.rsplit("/", 1)[0] for f in out.inputFiles()}
    stored = {r.doc_id: bytes(r.media) for r in spark.read.parquet(path).collect()}
    assert stored == {1: media_module.to_wav(media_module.pad(b"some text")), 2: media_module.to_wav(media_module.pad(b""))}
    assert {r.doc_id: r.media_bytes for r in out.collect()} == {k: len(v) for k, v in stored.items()}


def test_language_model_beats_base(spark):
    rows = queries.op5_lm_score(spark, "/root/testdata/sf0.01").where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_unit_probabilities():
    """After any context all units' probabilities sum to one, whatever the vectors, and equal the plain two-level softmax."""
    from tallow.llm import language_model as lm

    units = lm.Units(37)
    model = lm.Model(units, np.arange(units.n, dtype=float))
    rng = np.random.default_rng(5)
    for name in ("group_out", "out", "ctx"):
        getattr(model, name)[:] = rng.normal(0, 1.5, getattr(model, name).shape)
    every = np.arange(units.n)
    for one, two in ((0, 5), (36, units.end), (units.end, units.end)):
        log = model.log_p(every, np.full(units.n, one), np.full(units.n, two))
        assert np.exp(log).sum() == pytest.approx(1, abs=1e-5)
        q = model.ctx[one] * model.place[0] + model.ctx[two] * model.place[1]
        groups = np.exp(model.group_out @ q + model.group_bias)
        own = np.exp(model.out @ q + model.bias).reshape(units.groups, units.size)
        want = (groups / groups.sum())[:, None] * own / own.sum(1, keepdims=True)
        assert np.allclose(np.exp(log), want.ravel()[: units.n], atol=1e-5)


def test_scores_of_a_language_sum_to_one(spark):
    """Over the empty text, all words of the training texts and an unknown word of each rare unit, the first word's probabilities (scores without the end's factor) sum to one."""
    lm = queries.language_model
    docs = [(1, "a b a c"), (2, "b a"), (4, "c c d"), (5, " ".join(f"w{k}" for k in range(60)))]
    known = sorted({w for _, t in docs for w in t.split()})
    units = lm.corpus_counts(spark.createDataFrame(docs, "doc_id long, text string"))[0].units
    unknown: dict[int, str] = {}
    for k in range(5000):
        unknown.setdefault(units.rare_unit(f"zz{k:04d}".encode()), f"zz{k:04d}")
    assert len(unknown) == units.rare
    probes = ["", *known, *unknown.values()]
    table = spark.createDataFrame(docs + [(100 + k, w) for k, w in enumerate(probes)], "doc_id long, text string").coalesce(1).withColumn("held_out", F.col("doc_id") >= 100)
    rows = {r.doc_id: r for r in lm.score(table, F.col("doc_id") >= 100).collect()}
    counts = lm.corpus_counts(table.where("NOT held_out"))[0]
    encoded = lm.encode(table, counts).withColumn("row", F.lit(0))
    model = lm.train(encoded, counts)
    blobs = {r.doc_id: np.frombuffer(r.units, "<i4").astype(np.int64) for r in encoded.collect()}
    total = 0.0
    for k, w in enumerate(probes):
        tokens = blobs[100 + k]
        assert tokens[-1] == units.end and len(tokens) == 1 + bool(w)
        one, two = lm._context(tokens, np.array([0]), units.end)
        end = model.log_p(tokens[-1:], one[-1:], two[-1:])[0] / math.log(10) if w else 0.0
        total += 10 ** (rows[100 + k].score - end)
        assert rows[100 + k].n_known == 1 + (w in known)
    assert total == pytest.approx(1, abs=1e-4)
    # and a longer text is the product of its tokens' shares
    tokens = blobs[2]
    log = model.log_p(tokens, *lm._context(tokens, np.array([0]), units.end)).sum() / math.log(10)
    table_n = {"a": 3, "b": 2}
    for w in ("b", "a"):
        u = counts.units.rare_unit(w.encode())
        if w.encode() not in counts.head:
            log += math.log10(table_n[w] + 0.5) - counts.rare_log[u - units.head]
    assert rows[2].score == pytest.approx(log, abs=1e-4)


def test_ids_of_repeated_shingles_at_many_parts(spark):
    """At so many shingles that parts need more than 16 bits, ids still tell different shingles apart."""
    from tallow.llm import simhash

    texts = [f"{k} common words in every text of this group {k % 3} and a tail {k}" for k in range(12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    many = simhash.repeated_shingles(docs, 3, simhash.PART_SHINGLES << 18)
    words = [t.split() for t in texts]
    sets = [{tuple(w[k : k + 3]) for k in range(len(w) - 2)} for w in words]
    shared = {g for s in sets for g in s if sum(g in x for x in sets) > 1}
    found = {bytes(r.ids)[k : k + 8] for r in many.collect() for k in range(0, len(r.ids), 8)}
    assert len(found) == len(shared)
    with pytest.raises(ValueError):
        simhash.repeated_shingles(docs, 3, simhash.PART_SHINGLES << 30)


def test_limits_and_quantiles(spark):
    from tallow.llm import token_counts

    lens = [0, 1, 1, 5, 9, 9, 9, 5000, 9000]
    sums = token_counts.suffix_sums(token_counts.length_histogram(spark.createDataFrame([(n,) for n in lens], "n_tokens long")))
    for limit in (0, 1, 2, 9, 10, 4999, 5000, 8999, 9000, 10**6):
        got = token_counts.kept_at(sums, limit).first()
        assert (got.docs_ge, got.kept_tokens) == (sum(n >= limit for n in lens) if any(n >= limit for n in lens) else 0, sum(min(n, limit) for n in lens))
    for q in (0.01, 0.3, 0.5, 0.9, 1.0):
        assert token_counts.quantile(sums, q).first().n_tokens == sorted(lens)[math.ceil(q * len(lens)) - 1]


def test_token_counts(spark, hostile):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_vocabulary())
    lens = [len(tok.encode(t or "", add_special_tokens=False).ids) for _, t in texts(spark, hostile)]
    for r in queries.op9_token_counts(spark, hostile).collect():
        assert (r.n_docs, r.docs_ge) == (lens.count(r.n_tokens), sum(n >= r.n_tokens for n in lens))
        assert r.kept_tokens == sum(min(n, r.n_tokens) for n in lens)
        assert r.quantile == pytest.approx(sum(n <= r.n_tokens for n in lens) / len(lens))


@pytest.mark.parametrize("cut", [(7,), (3, 9), (1, 2, 60)])
def test_batches_against_an_index(spark, hostile, tmp_path, cut):
    """Batches in order of doc_id against a reopened index give what the whole table gives."""
    docs = spark.read.parquet(f"{hostile}/documents.parquet").where("doc_id IS NOT NULL")
    edges = [-1, *cut, 10**9]
    got = []
    for low, high in zip(edges, edges[1:], strict=False):
        index = substring_dedup.FingerprintIndex(spark, f"file://{tmp_path}/index", fan_in=1)
        batch = docs.where((F.col("doc_id") >= low) & (F.col("doc_id") < high))
        got += [tuple(r) for r in substring_dedup.dedup_batch(index, batch, docs.where(F.col("doc_id") < low)).collect()]
        assert len(index.runs) == 1
    assert ordered(got) == ordered(brute.substring_dedup([(r.doc_id, r.text) for r in docs.collect()]))


def test_string_kernel():
    """Scores by the table of sequences are the kernel's: inner products over gapped sequences of four letters, weighted by the letters between them."""
    rng = np.random.default_rng(4)
    weights = rng.normal(size=32**4).astype(np.float32)
    words = [b"idiot", b"i.d-i_o.t", b"idxiot", b"abc", b"a", "über".encode(), b"moron123", b"ab" * 40]
    for w, got in zip(words, toxicity.word_scores(words, weights), strict=True):
        assert got == pytest.approx(brute.kernel_score(w, weights), abs=1e-4)


def test_insults_in_disguise(spark):
    sf = "/root/testdata/sf0.01"
    plain = "The er of and idiot tion the ing."
    texts = [plain, *(plain.replace("idiot", x) for x in ("i d i o t", "i.d.i.o.t", "idiiot", "id10t", "IDIOT")), "The er of and tion the ing.", "", None]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(10**6 + k, t) for k, t in enumerate(texts)], "doc_id long, text string"))
    scores = [r.score for r in toxicity.score_toxicity(docs, spark.read.parquet(f"{sf}/labels.parquet"), queries.fold(4) != 2).where("doc_id >= 1000000").orderBy("doc_id").collect()]
    assert min(scores[:6]) > 2 * max(scores[6:]) and scores[7] == scores[8]


@pytest.mark.parametrize("name", ["op7_quality", "op10_toxicity"])
def test_every_hostile_row_has_a_score(spark, hostile, sf, name, tmp_path_factory):
    """Nulls, repeated labels, null labels, a word of 100,000 letters, clashing columns: a score between 0 and 1 a row, equal for equal texts."""
    out = f"file://{tmp_path_factory.mktemp('labelled')}"
    more = [(9100, "w" * 100_000), (9101, "a\u00a0b \u3000 c"), (9102, "i d i o t " * 50)]
    docs = spark.read.parquet(f"{hostile}/documents.parquet").drop("row").withColumn("score", F.lit("s")).withColumn("label", F.lit(1)).withColumn("y", F.lit(2))
    docs = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    docs.write.parquet(f"{out}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality", "toxic")
    labels.unionByName(labels.limit(5)).unionByName(spark.createDataFrame([(3, None, None), (None, 1, 1)], labels.schema)).withColumn("text", F.lit("t")).write.parquet(f"{out}/labels.parquet")
    rows = queries.QUERIES[name](spark, out).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id == 9007}) == 1


@pytest.mark.parametrize("name,label", [("op7_quality", "quality"), ("op10_toxicity", "toxic")])
def test_held_out_ranking(spark, name, label):
    sf = "/root/testdata/sf0.01"
    y = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [(r.score, y[r.doc_id]) for r in queries.QUERIES[name](spark, sf).where("held_out").collect() if r.doc_id in y]
    pos, neg = [s for s, t in rows if t], [s for s, t in rows if not t]
    assert sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg)) > 0.75


@pytest.mark.parametrize("name", queries.QUERIES)
def test_empty_tables(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).count() == 0


def test_pipeline(spark, hostile, empty):
    docs = spark.read.parquet(f"{hostile}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        path = f"{hostile}/after-{name}.parquet"
        stage(spark, docs, hostile).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == corpus_pipeline.COLUMNS
        after = [(r.doc_id, r.text) for r in docs.collect()]
        if name == "simhash_near_dedup":
            assert len(after) == len(set(brute.similar(before)))
            assert set(after) <= set(before)
        elif name == "substring_dedup":
            lost = [n for _, _, n, _ in brute.substring_dedup(before)]
            size = lambda rows: sum(len(brute.words(t)) for _, t in rows)
            assert size(after) == size(before) - sum(lost)
        elif name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{hostile}/benchmark.parquet").collect()]
            assert len(after) == sum(not r[-1] for r in brute.decontaminate(before, items))
        else:
            assert set(after) <= set(before)
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_near_copies_by_similarity(spark, sf):
    """Copies of 60 to 300 words with one to eight words changed: similarities on both sides of 0.8, in groups of copies of copies."""
    rng = np.random.default_rng(1)
    rows = []
    for k in range(60):
        text = [f"w{n}" for n in rng.integers(0, 3000, int(rng.integers(60, 300)))]
        rows.append((len(rows), " ".join(text)))
        for _ in range(3):
            text = list(text)
            for at in rng.choice(len(text), int(rng.integers(1, 9)), replace=False):
                text[at] = f"new{rng.integers(0, 3000)}"
            rows.append((len(rows), " ".join(text)))
    want = {}
    for (i, _), c in zip(rows, brute.similar(rows), strict=True):
        want[c] = min(want.get(c, i), i)
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
    got = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf).collect()}
    assert 60 < len(want) < 200
    assert set(want.values()) <= got
    assert got == set(want.values())


def kept(spark, sf, words):
    docs = spark.createDataFrame([(i, " ".join(w), None, None, None) for i, w in enumerate(words)], SCHEMA)
    return sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf).collect())


def test_near_copies_inside_a_family(spark, sf):
    """1,000 texts of one template, alike at 0.74 to 0.78 (codewords that agree in at most two of six places), and a near copy of 0.81 of a hundred."""
    texts = []
    for k in range(1000):
        slots = {13 * g + (k % 13 + k // 13 % 13 * g + k // 169 * g * g) % 13 for g in range(6)}
        texts.append((slots, {5 * s + 5: f"own{k}x{s}" for s in slots}))
    rng = np.random.default_rng(2)
    for k in range(100):
        slots, changed = texts[10 * k]
        more = rng.choice(sorted(set(range(78)) - slots), 8, replace=False).tolist()
        texts.append((slots, changed | {5 * s + 5: f"copy{k}x{s}" for s in more}))
    assert kept(spark, sf, [[changed.get(at, f"w{at}") for at in range(404)] for _, changed in texts]) == list(range(1000))


def test_short_near_copies(spark, sf):
    """Pairs of 8 and 9 words, four shingles of five in common: a similarity of exactly 0.8."""
    texts = [[f"w{k}x{at}" for at in range(8 + copy)] for copy in (0, 1) for k in range(400)]
    assert kept(spark, sf, texts) == list(range(400))


def test_scratch(spark):
    """Tables go at the end of the scratch that they were written in, kept ones at the end of the one around it; outside any, they stay."""
    from tallow.llm.common import materialize, scratch

    free = materialize(spark.range(2), "free")
    with scratch(spark):
        with scratch(spark) as keep:
            gone, kept = materialize(spark.range(3), "gone"), keep(materialize(spark.range(4), "kept"))
        assert kept.count() == 4
        with pytest.raises(Exception):
            gone.collect()
    with pytest.raises(Exception):
        kept.collect()
    assert free.count() == 2


def test_sql_names():
    assert set(oracles.ORACLES) <= set(queries.QUERIES)
    assert substring_dedup.WINDOW == 50


@pytest.mark.parametrize("name", ["op2_substring_dedup", "op3_warc", "op9_token_counts", "op12_line_dedup"])
def test_only_the_result_stays_on_disk(spark, hostile, name):
    import os

    from tallow.llm.common import shared_dir

    folder = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    out = queries.QUERIES[name](spark, hostile)
    left = set(os.listdir(folder)) - before
    assert len(left) == 1 and out.inputFiles()[0].split("/")[-2] in left


def test_the_machine_is_the_plain_kernel_machine():
    """With all words as landmarks the machine's scores are those of a squared-hinge machine on the plain kernel matrix, found by gradient descent on the functions' values."""
    words = [b"idiot", b"id1ot", b"i-d-i-o-t", b"idxiot", b"moron", b"mor0n", b"garden", b"gardens", b"station", b"winter", b"radio", b"more"]
    y = np.array([1.0] * 6 + [-1.0] * 6)
    weight = np.array([3.0, 1, 1, 1, 2, 1, 2, 1, 1, 1, 1, 2])
    machine = toxicity.StringKernelMachine().fit(words, y, weight, landmarks=50, penalty=1e-2)
    counts, norms = [brute.sequence_counts(w) for w in words], [math.sqrt(sum(brute.sequence_squares(w))) for w in words]
    gram = np.array([[sum(v * d.get(k, 0.0) for k, v in c.items()) / m / n for d, n in zip(counts, norms, strict=True)] for c, m in zip(counts, norms, strict=True)])
    # f = gram @ a + b; the loss is half the weighted squared hinge plus half the penalty times the function's norm
    w, a, b = weight / weight.sum(), np.zeros(len(words)), 0.0
    for _ in range(60_000):
        slack = np.maximum(0, 1 - y * (gram @ a + b))
        a -= 0.5 * (1e-2 * a - w * y * slack)
        b += 0.5 * (w * y * slack).sum()
    want = gram @ a + b
    assert np.allclose(machine.scores(words), want, atol=5e-3)
    assert (np.sign(machine.scores([b"idi0t", b"moooron", b"gardener"])) == [1, 1, -1]).all()


def test_cells_meet_every_pair_across_components_once(spark):
    """Under one shingle: sets of the top component meet those outside once, those outside meet each other, and 20,000 sets of one component with one outside are dealt once each."""
    import itertools

    from tallow.llm import simhash

    sets = [(c, 1 if c < 40 else 2 + c % 3) for c in range(70)]
    rows = spark.createDataFrame(sets, "c long, root long").withColumns({"top": F.lit(1).cast("long"), "inside": F.lit(4).cast("long"), "outside": F.lit(3).cast("long")})
    cells = {}
    for r in rows.select("c", "root", F.explode(simhash._cells()).alias("x")).select("c", "root", "x.*").collect():
        cells.setdefault((r.i, r.j), []).append(r)
    met = [frozenset((a.c, b.c)) for (i, j), group in cells.items() for a, b in itertools.combinations(group, 2) if i == j or a.own != b.own]
    assert len(met) == len(set(met))
    assert set(met) == {frozenset((a, b)) for (a, x), (b, y) in itertools.combinations(sets, 2) if x != 1 or y != 1}
    many = spark.range(20_001).select(F.col("id").alias("c"), F.when(F.col("id") < 20_000, 1).otherwise(2).cast("long").alias("root"), F.lit(1).cast("long").alias("top"), F.lit(20).cast("long").alias("inside"), F.lit(1).cast("long").alias("outside"))
    assert many.select(F.explode(simhash._cells())).count() == 20_000 + 21


def test_hot_shingles_and_small_chunks_change_nothing(spark, monkeypatch):
    import random

    from tallow.llm import simhash

    rng = random.Random(8)
    base = [[f"w{rng.randrange(4000)}" for _ in range(60)] for _ in range(5)]
    rows = []
    for k in range(90):
        w = list(base[k % 5])
        for _ in range(rng.randrange(4)):
            w[rng.randrange(60)] = f"v{k}"
        rows.append((k, " ".join(["a line that very many texts begin with", *w])))
    rows += [(200 + k, rows[3][1]) for k in range(20)] + [(300, None), (301, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    groups = brute.similar(rows)
    low = {}
    for (i, _), g in zip(rows, groups, strict=True):
        low[g] = min(low.get(g, i), i)
    assert 5 < len(low) < 80
    plain = sorted(r.doc_id for r in simhash.first_of_each_group(docs, 5).collect())
    monkeypatch.setattr(simhash, "HOT_SHINGLE", 12)
    monkeypatch.setattr(simhash, "SAMPLE", 1)
    monkeypatch.setattr(simhash, "PREFIX_ROWS", 4)
    assert len(simhash.hot_shingles(docs, 5, 12)[0]) > 3
    assert sorted(r.doc_id for r in simhash.first_of_each_group(docs, 5).collect()) == plain == sorted(low.values())


def test_near_duplicates_begin_with_fingerprints(spark, monkeypatch):
    """Near copies of long texts are linked through fingerprints; what these miss is found by the exact step."""
    import random

    from tallow.llm import simhash

    rng = random.Random(4)
    base = [[f"w{rng.randrange(9000)}" for _ in range(400)] for _ in range(6)]
    rows = [(k, " ".join(base[k % 6][:-1] + [f"v{k}"])) for k in range(24)]
    short = [f"s{k}" for k in range(60)]
    rows += [(100 + k, " ".join(short[:k] + [f"x{k}"] + short[k:])) for k in (0, 30, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    seen = []
    plain = simhash.fingerprint_pairs

    def spied(marked):
        out = simhash.materialize(plain(marked), "spied")
        seen.append((marked.select("c").collect(), {(r.x, r.y) for r in out.collect()}))
        return out

    monkeypatch.setattr(simhash, "fingerprint_pairs", spied)
    low = {}
    for (i, _), g in zip(rows, brute.similar(rows), strict=True):
        low[g] = min(low.get(g, i), i)
    assert sorted(r.doc_id for r in simhash.first_of_each_group(docs, 5).collect()) == sorted(low.values())
    sets = {r.doc_id: r.c for r in simhash.set_hashes(docs, 5).collect()}
    (_, pairs), = seen
    near = {tuple(sorted((sets[i], sets[j]))) for i in range(24) for j in range(i) if i % 6 == j % 6}
    assert len(pairs & near) >= 6
