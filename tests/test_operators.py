from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallow.operators import evaluate, labels, ranks, replies, series, vectors
from tallow.sources import tables
from tallow.sources.store import Store, config_key


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_gold_beats_pseudo(spark):
    cells = spark.createDataFrame([(k, "c") for k in range(3)], "doc_id long, column string")
    pseudo = spark.createDataFrame([(0, "c", 1.0), (1, "c", 1.0)], "doc_id long, column string, label double")
    gold = spark.createDataFrame([(0, "c", 0.0)], "doc_id long, column string, label double")
    weights = spark.createDataFrame([("c", 0.4)], "column string, weight double")
    out = {r.doc_id: (r.label, r.weight) for r in labels.build_targets(cells, pseudo, gold, weights).collect()}
    assert out == {0: (0.0, 1.0), 1: (1.0, 0.4), 2: (None, 0.0)}


def test_combine_prefers(spark):
    a = spark.createDataFrame([(1, "c", 1.0)], "doc_id long, column string, label double")
    b = spark.createDataFrame([(1, "c", 0.0)], "doc_id long, column string, label double")
    assert labels.combine(a, b).first().label is None
    kept = labels.combine(a, b, prefer="b").first()
    assert (kept.label, kept.weight, kept.provenance) == (0.0, 0.0, "conflict")


def test_ranks(spark):
    rows = [(k, "m", "c", p) for k, p in enumerate([0.1, 0.2, 0.3, 0.4])] + [(0, "n", "c", None)]
    out = ranks.rank_normalize(spark.createDataFrame(rows, "doc_id long, model string, column string, p double"))
    assert [round(r.r, 9) for r in out.where("model = 'm'").orderBy("doc_id").collect()] == [0.0, round(1 / 3, 9), round(2 / 3, 9), 1.0]
    assert out.where("model = 'n'").first().r is None
    with pytest.raises(ValueError):
        ranks.rank_average(out, {})


def test_folds_are_a_partition(spark):
    out = ranks.kfold(spark.range(23).withColumnRenamed("id", "doc_id"), 5).groupBy("fold").count().orderBy("fold").collect()
    assert [r["count"] for r in out] == [5, 5, 5, 4, 4]


def test_auc_ties_and_one_class(spark):
    rows = [("a", 1.0, 0.5), ("a", 0.0, 0.5), ("a", 1.0, 0.9), ("b", 1.0, 0.1)]
    out = {r.column: r.auc for r in evaluate.auc(spark.createDataFrame(rows, "column string, y double, p double")).collect()}
    assert out == {"a": 0.75, "b": None}


def test_masked_bce_ignores_weightless_cells(spark):
    rows = [(0.0, 1.0, 1.0), (50.0, 0.0, 0.0), (0.0, 0.0, 0.5)]
    out = evaluate.masked_bce(spark.createDataFrame(rows, "x double, y double, w double")).first()
    assert out.loss_mean == pytest.approx(0.693147, abs=1e-5)


def test_slice_indices(spark):
    assert one(spark, series.sample_indices(F.lit(10), 5)) == [0, 2, 4, 7, 9]
    assert one(spark, series.sample_indices(F.lit(1), 3)) == [0, 0, 0]
    assert one(spark, series.sample_indices(F.lit(0), 3)) == []
    assert one(spark, series.sample_indices(F.lit(7), 1)) == [0]
    assert one(spark, series.window_indices(F.lit(1), 2)) == [0, 0]


def test_flip_and_plane(spark):
    volume = F.array(*[F.array(F.array(F.lit(k), F.lit(k + 1))) for k in (0, 10)])
    assert one(spark, series.canonical_flip(volume, F.lit("sagittal"), F.lit("L"))) == [[[10, 11]], [[0, 1]]]
    assert one(spark, series.canonical_flip(volume, F.lit("axial"), F.lit("L"))) == [[[1, 0]], [[11, 10]]]
    assert one(spark, series.canonical_flip(volume, F.lit("axial"), F.lit(None).cast("string"))) == [[[0, 1]], [[10, 11]]]
    iop = lambda *v: F.array(*map(F.lit, v))
    assert one(spark, series.plane_of(iop(0.0, 1.0, 0.0, 0.0, 0.0, -1.0))) == "sagittal"
    assert one(spark, series.plane_of(iop(1.0, 0.0, 0.0, 0.0, 1.0, 0.0))) == "axial"
    assert one(spark, series.plane_of(F.lit(None).cast("array<double>"))) == "unknown"


def test_metadata(spark):
    assert one(spark, series.truthy(F.lit(" Yes "))) is True and one(spark, series.truthy(F.lit("maybe"))) is None
    assert one(spark, series.laterality(F.lit(None), F.lit("l"), F.lit("RIGHT KNEE"), F.lit(-50.0))) == "L"
    assert one(spark, series.laterality(F.lit(None), F.lit(None), F.lit(None), F.lit(5.0))) is None
    plane, contrast = series.describe(F.lit("SAG T2 FS"))
    assert (one(spark, plane), one(spark, contrast)) == ("sagittal", "fluid")
    key = series.slice_order(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(0.0), F.lit(2.0)), F.lit(7), F.lit(1))
    assert tuple(one(spark, key)) == (0, 4.0)


def test_masked_pooling(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], True), (1, [0.0, 1.0], True), (1, [9.0, 9.0], False)], "bag long, x array<double>, ok boolean")
    out = vectors.attention_pool(rows, "bag", "x", F.lit(0.0), F.col("ok")).orderBy("dim").collect()
    assert [r.value for r in out] == [0.5, 0.5]


def test_replies(spark):
    texts = ['Sure: {"ACL": 1, "mcl ": "absent"} done', "{bad json", None, '{"ACL": 0.5, "MCL": true}', "[1, 2]"]
    got = replies.label_by_model(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string"), lambda prompts: [p.split("Report:\n", 1)[1] for p in prompts], ["ACL", "MCL"]).orderBy("doc_id").collect()
    assert [(r.ACL, r.MCL) for r in got] == [(1.0, 0.0), (None, None), (None, None), (None, 1.0), (None, None)]


def test_no_reply_is_an_error(spark):
    texts = ['{"ACL": 1, "acl": 0}', '{"ACL": "1.0"}', '{"ACL": 1.0}', '{"ACL": 1} trailing }', '{"ACL": 1}, {"ACL": 0}', '{"ACL": {"a": 1, "a": 2}}', "{'ACL': 1}", '{"ACL": NaN}', '{"ACL": "\\tPresent "}', "{", ""]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string")
    got = [r.y for r in rows.orderBy("k").select(replies.parse_reply(F.col("t"), ["ACL"])["ACL"].alias("y")).collect()]
    assert got == [0.0, None, 1.0, None, None, None, None, None, 1.0, None, None]


def test_replies_end_where_the_object_ends(spark):
    cases = {'{"ACL": 1}], [{"ACL": 0}': None, '{"ACL": 1}}, {{"ACL": 0}': None, '{"ACL": 1}, "x": {"ACL": 0}': None, '{"ACL": 1}} {"b": {}': None, '{"ACL": 1}] {"b": [}': None, '{"ACL": "yes\u00a0"}': 1.0, '{"ACL": "\u2003No\u3000"}': 0.0, '{"ACL": "yes\u200b"}': None, '{"\u00a0acl": 0}': 0.0, '{"ACL": "\n1"}': None, '{"ACL": "\\n1"}': 1.0, '{"x": [1, {"y": "}"}], "ACL": 1} ': 1.0}
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(cases)], "k long, t string")
    got = [r.y for r in rows.orderBy("k").select(replies.parse_reply(F.col("t"), ["ACL"])["ACL"].alias("y")).collect()]
    assert dict(zip(cases, got, strict=True)) == cases


def test_descriptions_are_read_by_words(spark):
    from tallow.plans.views import RAW_DESCRIPTIONS

    plane, contrast = series.describe(F.col("t"))
    rows = spark.createDataFrame([(k, t) for k, (t, _, _) in enumerate(RAW_DESCRIPTIONS)], "k long, t string")
    got = [(r.t, r.p, r.c) for r in rows.select("k", "t", plane.alias("p"), contrast.alias("c")).orderBy("k").collect()]
    assert got == RAW_DESCRIPTIONS


def test_store_computes_once(spark, tmp_path):
    calls = []

    def compute(rows):
        calls.append(rows.count())
        return rows.withColumn("y", F.col("doc_id") * 2)

    rows = spark.range(10).withColumnRenamed("id", "doc_id")
    store = Store(spark, f"file://{tmp_path}", {"size": 1})
    assert store.get(rows.where("doc_id < 6"), compute).count() == 6
    assert sorted(r.y for r in store.get(rows, compute).collect()) == list(range(0, 20, 2))
    assert calls == [6, 4]
    assert config_key({"a": 1, "b": 2}) == config_key({"b": 2, "a": 1}) != config_key({"a": 1, "b": 3})


def test_split(spark, tmp_path):
    (tmp_path / "train_series.csv").write_text("StudyInstanceUID,SeriesInstanceUID\ns1,a\ns1,b\ns2,c\n")
    (tmp_path / "train.csv").write_text("StudyInstanceUID,Report,ACL\ns1,no tear,0\ns2,,nan\n")
    (tmp_path / "test_series.csv").write_text("StudyInstanceUID,SeriesInstanceUID\ns3,d\n")
    split = tables.load_split(spark, str(tmp_path), "train")
    assert split.studies.count() == 2 and split.reports.count() == 2
    assert {r.StudyInstanceUID: r.ACL for r in split.gold.collect()} == {"s1": 0.0, "s2": None}
    test = tables.load_split(spark, str(tmp_path), "test")
    assert test.gold is None and test.reports is None and test.studies.count() == 1


def test_image_folders(spark, tmp_path):
    (tmp_path / "a_images").mkdir()
    for name in ("b.dcm", ".hidden", "a.dcm"):
        (tmp_path / "a_images" / name).write_bytes(b"x")
    assert tables.image_root(spark, str(tmp_path), "a").endswith("/a_images") and tables.image_root(spark, str(tmp_path), "b").endswith("/b_series")
    (tmp_path / "a_series").mkdir()
    assert tables.image_root(spark, str(tmp_path), "a").endswith("/a_series")
    files = tables.list_files(spark, str(tmp_path / "a_images")).collect()
    assert [r.path.rsplit("/", 1)[1] for r in files] == ["a.dcm", "b.dcm"]
    assert tables.list_files(spark, str(tmp_path / "none")).count() == 0
    rows = spark.createDataFrame([("s", "u")], "StudyInstanceUID string, SeriesInstanceUID string")
    assert tables.with_paths(rows, "/root/").first().series_dir == "/root/s/u"


def test_targets_and_sinks(spark, tmp_path):
    (tmp_path / "sample.csv").write_text("StudyInstanceUID,a,b\ns,0.5,0.5\n")
    assert tables.target_columns(spark, str(tmp_path / "sample.csv"), expected=2) == ["a", "b"]
    with pytest.raises(ValueError):
        tables.target_columns(spark, str(tmp_path / "sample.csv"))
    assert labels.missing_targets(["a"], ["a", "b"]) == ["b"]
    tables.write_csv(spark.createDataFrame([(1, 0.5)], "k long, p double"), str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).first().p == "0.5"


def test_wrong_shapes_are_misses(spark, tmp_path):
    rows = spark.range(4).withColumnRenamed("id", "doc_id")
    short = Store(spark, f"file://{tmp_path}", {"x": 1})
    short.get(rows, lambda r: r.withColumn("v", F.array(F.lit(1.0))))
    right = Store(spark, f"file://{tmp_path}", {"x": 1}, right=F.size("v") == 2)
    assert right.missing(rows).count() == 4
    assert [list(r.v) for r in right.get(rows, lambda r: r.withColumn("v", F.array(F.lit(1.0), F.lit(2.0)))).collect()] == [[1.0, 2.0]] * 4


def test_models_without_rows(spark):
    cells = spark.createDataFrame([(1, "b", "c", 0.2), (2, "b", "c", 0.9), (1, "d", "c", 0.7), (3, "d", "c", 0.1)], "doc_id long, model string, column string, p double")
    assert {r.doc_id: r.p for r in ranks.rank_average(cells, {"a": 9.0, "b": 1.0}).collect()} == {1: 0.2, 2: 0.9}
    # the second model's own key is dropped, and its missing one counts as the middle
    assert {r.doc_id: r.p for r in ranks.rank_average(cells, {"a": 9.0, "b": 1.0, "d": 1.0}).collect()} == {1: 0.0, 2: 0.75}
    with pytest.raises(ValueError):
        ranks.rank_average(cells, {"z": 1.0})


def test_sums_below_at_any_number_of_ranges(spark):
    from tallow.operators.order import sums_below

    values = [0.5, -1.0, 3.0, 2.0, 1e300, -1e300, 0.25, 7.0]
    bins = spark.createDataFrame([("a", v, k + 1) for k, v in enumerate(values)] + [("b", 1.0, 5)], "g string, v double, n long")
    for ranges in (2, 3, 100):
        got = {(r.g, r.v): r.n_below for r in sums_below(bins, ["g"], "v", ["n"], ranges).collect()}
        assert got == {("a", v): sum(k + 1 for k, u in enumerate(values) if u < v) for v in values} | {("b", 1.0): 0}


def test_complete_outputs(spark):
    need = spark.range(3).withColumnRenamed("id", "doc_id")
    good = need.withColumn("a", F.lit(0.5))
    assert ranks.check_complete(good, need, ["a"]) is good
    for bad in (good.where("doc_id > 0"), good.unionByName(good.limit(1)), good.withColumn("a", F.lit(1.5)), good.withColumn("a", F.lit(None).cast("double")), good.withColumn("a", F.lit(float("nan"))), good.withColumnRenamed("a", "b")):
        with pytest.raises(ValueError):
            ranks.check_complete(bad, need, ["a"])


def test_dropout_keeps_a_slice(spark):
    rows = spark.createDataFrame([(s, k) for s in range(40) for k in range(s % 4 + 1)], "series long, k long")
    kept = series.slice_dropout(rows, ["series"], "k", 0.9).groupBy("series").agg(F.count("*").alias("n"), F.count_if("kept").alias("kept")).collect()
    assert all(r.kept >= 1 for r in kept) and all(r.kept == r.n for r in kept if r.n <= 2) and any(r.kept < r.n for r in kept)


def test_noise_is_normal(spark):
    x = [r.x for r in spark.range(4000).select(series.normal(F.lit(1), F.col("id")).alias("x")).collect()]
    assert abs(sum(x) / len(x)) < 0.05 and abs(sum(v * v for v in x) / len(x) - 1) < 0.08


def test_fold_models(spark, tmp_path):
    from tallow.operators import learn

    rng = __import__("numpy").random.default_rng(0)
    x = rng.normal(size=(300, 4))
    y = (x[:, 0] + 0.3 * rng.normal(size=300) > 0).astype(float)
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "doc_id long, x array<double>")
    targets = spark.createDataFrame([(k, c, v, 1.0) for k in range(300) for c, v in (("a", float(y[k])), ("one", 1.0))], "doc_id long, column string, label double, weight double")
    out = learn.out_of_fold(rows, targets, ranks.kfold(rows, 3), ["a", "one"], 3)
    got = {(r.doc_id, r.column): r.p for r in out.collect()}
    assert len(got) == 600 and {got[k, "one"] for k in range(300)} == {0.5}
    pos, neg = [got[k, "a"] for k in range(300) if y[k]], [got[k, "a"] for k in range(300) if not y[k]]
    assert sum(a > b for a in pos for b in neg) / (len(pos) * len(neg)) > 0.9
    model = learn.fit_column(rows.withColumn("label", (F.get("x", F.lit(0)) > 0).cast("double")).withColumn("weight", F.lit(1.0)))
    learn.save_model(model, str(tmp_path / "model"))
    same = learn.load_model(str(tmp_path / "model"))
    assert [r.p for r in learn.predict(rows, same).orderBy("doc_id").collect()] == [r.p for r in learn.predict(rows, model).orderBy("doc_id").collect()]
    learn.write_summary(spark, {"auc": 0.5, "folds": [1, 2]}, str(tmp_path / "summary"))
    assert learn.read_summary(spark, str(tmp_path / "summary")) == {"auc": 0.5, "folds": [1, 2]}


def test_percentiles_to_the_last_bit(spark):
    """Cents in groups of all sizes, against the SQL's percentiles."""
    import duckdb

    rows = [(n, (k * k * 7919 + n * 31) % 50021 / 100) for n in range(1, 121) for k in range(n)]
    df = spark.createDataFrame(rows, "g int, v double")
    got = {r.g: list(r._q) for r in series.percentiles(df.groupBy("g", "v").agg(F.count("*").alias("n")), ["g"], "v", "n", [0.01, 0.5, 0.99]).collect()}
    con = duckdb.connect()
    for g in range(1, 121):
        want = con.execute("SELECT quantile_cont(v, 0.01), quantile_cont(v, 0.5), quantile_cont(v, 0.99) FROM (SELECT unnest(?::DOUBLE[]) AS v)", [[v for n, v in rows if n == g]]).fetchall()[0]
        assert got[g] == list(want)


def test_profile_of_counts(spark):
    import duckdb

    rows = [(k * k % 83 + 1,) for k in range(38)]
    got = list(series.slice_count_profile(spark.createDataFrame(rows, "n int")).first())[:5]
    want = duckdb.execute("SELECT quantile_cont(n, 0.05), quantile_cont(n, 0.25), quantile_cont(n, 0.5), quantile_cont(n, 0.75), quantile_cont(n, 0.95) FROM (SELECT unnest(?::DOUBLE[]) AS n)", [[float(n) for n, in rows]]).fetchall()[0]
    assert got == list(want)
    assert [*series.slice_count_profile(spark.createDataFrame([], "n int")).collect()[0]][:6] == [None] * 6


def test_clip_rounds_as_the_sql(spark, tmp_path):
    """Values of which a last bit of a percentile decides the level."""
    import duckdb

    from tallow.plans import registry

    values = [(0, 6.5, 7.5, 8.5), (1, 221.0, 223.75, 246.5), (3, 178.25, 210.25, 242.25)]
    rows = [(10 * k + 4 + j, u, float(v)) for k, (u, *vs) in enumerate(values) for j, v in enumerate(vs)]
    spark.createDataFrame(rows, "event_id long, user_id long, value double").selectExpr("event_id", "user_id", "timestamp'2024-01-01' AS ts", "value").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = dict(con.execute(registry.ORACLES["percentile_clip"]).fetchall())
    got = {r.event_id: r.scaled for r in registry.QUERIES["percentile_clip"](spark, str(tmp_path)).collect()}
    assert got == want and [got[4 + j] for j in range(3)] == [0, 128, 255]
