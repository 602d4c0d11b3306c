"""All queries of the engine's own operators, each a function of (spark, sf_dir) over whole tables, and the SQL for each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import normalize, with_language
from ..operators import evaluate, labels, learn, ranks, replies, series, vectors, votes
from ..sources import scans, shared
from ..sources.store import config_key_of, shard_key
from . import images, oracles, studies
from . import views as V
from .weights import BIAS, GW, HEADS, PLANES, UW, VW

QUERIES: dict = {**images.QUERIES, **studies.QUERIES}
ORACLES = {**oracles.ORACLES, **images.ORACLES, **studies.ORACLES}
PREFERENCES = ["N_O", "R_any", "any_F"]
WINDOWS = (0.0, 0.5)


def query(f):
    QUERIES[f.__name__] = f
    return f


def _detected(s: SparkSession, d: str) -> DataFrame:
    return with_language(V.documents(s, d).select("doc_id", "lang", "text"), name="detected")


@query
def language_agreement(s, d):
    rows = _detected(s, d)
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("lang") == F.col("detected")).alias("agreed"), F.count_if(F.col("detected") == "unknown").alias("unknown"))


@query
def language_histogram(s, d):
    return _detected(s, d).groupBy("detected").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "detected").limit(12)


@query
def normalized_text(s, d):
    return V.documents(s, d).select("doc_id", F.md5(normalize(F.col("text"))).alias("plain_md5"))


@query
def clause_votes(s, d):
    clauses = votes.with_places(votes.clause_table(V.documents(s, d), V.DEMO_CUES), V.DEMO_FINDINGS)
    cast = [votes.vote(f, k).alias(f.column) for k, f in enumerate(V.DEMO_FINDINGS)]
    rows = clauses.select(F.explode(F.array(*[F.struct(F.lit(f.column).alias("column"), c.alias("vote")) for f, c in zip(V.DEMO_FINDINGS, cast, strict=True)])).alias("x"), "negated", "hedged").select("x.*", "negated", "hedged")
    return rows.groupBy("column").agg(F.count("*").alias("n"), F.count_if(F.col("vote") == "pos").alias("pos"), F.count_if(F.col("vote") == "neg").alias("neg"), F.count_if("negated").alias("negated"), F.count_if("hedged").alias("hedged"))


@query
def report_labels(s, d):
    return votes.label_findings(V.documents(s, d), V.DEMO_FINDINGS, V.DEMO_CUES)


@query
def section_scope(s, d):
    rows = votes.scoped_lines(V.documents(s, d), V.DEMO_SECTIONS)
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if("is_header").alias("headers"), F.count_if(F.col("section") == "first").alias("first_lines"), F.count_if(F.col("section") == "second").alias("second_lines"))


@query
def finding_labels(s, d):
    return votes.label_reports(V.reports(s, d))


@query
def compartment_labels(s, d):
    return votes.label_compartments(V.reports(s, d))


@query
def finding_mentions(s, d):
    """How many reports hint at each of the twelve columns."""
    return votes.mentioned(V.reports(s, d)).groupBy("column").agg(F.count_if("mentioned").alias("n"))


@query
def finding_ceiling(s, d):
    """How far labels of the twelve columns could go, with the labels of the reports' sentences as the truth."""
    cells = votes.labels_and_mentions(V.reports(s, d)).withColumnRenamed("label", "gold")
    return votes.mention_table(cells.withColumn("label", F.when(F.col("doc_id") % 3 > 0, F.col("gold"))))


def _mentioned(s, d):
    return V.judged(s, d).withColumn("mentioned", votes.mentions(F.col("text"), V.DEMO_FINDINGS[0], extra="trash"))


@query
def mention_ceiling(s, d):
    return votes.mention_table(_mentioned(s, d))


@query
def mention_rate(s, d):
    return votes.mention_rate(votes.mention_table(_mentioned(s, d))).withColumn("mention_rate", F.round("mention_rate", 9))


@query
def error_triage(s, d):
    return votes.error_triage(V.judged(s, d).where(F.col("column") == "toxic"), r"\bidiot\b|\bscum\b|\bmoron\b")


@query
def cells_with_text(s, d):
    english = V.documents(s, d).where("lang = 'en'")
    return votes.with_texts(V.gold(s, d), english).select("doc_id", "column", F.length("text").alias("n_chars"))


@query
def labelled_documents(s, d):
    wide = V.documents(s, d).select("doc_id").join(V.table(s, d, "labels"), "doc_id", "left")
    return labels.any_label(wide, V.COLUMNS).select("doc_id")


@query
def labelled_cells(s, d):
    return labels.labelled_cells(_targets(s, d))


@query
def label_coverage(s, d):
    return evaluate.coverage(V.rule_a(s, d))


@query
def labeler_scores(s, d):
    return evaluate.scores(V.judged(s, d))


@query
def scores_by_language(s, d):
    return evaluate.scores_by_language(V.judged(s, d))


def _precision(s):
    return s.createDataFrame([("quality", 0.94), ("toxic", 0.67)], "column string, precision double")


def _targets(s, d):
    cells = V.rule_a(s, d).select("doc_id", "column")
    out = labels.build_targets(cells, V.rule_a(s, d), V.gold(s, d), labels.column_weights(V.rule_a(s, d), _precision(s)))
    return out.withColumn("weight", F.round("weight", 9))


@query
def build_targets(s, d):
    return _targets(s, d)


@query
def trainable_documents(s, d):
    return labels.trainable(labels.gold_only(_targets(s, d)))


@query
def label_weights(s, d):
    return labels.column_weights(V.rule_a(s, d), _precision(s)).select("column", F.round("weight", 9).alias("weight"))


@query
def combine_labels(s, d):
    return labels.combine(V.rule_a(s, d), V.rule_b(s, d))


@query
def provenance_counts(s, d):
    return labels.provenance_summary(labels.combine(V.rule_a(s, d), V.rule_b(s, d)))


@query
def provenance_accuracy(s, d):
    out = labels.accuracy_by_provenance(labels.combine(V.rule_a(s, d), V.rule_b(s, d)), V.gold(s, d))
    return out.withColumn("accuracy", F.round("accuracy", 9))


def _auc_cells(s, d):
    return V.scored(s, d).join(V.gold(s, d).select("doc_id", "column", F.col("label").alias("y")), ["doc_id", "column"])


@query
def masked_auc(s, d):
    return evaluate.auc(_auc_cells(s, d), "model", "column").withColumn("auc", F.round("auc", 9))


@query
def macro_auc(s, d):
    return evaluate.auc(_auc_cells(s, d), "model", "column").groupBy("model").agg(F.round(F.avg("auc"), 9).alias("auc"))


@query
def continuous_auc(s, d):
    cells = V.continuous(s, d).join(V.gold(s, d).select("doc_id", "column", F.col("label").alias("y")), ["doc_id", "column"])
    return evaluate.auc(cells, "model", "column").withColumn("auc", F.round("auc", 9))


@query
def kfold_assign(s, d):
    return ranks.kfold(V.documents(s, d), 5)


@query
def holdout_split(s, d):
    return ranks.holdout(V.documents(s, d), 0.2)


@query
def oof_auc(s, d):
    folds = ranks.kfold(V.documents(s, d), 5)
    cells = _auc_cells(s, d).where("model = 'm1'").join(folds, "doc_id")
    return evaluate.auc(cells, "fold", "column").withColumn("auc", F.round("auc", 9))


@query
def rank_average(s, d):
    return ranks.rank_average(V.scored(s, d), {"m1": 2.0, "m2": 1.0}).withColumn("p", F.round("p", 9))


@query
def continuous_rank_average(s, d):
    """The first model has no rows, so it neither sets the keys nor weighs."""
    return ranks.rank_average(V.continuous(s, d), {"m0": 5.0, "m1": 2.0, "m2": 1.0}).withColumn("p", F.round("p", 9))


@query
def probability_average(s, d):
    return ranks.probability_average(V.scored(s, d)).withColumn("p", F.round("p", 9))


@query
def offset_average(s, d):
    cells = V.scored(s, d).withColumn("offset", F.when(F.col("model") == "m1", 0.0).otherwise(0.5))
    return vectors.offset_average(cells).withColumn("p", F.round("p", 9))


@query
def submission_fill(s, d):
    docs = V.documents(s, d)
    return ranks.check_complete(ranks.complete(docs, V.gold(s, d).withColumnRenamed("label", "p"), V.COLUMNS), docs, V.COLUMNS)


@query
def fold_union(s, d):
    """Predictions of five folds' models, one after the other; each document comes once."""
    rows = V.scored(s, d).where("model = 'm1'").join(ranks.kfold(V.documents(s, d), 5), "doc_id")
    parts = [rows.where(F.col("fold") == k).select("doc_id", "column", F.round("p", 9).alias("p")) for k in range(5)]
    return reduce(DataFrame.unionByName, parts)


@query
def fold_overlap(s, d):
    """Documents that both labelers and the gold labels know."""
    known = [rows.where("label IS NOT NULL").select("doc_id") for rows in (V.rule_a(s, d), V.rule_b(s, d), V.gold(s, d))]
    return reduce(DataFrame.intersect, known)


@query
def fold_models(s, d):
    """Out-of-fold scores of vectors' labels: whether a vector's label is even, and whether it is below 3, by models on the other folds."""
    rows = V.table(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.transform("embedding", lambda v: v.cast("double")).alias("x"), "label")
    y = F.array(F.struct(F.lit("even").alias("column"), (F.col("label") % 2 == 0).cast("double").alias("label")), F.struct(F.lit("low").alias("column"), (F.col("label") < 3).cast("double").alias("label")))
    targets = rows.select("doc_id", F.explode(y).alias("y")).select("doc_id", "y.*", F.lit(1.0).alias("weight"))
    return learn.out_of_fold(rows.select("doc_id", "x"), targets, ranks.kfold(rows, 3), ["even", "low"], 3)


@query
def series_select_top1(s, d):
    return series.select_first(V.series(s, d), PREFERENCES)


@query
def series_select_multi(s, d):
    return series.select_series(V.series(s, d), PREFERENCES, 3).select("study", F.array_join("uids", ",").alias("uids"))


@query
def slot_stack(s, d):
    return series.slots(series.select_series(V.series(s, d), PREFERENCES, 3), 3)


@query
def series_coverage(s, d):
    orders = V.table(s, d, "orders").select(F.col("o_orderkey").alias("study"))
    return series.series_coverage(orders, V.series(s, d), PREFERENCES)


def _counts(s, d):
    return V.slices(s, d).groupBy("user_id").agg(F.count("*").cast("int").alias("n"))


@query
def slice_linspace(s, d):
    return _counts(s, d).select("user_id", F.posexplode(series.sample_indices(F.col("n"), 16)).alias("position", "at"))


@query
def slice_tta_windows(s, d):
    both = F.array(*[F.struct(F.lit(w).alias("offset"), series.window_indices(F.col("n"), 8, w).alias("at")) for w in WINDOWS])
    return _counts(s, d).select("user_id", F.explode(both).alias("x")).select("user_id", "x.offset", F.posexplode("x.at").alias("position", "at"))


@query
def slice_jitter(s, d):
    jitter = (series.uniform(F.lit("jitter"), F.col("user_id")) - 0.5) * 0.6
    return _counts(s, d).select("user_id", F.posexplode(series.window_indices(F.col("n"), 8, 0.25, jitter)).alias("position", "at"))


@query
def slice_positions(s, d):
    """Slices in order: by place along the normal, by number, or by file, as far as they are known."""
    e = F.col("event_id")
    place = F.when(e % 3 == 0, F.array(F.col("value"), F.lit(1.0), F.lit(2.0)))
    key = series.slice_order(place, F.array(F.lit(0.5), F.lit(0.0), F.lit(-1.0)), F.when(e % 3 == 1, e % 17), e)
    return V.slices(s, d).select("event_id", F.row_number().over(Window.partitionBy("user_id").orderBy(key, "event_id")).alias("position"))


@query
def slice_dropout(s, d):
    return series.slice_dropout(V.slices(s, d), ["user_id"], "event_id", 0.3, seed=4).select("event_id", "kept")


@query
def slice_noise(s, d):
    return V.slices(s, d).select("event_id", F.round(series.add_noise(F.col("value") / 1000.0, 0.025, F.lit(9), F.col("event_id")), 6).alias("noisy"))


def _with_scans(s, d, read):
    """What `read` makes of a folder of scan files, one for each event, below its series, packed into archives; the files go when it is written."""
    folder = shared.new_folder(s, "scans")
    parts = int(s.conf.get("spark.sql.shuffle.partitions"))
    scans.write_scans(V.scan_rows(s, d).repartition(parts), folder, packed=True)
    out = shared.written(read(folder), "scans-read")
    shared.remove(s, folder)
    return out


@query
def scan_headers(s, d):
    """Planes, sides and places of slices, from headers only."""

    def read(folder):
        rows = scans.read_scans(s, folder, "path", "orientation", "position", "image_side", "side", "body_part", "frames", "description")
        plane, contrast = series.series_kind(F.lit(None), F.lit(None), F.col("description"), F.col("orientation"))
        side = series.laterality(F.col("image_side"), F.col("side"), F.col("body_part"), F.get("position", F.lit(0)))
        return rows.select(V.event_of("path").alias("event_id"), plane.alias("plane"), contrast.alias("contrast"), side.alias("side"), "frames")

    return _with_scans(s, d, read)


@query
def scan_pixels(s, d):
    """The middle frames' samples after inversion and rescaling; null for cut files."""

    def read(folder):
        rows = scans.read_scans(s, folder, "path", "rows", "columns", "pixels")
        total = F.aggregate("pixels", F.lit(0.0), lambda a, x: a + x.cast("double"))
        return rows.select(V.event_of("path").alias("event_id"), (F.col("rows") * F.col("columns")).alias("size"), F.get("pixels", F.lit(0)).cast("double").alias("first"), total.alias("total"))

    return _with_scans(s, d, read)


@query
def truthy_flags(s, d):
    rows = V.raw_series(s, d).select(F.coalesce("fluid", F.lit("none")).alias("raw"), series.truthy(F.col("fluid")).alias("flag"))
    return rows.groupBy("raw", "flag").agg(F.count("*").alias("n"))


@query
def series_metadata(s, d):
    plane, contrast = series.series_kind(F.col("plane"), F.col("fluid"), F.col("description"), F.col("iop"))
    return V.raw_series(s, d).select(plane.alias("plane"), contrast.alias("contrast")).groupBy("plane", "contrast").agg(F.count("*").alias("n"))


@query
def laterality_histogram(s, d):
    sides = V.raw_series(s, d).select(series.laterality(F.col("image"), F.col("tag"), F.col("part"), F.col("x")).alias("side"))
    return series.laterality_histogram(sides).withColumn("pct_known", F.round("pct_known", 9))


@query
def percentile_clip(s, d):
    """One in ten slices is unreadable; the series of one user in five hold one value a slice only."""
    rows = V.slices(s, d).withColumn("value", F.when(F.col("event_id") % 10 == 3, F.lit(None)).when(F.col("user_id") % 5 == 2, F.lit(7.0)).otherwise(F.col("value")))
    return series.percentile_clip(rows, "user_id", "value", slice_no="event_id").select("event_id", "scaled")


@query
def neighbor_stack(s, d):
    return series.neighbour_stack(V.slices(s, d), "user_id", ["ts", "event_id"], "value").select("event_id", "before", "value", "after")


@query
def canonical_flip(s, d):
    plane = F.element_at(F.array(F.lit("sagittal"), F.lit("coronal"), F.lit("axial"), F.lit("unknown")), (F.col("label") % 4 + 1).cast("int"))
    rows = V.table(s, d, "embeddings").select("vec_id", plane.alias("plane"), F.when(F.col("label") < 5, "L").otherwise("R").alias("side"), F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.array(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda j: F.get("embedding", k * 4 + j)))).alias("x"))
    flipped = F.flatten(F.flatten(series.canonical_flip(F.col("x"), F.col("plane"), F.col("side"))))
    return rows.select("vec_id", *[F.round(F.get(flipped, F.lit(k)).cast("double"), 6).alias(f"x{k}") for k in (0, 3, 12, 15)])


@query
def slice_count_profile(s, d):
    return series.slice_count_profile(_counts(s, d))


@query
def intensity_augment(s, d):
    rows = V.slices(s, d).withColumn("unit", F.col("value") / 1000.0)
    return series.bias_adjust(rows, "user_id", "unit", 1.2, 0.9, 0.05).select("event_id", "augmented")


@query
def coverage_semi_anti(s, d):
    docs, known = V.documents(s, d).select("doc_id", "lang"), V.table(s, d, "labels").select("doc_id")
    done = docs.join(known, "doc_id", "left_semi").groupBy("lang").agg(F.count("*").alias("resolved"))
    todo = docs.join(known, "doc_id", "left_anti").groupBy("lang").agg(F.count("*").alias("missing"))
    return done.join(todo, "lang", "full_outer").select("lang", F.coalesce("resolved", F.lit(0)).alias("resolved"), F.coalesce("missing", F.lit(0)).alias("missing"))


@query
def attention_pool(s, d):
    rows = V.table(s, d, "embeddings")
    return vectors.attention_pool(rows, "label", "embedding", vectors.gate(F.col("embedding"), VW, UW, GW)).select("label", "dim", F.round("value", 6).alias("value"))


@query
def two_level_pool(s, d):
    """Vectors as slices, a study a label, four series each, with planes by series."""
    rows = V.table(s, d, "embeddings").select("label", (F.col("vec_id") % 4).alias("series"), (F.col("vec_id") % 4 % 3).cast("int").alias("plane"), "embedding")
    planes = s.createDataFrame([(p, k, v) for p, of in PLANES.items() for k, v in enumerate(of)], "plane int, dim int, add double")
    score = lambda x: vectors.gate(x, VW, UW, GW)
    pooled = vectors.two_level_pool(rows, "label", "series", "embedding", score, score, "plane", planes)
    return vectors.linear_head(pooled, "label", HEADS, BIAS).select("label", "column", F.round("p", 6).alias("p"))


@query
def weighted_bce(s, d):
    cells = _targets(s, d).join(V.scored(s, d).where("model = 'm1'"), ["doc_id", "column"])
    cells = cells.select("column", (F.col("p") * 4 - 2).alias("x"), F.col("label").alias("y"), F.col("weight").alias("w"))
    return evaluate.masked_bce(cells, "column").select("column", F.round("loss_sum", 6).alias("loss_sum"), F.round("loss_mean", 9).alias("loss_mean"))


@query
def bce_cells(s, d):
    cells = _targets(s, d).join(V.scored(s, d).where("model = 'm1'"), ["doc_id", "column"])
    cells = cells.select("doc_id", "column", (F.col("p") * 4 - 2).alias("x"), F.col("label").alias("y"), F.col("weight").alias("w"))
    return evaluate.bce_cells(cells).select("doc_id", "column", F.round("loss", 9).alias("loss"))


@query
def first_reports(s, d):
    return labels.first_rows(V.reports(s, d), 200, "doc_id").select("doc_id", F.md5("text").alias("text_md5"))


@query
def train_then_validation(s, d):
    """Documents that the labeler labels as toxic or not, then those with gold labels that it doesn't."""
    pseudo = V.rule_a(s, d).where("column = 'toxic' AND label IS NOT NULL")
    return labels.first_seen(pseudo, V.gold(s, d).where("label IS NOT NULL"))


@query
def prediction_spread(s, d):
    return evaluate.spread(V.scored(s, d).where("model = 'm1'")).withColumn("std", F.round("std", 9))


@query
def json_reply_parse(s, d):
    return V.table(s, d, "events").select("event_id", replies.parse_reply(F.col("props"), ["K"])["K"].alias("k"))


@query
def reply_labels(s, d):
    reply = F.replace(V.in_turn([r for r, _ in V.REPLIES], F.col("doc_id")), F.lit(V.OWN), (F.col("n_chars") % 3).cast("string"))
    return V.documents(s, d).select("doc_id", replies.parse_reply(reply, ["quality", "toxic"])["toxic"].alias("toxic"))


@query
def prompt_render(s, d):
    return V.documents(s, d).select("doc_id", F.md5(replies.build_prompt(F.col("text"), V.COLUMNS)).alias("prompt_md5"))


@query
def shard_histogram(s, d):
    return V.documents(s, d).groupBy(shard_key(F.col("doc_id")).alias("shard")).agg(F.count("*").alias("n"))


@query
def config_keys(s, d):
    """Keys of the configurations that parts stand for, and how many parts share each."""
    key = config_key_of(n_slices=F.col("p_size"), name=F.col("p_brand"), size=F.col("p_partkey") % 3 * 112)
    return V.table(s, d, "part").groupBy(key.alias("key")).agg(F.count("*").alias("n"))


@query
def required_studies(s, d):
    """Orders and ids that no order has as the studies asked for, line items as series."""
    orders = V.table(s, d, "orders").select(F.col("o_orderkey").alias("study"))
    asked = orders.unionByName(orders.select((-F.col("study") - 1).alias("study")).where("study % 5 = 0"))
    return series.required_studies(asked, V.series(s, d).where("plane <> 'A'"))


@query
def prompt_findings(s, d):
    return V.reports(s, d).select("doc_id", F.md5(replies.build_prompt(F.col("text"), list(replies.DESCRIPTIONS))).alias("prompt_md5"))


@query
def window_scores(s, d):
    """Labels as studies, four series each; windows of five slices at two offsets."""
    rows = V.table(s, d, "embeddings").select("label", (F.col("vec_id") % 4).alias("series"), (F.col("vec_id") % 4 % 3).cast("int").alias("plane"), "vec_id", "embedding")
    planes = s.createDataFrame([(p, k, v) for p, of in PLANES.items() for k, v in enumerate(of)], "plane int, dim int, add double")
    score = lambda x: vectors.gate(x, VW, UW, GW)
    out = vectors.window_scores(rows, "label", "series", ["vec_id"], "embedding", 5, list(WINDOWS), score, score, HEADS, BIAS, "plane", planes)
    return out.withColumn("p", F.round("p", 6))
