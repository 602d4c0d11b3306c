"""Co-training against a plain version, and what the views teach each other."""

from __future__ import annotations

import random

import brute
import numpy as np
from pyspark.sql import functions as F

from tallow.llm import quality


def made(n, labelled, seed):
    """Both views know the label, each with noise of its own; few rows have one."""
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        y = rng.random() < 0.5
        x = [1.0, rng.gauss(1.5 if y else -1.5, 1), rng.gauss(0, 1)]
        m = [1.0, rng.gauss(2.0 if y else -2.0, 1)]
        rows.append((x, m, float(y) if k < labelled else None, k % 4 == 0, y))
    return rows


def test_plain_version(spark):
    rows = made(80, 30, 1)
    table = spark.createDataFrame([r[:4] for r in rows], "x array<float>, m array<float>, y double, held boolean").repartition(3)
    held = [(np.float32(x).tolist(), np.float32(m).tolist(), y, h) for x, m, y, h, _ in rows]
    got, want = quality.co_train(table, (3, 2)), brute.co_train(held, (3, 2))
    assert len(got) == 5 and all(np.allclose(a, b, atol=1e-6) for a, b in zip(got, want, strict=True))


def test_views_teach_each_other(spark):
    """With few labels, the rounds in which views label for each other bring the text view closer to the truth."""

    def right(rounds):
        total = 0.0
        for seed in (3, 4, 5):
            rows = made(600, 14, seed)
            table = spark.createDataFrame([r[:4] for r in rows], "x array<float>, m array<float>, y double, held boolean").coalesce(2)
            beta = quality.co_train(table, (3, 2), rounds=rounds, steps=3)[0]
            total += sum((np.dot(x, beta) > 0) == y for x, *_, y in rows) / len(rows)
        return total / 3

    assert right(3) > right(1) + 0.01


def test_scores_follow_the_labels(spark):
    """Held-out documents of two kinds of text are told apart, by texts that no metadata gives away."""
    rng = random.Random(2)
    good = ["a calm sentence about gardens and rivers in the morning", "the station opens early and people walk along the water"]
    bad = ["BUY $$$ now!!! click @@@ here >>> http <<< win win win", "xxx zzz qqq %%% ### !!! 000 111 222 $$$ free free free"]
    docs = [(k, " ".join(rng.choice(good if k % 2 else bad) for _ in range(4)), "en", "s", 0) for k in range(160)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(100)], "doc_id long, quality int")
    out = quality.score_quality(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), labels, F.col("doc_id") < 100).collect()
    assert len(out) == 160 and all((r.score > 0.5) == bool(r.doc_id % 2) for r in out)
