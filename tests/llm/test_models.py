import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelweave.llm import langid, quality, toxicity
from panelweave.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_language_accuracy_on_the_held_out_fold(spark):
    got = QUERIES["op1_language_id"](spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = got.join(docs.select("doc_id", "lang", F.length("text").alias("n")), "doc_id").filter("held_out and n > 40").collect()
    assert len(rows) > 150 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.98
    assert got.count() == docs.count() and all(0 <= r.score <= 1 for r in got.collect())


def test_mixture_finds_two_languages():
    rng = np.random.default_rng(0)
    like = rng.dirichlet(np.full(langid.BUCKETS, 0.02), 3).astype(np.float32) + np.float32(1e-9)
    draw = lambda shares, n: np.bincount(rng.choice(langid.BUCKETS, n, p=(np.array(shares) @ like) / (np.array(shares) @ like).sum()), minlength=langid.BUCKETS)
    counts = np.stack([draw([1, 0, 0], 800), draw([0, 0.35, 0.65], 800)]).astype(np.float32)
    chosen, _ = langid.select(counts, like)
    assert (chosen[0] > 0).tolist() == [True, False, False]
    assert (chosen[1] > 0).tolist() == [False, True, True] and abs(chosen[1, 2] - 0.65) < 0.08


def test_mixture_finds_six_of_nine_languages():
    rng = np.random.default_rng(3)
    like = rng.dirichlet(np.full(langid.BUCKETS, 0.02), 9).astype(np.float32) + np.float32(1e-9)
    shares = np.array([0.2, 0.2, 0, 0.15, 0, 0.15, 0.1, 0, 0.2])
    p = (shares @ like).astype(float)
    counts = np.bincount(rng.choice(langid.BUCKETS, 3000, p=p / p.sum()), minlength=langid.BUCKETS).astype(np.float32)[None]
    chosen, _ = langid.select(counts, like)
    assert (chosen[0] > 0).tolist() == (shares > 0).tolist() and np.abs(chosen[0] - shares).max() < 0.05


def test_language_edges(spark, make, edge):
    model = langid.fit(make(edge, clashes=True))
    assert model.languages == ["de", "en"]
    got = {r.doc_id: r for r in langid.identify(make(edge, clashes=True), model).collect()}
    assert all(got[d].lang_pred == "und" and got[d].score == 0 for d in (1, 2, 3, 14)) and got[10].lang_pred != "und"
    assert langid.identify(make(edge).limit(0), model).count() == 0
    nothing = langid.fit(make(edge).limit(0))
    assert {r.lang_pred for r in langid.identify(make(edge), nothing).collect()} == {"und"}


def accuracy(spark, name, column):
    got = QUERIES[name](spark, SF)
    rows = got.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("held_out").select("score", "predicted", F.col(column).alias("y")).collect()
    y, s = np.array([r.y for r in rows]), np.array([r.score for r in rows])
    pairs = s[y == 1][:, None] - s[y == 0][None, :]
    assert got.count() == 1000 and ((s >= 0) & (s <= 1)).all()
    return ((pairs > 0) + 0.5 * (pairs == 0)).mean()


def test_quality_ranks_the_held_out_fold(spark):
    assert accuracy(spark, "op8_quality_classifier", "quality") > 0.9


def test_toxicity_learns_from_positives_and_unlabelled_text(make, spark):
    rng = random.Random(1)
    vocab = [f"v{i}" for i in range(400)]
    rows, labels = [], []
    for d in range(1500):
        w = [rng.choice(vocab) for _ in range(rng.randint(5, 60))]
        toxic = rng.random() < 0.12
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(["vile", "nasty", "Foul"])
        rows.append((d, " ".join(w)))
        if d % 2:
            labels.append((d, int(toxic)))
    truth = {d: any(x in t for x in ("vile", "nasty", "Foul")) for d, t in rows}
    weights = toxicity.fit(make(rows), spark.createDataFrame(labels, "doc_id long, toxic int"), F.col("doc_id") % 5 != 0)
    got = {r.doc_id: r.score for r in toxicity.score(make(rows), weights).collect()}
    held = [d for d in got if d % 5 == 0]
    assert np.mean([(got[d] >= 0.5) == truth[d] for d in held]) > 0.98


@pytest.mark.parametrize("which", ["quality", "toxicity"])
def test_model_edges(spark, make, edge, which):
    docs = make(edge, clashes=True)
    labels = spark.createDataFrame([(4, 1), (4, 0), (9, 0), (None, 1), (11, None), (12, 1)], "doc_id long, y int")
    if which == "quality":
        from panelweave.llm.features import labelled

        fit = lambda d, l: quality.fit(labelled(d, l, "y", F.lit(True), 100, 1))
        score = quality.score
    else:
        fit = lambda d, l: toxicity.fit(d, l, F.lit(True), "y")
        score = toxicity.score
    for d, l in ((docs, labels), (docs, labels.limit(0)), (docs.limit(0), labels)):
        rows = score(docs, fit(d, l)).collect()
        assert len(rows) == len(edge) and all(0 <= r.score <= 1 for r in rows)
    assert score(docs.limit(0), np.zeros(1 << 18)).count() == 0
