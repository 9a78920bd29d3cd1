"""Linear models as data, mails scored by fitted models, and published artifacts."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from postwarden.functions import fixed as fx
from postwarden.operators import linear, vectors
from postwarden.operators.model import SCORES, best_round, fit_classifier, predict_scores
from postwarden.plans import scoring, training
from postwarden.sources import artifacts

WORDS = {
    "ham": "meeting notes agenda tuesday report figures lunch project team",
    "spam": "winner prize casino bonus cheap pills offer lottery jackpot",
    "phishing": "verify account password suspended bank login confirm identity secure",
}


@pytest.fixture(scope="module")
def mail(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(90):
        label = fx.LABELS[i % 3]
        body = " ".join(rng.choice(WORDS[label].split(), 8)) + (" common words here" if i % 2 else "")
        rows.append((i, f'"N" <{label}{i % 4}@x.example.com>', " ".join(rng.choice(WORDS[label].split(), 2)), body, label))
    return spark.createDataFrame(rows, "mail_id long, from_email string, subject string, body string, label string")


@pytest.fixture(scope="module")
def learnt(mail):
    space = training.fit_feature_space(mail, 60, 20)
    model, spreads = training.fit_linear(mail, space, 30)
    return space, model, spreads


def test_products_and_softmax(spark):
    rows = spark.createDataFrame([([0, 2], [1.5, -2.0]), ([], [])], "i array<int>, v array<double>")
    z = linear.dot("i", "v", linear.literal_array([2.0, 1e300, 0.25]))
    assert [r[0] for r in rows.select(z).collect()] == [2.5, 0.0]
    far = spark.range(1).select(*linear.softmax([F.lit(1000.0), F.lit(999.0), F.lit(-1e6)])).first()
    assert sum(far) == pytest.approx(1) and far[0] == pytest.approx(1 / (1 + math.exp(-1)))


def test_fit_equals_gradient_steps_in_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 6)) * (rng.random((40, 6)) < 0.6)
    k = rng.integers(0, 3, 40)
    rows = [
        ([int(j) for j in np.flatnonzero(r)], [float(v) for v in r[r != 0]], int(c)) for r, c in zip(x, k)
    ]
    df = spark.createDataFrame(rows, "indices array<int>, values array<double>, label_code int")
    weights, free = linear.fit_softmax(df, 6, steps=12, l2=0.01)
    full = np.hstack([x, np.ones((40, 1))])
    rate = 1 / (0.5 * (full**2).sum(axis=1).mean() + 0.01)
    w, move = np.zeros((3, 7)), np.zeros((3, 7))
    for _ in range(12):
        z = full @ w.T
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        slope = (p - np.eye(3)[k]).T @ full / 40
        slope[:, :6] += 0.01 * w[:, :6]
        move = 0.9 * move - rate * slope
        w += move
    assert np.allclose(weights, w[:, :6]) and np.allclose(free, w[:, 6])
    assert linear.fit_softmax(df.limit(0), 6)[1] == [0.0] * 3


def test_numbers_are_standardised_and_constants_drop_out(spark):
    df = spark.createDataFrame([([1.0, 5.0, 0.1],), ([3.0, 5.0, 0.1],)], "dense array<double>")
    means, scales = linear.dense_statistics(df, "dense", 3)
    assert means == pytest.approx([2, 5, 0.1]) and scales == [1.0, 0.0, 0.0]
    assert [r[0] for r in df.select(linear.standardised("dense", means, scales)).collect()] == [[-1.0, 0, 0], [1.0, 0, 0]]
    weights, free = linear.unscaled([[7.0, 2.0, 9.0, 9.0]], [1.0], 1, means, [0.5, 0.0, 0.0])
    assert weights == [[7.0, 1.0, 0.0, 0.0]] and free == [1.0 - 2.0]


def test_coordinates_are_the_stacked_vector(spark, mail, learnt):
    space = learnt[0]
    rows = training.sparse_rows(mail, space)
    got = {(r["mail_id"], r["feature"]): r["value"] for r in training.coordinates(rows, space.names).collect()}
    stacked = training.feature_vectors(mail, space).collect()
    want = {
        (r["mail_id"], space.names[i]): v for r in stacked for i, v in enumerate(r["features"].toArray()) if v
    }
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_regression_of_spark_ml_scores_alike_as_data(spark, mail, learnt):
    space = learnt[0]
    keep = ["mail_id", "label_code"]
    rows = training.feature_vectors(training.labelled(mail), space, keep=keep)
    fitted = fit_classifier(rows, "logistic")
    want = {r["mail_id"]: [r[s] for s in SCORES] for r in predict_scores(rows, fitted).collect()}
    model = linear.LinearModel.from_logistic(fitted, space.names)
    sparse = training.sparse_rows(training.labelled(mail), space, keep=keep)
    for r in training.linear_scores(sparse, model, keep).collect():
        assert [r[s] for s in SCORES] == pytest.approx(want[r["mail_id"]], abs=1e-9)


def test_mails_scored_by_a_model(spark, mail, learnt):
    space, model, _ = learnt
    scored = scoring.score_mail(mail, space.reputation, scoring.ModelScorer(model, space))
    got = {r["mail_id"]: r for r in scored.collect()}
    serve = training.sparse_rows(mail, space, "serve")
    for r in training.linear_scores(serve, model, ["mail_id"]).collect():
        assert [got[r["mail_id"]][s] for s in SCORES] == pytest.approx([r[s] for s in SCORES], abs=1e-9)
    labels = {r["mail_id"]: r["label"] for r in mail.collect()}
    best = [max(fx.LABELS, key=lambda n: r[f"{n}_score"]) == labels[i] for i, r in got.items()]
    assert sum(best) >= 0.9 * len(best)
    assert not [c for c in scored.columns if c in scoring.ModelScorer.carried]


def test_odd_mails_do_not_fail_a_scored_batch(spark, mail, learnt):
    space, model, _ = learnt
    odd = spark.createDataFrame(
        [(1, None, None, None), (2, None, None, "verify account"), (3, "a@b.c", "", ""), (4, "", "s", None), (4, "", "s", None)],
        "mail_id long, from_email string, subject string, body string",
    )
    found = scoring.score_mail(odd, space.reputation, scoring.ModelScorer(model, space)).orderBy("mail_id").collect()
    assert [r["error"] for r in found] == ["empty message", None, None, None, None]
    assert found[0]["ham_score"] is None and found[0]["predicted_label"] is None
    assert all(sum(r[s] for s in SCORES) == pytest.approx(1) for r in found[1:])


def test_texts_do_not_travel_with_scored_mails(spark, mail, learnt):
    """Below the join with reputation a mail carries numbers only, and no Python worker runs."""
    space, model, _ = learnt
    scored = scoring.score_mail(mail, space.reputation, scoring.ModelScorer(model, space))
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan
    join = next(i for i, line in enumerate(plan.splitlines()) if "Join" in line)
    below = plan.splitlines()[join + 1]
    assert "term_logits_" in below and " body#" not in below and "body_terms_" not in below


def test_forest_scores_by_vectors(spark, mail, learnt):
    space = learnt[0]
    rows = training.feature_vectors(training.labelled(mail), space, keep=["mail_id", "label_code"])
    forest = fit_classifier(rows, "forest", numTrees=5, maxDepth=3)
    scored = scoring.score_mail(mail, space.reputation, scoring.VectorScorer(forest, space))
    serve = training.feature_vectors(mail, space, "serve")
    want = {r["mail_id"]: [r[s] for s in SCORES] for r in predict_scores(serve, forest).collect()}
    got = {r["mail_id"]: [r[s] for s in SCORES] for r in scored.collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i]) for i in want)


def test_saved_model_scores_alike_in_another_session(spark, mail, learnt, tmp_path):
    space, model, _ = learnt
    root = str(tmp_path / "models")
    assert training.save_model(space, model, root) == 1
    other, loaded = training.load_model(spark.newSession(), root)
    assert other.names == space.names and loaded == model
    score = scoring.ModelScorer(model, space)
    again = scoring.ModelScorer(loaded, other)
    want = scoring.score_mail(mail, space.reputation, score).select("mail_id", *SCORES, "predicted_label")
    got = scoring.score_mail(mail, other.reputation, again).select("mail_id", *SCORES, "predicted_label")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_only_published_versions_are_read(spark, tmp_path):
    root = str(tmp_path / "store")
    one, two = spark.range(3), spark.range(5)
    with pytest.raises(LookupError):
        artifacts.load(spark, root)
    assert artifacts.publish(spark, root, {"rows": one}) == 1
    # A writer that dies before its row leaves its tables unseen.
    two.write.parquet(f"{root}/v2-dead/rows")
    assert artifacts.load(spark, root)["rows"].count() == 3
    assert artifacts.publish(spark, root, {"rows": two}) == 2
    assert artifacts.load(spark, root)["rows"].count() == 5
    assert artifacts.load(spark, root, 1)["rows"].count() == 3
    with pytest.raises(LookupError):
        artifacts.load(spark, root, 7)


def test_parts_that_do_not_fit_are_refused(spark, learnt, tmp_path):
    space, model, _ = learnt
    root = str(tmp_path / "models")
    shorter = linear.LinearModel(model.names[:-1], [w[:-1] for w in model.weights], model.intercepts)
    training.save_model(space, shorter, root)
    with pytest.raises(ValueError, match="features differ"):
        training.load_model(spark, root)
    with pytest.raises(ValueError, match="other features"):
        scoring.ModelScorer(shorter, space)
    with pytest.raises(ValueError, match="coefficients"):
        linear.LinearModel(["a"] * 400_000, [[0.0] * 400_000] * 3, [0.0] * 3)
    with pytest.raises(ValueError, match="whole model"):
        linear.LinearModel.from_rows(model.rows(spark).filter("feature <> 'intercept'"))


def test_importance_ranks_by_size_and_spread(spark):
    model = linear.LinearModel(["a", "b", "c", "d"], [[1.0, 0, 3, 0], [-1, 0.5, 0, 0], [0, 0, 0, 0]], [0.0] * 3)
    rows = linear.importance(model, {"c": 0.1}, spark).collect()
    assert [tuple(r) for r in rows] == [("a", 2.0), ("b", 0.5), ("c", pytest.approx(0.3))]


def test_weights_need_no_shuffle(spark, mail):
    vocab = vectors.fit_tfidf(mail, "body", 20)
    rows = vectors.tfidf(mail, vocab)
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    norms = rows.groupBy("mail_id").agg(F.sum(F.col("weight") * F.col("weight")).alias("n")).collect()
    assert len(norms) == 90 and all(r["n"] == pytest.approx(1) for r in norms)
    assert vectors.tfidf(mail, vocab.limit(0)).count() == 0


def test_patience_waits_over_a_plateau(spark):
    plateau = [0.9, 0.7, 0.71, 0.72, 0.7, 0.69, 0.8, 0.8, 0.8]
    assert best_round(plateau, 5) == (6, False) and best_round(plateau, 3) == (2, True)
    assert best_round(plateau + [0.8] * 3, 5) == (6, True)
    assert best_round([0.5], 3) == (1, False)
    rng = np.random.default_rng(5)
    rows = []
    for i in range(120):
        x = rng.normal(size=3)
        code = int(x[0] > 0) + int(x[0] > 0.8)
        rows.append((x.tolist(), code if rng.random() < 0.8 else int(rng.integers(0, 3)), i % 3 == 0))
    from pyspark.ml.functions import array_to_vector

    df = spark.createDataFrame(rows, "x array<double>, label_code int, held boolean").withColumn("features", array_to_vector("x")).cache()
    boosted = fit_classifier(df, "boosted", validation="held", patience=2, maxIter=8, maxDepth=2)
    for code, fitted in enumerate(boosted.models):
        held = df.filter("held").withColumn("is_class_", (F.col("label_code") == code).cast("double"))
        losses = fitted.evaluateEachIteration(held)
        assert len(losses) <= 8 and min(losses) == losses[-1]


def test_steps_explode_no_rows(spark, monkeypatch):
    """A step's sums are made inside the tasks; rows with a null value or label take no part."""
    df = spark.createDataFrame(
        [([0, 1], [1.0, 2.0], 0), ([1], [3.0], 2), ([0], [None], 1), ([], [], None)],
        "i array<int>, v array<double>, k int",
    )
    got = {r["place"]: list(r)[1:] for r in df.coalesce(1).mapInArrow(linear._missed([[0.0] * 3] * 3), linear.STEP).collect()}
    third = 1 / 3
    assert got.keys() == {0, 1}
    assert got[0] == pytest.approx([third - 1, third, third])
    assert got[1] == pytest.approx([2 * (third - 1) + 3 * third, 2 * third + 3 * third, 2 * third + 3 * (third - 1)])


def test_training_rows_of_trees_are_dealt_by_their_binned_size(spark, monkeypatch):
    from postwarden.plans import training

    rows = spark.range(1000).coalesce(1)
    assert training.dealt_for_trees(rows, 6000) is rows
    monkeypatch.setattr(training, "TREE_BYTES", 100 * 6000 * 4)
    dealt = training.dealt_for_trees(rows, 6000)
    sizes = [len(part) for part in dealt.rdd.glom().collect()]
    assert sum(sizes) == 1000 and len(sizes) == 10 and max(sizes) <= 110


def test_models_of_boosted_classes_are_fitted_at_the_same_time(spark, monkeypatch):
    import threading

    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.linalg import Vectors

    rows = [(Vectors.dense([float(i % 3), float(i % 7)]), i % 3) for i in range(60)]
    df = spark.createDataFrame(rows, ["features", "label_code"])
    alone = fit_classifier(df, "boosted", maxIter=2, maxDepth=2)
    all_here, fit = threading.Barrier(3, timeout=60), GBTClassifier.fit

    def fit_when_all_are_here(self, data, *more):
        all_here.wait()
        return fit(self, data, *more)

    monkeypatch.setattr(GBTClassifier, "fit", fit_when_all_are_here)
    together = fit_classifier(df, "boosted", maxIter=2, maxDepth=2, parallelism=3)
    assert [m.toDebugString.split("\n", 1)[1] for m in together.models] == [m.toDebugString.split("\n", 1)[1] for m in alone.models]
    assert training.fits_together(df, 2) == 3 and training.fits_together(df, 1 << 26) == 1
