import datetime as dt

import numpy as np
import pytest

from quilate.operators import features, market, models, quality


def snaps(spark, data):
    return spark.createDataFrame([(i, dt.datetime(*d), p, s, float(v), "x", "l") for i, (d, p, s, v) in enumerate(data)], "id long, timestamp timestamp, canonical_product_id string, source string, price_usd double, seller string, listing_id string")


def test_features_empty_and_single(spark):
    assert features.weekly_features(snaps(spark, [])).count() == 0
    r = features.weekly_features(snaps(spark, [((2026, 4, 6, 12), "a", "s", 100)])).collect()
    assert len(r) == 1 and (r[0]["mediana_semanal"], r[0]["precio_lag_1"], r[0]["mediana_movil"], r[0]["dispersion_precios"]) == (100, None, 100, None)


def test_features_gap(spark):
    data = [((2026, 4, 6), "a", "s", 100), ((2026, 4, 7), "a", "s", 120), ((2026, 4, 20), "a", "s", 110), ((2026, 4, 21), "a", "s", 130), ((2026, 4, 12, 23, 59), "b", "s", 5)]
    got = {(r["canonical_product_id"], r["week_start"]): r for r in features.weekly_features(snaps(spark, data)).collect()}
    a = [got["a", w] for w in ("2026-04-06", "2026-04-13", "2026-04-20")]
    assert [r["mediana_semanal"] for r in a] == [110, None, 120]
    assert [r["precio_lag_1"] for r in a] == [None, 110, None] and [r["precio_lag_2"] for r in a] == [None, None, 110]
    assert [r["mediana_movil"] for r in a] == [110, 110, 115]
    assert got["b", "2026-04-06"]["mediana_semanal"] == 5 and len(got) == 6


def test_features_since(spark):
    data = [((2026, 4, 6), "a", "s", 100), ((2026, 4, 13), "a", "s", 120), ((2026, 4, 20), "a", "s", 140)]
    cold = features.weekly_features(snaps(spark, data), since="2026-04-13").orderBy("week_start").collect()
    warm = features.weekly_features(snaps(spark, data), since="2026-04-13", warm_up_weeks=4).orderBy("week_start").collect()
    assert [r["precio_lag_1"] for r in cold] == [None, 120] and [r["precio_lag_1"] for r in warm] == [100, 120]
    assert [r["week_start"] for r in cold] == [r["week_start"] for r in warm] == ["2026-04-13", "2026-04-20"]


def test_metrics_and_folds(spark):
    m = models.metrics(spark.createDataFrame([(100.0, 110.0), (200.0, 190.0)], "y double, p double"), "y", "p").first()
    assert (m["mae"], m["rmse"], m["mape"]) == pytest.approx((10, 10, 7.5))
    frame = spark.createDataFrame([(f"2026-01-{i // 2 + 10}", f"p{i % 2}", float(i)) for i in range(20)], "week_start string, canonical_product_id string, v double")
    rows = models.walk_forward(models.with_bucket(frame, 4), 4).collect()
    sizes = {f: sum(r["fold"] == f and r["role"] == "train" for r in rows) for f in (1, 2, 3)}
    assert sizes == {1: 5, 2: 10, 3: 15}
    with pytest.raises(ValueError):
        models.with_bucket(frame, 1)
    with pytest.raises(Exception, match="fewer rows"):
        models.with_bucket(frame, 30).collect()


def test_elastic_net_against_coordinate_descent(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 5)) * [1, 5, 2, 3, 0]
    y = x @ [3, -1, 0.5, 0, 0] + rng.normal(size=80) + 7
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], [*models.FEATURES, "target"])
    net = models.ElasticNet().fit(df)
    s = x.std(axis=0)
    s[s == 0] = 1
    z, w = (x - x.mean(axis=0)) / s, np.zeros(5)
    for _ in range(2000):
        for j in range(5):
            rho = z[:, j] @ (y - y.mean() - z @ w + z[:, j] * w[j]) / 80
            w[j] = np.sign(rho) * max(abs(rho) - 0.5, 0) / ((z[:, j] ** 2).mean() + 0.5)
    assert np.allclose(net.coefficients, w, atol=1e-7) and net.intercept == pytest.approx(y.mean())
    got = [r["prediction"] for r in net.predict(df).collect()]
    assert np.allclose(got, z @ w + y.mean())
    assert abs(net.importances()[0][1]) == pytest.approx(max(abs(w)))
    again = models.ElasticNet.from_json(net.to_json())
    assert again.coefficients == net.coefficients
    with pytest.raises(ValueError, match="not fitted"):
        models.ElasticNet().predict(df)
    with pytest.raises(ValueError, match="differ"):
        net.predict(df.drop("precio_lag_1"))
    with pytest.raises(ValueError, match="missing"):
        models.Naive().predict(df.drop("precio_lag_1"))


def test_cross_validation_and_persistence(spark, tmp_path):
    data = [(f"2026-{1 + i // 28:02d}-{1 + i % 28:02d}", "a", *(float(i + k) for k in range(5)), float(i + 1)) for i in range(20)]
    frame = spark.createDataFrame(data, ["week_start", "canonical_product_id", *models.FEATURES, "target"])
    b = models.with_bucket(frame, 4)
    assert models.cross_validate(b, models.ElasticNet, 4).count() == 3
    best = models.choose_model(b, 4)
    models.save_model(spark, models.Naive(), str(tmp_path), "2026a")
    models.save_model(spark, best, str(tmp_path), "2026b")
    name, model = models.load_latest(spark, str(tmp_path))
    assert name == "2026b" and model.kind == best.kind
    p = models.predictions(frame, model, name, "now").collect()
    assert len(p) == 1 and p[0]["lower_bound"] == pytest.approx(p[0]["predicted_price_usd"] * 0.9)


def test_market(spark):
    data = [((2026, 5, 30), "a", "s", 80), ((2026, 5, 29), "a", "t", 90), ((2026, 1, 1), "a", "s", 100), ((2026, 1, 1), "old", "s", 1)]
    s = snaps(spark, data)
    r = market.market_summary(s, "2026-06-01").collect()
    assert len(r) == 1 and (r[0]["current_price"], r[0]["historical_median"], r[0]["pct_diff"]) == (80, 90, -11.1)
    many = snaps(spark, [((2026, 5, 30, 0, i), "a", "s", i) for i in range(12)] + [((2026, 5, 1), "a", "t", 5)])
    assert [r["source"] for r in market.current_prices(many, "2026-06-01", 2000).collect()] == ["s"]


def test_quality(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), (None, "c"), ("d", None), (None, None)], "t string, f string")
    r = quality.precision_recall(df, "t", "f").first()
    assert (r["tp"], r["fp"], r["fn"]) == (1, 2, 2)
    assert {x["value"]: x["n"] for x in quality.value_counts(df, "t").collect()} == {"a": 2, None: 2, "d": 1}


def noisy_frame(spark, n=60):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, 5)) * 10 + 100
    y = 0.7 * x[:, 0] + 0.3 * x[:, 1] + rng.normal(size=n)
    data = [(f"2026-{1 + i // 28:02d}-{1 + i % 28:02d}", f"p{i % 3}", *map(float, x[i]), float(y[i])) for i in range(n)]
    return models.with_bucket(spark.createDataFrame(data, ["week_start", "canonical_product_id", *models.FEATURES, "target"]), 4).checkpoint()


def test_moments_of_buckets_give_each_fold_its_own_fit(spark):
    from quilate.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    b = noisy_frame(spark)
    for fold, model in models.fold_models(b, models.ElasticNet, 4).items():
        alone = models.ElasticNet().fit(b.where(f"bucket < {fold}"))
        assert np.allclose(model.coefficients, alone.coefficients, atol=1e-8) and model.intercept == pytest.approx(alone.intercept)
        want = models.metrics(alone.predict(b.where(f"bucket = {fold}")), "target", "prediction").first()
        got = models.cross_validate(b, models.ElasticNet, 4).where(f"fold = {fold}").first()
        assert [got[k] for k in ("mae", "rmse", "mape")] == pytest.approx([want[k] for k in ("mae", "rmse", "mape")])
    with pytest.raises(ValueError, match="no rows"):
        models.ElasticNet().fit(b.limit(0))
    with pytest.raises(ValueError, match="not trained on"):
        models.ElasticNet(columns=("precio_lag_1",)).fit(b).predict(b)
    assert isinstance(models.Naive(), models.PriceModel) and isinstance(models.ElasticNet(), models.PriceModel)


def test_winners_of_rejoined_predictions(spark):
    b = noisy_frame(spark)
    both = {m().kind: models.fold_predictions(b, m, 4) for m in (models.ElasticNet, models.Naive)}
    rows = models.rejoined(b.select(*models.KEYS, "target"), both)
    counts = {r["winner"]: r["n"] for r in quality.winner_counts(rows, "target", "elastic_net", "naive").collect()}
    want = {}
    for r in rows.collect():
        e, n = abs(r["target"] - r["elastic_net"]), abs(r["target"] - r["naive"])
        k = "elastic_net" if e < n else "naive" if n < e else "tie"
        want[k] = want.get(k, 0) + 1
    assert counts == want and sum(counts.values()) == b.where("bucket > 0").count() and counts["elastic_net"] > counts["naive"]


def test_metadata_names_the_model(spark, tmp_path):
    b = noisy_frame(spark)
    scores = models.compare_models(b, 4)
    winner = models.choose_model(b, 4, scores)
    models.save_model(spark, winner, str(tmp_path), "20260601", models.training_metadata(b, winner, scores, "20260601"))
    kept = models.load_metadata(spark, str(tmp_path), "20260601")
    assert (kept["model"], kept["train_rows"], kept["skus"], kept["features"]) == ("elastic_net", 60, 3, list(models.FEATURES))
    assert kept["metrics_winner"] == kept["metrics_elastic_net"] != kept["metrics_naive"]
    assert models.model_id(spark, str(tmp_path), "20260601") == "elastic_net"
    models.save_model(spark, winner, str(tmp_path), "20260602")
    assert models.model_id(spark, str(tmp_path), "20260602") == "model_20260602" and models.load_latest(spark, str(tmp_path))[0] == "20260602"


def test_summary_by_deviation(spark):
    rows = spark.createDataFrame([("a", 3.0), ("b", -12.5), ("c", 3.0), ("d", 0.0)], "canonical_product_id string, pct_diff double")
    assert [r["canonical_product_id"] for r in market.by_deviation(rows).collect()] == ["b", "d", "a", "c"]
