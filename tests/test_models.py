import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.operators import anomalies, features, forecasting, trees
from shelfwise.operators.cleaning import clean_sales_impute, stage_sales
from shelfwise.schema import FEATURES, RAW_SCHEMA
from shelfwise.sources import star
from tests.data import SAMPLE

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def cleaned(spark):
    return clean_sales_impute(spark.createDataFrame(SAMPLE, RAW_SCHEMA))


@pytest.fixture(scope="module")
def sales(spark):
    return star.sales(spark, SF).cache()


@pytest.fixture(scope="module")
def trained(sales):
    codes = features.encode_labels(sales)
    rows = features.training_rows(features.engineer_features(sales, codes))
    return codes, *forecasting.train_demand_model(rows, num_trees=10, tree_depth=5)


def test_feature_frame(cleaned):
    frame = features.feature_frame(features.engineer_features(cleaned))
    assert len(FEATURES) == 34 and frame.columns == [*FEATURES, "label"]
    rows = frame.collect()
    assert len(rows) == 5
    assert all(v is not None for r in rows for v in r)
    assert all(r.label >= 0 for r in rows)


def test_label_codes(cleaned):
    codes = {(r["column"], r.label): r.code for r in features.encode_labels(cleaned).collect()}
    assert {c for c, _ in codes} == {"product_id", "category", "store_id", "region"}
    assert [codes["region", n] for n in ("Central", "East", "North", "South", "West")] == [0, 1, 2, 3, 4]


def test_unseen_label_is_zero(spark, cleaned):
    codes = features.encode_labels(cleaned)
    other = spark.createDataFrame([("X", "Y", "Z", "Q")], "product_id string, category string, store_id string, region string")
    got = features.apply_codes(other, codes).first()
    assert (got.product_code, got.category_code, got.store_code, got.region_code) == (0, 0, 0, 0)


def test_first_rows_take_the_median(cleaned):
    first = features.engineer_features(cleaned).where("product_id = 'PROD_003'").first()
    assert first.units_lag_1 == 12.0 and first.roll_avg_30 == 12.0 and first.roll_std_7 == 0.0 and first.momentum_ratio == 1.0


def test_holdout_is_the_end_of_the_order(sales):
    rows = features.holdout_split(sales, 0.25).collect()
    n = len(rows)
    assert sum(r.is_holdout for r in rows) == n - int(n * 0.75)
    assert max(r.product_id for r in rows if not r.is_holdout) <= min(r.product_id for r in rows if r.is_holdout)
    late = features.holdout_split(sales, 0.25, "chronological").collect()
    assert max(r.date for r in late if not r.is_holdout) <= min(r.date for r in late if r.is_holdout)


def test_training_and_prediction(spark, trained, tmp_path):
    codes, model, metrics = trained
    m = metrics.first()
    assert m.feature_count == 34 and m.num_trees == 10 and m.training_rows > m.holdout_rows > 0
    assert 0 < m.mae <= m.rmse and m.r2 < 1
    forecasting.save_model(model, codes, metrics, str(tmp_path))
    loaded, loaded_codes = forecasting.load_model(spark, str(tmp_path))
    requests = spark.createDataFrame(
        [("prod_1", "2025-06-01", 299.99, 10.0, "store_1", "asia"), ("PROD_1", "2025-06-01", -1.0, 10.0, "S", "X"),
         ("PROD_1", "2025-06-01", 5.0, 101.0, "S", "X")],
        "product_id string, target_date string, price double, discount double, store_id string, region string",
    ).withColumn("target_date", F.to_date("target_date"))
    first = forecasting.predict_demand(requests, codes, model).collect()
    again = forecasting.predict_demand(requests, loaded_codes, loaded).collect()
    assert first == again and len(first) == 1
    assert first[0].product_id == "PROD_1" and first[0].region == "Asia" and first[0].predicted_units_sold >= 0


def test_parameter_bounds(spark, sales):
    with pytest.raises(ValueError):
        forecasting.train_demand_model(sales, num_trees=5)
    with pytest.raises(ValueError):
        forecasting.train_demand_model(sales, tree_depth=31)
    with pytest.raises(ValueError):
        anomalies.flag_anomalies(sales, outlier_fraction=0.9)
    with pytest.raises(ValueError):
        anomalies.classify_anomalies(sales, F.lit(1.0), 0.5)


def test_request_features_are_complete(spark, trained):
    codes = trained[0]
    request = spark.createDataFrame([("PROD_1", "STORE_A", "North", 10.0, 0.0)], "product_id string, store_id string, region string, price double, discount double")
    got = forecasting.request_features(request.withColumn("target_date", F.lit("2025-06-01").cast("date")), codes).first()
    assert all(got[n] is not None for n in FEATURES)
    assert (got.units_lag_30, got.roll_std_7, got.lag1_to_product_ratio, got.is_weekend_flag) == (20.0, 0.0, 1.0, 1)


def test_anomalies(sales):
    flagged = anomalies.detect_anomalies(sales, 0.05).cache()
    total = sales.count()
    assert 0 < flagged.count() <= 0.05 * total + 1
    assert flagged.count() >= 0.04 * total
    assert flagged.where("score <= 0 or score >= 1").count() == 0
    counts = anomalies.anomaly_counts(flagged).first()
    assert counts.total_anomalies == counts.high_sales_anomalies + counts.low_sales_anomalies == flagged.count()
    top = anomalies.top_anomalies(flagged, 10).collect()
    assert len(top) == 10 and len(top[0]) == 11


def test_forest_finds_a_planted_outlier(spark):
    rng = np.random.default_rng(0)
    rows = [(float(rng.normal(10, 1)), float(rng.integers(0, 20)), float(rng.integers(1, 20)), float(rng.normal(100, 5))) for _ in range(500)]
    rows.append((1000.0, 90.0, 5000.0, 1e6))
    df = spark.createDataFrame(rows, "price double, discount double, units_sold double, revenue double")
    top = anomalies.flag_anomalies(df, 0.01).orderBy(F.desc("score")).first()
    assert top.price == 1000.0


def test_equal_rows_stay_together(spark):
    df = spark.createDataFrame([(1.0, 0.0, 1.0, 1.0)] * 300 + [(50.0, 0.0, 9.0, 450.0)] * 4, "price double, discount double, units_sold double, revenue double")
    got = anomalies.flag_anomalies(df, 0.02).collect()
    assert len(got) in (0, 4)  # copies share one score, so all of them are flagged or none


def test_labels_and_reasons(spark):
    rows = [(50, 25.0), (50, 5.0), (0, 0.0), (3, 0.0)]
    df = spark.createDataFrame(rows, "units_sold int, discount double")
    got = [(r.anomaly_label, r.reason) for r in anomalies.classify_anomalies(df, F.lit(10.0), 2.0).collect()]
    assert got == [
        ("High Sales Anomaly", "Discount driven spike"), ("High Sales Anomaly", "Unexpected sales spike"),
        ("Low Sales Anomaly", "Stockout — zero units sold"), ("Low Sales Anomaly", "Low demand issue"),
    ]


def test_staged_rows_train_too(spark):
    frame = features.feature_frame(features.engineer_features(stage_sales(spark.createDataFrame(SAMPLE, RAW_SCHEMA))))
    assert frame.count() == 5


def plain_tree(x, y, w):
    """Leaf means by trying every cut of every feature, until leaves are pure."""
    best = None
    for f in range(len(x)):
        for v in np.unique(x[f])[:-1]:
            left = x[f] <= v
            parts = [(w[s].sum(), (w * y)[s].sum()) for s in (left, ~left)]
            gain = sum(m * m / n for n, m in parts)
            if best is None or gain > best[0] + 1e-9:
                best = gain, f, v
    mean = (w * y).sum() / w.sum()
    if best is None or len(np.unique(y)) == 1 or best[0] <= mean * mean * w.sum() + 1e-9:
        return np.full(len(y), mean)
    left = x[best[1]] <= best[2]
    out = np.empty(len(y))
    for side in (left, ~left):
        out[side] = plain_tree(x[:, side], y[side], w[side])
    return out


@pytest.mark.parametrize("seed", range(12))
def test_grown_tree_equals_plain_cuts(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(3, 60)).astype(np.float32)
    x[1] = np.round(x[1])
    y, w = rng.normal(size=60), rng.integers(1, 4, 60)
    tree = trees.grown(x, y, w, 3, None, rng)
    got = tree.value[tree.reached(x)]
    assert got == pytest.approx(plain_tree(x, y, w.astype(float)), abs=1e-5)
    shallow = trees.grown(x, y, w, 3, 2, rng)
    assert len(shallow.value) <= 7 and len(np.unique(shallow.reached(x))) <= 4


def test_two_phases_learn_as_one(spark):
    """Whole trees in one task, and trees of which large nodes are split first, fit and predict about alike; copies agree."""
    rng = np.random.default_rng(1)
    data = [(float(a), float(b), float(c), float(np.sin(a) * 5 + (b > 0.3) * 4 + rng.normal() * 0.1)) for a, b, c in rng.normal(size=(3000, 3))]
    df = spark.createDataFrame(data, "a double, b double, c double, y double").repartition(5)
    test = df.where("c > 1.2")
    fit = df.where("c <= 1.2")
    errors = []
    for most in (10**6, 200):
        forest = trees.train(fit, ["a", "b", "c"], "y", 12, most_rows=most)
        assert (max(len(t.feature) for t in forest.tops) == 1) == (most > 10**5)
        first = sorted(map(tuple, trees.predict(forest, test, part_rows=100).select("a", "prediction").collect()))
        again = trees.train(fit.repartition(3), ["a", "b", "c"], "y", 12, most_rows=10**6) if most > 10**5 else forest
        second = sorted(map(tuple, trees.predict(again, test).select("a", "prediction").collect()))
        assert np.array(second) == pytest.approx(np.array(first), abs=0.6) and (most > 10**5 or first == second)
        truth = dict(test.select("a", "y").collect())
        errors.append(np.mean([abs(truth[a] - p) for a, p in first]))
        assert np.mean([abs(p - truth[a]) for a, p in first]) < 0.45 and len(first) == test.count()
    assert abs(errors[0] - errors[1]) < 0.15


def test_registered_queries_train_the_reference_forest(spark):
    """100 trees of unlimited depth on all rows; the metrics are those of the predictions."""
    from shelfwise.plans import registry_models

    rows, model, metrics = registry_models._model(spark, SF)[0], *registry_models._model(spark, SF)[2:]
    m = metrics.first()
    assert m.num_trees == 100 and len(model.tops) == 100 and m.feature_count == 34
    frame = features.training_rows(features.engineer_features(rows, features.encode_labels(rows)))
    held = frame.where("is_holdout").withColumn("label", F.col("units_sold").cast("double"))
    got = np.array([(r.label, r.prediction) for r in trees.predict(model, held).select("label", "prediction").collect()])
    off = got[:, 1] - got[:, 0]
    want = (np.abs(off).mean(), np.sqrt((off**2).mean()), 1 - (off**2).sum() / ((got[:, 0] - got[:, 0].mean()) ** 2).sum())
    assert (m.mae, m.rmse, m.r2) == pytest.approx(want, abs=1e-3) and m.holdout_rows == len(got)
    deepest = model.subtrees.first()
    assert len(deepest.feature) // 2 > 1000  # nodes of one tree: no depth limit


def test_forecast_of_all_requests(spark, sales, trained):
    codes, model, _ = trained
    requests = sales.select("product_id", F.col("date").alias("target_date"), "price", "discount", "store_id", "region")
    got = forecasting.predict_demand(requests, codes, model)
    assert got.count() == forecasting.valid_requests(requests).count()
    assert got.agg(F.min("predicted_units_sold")).first()[0] >= 0


def test_trees_come_in_turns(spark, monkeypatch):
    """However many trees there are, no job shuffles more rows than one tree's, or a full subtree's for each core."""
    rng = np.random.default_rng(3)
    rows = [(float(a), float(b), float(a > 5)) for a, b in rng.integers(0, 10, (200, 2))]
    df = spark.createDataFrame(rows, "a double, b double, y double")
    turns, plain = [], trees._packed

    def counted(rows, features, tops, *rest):
        turns.append(len(tops))
        return plain(rows, features, tops, *rest)

    monkeypatch.setattr(trees, "_packed", counted)
    cores = spark.sparkContext.defaultParallelism
    forest = trees.train(df, ["a", "b"], "y", 2 * cores + 2, most_rows=200)
    got = trees.predict(forest, df, part_rows=200).select("a", "prediction").collect()
    assert sum(turns) == 2 * (2 * cores + 2) and max(turns) * 126 <= cores * 200
    assert len(got) == 200 and all((p > 0.5) == (a > 5) for a, p in got)
    tops = [trees.Tree.leaf()] * 5
    assert [list(some) for some in trees._in_turn(tops, 10, 25)] == [[0, 1], [2, 3], [4]]
    assert [len(some) for some in trees._in_turn(tops, 10, 5)] == [1] * 5


def test_rows_go_down_a_heap_as_down_its_tree():
    rng = np.random.default_rng(3)
    trees = []
    for n in (1, 2, 40, 256):
        nodes = sorted(anomalies.grow_tree(rng.integers(0, 30, (n, 4)).astype(float), rng, 8))
        trees.append([np.array(c) for c in zip(*nodes)][1:])
    rows = rng.integers(0, 30, (300, 4)).astype(float)
    rows[::7, 1] = np.nan
    heaps = [anomalies.as_heap(*t) for t in trees]
    want = np.zeros(len(rows))
    for feature, cut, left, right, depth in trees:
        for i, row in enumerate(rows):
            node = 0
            while feature[node] >= 0:
                node = left[node] if row[feature[node]] <= cut[node] else right[node]
            want[i] += depth[node]
    assert (anomalies.path_score(heaps, rows, 256) == np.power(2.0, -want / 4 / anomalies.unsuccessful_search(256))).all()
    assert len(anomalies.path_score(heaps, rows[:0], 256)) == 0


def test_turns_give_all_cores_as_many_trees():
    """A turn of ten trees on eight cores would leave six of them idle for half of it."""
    tops = [trees.Tree.leaf()] * 20
    assert [len(some) for some in trees._in_turn(tops, 30, 310, 8)] == [8, 8, 4]
    assert [len(some) for some in trees._in_turn(tops, 30, 100, 8)] == [3] * 6 + [2]
    assert [i for some in trees._in_turn(tops, 1, 17, 8) for i in some] == list(range(20))


def test_a_level_of_a_tree_is_dealt_without_sorting(monkeypatch):
    """Each feature is sorted once, however deep the tree grows."""
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(3, 500)).astype(np.float32), rng.normal(size=500)
    sorts, plain = [], np.argsort
    monkeypatch.setattr(np, "argsort", lambda a, *rest, **more: sorts.append(len(a)) or plain(a, *rest, **more))
    tree = trees.grown(x, y, np.ones(500, np.uint8), 2, None, rng)
    assert len(sorts) == 3 and (tree.value[tree.reached(x)] == y.astype(np.float32)).all()
