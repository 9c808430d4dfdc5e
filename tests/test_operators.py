"""Hand-worked cases: ties, nulls, constant series, single class, skew, sinks."""

import datetime as dt
import math
import os

import pytest
from pyspark.sql import functions as F

from chartwise.functions import stats as st
from chartwise.operators import batches, cohort, metrics, observations, predictions, ranking, splits, text, timeline, web
from chartwise.sources import files


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


# ---------------------------------------------------------------- ranking

def test_positions_skewed_group_matches_row_number(spark):
    # group 0 holds ~90 % of the rows
    df = spark.range(0, 2000).select(
        F.when(F.col("id") % 10 == 0, F.col("id") % 3 + 1).otherwise(0).alias("g"), F.col("id").alias("v"))
    got = ranking.positions(df, ["v"], group=["g"], out="pos", slices=7)
    expected = df.selectExpr("g", "v", "row_number() OVER (PARTITION BY g ORDER BY v) - 1 AS pos")
    assert rows(got, "g", "v", "pos") == rows(expected, "g", "v", "pos")


def test_running_sum_and_max(spark):
    df = spark.createDataFrame([(g, i, (i * 7) % 5) for g in (0, 1) for i in range(50)], "g int, i int, x int")
    s = ranking.running(df, "x", ["i"], group=["g"], out="r", slices=5)
    m = ranking.running(df, "x", ["i"], group=["g"], how="max", out="r", slices=5)
    exp_s = df.selectExpr("g", "i", "coalesce(sum(x) OVER (PARTITION BY g ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING "
                          "AND 1 PRECEDING), 0) AS r")
    exp_m = df.selectExpr("g", "i", "max(x) OVER (PARTITION BY g ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING "
                          "AND 1 PRECEDING) AS r")
    assert rows(s, "g", "i", "r") == rows(exp_s, "g", "i", "r")
    assert rows(m, "g", "i", "r") == rows(exp_m, "g", "i", "r")


# ---------------------------------------------------------------- cohort

def test_variant_a_equals_window_definition(spark):
    t = dt.datetime
    stays = spark.createDataFrame([
        (1, 10, 100, t(2020, 1, 1), t(2020, 1, 2)),
        (1, 11, 101, t(2020, 1, 1), t(2020, 1, 3)),   # tie on intime: stay_id breaks it
        (1, 12, 102, t(2020, 2, 1), None),
        (2, 20, 200, t(2020, 1, 1), None),            # no discharge before stay 2
        (2, 21, 201, t(2020, 1, 5), t(2020, 1, 6)),
        (3, 30, 300, t(2020, 1, 1), t(2020, 1, 2)),   # single stay
    ], "subject_id bigint, hadm_id bigint, stay_id bigint, intime timestamp, outtime timestamp")
    ids = spark.createDataFrame([(1,), (2,), (3,)], "subject_id bigint")
    a = cohort.readmitted_stays_a(stays, ids)
    assert rows(a, "subject_id", "stay_id", "record_seq") == [(1, 101, 2)]
    assert a.first()["gap_days"] == pytest.approx(-1.0)  # admitted a day before the previous discharge
    b = cohort.readmitted_stays_b(stays, ids)
    assert rows(b, "subject_id", "stay_id", "record_seq") == [(1, 101, 2), (1, 102, 3)]


def test_lookback_inclusive_end_anchored(spark):
    t = dt.datetime
    ev = spark.createDataFrame([
        (1, t(2020, 1, 2, 12), 220045, 1.0), (1, t(2020, 1, 1, 12), 220045, 2.0),  # exactly 24 h before: kept
        (1, t(2020, 1, 1, 11), 220045, 3.0), (1, t(2020, 1, 3, 0), 999999, 4.0),   # other item: ignored for max
        (2, t(2020, 1, 1), 220045, 5.0),
    ], "subject_id bigint, charttime timestamp, itemid int, valuenum double")
    out = cohort.lookback(ev, spark.createDataFrame([(1,)], "subject_id bigint"))
    assert sorted(r.valuenum for r in out.collect()) == [1.0, 2.0]


def test_age_band_bad_text_drops_out(spark):
    p = spark.createDataFrame([(1, "30"), (2, "35"), (3, "36"), (4, "abc"), (5, None)], "subject_id bigint, anchor_age string")
    assert rows(cohort.age_band(p), "subject_id") == [(1,), (2,)]


# ---------------------------------------------------------------- timeline

def test_label_map_last_duplicate_wins(spark):
    items = spark.createDataFrame([(0, "1", "a"), (1, "1", "b"), (2, "2", "c")], "pos int, itemid string, label string")
    assert rows(timeline.label_map(items), "itemid", "label") == [("1", "b"), ("2", "c")]


def test_item_series_constant_and_minmax(spark):
    raw = spark.createDataFrame([
        (1, 1, "7", "2020-01-01 00:00:00", "5"), (2, 1, "7", "2020-01-01 01:00:00", "5"),
        (3, 1, "8", "2020-01-01 00:00:00", "1"), (4, 1, "8", "2020-01-01 02:00:00", "3"),
        (5, 1, "8", "bad", "2"), (6, 1, "8", "2020-01-01 01:00:00", "n/a"),
    ], "event_id bigint, subject_id bigint, itemid string, charttime string, valuenum string")
    items = spark.createDataFrame([(0, "8", "Eight")], "pos int, itemid string, label string")
    out = {r.event_id: r for r in timeline.item_series(raw, items).collect()}
    assert set(out) == {1, 2, 3, 4}
    assert out[1].norm_value == 0.0 and out[1].series_no == 0 and out[1].legend == "7"
    assert out[3].norm_value == 0.0 and out[4].norm_value == 1.0 and out[4].plot_value == 2.0
    assert out[3].legend == "8 - Eight"
    assert out[3].time_diff_hours == 2.0


# ---------------------------------------------------------------- observations

def test_jitter_requires_matching_columns(spark):
    for ddl in ("id bigint, t double, value_1 double", "id bigint, t double, value_1 double, mask_2 int"):
        with pytest.raises(ValueError):
            observations.jitter(spark.createDataFrame([], ddl))


def test_jitter_moves_every_feature_a_step_of_its_own(spark):
    k = 11
    cols = [f"value_{i} double" for i in range(k)] + [f"mask_{i} int" for i in range(k)]
    full = [(n, 9.0, "note", *[float(i) for i in range(k)], *([1] * k)) for n in range(40)]
    some = [(100, 9.0, "one", *[0.0] * k, *([0] * 4 + [1] + [0] * 6)), (101, 9.0, "none", *[0.0] * k, *([0] * k)),
            (102, 0.002, "early", *[0.0] * k, *([1] * 3 + [0] * 8))]
    df = spark.createDataFrame(full + some, "id bigint, t double, note string, " + ", ".join(cols))
    out = observations.jitter(df, 0.001, seed=1).collect()
    by_id = {}
    for r in out:
        by_id.setdefault(r.id, []).append(r)
    orders = set()
    for n in range(40):
        got = sorted(by_id[n], key=lambda r: -r.t)
        assert [round((9.0 - r.t) / 0.001) for r in got] == list(range(k))
        masks = [[r[f"mask_{i}"] for i in range(k)] for r in got]
        assert all(sum(m) == 1 for m in masks)
        orders.add(tuple(m.index(1) for m in masks))
    assert len(orders) > 30 and all(sorted(o) == list(range(k)) for o in orders)
    assert len({o[0] for o in orders}) > 5  # no feature is always the one that stays
    assert [(r.t, r.note) for r in by_id[100] + by_id[101]] == [(9.0, "one"), (9.0, "none")]
    assert sorted(round(r.t, 6) for r in by_id[102]) == [0.0, 0.001, 0.002] and len(out) == 40 * k + 5


def test_jitter_splits_and_clamps(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0, 2.0, 1, 1), (2, 1.0, 1.0, 0.0, 1, 0)],
                               "id bigint, t double, value_1 double, value_2 double, mask_1 int, mask_2 int")
    out = observations.jitter(df, 0.5, seed=3).collect()
    assert len(out) == 3
    assert all(r.t >= 0 for r in out)
    both = [r for r in out if r.id == 1]
    assert sorted((r.mask_1, r.mask_2) for r in both) == [(0, 1), (1, 0)]


def test_covariate_check_counts(spark):
    obs = spark.createDataFrame([(1, 0.0), (2, 0.0)], "id bigint, t double")
    cov = spark.createDataFrame([(2, 1.0), (2, 2.0), (3, 0.0)], "id bigint, c double")
    r = observations.covariate_check(obs, cov).first()
    assert (r.n_ids, r.n_cov_rows, r.ids_without_cov, r.cov_without_obs, r.duplicated_cov_ids) == (2, 3, 1, 1, 1)


def test_from_arrays_shape_mismatch_raises(spark):
    df = spark.createDataFrame([(1, 0.0, [1.0, 2.0, 3.0], [1.0, 1.0, 0.0])],
                               "id bigint, t double, values array<double>, mask array<double>")
    with pytest.raises(Exception, match="shape mismatch"):
        observations.from_arrays(df, 2).collect()


# ---------------------------------------------------------------- predictions and metrics

def test_nearest_exact_first_tie_to_earlier(spark):
    ev = spark.createDataFrame([(1, 10), (1, 12), (1, 1), (1, 30)], "id bigint, tick int")
    pt = spark.createDataFrame([(1, 9), (1, 10), (1, 11), (1, 13), (1, 5)], "id bigint, tick int")
    got = dict((r.tick, r.matched_tick) for r in predictions.nearest_ticks(ev, pt).collect())
    assert got == {10: 10, 12: 11, 1: 5, 30: 13}


def test_erf_approximation():
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    xs = [i / 10 for i in range(-50, 51)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r[0] for r in df.select(st.erf(F.col("x"))).collect()]
    assert max(abs(g - math.erf(x)) for g, x in zip(got, xs)) < 2e-7


def _pairwise_auc(data):
    pos = [s for s, y in data if y == 1]
    neg = [s for s, y in data if y == 0]
    wins = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
    return wins / (len(pos) * len(neg))


def test_auc_ties_and_single_class(spark):
    data = [(0.1, 0), (0.4, 1), (0.4, 0), (0.8, 1), (0.8, 1), (0.2, 0), (0.6, 0)]
    df = spark.createDataFrame([(0, math.log(s / (1 - s)), y) for s, y in data], "batch int, logit double, label int")
    got = metrics.class_losses(df).first().auc
    assert got == pytest.approx(_pairwise_auc(data))
    one = spark.createDataFrame([(0, 0.3, 1), (0, -0.2, 1)], "batch int, logit double, label int")
    assert metrics.class_losses(one).first().auc == 0.5
    assert metrics.class_losses(one, fallback=0.0).first().auc == 0.0


def test_masked_corr_modes_differ_when_unmasked_predictions(spark):
    ev = spark.createDataFrame([(0, 1.0, 1.0, 1.2), (0, 2.0, 1.0, 1.9), (0, 3.0, 1.0, 3.1), (0, 0.0, 0.0, 5.0)],
                               "k int, x double, m double, mean double")
    r = metrics.masked_corr(ev).first()
    assert r.corr_pearson == pytest.approx(0.98865, abs=1e-4)  # worked by hand on the three masked rows
    assert r.corr_reference != pytest.approx(r.corr_pearson)


def test_histogram_right_edge_and_constant(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (0.5,)], "v double")
    h = metrics.histogram(df, "v", bins=2)["bins"]
    assert rows(h, "bin", "count") == [(0, 1), (1, 2)]
    c = metrics.histogram(spark.createDataFrame([(3.0,)], "v double"), "v", bins=2)["bins"]
    assert rows(c, "bin", "lower", "bucket_limit", "count") == [(0, 2.5, 3.0, 0), (1, 3.0, 3.5, 1)]


def test_running_best_strict(spark):
    m = spark.createDataFrame([(0, 0, -2000.0), (0, 1, 1.0), (0, 2, 1.0), (0, 3, 2.0)], "run int, step int, val_metric double")
    got = [r.new_best for r in metrics.running_best(m).orderBy("step").collect()]
    assert got == [False, True, False, True]


def test_report_zero_predicted_class(spark):
    p = spark.createDataFrame([(0, 0), (0, 0), (1, 0)], "label int, pred int")
    rep = {r["class"]: r for r in metrics.report(p)["report"].collect()}
    assert rep["1"].precision == 0.0 and rep["1"].recall == 0.0 and rep["1"].support == 1
    assert rep["macro avg"].support == 3


# ---------------------------------------------------------------- splits

def test_fold_sizes_follow_ceil_rule(spark):
    ids = spark.range(0, 37).withColumnRenamed("id", "id")
    f = splits.folds(ids, n_folds=2, test_size=0.1, val_size=0.2, seed=1)
    sizes = {(r.fold, r.split): r["count"] for r in f.groupBy("fold", "split").count().collect()}
    n_test = math.ceil(0.1 * 37)
    n_val = math.ceil(0.2 * (37 - n_test))
    for fold in (0, 1):
        assert sizes[(fold, "test")] == n_test and sizes[(fold, "val")] == n_val
        assert sizes[(fold, "train")] == 37 - n_test - n_val


# ---------------------------------------------------------------- text and web

def test_words_unicode_and_stop_words(spark):
    df = spark.createDataFrame([(1, "The Ärzte-study of data, via café model!! ab")], "work_id bigint, title string")
    got = [r.word for r in text.words(df, "title", ["work_id"]).orderBy("pos").collect()]
    assert got == ["Ärztestudy", "Café"]


def test_top_words_ties_by_first_occurrence(spark):
    w = spark.createDataFrame([("a", 1, "2001", "zeta beta gamma"), ("a", 2, "2001", "gamma zeta delta"),
                               ("a", 3, None, "only")], "author string, work_id bigint, year string, title string")
    top = text.top_words(w).where("year = '2001'").orderBy("rank").collect()
    assert [r.word for r in top] == ["Zeta", "Gamma", "Beta"]


def test_forecast_first_high_after_today(spark):
    html = ('<li class="tombstone-container"><p class="period-name">Today</p><p class="temp">High: 9 F</p></li>'
            '<li class="tombstone-container"><p class="period-name">Tonight</p><p class="temp">Low: 1 F</p></li>'
            '<li class="tombstone-container"><p class="period-name">Sat</p><p class="short-desc">A<br>B</p>'
            '<p class="temp">High: -4 F</p></li>')
    pages = spark.createDataFrame([(1, " mdw ", html), (2, "Denver, CO", "<p>none</p>")], "page_id bigint, location string, html string")
    out = {r.page_id: r for r in web.next_high(pages).collect()}
    assert (out[1].period, out[1].temp, out[1].description, out[1].city) == ("Sat", -4, "A B", "Chicago Midway Airport")
    assert out[2].temp is None and out[2].city == "Denver"


# ---------------------------------------------------------------- sources and sinks

def test_csv_strings_and_views(spark, scratch):
    p = os.path.join(scratch, "p.csv")
    with open(p, "w") as f:
        f.write("SUBJECT_ID,anchor_age\n1,31\n2,x\n")
    df = files.read_csv_strings(spark, p)
    assert [t for _, t in df.dtypes] == ["string", "string"]
    files.register_views({"patients_csv": df})
    assert spark.sql("SELECT count(*) FROM patients_csv").first()[0] == 2


def test_subject_sink_and_folder_reload(spark, scratch):
    t = dt.datetime
    df = spark.createDataFrame([(1, t(2020, 1, 1), 220045, 1.0), (1, t(2020, 1, 2), 220045, None),
                                (2, t(2020, 1, 1), 220050, 3.0)],
                               "subject_id bigint, charttime timestamp, itemid int, valuenum double")
    out = os.path.join(scratch, "subjects")
    files.write_per_subject(df, out)
    assert {"subject_id=1", "subject_id=2"} <= set(os.listdir(out))
    back = files.read_subject_folder(spark, out, df.schema)
    assert rows(back, "subject_id", "valuenum") == [(1, 1.0), (2, 3.0)]
    empty = files.read_subject_folder(spark, os.path.join(scratch, "missing"), df.schema)
    assert empty.count() == 0 and empty.columns == df.columns


def test_dimension_fallback_and_contract(spark, scratch):
    missing = files.read_dimension(spark, os.path.join(scratch, "nope.csv"))
    assert missing.columns == ["itemid", "label", "pos"] and missing.count() == 0
    obs = os.path.join(scratch, "obs.csv")
    lab = os.path.join(scratch, "lab.csv")
    with open(obs, "w") as f:
        f.write("ID,Time,Value_0,Mask_0\n1,0.5,2,1\n")
    with open(lab, "w") as f:
        f.write("label,ID\n1,1\n")
    with pytest.raises(ValueError):
        files.read_observation_files(spark, obs, label_path=lab)
    got = files.read_observation_files(spark, obs)["obs"]
    assert got.columns == ["id", "t", "value_0", "mask_0"]


def test_jdbc_reader_builds_options(spark):
    # loading needs a database; the option mapping is what can be checked here
    assert files.jdbc_options("jdbc:x", "SELECT 1", user="u", password="p", partition_column="id", lower=0, upper=10, partitions=4) == {
        "url": "jdbc:x", "fetchsize": "10000", "user": "u", "password": "p", "dbtable": "(SELECT 1) AS q", "partitionColumn": "id",
        "lowerBound": "0", "upperBound": "10", "numPartitions": "4"}
    assert files.jdbc_options("jdbc:x", "SELECT 1") == {"url": "jdbc:x", "fetchsize": "10000", "query": "SELECT 1"}


def test_fold_sink_partition_pruning(spark, scratch):
    f = splits.folds(spark.range(0, 30), n_folds=2)
    path = os.path.join(scratch, "folds")
    splits.write_folds(f, path)
    back = splits.read_fold(spark, path, 1, "test")
    assert back.count() == math.ceil(0.1 * 30)
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(fold" in plan and "PushedFilters: []" in plan


def test_preview_total_order(spark):
    df = spark.range(0, 100)
    assert [r.id for r in files.preview(df, ["id"], 3).collect()] == [0, 1, 2]


def test_hash_ordered_positions_match_row_number(spark):
    df = spark.range(0, 3000).select(
        F.when(F.col("id") % 7 == 0, 1).otherwise(0).alias("g"), F.col("id"),
        F.md5(F.col("id").cast("string")).alias("_h"))
    got = ranking.positions(df, ["_h", "id"], group=["g"], out="pos", slices=13, hash_ordered=True)
    expected = df.selectExpr("g", "id", "row_number() OVER (PARTITION BY g ORDER BY _h, id) - 1 AS pos")
    assert rows(got, "g", "id", "pos") == rows(expected, "g", "id", "pos")


def test_metric_log_sink_may_run_twice(spark, scratch):
    wide = spark.createDataFrame([(0, 1, -0.5, 2.0)], "run int, step int, val_metric double, loss double")
    path = os.path.join(scratch, "log")
    files.write_metric_log(metrics.metric_log(wide), path)
    second = metrics.metric_log(wide.withColumn("step", F.lit(2)))
    files.write_metric_log(second, path)
    files.write_metric_log(second, path)
    back = files.read_metric_log(spark, path)
    assert rows(back, "step", "tag", "value") == [(1, "loss", 2.0), (1, "val_metric", -0.5),
                                                  (2, "loss", 2.0), (2, "val_metric", -0.5)]
    files.write_metric_log(metrics.metric_log(wide.withColumn("loss", F.lit(3.0))), path)
    assert rows(files.read_metric_log(spark, path).where("tag = 'loss'"), "step", "value") == [(1, 3.0), (2, 2.0)]


def test_subject_and_fold_sinks_may_run_twice(spark, scratch):
    t = dt.datetime
    schema = "subject_id bigint, charttime timestamp, itemid int, valuenum double"
    both = spark.createDataFrame([(1, t(2020, 1, 1), 5, 1.0), (2, t(2020, 1, 1), 5, 3.0)], schema)
    out = os.path.join(scratch, "subjects")
    files.write_per_subject(both, out)
    before = sorted(os.listdir(os.path.join(out, "subject_id=2")))
    files.write_per_subject(both.where("subject_id = 1").withColumn("valuenum", F.lit(7.0)), out)
    assert rows(files.read_subject_folder(spark, out, both.schema), "subject_id", "valuenum") == [(1, 7.0), (2, 3.0)]
    assert sorted(os.listdir(os.path.join(out, "subject_id=2"))) == before  # not touched
    f = splits.folds(spark.range(0, 30), n_folds=2)
    path = os.path.join(scratch, "folds")
    splits.write_folds(f, path)
    splits.write_folds(f, path)
    assert spark.read.parquet(path).count() == 60


def test_folder_keeps_all_columns_and_widens_types(spark, scratch):
    out = os.path.join(scratch, "mixed")
    parts = [spark.createDataFrame([(1, 2, 1.5)], "a int, b int, c float"),
             spark.createDataFrame([(2.25, 1 << 40, "x")], "c double, a bigint, d string"),
             spark.createDataFrame([(3, "y")], "b bigint, d string")]
    for k, p in enumerate(parts):
        p.coalesce(1).write.mode("append").parquet(os.path.join(out, f"p{k}.d"))
    flat = os.path.join(scratch, "flat")
    os.makedirs(flat)
    for k in range(3):
        d = os.path.join(out, f"p{k}.d")
        name = next(n for n in os.listdir(d) if n.endswith(".parquet"))
        os.link(os.path.join(d, name), os.path.join(flat, f"f{k}.parquet"))
    assert {f.name: f.dataType.simpleString() for f in files.folder_schema(spark, flat).fields} == {
        "a": "bigint", "b": "bigint", "c": "double", "d": "string"}
    got = files.read_subject_folder(spark, flat).select("a", "b", "c", "d").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, 2, 1.5, None), (1 << 40, None, 2.25, "x"), (None, 3, None, "y")], key=str)
    bad = os.path.join(scratch, "bad")
    spark.createDataFrame([("z",)], "a string").coalesce(1).write.parquet(bad)
    name = next(n for n in os.listdir(bad) if n.endswith(".parquet"))
    os.link(os.path.join(bad, name), os.path.join(flat, "z.parquet"))
    with pytest.raises(ValueError, match=r"'a' is bigint.*|'a' is int.*z\.parquet"):
        files.folder_schema(spark, flat)
    assert files.read_subject_folder(spark, os.path.join(scratch, "none")).columns == []


def test_ids_in_order_of_first_appearance(spark, scratch):
    path = os.path.join(scratch, "stored")
    order = [9, 4, 9, 7, 4, 1, 7]
    spark.createDataFrame([(i, k) for k, i in enumerate(order)], "id int, k int").coalesce(1).write.parquet(path)
    stored = files.with_file_position(spark, path)
    got = observations.reindex(stored, {"t": spark.createDataFrame([(7, "x"), (5, "y")], "id int, v string")}, order="appearance")
    assert rows(got["mapping"], "id", "new_id") == [(1, 3), (4, 1), (7, 2), (9, 0)]
    assert rows(got["t"], "id", "new_id", "v") == [(7, 2, "x")]
    assert rows(observations.reindex(stored, {})["mapping"], "id", "new_id") == [(1, 0), (4, 1), (7, 2), (9, 3)]
    with pytest.raises(ValueError):
        observations.reindex(stored, {}, order="size")


def test_sequenced_stays_hot_subject_matches_window(spark):
    # subject 1 holds ~90 % of the stays; equal admission times tie-break on stay_id
    base = spark.range(0, 1500).select(
        F.when(F.col("id") % 10 == 0, F.col("id") % 7 + 2).otherwise(1).alias("subject_id"),
        F.col("id").alias("hadm_id"), (F.col("id") + 1000).alias("stay_id"),
        (F.lit(dt.datetime(2020, 1, 1)) + F.make_dt_interval(days=(F.col("id") % 97).cast("int"))).alias("intime"),
    ).withColumn("outtime", F.when(F.col("hadm_id") % 11 == 0, None).otherwise(F.col("intime") + F.expr("INTERVAL 1 DAY")))
    ids = base.select("subject_id").distinct()
    got = cohort.sequenced_stays(base, ids)
    exp = base.selectExpr(
        "subject_id", "stay_id",
        "CAST(row_number() OVER (PARTITION BY subject_id ORDER BY intime, stay_id) AS BIGINT) AS record_seq",
        "lag(outtime) OVER (PARTITION BY subject_id ORDER BY intime, stay_id) AS previous_outtime")
    assert rows(got, "subject_id", "stay_id", "record_seq", "previous_outtime") == \
        rows(exp, "subject_id", "stay_id", "record_seq", "previous_outtime")


def test_first_by_hot_group_matches_window(spark):
    df = spark.range(0, 3000).select(
        F.when(F.col("id") % 9 == 0, F.col("id") % 4 + 1).otherwise(0).alias("id"),
        (F.col("id") * 0.1).alias("t"), (F.col("id") % 13).cast("double").alias("value_0"))
    near = ranking.first_by(df, ["id"], [F.abs(F.col("t") - 44.0), "value_0", "t"])
    last = ranking.first_by(df, ["id"], ["t"], last=True)
    exp_near = df.selectExpr("*", "row_number() OVER (PARTITION BY id ORDER BY abs(t - 44.0), value_0, t) AS rn").where("rn = 1")
    exp_last = df.selectExpr("*", "row_number() OVER (PARTITION BY id ORDER BY t DESC) AS rn").where("rn = 1")
    assert rows(near, "id", "t", "value_0") == rows(exp_near, "id", "t", "value_0")
    assert rows(last, "id", "t", "value_0") == rows(exp_last, "id", "t", "value_0")


def test_losses_count_every_observed_value(spark):
    obs = spark.createDataFrame([(1, 0, 0, 1.0, 1.0), (1, 1, 0, 2.0, 1.0), (2, 0, 0, 3.0, 1.0)], "id long, tick int, k int, x double, m double")
    pred = spark.createDataFrame([(1, 0, s, 0, 1.0, 0.0) for s in (0, 1)] + [(1, 1, 0, 0, 1.0, 0.0)],
                                 "id long, tick int, seq int, k int, mean double, logvar double")
    out = {r.id: r for r in metrics.observation_losses(obs, pred).collect()}
    assert (out[1].num_obs, out[1].num_unmatched, out[2].num_obs, out[2].num_unmatched) == (2.0, 1.0, 1.0, 1.0)
    assert out[2].loss == 0.0 and out[1].loss_pre == pytest.approx(0.5 * math.log(2 * math.pi))


def test_unmatched_predictions_leave_both_sides_of_a_ratio(spark):
    ev = spark.createDataFrame([(0, 2.0, 1.0, 1.0, 0.0), (0, 5.0, 1.0, None, None)], "k int, x double, m double, mean double, logvar double")
    r = metrics.masked_summary(ev).first()
    assert (r.num_obs, r.num_unmatched, r.mse) == (2.0, 1.0, 1.0)


def test_masked_corr_equals_its_definition(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    rows_ = [(int(k), float(x), float(h), float(m)) for k, x, h, m in zip(
        rng.integers(0, 3, 400), 1e6 + rng.normal(size=400), rng.normal(size=400), rng.integers(0, 2, 400), strict=True)]
    got = {r.k: r for r in metrics.masked_corr(spark.createDataFrame(rows_, "k int, x double, mean double, m double")).collect()}
    for k in range(3):
        x, h, m = (np.array([r[i] for r in rows_ if r[0] == k]) for i in (1, 2, 3))
        for name, mt, mh in (("corr_reference", x.sum() / m.sum(), h.sum() / m.sum()),
                             ("corr_pearson", (x * m).sum() / m.sum(), (h * m).sum() / m.sum())):
            want = ((x - mt) * (h - mh) * m).sum() / np.sqrt(((x - mt) ** 2 * m).sum() * ((h - mh) ** 2 * m).sum())
            assert got[k][name] == pytest.approx(want, abs=1e-7)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_metrics_scan_their_input_once(spark, scratch):
    path = os.path.join(scratch, "t")
    spark.range(100).selectExpr("int(id % 3) AS label", "int(id % 2) AS pred", "int(id % 2) AS k", "double(id) AS x",
                                "double(id) AS mean", "1.0D AS m").write.parquet(path)
    df = spark.read.parquet(path)
    out = metrics.report(df)
    for one in (out["report"], out["confusion"], out["accuracy"], metrics.class_weights(df), metrics.masked_corr(df)):
        assert plan_of(one).count("Relation") == 1
        assert "Join" not in plan_of(one)


def test_nearest_ticks_is_linear_in_a_long_series(spark):
    import time

    evals = spark.range(40000).selectExpr("1L AS id", "int(id * 3) AS tick")
    pred = spark.range(40000).selectExpr("1L AS id", "int(id * 3 + 1) AS tick").union(spark.range(5).selectExpr("2L AS id", "int(id) AS tick"))
    out = predictions.nearest_ticks(evals, pred)
    assert "UnboundedFollowing" not in out._jdf.queryExecution().optimizedPlan().toString()
    t0 = time.perf_counter()
    got = out.selectExpr("count(*) AS n", "count_if(matched_tick = tick + 1) AS near").first()
    assert (got.n, got.near) == (40000, 40000) and time.perf_counter() - t0 < 10


def test_nearest_ticks_of_one_id_are_many_tasks(spark):
    """A hot id's ticks meet in slices of a bounded number of rows; neighbours are found across empty slices."""
    evals = spark.range(0, 3000, 7).selectExpr("1L AS id", "int(id) AS tick").union(spark.createDataFrame([(2, 5), (3, 50), (4, -90)], "id long, tick int"))
    pred = spark.range(0, 3000, 13).where("id < 900 OR id > 2100").selectExpr("1L AS id", "int(id) AS tick").union(
        spark.createDataFrame([(2, 4000), (2, -4000), (4, -1000), (4, 0), (5, 1)], "id long, tick int"))
    p = {}
    for r in pred.collect():
        p.setdefault(r.id, []).append(r.tick)
    want = sorted((r.id, r.tick, min(p.get(r.id, []), key=lambda x: (abs(x - r.tick), x), default=None)) for r in evals.collect())
    for width in (10, 64, predictions.SLICE_TICKS):
        got = predictions.nearest_ticks(evals, pred, width)
        assert sorted((r.id, r.tick, r.matched_tick) for r in got.collect()) == want
    big = predictions.nearest_ticks(spark.range(40000).selectExpr("1L AS id", "int(id * 3) AS tick"),
                                    spark.range(40000).selectExpr("1L AS id", "int(id * 3 + 1) AS tick"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = big.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(tasks) == 4  # every shuffle partition of the session works on the one id


def test_first_rows_per_id_are_cut_before_the_shuffle(spark):
    # id 1 holds ~90 % of the rows
    obs = spark.range(0, 5000).selectExpr("if(id % 10 = 0, id % 7 + 2, 1L) AS id", "double(id) AS t", "double(id % 13) AS value_0", "1 AS mask_0")
    got = observations.validation_split(obs, 100.0, 3, parts=("after",))["after"]
    want = obs.where("t > 100").selectExpr("*", "row_number() OVER (PARTITION BY id ORDER BY t) AS rn").where("rn <= 3").drop("rn")
    assert rows(got, "id", "t") == rows(want, "id", "t")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2 and "rangepartitioning" not in plan
    near = observations.validation_split(obs, 100.0, t_closest=200.5, parts=("after",))["after"]
    want = obs.where("t > 100").selectExpr("*", "row_number() OVER (PARTITION BY id ORDER BY abs(t - 200.5), value_0, t) AS rn").where("rn = 1")
    assert rows(near, "id", "t") == rows(want, "id", "t")
    # a cut at 0 is a cut
    zero = observations.validation_split(obs.withColumn("t", F.col("t") - 2000), -100.0, 1, t_val_from=0.0, parts=("after",))["after"]
    assert zero.agg(F.min("t")).first()[0] == 0.0


def test_nested_elements_are_whole(spark):
    html = {1: '<div class="box">one <div>two</div> three</div> four',
            2: '<div class="a box b">x<br>y<p class=box>in</div>z',
            3: '<!-- <div class="box">no</div> --><span CLASS=\'box\'>unclosed <b>q',
            4: '<div class="boxes">no</div><div data-x="a>b" class="box">yes<script>var a="<div class=box>";</script>!</div></div></p><i class="box"></i>',
            5: None, 6: 'a < b <div class="box">1 < 2</div>', 7: '<ul><li class="box">a<ul><li class="box">b</li></ul>c</li></ul>', 8: "", 9: "no tags, box"}
    pages = spark.createDataFrame(list(html.items()), "page_id int, html string")
    got = web.class_texts(pages, "box")
    assert rows(got, "page_id", "pos", "text") == [
        (1, 0, "one two three"), (2, 0, "x y in"), (2, 1, "in"), (3, 0, "unclosed q"), (4, 0, "yes !"), (4, 1, ""), (6, 0, "1 < 2"),
        (7, 0, "a b c"), (7, 1, "b")]
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    # tokens joined are the page
    back = pages.where("html IS NOT NULL").select("html", F.array_join(web.html_tokens(F.col("html")), "").alias("j"))
    assert all(r.html == r.j for r in back.collect())
    nested = ('<div class="tombstone-container"><div class="period-name"><b>Fri</b></div><div class="temp"><div>High:</div> 3</div>'
              '<div class="short-desc">x</div></div><div class="temp">High: 9</div>')
    one = web.next_high(spark.createDataFrame([(1, "A, B", nested), (2, "C", None)], "page_id int, location string, html string"))
    assert rows(one, "page_id", "period", "temp", "description") == [(1, "Fri", 3, "x"), (2, None, None, None)]


def test_profiles_are_parsed_once(spark):
    raw = spark.createDataFrame([(1, "{broken"), (2, None), (3, "[]"), (4, '{"activities-summary":{"works":{"group":[{"work-summary":[{"title":'
                                 '{"title":{"value":"T"}},"publication-date":{"year":{"value":1999}}}]}]}}}')], "profile_id int, body string")
    for made, want in ((web.profile_affiliations(raw), []), (web.profile_works(raw), [(4, 0, "T", "1999")])):
        assert sorted(map(tuple, made.collect())) == want
        assert made._jdf.queryExecution().optimizedPlan().toString().count("parseJson(") == 1
    assert rows(web.parse_profiles(raw).selectExpr("profile_id", "parsed IS NULL AS bad"), "profile_id", "bad") == [
        (1, True), (2, True), (3, False), (4, False)]


def test_rounding_follows_the_step(spark):
    df = spark.createDataFrame([(0.75, 4.5, 0.15, 0.05)], "a double, b double, c double, d double")
    r = df.select(predictions.round_to_step(F.col("a"), 0.25).alias("a"), predictions.round_to_step(F.col("b"), 1.5).alias("b"),
                  predictions.round_to_step(F.col("c"), 0.05).alias("c"), predictions.round_to_step(F.col("d"), 0.1).alias("d"),
                  predictions.round_to_step(F.col("b"), 1.0).alias("e")).first()
    assert (r.a, r.b, r.c, r.e) == (0.75, 4.5, 0.15, 4.0) and r.d in (0.0, 0.1)


def test_top_words_with_large_ids_and_equal_counts(spark):
    works = spark.createDataFrame([("a", 1 << 40, "2000", "zebra apple"), ("a", 5, "2000", "mango zebra"), ("a", 6, "2000", "apple mango")],
                                  "author string, work_id long, year string, title string")
    got = [(r.word, r.n) for r in text.top_words(works).orderBy("rank").collect()]
    assert got == [("Mango", 2), ("Zebra", 2), ("Apple", 2)]


def test_readers_ask_the_file_system(spark, scratch):
    for k in (1, 2):
        with open(os.path.join(scratch, f"d{k}.csv"), "w") as f:
            f.write(f"itemid,label\n{k},first\n9,from {k}\n")
        spark.createDataFrame([(k, 1.0)], "subject_id long, valuenum double").write.parquet(os.path.join(scratch, f"p{k}"))
    dim = files.read_dimension(spark, os.path.join(scratch, "d*.csv"))
    assert rows(dim, "pos", "itemid", "label") == [(0, "1", "first"), (1, "9", "from 1"), (2, "2", "first"), (3, "9", "from 2")]
    assert rows(timeline.label_map(dim), "itemid", "label") == [("1", "first"), ("2", "first"), ("9", "from 2")]
    schema = spark.read.parquet(os.path.join(scratch, "p1")).schema
    assert files.read_subject_folder(spark, os.path.join(scratch, "p*"), schema).count() == 2
    assert files.read_subject_folder(spark, "file:" + os.path.join(scratch, "p1"), schema).count() == 1
    assert files.read_subject_folder(spark, "file:" + os.path.join(scratch, "none"), schema).count() == 0


def test_observation_files_feed_split_and_batch(spark, scratch):
    path = os.path.join(scratch, "obs.csv")
    with open(path, "w") as f:
        f.write("ID,Time,Value_0,Mask_0\n1,0.5,2,1\n1,1.5,NaN,1\n1,2.5,4,1\n2,0.5,1,1\n")
    obs = files.read_observation_files(spark, path)["obs"].withColumn("tick", (F.col("t") * 10).cast("int"))
    assert obs.where("value_0 IS NULL").count() == 1
    s = observations.validation_split(obs, 1.0, max_val_samples=1)
    assert rows(s["ids"], "id") == [(1,)] and rows(s["after"], "id", "t") == [(1, 1.5)]
    assign = splits.batches(splits.folds(obs, n_folds=1), 10)
    out = batches.time_batch(obs, assign)["rows"]
    assert out.count() == 4 and {"value_0", "mask_0", "obs_idx"} <= set(out.columns)
    assert rows(observations.rows_of(obs, 2), "id", "t") == [(2, 0.5)]


def test_profile_names_and_groups(spark):
    body = '{"person":{"name":{%s}},"activities-summary":{"employments":{"affiliation-group":[%s]}}}'
    job = '{"summaries":[{"employment-summary":{"organization":{"name":"A"},"start-date":{"year":{"value":"1"}},"end-date":null}}]}'
    data = [(1, body % ('"given-names":{"value":"G"},"family-name":{"value":"F"}', job)), (2, body % ('"given-names":{"value":"G"}', job)),
            (3, body % ('"given-names":{"value":"G"},"family-name":null', job)), (4, body % ('"given-names":{"value":"G"}', "")),
            (5, body % ('"given-names":{"value":"G"}', '{"summaries":[]},' + job)), (6, '{"activities-summary":{}}'),
            (7, body % ('"given-names":{"value":"G"}', '{"summaries":[{"employment-summary":{"organization":{}}}]}'))]
    got = rows(web.profile_affiliations(spark.createDataFrame(data, "profile_id int, body string")), "profile_id", "full_name", "aff_no", "affiliation")
    assert got == [(1, "G F", 0, "A (1-Present)"), (2, "G", 0, "A (1-Present)"), (3, "Unknown Name", 0, "A (1-Present)"),
                   (5, "G", 1, "A (1-Present)"), (7, "G", 0, "None (?-Present)")]


def test_blocks_by_class_token_on_any_tag(spark):
    html = ('<div class="x tombstone-container y"><span class="period-name">Sat</span><b class="temp temp-high">High: <i>7</i> F</b></div>'
            '<div class="not-tombstone-container"><span class="temp">High: 9</span></div>')
    pages = spark.createDataFrame([(1, "Denver, CO", html)], "page_id int, location string, html string")
    out = web.next_high(pages)
    assert (out.first().period, out.first().temp) == ("Sat", 7)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert rows(web.class_texts(pages, "temp"), "pos", "text") == [(0, "High: 7 F"), (1, "High: 9")]


def test_ensemble_on_separable_data(spark):
    from chartwise.operators import classify

    data = spark.range(300).selectExpr("id", "int(id % 5 = 0) AS label",
                                       "array(double(id % 5 = 0) * 4 + (id % 7) * 0.01, double(id % 3)) AS embedding")
    split = data.selectExpr("id", "if(id % 4 = 3, 'test', 'train') AS split")
    thirds = data.where("id % 4 <> 3").selectExpr("id", "int(id % 3) AS part")
    out = classify.ensemble_run(data, split, thirds)
    scores_ = {r.model: r for r in out["scores"].collect()}
    assert set(scores_) == {"lr_part0", "dt_part1", "svc_part2", "ensemble"}
    assert all(r.accuracy >= 0.98 and r.n_test == 75 for r in scores_.values())
    voted = out["voted"].collect()
    for r in voted:
        assert r.p_mean == pytest.approx((r.p_lr + r.p_dt + r.p_svc) / 3) and r.pred == int(r.p_mean > 0.5)


def test_kernel_model_separates_rings(spark):
    import random

    from chartwise.operators import classify

    r = random.Random(1)
    data = []
    for i in range(600):
        a, q = r.uniform(0, 2 * math.pi), (1.0 if i % 2 else 2.5) + r.gauss(0, 0.15)
        data.append((i, [q * math.cos(a), q * math.sin(a)], i % 2))
    df = metrics.with_class_weights(classify.with_features(spark.createDataFrame(data, "id int, embedding array<double>, label int")), "label")
    train, test = df.where("id < 450"), df.where("id >= 450")
    accuracy = {}
    for kernel in ("rbf", "linear"):
        model = classify.BalancedModels(train, which=("svc",), kernel=kernel)
        accuracy[kernel] = classify.single_accuracy(model, "svc", test).agg(F.avg("ok")).first()[0]
    assert accuracy["rbf"] >= 0.95 and accuracy["linear"] < 0.7
    x = [v for p in data for v in p[1]]
    mean = sum(x) / len(x)
    assert classify.scale_gamma(df) == pytest.approx(1 / (2 * (sum((v - mean) ** 2 for v in x) / len(x))))
    # the features' inner products are the kernel's values, more nearly the more there are
    points = [p[1] for p in data[:30]]
    errors = {}
    for size in (64, 1024):
        f = classify.FourierFeatures(2, 0.3, size, seed=4)
        z = [row.z for row in spark.createDataFrame([(p,) for p in points], "x array<double>").select(f.of(F.col("x")).alias("z")).collect()]
        errors[size] = sum(abs(sum(a * b for a, b in zip(z[i], z[j], strict=True)) - math.exp(-0.3 * math.dist(points[i], points[j]) ** 2))
                           for i in range(30) for j in range(i)) / 435
    assert errors[1024] < 0.03 < errors[64] < 0.2


def test_certificates_hold_for_fits_and_fail_for_others(spark):
    from pyspark.ml.linalg import Vectors

    from chartwise.operators import classify

    data = spark.range(400).selectExpr("id", "int(id % 4 = 0) AS label", "array(double(id % 4 = 0) + (id % 9) * 0.2, double(id % 5)) AS embedding")
    train = metrics.with_class_weights(classify.with_features(data), "label")
    models = classify.BalancedModels(train)
    got = {(r.model, r.check): r.ok for r in classify.certificates(models, train).collect()}
    assert len(got) == 5 and all(got.values())
    # the same models on rows they were not fitted on
    other = metrics.with_class_weights(classify.with_features(data.withColumn("label", 1 - F.col("label"))), "label")
    wrong = {(r.model, r.check): r.ok for r in classify.certificates(models, other).collect()}
    assert not wrong["lr", "gradient near zero"] and not wrong["dt", "leaves give class shares"] and not wrong["svc", "objective near its minimum"]
    assert models.lr.coefficients != Vectors.dense([0.0, 0.0])


def test_checkpoint_folder_must_be_shared_off_local(spark):
    from chartwise import session

    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(ValueError):
        session.ensure_checkpoint_dir(Session())


def test_intermediates_go_with_their_scope(spark):
    from chartwise import scratch

    kept = scratch.save(spark.range(3))
    with scratch.scope():
        inside = scratch.save(spark.range(5))
        assert inside.count() == 5 and os.path.isdir(inside._saved_at.removeprefix("file:"))
    assert not os.path.exists(inside._saved_at.removeprefix("file:")) and kept.count() == 3
    # what another process left goes by age
    left = os.path.join(os.path.dirname(kept._saved_at.removeprefix("file:")), "chartwise-left")
    os.makedirs(left)
    assert scratch.sweep(spark, 1) == 0 and os.path.isdir(left)
    os.utime(left, (1, 1))
    assert scratch.sweep(spark, 1) == 1 and not os.path.exists(left) and kept.count() == 3
    scratch.drop(kept)


def test_large_inputs_are_not_shuffled_to_be_spread(spark, scratch):
    from chartwise.operators import joins

    path = os.path.join(scratch, "t")
    spark.range(20000).selectExpr("id", "repeat(md5(string(id)), 4) AS text").write.parquet(path)
    df = spark.read.parquet(path)
    assert "Exchange" in joins.spread(df, "id")._jdf.queryExecution().executedPlan().toString()
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        assert "Exchange" not in joins.spread(df, "id")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_broadcast_follows_written_bytes(spark):
    from chartwise.operators.joins import Derived

    wide = spark.range(200).selectExpr("id", "array_join(transform(sequence(1, 300), x -> uuid()), '') AS text")
    assert not Derived(wide, 1 << 20).fits and Derived(spark.range(10), 1 << 20).fits


def test_class_names_match_whole_tokens_in_their_case(spark):
    html = '<p CLASS="temp">a</p><p class="TEMP">b</p><p class="temperature">c</p><p class=temp>d</p><P id="temp">e</P><p class="x temp">f</p><script class="temp">g</script>'
    out = web.class_texts(spark.createDataFrame([(1, html)], "page_id int, html string"), "temp")
    assert rows(out, "pos", "text") == [(0, "a"), (1, "d"), (2, "f")]
