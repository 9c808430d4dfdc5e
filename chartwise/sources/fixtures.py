"""Clinical-shaped views over the driver tables (see FIXTURES.md).

Each function maps driver tables to the schema an operator expects
(stays, chart events, observations, predictions, ...). They are plain
projections, filters and aggregates, so Catalyst folds them into the
operator plans that use them. The DuckDB text of the same views lives in
``fixture_sql`` for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartwise.operators.joins import slice_count, spread
from chartwise.sources.tables import Tables


def _case(col, mapping: dict, default):
    expr = None
    for key, value in mapping.items():
        expr = F.when(col == key, F.lit(value)) if expr is None else expr.when(col == key, F.lit(value))
    return expr.otherwise(F.lit(default))


# Event type → chart item id, and event type → feature number.
EVENT_ITEM = {"click": 220045, "view": 220210, "purchase": 220050, "signup": 223761}
EVENT_ITEM_DEFAULT = 999999
EVENT_FEATURE = {"click": 0, "view": 1, "purchase": 2, "signup": 3}
EVENT_FEATURE_DEFAULT = 4
N_FEATURES = 5
# How many bytes of predictions stand for a byte of events, about.
EXPANDED = 128


def patients(t: Tables) -> DataFrame:
    c = t["customer"]
    return c.select(
        F.col("c_custkey").alias("subject_id"),
        (F.lit(18) + F.col("c_custkey") % 60).cast("string").alias("anchor_age"),
    )


def icustays(t: Tables) -> DataFrame:
    o = t["orders"]
    days = (F.col("o_orderkey") % 10).cast("int")
    return o.select(
        F.col("o_custkey").alias("subject_id"),
        F.col("o_orderkey").alias("hadm_id"),
        (F.col("o_orderkey") + 30000000).alias("stay_id"),
        F.col("o_orderdate").alias("intime"),
        F.when(F.col("o_orderkey") % 17 == 0, F.lit(None))
        .otherwise(F.col("o_orderdate") + F.make_dt_interval(days=days))
        .alias("outtime"),
    )


# Added bad rows get ids of their own, far above the real ones.
NULL_VALUE_ID, BAD_TIME_ID, BAD_VALUE_ID = 1_000_000_000_000, 2_000_000_000_000, 3_000_000_000_000


def chartevents(t: Tables) -> DataFrame:
    """Every event as a chart event, and added rows without a value."""
    e = t["events"]
    kinds = F.when(F.col("event_id") % 13 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return e.select("event_id", "user_id", "ts", "event_type", "value", F.explode(kinds).alias("_bad")).select(
        (F.col("event_id") + F.col("_bad") * F.lit(NULL_VALUE_ID)).alias("event_id"),
        F.col("user_id").alias("subject_id"),
        F.col("ts").alias("charttime"),
        _case(F.col("event_type"), EVENT_ITEM, EVENT_ITEM_DEFAULT).alias("itemid"),
        F.when(F.col("_bad") == 0, F.col("value")).alias("valuenum"),
    )


def chartevents_raw(t: Tables) -> DataFrame:
    """All-string chart events as the reference's CSV export holds them, and added rows that do not parse."""
    c = chartevents(t).withColumn("_kinds", F.concat(
        F.array(F.lit(0)),
        F.when(F.col("event_id") % 31 == 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")),
        F.when(F.col("event_id") % 29 == 0, F.array(F.lit(2))).otherwise(F.array().cast("array<int>"))))
    return c.select("*", F.explode("_kinds").alias("_bad")).select(
        (F.col("event_id") + F.when(F.col("_bad") == 1, F.lit(BAD_TIME_ID)).when(F.col("_bad") == 2, F.lit(BAD_VALUE_ID)).otherwise(0))
        .alias("event_id"),
        "subject_id",
        F.col("itemid").cast("string").alias("itemid"),
        F.when(F.col("_bad") == 1, F.lit("not a time"))
        .otherwise(F.date_trunc("second", F.col("charttime")).cast("timestamp_ntz").cast("string"))
        .alias("charttime"),
        F.when(F.col("_bad") == 2, F.lit("n/a")).otherwise(F.col("valuenum").cast("string")).alias("valuenum"),
    )


def d_items(t: Tables) -> DataFrame:
    """Item dimension with one duplicated key and one missing key."""
    # Fixed values: (load position, item id, label).
    rows = [
        (0, "220045", "Heart Rate"),
        (1, "220210", "Respiratory Rate (old)"),
        (2, "223761", "Temperature Fahrenheit"),
        (3, "220210", "Respiratory Rate"),
    ]
    return t.spark.createDataFrame(rows, "pos int, itemid string, label string")


def obs(t: Tables) -> DataFrame:
    """Wide observation table: id, tick, t, value_0..4, mask_0..4."""
    e = t["events"]
    hour_of_month = (F.dayofmonth("ts") - 1) * 24 + F.hour("ts")
    tick = (F.lit(4) * F.floor(hour_of_month / 6).cast("int")).alias("tick")
    k = _case(F.col("event_type"), EVENT_FEATURE, EVENT_FEATURE_DEFAULT).alias("k")
    long = e.select(F.col("user_id").alias("id"), F.col("value").alias("v"), tick, k)
    aggs = []
    for i in range(N_FEATURES):
        aggs.append(F.coalesce(F.max(F.when(F.col("k") == i, F.col("v"))), F.lit(0.0)).alias(f"value_{i}"))
    for i in range(N_FEATURES):
        aggs.append(F.max(F.when(F.col("k") == i, 1).otherwise(0)).alias(f"mask_{i}"))
    wide = long.groupBy("id", "tick").agg(*aggs)
    return wide.select("id", "tick", (F.col("tick").cast("double") / 10).alias("t"), *[a for a in wide.columns if a not in ("id", "tick")])


def obs_two(t: Tables) -> DataFrame:
    """Six-column observation table the jitter step accepts."""
    o = obs(t)
    return o.where(F.col("mask_0") + F.col("mask_1") > 0).select(
        "id", "t",
        F.col("value_0").alias("value_1"), F.col("value_1").alias("value_2"),
        F.col("mask_0").alias("mask_1"), F.col("mask_1").alias("mask_2"),
    )


def _obs_ids(t: Tables) -> DataFrame:
    return obs(t).select("id").distinct()


def cov(t: Tables) -> DataFrame:
    c = t["customer"]
    return c.join(_obs_ids(t), c["c_custkey"] == F.col("id"), "left_semi").select(
        F.col("c_custkey").alias("id"),
        F.col("c_acctbal").alias("cov_0"),
        F.col("c_nationkey").cast("double").alias("cov_1"),
    )


def labels(t: Tables) -> DataFrame:
    c = t["customer"]
    return c.join(_obs_ids(t), c["c_custkey"] == F.col("id"), "left_semi").select(
        F.col("c_custkey").alias("id"),
        F.when(F.col("c_nationkey") % 4 == 0, 1).otherwise(0).alias("label"),
    )


def pred(t: Tables) -> DataFrame:
    """Long predictions: grid rows (seq 0) and after-update rows (seq 1).

    One row per id holds its observed ticks and is dealt by id before it
    is expanded by per-row generators, not joins, into its grid and its
    after-update rows; so the rows grow linearly with the ids, and what
    groups them by id and more needs no shuffle of the expanded rows.
    """
    kept = (F.col("tick") <= 400) & (F.col("tick") % 7 != 0)
    o = obs(t).select("id", "tick")
    ids = o.repartition(slice_count(o, EXPANDED), "id").groupBy("id").agg(F.collect_list(F.when(kept, F.col("tick"))).alias("_seen"))
    grid = F.filter(F.sequence(F.lit(0), F.lit(480)), lambda i: i % 7 != 0)
    rows = F.concat(
        F.transform(grid, lambda i: F.struct(i.alias("tick"), F.lit(0).alias("seq"))),
        F.transform("_seen", lambda i: F.struct(i.alias("tick"), F.lit(1).alias("seq"))))
    ticks = ids.select("id", F.inline(rows))
    phase = F.col("id") + F.col("k") + F.col("tick") * F.lit(0.05)
    return ticks.select("id", "tick", "seq", F.explode(F.sequence(F.lit(0), F.lit(N_FEATURES - 1))).alias("k")).select(
        "id", "tick", "seq", "k",
        (F.lit(100) + F.col("seq") + F.lit(50) * F.sin(phase)).alias("mean"),
        (F.lit(1.0) + F.col("k").cast("double") / 2).alias("logvar"),
    )


def pred_obs(t: Tables) -> DataFrame:
    """Predictions at every observation, before (seq 0) and after (seq 1) its update, as training has them."""
    rows = obs(t).select("id", "tick", F.explode(F.sequence(F.lit(0), F.lit(N_FEATURES - 1))).alias("k"))
    phase = F.col("id") + F.col("k") + F.col("tick") * F.lit(0.05)
    return rows.select("id", "tick", F.explode(F.array(F.lit(0), F.lit(1))).alias("seq"), "k").select(
        "id", "tick", "seq", "k",
        (F.lit(100) + F.col("seq") + F.lit(50) * F.sin(phase)).alias("mean"),
        (F.lit(1.0) + F.col("k").cast("double") / 2).alias("logvar"))


def scores(t: Tables) -> DataFrame:
    lab, doc = t["labels"], t["documents"]
    logit = F.greatest(F.least((doc["n_chars"] - 1000).cast("double") / 500, F.lit(3.0)), F.lit(-1.0))
    return lab.join(doc, lab["doc_id"] == doc["doc_id"]).select(
        lab["doc_id"].alias("id"), lab["quality"].alias("label"), lab["toxic"].alias("batch"), logit.alias("logit"),
    )


def works(t: Tables) -> DataFrame:
    """Publications: whole document text as the title; unknown years, empty titles."""
    d = t["documents"]
    return d.select(
        F.col("source").alias("author"),
        F.col("doc_id").alias("work_id"),
        "lang",
        F.when(F.col("doc_id") % 11 == 0, F.lit(None).cast("string"))
        .otherwise((F.lit(2000) + F.col("doc_id") % 20).cast("string")).alias("year"),
        F.col("text").alias("title"),
    ).unionByName(_untitled(t))


def _untitled(t: Tables) -> DataFrame:
    """Added works without a title."""
    d = t["documents"]
    return d.where(F.col("doc_id") % 37 == 0).select(
        F.col("source").alias("author"), (F.col("doc_id") + 1_000_000_000_000).alias("work_id"), "lang",
        F.lit("2001").alias("year"), F.lit("").alias("title"))


def profiles(t: Tables) -> DataFrame:
    c = t["customer"]
    key = F.col("c_custkey")
    year_obj = lambda y: F.concat(F.lit('{"year":{"value":"'), y.cast("string"), F.lit('"}}'))
    family = F.when(key % 9 == 0, F.lit(',"family-name":null')).when(key % 8 == 3, F.lit("")).otherwise(
        F.concat(F.lit(',"family-name":{"value":"'), F.col("c_name"), F.lit('"}')))
    start = F.when(key % 5 == 0, F.lit("null")).otherwise(year_obj(F.lit(1990) + key % 20))
    end = F.when(key % 2 == 0, F.lit("null")).otherwise(year_obj(F.lit(2012) + key % 8))
    job = F.concat(F.lit('{"employment-summary":{"organization":{"name":"Org '), F.col("c_nationkey").cast("string"),
                   F.lit('"},"start-date":'), start, F.lit(',"end-date":'), end, F.lit("}}"))
    second = F.lit('{"employment-summary":{"organization":{"name":"Second"},"start-date":null,"end-date":null}}')
    groups = F.when(key % 3 == 0, F.lit("")).when(key % 3 == 1, F.concat(F.lit('{"summaries":['), job, F.lit("]}"))).otherwise(
        F.concat(F.lit('{"summaries":['), job, F.lit(","), second, F.lit(']},{"summaries":[]},{"summaries":['), second, F.lit("]}")))
    work = F.concat(F.lit('{"work-summary":[{"title":{"title":{"value":"Study of '), F.lower("c_mktsegment"),
                    F.lit('"}},"publication-date":'), year_obj(F.lit(2000) + key % 25), F.lit("}]}"))
    works_part = F.when(key % 4 == 0, F.lit("")).when(key % 4 == 1, F.lit(',"works":{"group":[]}')).when(
        key % 4 == 2, F.concat(F.lit(',"works":{"group":['), work, F.lit("]}"))).otherwise(F.concat(
            F.lit(',"works":{"group":['), work, F.lit(',{"work-summary":[{"title":{"title":{"value":"Undated"}},"publication-date":null}]},'
                                                      '{"work-summary":[{"title":{"title":{"value":""}},"publication-date":null}]}]}')))
    body = F.concat(
        F.lit('{"person":{"name":{"given-names":{"value":"'), F.lower("c_mktsegment"), F.lit('"}'), family,
        F.lit('}},"activities-summary":{"employments":{"affiliation-group":['), groups, F.lit("]}"), works_part, F.lit("}}"))
    return c.select(key.alias("profile_id"), body.alias("body"))


def forecasts(t: Tables) -> DataFrame:
    """Forecast pages; their keys are dealt to every core, since parsing a page costs much more than reading its row."""
    c = spread(t["customer"].select("c_custkey"), "c_custkey")
    key = F.col("c_custkey")
    location = (
        F.when(key % 4 == 0, "mdw").when(key % 4 == 1, "Central Park").when(key % 4 == 2, "Denver, CO").otherwise("Boston, MA")
    )
    block = '<li class="tombstone-container"><p class="period-name">{}</p>{}</li>'
    # any tag, several class tokens
    wide = '<div class="forecast tombstone-container"><p class="period-name">{}</p>{}</div>'
    today = block.format("Today", '<p class="short-desc">Clear</p><p class="temp">High: 99 F</p>')
    notice = block.format("Notice", "")
    tonight = wide.format("Tonight", '<p class="short-desc">Cold</p><p class="temp temp-low">Low: 5 F</p>')
    friday_head = '<li class="tombstone-container"><p class="period-name">Friday</p><p class="short-desc">Rain<br>Late</p><p class="temp temp-high">High: '
    html = F.concat(
        F.lit("<ul>" + today),
        F.when(key % 3 == 0, F.lit(notice)).otherwise(F.lit("")),
        F.lit(tonight),
        F.when(key % 10 == 0, F.lit("")).otherwise(
            F.concat(F.lit(friday_head), (key % 60 - 10).cast("string"), F.lit(" F</p></li>"))
        ),
        F.lit("</ul>"),
    )
    return c.select(key.alias("page_id"), location.alias("location"), html.alias("html"))


def metrics(t: Tables) -> DataFrame:
    o = t["orders"]
    return o.select(
        (F.col("o_orderkey") % 5).alias("run"),
        F.floor(F.col("o_orderkey") / 5).cast("int").alias("step"),
        (-F.col("o_totalprice") / 100000).alias("val_metric"),
        (F.col("o_totalprice") / 1000).alias("loss"),
    )


def classes(t: Tables) -> DataFrame:
    e = t["embeddings"]
    return e.select(
        F.col("vec_id").alias("id"), "embedding",
        F.when(F.col("label") == 0, 1).otherwise(0).alias("label"),
    )


ALL = {
    "fx_patients": patients, "fx_icustays": icustays, "fx_chartevents": chartevents,
    "fx_chartevents_raw": chartevents_raw, "fx_d_items": d_items, "fx_obs": obs, "fx_obs_two": obs_two,
    "fx_cov": cov, "fx_labels": labels, "fx_pred": pred, "fx_pred_obs": pred_obs, "fx_scores": scores, "fx_works": works,
    "fx_profiles": profiles, "fx_forecasts": forecasts, "fx_metrics": metrics, "fx_classes": classes,
}

