"""Event analytics over exported chart events.

* ``coerce_events``     text → timestamp / number, bad values → NULL     (H12, H13)
* ``label_map``         item → label, last duplicate wins                 (C5)
* ``labelled_events``   hours before each subject's last event, floored,
                        constant label 1, item label                      (E6, B6, C5, B1)
* ``item_series``       plot-ready series per (subject, item): fractional
                        hours before last event, left join to the item
                        dimension (duplicates multiply), min-max scaling
                        (constant series → value − mean), series number
                        and legend text                                   (B4, E7, C4, E13, E14, E15)

Per-subject and per-series statistics are map-side-combined aggregates
joined back to the events (no ``OVER (PARTITION BY subject)``), so a
subject with a third of all events is not funnelled into one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chartwise.functions.time import epoch_seconds, parse_double, parse_timestamp
from chartwise.operators.joins import join_derived


def coerce_events(raw: DataFrame) -> DataFrame:
    """Typed copy of all-string events: ``charttime`` TIMESTAMP, ``valuenum`` DOUBLE."""
    return raw.withColumn("charttime", parse_timestamp(F.col("charttime"))).withColumn(
        "valuenum", parse_double(F.col("valuenum"))
    )


def label_map(items: DataFrame, order: str = "pos") -> DataFrame:
    """One label per item id: the last row in load order wins (dict semantics)."""
    w = Window.partitionBy("itemid").orderBy(F.col(order).desc())
    return items.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select("itemid", "label")


def _last_event_time(events: DataFrame) -> DataFrame:
    return events.groupBy("subject_id").agg(F.max("charttime").alias("_last"))


def labelled_events(raw: DataFrame, items: DataFrame) -> DataFrame:
    """Model-ready events: subject, whole hours before last event, item label, value, label 1."""
    ev = coerce_events(raw)
    ev = join_derived(ev, _last_event_time(ev), "subject_id", "left")
    hours = F.floor((epoch_seconds(F.col("_last")) - epoch_seconds(F.col("charttime"))) / 3600).cast("double")
    # the item dimension may come from a file (A4): measured before any broadcast
    ev = join_derived(ev.withColumn("itemid", F.col("itemid").cast("string")), label_map(items), "itemid", "left")
    return ev.select(
        "subject_id",
        hours.alias("timeline"),
        F.col("label").alias("item_label"),
        "valuenum",
        F.lit(1).alias("label"),
    )


def item_series(raw: DataFrame, items: DataFrame) -> DataFrame:
    """Normalised series per (subject, item) with vertical offset and legend."""
    ev = coerce_events(raw).where(F.col("valuenum").isNotNull() & F.col("charttime").isNotNull())
    ev = join_derived(ev, _last_event_time(ev), "subject_id", "inner")
    ev = ev.withColumn(
        "time_diff_hours", (epoch_seconds(F.col("_last")) - epoch_seconds(F.col("charttime"))) / 3600.0
    ).withColumn("itemid", F.col("itemid").cast("string"))

    keys = ["subject_id", "itemid"]
    # one hash aggregate over the events; the item dimension's duplicates repeat an item's rows alike and change none of it
    stats = ev.groupBy(*keys).agg(
        F.min("valuenum").alias("_min"), F.max("valuenum").alias("_max"), F.avg("valuenum").alias("_mean"))
    # series number: item ids of a subject in text order (one row per series)
    stats = stats.withColumn(
        "series_no", (F.dense_rank().over(Window.partitionBy("subject_id").orderBy("itemid")) - 1).cast("bigint")
    )
    ev = join_derived(ev, stats, keys, "inner")
    # the legend is the item's first label in load order
    first = items.where(F.col("label").isNotNull()).groupBy("itemid").agg(F.min_by("label", "pos").alias("_first"))
    ev = join_derived(ev, items.select("itemid", "pos").join(first, "itemid", "left"), "itemid", "left")
    span = F.col("_max") - F.col("_min")
    norm = F.when(span > 0, (F.col("valuenum") - F.col("_min")) / span).otherwise(F.col("valuenum") - F.col("_mean"))
    legend = F.when(F.col("_first").isNotNull(), F.concat_ws(" - ", "itemid", "_first")).otherwise(F.col("itemid"))
    return ev.select(
        "subject_id", "event_id", "itemid", "pos",
        "time_diff_hours", "valuenum",
        norm.alias("norm_value"),
        "series_no",
        (norm + F.col("series_no").cast("double")).alias("plot_value"),
        legend.alias("legend"),
    )
