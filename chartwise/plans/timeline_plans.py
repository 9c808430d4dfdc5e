"""Event-analytics queries: labelled events and plot-ready normalised series."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartwise.operators import timeline
from chartwise.plans.catalog import query
from chartwise.sources import fixtures as fx


def round_sig(c, digits: int = 10):
    """Round to ``digits`` significant digits (large sums whose last digits
    depend on summation order); ``round_sig_sql`` is the oracle twin."""
    x = F.col(c) if isinstance(c, str) else c
    p = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(x))) - F.lit(digits - 1))
    return F.when(x == 0, F.lit(0.0)).otherwise(F.round(x / p, 0) * p)


def round_sig_sql(x: str, digits: int = 10) -> str:
    x = f"({x})"
    p = f"pow(10.0, floor(log10(abs({x}))) - {digits - 1})"
    return f"(CASE WHEN {x} = 0 THEN 0.0 ELSE round({x} / {p}, 0) * {p} END)"


def round_doubles(df, places: int = 6):
    """Round every DOUBLE column (oracle comparison on 6 decimals)."""
    return df.select(*[
        F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes
    ])


_COERCED = """
ev AS (SELECT event_id, subject_id, itemid, TRY_CAST(charttime AS TIMESTAMP) AS charttime,
              CASE WHEN isnan(TRY_CAST(valuenum AS DOUBLE)) THEN NULL ELSE TRY_CAST(valuenum AS DOUBLE) END AS valuenum
       FROM fx_chartevents_raw)"""


@query("labelled_events", f"""
WITH {_COERCED.strip()},
items AS (SELECT itemid, label FROM (
  SELECT *, row_number() OVER (PARTITION BY itemid ORDER BY pos DESC) AS rn FROM fx_d_items) AS d WHERE rn = 1)
SELECT e.subject_id,
       floor((epoch(max(e.charttime) OVER (PARTITION BY e.subject_id)) - epoch(e.charttime)) / 3600) AS timeline,
       i.label AS item_label, round(e.valuenum, 6) AS valuenum, 1 AS label
FROM ev AS e LEFT JOIN items AS i ON e.itemid = i.itemid""",
       ids="H12 H13 E6 B6 C5 B1")
def labelled_events(t):
    return round_doubles(timeline.labelled_events(fx.chartevents_raw(t), fx.d_items(t)))


@query("item_series", f"""
WITH {_COERCED.strip()},
kept AS (SELECT *, (epoch(max(charttime) OVER (PARTITION BY subject_id)) - epoch(charttime)) / 3600.0 AS time_diff_hours
         FROM ev WHERE valuenum IS NOT NULL AND charttime IS NOT NULL),
merged AS (SELECT k.*, d.pos, d.label FROM kept AS k LEFT JOIN fx_d_items AS d ON k.itemid = d.itemid),
fl AS (SELECT subject_id, itemid, label AS first_label FROM (
   SELECT subject_id, itemid, label,
          row_number() OVER (PARTITION BY subject_id, itemid ORDER BY time_diff_hours, event_id, pos) AS rn
   FROM merged WHERE label IS NOT NULL) AS f WHERE rn = 1),
stats AS (SELECT m.*, fl.first_label,
   min(valuenum) OVER s AS vmin, max(valuenum) OVER s AS vmax, avg(valuenum) OVER s AS vmean,
   dense_rank() OVER (PARTITION BY m.subject_id ORDER BY m.itemid) - 1 AS series_no
  FROM merged AS m LEFT JOIN fl ON m.subject_id = fl.subject_id AND m.itemid = fl.itemid
  WINDOW s AS (PARTITION BY m.subject_id, m.itemid))
SELECT subject_id, event_id, itemid, pos, round(time_diff_hours, 6) AS time_diff_hours, round(valuenum, 6) AS valuenum,
       round(CASE WHEN vmax - vmin > 0 THEN (valuenum - vmin) / (vmax - vmin) ELSE valuenum - vmean END, 6) AS norm_value,
       CAST(series_no AS BIGINT) AS series_no,
       round(CASE WHEN vmax - vmin > 0 THEN (valuenum - vmin) / (vmax - vmin) ELSE valuenum - vmean END + series_no, 6)
         AS plot_value,
       CASE WHEN first_label IS NOT NULL THEN itemid || ' - ' || first_label ELSE itemid END AS legend
FROM stats""", ids="B4 E7 C4 E13 E14 E15")
def item_series(t):
    return round_doubles(timeline.item_series(fx.chartevents_raw(t), fx.d_items(t)))
