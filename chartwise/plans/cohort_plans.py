"""Cohort queries: the flagship look-back (variants A and B), its stays and complement."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartwise.operators import cohort
from chartwise.plans.catalog import query
from chartwise.sources import fixtures as fx

_ITEMS = ", ".join(str(i) for i in cohort.CHART_ITEMS)

_AGE_IDS = "SELECT subject_id FROM fx_patients WHERE TRY_CAST(anchor_age AS INTEGER) BETWEEN 30 AND 35"

# A subject's stays are counted by comparing them with each other; a stay
# follows the one whose count is one less.
_FOLLOWING = f"""
own AS (SELECT s.* FROM fx_icustays AS s JOIN ({_AGE_IDS}) AS p ON s.subject_id = p.subject_id),
nth AS (SELECT a.subject_id, a.hadm_id, a.stay_id, a.intime, a.outtime, count(*) AS n
        FROM own AS a JOIN own AS b ON a.subject_id = b.subject_id
             AND (b.intime < a.intime OR (b.intime = a.intime AND b.stay_id <= a.stay_id))
        GROUP BY ALL),
following AS (SELECT c.subject_id, c.hadm_id, c.stay_id, (epoch(c.intime) - epoch(p.outtime)) / 86400 AS gap_days, c.n AS record_seq
              FROM nth AS c JOIN nth AS p ON p.subject_id = c.subject_id AND p.n = c.n - 1
              WHERE p.outtime IS NOT NULL)"""

# A: the second stay, if the first one's discharge is known. B: every stay that follows a known discharge.
_READMIT_A = "readmitted AS (SELECT * FROM following WHERE record_seq = 2)"
_READMIT_B = "readmitted AS (SELECT * FROM following)"


def _lookback_sql(readmit: str) -> str:
    return f"""
WITH {_FOLLOWING.strip()}, {readmit.strip()},
kept AS (SELECT e.*, floor(epoch(e.charttime)) AS second FROM fx_chartevents AS e
         WHERE e.itemid IN ({_ITEMS}) AND EXISTS (SELECT 1 FROM readmitted AS r WHERE r.subject_id = e.subject_id)),
latest AS (SELECT subject_id, max(second) AS last_second FROM kept GROUP BY subject_id)
SELECT k.subject_id, k.charttime, k.itemid, k.valuenum
FROM kept AS k JOIN latest AS l ON k.subject_id = l.subject_id AND l.last_second - k.second <= 86400
ORDER BY k.subject_id, k.charttime"""


def _stays_sql(readmit: str) -> str:
    return f"""
WITH {_FOLLOWING.strip()}, {readmit.strip()}
SELECT subject_id, hadm_id, stay_id, round(gap_days, 6) AS gap_days, CAST(record_seq AS BIGINT) AS record_seq
FROM readmitted"""


def _rounded(df):
    return df.withColumn("gap_days", F.round("gap_days", 6))


@query("cohort_lookback_a", _lookback_sql(_READMIT_A),
       ids="B1 B2 B3 B4 B5 B15 C1 C2 E1 E2 E3 E4 E5 F1 H14")
def cohort_lookback_a(t):
    """Flagship: last 24 h of the 33 items for age 30-35 subjects with a second stay."""
    return cohort.readmission_lookback(fx.patients(t), fx.icustays(t), fx.chartevents(t), "A")


@query("cohort_lookback_b", _lookback_sql(_READMIT_B), ids="C3 D3 E1 E2 E3 E4 E5")
def cohort_lookback_b(t):
    """Variant B: any stay after a known discharge qualifies the subject."""
    return cohort.readmission_lookback(fx.patients(t), fx.icustays(t), fx.chartevents(t), "B")


@query("readmitted_stays_a", _stays_sql(_READMIT_A), ids="C2 E1 E2 E3 B5 B7")
def readmitted_stays_a(t):
    return _rounded(cohort.readmitted_stays(fx.icustays(t), fx.patients(t), "A"))


@query("readmitted_stays_b", _stays_sql(_READMIT_B), ids="C3 D3 E1 E2 E3")
def readmitted_stays_b(t):
    return _rounded(cohort.readmitted_stays(fx.icustays(t), fx.patients(t), "B"))


@query("not_readmitted", f"""
WITH {_FOLLOWING.strip()}, {_READMIT_A.strip()}
SELECT subject_id FROM ({_AGE_IDS}) AS p
WHERE subject_id NOT IN (SELECT subject_id FROM readmitted)""", ids="C13")
def not_readmitted(t):
    """Age-band patients without a qualifying readmission (the 0-label side)."""
    return cohort.not_readmitted(fx.patients(t), fx.icustays(t), "A")


@query("cohort_sizes", f"""
WITH {_FOLLOWING.strip()}, {_READMIT_A.strip()}
SELECT (SELECT count(DISTINCT subject_id) FROM readmitted) AS readmitted,
       (SELECT count(*) FROM ({_AGE_IDS}) AS p WHERE subject_id NOT IN (SELECT subject_id FROM readmitted))
         AS not_readmitted""", ids="D1 D2 C13")
def cohort_sizes(t):
    """Distinct readmitted and non-readmitted subjects (the two recorded counts)."""
    yes = cohort.readmitted_stays(fx.icustays(t), fx.patients(t), "A").agg(
        F.countDistinct("subject_id").alias("readmitted"))
    no = cohort.not_readmitted(fx.patients(t), fx.icustays(t), "A").agg(F.count("*")).scalar()
    return yes.select("readmitted", no.alias("not_readmitted"))


@query("chart_preview", """
SELECT event_id, subject_id, charttime, itemid, valuenum FROM fx_chartevents ORDER BY event_id LIMIT 10""", ids="A13")
def chart_preview(t):
    """First ten chart events in event order (a preview; the limit is the feature)."""
    from chartwise.sources.files import preview
    return preview(fx.chartevents(t), ["event_id"], 10)
