"""DuckDB text of the fixture views, for the oracle queries.

``with_fixtures(sql)`` prefixes a query with the ``WITH`` definitions of
every ``fx_*`` view it names (dependencies first), so each oracle query
is one self-contained statement over the driver's base views.
"""

from __future__ import annotations

import re

FIXTURE_SQL = {
    "fx_patients": """
SELECT c_custkey AS subject_id, CAST(18 + c_custkey % 60 AS VARCHAR) AS anchor_age FROM customer""",
    "fx_icustays": """
SELECT o_custkey AS subject_id, o_orderkey AS hadm_id, o_orderkey + 30000000 AS stay_id,
       o_orderdate AS intime,
       CASE WHEN o_orderkey % 17 = 0 THEN NULL
            ELSE o_orderdate + CAST(o_orderkey % 10 AS INT) * INTERVAL '1' DAY END AS outtime
FROM orders""",
    "fx_chartevents": """
SELECT event_id, user_id AS subject_id, ts AS charttime,
       CASE event_type WHEN 'click' THEN 220045 WHEN 'view' THEN 220210
            WHEN 'purchase' THEN 220050 WHEN 'signup' THEN 223761 ELSE 999999 END AS itemid,
       value AS valuenum
FROM events
UNION ALL
SELECT event_id + 1000000000000, user_id, ts,
       CASE event_type WHEN 'click' THEN 220045 WHEN 'view' THEN 220210
            WHEN 'purchase' THEN 220050 WHEN 'signup' THEN 223761 ELSE 999999 END, NULL
FROM events WHERE event_id % 13 = 0""",
    "fx_chartevents_raw": """
SELECT event_id, subject_id, CAST(itemid AS VARCHAR) AS itemid, CAST(date_trunc('second', charttime) AS VARCHAR) AS charttime,
       CAST(valuenum AS VARCHAR) AS valuenum
FROM fx_chartevents
UNION ALL SELECT event_id + 2000000000000, subject_id, CAST(itemid AS VARCHAR), 'not a time', CAST(valuenum AS VARCHAR)
FROM fx_chartevents WHERE event_id % 31 = 0
UNION ALL SELECT event_id + 3000000000000, subject_id, CAST(itemid AS VARCHAR), CAST(date_trunc('second', charttime) AS VARCHAR), 'n/a'
FROM fx_chartevents WHERE event_id % 29 = 0""",
    "fx_d_items": """
SELECT pos, itemid, label FROM (VALUES
  (0, '220045', 'Heart Rate'), (1, '220210', 'Respiratory Rate (old)'),
  (2, '223761', 'Temperature Fahrenheit'), (3, '220210', 'Respiratory Rate')) AS t(pos, itemid, label)""",
    "fx_obs": """
SELECT id, tick, CAST(tick AS DOUBLE) / 10 AS t,
       coalesce(max(CASE WHEN k = 0 THEN v END), 0) AS value_0, coalesce(max(CASE WHEN k = 1 THEN v END), 0) AS value_1,
       coalesce(max(CASE WHEN k = 2 THEN v END), 0) AS value_2, coalesce(max(CASE WHEN k = 3 THEN v END), 0) AS value_3,
       coalesce(max(CASE WHEN k = 4 THEN v END), 0) AS value_4,
       max(CASE WHEN k = 0 THEN 1 ELSE 0 END) AS mask_0, max(CASE WHEN k = 1 THEN 1 ELSE 0 END) AS mask_1,
       max(CASE WHEN k = 2 THEN 1 ELSE 0 END) AS mask_2, max(CASE WHEN k = 3 THEN 1 ELSE 0 END) AS mask_3,
       max(CASE WHEN k = 4 THEN 1 ELSE 0 END) AS mask_4
FROM (SELECT user_id AS id, value AS v,
             4 * CAST(floor(((extract(day FROM ts) - 1) * 24 + extract(hour FROM ts)) / 6) AS INT) AS tick,
             CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS k
      FROM events) AS e
GROUP BY id, tick""",
    "fx_obs_two": """
SELECT id, t, value_0 AS value_1, value_1 AS value_2, mask_0 AS mask_1, mask_1 AS mask_2
FROM fx_obs WHERE mask_0 + mask_1 > 0""",
    "fx_cov": """
SELECT c_custkey AS id, c_acctbal AS cov_0, CAST(c_nationkey AS DOUBLE) AS cov_1
FROM customer WHERE c_custkey IN (SELECT id FROM fx_obs)""",
    "fx_labels": """
SELECT c_custkey AS id, CASE WHEN c_nationkey % 4 = 0 THEN 1 ELSE 0 END AS label
FROM customer WHERE c_custkey IN (SELECT id FROM fx_obs)""",
    "fx_pred": """
SELECT g.id, g.tick, 0 AS seq, f.k, 100 + 50 * sin(g.id + f.k + g.tick * CAST(0.05 AS DOUBLE)) AS mean,
       1 + CAST(f.k AS DOUBLE) / 2 AS logvar
FROM (SELECT i.id, CAST(s.tick AS INTEGER) AS tick
      FROM (SELECT DISTINCT id FROM fx_obs) AS i CROSS JOIN range(0, 481) AS s(tick)) AS g
CROSS JOIN (SELECT CAST(k AS INTEGER) AS k FROM range(0, 5) AS r(k)) AS f
WHERE g.tick % 7 <> 0
UNION ALL
SELECT o.id, o.tick, 1 AS seq, f.k, 101 + 50 * sin(o.id + f.k + o.tick * CAST(0.05 AS DOUBLE)) AS mean,
       1 + CAST(f.k AS DOUBLE) / 2 AS logvar
FROM fx_obs AS o CROSS JOIN (SELECT CAST(k AS INTEGER) AS k FROM range(0, 5) AS r(k)) AS f
WHERE o.tick <= 400 AND o.tick % 7 <> 0""",
    "fx_pred_obs": """
SELECT o.id, o.tick, s.seq, f.k, 100 + s.seq + 50 * sin(o.id + f.k + o.tick * CAST(0.05 AS DOUBLE)) AS mean,
       1 + CAST(f.k AS DOUBLE) / 2 AS logvar
FROM fx_obs AS o CROSS JOIN (SELECT CAST(k AS INTEGER) AS k FROM range(0, 5) AS r(k)) AS f
CROSS JOIN (SELECT CAST(seq AS INTEGER) AS seq FROM range(0, 2) AS q(seq)) AS s""",
    "fx_scores": """
SELECT l.doc_id AS id, l.quality AS label, l.toxic AS batch,
       greatest(least(CAST(d.n_chars - 1000 AS DOUBLE) / 500, 3), -1) AS logit
FROM labels AS l JOIN documents AS d ON l.doc_id = d.doc_id""",
    "fx_works": """
SELECT source AS author, doc_id AS work_id, lang,
       CASE WHEN doc_id % 11 = 0 THEN NULL ELSE CAST(2000 + doc_id % 20 AS VARCHAR) END AS year,
       text AS title
FROM documents
UNION ALL SELECT source, doc_id + 1000000000000, lang, '2001', '' FROM documents WHERE doc_id % 37 = 0""",
    "fx_profiles": """
SELECT profile_id, '{"person":{"name":{"given-names":{"value":"' || seg || '"}' || family ||
       '}},"activities-summary":{"employments":{"affiliation-group":[' ||
       CASE k % 3 WHEN 0 THEN '' WHEN 1 THEN '{"summaries":[' || job || ']}'
            ELSE '{"summaries":[' || job || ',' || second || ']},{"summaries":[]},{"summaries":[' || second || ']}' END || ']}' ||
       CASE k % 4 WHEN 0 THEN '' WHEN 1 THEN ',"works":{"group":[]}' WHEN 2 THEN ',"works":{"group":[' || work || ']}'
            ELSE ',"works":{"group":[' || work || ',{"work-summary":[{"title":{"title":{"value":"Undated"}},"publication-date":null}]},' ||
                 '{"work-summary":[{"title":{"title":{"value":""}},"publication-date":null}]}]}' END || '}}' AS body
FROM (SELECT c_custkey AS profile_id, c_custkey AS k, lower(c_mktsegment) AS seg,
       CASE WHEN c_custkey % 9 = 0 THEN ',"family-name":null' WHEN c_custkey % 8 = 3 THEN ''
            ELSE ',"family-name":{"value":"' || c_name || '"}' END AS family,
       '{"employment-summary":{"organization":{"name":"Org ' || CAST(c_nationkey AS VARCHAR) || '"},"start-date":' ||
       CASE WHEN c_custkey % 5 = 0 THEN 'null' ELSE '{"year":{"value":"' || CAST(1990 + c_custkey % 20 AS VARCHAR) || '"}}' END ||
       ',"end-date":' ||
       CASE WHEN c_custkey % 2 = 0 THEN 'null' ELSE '{"year":{"value":"' || CAST(2012 + c_custkey % 8 AS VARCHAR) || '"}}' END || '}}' AS job,
       '{"employment-summary":{"organization":{"name":"Second"},"start-date":null,"end-date":null}}' AS second,
       '{"work-summary":[{"title":{"title":{"value":"Study of ' || lower(c_mktsegment) || '"}},"publication-date":{"year":{"value":"' ||
       CAST(2000 + c_custkey % 25 AS VARCHAR) || '"}}}]}' AS work
      FROM customer) AS c""",
    "fx_forecasts": """
SELECT c_custkey AS page_id,
       CASE c_custkey % 4 WHEN 0 THEN 'mdw' WHEN 1 THEN 'Central Park' WHEN 2 THEN 'Denver, CO' ELSE 'Boston, MA' END AS location,
       '<ul><li class="tombstone-container"><p class="period-name">Today</p><p class="short-desc">Clear</p><p class="temp">High: 99 F</p></li>' ||
       CASE WHEN c_custkey % 3 = 0 THEN '<li class="tombstone-container"><p class="period-name">Notice</p></li>' ELSE '' END ||
       '<div class="forecast tombstone-container"><p class="period-name">Tonight</p><p class="short-desc">Cold</p><p class="temp temp-low">Low: 5 F</p></div>' ||
       CASE WHEN c_custkey % 10 = 0 THEN '' ELSE '<li class="tombstone-container"><p class="period-name">Friday</p><p class="short-desc">Rain<br>Late</p><p class="temp temp-high">High: ' ||
            CAST(c_custkey % 60 - 10 AS VARCHAR) || ' F</p></li>' END || '</ul>' AS html
FROM customer""",
    "fx_metrics": """
SELECT o_orderkey % 5 AS run, CAST(floor(o_orderkey / 5) AS INT) AS step,
       -o_totalprice / 100000 AS val_metric, o_totalprice / 1000 AS loss
FROM orders""",
    "fx_classes": """
SELECT vec_id AS id, embedding, CASE WHEN label = 0 THEN 1 ELSE 0 END AS label FROM embeddings""",
}

_NAME = re.compile(r"\bfx_[a-z_]+\b")


def _deps(name: str) -> list[str]:
    return [n for n in dict.fromkeys(_NAME.findall(FIXTURE_SQL[name])) if n != name and n in FIXTURE_SQL]


def _order(names) -> list[str]:
    seen: list[str] = []

    def visit(n):
        if n in seen:
            return
        for d in _deps(n):
            visit(d)
        seen.append(n)

    for n in names:
        visit(n)
    return seen


def with_fixtures(sql: str) -> str:
    """Prefix ``sql`` with the fixture CTEs it references."""
    used = [n for n in dict.fromkeys(_NAME.findall(sql)) if n in FIXTURE_SQL]
    if not used:
        return sql
    ctes = ",\n".join(f"{n} AS ({FIXTURE_SQL[n].strip()})" for n in _order(used))
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
