"""Observation-model queries: forms, defaults, validation cut, re-index, jitter."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartwise.operators import observations as ob
from chartwise.plans.catalog import query
from chartwise.plans.timeline_plans import round_doubles
from chartwise.sources import fixtures as fx
from chartwise.sources.files import with_file_position

N = fx.N_FEATURES
# Validation options used throughout (the reference's run uses a cut at 40
# and 3 samples per id); the "from" and "closest" variants add 42 and 44.
T_VAL, MAX_VAL_SAMPLES, T_VAL_FROM, T_CLOSEST = 40.0, 3, 42.0, 44.0
JITTER_TIME, JITTER_SEED = 0.001, 7

_VALS = ", ".join(f"round(value_{i}, 6) AS value_{i}" for i in range(N))
_MASKS = ", ".join(f"mask_{i}" for i in range(N))
_WIDE = f"id, tick, round(t, 6) AS t, {_VALS}, {_MASKS}"

_LONG_SQL = " UNION ALL ".join(
    f"SELECT id, tick, t, {i} AS feature, value_{i} AS value FROM fx_obs WHERE mask_{i} = 1" for i in range(N)
)

_VAL_IDS = f"""val_ids AS (SELECT id FROM fx_obs GROUP BY id
   HAVING max(CASE WHEN t <= {T_VAL} THEN 1 ELSE 0 END) = 1 AND max(CASE WHEN t > {T_VAL} THEN 1 ELSE 0 END) = 1)"""


@query("obs_long", f"SELECT id, tick, round(t, 6) AS t, feature, round(value, 6) AS value FROM ({_LONG_SQL}) AS l",
       ids="I6 B8 A6")
def obs_long(t):
    return round_doubles(ob.to_long(fx.obs(t)))


@query("obs_long_to_wide", f"SELECT {_WIDE} FROM fx_obs", ids="I6")
def obs_long_to_wide(t):
    return round_doubles(ob.to_wide(ob.to_long(fx.obs(t)), N))


@query("obs_from_arrays", "SELECT id, round(t, 6) AS t, " + ", ".join(f"round(value_{i}, 6) AS value_{i}" for i in range(N))
       + ", " + ", ".join(f"CAST(mask_{i} AS DOUBLE) AS mask_{i}" for i in range(N)) + " FROM fx_obs ORDER BY id, t",
       ids="A6 B8")
def obs_from_arrays(t):
    return round_doubles(ob.from_arrays(ob.pack(fx.obs(t)), N))


@query("obs_float32", "SELECT id, tick, CAST(t AS FLOAT) AS t, "
       + ", ".join(f"CAST(value_{i} AS FLOAT) AS value_{i}" for i in range(N)) + ", "
       + ", ".join(f"CAST(mask_{i} AS FLOAT) AS mask_{i}" for i in range(N)) + " FROM fx_obs", ids="B9")
def obs_float32(t):
    return ob.to_float32(fx.obs(t), keep=("id", "tick"))


@query("default_covariates", "SELECT DISTINCT id, CAST(0.0 AS DOUBLE) AS cov FROM fx_obs", ids="D7")
def default_covariates(t):
    return ob.default_table(fx.obs(t), "cov")


def _split(t, *parts, **kw):
    """The named parts of the validation split only; covariates and labels count as parts."""
    tables = {"cov": fx.cov, "labels": fx.labels}
    kw.setdefault("max_val_samples", MAX_VAL_SAMPLES)
    return ob.validation_split(fx.obs(t), T_VAL, extra={p: tables[p](t) for p in parts if p in tables}, parts=parts, **kw)


@query("validation_ids", f"WITH {_VAL_IDS} SELECT id FROM val_ids", ids="G2 I4 B7")
def validation_ids(t):
    return _split(t, "ids")["ids"]


@query("validation_before", f"""WITH {_VAL_IDS}
SELECT {_WIDE} FROM fx_obs WHERE id IN (SELECT id FROM val_ids) AND t <= {T_VAL}""", ids="B13 C6 I4")
def validation_before(t):
    return round_doubles(_split(t, "before")["before"])


@query("validation_after_first", f"""WITH {_VAL_IDS}
SELECT {_WIDE} FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY t) AS rn
  FROM fx_obs WHERE id IN (SELECT id FROM val_ids) AND t > {T_VAL}) AS a WHERE rn <= {MAX_VAL_SAMPLES}""",
       ids="B13 E10 I4")
def validation_after_first(t):
    return round_doubles(_split(t, "after")["after"])


@query("validation_after_from", f"""WITH val_ids AS (SELECT id FROM fx_obs GROUP BY id
   HAVING max(CASE WHEN t <= {T_VAL} THEN 1 ELSE 0 END) = 1 AND max(CASE WHEN t >= {T_VAL_FROM} THEN 1 ELSE 0 END) = 1)
SELECT {_WIDE} FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY t) AS rn
  FROM fx_obs WHERE id IN (SELECT id FROM val_ids) AND t >= {T_VAL_FROM}) AS a WHERE rn <= {MAX_VAL_SAMPLES}""",
       ids="B13 E10 I4")
def validation_after_from(t):
    return round_doubles(_split(t, "after", t_val_from=T_VAL_FROM)["after"])


@query("validation_after_nearest", f"""WITH {_VAL_IDS}
SELECT {_WIDE} FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY abs(t - {T_CLOSEST}), value_0, t) AS rn
  FROM fx_obs WHERE id IN (SELECT id FROM val_ids) AND t > {T_VAL}) AS a WHERE rn = 1""", ids="E9 I4")
def validation_after_nearest(t):
    return round_doubles(_split(t, "after", t_closest=T_CLOSEST)["after"])


@query("validation_covariates", f"""WITH {_VAL_IDS}
SELECT id, round(cov_0, 6) AS cov_0, round(cov_1, 6) AS cov_1 FROM fx_cov WHERE id IN (SELECT id FROM val_ids)""",
       ids="C6")
def validation_covariates(t):
    return round_doubles(_split(t, "cov")["cov"])


@query("validation_labels", f"""WITH {_VAL_IDS}
SELECT id, label FROM fx_labels WHERE id IN (SELECT id FROM val_ids)""", ids="C6")
def validation_labels(t):
    return _split(t, "labels")["labels"]


@query("last_before_cut", f"""WITH {_VAL_IDS}
SELECT {_WIDE} FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY t DESC) AS rn
  FROM fx_obs WHERE id IN (SELECT id FROM val_ids) AND t <= {T_VAL}) AS b WHERE rn = 1""", ids="E8")
def last_before_cut(t):
    return round_doubles(ob.last_before_cut(_split(t, "before")["before"]))


@query("reindex_map", f"""WITH {_VAL_IDS}
SELECT id, dense_rank() OVER (ORDER BY id) - 1 AS new_id FROM val_ids""", ids="E11")
def reindex_map(t):
    return ob.reindex(_split(t, "ids")["ids"], {})["mapping"].select("id", "new_id")


@query("reindexed_covariates", f"""WITH {_VAL_IDS}, m AS (SELECT id, dense_rank() OVER (ORDER BY id) - 1 AS new_id FROM val_ids)
SELECT m.new_id, c.id, round(c.cov_0, 6) AS cov_0, round(c.cov_1, 6) AS cov_1 FROM fx_cov AS c JOIN m ON c.id = m.id""",
       ids="E11 C6")
def reindexed_covariates(t):
    s = _split(t, "ids", "cov")
    out = ob.reindex(s["ids"], {"cov": s["cov"]})["cov"]
    return round_doubles(out.select("new_id", "id", "cov_0", "cov_1"))


@query("reindex_by_appearance", """
WITH rows AS (SELECT user_id, row_number() OVER () AS place FROM events)
SELECT user_id AS id, row_number() OVER (ORDER BY min(place)) - 1 AS new_id FROM rows GROUP BY user_id""", ids="E11")
def reindex_by_appearance(t):
    """Subjects of the stored event table, numbered in the order in which they first stand in it."""
    rows = with_file_position(t.spark, t.path("events")).withColumnRenamed("user_id", "id").select("id", "file_path", "file_row")
    return ob.reindex(rows, {}, order="appearance")["mapping"].select("id", "new_id")


_MAP = f"{_VAL_IDS}, m AS (SELECT id, dense_rank() OVER (ORDER BY id) - 1 AS new_id FROM val_ids)"


@query("reindexed_observations", f"""WITH {_MAP}
SELECT m.new_id, {_WIDE.replace('id,', 'o.id,', 1)} FROM fx_obs AS o JOIN m ON o.id = m.id""", ids="E11 C6")
def reindexed_observations(t):
    obs = fx.obs(t)
    out = ob.reindex(_split(t, "ids")["ids"], {"obs": obs})["obs"]
    return round_doubles(out.select("new_id", *obs.columns))


@query("reindexed_labels", f"""WITH {_MAP}
SELECT m.new_id, l.id, l.label FROM fx_labels AS l JOIN m ON l.id = m.id""", ids="E11 C6")
def reindexed_labels(t):
    return ob.reindex(_split(t, "ids")["ids"], {"labels": fx.labels(t)})["labels"].select("new_id", "id", "label")


@query("validation_scaled", """
WITH s AS (SELECT id, tick, t * 0.5 AS t, value_0 FROM fx_obs),
v AS (SELECT id FROM s GROUP BY id HAVING max(CASE WHEN t <= 20.0 THEN 1 ELSE 0 END) = 1 AND max(CASE WHEN t > 20.0 THEN 1 ELSE 0 END) = 1)
SELECT id, tick, round(t, 6) AS t, round(value_0, 6) AS value_0 FROM s WHERE id IN (SELECT id FROM v) AND t <= 20.0""", ids="B7 I4")
def validation_scaled(t):
    """The cut on scaled time (times halved, cut at 20)."""
    before = ob.validation_split(fx.obs(t), 20.0, t_mult=0.5, parts=("before",))["before"]
    return round_doubles(before.select("id", "tick", "t", "value_0"))


_VALUES = "[" + ", ".join(f"round(value_{i}, 6)" for i in range(N)) + "]"
_MASK_LIST = "[" + ", ".join(f"CAST(mask_{i} AS DOUBLE)" for i in range(N)) + "]"


@query("sample_rows", f"""WITH {_VAL_IDS},
p AS (SELECT id, 'path' AS part, t, {_VALUES} AS "values", {_MASK_LIST} AS mask FROM fx_obs
      WHERE id IN (SELECT id FROM val_ids) AND t <= {T_VAL}),
h AS (SELECT id, 'val' AS part, t, {_VALUES} AS "values", {_MASK_LIST} AS mask FROM (
        SELECT *, row_number() OVER (PARTITION BY id ORDER BY t) AS rn FROM fx_obs
        WHERE id IN (SELECT id FROM val_ids) AND t > {T_VAL}) AS x WHERE rn <= {MAX_VAL_SAMPLES})
SELECT id, part, row_number() OVER (PARTITION BY id, part ORDER BY t) - 1 AS seq, round(t, 6) AS t, "values", mask
FROM (SELECT * FROM p UNION ALL SELECT * FROM h) AS u""", ids="C9")
def sample_rows(t):
    s = _split(t, "before", "after")
    out = round_doubles(ob.sample_rows(s["before"], s["after"]))
    return out.withColumn("values", F.transform("values", lambda v: F.round(v, 6)))


@query("covariate_check", """
WITH ids AS (SELECT DISTINCT id FROM fx_obs), c AS (SELECT id, count(*) AS n FROM fx_cov GROUP BY id),
b AS (SELECT ids.id AS oid, c.id AS cid, c.n FROM ids FULL OUTER JOIN c ON ids.id = c.id)
SELECT count(oid) AS n_ids, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_cov_rows,
       count(CASE WHEN n IS NULL THEN 1 END) AS ids_without_cov,
       count(CASE WHEN oid IS NULL THEN 1 END) AS cov_without_obs,
       count(CASE WHEN n > 1 THEN 1 END) AS duplicated_cov_ids FROM b""", ids="C12 D2")
def covariate_check(t):
    return ob.covariate_check(fx.obs(t), fx.cov(t))


@query("jitter", f"""
WITH k AS (SELECT *, CASE WHEN substr(md5(CAST(id AS VARCHAR) || '-' || CAST(CAST(round(t * 1000) AS BIGINT) AS VARCHAR)
                   || '-' || '{JITTER_SEED}'), 1, 1) < '8' THEN 1 ELSE 0 END AS coin FROM fx_obs_two),
j AS (SELECT id, t, value_1, value_2, mask_1, mask_2 FROM k WHERE NOT (mask_1 = 1 AND mask_2 = 1)
  UNION ALL SELECT id, greatest(t - {JITTER_TIME} * coin, 0.0), value_1, value_2, mask_1, 0 FROM k
            WHERE mask_1 = 1 AND mask_2 = 1
  UNION ALL SELECT id, greatest(t - {JITTER_TIME} * (1 - coin), 0.0), value_1, value_2, 0, mask_2 FROM k
            WHERE mask_1 = 1 AND mask_2 = 1)
SELECT id, round(t, 6) AS t, round(value_1, 6) AS value_1, round(value_2, 6) AS value_2, mask_1, mask_2 FROM j""",
       ids="I5 G3 B11 B12 G1")
def jitter(t):
    return round_doubles(ob.jitter(fx.obs_two(t), JITTER_TIME, JITTER_SEED))


_SEEN = "list_filter([" + ", ".join(f"CASE WHEN mask_{i} = 1 THEN {i} END" for i in range(N)) + "], lambda f: f IS NOT NULL)"
_JVALS = ", ".join(f"round(value_{i}, 6) AS value_{i}" for i in range(N))


@query("jitter_all", f"""
WITH k AS (SELECT *, md5(CAST(id AS VARCHAR) || '-' || CAST(CAST(round(t * 1000) AS BIGINT) AS VARCHAR) || '-' || '{JITTER_SEED}') AS h,
                  {_SEEN} AS seen FROM fx_obs),
places AS (SELECT *, list_prepend(CAST(0 AS BIGINT), list_transform(range(1, len(seen)), lambda p:
             CAST(floor(CAST('0x' || substr(h, CAST((p - 1) * 4 + 1 AS INTEGER), 4) AS BIGINT) * (p + 1) / 65536) AS BIGINT))) AS pl
           FROM k WHERE len(seen) > 1),
parts AS (SELECT *, unnest(range(len(seen))) AS i FROM places),
ranks AS (SELECT *, seen[i + 1] AS f, list_reduce(pl[i + 1:], lambda r, q: CASE WHEN q <= r THEN r + 1 ELSE r END) AS j FROM parts)
SELECT id, tick, round(greatest(t - {JITTER_TIME} * j, 0.0), 6) AS t, {_JVALS},
       {", ".join(f"CASE WHEN f = {i} THEN 1 ELSE 0 END AS mask_{i}" for i in range(N))} FROM ranks
UNION ALL SELECT id, tick, round(t, 6) AS t, {_JVALS}, {_MASKS} FROM k WHERE len(seen) <= 1""", ids="I5 G3 B11")
def jitter_all(t):
    """Jitter of all features of the observation table."""
    return round_doubles(ob.jitter(fx.obs(t), JITTER_TIME, JITTER_SEED))


@query("observed_per_row", f"""
SELECT id, tick, round(t, 6) AS t, CAST(count(*) AS DOUBLE) AS num_obs,
       list(round(value, 6) ORDER BY feature) AS obs_values, list(feature ORDER BY feature) AS obs_features,
       CAST(count(*) AS INTEGER) AS length
FROM ({_LONG_SQL}) AS l GROUP BY id, tick, t""", ids="D8 H22")
def observed_per_row(t):
    df = ob.observed_per_row(fx.obs(t))
    return round_doubles(df).withColumn("obs_values", F.transform("obs_values", lambda v: F.round(v, 6)))


@query("sample_index", f"""WITH {_VAL_IDS},
b AS (SELECT id, count(*) AS n_path, min(t) AS t_first, max(t) AS t_last FROM fx_obs
      WHERE id IN (SELECT id FROM val_ids) AND t <= {T_VAL} GROUP BY id),
a AS (SELECT id, count(*) AS n_val, min(t) AS t_val_first FROM (
        SELECT *, row_number() OVER (PARTITION BY id ORDER BY t) AS rn FROM fx_obs
        WHERE id IN (SELECT id FROM val_ids) AND t > {T_VAL}) AS x WHERE rn <= {MAX_VAL_SAMPLES} GROUP BY id)
SELECT b.id, b.n_path, round(b.t_first, 6) AS t_first, round(b.t_last, 6) AS t_last,
       CAST(l.label AS DOUBLE) AS y, [round(c.cov_0, 6), round(c.cov_1, 6)] AS cov,
       coalesce(a.n_val, 0) AS n_val, round(a.t_val_first, 6) AS t_val_first
FROM b LEFT JOIN fx_labels AS l ON b.id = l.id LEFT JOIN fx_cov AS c ON b.id = c.id LEFT JOIN a ON b.id = a.id""",
       ids="C9 C6")
def sample_index(t):
    s = _split(t, "before", "after", "cov", "labels")
    out = ob.sample_index(s["before"], s["after"], s["cov"], s["labels"])
    out = round_doubles(out).withColumn("cov", F.transform("cov", lambda v: F.round(v, 6)))
    return out.select("id", "n_path", "t_first", "t_last", "y", "cov", "n_val", "t_val_first")


_ALIGN = f"""{_VAL_IDS},
v AS (SELECT id, row_number() OVER (ORDER BY id, t) - 1 AS pos FROM (
        SELECT *, row_number() OVER (PARTITION BY id ORDER BY t) AS rn FROM fx_obs
        WHERE id IN (SELECT id FROM val_ids) AND t >= {T_VAL_FROM}) AS x WHERE rn = 1),
l AS (SELECT id, t, value_0 FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY t DESC) AS rn FROM fx_obs
        WHERE id IN (SELECT id FROM val_ids) AND t <= {T_VAL}) AS y WHERE rn = 1)"""


def _aligned(t):
    s = ob.validation_split(fx.obs(t), T_VAL, max_val_samples=1, t_val_from=T_VAL_FROM)
    from chartwise.operators.ranking import positions
    val = positions(s["after"].select("id", "t"), ["id", "t"], out="pos")
    last = ob.last_before_cut(s["before"]).select("id", "t", "value_0")
    return ob.align_to(val, last)


@query("last_aligned_to_val", f"""WITH {_ALIGN.strip()}
SELECT v.pos, l.id, round(l.t, 6) AS t, round(l.value_0, 6) AS value_0 FROM v JOIN l ON v.id = l.id""",
       ids="C11 E8 C10")
def last_aligned_to_val(t):
    return round_doubles(_aligned(t)["aligned"].select("pos", "id", "t", "value_0"))


@query("alignment_check", f"""WITH {_ALIGN.strip()}
SELECT count(CASE WHEN l.id IS NULL THEN 1 END) AS missing_in_other,
       count(CASE WHEN v.id IS NULL THEN 1 END) AS missing_in_reference FROM v FULL OUTER JOIN l ON v.id = l.id""",
       ids="C11")
def alignment_check(t):
    return _aligned(t)["check"]
