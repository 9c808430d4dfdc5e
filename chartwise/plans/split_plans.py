"""Split and batch queries: folds, stratified split, thirds, batches, batch tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartwise.operators import batches as bt
from chartwise.operators import splits as sp
from chartwise.operators import observations as ob
from chartwise.plans.catalog import query
from chartwise.plans.observation_plans import MAX_VAL_SAMPLES, T_VAL
from chartwise.plans.timeline_plans import round_doubles
from chartwise.sources import fixtures as fx

# Fixed values of the reference's fold generator and training loader.
N_FOLDS, TEST_SIZE, VAL_SIZE, FOLD_SEED = 5, 0.1, 0.2, 432
BATCH_SIZE, BATCH_SEED = 500, 0
# Imbalanced-class demo: 25 % stratified test share, seed 42.
STRAT_TEST, STRAT_SEED = 0.25, 42

_FOLDS = f"""
ids AS (SELECT DISTINCT id FROM fx_obs),
nn AS (SELECT count(*) AS n FROM ids),
cuts AS (SELECT CAST(ceil(CAST({TEST_SIZE} AS DOUBLE) * n) AS BIGINT) AS n_test,
                CAST(ceil(CAST({VAL_SIZE} AS DOUBLE) * (n - CAST(ceil(CAST({TEST_SIZE} AS DOUBLE) * n) AS BIGINT))) AS BIGINT)
                  AS n_val FROM nn),
ranked AS (SELECT CAST(g.fold AS INTEGER) AS fold, ids.id,
                  row_number() OVER (PARTITION BY g.fold ORDER BY md5(CAST(ids.id AS VARCHAR) || '-' ||
                      CAST({FOLD_SEED} + g.fold AS VARCHAR)), ids.id) - 1 AS r
           FROM ids CROSS JOIN range(0, {N_FOLDS}) AS g(fold)),
folds AS (SELECT fold, CASE WHEN r < n_test THEN 'test' WHEN r < n_test + n_val THEN 'val' ELSE 'train' END AS split, id
          FROM ranked CROSS JOIN cuts)"""

_BATCHES = f"""
assign AS (SELECT fold, split, id, CAST(floor(p / {BATCH_SIZE}) AS BIGINT) AS batch,
                  CAST(p % {BATCH_SIZE} AS BIGINT) AS pos_in_batch
           FROM (SELECT *, row_number() OVER (PARTITION BY fold, split
                     ORDER BY md5(CAST(id AS VARCHAR) || '-' || '{BATCH_SEED}'), id) - 1 AS p FROM folds) AS x)"""

_G = "fold, split, batch"
_TR = "tr AS (SELECT id, fold, split, batch, pos_in_batch AS obs_idx FROM assign)"


def _folds(t):
    return sp.folds(fx.obs(t), N_FOLDS, TEST_SIZE, VAL_SIZE, FOLD_SEED)


def _assign(t):
    return sp.batches(_folds(t), BATCH_SIZE, BATCH_SEED)


@query("folds", f"WITH {_FOLDS.strip()} SELECT fold, split, id FROM folds", ids="I1")
def folds(t):
    return _folds(t)


@query("fold_sizes", f"WITH {_FOLDS.strip()} SELECT fold, split, count(*) AS n FROM folds GROUP BY fold, split",
       ids="I1 D2")
def fold_sizes(t):
    return _folds(t).groupBy("fold", "split").agg(F.count("*").alias("n"))


@query("batches", f"WITH {_FOLDS.strip()}, {_BATCHES.strip()} SELECT * FROM assign", ids="F7 C10")
def batches(t):
    return _assign(t)


@query("batch_time_index", f"""WITH {_FOLDS.strip()}, {_BATCHES.strip()}, {_TR},
tm AS (SELECT {_G}, o.tick, o.t, count(*) AS n FROM fx_obs AS o JOIN tr ON o.id = tr.id GROUP BY {_G}, o.tick, o.t)
SELECT {_G}, tick, round(t, 6) AS t, n,
       CAST(coalesce(sum(n) OVER (PARTITION BY {_G} ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
            AS BIGINT) AS ptr_start,
       CAST(sum(n) OVER (PARTITION BY {_G} ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT)
            AS ptr_end
FROM tm""", ids="I7 D4 E12")
def batch_time_index(t):
    out = bt.time_batch(fx.obs(t), _assign(t))["times"]
    return round_doubles(out.select("fold", "split", "batch", "tick", "t", "n", "ptr_start", "ptr_end"))


_VALUES = ", ".join(f"round(value_{i}, 6) AS value_{i}" for i in range(fx.N_FEATURES))
_MASKS = ", ".join(f"mask_{i}" for i in range(fx.N_FEATURES))
_OBS_COLUMNS = [f"value_{i}" for i in range(fx.N_FEATURES)] + [f"mask_{i}" for i in range(fx.N_FEATURES)]


@query("batch_rows", f"""WITH {_FOLDS.strip()}, {_BATCHES.strip()}, {_TR}
SELECT {_G}, row_number() OVER (PARTITION BY {_G} ORDER BY o.tick, o.id) - 1 AS row_idx,
       o.id, tr.obs_idx, o.tick, round(o.t, 6) AS t, {_VALUES}, {_MASKS},
       round(c.cov_0, 6) AS cov_0, round(c.cov_1, 6) AS cov_1, l.label
FROM fx_obs AS o JOIN tr ON o.id = tr.id LEFT JOIN fx_cov AS c ON o.id = c.id LEFT JOIN fx_labels AS l ON o.id = l.id""",
       ids="I7 F2 C10")
def batch_rows(t):
    out = bt.time_batch(fx.obs(t), _assign(t), fx.cov(t), fx.labels(t))["rows"]
    return round_doubles(out.select("fold", "split", "batch", "row_idx", "id", "obs_idx", "tick", "t", *_OBS_COLUMNS,
                                    "cov_0", "cov_1", "label"))


_CUT = f"""val_ids AS (SELECT id FROM fx_obs GROUP BY id
   HAVING max(CASE WHEN t <= {T_VAL} THEN 1 ELSE 0 END) = 1 AND max(CASE WHEN t > {T_VAL} THEN 1 ELSE 0 END) = 1)"""


@query("batch_val_rows", f"""WITH {_FOLDS.strip()}, {_BATCHES.strip()}, {_TR}, {_CUT},
h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY t) AS rn FROM fx_obs
      WHERE id IN (SELECT id FROM val_ids) AND t > {T_VAL}) AS x WHERE rn <= {MAX_VAL_SAMPLES})
SELECT {_G}, row_number() OVER (PARTITION BY {_G} ORDER BY h.id, h.t) - 1 AS val_idx, h.id, tr.obs_idx, h.tick,
       round(h.t, 6) AS t, {_VALUES}, {_MASKS}
FROM h JOIN tr ON h.id = tr.id""", ids="I7 I8 F2")
def batch_val_rows(t):
    after = ob.validation_split(fx.obs(t), T_VAL, MAX_VAL_SAMPLES, parts=("after",))["after"]
    out = bt.held_out_rows(after, bt.assigned(_assign(t)))
    return round_doubles(out.select("fold", "split", "batch", "val_idx", "id", "obs_idx", "tick", "t", *_OBS_COLUMNS))


@query("batch_last_rows", f"""WITH {_FOLDS.strip()}, {_BATCHES.strip()}, {_TR}, {_CUT},
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY t DESC) AS rn FROM fx_obs
      WHERE id IN (SELECT id FROM val_ids) AND t <= {T_VAL}) AS x WHERE rn = 1)
SELECT {_G}, row_number() OVER (PARTITION BY {_G} ORDER BY b.id) - 1 AS last_idx, b.id, tr.obs_idx, b.tick,
       round(b.t, 6) AS t, {_VALUES}, {_MASKS}
FROM b JOIN tr ON b.id = tr.id""", ids="I7 I8 E8")
def batch_last_rows(t):
    before = ob.validation_split(fx.obs(t), T_VAL, parts=("before",))["before"]
    out = bt.last_rows(before, bt.assigned(_assign(t)))
    return round_doubles(out.select("fold", "split", "batch", "last_idx", "id", "obs_idx", "tick", "t", *_OBS_COLUMNS))


_LONG = " UNION ALL ".join(
    f"SELECT id, tick, t, {i} AS feature, value_{i} AS value FROM fx_obs WHERE mask_{i} = 1" for i in range(fx.N_FEATURES)
)


@query("seq_batch", f"""WITH {_FOLDS.strip()}, {_BATCHES.strip()}, {_TR},
per_row AS (SELECT id, tick, t, CAST(count(*) AS DOUBLE) AS num_obs, list(value ORDER BY feature) AS vals,
                   list(feature ORDER BY feature) AS feats, CAST(count(*) AS INTEGER) AS length
            FROM ({_LONG}) AS l GROUP BY id, tick, t),
b AS (SELECT {_G}, tr.obs_idx, p.*, max(p.length) OVER (PARTITION BY {_G}) AS maxlen
      FROM per_row AS p JOIN tr ON p.id = tr.id)
SELECT {_G}, row_number() OVER (PARTITION BY {_G} ORDER BY tick, num_obs DESC, id) - 1 AS row_idx,
       id, obs_idx, tick, round(t, 6) AS t, num_obs, length,
       list_transform(list_concat(vals, list_transform(range(maxlen - length), lambda x: 0.0)), lambda v: round(v, 6)) AS x_padded,
       list_concat(feats, list_transform(range(maxlen - length), lambda x: 0)) AS f_padded
FROM b""", ids="I8 F3 H22 H23")
def seq_batch(t):
    out = round_doubles(bt.seq_batch(fx.obs(t), _assign(t)))
    return out.withColumn("x_padded", F.transform("x_padded", lambda v: F.round(v, 6)))


@query("seq_batch_check", f"""WITH {_FOLDS.strip()}, {_BATCHES.strip()}, {_TR},
r AS (SELECT {_G}, count(*) AS n_rows FROM (SELECT DISTINCT id, tick FROM ({_LONG}) AS l) AS o JOIN tr ON o.id = tr.id GROUP BY {_G}),
p AS (SELECT {_G}, CAST(sum(n) AS BIGINT) AS last_ptr FROM (
        SELECT {_G}, tick, count(*) AS n FROM fx_obs AS o JOIN tr ON o.id = tr.id GROUP BY {_G}, tick) AS x GROUP BY {_G})
SELECT r.fold, r.split, r.batch, n_rows, last_ptr, n_rows = last_ptr AS ok
FROM r JOIN p ON r.fold = p.fold AND r.split = p.split AND r.batch = p.batch""", ids="I8 I11")
def seq_batch_check(t):
    obs, side = fx.obs(t), bt.assigned(_assign(t))
    rows = bt.batch_rows(ob.observed_per_row(obs), side)
    return bt.seq_batch_check(rows, bt.time_batch(obs, side)["times"])


_STRAT = f"""
strat AS (SELECT id, label, CASE WHEN r < floor(CAST({STRAT_TEST} AS DOUBLE) * n + 0.5) THEN 'test' ELSE 'train' END AS split
  FROM (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(id AS VARCHAR) || '-' || '{STRAT_SEED}'), id) - 1 AS r,
               count(*) OVER (PARTITION BY label) AS n FROM fx_classes) AS x)"""


@query("stratified_split", f"WITH {_STRAT.strip()} SELECT id, label, split FROM strat", ids="I2")
def stratified_split(t):
    return sp.stratified(fx.classes(t).select("id", "label"), "label", STRAT_TEST, STRAT_SEED)


@query("train_thirds", f"""WITH {_STRAT.strip()},
tr AS (SELECT id, label, row_number() OVER (ORDER BY md5(CAST(id AS VARCHAR) || '-' || '{STRAT_SEED}'), id) - 1 AS p,
              count(*) OVER () AS n FROM strat WHERE split = 'train')
SELECT id, label, CAST(least(floor(p / greatest(floor(n / 3), 1)), 2) AS INTEGER) AS part FROM tr""", ids="I3")
def train_thirds(t):
    train = sp.stratified(fx.classes(t).select("id", "label"), "label", STRAT_TEST, STRAT_SEED).where("split = 'train'")
    keyed = train.withColumn("_h", sp.hash_key("id", STRAT_SEED))
    return sp.thirds(keyed, ["_h", "id"], hash_ordered=True).select("id", "label", "part")
