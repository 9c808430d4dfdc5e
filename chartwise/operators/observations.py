"""Irregular multivariate observations: wide, long and array forms.

The wide form is ``id, t, value_0..k-1, mask_0..k-1`` (mask 1 = observed;
the column count is whatever the table holds). Operators:

* ``value_columns`` / ``pack``     columns by prefix → ``values``/``mask`` arrays  (B8, A6)
* ``from_arrays``                  array form → wide, sizes checked              (A6)
* ``to_long`` / ``to_wide``        one row per observed value and back            (I6)
* ``to_float32``                   whole-table cast                               (B9)
* ``default_table``                each id with a constant (covariate/label)     (D7)
* ``validation_ids``               ids seen before and after the cut             (G2)
* ``validation_split``             before/after tables, first n or nearest       (I4, B13, E9, E10, C6)
* ``last_before_cut``              last row per id                               (E8)
* ``reindex``                      dense 0..n-1 ids, by id or by first appearance,
                                 applied to several tables                     (E11, C6)
* ``covariate_check``              one covariate row per id                      (C12)
* ``jitter``                       split rows with several features observed     (I5, G3, B11, B12)
* ``observed_per_row``             observed values, feature numbers, counts      (D8, H22)
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartwise.operators.joins import Derived, join_derived
from chartwise.operators.ranking import first_by, first_n, positions


def value_columns(df: DataFrame, prefix: str) -> list[str]:
    """Columns named ``<prefix><n>`` in numeric order."""
    pat = re.compile(re.escape(prefix) + r"(\d+)$")
    found = [(int(m.group(1)), c) for c in df.columns if (m := pat.match(c))]
    return [c for _, c in sorted(found)]


def pack(df: DataFrame, keys=("id", "t"), value_prefix: str = "value_", mask_prefix: str = "mask_") -> DataFrame:
    """Wide → ``keys, values array<double>, mask array<double>``."""
    vals, masks = value_columns(df, value_prefix), value_columns(df, mask_prefix)
    if len(vals) != len(masks):
        raise ValueError(f"{len(vals)} value columns but {len(masks)} mask columns")
    return df.select(
        *keys,
        F.array(*[F.col(c).cast("double") for c in vals]).alias("values"),
        F.array(*[F.col(c).cast("double") for c in masks]).alias("mask"),
    )


def from_arrays(df: DataFrame, n_features: int, keys=("id", "t")) -> DataFrame:
    """Array form → wide; a row whose arrays differ in size raises (shape assert)."""
    ok = (F.size("values") == F.lit(n_features)) & (F.size("mask") == F.lit(n_features))
    # a filter, not a column: an unused column would be pruned with its check
    checked = df.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit("values/mask shape mismatch"))))
    return checked.select(
        *keys,
        *[F.col("values")[i].alias(f"value_{i}") for i in range(n_features)],
        *[F.col("mask")[i].alias(f"mask_{i}") for i in range(n_features)],
    ).orderBy(*keys)


def to_long(df: DataFrame, keys=("id", "tick", "t")) -> DataFrame:
    """One row per observed value: ``keys, feature, value``."""
    packed = pack(df, keys)
    z = packed.select(*keys, F.posexplode(F.arrays_zip("values", "mask")).alias("feature", "z"))
    return z.where(F.col("z.mask") == 1).select(*keys, F.col("feature").cast("int").alias("feature"),
                                                F.col("z.values").alias("value"))


def to_wide(long: DataFrame, n_features: int, keys=("id", "tick", "t"), fill: float = 0.0) -> DataFrame:
    """Long → wide with masks; unobserved values filled with ``fill``."""
    piv = long.groupBy(*keys).pivot("feature", list(range(n_features))).agg(F.max("value"))
    return piv.select(
        *keys,
        *[F.coalesce(F.col(str(i)), F.lit(fill)).alias(f"value_{i}") for i in range(n_features)],
        *[F.when(F.col(str(i)).isNotNull(), 1).otherwise(0).alias(f"mask_{i}") for i in range(n_features)],
    )


def to_float32(df: DataFrame, keep=("id",)) -> DataFrame:
    """Cast every non-key column to FLOAT (``astype(np.float32)``)."""
    return df.select(*[F.col(c) if c in keep else F.col(c).cast("float").alias(c) for c in df.columns])


def default_table(obs: DataFrame, column: str, value: float = 0.0) -> DataFrame:
    """Each distinct id with a constant column (missing covariates or labels)."""
    return obs.select("id").distinct().withColumn(column, F.lit(value))


def _after(t_val: float, t_val_from: float | None):
    return F.col("t") > F.lit(t_val) if t_val_from is None else F.col("t") >= F.lit(t_val_from)


def validation_ids(obs: DataFrame, t_val: float, t_val_from: float | None = None) -> DataFrame:
    """Ids with an observation at ``t <= t_val`` and one after the cut (one aggregate pass)."""
    flags = obs.groupBy("id").agg(
        F.max((F.col("t") <= F.lit(t_val)).cast("int")).alias("_before"),
        F.max(_after(t_val, t_val_from).cast("int")).alias("_after"),
    )
    return flags.where((F.col("_before") == 1) & (F.col("_after") == 1)).select("id")


def validation_split(obs: DataFrame, t_val: float, max_val_samples: int = 1, t_val_from: float | None = None,
                     t_closest: float | None = None, t_mult: float = 1.0, extra=(),
                     parts=("ids", "before", "after")) -> dict[str, DataFrame]:
    """Validation cohort and its before/after tables.

    Time is scaled once (``t * t_mult``) before both the cohort test and the
    cut. ``before``: ``t <= t_val``. ``after``: ``t > t_val``, or
    ``t >= t_val_from`` when given; then either the row nearest
    ``t_closest`` per id (ties: smaller ``value_0``, then earlier ``t``) or
    the first ``max_val_samples`` rows per id in time order. ``extra``
    tables (covariates, labels) are cut to the same ids. Only ``parts`` and
    the extra tables are made; the ids are written once, and only if
    another table needs them.
    """
    scaled = obs.withColumn("t", F.col("t") * F.lit(t_mult))
    ids = validation_ids(scaled, t_val, t_val_from)
    out = {"ids": ids} if "ids" in parts else {}
    extra = dict(extra)
    if not extra and not {"before", "after"} & set(parts):
        return out
    side = Derived(ids)
    if "ids" in parts:
        out["ids"] = side.df
    if "before" in parts:
        out["before"] = join_derived(scaled.where(F.col("t") <= F.lit(t_val)), side, "id", "left_semi")
    if "after" in parts:
        after = join_derived(scaled.where(_after(t_val, t_val_from)), side, "id", "left_semi")
        if t_closest is not None:
            after = first_n(after, ["id"], [F.abs(F.col("t") - F.lit(t_closest)), "value_0", "t"], 1)
        else:
            after = first_n(after, ["id"], ["t"], max_val_samples)  # (id, t) is unique
        out["after"] = after
    for name, table in extra.items():
        out[name] = join_derived(table, side, "id", "left_semi")
    return out


def last_before_cut(before: DataFrame) -> DataFrame:
    """Last row per id in time order (``keep='last'``), as a combinable max."""
    return first_by(before, ["id"], ["t"], last=True)


def first_places(rows: DataFrame, place=("file_path", "file_row")) -> DataFrame:
    """(id, first): where every id first stands in ``rows``, by the ``place`` columns (combinable)."""
    return rows.groupBy("id").agg(F.min(F.struct(*place)).alias("first"))


def reindex(ids: DataFrame, tables: dict[str, DataFrame], order: str = "id", place=("file_path", "file_row")) -> dict[str, DataFrame]:
    """Keep rows whose id is in ``ids`` and renumber ids 0..n-1.

    ``order`` "id": in id order. "appearance": in the order in which ids
    first stand in ``ids``, which then may hold an id many times and has the
    ``place`` columns (``sources.files.with_file_position`` gives them).
    The mapping is computed with slice-parallel positions (no global
    single-task window), materialised once and joined to every table.
    """
    if order not in ("id", "appearance"):
        raise ValueError(f"order must be 'id' or 'appearance', not {order!r}")
    if order == "id":
        numbered = positions(ids.select("id").distinct(), ["id"], out="new_id")
    else:
        numbered = positions(first_places(ids, place), ["first"], out="new_id").drop("first")
    mapping = Derived(numbered)
    out = {"mapping": mapping.df}
    for name, table in tables.items():
        out[name] = join_derived(table, mapping, "id", "inner")
    return out


def covariate_check(obs: DataFrame, cov: DataFrame) -> DataFrame:
    """One row: distinct ids, covariate rows, ids without covariates,
    covariate ids without observations, duplicated covariate ids."""
    ids = obs.select("id").distinct()
    per_id = cov.groupBy("id").agg(F.count("*").alias("_n"))
    both = ids.withColumn("_obs", F.lit(1)).join(per_id, "id", "full_outer")
    return both.agg(
        F.count("_obs").alias("n_ids"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_cov_rows"),
        F.count(F.when(F.col("_n").isNull(), 1)).alias("ids_without_cov"),
        F.count(F.when(F.col("_obs").isNull(), 1)).alias("cov_without_obs"),
        F.count(F.when(F.col("_n") > 1, 1)).alias("duplicated_cov_ids"),
    )


_DIGITS, _CHUNKS = 4, 8  # hex digits per draw, draws per md5


def _draw(key: F.Column, p: F.Column) -> F.Column:
    """The ``p``-th number below 16^4 that belongs to ``key`` (p from 1): four hex digits of an md5."""
    block, chunk = F.floor((p - 1) / _CHUNKS).cast("int"), (p - 1) % _CHUNKS
    digest = F.md5(F.when(block == 0, key).otherwise(F.concat_ws("-", key, block.cast("string"))))
    return F.conv(F.substr(digest, chunk * _DIGITS + 1, F.lit(_DIGITS)), 16, 10).cast("bigint")


def shuffled(items: F.Column, key: F.Column) -> F.Column:
    """A reproducible permutation of the array ``items``: each item in turn goes to a drawn place among those before it."""
    numbered = F.transform(items, lambda x, i: F.struct(x.alias("x"), i.alias("i")))

    def insert(done: F.Column, e: F.Column) -> F.Column:
        place = F.when(e["i"] == 0, F.lit(0)).otherwise(F.floor(_draw(key, e["i"]) * (e["i"] + 1) / 16 ** _DIGITS))
        return F.array_insert(done, place.cast("int") + 1, e["x"])

    return F.aggregate(numbered, F.array().cast("array<int>"), insert)


def jitter(obs: DataFrame, jitter_time: float = 1e-3, seed: int = 0) -> DataFrame:
    """Rows with several observed features become one row per observed feature, at different times.

    The observed features of a row get a reproducible random order; the
    j-th (from 0) moves ``j * jitter_time`` earlier, and times are clamped at 0. Rows
    with one observed feature or none stay. Takes any number of
    ``value_<n>`` / ``mask_<n>`` columns; other columns are carried along.
    With two features one row moves, as a coin decides.
    """
    values, masks = value_columns(obs, "value_"), value_columns(obs, "mask_")
    numbers = [int(c.removeprefix("mask_")) for c in masks]
    if not masks or [int(c.removeprefix("value_")) for c in values] != numbers or not {"id", "t"} <= set(obs.columns):
        raise ValueError("jitter needs id, t and as many value_<n> as mask_<n> columns with the same numbers")
    key = F.concat_ws("-", F.col("id").cast("string"), F.round(F.col("t") * 1000).cast("bigint").cast("string"), F.lit(str(seed)))
    seen = F.array_compact(F.array(*[F.when(F.col(c) == 1, F.lit(n)) for c, n in zip(masks, numbers, strict=True)]))
    rows = obs.withColumn("_seen", seen)
    # (feature kept, steps moved); one entry that keeps all features where nothing is split
    parts = F.when(F.size("_seen") > 1, F.transform(shuffled(F.col("_seen"), key), lambda f, j: F.struct(f.alias("f"), j.alias("j")))).otherwise(
        F.array(F.struct(F.lit(None).cast("int").alias("f"), F.lit(0).alias("j"))))
    split = rows.withColumn("_part", F.explode(parts))
    whole = F.col("_part.f").isNull()
    moved = F.when(whole, F.col("t")).otherwise(F.greatest(F.col("t") - F.lit(jitter_time) * F.col("_part.j"), F.lit(0.0)))
    keep = {c: F.when(whole | (F.col("_part.f") == n), F.col(c)).otherwise(F.lit(0)).alias(c) for c, n in zip(masks, numbers, strict=True)}
    return split.select(*[moved.alias("t") if c == "t" else keep.get(c, F.col(c)) for c in obs.columns])


def observed_per_row(obs: DataFrame, keys=("id", "tick", "t")) -> DataFrame:
    """Per row: number observed, observed values and their feature numbers."""
    packed = pack(obs, keys)
    n = F.size("values")
    z = F.arrays_zip(F.col("values").alias("v"), F.col("mask").alias("m"),
                     F.sequence(F.lit(0), n - 1).alias("f"))
    seen = F.filter(z, lambda e: e["m"] == 1)
    return packed.select(
        *keys,
        F.aggregate("mask", F.lit(0.0), lambda acc, x: acc + x).alias("num_obs"),
        F.transform(seen, lambda e: e["v"]).alias("obs_values"),
        F.transform(seen, lambda e: e["f"]).alias("obs_features"),
        F.size(seen).alias("length"),
    )


def sample_index(before: DataFrame, after: DataFrame, cov: DataFrame, labels: DataFrame) -> DataFrame:
    """One record per id: label, covariates, and the extent of its path and held-out rows (C9).

    The reference's sample nests an id's whole series in one object. Here
    the series stay in the keyed ``before``/``after`` tables and the record
    carries counts and time bounds (all combinable aggregates), so an id
    with a third of all rows never becomes one giant row.
    """
    cov_cols = [c for c in cov.columns if c != "id"]
    path = before.groupBy("id").agg(F.count("*").alias("n_path"), F.min("t").alias("t_first"),
                                    F.max("t").alias("t_last"))
    held = after.groupBy("id").agg(F.count("*").alias("n_val"), F.min("t").alias("t_val_first"))
    c = cov.select("id", F.array(*[F.col(x).cast("double") for x in cov_cols]).alias("cov"))
    y = labels.select("id", F.col("label").cast("double").alias("y"))
    return (path.join(y, "id", "left").join(c, "id", "left").join(held, "id", "left")
            .withColumn("n_val", F.coalesce("n_val", F.lit(0))))


def sample_rows(before: DataFrame, after: DataFrame) -> DataFrame:
    """The series behind ``sample_index`` as keyed rows: id, part (path / val), seq in time order, t, values, mask (C9).

    Positions come from range slices, so an id with a third of all rows is
    numbered by many tasks and never gathered.
    """
    rows = None
    for part, table in (("path", before), ("val", after)):
        one = pack(table, ("id", "t")).select("id", F.lit(part).alias("part"), "t", "values", "mask")
        rows = one if rows is None else rows.unionByName(one)
    return positions(rows, ["t"], group=["id", "part"], out="seq").select("id", "part", "seq", "t", "values", "mask")


def rows_of(df: DataFrame, id_value) -> DataFrame:
    """All rows of one id (B14); the filter reaches the scan of a stored table."""
    return df.where(F.col("id") == F.lit(id_value))


def align_to(reference: DataFrame, other: DataFrame, key: str = "id", order: str = "pos") -> dict[str, DataFrame]:
    """Reorder ``other`` to follow ``reference``'s ``order`` on ``key`` (C11).

    ``aligned`` carries the reference position; ``check`` counts keys present
    on one side only (both must be 0, the reference's permutation assert).
    """
    ref = reference.select(key, order)
    aligned = ref.join(other, key, "inner")
    both = ref.withColumn("_r", F.lit(1)).join(other.select(key).withColumn("_o", F.lit(1)), key, "full_outer")
    check = both.agg(
        F.count(F.when(F.col("_o").isNull(), 1)).alias("missing_in_other"),
        F.count(F.when(F.col("_r").isNull(), 1)).alias("missing_in_reference"),
    )
    return {"aligned": aligned, "check": check}
