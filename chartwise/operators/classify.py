"""Imbalanced-class ensemble on Spark MLlib.

The reference fits three class-balanced models on contiguous thirds of a
stratified training split, scores each alone, then refits a soft-voting
ensemble of the three on the whole training split and reports accuracy,
confusion matrix and per-class precision/recall/F1.

* logistic regression, ≤ 1000 iterations (J1): sklearn's C = 1 objective
  is Σ wᵢ·lossᵢ + ½‖β‖², which is MLlib's (1/Σw)·Σ wᵢ·lossᵢ + (λ/2)‖β‖²
  with λ = 1/Σw and no feature standardisation.
* decision tree, depth 6 (J2).
* support-vector classifier with probabilities (J3): MLlib has linear SVMs
  only, so the RBF kernel exp(-γ|x - y|²) is approximated by random Fourier
  features (``FourierFeatures``; γ = 1 / (features · variance of all values)) and a
  linear SVM is fitted on them (``kernel="linear"`` fits it on the features themselves). Its
  margin is mapped to a probability by a one-feature logistic fit (Platt scaling).
* soft vote (J4): mean of the three class-1 probabilities; class 1 when
  the mean exceeds 0.5 (arg-max, ties to class 0).

Balanced weights n / (k · n_c) come from ``metrics.with_class_weights`` (D25).

``certificates`` checks fitted models without fitting again, each in one scan of
the training rows: conditions that hold at the optimum (or, for the tree, at
every greedy choice) and fail elsewhere.
"""

from __future__ import annotations

import json
import math
import random

from pyspark.ml.classification import DecisionTreeClassifier, LinearSVC, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chartwise.functions.stats import sigmoid
from chartwise.operators.joins import materialise
from chartwise.operators.metrics import with_class_weights


def with_features(df: DataFrame, array_col: str = "embedding") -> DataFrame:
    return df.withColumn("features", array_to_vector(F.col(array_col).cast("array<double>")))


def _p1(col: str = "probability"):
    return vector_to_array(F.col(col))[1]


def scale_gamma(df: DataFrame, col: str = "features") -> float:
    """1 / (number of features · variance of all values), from one aggregate."""
    x = vector_to_array(F.col(col))
    total = lambda f: F.sum(F.aggregate(F.transform(x, f), F.lit(0.0), lambda s, v: s + v))
    r = df.agg(F.sum(F.size(x)).alias("n"), total(lambda v: v).alias("s"), total(lambda v: v * v).alias("q"), F.max(F.size(x)).alias("d")).first()
    variance = r.q / r.n - (r.s / r.n) ** 2
    return 1.0 / (r.d * variance) if variance > 0 else 1.0 / r.d


class FourierFeatures:
    """Random features whose inner product approximates exp(-gamma·|x - y|²).

    z_i(x) = sqrt(2/size)·cos(w_i·x + b_i), w_i normal with variance 2·gamma, b_i uniform on a
    circle, all from ``seed``. The error of one kernel value falls as 1/sqrt(size).
    """

    def __init__(self, dims: int, gamma: float, size: int = 256, seed: int = 0):
        draw = random.Random(seed)
        self.rows = [{"w": [draw.gauss(0.0, math.sqrt(2 * gamma)) for _ in range(dims)], "b": draw.uniform(0.0, 2 * math.pi)}
                     for _ in range(size)]

    def of(self, x):
        """The features of an array column, as an array column."""
        table = F.from_json(F.lit(json.dumps(self.rows)), "array<struct<w:array<double>,b:double>>")
        scale = math.sqrt(2.0 / len(self.rows))
        return F.transform(table, lambda r: F.lit(scale) * F.cos(F.aggregate(
            F.zip_with(r["w"], x, lambda a, b: a * b), r["b"], lambda s, v: s + v)))


class BalancedModels:
    """Fit the requested balanced models on ``train`` (features, label, weight).

    The training table is materialised first: the fits are iterative (one
    Spark job per iteration) and must not recompute its lineage each time.
    ``kernel`` "rbf" fits the support-vector model on ``kernel_size`` Fourier
    features, "linear" on the features themselves.
    """

    def __init__(self, train: DataFrame, which=("lr", "dt", "svc"), max_iter: int = 1000,
                 svc_iter: int = 100, depth: int = 6, seed: int = 42, kernel: str = "rbf", kernel_size: int = 256):
        if kernel not in ("rbf", "linear"):
            raise ValueError(f"kernel must be 'rbf' or 'linear', not {kernel!r}")
        train = materialise(train)
        self.depth = depth
        self.map = None
        self.total_weight = total_weight = train.agg(F.sum("weight")).first()[0]  # one scalar: the regularisation scale
        if "svc" in which and kernel == "rbf":
            first = train.select(F.size(vector_to_array(F.col("features"))).alias("d")).first()
            self.map = FourierFeatures(first.d if first else 0, scale_gamma(train), kernel_size, seed)
        if "lr" in which:
            self.lr = LogisticRegression(
                maxIter=max_iter, regParam=1.0 / total_weight, elasticNetParam=0.0, standardization=False,
                weightCol="weight", labelCol="label", featuresCol="features",
            ).fit(train)
        if "dt" in which:
            self.dt = DecisionTreeClassifier(maxDepth=depth, weightCol="weight", labelCol="label",
                                             featuresCol="features", seed=seed).fit(train)
        if "svc" in which:
            mapped = materialise(self._mapped(train)) if self.map else self._mapped(train)
            self.svc = LinearSVC(maxIter=svc_iter, regParam=1.0 / total_weight, weightCol="weight", standardization=False,
                                 labelCol="label", featuresCol="svc_features").fit(mapped)
            margins = self._margin(self.svc.transform(mapped))
            self.platt = LogisticRegression(maxIter=100, weightCol="weight", labelCol="label",
                                            featuresCol="margin_vec").fit(margins)

    def _mapped(self, df: DataFrame) -> DataFrame:
        x = F.col("features")
        return df.withColumn("svc_features", array_to_vector(self.map.of(vector_to_array(x))) if self.map else x)

    @staticmethod
    def _margin(scored: DataFrame) -> DataFrame:
        m = scored.withColumn("margin", vector_to_array(F.col("rawPrediction"))[1])
        return VectorAssembler(inputCols=["margin"], outputCol="margin_vec").transform(
            m.drop("rawPrediction", "prediction"))

    def proba(self, df: DataFrame, which: str) -> DataFrame:
        """``df`` plus ``p_<which>`` (class-1 probability)."""
        if which == "lr":
            s = self.lr.transform(df)
        elif which == "dt":
            s = self.dt.transform(df)
        else:
            s = self.platt.transform(self._margin(self.svc.transform(self._mapped(df))))
        keep = [c for c in df.columns]
        return s.select(*keep, _p1().alias(f"p_{which}"))


MODELS = ("lr", "dt", "svc")


def vote(probabilities: DataFrame, models=MODELS) -> DataFrame:
    """Soft vote on a table of class-1 probabilities ``p_<model>``: their mean, and class 1 above one half."""
    mean = sum((F.col(f"p_{m}") for m in models[1:]), F.col(f"p_{models[0]}")) / len(models)
    return probabilities.withColumn("p_mean", mean).withColumn("pred", (F.col("p_mean") > 0.5).cast("int"))


def soft_vote(models: BalancedModels, df: DataFrame) -> DataFrame:
    """Class-1 probabilities of the three models, their mean and the voted class."""
    p = df.select("id", "label", "features")
    for name in MODELS:
        p = models.proba(p, name)
    return vote(p)


def single_accuracy(models: BalancedModels, which: str, test: DataFrame) -> DataFrame:
    """Per test row: 1.0 when the model's class-1 probability picks the label."""
    s = models.proba(test.select("id", "label", "features"), which)
    return s.select(((F.col(f"p_{which}") > 0.5).cast("int") == F.col("label")).cast("double").alias("ok"))


_OPTIMAL = 0.01  # largest gradient at the fit, as a share of that at zero
_TREE_SLACK = 0.05
_BINS = 32


def _lr_gradient(models: BalancedModels, train: DataFrame) -> DataFrame:
    """The weighted, regularised gradient at the fitted coefficients against that at zero."""
    beta = [float(v) for v in models.lr.coefficients]
    lam = 1.0 / models.total_weight
    x = vector_to_array(F.col("features"))
    dot = F.aggregate(F.zip_with(x, F.lit(beta), lambda a, b: a * b), F.lit(float(models.lr.intercept)), lambda s, v: s + v)
    parts = train.select(F.col("weight").alias("w"), F.col("label").cast("double").alias("y"), sigmoid(dot).alias("p"),
                         F.posexplode(F.concat(x, F.array(F.lit(1.0)))).alias("j", "v"))  # the last entry is the intercept
    per = parts.groupBy("j").agg(F.sum(F.col("w") * (F.col("p") - F.col("y")) * F.col("v")).alias("g"),
                                 F.sum(F.col("w") * (0.5 - F.col("y")) * F.col("v")).alias("g0"))
    pull = F.coalesce(F.get(F.lit([lam * b for b in beta]), F.col("j")), F.lit(0.0))
    norm = lambda c: F.sqrt(F.sum(c * c))
    n = models.total_weight
    return per.agg((norm(F.col("g") / n + pull) <= _OPTIMAL * norm(F.col("g0") / n)).alias("ok"))


def _dt_leaves(models: BalancedModels, train: DataFrame) -> DataFrame:
    """Every leaf gives the weighted class share of the training rows that reach it."""
    scored = models.dt.copy().setLeafCol("_leaf").transform(train)
    leaves = scored.groupBy("_leaf").agg(
        (F.sum(F.col("weight") * F.col("label")) / F.sum("weight")).alias("share"),
        F.min(_p1()).alias("lo"), F.max(_p1()).alias("hi"))
    return leaves.agg((F.max(F.greatest(F.abs(F.col("share") - F.col("lo")), F.abs(F.col("share") - F.col("hi")))) < 1e-9).alias("ok"))


def _gini(w, p):
    share = F.try_divide(p, w)
    return 1 - share * share - (1 - share) * (1 - share)


def _dt_root(models: BalancedModels, train: DataFrame) -> DataFrame:
    """No split at a quantile of any feature lowers the weighted Gini of all rows noticeably more than the root's."""
    dims = models.dt.numFeatures
    x = vector_to_array(F.col("features"))
    at = [i / _BINS for i in range(1, _BINS)]
    bounds = train.agg(F.array(*[F.percentile_approx(x[j], at) for j in range(dims)]).alias("b")).first().b
    cuts = F.from_json(F.lit(json.dumps(bounds)), "array<array<double>>")
    binned = train.select("weight", "label", F.posexplode(x).alias("j", "v")).withColumn(
        "bin", F.size(F.filter(F.get(cuts, F.col("j")), lambda c: c < F.col("v"))))
    counts = binned.groupBy("j", "bin").agg(F.sum("weight").alias("w"), F.sum(F.col("weight") * F.col("label")).alias("p"))
    so_far = Window.partitionBy("j").orderBy("bin")  # at most _BINS rows a feature
    every = Window.partitionBy("j")
    c = counts.select("j", F.sum("w").over(so_far).alias("wl"), F.sum("p").over(so_far).alias("pl"),
                      F.sum("w").over(every).alias("w"), F.sum("p").over(every).alias("p"))
    wr, pr = F.col("w") - F.col("wl"), F.col("p") - F.col("pl")
    gain = _gini(F.col("w"), F.col("p")) - F.try_divide(F.col("wl"), F.col("w")) * _gini(F.col("wl"), F.col("pl")) - F.coalesce(
        F.try_divide(wr, F.col("w")) * _gini(wr, pr), F.lit(0.0))
    root = models.dt._call_java("rootNode")
    own = root.gain() if models.dt.depth else 0.0
    return c.agg((F.max(gain) <= own * (1 + _TREE_SLACK) + 1e-6).alias("ok"))


def _svc_objective(models: BalancedModels, train: DataFrame) -> DataFrame:
    """The regularised hinge loss at the fit is below that at zero and not above that of shorter or longer coefficients."""
    norm2 = float(models.svc.coefficients.dot(models.svc.coefficients))
    m = models.svc.transform(models._mapped(train)).select(
        "weight", (vector_to_array(F.col("rawPrediction"))[1] * (2 * F.col("label") - 1)).alias("m"))
    n = models.total_weight
    loss = lambda s: F.sum(F.col("weight") * F.greatest(F.lit(0.0), 1 - F.col("m") * s)) / n + norm2 * s * s / (2 * n)
    sums = m.agg(loss(1.0).alias("at"), loss(0.9).alias("short"), loss(1.1).alias("long"))
    return sums.select(((F.col("at") < 1.0) & (F.col("at") <= F.least("short", "long") + 1e-3)).alias("ok"))


def certificates(models: BalancedModels, train: DataFrame) -> DataFrame:
    """(model, check, ok) for the models that ``models`` holds, on the rows they were fitted on."""
    rows = []
    if hasattr(models, "lr"):
        rows.append(("lr", "gradient near zero", _lr_gradient(models, train)))
    if hasattr(models, "dt"):
        rows += [("dt", "leaves give class shares", _dt_leaves(models, train)), ("dt", "root split is best", _dt_root(models, train)),
                 ("dt", "depth within limit", train.limit(1).select(F.lit(models.dt.depth <= models.depth).alias("ok")))]
    if hasattr(models, "svc"):
        rows.append(("svc", "objective near its minimum", _svc_objective(models, train)))
    out = None
    for model, check, ok in rows:
        one = ok.select(F.lit(model).alias("model"), F.lit(check).alias("check"), F.coalesce("ok", F.lit(False)).alias("ok"))
        out = one if out is None else out.unionByName(one)
    return out


def ensemble_run(classes: DataFrame, split: DataFrame, thirds: DataFrame) -> dict[str, DataFrame]:
    """Reference workflow: thirds fitted alone, ensemble refit on full train.

    ``split`` holds (id, split); ``thirds`` holds (id, part) of the train rows.
    """
    data = with_features(classes).join(split.select("id", "split"), "id")
    train = with_class_weights(data.where("split = 'train'"), "label")
    test = data.where("split = 'test'")
    parts = train.join(thirds.select("id", "part"), "id")
    rows = []
    for part, name in ((0, "lr"), (1, "dt"), (2, "svc")):
        m = BalancedModels(with_class_weights(parts.where(F.col("part") == part).drop("weight"), "label"), which=(name,))
        acc = single_accuracy(m, name, test).agg(F.avg("ok").alias("accuracy"), F.count("*").alias("n_test"))
        rows.append(acc.select(F.lit(f"{name}_part{part}").alias("model"), "accuracy", "n_test"))
    full = BalancedModels(train)
    voted = soft_vote(full, test)
    ens = voted.agg(F.avg((F.col("pred") == F.col("label")).cast("double")).alias("accuracy"),
                    F.count("*").alias("n_test"))
    rows.append(ens.select(F.lit("ensemble").alias("model"), "accuracy", "n_test"))
    scores = rows[0]
    for r in rows[1:]:
        scores = scores.unionByName(r)
    return {"scores": scores, "voted": voted}
