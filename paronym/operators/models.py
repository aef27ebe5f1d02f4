"""Classifiers over features: members of several kinds, calibration, means, stacking and explanations.

Members are ``pyspark.ml`` models.  Their kinds stand in for nets that Spark
lacks: the perceptron has sigmoid layers without dropout, trees that draw
random cuts become forests without bootstrap.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.ml import Model
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .metrics import average_precision
from .sampling import bootstrap, class_weight, numbered, order_hash


def with_vector(df: DataFrame, columns: list[str], name: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol=name, handleInvalid="keep").transform(df)


def _draw(seed: int, what: str) -> float:
    """A number from 0 to 1 that only seed and purpose decide."""
    return int(hashlib.md5(f"{seed}:{what}".encode()).hexdigest()[:12], 16) / 16**12


@dataclass
class Member:
    """A fitted classifier with its calibration of the logit: 1 / (1 + exp(-(slope * logit + shift)))."""

    name: str
    model: Model
    slope: float = 1.0
    shift: float = 0.0

    def score(self, df: DataFrame, out: str, features: str = "features") -> DataFrame:
        model = self.model.copy()
        for p, v in (("featuresCol", features), ("predictionCol", f"_{out}_p"), ("rawPredictionCol", f"_{out}_r"), ("probabilityCol", f"_{out}_q")):
            model.set(model.getParam(p), v)
        made = model.transform(df).withColumn(out, calibrated(vector_to_array(f"_{out}_q")[1], self.slope, self.shift))
        return made.drop(f"_{out}_p", f"_{out}_r", f"_{out}_q")


def logit(p: Column) -> Column:
    safe = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(safe / (1 - safe))


def calibrated(p: Column, slope: float, shift: float) -> Column:
    return 1 / (1 + F.exp(-(F.lit(slope) * logit(p) + F.lit(shift))))


def platt(scored: DataFrame, score: str = "score", label: str = "y") -> tuple[float, float]:
    """Slope and shift of a logistic regression on the logit; with one class only the score stays as it is."""
    # The fit reads its rows again and again; scoring them is what costs.
    rows = with_vector(cut_lineage(scored.select(logit(F.col(score)).alias("l"), F.col(label).cast("double").alias("label"))), ["l"])
    known = rows.agg(F.count("*").alias("n"), F.countDistinct("label").alias("k")).first()
    if known.k < 2:
        return 1.0, 0.0
    fitted = LogisticRegression(regParam=1 / known.n, standardization=False).fit(rows)
    return float(fitted.coefficients[0]), float(fitted.intercept)


def logistic_member(train: DataFrame, seed: int, weight: str | None = None) -> Member:
    """A logistic regression whose strength and kind of penalty the seed draws, on a bootstrap of the rows."""
    strength = 10 ** (-2 + 3 * _draw(seed, "C"))
    n = max(train.count(), 1)
    more = {} if weight is None else {"weightCol": weight}
    kind = LogisticRegression(regParam=1 / (strength * n), elasticNetParam=float(_draw(seed, "penalty") < 0.5), maxIter=50, **more)
    return Member(f"logistica_{seed}", kind.fit(train))


def forest_member(train: DataFrame, seed: int, weight: str | None = None, trees: tuple[int, int] = (20, 60)) -> Member:
    """A forest whose size, depth, leaves and share of features the seed draws."""
    pick = lambda what, options: options[int(_draw(seed, what) * len(options))]
    kind = RandomForestClassifier(
        numTrees=trees[0] + int(_draw(seed, "trees") * (trees[1] - trees[0])), maxDepth=pick("depth", (8, 12, 16)), minInstancesPerNode=pick("leaf", (1, 2, 4, 8)),
        featureSubsetStrategy=pick("features", ("sqrt", "log2", "0.5")), seed=seed, bootstrap=pick("kind", (True, False)), **({} if weight is None else {"weightCol": weight}),
    )
    return Member(f"floresta_{seed}", kind.fit(train))


def perceptron_member(train: DataFrame, seed: int, inputs: int, layers: tuple[int, ...] = (32, 16), steps: int = 40) -> Member:
    return Member(f"rede_{seed}", MultilayerPerceptronClassifier(layers=[inputs, *layers, 2], seed=seed, maxIter=steps).fit(train))


@dataclass
class Ensemble:
    """Members, each calibrated on its own; the score is the mean of theirs."""

    members: list[Member] = field(default_factory=list)

    def score(self, df: DataFrame, out: str = "score") -> DataFrame:
        names = [f"_{out}_{i}" for i in range(len(self.members))]
        for m, n in zip(self.members, names):
            df = m.score(df, n)
        parts = F.struct(*[F.col(n).alias(m.name) for m, n in zip(self.members, names)])
        return df.withColumns({out: sum((F.col(n) for n in names), F.lit(0.0)) / len(names), f"{out}_parts": parts}).drop(*names)


def bagging(train: DataFrame, validation: DataFrame, kinds: tuple[str, ...] = ("logistica", "floresta"), members: int = 2, seed: int = 42, inputs: int = 0, key: str = "pair_id") -> Ensemble:
    """Members on bootstraps of the training rows, calibrated on the validation rows.

    Positive rows weigh as many times as there are negatives for each; nets,
    which take no weights, see them so many times instead (rounded).  Both frames have ``features`` and a ``label`` of 0 and 1.  The number of
    members is a parameter, 1 at least; each fit is a distributed job.
    """
    made = Ensemble()
    weight = max(float(class_weight(train, "label").first()[0] or 0.0), 1.0)
    weighed = train.withColumn("weight", F.when(F.col("label") == 1, F.lit(weight)).otherwise(F.lit(1.0)))
    for i in range(max(1, members)):
        own = seed + 1000 * i
        drawn = cut_lineage(bootstrap(weighed, key, 1.0, own).withColumn("label", F.col("label").cast("double")))  # the kinds share it
        for kind in kinds:
            fit = {"logistica": logistic_member, "floresta": forest_member}.get(kind)
            if fit is None:
                times = F.when(F.col("label") == 1, F.lit(round(weight))).otherwise(F.lit(1))
                member = perceptron_member(drawn.withColumn("time", F.explode(F.sequence(F.lit(1), times))), own, inputs)
            else:
                member = fit(drawn, own, "weight")
            member.slope, member.shift = platt(member.score(validation, "score").withColumn("y", F.col("label")))
            made.members.append(member)
    return made


def stacked(ensemble: Ensemble, validation: DataFrame, columns: list[str], key: str = "pair_id", folds: int = 3) -> tuple[Member, DataFrame]:
    """A regression on features and members' scores, and the validation rows with scores of folds that weren't fitted on them."""
    scored = ensemble.score(validation, "m").select(key, "label", *columns, *[F.col("m_parts")[m.name].alias(f"s_{m.name}") for m in ensemble.members])
    inputs = [*columns, *[f"s_{m.name}" for m in ensemble.members]]
    rows = cut_lineage(with_vector(scored.withColumns({"label": F.col("label").cast("double"), "fold": F.pmod(F.conv(F.substring(order_hash(key, 7), 1, 8), 16, 10).cast("bigint"), F.lit(folds))}), inputs, "stack"))
    fit = lambda d: Member("meta", LogisticRegression(featuresCol="stack", regParam=0.01).fit(d))
    parts = [fit(rows.where(F.col("fold") != i)).score(rows.where(F.col("fold") == i), "score", "stack") for i in range(folds)]
    held = parts[0]
    for p in parts[1:]:
        held = held.unionByName(p)
    return fit(rows), held.select(key, "label", "score")


def permutation_importance(score, df: DataFrame, columns: list[str], key: str = "pair_id", repeats: int = 3, seed: int = 42) -> DataFrame:
    """``(feature, importance)``: the mean loss of average precision when a column's values change places.

    ``score`` takes a frame with ``columns`` and adds ``score``; values are
    exchanged by joining each row with the row of the same place in another
    hash order.  All columns are tried in one job a repeat: each row stands once
    for every column, with that column's value from the other row.
    """
    base = cut_lineage(df.select(key, "y", *columns))
    whole = average_precision(score(base)).first()[0]
    own = numbered(base.withColumn("all", F.lit(0)), key, ["all"], seed).select("rank", key, "y", *columns)
    tried = None
    for r in range(repeats):
        other = numbered(base.withColumn("all", F.lit(0)), key, ["all"], seed + 1 + r).select("rank", F.struct(*[F.col(c).alias(f"m{i}") for i, c in enumerate(columns)]).alias("other"))
        each = own.join(other, "rank").withColumns({"feature": F.explode(F.array(*map(F.lit, columns))), "round": F.lit(r)})
        moved = each.withColumns({c: F.when(F.col("feature") == c, F.col("other")[f"m{i}"]).otherwise(F.col(c)) for i, c in enumerate(columns)}).drop("rank", "other")
        tried = moved if tried is None else tried.unionByName(moved)
    lost = average_precision(score(tried).select("feature", "round", "y", "score"), "feature", "round")
    return lost.groupBy("feature").agg((F.lit(whole) - F.avg("average_precision")).alias("importance"))


def linear_attribution(member: Member, df: DataFrame, columns: list[str], baseline: dict[str, float], key: str = "pair_id") -> DataFrame:
    """``(key, feature, share)``: coefficient times distance from the baseline, each row's absolute values summing to 1."""
    weights = dict(zip(columns, map(float, member.model.coefficients)))
    parts = [F.struct(F.lit(c).alias("feature"), (F.lit(weights[c]) * (F.col(c) - F.lit(baseline[c]))).alias("x")) for c in columns]
    long = df.select(key, F.explode(F.array(*parts)).alias("p")).select(key, "p.*")
    total = F.sum(F.abs("x")).over(Window.partitionBy(key))
    return long.select(key, "feature", F.when(total > 0, F.col("x") / total).otherwise(F.lit(0.0)).alias("share"))


def mean_attribution(members: list[Member], df: DataFrame, columns: list[str], baseline: dict[str, float], key: str = "pair_id") -> DataFrame:
    """``(key, feature, share)``: the attributions of linear members averaged, each row's absolute values summing to 1 again."""
    every = None
    for m in members:
        one = linear_attribution(m, df, columns, baseline, key)
        every = one if every is None else every.unionByName(one)
    mean = every.groupBy(key, "feature").agg(F.avg("share").alias("x"))
    total = F.sum(F.abs("x")).over(Window.partitionBy(key))
    return mean.select(key, "feature", F.when(total > 0, F.col("x") / total).otherwise(F.lit(0.0)).alias("share"))


def focal_loss(p: Column, y: Column, alpha: float = 0.25, gamma: float = 2.0, smooth: float = 0.0) -> Column:
    """Loss of one row that falls with the share that is right already."""
    t = y * (1 - smooth) + 0.5 * smooth
    safe = F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), p))
    right = t * safe + (1 - t) * (1 - safe)
    weight = t * alpha + (1 - t) * (1 - alpha)
    return -weight * F.pow(1 - right, F.lit(gamma)) * (t * F.log(safe) + (1 - t) * F.log(1 - safe))


def weighted_cross_entropy(p: Column, y: Column, pos_weight: float = 1.0) -> Column:
    safe = F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), p))
    return -(F.lit(pos_weight) * y * F.log(safe) + (1 - y) * F.log(1 - safe))


