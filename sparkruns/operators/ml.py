"""Tree classifiers on Spark ML: categories of any number, stopping by average precision, several classes, a chain of learners."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import IllegalArgumentException
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import fresh, scratch
from .encoding import TargetStatistics, ordered_statistics
from .evaluate import average_precision

#: Most classes of a target; more are no classification of runs.
MOST_CLASSES = 100


class NoLearner(RuntimeError):
    """No learner of a chain accepted the data."""


@dataclass
class ConstantModel:
    """Scores every row alike, for data with one class."""

    probability: float
    classes: list = field(default_factory=list)
    backend: str = "constant"
    failures: list = field(default_factory=list)

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("probability_1", F.lit(float(self.probability)))


@dataclass
class Features:
    """Numbers with their means for missing ones, and categories as statistics of the target."""

    numeric: list[str]
    fills: list[float]
    categorical: list[str]
    statistics: TargetStatistics | None

    @property
    def names(self) -> list[str]:
        return [*self.numeric, *self.categorical]

    def vectors(self, df: DataFrame, name: str, ready: bool = False) -> DataFrame:
        """``df`` with a vector column; ``ready`` rows have their statistics already."""
        out = df if ready or not self.statistics else self.statistics.transform(df)
        numbers = {f"x_{c}": F.coalesce(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")), F.lit(f)) for c, f in zip(self.numeric, self.fills, strict=True)}
        out = out.withColumns(numbers) if numbers else out
        inputs = [*numbers, *(f"stat_{c}" for c in self.categorical)]
        return VectorAssembler(inputCols=inputs, outputCol=name).transform(out).select(*df.columns, name)


@dataclass
class BinaryModel:
    """A fitted forest, or the first ``trees`` of a boosted one."""

    features: Features
    fitted: object
    trees: int | None = None
    precisions: list[float] = field(default_factory=list)
    backend: str = "gbt"
    failures: list = field(default_factory=list)

    @property
    def names(self) -> list[str]:
        return self.features.names

    def transform(self, df: DataFrame) -> DataFrame:
        (vector,) = fresh(df, "features")
        out = self.features.vectors(df, vector)
        if self.trees is None:
            return self.fitted.transform(out).select(*df.columns, vector_to_array("probability")[1].alias("probability_1"))
        out, margins = _margins(self.fitted, out, vector, self.trees)
        total = sum(margins[1:], margins[0])
        return out.select(*df.columns, (1.0 / (1.0 + F.exp(-2.0 * total))).alias("probability_1"))


def _margins(fitted, df: DataFrame, vector: str, n: int) -> tuple[DataFrame, list[Column]]:
    """``df`` with the outputs of the first ``n`` trees, and their weighted columns."""
    columns = []
    for i, (tree, weight) in enumerate(zip(fitted.trees[:n], fitted.treeWeights[:n], strict=True)):
        tree = tree.copy()
        tree.setFeaturesCol(vector)
        tree.setPredictionCol(f"tree_{i}")
        df = tree.transform(df)
        columns.append(F.col(f"tree_{i}") * float(weight))
    return df, columns


def prefix_precisions(fitted, df: DataFrame, target: str, vector: str) -> list[float]:
    """Average precision of each prefix of a boosted ensemble, from one pass of the rows through all trees."""
    out, columns = _margins(fitted, df, vector, len(fitted.trees))
    total, prefixes = None, []
    for i, c in enumerate(columns):
        total = c if total is None else total + c
        prefixes.append(F.struct(F.lit(i).alias("trees"), total.alias("score")))
    rows = out.select(F.col(target).cast("int").alias("y"), F.explode(F.array(*prefixes)).alias("p")).select("y", "p.trees", "p.score")
    found = {r.trees: r.average_precision for r in average_precision(rows, ["trees"], "y", "score").collect()}
    return [found.get(i) or 0.0 for i in range(len(columns))]


def stopped_at(precisions: list[float], patience: int) -> int:
    """Number of trees of the best prefix, where boosting stops once ``patience`` further ones bring no better."""
    best = 0
    for i, p in enumerate(precisions):
        if p > precisions[best]:
            best = i
        elif i - best >= patience:
            break
    return best + 1


def _classes(df: DataFrame, target: str) -> list:
    found = sorted(r[0] for r in df.select(F.col(target)).filter(F.col(target).isNotNull()).distinct().limit(MOST_CLASSES + 1).collect())
    if not found:
        raise ValueError(f"target {target!r} has no values")
    if len(found) > MOST_CLASSES:
        raise ValueError(f"target {target!r} has more than {MOST_CLASSES} classes")
    return found


def _prepared(df: DataFrame, target: str, numeric: list[str], categorical: list[str], ids: list[str], validation: str | None, seed: int) -> tuple[Features, DataFrame, DataFrame | None]:
    """Features, training rows and validation rows (a boolean column) as vectors."""
    rows = df.filter(F.col(target).isNotNull())
    held = F.coalesce(F.col(validation), F.lit(False)) if validation else F.lit(False)
    train = rows.filter(~held)
    number = lambda c: F.col(c).cast("double")
    means = train.agg(*(F.avg(F.when(~F.isnan(number(c)), number(c))).alias(f"m{i}") for i, c in enumerate(numeric))).first() if numeric else []
    statistics = None
    if categorical:
        train, statistics = ordered_statistics(train, target, categorical, ids or [c for c in df.columns if c != target], seed=seed)
    features = Features(numeric, [m or 0.0 for m in means], categorical, statistics)
    (vector,) = fresh(df, "features")
    keep = [c for c in df.columns]
    train = scratch(features.vectors(train, vector, ready=True).select(*keep, vector), "training-vectors")
    return features, train, features.vectors(rows.filter(held), vector) if validation else None


def fit_binary(df: DataFrame, target: str, numeric: list[str], categorical: list[str] = [], weight: str | None = None, validation: str | None = None, backend: str = "gbt", iterations: int = 20, depth: int = 5, rate: float = 0.1, seed: int = 7, patience: int = 50, min_rows: int = 1, min_gain: float = 0.0, subsample: float = 1.0, ids: list[str] = [], bins: int = 64):  # noqa: B006
    """A boosted (``gbt``) or bagged (``rf``) tree classifier of a 0/1 target; one class gives a constant.

    Rows of the boolean column ``validation`` take no part in fitting; of a boosted ensemble they choose the number of
    trees by average precision, with ``patience``. Categories become statistics of the target in an order by ``ids``.
    ``min_rows`` and ``min_gain`` keep leaves from fitting few rows.
    """
    classes = _classes(df.filter(~F.coalesce(F.col(validation), F.lit(False))) if validation else df, target)
    if len(classes) < 2:
        return ConstantModel(float(classes[0]), classes)
    features, train, held = _prepared(df, target, numeric, categorical, ids, validation, seed)
    vector = train.columns[-1]
    return _fit(features, train.withColumn(target, F.col(target).cast("double")), held, target, vector, weight, backend, iterations, depth, rate, seed, patience, min_rows, min_gain, subsample, bins)


def _fit(features, train, held, target, vector, weight, backend, iterations, depth, rate, seed, patience, min_rows, min_gain, subsample, bins) -> BinaryModel:
    common = {"labelCol": target, "featuresCol": vector, "maxDepth": depth, "seed": seed, "maxBins": bins, "minInstancesPerNode": min_rows, "minInfoGain": min_gain, "subsamplingRate": subsample} | ({"weightCol": weight} if weight else {})
    if backend == "rf":
        return BinaryModel(features, RandomForestClassifier(numTrees=iterations, **common).fit(train), backend=backend)
    fitted = GBTClassifier(maxIter=iterations, stepSize=rate, **common).fit(train)
    precisions = prefix_precisions(fitted, held, target, vector) if held is not None else []
    return BinaryModel(features, fitted, stopped_at(precisions, patience) if precisions else len(fitted.trees), precisions)


# several classes

#: Learners of run models, in order of preference.
RUN_BACKENDS = ("gbt", "rf")


@dataclass
class ClassModel:
    """One model for each class against the rest; probabilities add up to one."""

    classes: list
    models: list
    backend: str
    failures: list

    def transform(self, df: DataFrame) -> DataFrame:
        """``probabilities`` in the order of ``classes``, and the ``predicted`` class; of equal ones the first."""
        out = df
        names = fresh(df, *(f"of_{i}" for i in range(len(self.classes))))
        for name, m in zip(names, self.models, strict=True):
            out = m.transform(out).withColumnRenamed("probability_1", name)
        total = sum((F.col(n) for n in names[1:]), F.col(names[0]))
        shares = F.array(*(F.when(total > 0, F.col(n) / total).otherwise(F.lit(1.0 / len(names))) for n in names))
        labels = F.array(*(F.lit(c) for c in self.classes))
        out = out.withColumn(names[0], shares)
        return out.select(*df.columns, F.col(names[0]).alias("probabilities"), labels[F.array_position(names[0], F.array_max(names[0])).cast("int") - 1].alias("predicted"))


def fit_classes(df: DataFrame, target: str, numeric: list[str], categorical: list[str] = [], weight: str | None = None, balanced: bool = True, backends=RUN_BACKENDS, **settings):  # noqa: B006
    """A classifier of two or more classes by the first learner of a chain that accepts the data; ``NoLearner`` if none does.

    With ``balanced``, classes weigh alike, whatever their numbers, times a row's own weight. Rows without a target take
    no part; one class gives a model that is certain of it. Only a learner's refusal of the data or of its settings
    passes to the next one; whatever else fails, fails.
    """
    classes = _classes(df, target)
    if len(classes) == 1:
        return ClassModel(classes, [ConstantModel(1.0)], "constant", [])
    rows = df.filter(F.col(target).isNotNull())
    balance, one = fresh(df, "balance", "one")
    own = F.coalesce(F.col(weight).cast("double"), F.lit(0.0)) if weight else F.lit(1.0)
    sizes = {r[0]: r[1] for r in rows.groupBy(target).agg(F.sum(own)).collect()}
    whole = sum(sizes.values())
    failures: list[tuple[str, str]] = []
    for backend in backends:
        try:
            models = []
            for c in classes[1:] if len(classes) == 2 else classes:
                is_ = F.col(target) == F.lit(c)
                scale = F.when(is_, whole / (2 * max(sizes[c], 1e-300))).otherwise(whole / (2 * max(whole - sizes[c], 1e-300))) if balanced else F.lit(1.0)
                part = rows.withColumns({one: F.when(is_, 1).otherwise(0), balance: own * scale})
                models.append(fit_binary(part, one, numeric, categorical, weight=balance, backend=backend, **settings))
        except IllegalArgumentException as e:
            failures.append((backend, str(e).split("\n")[0]))
            continue
        if len(classes) == 2:
            models = [_Complement(models[0]), models[0]]
        return ClassModel(classes, models, backend, failures)
    raise NoLearner("; ".join(f"{b}: {why}" for b, why in failures))


@dataclass
class _Complement:
    model: object

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(df).withColumn("probability_1", 1.0 - F.col("probability_1"))


def fit_with_fallback(df: DataFrame, target: str, numeric: list[str], categorical: list[str] = [], backends=RUN_BACKENDS, **settings):  # noqa: B006
    """A model of a 0/1 target by the first learner of a chain that accepts the data; ``NoLearner`` if none does."""
    failures: list[tuple[str, str]] = []
    for backend in backends:
        try:
            model = fit_binary(df, target, numeric, categorical, backend=backend, **settings)
        except IllegalArgumentException as e:
            failures.append((backend, str(e).split("\n")[0]))
            continue
        model.failures = failures
        return model
    raise NoLearner("; ".join(f"{b}: {why}" for b, why in failures))


def feature_importance(model, n: int | None = None) -> list[tuple[str, float]]:
    """Features and their importance, highest first."""
    if isinstance(model, ConstantModel):
        return []
    weights = model.fitted.featureImportances.toArray().tolist()
    return sorted(zip(model.names, weights, strict=True), key=lambda x: (-x[1], x[0]))[:n]
