"""Spark ML learners behind one interface: fit on ``y`` and features, score a probability."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.ml import Model, Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import PCA, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the learners
LOGISTIC_C = 1.0
LOGISTIC_ITERATIONS = 2000
TREES = 300
LEARNING_RATE = 0.05
HIDDEN = 128
MLP_ITERATIONS = 300
PCA_COMPONENTS = 64
MAX_CATEGORY_BINS = 1024


@dataclass(frozen=True)
class Fitted:
    model: Model
    prepare: Callable[[DataFrame], DataFrame]

    def score(self, df: DataFrame) -> DataFrame:
        """Adds ``y_score``, the probability of the positive class."""
        scored = self.model.transform(self.prepare(df))
        return scored.withColumn("y_score", vector_to_array("probability")[1])


@dataclass(frozen=True)
class SignedMean:
    """Mean of the codes of some positions, each turned to rise with the label."""

    signs: list[float]
    first: int
    codes: str

    def score(self, df: DataFrame) -> DataFrame:
        """Adds ``y_score`` in [0, 1] for codes in [0, 1], to nine digits: equal codes have equal scores."""
        turned = [w * (F.get(self.codes, F.lit(self.first + i)) - 0.5) for i, w in enumerate(self.signs)]
        total = sum(turned, F.lit(0.0))
        return df.withColumn("y_score", F.round(total / len(self.signs) + 0.5, 9))


def fit_signed_mean(train: DataFrame, codes: str = "codes", seed: int = 5, first: int = 0, last: int | None = None) -> SignedMean:
    """The sign of each position is that of the gap between the means of both classes; positions ``first`` to ``last``."""
    width = _size(train, codes)
    last = _checked(first, last, width)
    return SignedMean(_signs(class_gaps(train, range(first, last), codes).first()), first, codes)


def class_gaps(train: DataFrame, positions: range, codes: str = "codes", keys: list[str] = []) -> DataFrame:
    """Gap ``g<i>`` between the mean codes of both classes per position, for each training side that ``keys`` tell apart."""
    gaps = [
        (F.avg(F.when(F.col("y") == 1, F.get(codes, F.lit(i)))) - F.avg(F.when(F.col("y") == 0, F.get(codes, F.lit(i))))).alias(f"g{i}")
        for i in positions
    ]
    return train.groupBy(*keys).agg(*gaps)


def signed_mean_of(gaps: list[float | None], codes: str = "codes", seed: int = 5, first: int = 0, last: int | None = None) -> SignedMean:
    """As :func:`fit_signed_mean`, from the gaps of all positions of a training side."""
    last = _checked(first, last, len(gaps))
    return SignedMean(_signs(gaps[first:last]), first, codes)


def _signs(gaps: Iterable[float | None]) -> list[float]:
    return [-1.0 if g is not None and g < 0 else 1.0 for g in gaps]


def _checked(first: int, last: int | None, width: int) -> int:
    last = width if last is None else last
    if not first < last <= width:
        raise ValueError(f"positions {first} to {last} of {width} codes")
    return last


def with_vector(df: DataFrame, codes: str = "codes") -> DataFrame:
    return df.withColumn("features", array_to_vector(F.col(codes).cast("array<double>")))


def _size(df: DataFrame, codes: str) -> int:
    return df.select(F.size(codes)).first()[0]


def fit_logistic(train: DataFrame, codes: str = "codes", seed: int = 5, c: float = LOGISTIC_C) -> Fitted:
    """Standardized features, L2 penalty 1/C on the summed loss."""
    n = train.count()
    scale = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True)
    model = LogisticRegression(
        featuresCol="scaled", labelCol="y", regParam=1.0 / (c * n), elasticNetParam=0.0,
        maxIter=LOGISTIC_ITERATIONS, standardization=False,
    )
    return Fitted(Pipeline(stages=[scale, model]).fit(with_vector(train, codes)), lambda d: with_vector(d, codes))


def fit_gbt(
    train: DataFrame, codes: str = "codes", seed: int = 5, trees: int = TREES, depth: int = 6
) -> Fitted:
    """Gradient-boosted trees; depth 5 gives up to 32 leaves, depth 6 up to 64."""
    model = GBTClassifier(featuresCol="features", labelCol="y", maxIter=trees, stepSize=LEARNING_RATE, maxDepth=depth, seed=seed)
    return Fitted(model.fit(with_vector(train, codes)), lambda d: with_vector(d, codes))


def fit_mlp(
    train: DataFrame, codes: str = "codes", seed: int = 5, hidden: int = HIDDEN, iterations: int = MLP_ITERATIONS
) -> Fitted:
    """Standardized features, one hidden layer."""
    scale = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True)
    layers = [_size(train, codes), hidden, 2]
    model = MultilayerPerceptronClassifier(featuresCol="scaled", labelCol="y", layers=layers, maxIter=iterations, seed=seed)
    return Fitted(Pipeline(stages=[scale, model]).fit(with_vector(train, codes)), lambda d: with_vector(d, codes))


def fit_categorical_gbt(
    train: DataFrame, columns: list[str], seed: int = 5, trees: int = TREES, depth: int = 6
) -> Fitted:
    """Trees on raw categories: indexed levels are nominal features, unseen levels a bin of their own."""
    # refuse before the indexer gathers the levels of a high-cardinality column
    rough = max(train.agg(*[F.approx_count_distinct(c) for c in columns]).first())
    if rough > 1.2 * MAX_CATEGORY_BINS:
        raise ValueError(f"about {rough} levels: use ordered codes instead of raw categories")
    index = StringIndexer(inputCols=columns, outputCols=[f"_ix_{c}" for c in columns], handleInvalid="keep").fit(train)
    bins = max(32, 1 + max(len(labels) for labels in index.labelsArray))
    pack = VectorAssembler(inputCols=[f"_ix_{c}" for c in columns], outputCol="features")
    model = GBTClassifier(featuresCol="features", labelCol="y", maxIter=trees, stepSize=LEARNING_RATE, maxDepth=depth, maxBins=bins, seed=seed)
    return Fitted(Pipeline(stages=[index, pack, model]).fit(train), lambda d: d)


def fit_pca_mlp(
    train: DataFrame, codes: str = "image", seed: int = 1042, components: int = PCA_COMPONENTS,
    hidden: int = HIDDEN, iterations: int = MLP_ITERATIONS,
) -> Fitted:
    """Image reader: centre, project on principal components of the training images, MLP."""
    n = train.count()
    k = min(components, _size(train, codes), max(2, n - 1))
    centre = StandardScaler(inputCol="features", outputCol="centred", withMean=True, withStd=False)
    project = PCA(k=k, inputCol="centred", outputCol="projected")
    model = MultilayerPerceptronClassifier(featuresCol="projected", labelCol="y", layers=[k, hidden, 2], maxIter=iterations, seed=seed)
    pipeline = Pipeline(stages=[centre, project, model])
    return Fitted(pipeline.fit(with_vector(train, codes)), lambda d: with_vector(d, codes))


LEARNERS = {
    "signed_mean": fit_signed_mean,
    "logistic": fit_logistic,
    "gbt_leaf": lambda train, codes="codes", seed=5, **kw: fit_gbt(train, codes, seed, depth=5, **kw),
    "gbt_depth": lambda train, codes="codes", seed=5, **kw: fit_gbt(train, codes, seed, depth=6, **kw),
    "mlp": fit_mlp,
    "pca_mlp": fit_pca_mlp,
}
BY_GAPS = {"signed_mean": signed_mean_of}  # fitted from one look at the training sides of all cells
COMPLEXITY = {"signed_mean": 0, "logistic": 1, "gbt_leaf": 2, "gbt_depth": 2, "cat_gbt": 2, "mlp": 3, "pca_mlp": 3}  # fixed values
