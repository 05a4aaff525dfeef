"""Clustering and benchmark models on tables with pyspark.ml."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import numeric
from tessera.operators.index import impute_medians
from tessera.operators.metrics import all_metrics
from tessera.operators.splits import protocol_splits
from tessera.operators.transform import zscore
from tessera.runtime import attach, keep, require, require_columns


def kmeans_groups(
    df: DataFrame, columns: Sequence[str], k: int = 4, seed: int = 42, restarts: int = 20
) -> tuple[DataFrame, DataFrame]:
    """K-means on median-filled, standardised columns. The best of several seeds
    is kept and clusters are numbered by their centre. Returns the rows with
    ``cluster_id`` and the cluster report."""
    columns = list(columns)
    require_columns(df, columns)
    require(k >= 2, "k must be at least 2")
    # Many passes follow, and the input may be a join of large tables.
    raw = keep(df.withColumns({f"__x_{c}": numeric(c) for c in columns}))
    require(raw.limit(k).count() == k, "there must be at least k rows")
    filled, _ = impute_medians(raw, [f"__x_{c}" for c in columns])
    standard = zscore(filled, [f"__x_{c}" for c in columns], suffix="__std")
    inputs = [f"__x_{c}__std" for c in columns]
    vectors = keep(VectorAssembler(inputCols=inputs, outputCol="__vec").transform(standard).drop(*inputs))
    best = None
    for attempt in range(restarts):
        model = KMeans(k=k, seed=seed + attempt, featuresCol="__vec", predictionCol="__c").fit(vectors)
        if best is None or model.summary.trainingCost < best[0]:
            best = (model.summary.trainingCost, model)
    centres = [tuple(float(v) for v in centre) for centre in best[1].clusterCenters()]
    place = {old: new for new, old in enumerate(sorted(range(len(centres)), key=lambda i: centres[i]))}
    number = F.coalesce(*[F.when(F.col("__c") == old, F.lit(new)) for old, new in place.items()])
    scored = best[1].transform(vectors).withColumn("cluster_id", number)
    report = cluster_report(scored, {f"__x_{c}": c for c in columns})
    return scored.drop("__vec", "__c", *[f"__x_{c}" for c in columns]), report


def cluster_report(df: DataFrame, columns: Mapping[str, str] | Sequence[str], cluster: str = "cluster_id") -> DataFrame:
    """Size and mean features of each cluster."""
    names = columns if isinstance(columns, Mapping) else {c: c for c in columns}
    return df.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("cluster_size"), *[F.avg(c).alias(out) for c, out in names.items()]
    )


def standardize_features(
    df: DataFrame, columns: Sequence[str], role: str = "role", by: Sequence[str] = ()
) -> DataFrame:
    """Standardise with statistics of the training rows; a missing value takes
    the training mean and a near-constant column a unit deviation."""
    by = list(by)
    train = df.where(F.col(role) == "train")
    aggs = []
    for c in columns:
        aggs += [F.avg(numeric(c)).alias(f"__m_{c}"), F.stddev_pop(numeric(c)).alias(f"__s_{c}")]
    stats = train.groupBy(*by).agg(*aggs) if by else train.agg(*aggs)

    def scaled(c: str):
        sd = F.when(F.col(f"__s_{c}") <= 1e-6, F.lit(1.0)).otherwise(F.col(f"__s_{c}"))
        return (F.coalesce(numeric(c), F.col(f"__m_{c}")) - F.col(f"__m_{c}")) / sd

    out = attach(df, stats, by).withColumns({c: scaled(c) for c in columns})
    return out.drop(*[f"__{p}_{c}" for c in columns for p in "ms"])


def standardize_patches(df: DataFrame, patch: str, channels: int, role: str = "role") -> DataFrame:
    """Standardise each channel of a flat patch with training statistics."""
    slots = F.posexplode(patch).alias("__slot", "__v")
    width = F.floor(F.size(patch) / channels)
    values = df.where(F.col(role) == "train").select(width.alias("__w"), slots)
    channel = F.floor(F.col("__slot") / F.col("__w")).alias("__ch")
    stats = values.groupBy(channel).agg(F.avg("__v").alias("m"), F.stddev_pop("__v").alias("s"))
    # At most ``channels`` rows become the two small arrays.
    table = stats.agg(F.array_sort(F.collect_list(F.struct("__ch", "m", "s"))).alias("__stats"))
    scaled = F.transform(
        F.col(patch),
        lambda v, i: (v - _channel(i, patch, channels)["m"])
        / F.when(_channel(i, patch, channels)["s"] <= 1e-6, 1.0).otherwise(_channel(i, patch, channels)["s"]),
    )
    return attach(df, table, []).withColumn(patch, scaled.cast("array<float>")).drop("__stats")


def _channel(i, patch: str, channels: int):
    return F.get(F.col("__stats"), F.floor(i * channels / F.size(patch)).cast("int"))


def _each_protocol(rows: DataFrame, by: str, fit: Callable[[str], DataFrame], workers: int = 4) -> DataFrame:
    """Fit the protocols side by side, a few at a time; their jobs share the cluster."""
    names = sorted(r[by] for r in rows.select(by).distinct().collect())  # one entry per protocol
    with ThreadPoolExecutor(workers) as pool:
        scored = list(pool.map(inheritable_thread_target(rows.sparkSession)(fit), names))
    return reduce(DataFrame.unionByName, scored)


def logistic_curves(
    train: DataFrame, x: str, label: str, by: str, penalty: float = 1.0, passes: int = 64
) -> DataFrame:
    """Logistic regression of a 0/1 label on one variable for every group at once:
    ``by, intercept, slope``. Half the squared slope times ``penalty`` is added
    to the summed loss; the intercept is free.

    Each pass is one grouped aggregation that gives all groups the loss, gradient
    and 2 x 2 Hessian at their candidate; a candidate with a higher loss is drawn
    back by half. Passes end when no group moves. Rows without the variable or
    label are left out; a group of one class has an infinite intercept.
    """
    rows = keep(train.select(by, numeric(x).alias("__x"), F.col(label).cast("double").alias("__y")).dropna())
    zero = F.lit(0.0)
    classes = F.log(F.try_divide(F.sum("__y"), F.sum(1 - F.col("__y"))))
    state = keep(rows.groupBy(by).agg(
        F.avg("__x").alias("m"), F.when(F.stddev_pop("__x") > 0, F.stddev_pop("__x")).otherwise(1.0).alias("s"),
        F.avg("__y").alias("share"), classes.alias("da"),
    ).select(by, "m", "s", "share", zero.alias("a"), zero.alias("b"), F.coalesce("da", zero).alias("da"), zero.alias("db"),
             F.lit(float("inf")).alias("loss")))
    mixed = (F.col("share") > 0) & (F.col("share") < 1)
    for _ in range(passes):
        tried = state.where(mixed).select(by, "m", "s", (F.col("a") + F.col("da")).alias("u"), (F.col("b") + F.col("db")).alias("v"))
        z = (F.col("__x") - F.col("m")) / F.col("s")
        held = rows.join(tried, by).select(by, "__y", z.alias("z"), (F.col("u") + F.col("v") * z).alias("t"))
        y, z, t = F.col("__y"), F.col("z"), F.col("t")
        p = 1 / (1 + F.exp(-t))
        w = p * (1 - p)
        sums = held.groupBy(by).agg(
            F.sum(F.greatest(t, zero) + F.log1p(F.exp(-F.abs(t))) - y * t).alias("f"), F.sum(p - y).alias("g0"), F.sum((p - y) * z).alias("g1"),
            F.sum(w).alias("h00"), F.sum(w * z).alias("h01"), F.sum(w * z * z).alias("h11"),
        )
        u, v = F.col("a") + F.col("da"), F.col("b") + F.col("db")
        pull = F.lit(float(penalty)) / (F.col("s") * F.col("s"))
        f, g1, h11 = F.col("f") + pull * v * v / 2, F.col("g1") + pull * v, F.col("h11") + pull
        det = F.col("h00") * h11 - F.col("h01") * F.col("h01")
        better = f <= F.col("loss")
        moved = {
            "a": (u, F.col("a")), "b": (v, F.col("b")), "loss": (f, F.col("loss")),
            "da": (F.try_divide(F.col("h01") * g1 - h11 * F.col("g0"), det), F.col("da") / 2),
            "db": (F.try_divide(F.col("h01") * F.col("g0") - F.col("h00") * g1, det), F.col("db") / 2),
        }
        after = state.where(mixed).join(sums, by).select(
            by, "m", "s", "share", *[F.coalesce(F.when(better, new).otherwise(old), zero).alias(c) for c, (new, old) in moved.items()]
        )
        state = keep(after.unionByName(state.where(~mixed)))
        if state.where(mixed & (F.abs("da") + F.abs("db") > 1e-10)).isEmpty():
            break
    slope = F.col("b") / F.col("s")
    endless = F.when(F.col("share") >= 1, float("inf")).when(F.col("share") <= 0, float("-inf"))
    return state.select(by, F.coalesce(endless, F.col("a") - slope * F.col("m")).alias("intercept"), slope.alias("slope"))


def linear_baseline(
    rows: DataFrame, score: str, truth: str, label: str, by: str = "protocol"
) -> DataFrame:
    """Least-squares line and logistic curve on the negated score, fitted per
    protocol on its training rows. Returns test rows with ``rwi_pred`` and
    ``low_wealth_prob``; a protocol without training rows gets NULL. The line is
    closed form, in one aggregation; the curves of all protocols share theirs."""
    rows = rows.withColumn("__x", -numeric(score))
    train = rows.where(F.col("role") == "train")
    y, x = F.col(truth).cast("double"), F.col("__x")
    both = y.isNotNull() & x.isNotNull()
    y, x = F.when(both, y), F.when(both, x)
    # A constant score carries no slope; the line is then the mean.
    slope = F.when(F.var_pop(x) > 0, F.covar_pop(y, x) / F.var_pop(x)).otherwise(0.0)
    line = train.groupBy(by).agg(slope.alias("__b"), F.avg(y).alias("__my"), F.avg(x).alias("__mx"))
    line = line.select(by, "__b", (F.col("__my") - F.col("__b") * F.col("__mx")).alias("__a"))
    curve = logistic_curves(train, "__x", label, by).select(by, F.col("intercept").alias("__c"), F.col("slope").alias("__d"))
    test = attach(rows.where(F.col("role") == "test"), line.join(curve, by, "left"), [by])
    fitted = {
        "rwi_pred": F.col("__a") + F.col("__b") * F.col("__x"),
        "low_wealth_prob": 1 / (1 + F.exp(-(F.col("__c") + F.col("__d") * F.col("__x")))),
    }
    return test.withColumns(fitted).drop("__a", "__b", "__c", "__d", "__x")


def boosted_trees(
    rows: DataFrame, features: Sequence[str], truth: str, label: str, by: str = "protocol",
    trees: int = 400, depth: int = 6, rate: float = 0.05, subsample: float = 0.9, seed: int = 42,
    columns: float = 0.9,
) -> DataFrame:
    """Gradient-boosted regression and classification per protocol, each tree on
    a share of the rows, each split on a share of the columns, positives weighted
    by the class ratio. Returns scored test rows."""
    features = list(features)
    scaled = standardize_features(rows, features, by=[by])
    vectors = keep(VectorAssembler(inputCols=features, outputCol="__vec", handleInvalid="keep").transform(scaled))
    settings = {
        "featuresCol": "__vec", "maxIter": trees, "maxDepth": depth, "stepSize": rate,
        "subsamplingRate": subsample, "featureSubsetStrategy": str(columns), "seed": seed,
    }

    def fit(name: str) -> DataFrame:
        part = vectors.where(F.col(by) == name)
        train = part.where(F.col("role") == "train").withColumn("__y", F.col(label).cast("double"))
        counts = train.agg(F.count_if(F.col("__y") == 0).alias("q"), F.count_if(F.col("__y") == 1).alias("p")).first()
        weighted = train.withColumn(
            "__w", F.when(F.col("__y") == 1, float(counts["q"]) / max(counts["p"], 1)).otherwise(1.0)
        )
        tree = GBTRegressor(labelCol=truth, predictionCol="rwi_pred", **settings).fit(train)
        klass = GBTClassifier(labelCol="__y", weightCol="__w", **settings).fit(weighted)
        scored = klass.transform(tree.transform(part.where(F.col("role") == "test")))
        return scored.withColumn("low_wealth_prob", vector_to_array("probability")[1])

    return _each_protocol(rows, by, fit).drop("__vec", "rawPrediction", "probability", "prediction")


def _add(out: DataFrame | None, more: DataFrame) -> DataFrame:
    return more if out is None else out.unionByName(more)


PREDICTION_COLUMNS = (
    "protocol", "model", "cell_id", "city", "rwi_true", "rwi_pred", "low_wealth_true", "low_wealth_prob",
)


def run_benchmark(
    df: DataFrame,
    features: Sequence[str],
    models: Sequence[str] = ("linear_baseline", "boosted_trees"),
    score: str = "deprivation_index_0_100",
    truth: str = "rwi_mean",
    label: str = "rwi_bottom_quantile_flag",
    mask: str = "rwi_label_available",
    by: str = "city",
    id: str = "cell_id",
    seed: int = 42,
    strategy: str = "auto",
    trees: int = 400,
    depth: int = 6,
) -> tuple[DataFrame, DataFrame]:
    """Fit each model under each hold-out protocol. Returns the long metric
    table and the prediction table."""
    splits = protocol_splits(df, by, label, mask, seed, strategy, id)
    columns = dict.fromkeys([id, by, score, truth, label, *features])
    rows = keep(splits.join(df.select(*columns), id).withColumn("__label", F.col(label).cast("int")))
    fits: dict[str, Callable[[], DataFrame]] = {
        "linear_baseline": lambda: linear_baseline(rows, score, truth, "__label"),
        "boosted_trees": lambda: boosted_trees(rows, features, truth, "__label", trees=trees, depth=depth, seed=seed),
    }
    unknown = [m for m in models if m not in fits]
    require(not unknown, f"unknown models {unknown}")
    predictions = None
    for model in models:
        scored = fits[model]().select(
            "protocol", F.lit(model).alias("model"), F.col(id).alias("cell_id"), F.col(by).alias("city"),
            F.col(truth).cast("double").alias("rwi_true"), "rwi_pred",
            F.col("__label").alias("low_wealth_true"), "low_wealth_prob",
        )
        predictions = _add(predictions, scored)
    predictions = keep(predictions)
    return all_metrics(predictions), predictions


def align_to(df: DataFrame, ids: DataFrame, id: str = "cell_id") -> DataFrame:
    """Rows of ``df`` for the given ids, carrying the position ``ids`` has."""
    return ids.join(df, id, "inner")
