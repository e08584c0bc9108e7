"""Rent model: training table, fit, metrics, scoring, importances and suggestions."""

from __future__ import annotations

import warnings

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentlens.functions import features, parsing
from rentlens.operators import filters, sampling
from rentlens.operators.columns import numeric, require_columns, resolve_features
from rentlens.operators.frames import cut
from rentlens.operators.quantiles import exact_median
from rentlens.operators.reports import unit_context
from rentlens.plans.encoding import ONE_HOT, FeaturePreparation
from rentlens.plans.encoding import TARGET as TARGET_STATISTIC
from rentlens.sources.tables import save_model, write_metrics, write_stage

# Features of the two model variants.
BASIC_NUMERIC = ["area_sqm", "rooms", "floor", "year_built", "lat", "lon"]
BASIC_CATEGORICAL = ["city", "zip_code", "district", "condition"]
RICH_NUMERIC = [
    "area_sqm", "rooms", "floor", "pricetrend", "serviceCharge", "garden", "lift", "hasKitchen",
]
RICH_CATEGORICAL = ["typeOfFlat", "heatingType_clean", "periode_0005"]
TARGET = "rent_cold"

# Used where the training table has them: census rents of the listing's municipality.
CENSUS_NUMERIC = ["zensus_miete_total", "zensus_miete_decade", "zensus_factor_decade"]

# How each text column is encoded. Places have as many labels as there are places, so they
# go by target statistics; the others are short lists of kinds.
ENCODING = {
    "city": TARGET_STATISTIC, "zip_code": TARGET_STATISTIC, "district": TARGET_STATISTIC,
    "condition": ONE_HOT, "typeOfFlat": ONE_HOT, "heatingType_clean": ONE_HOT, "periode_0005": ONE_HOT,
}

#: Training rows that are worth a task of their own while cores are free, and those that a
#: task takes once there is one for every core.
LEAST_ROWS, ROWS_PER_TASK = 10_000, 250_000


def train_table(listings: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Plausible listings with a rent: ten features and the target."""
    known = filters.has_target(listings, TARGET)
    typed = known.withColumn("condition", parsing.lower_condition(F.col("condition")))
    names = [*(key or []), *BASIC_CATEGORICAL, *BASIC_NUMERIC, TARGET]
    return filters.plausible(typed).select(*names)


def load_train(df: DataFrame) -> DataFrame:
    """Numeric features and target as doubles; rows without target are dropped."""
    wanted = [c for c in [*RICH_NUMERIC, TARGET] if c in df.columns]
    typed = df.withColumns({c: numeric(df, c) for c in wanted})
    return filters.has_target(typed, TARGET)


def known_share(df: DataFrame, names: list[str]) -> DataFrame:
    """Percent of non-null cells per feature, smallest first."""
    shares = df.agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in names])
    long = shares.unpivot([], names, "feature", "share")
    return long.select("feature", (F.col("share") * 100).alias("known_pct")).orderBy(
        "known_pct", "feature"
    )


def spread_rows(df: DataFrame, count: int) -> DataFrame:
    """The ``count`` rows persisted in as many partitions as ``tasks_for`` says."""
    wide = df.repartition(tasks_for(count, df.sparkSession.sparkContext.defaultParallelism))
    wide.persist(StorageLevel.MEMORY_AND_DISK).count()
    return wide


def tasks_for(rows: int, cores: int) -> int:
    """Tasks of a pass over training rows: one a core, then whole rounds of ``ROWS_PER_TASK`` rows.

    Every partition sends its statistics of all open nodes, whatever the number of its rows,
    so more partitions than the cores or a task's memory need would only multiply them.
    """
    if rows <= cores * ROWS_PER_TASK:
        return max(1, min(cores, -(-rows // LEAST_ROWS)))
    return cores * -(-rows // (cores * ROWS_PER_TASK))


def fit_forest(
    train: DataFrame,
    numeric_names: list[str],
    text_names: list[str],
    trees: int,
    min_leaf: int,
    max_depth: int = 30,
    seed: int = 42,
    target: str = TARGET,
    encoding: dict[str, str] | None = None,
) -> PipelineModel:
    """Preparation, vectors and forest as one model that can be saved.

    ``encoding`` says for each text column whether it is ``one_hot`` or goes by ``target``
    statistics, whatever the number of its labels. The forest learns from statistics of
    other folds; new rows are scored with those of all rows. A label that training never saw
    is all zeros, or has the overall mean.
    """
    kinds = {c: (encoding or ENCODING)[c] for c in text_names}
    one_hot = [c for c in text_names if kinds[c] == ONE_HOT]
    by_target = [c for c in text_names if kinds[c] == TARGET_STATISTIC]
    train = train.select(*numeric_names, *text_names, target).persist(StorageLevel.MEMORY_AND_DISK)
    preparation = FeaturePreparation(
        numeric=numeric_names, one_hot=one_hot, by_target=by_target, target=target
    ).fit(train)
    ready = preparation.out_of_fold(train)
    vectors = Pipeline(stages=vector_stages(numeric_names, one_hot, by_target)).fit(ready)
    # Lookups and vectors neither add nor drop rows.
    rows = spread_rows(vectors.transform(ready).select("features", target), train.count())
    train.unpersist()
    forest = RandomForestRegressor(
        featuresCol="features",
        labelCol=target,
        predictionCol="pred",
        numTrees=trees,
        maxDepth=max_depth,
        minInstancesPerNode=min_leaf,
        featureSubsetStrategy="all",
        seed=seed,
        maxMemoryInMB=1024,
    ).fit(rows)
    rows.unpersist()
    return PipelineModel(stages=[preparation, *vectors.stages, forest])


def vector_stages(numeric_names: list[str], one_hot: list[str], by_target: list[str]) -> list:
    """From prepared columns to one vector."""
    stages: list = []
    if one_hot:
        indexed, coded = [f"{c}__ix" for c in one_hot], [f"{c}__oh" for c in one_hot]
        stages.append(
            StringIndexer(
                inputCols=[f"{c}__in" for c in one_hot], outputCols=indexed, handleInvalid="keep"
            )
        )
        stages.append(OneHotEncoder(inputCols=indexed, outputCols=coded, handleInvalid="keep"))
    parts = [f"{c}__in" for c in numeric_names]
    parts += [f"{c}__oh" for c in one_hot] + [f"{c}__in" for c in by_target]
    stages.append(VectorAssembler(inputCols=parts, outputCol="features", handleInvalid="keep"))
    return stages


def fit_basic(train: DataFrame, trees: int = 400, max_depth: int = 30) -> PipelineModel:
    return fit_forest(train, BASIC_NUMERIC, BASIC_CATEGORICAL, trees, 1, max_depth)


def fit_rich(train: DataFrame, trees: int = 200, max_depth: int = 30) -> PipelineModel:
    """Features that the table lacks are left out with a warning; none at all is an error."""
    found = rich_features(train)
    if found["missing"]:
        warnings.warn(f"features not found: {found['missing']}", stacklevel=2)
    return fit_forest(train, found["numeric"], found["categorical"], trees, 2, max_depth)


def rich_features(df: DataFrame) -> dict:
    """Present and missing features of the rich model; census columns count where present."""
    census = [c for c in CENSUS_NUMERIC if c in df.columns]
    return resolve_features(df, [*RICH_NUMERIC, *census], RICH_CATEGORICAL)


def train_job(
    table: DataFrame,
    key: str,
    model_path: str,
    metrics_path: str,
    sample: int = 50_000,
    test_share: float = 0.2,
    trees: int = 200,
    max_depth: int = 30,
) -> tuple[PipelineModel, DataFrame]:
    """Load, feature check, known share, sample, split, fit, metrics and both files.

    Returns the model and one row of metrics: sizes, errors, the features used and their
    known share. ``sample`` 0 takes every row. Missing features give a warning; a table
    without the target or without any feature is an error.
    """
    require_columns(table, [TARGET, key])
    rows = load_train(table)
    found = rich_features(rows)
    names = [*found["numeric"], *found["categorical"]]
    share = known_share(rows, names)
    # The split goes by the hash of the key, so the sample goes by another one.
    drawn = rows.withColumn("__draw", F.concat(F.lit("sample "), F.col(key).cast("string")))
    drawn = sampling.seeded_sample(drawn, "__draw", sample)
    train, test = sampling.split(drawn.select(key, *names, TARGET), key, test_share)
    model = fit_rich(train, trees, max_depth)
    scored = write_stage(
        score_batch(model, test).select(F.col(TARGET).alias("y"), "pred"),
        f"{metrics_path}.scored",
    )
    known = share.agg(
        F.sort_array(F.collect_list(F.struct("known_pct", "feature"))).alias("known")
    ).scalar()
    metrics = cut(
        regression_metrics(scored).select(
            train.agg(F.count(F.lit(1))).scalar().alias("n_train"),
            F.col("n").alias("n_test"),
            *[F.col(c) for c in ("mae", "mdae", "mape", "smape", "r2")],
            F.array(*[F.lit(c) for c in names]).alias("features_used"),
            F.lit(TARGET).alias("target"),
            F.lit(sample).alias("sample"),
            known.alias("known_share"),
        )
    )
    save_model(model, model_path)
    write_metrics(metrics, metrics_path)
    return model, metrics


def score_batch(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Input columns and ``pred``; features the input lacks count as missing."""
    return model.transform(df).select(*[F.col(f"`{c}`") for c in df.columns], "pred")


def regression_metrics(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """MAE, MdAE, MAPE, sMAPE and R² as one row."""
    real, guess = F.col(y).cast("double"), F.col(pred).cast("double")
    error = F.abs(guess - real)
    denominator = F.abs(real) + F.abs(guess)
    safe = F.when(denominator == 0, F.lit(1.0)).otherwise(denominator)
    median = exact_median(df.select(error.alias("error")), "error").select("median").scalar()
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(error).alias("mae"),
        (F.avg(error / F.greatest(real, F.lit(1e-6))) * 100).alias("mape"),
        (F.avg(2 * error / safe) * 100).alias("smape"),
        (1 - F.try_divide(F.avg(error * error), F.var_pop(real))).alias("r2"),
    ).select("n", "mae", median.alias("mdae"), "mape", "smape", "r2")


def evaluate(model: PipelineModel, test: DataFrame, path: str, target: str = TARGET) -> DataFrame:
    """Hold-out metrics over predictions that are scored once and kept at ``path``."""
    scored = score_batch(model, test).select(F.col(target).alias("y"), "pred")
    return regression_metrics(write_stage(scored, path))


def feature_importance(model: PipelineModel, scored: DataFrame, k: int = 30) -> DataFrame:
    """Names and importances of the ``k`` strongest features.

    ``scored`` is any frame transformed by the feature stages; its vector metadata has
    one name per feature, the importances come as one vector of the same length.
    """
    forest = model.stages[-1]
    attributes = scored.schema["features"].metadata["ml_attr"]["attrs"]
    names = {a["idx"]: a["name"] for group in attributes.values() for a in group}
    weights = forest.featureImportances
    pairs = [(names.get(int(i), f"f{i}"), float(w)) for i, w in zip(weights.indices, weights.values)]
    table = scored.sparkSession.createDataFrame(pairs, "feature string, importance double")
    return table.orderBy(F.desc("importance"), "feature").limit(k)


def transformed(model: PipelineModel, df: DataFrame) -> DataFrame:
    return model.transform(df)


def unit_features(units: DataFrame, properties: DataFrame) -> DataFrame:
    """One scoring row per unit; zero or missing sizes take the defaults 60, 2 and 0."""
    return unit_context(units, properties).select(
        F.col("id").alias("unit_id"),
        "city",
        "zip_code",
        F.lit(None).cast("string").alias("district"),
        F.lit(None).cast("double").alias("lat"),
        F.lit(None).cast("double").alias("lon"),
        features.or_default(F.col("size_sqm"), 60).alias("area_sqm"),
        features.or_default(F.col("rooms"), 2).alias("rooms"),
        F.coalesce(F.col("floor").cast("double"), F.lit(0.0)).alias("floor"),
        F.col("year_built").cast("double").alias("year_built"),
        parsing.lower_condition(F.col("condition"), "").alias("condition"),
    )


def suggest_rent(
    units: DataFrame, properties: DataFrame, model: PipelineModel | None = None
) -> DataFrame:
    """Model rent where it is positive, else the rule-based rent; one row per known unit."""
    rows = unit_features(units, properties)
    rule = features.heuristic_rent(
        F.col("city"), F.col("area_sqm"), F.col("condition"), F.col("floor")
    )
    if model is None:
        return rows.select("unit_id", rule.alias("suggested_rent"))
    scored = score_batch(model, rows)
    return scored.select("unit_id", _positive_or(F.col("pred"), rule).alias("suggested_rent"))


def _positive_or(pred: Column, rule: Column) -> Column:
    return F.when(pred > 0, parsing.round_cents(pred)).otherwise(rule)
