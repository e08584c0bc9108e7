"""Feature preparation as a stage of its own that is learned, saved and loaded with a model.

Numbers are filled with their median and texts with their most frequent value. A text
column is encoded as its caller says: ``target`` or ``one_hot``. The target statistic of a
label is its mean target, drawn to the mean of all rows by as many rows as ``prior`` says.
Labels stay a table, joined to the rows at any number of them; nothing about them is held
by the driver, and no two labels share a value because there are many.
"""

from __future__ import annotations

import warnings

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rentlens.operators.columns import numeric, quoted, resolve_features
from rentlens.operators.frames import cut, owned
from rentlens.operators.impute import column_medians
from rentlens.operators.joins import lookup_join

ONE_HOT, TARGET = "one_hot", "target"

FOLDS, PRIOR = 5, 20.0

STATS = "column string, label string, fold int, n long, total double"


class _Prepared(Params):
    numeric = Param(Params._dummy(), "numeric", "numeric features", TypeConverters.toListString)
    one_hot = Param(Params._dummy(), "one_hot", "texts for an indexer", TypeConverters.toListString)
    by_target = Param(Params._dummy(), "by_target", "texts by target statistic", TypeConverters.toListString)
    target = Param(Params._dummy(), "target", "column that is predicted", TypeConverters.toString)
    folds = Param(Params._dummy(), "folds", "parts of the training rows", TypeConverters.toInt)
    prior = Param(Params._dummy(), "prior", "rows that the overall mean counts", TypeConverters.toFloat)

    def _names(self) -> tuple[list[str], list[str], list[str]]:
        return tuple(self.getOrDefault(p) for p in (self.numeric, self.one_hot, self.by_target))


class FeaturePreparation(Estimator, _Prepared):
    """Learns fills and label statistics; columns of the result end in ``__in``."""

    @keyword_only
    def __init__(self, *, numeric=None, one_hot=None, by_target=None, target=None, folds=FOLDS, prior=PRIOR):
        super().__init__()
        self._setDefault(numeric=[], one_hot=[], by_target=[], folds=FOLDS, prior=PRIOR)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> PreparedFeatures:
        numbers, one_hot, by_target = self._names()
        folds = self.getOrDefault(self.folds)
        found = resolve_features(dataset, numbers, [*one_hot, *by_target])
        if found["missing"]:
            raise ValueError(f"features not found: {found['missing']}")
        fills = _fills(dataset, numbers, [*one_hot, *by_target])
        mean, stats = 0.0, dataset.sparkSession.createDataFrame([], STATS)
        if by_target:
            target = self.getOrDefault(self.target)
            mean = dataset.agg(F.avg(F.col(target).cast("double"))).first()[0] or 0.0
            stats = _statistics(dataset, by_target, fills, target, folds)
        model = PreparedFeatures(fills=fills, mean=mean)
        return self._copyValues(model)._with_stats(stats)


class PreparedFeatures(Model, _Prepared, MLWritable, MLReadable):
    """The learned stage. ``transform`` is for new rows; the rows it was learned from go
    through ``out_of_fold``, where no row's own target has a part in its features."""

    fills = Param(Params._dummy(), "fills", "learned value per column", TypeConverters.identity)
    mean = Param(Params._dummy(), "mean", "mean target of the training rows", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, fills=None, mean=None):
        super().__init__()
        self._setDefault(numeric=[], one_hot=[], by_target=[], folds=FOLDS, prior=PRIOR)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})
        self.stats: DataFrame | None = None

    def _with_stats(self, stats: DataFrame) -> PreparedFeatures:
        self.stats = stats
        return self

    def copy(self, extra=None) -> PreparedFeatures:
        return super().copy(extra)._with_stats(self.stats)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """Features that the rows lack count as missing, with a warning."""
        numbers, one_hot, by_target = self._names()
        found = resolve_features(dataset, numbers, [*one_hot, *by_target])
        if found["missing"]:
            warnings.warn(f"features not found, filled in: {found['missing']}", stacklevel=2)
        filled = self._filled(dataset)
        for c in by_target:
            known = self.stats.where(F.col("column") == c).groupBy(F.col("label").alias(f"{c}__in"))
            known = known.agg(F.sum("n").alias("__n"), F.sum("total").alias("__total"))
            joined = lookup_join(filled, known, [f"{c}__in"])
            filled = self._shrunk(joined, c, F.coalesce("__n", F.lit(0)), F.coalesce("__total", F.lit(0.0)))
        return filled

    def out_of_fold(self, dataset: DataFrame) -> DataFrame:
        """Training rows: statistics of a label come from the rows of the other folds."""
        by_target = self.getOrDefault(self.by_target)
        if not by_target:
            return self._filled(dataset)
        names = [*self.getOrDefault(self.fills), self.getOrDefault(self.target)]
        fold = _fold(names, self.getOrDefault(self.folds))
        filled = self._filled(dataset.withColumn("__fold", fold))
        for c in by_target:
            own = self.stats.where(F.col("column") == c)
            whole = own.groupBy("label").agg(F.sum("n").alias("__n"), F.sum("total").alias("__total"))
            rest = own.join(whole, "label").select(
                F.col("label").alias(f"{c}__in"),
                F.col("fold").alias("__fold"),
                (F.col("__n") - F.col("n")).alias("__n"),
                (F.col("__total") - F.col("total")).alias("__total"),
            )
            joined = lookup_join(filled, rest, [f"{c}__in", "__fold"])
            filled = self._shrunk(joined, c, F.col("__n"), F.col("__total"))
        return filled.drop("__fold")

    def _filled(self, dataset: DataFrame) -> DataFrame:
        numbers = self.getOrDefault(self.numeric)
        fills = self.getOrDefault(self.fills)
        cells = {}
        for c, value in fills.items():
            if c in numbers:
                have = numeric(dataset, c).cast("double") if c in dataset.columns else F.lit(None)
            else:
                have = quoted(c).cast("string") if c in dataset.columns else F.lit(None)
            cells[f"{c}__in"] = F.coalesce(have, F.lit(value))
        return dataset.withColumns(cells)

    def _shrunk(self, df: DataFrame, column: str, n: Column, total: Column) -> DataFrame:
        prior, mean = self.getOrDefault(self.prior), self.getOrDefault(self.mean)
        value = (total + F.lit(prior * mean)) / (n + F.lit(prior))
        return df.withColumn(f"{column}__in", value).drop("__n", "__total")

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: PreparedFeatures):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        session = self.sparkSession
        DefaultParamsWriter.saveMetadata(self.model, path, session)
        self.model.stats.write.parquet(f"{path}/statistics")


class _Reader(MLReader):
    def load(self, path: str) -> PreparedFeatures:
        session: SparkSession = self.sparkSession
        metadata = DefaultParamsReader.loadMetadata(path, session)
        model = PreparedFeatures()
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model._with_stats(session.read.schema(STATS).parquet(f"{path}/statistics"))


def _fold(names: list[str], folds: int) -> Column:
    """Equal rows share a fold, so none is judged by a copy of itself."""
    cells = [F.col(f"`{c}`").cast("string") for c in sorted(names)]
    return F.pmod(F.xxhash64(*cells), F.lit(folds)).cast("int")


def _fills(df: DataFrame, numbers: list[str], texts: list[str]) -> dict:
    """Medians of all numbers and most frequent values of all texts, one pass for each kind."""
    fills: dict = {c: 0.0 for c in numbers} | {c: "unknown" for c in texts}
    if numbers:
        typed = df.select(*[numeric(df, c).cast("double").alias(c) for c in numbers])
        # The cells that the medians keep are as many as the rows times the columns; they go
        # before the fit, which needs the memory.
        with owned():
            row = df.sparkSession.range(1).select(
                *[m.alias(c) for c, m in column_medians(typed, numbers).items()]
            ).first()
        fills |= {c: row[c] for c in numbers if row[c] is not None}
    if texts:
        long = df.select(*[quoted(c).cast("string").alias(c) for c in texts]).unpivot(
            [], [quoted(c) for c in texts], "column", "value"
        )
        counts = long.where("value is not null").groupBy("column", "value").count()
        top = counts.groupBy("column").agg(
            F.min(F.struct((-F.col("count")).alias("rank"), "value"))["value"].alias("value")
        )
        fills |= {r["column"]: r["value"] for r in top.collect()}
    return fills


def _statistics(df: DataFrame, by_target: list[str], fills: dict, target: str, folds: int) -> DataFrame:
    """Rows and sum of the target per column, label and fold: one pass for all columns."""
    rows = df.select(
        _fold([*fills, target], folds).alias("fold"),
        F.col(target).cast("double").alias("__y"),
        *[F.coalesce(quoted(c).cast("string"), F.lit(fills[c])).alias(c) for c in by_target],
    )
    long = rows.unpivot(["fold", "__y"], [quoted(c) for c in by_target], "column", "label")
    stats = long.groupBy("column", "label", "fold").agg(
        F.count("__y").alias("n"), F.coalesce(F.sum("__y"), F.lit(0.0)).alias("total")
    )
    return cut(stats.select("column", "label", "fold", "n", "total"))
