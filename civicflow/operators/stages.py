"""Preparation and data steps as ``pyspark.ml`` stages.

* :class:`Step` is one column operator or one fitted dictionary of the library
  with its arguments and, where it has one, its table; the table is saved
  beside the stage.  A whole preparation is a ``PipelineModel`` of steps.
* :class:`StateModel` is the base of models whose parameters are one JSON text.
* :class:`Standardize`, :class:`PowerTransform` and :class:`OverSampled` are the
  data steps of training (H1, H2, H3) on the feature vector; fitted inside a
  pipeline they see the rows of the fit alone.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicflow import functions as cf
from civicflow.operators import scaling

FEATURES = "features"


# ---------------------------------------------------------------- models with a JSON state

class StateModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """A ``pyspark.ml`` model whose parameters are one JSON text, so that it
    saves, loads and joins pipelines like any other stage.

    Subclasses give ``scores(df, x)``: an array of one number per class, from
    the features as an array, and whether they are log likelihoods.
    """

    state = Param(Params._dummy(), "state", "fitted parameters as JSON", typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, state: str = "{}"):
        super().__init__()
        self._set(state=state)

    def values(self) -> dict:
        return json.loads(self.getOrDefault(self.state))

    def scores(self, x: Column) -> Column:
        raise NotImplementedError(type(self).__name__)

    def probabilities(self, raw: Column) -> Column:
        """Softmax, stable against large scores."""
        e = F.transform(raw, lambda v: F.exp(v - F.array_max(raw)))
        return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda s, w: s + w))

    def _transform(self, df: DataFrame) -> DataFrame:
        return self._labelled(df.withColumn("rawPrediction", self.scores(vector_to_array(F.col(FEATURES)))))

    def _labelled(self, out: DataFrame) -> DataFrame:
        labels = F.array(*[F.lit(float(c)) for c in self.values()["classes"]])
        return (out.withColumn("probability", self.probabilities(F.col("rawPrediction")))
                   .withColumn("prediction", F.element_at(labels, cf.argmax_index("rawPrediction") + 1)))


# ---------------------------------------------------------------- preparation steps

def _kinds() -> dict[str, Callable]:
    """What a step can be: ``(df, table, **arguments) -> df``."""
    from civicflow.operators import categories, clean, dates, enrich, profile

    def plain(fn: Callable) -> Callable:
        return lambda df, table, **args: fn(df, **args)

    def dictionary(cls: type) -> Callable:
        def run(df: DataFrame, table: DataFrame, **args) -> DataFrame:
            own = cls(**args)
            setattr(own, cls.table_name, table)
            return own.transform(df)
        return run

    def numbers(cls: type, name: str) -> Callable:
        def run(df: DataFrame, table: None, fitted: dict, **args) -> DataFrame:
            own = cls(**args)
            setattr(own, name, fitted)
            return own.transform(df)
        return run

    found = {fn.__name__: plain(fn) for fn in (
        clean.drop_if_present, clean.fill_missing_like, clean.drop_negative, clean.drop_missing_key, clean.coerce_integer, clean.round_columns,
        clean.clip_columns, clean.clean_column_names, clean.zero_columns, dates.add_duration_days, dates.add_date_features)}
    found |= {cls.__name__: dictionary(cls) for cls in (categories.TopNBucketer, categories.TopNEncoder, categories.DenseCodes, categories.RareBucketer)}
    found |= {"IQRCapper": numbers(categories.IQRCapper, "bounds"), "NullImputer": numbers(profile.NullImputer, "fill"),
              "ZScore": numbers(scaling.ZScore, "stats"), "YeoJohnsonGrid": numbers(scaling.YeoJohnsonGrid, "best")}
    found["fill_group_from_dimension"] = lambda df, table, code, group, key, name: enrich.fill_group_from_dimension(df, code, group, table, key, name)
    found["attach_shares"] = lambda df, table, column, key, shares, missing: enrich.attach_shares(df, column, table, key, shares, missing=missing)
    return found


class _StepWriter(DefaultParamsWriter):
    def saveImpl(self, path: str) -> None:  # noqa: N802 - name of pyspark.ml
        super().saveImpl(path)
        if self.instance.table is not None:
            self.instance.table.write.parquet(f"{path}/table")


class _StepReader(DefaultParamsReader):
    def load(self, path: str) -> Step:
        step = super().load(path)
        if step.getOrDefault(step.has_table):
            step.table = self.sparkSession.read.parquet(f"{path}/table")
        return step


class Step(Model, DefaultParamsReadable, DefaultParamsWritable):
    """One operator with its arguments and table, as a stage that saves."""

    kind = Param(Params._dummy(), "kind", "name of the operator", typeConverter=TypeConverters.toString)
    args = Param(Params._dummy(), "args", "its arguments as JSON", typeConverter=TypeConverters.toString)
    has_table = Param(Params._dummy(), "has_table", "whether a table belongs to it", typeConverter=TypeConverters.toBoolean)

    def __init__(self, kind: str = "", table: DataFrame | None = None, **args):
        super().__init__()
        self.table = table
        self._set(kind=kind, args=json.dumps(args), has_table=table is not None)

    def _transform(self, df: DataFrame) -> DataFrame:
        return _kinds()[self.getOrDefault(self.kind)](df, self.table, **json.loads(self.getOrDefault(self.args)))

    def write(self) -> _StepWriter:
        return _StepWriter(self)

    @classmethod
    def read(cls) -> _StepReader:
        return _StepReader(cls)


def step_of(fitted) -> Step:
    """A fitted dictionary or set of numbers as a stage."""
    name = type(fitted).__name__
    numbers = {"IQRCapper": ("bounds", ("columns", "k")), "NullImputer": ("fill", ("unknown",)), "ZScore": ("stats", ("columns", "suffix")),
               "YeoJohnsonGrid": ("best", ("columns",))}
    if name in numbers:
        own, params = numbers[name]
        return Step(name, None, fitted=getattr(fitted, own), **{p: getattr(fitted, p) for p in params})
    return Step(name, getattr(fitted, fitted.table_name), **{p: getattr(fitted, p) for p in fitted.params})


# ---------------------------------------------------------------- data steps of training

class Standardized(StateModel):
    """H1: z-scores of the feature vector; a component without spread is 0, a missing one stays missing."""

    def _transform(self, df: DataFrame) -> DataFrame:
        v = self.values()
        own = F.arrays_zip(vector_to_array(F.col(FEATURES)).alias("x"), F.array(*map(F.lit, v["mean"])).alias("m"), F.array(*map(F.lit, v["sd"])).alias("s"))
        z = F.transform(own, lambda c: F.when((c["s"] == 0) & ~F.isnan(c["x"]), 0.0).otherwise((c["x"] - c["m"]) / F.when(c["s"] != 0, c["s"]).otherwise(1.0)))
        return df.withColumn(FEATURES, array_to_vector(z))


class Powered(StateModel):
    """H2: the Yeo-Johnson transform of the feature vector, with a lambda for each component."""

    def _transform(self, df: DataFrame) -> DataFrame:
        own = F.zip_with(vector_to_array(F.col(FEATURES)), F.array(*map(F.lit, self.values()["lambdas"])), scaling.yeo_johnson_of)
        return df.withColumn(FEATURES, array_to_vector(own))


def _psi(x: np.ndarray, lam: float) -> np.ndarray:
    """The Yeo-Johnson transform of numbers."""
    out = np.empty_like(x)
    up = x >= 0
    out[up] = np.log1p(x[up]) if lam == 0 else (np.power(x[up] + 1, lam) - 1) / lam
    out[~up] = -np.log1p(-x[~up]) if lam == 2 else -(np.power(1 - x[~up], 2 - lam) - 1) / (2 - lam)
    return out


class Total(NamedTuple):
    """Weight of some rows; number of values and sum of sign(x) log1p(|x|) by component; mean and variance of the transformed values by lambda and component."""

    rows: float
    n: np.ndarray
    log: np.ndarray
    mean: np.ndarray
    var: np.ndarray


class Moments:
    """Additive sums of the features for each key (a fold and class, say).

    For every component and lambda: the number of values, the sums of the
    transformed value and of its square around a centre of the key's own, and
    the sum of sign(x) log1p(|x|); missing values count nowhere.  Any set of
    keys can be put together, such as "all but this fold", and nothing of the
    keys left out, not even rounding, enters the result.
    """

    def __init__(self, lambdas: Sequence[float], sums: dict[tuple, tuple[float, np.ndarray, np.ndarray]]):
        self.lambdas, self.sums = list(lambdas), sums

    @classmethod
    def of(cls, df: DataFrame, keys: Sequence[str], lambdas: Sequence[float] = (1.0,)) -> Moments:
        x, n = vector_to_array(F.col(FEATURES)), len(keys)
        near = df.select(F.array(*[F.col(c).cast("double") for c in keys]).cast("array<double>").alias("k"),
                         array_to_vector(F.transform(x, lambda v: F.when(F.isnan(v), 0.0).otherwise(v))).alias("x"))
        starts = {tuple(r["k"]): r["m"].toArray() for r in near.groupBy("k").agg(Summarizer.mean(F.col("x")).alias("m")).collect()}  # a row per key
        if not starts:
            raise ValueError("no rows to fit on")
        centres = {k: np.stack([_psi(m, lam) for lam in lambdas]) for k, m in starts.items()}

        def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[tuple, list] = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                own = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(n)]) if n else np.zeros((batch.num_rows, 0))
                every = batch.column(n).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                for k in map(tuple, np.unique(own, axis=0).tolist()):
                    rows = every[(own == k).all(axis=1)]
                    there = ~np.isnan(rows)
                    rows = np.where(there, rows, starts[k])
                    log = np.where(there, np.sign(rows) * np.log1p(np.abs(rows)), 0)
                    moved = [(_psi(rows, lam) - c) * there for lam, c in zip(lambdas, centres[k], strict=True)]
                    parts = [there.sum(axis=0), log.sum(axis=0), *[p.sum(axis=0) for p in moved], *[(p ** 2).sum(axis=0) for p in moved]]
                    new = [float(len(rows)), np.concatenate(parts).astype(float)]
                    old = held.get(k)
                    held[k] = new if old is None else [old[0] + new[0], old[1] + new[1]]
            if held:
                yield pa.RecordBatch.from_arrays([pa.array([list(k) for k in held], pa.list_(pa.float64())), pa.array([v[0] for v in held.values()]),
                                                  pa.array([v[1].tolist() for v in held.values()], pa.list_(pa.float64()))], names=["k", "w", "s"])

        parts = df.select(*keys, x.alias("_x")).mapInArrow(reduce, "k array<double>, w double, s array<double>")
        found = parts.select("k", "w", array_to_vector("s").alias("s")).groupBy("k").agg(F.sum("w").alias("w"), Summarizer.sum(F.col("s")).alias("s"))
        return cls(lambdas, {tuple(r["k"]): (r["w"], r["s"].toArray(), centres[tuple(r["k"])]) for r in found.collect()})  # a row per key

    def total(self, keep: Callable[[tuple], bool] = lambda k: True) -> Total:
        """The sums of the keys that ``keep`` chooses, put together."""
        own = [self.sums[k] for k in sorted(self.sums) if keep(k)]
        m, d = own[0][2].shape
        cut = [(s[:d], s[d:2 * d], s[2 * d:(2 + m) * d].reshape(m, d), s[(2 + m) * d:].reshape(m, d), c) for _, s, c in own]
        n = sum(c[0] for c in cut)
        size = np.maximum(n, 1)
        centre = sum(c[0] * c[4] for c in cut) / size
        # each key's sums, moved from its centre to the common one
        first = sum(s + c * (at - centre) for c, _, s, _, at in cut)
        second = sum(q + 2 * (at - centre) * s + c * (at - centre) ** 2 for c, _, s, q, at in cut)
        var = second / size - (first / size) ** 2
        # a difference this small is rounding: the values are all the same
        flat = var <= 1e-24 * (centre + first / size) ** 2
        return Total(sum(w for w, _, _ in own), n, sum(c[1] for c in cut), centre + first / size, np.where(flat, 0, np.maximum(var, 0)))

    def best_lambdas(self, total: Total) -> np.ndarray:
        """H2: the position of each component's most likely lambda, the smallest on ties."""
        with np.errstate(divide="ignore"):
            llf = -total.n / 2 * np.log(total.var) + (np.array(self.lambdas)[:, None] - 1) * total.log
        return np.argmax(np.where(np.isnan(llf), -np.inf, llf), axis=0)


def data_steps(moments: Moments, total: Total, power: bool = False, normalize: bool = True) -> list[StateModel]:
    """H2 and H1 as fitted stages, from the sums of the rows they are fitted on."""
    d = total.mean.shape[1]
    at = moments.best_lambdas(total) if power else np.full(d, moments.lambdas.index(1.0))
    pick = np.arange(d)
    stages: list[StateModel] = [Powered(state=json.dumps({"lambdas": [moments.lambdas[i] for i in at]}))] if power else []
    if normalize:
        stages.append(Standardized(state=json.dumps({"mean": total.mean[at, pick].tolist(), "sd": np.sqrt(total.var[at, pick]).tolist()})))
    return stages


class _OneStep(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    power = False

    def _fit(self, df: DataFrame) -> StateModel:
        moments = Moments.of(df, [], scaling.DEFAULT_LAMBDAS if self.power else (1.0,))
        return data_steps(moments, moments.total(), self.power, not self.power)[0]


class Standardize(_OneStep):
    """H1 as an estimator on the feature vector (population deviation)."""


class PowerTransform(_OneStep):
    """H2 as an estimator on the feature vector: per component the most likely lambda of the grid."""

    power = True


class OverSampled(Estimator):
    """H3: fits another estimator on rows whose classes have been made equal (:func:`civicflow.operators.models.oversample`); predictions see the rows as they are."""

    def __init__(self, estimator: Estimator, key: str, label: str = "label", k: int = 5, seed: int = 42):
        super().__init__()
        self.estimator, self.key, self.label, self.k, self.seed = estimator, key, label, k, seed

    def _fit(self, df: DataFrame) -> Model:
        from civicflow.operators.models import oversample
        from civicflow.session import cut_lineage
        return self.estimator.fit(cut_lineage(oversample(df, self.key, self.label, self.k, self.seed)))
