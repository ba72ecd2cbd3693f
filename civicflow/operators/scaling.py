"""Feature scaling and balancing (H1-H3).

Fitting is always one aggregate pass over the data producing a handful of
numbers per column; transforms are plain column expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# Fixed value: default lambda grid for the Yeo-Johnson search.
DEFAULT_LAMBDAS = [-2.0, -1.5, -1.0, -0.5, 0.0, 0.5, 1.0, 1.5, 2.0]


class ZScore:
    """H1: (x - mean) / sd with the population sd (``ddof=0``) by default,
    as scalers usually do; ``ddof=1`` gives the sample sd.  NaN counts as
    missing; a column without spread becomes 0."""

    def __init__(self, columns: Sequence[str], ddof: int = 0, suffix: str = ""):
        self.columns, self.ddof, self.suffix = list(columns), ddof, suffix
        self.stats: dict[str, tuple[float, float]] = {}

    def fit(self, df: DataFrame) -> ZScore:
        sd = F.stddev_pop if self.ddof == 0 else F.stddev_samp
        value = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c)) for c in self.columns}
        row = df.agg(*[x for c, v in value.items() for x in (F.avg(v).alias(f"m_{c}"), sd(v).alias(f"s_{c}"))]).first()
        self.stats = {c: (row[f"m_{c}"], row[f"s_{c}"]) for c in self.columns}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        exprs = {}
        for c, (m, s) in self.stats.items():
            z = (F.col(c) - F.lit(m)) / F.lit(s) if s else F.when(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")), 0.0).otherwise(F.col(c).cast("double"))
            exprs[c + self.suffix] = z
        return df.withColumns(exprs)


def yeo_johnson(x: Column, lam: float) -> Column:
    """Yeo-Johnson transform of a column for a fixed lambda."""
    pos = (F.log1p(x) if lam == 0 else (F.pow(x + 1.0, F.lit(lam)) - 1.0) / F.lit(lam))
    neg = (-F.log1p(-x) if lam == 2 else -(F.pow(1.0 - x, F.lit(2.0 - lam)) - 1.0) / F.lit(2.0 - lam))
    return F.when(x >= 0, pos).otherwise(neg)


def yeo_johnson_of(x: Column, lam: Column) -> Column:
    """The same for a lambda that is a column."""
    pos = F.when(lam == 0, F.log1p(x)).otherwise((F.pow(x + 1.0, lam) - 1.0) / lam)
    neg = F.when(lam == 2, -F.log1p(-x)).otherwise(-(F.pow(1.0 - x, 2.0 - lam) - 1.0) / (2.0 - lam))
    return F.when(x >= 0, pos).otherwise(neg)


class YeoJohnsonGrid:
    """H2: per column, the lambda from ``lambdas`` with the largest
    Yeo-Johnson log-likelihood

        llf = -n/2 * log(var_pop(psi(x, lambda))) + (lambda - 1) * sum(sign(x) * log1p(|x|))

    (ties -> smallest lambda).  All columns x lambdas are scored in ONE
    aggregate; the choice is made on the small (column, lambda) table.
    ``refine`` more passes divide the step of the grid by five each.
    """

    def __init__(self, columns: Sequence[str], lambdas: Sequence[float] = DEFAULT_LAMBDAS, refine: int = 0):
        self.columns, self.lambdas, self.refine = list(columns), [float(v) for v in lambdas], refine
        self.table: DataFrame | None = None
        self.best: dict[str, float] = {}

    def scores(self, df: DataFrame, lambdas: dict[str, list[float]] | None = None) -> DataFrame:
        """(column_name, lambda, llf): one pass; the transforms of a value are
        one vector, of which each column has one variance."""
        lambdas = lambdas or {c: self.lambdas for c in self.columns}
        value = lambda c: F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("x"),
                                   F.array(*[F.lit(lam) for lam in lambdas[c]]).alias("lambdas"))
        rows = df.select(F.inline(F.array(*[value(c) for c in self.columns]))).where("x is not null")
        x = F.col("x")
        # a loop over an array: a CASE per lambda makes a method too long to be compiled
        transformed = array_to_vector(F.transform("lambdas", lambda lam: yeo_johnson_of(x, lam)))
        sums = rows.groupBy("column_name", "lambdas").agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.signum(x) * F.log1p(F.abs(x))).alias("s"), Summarizer.variance(transformed).alias("v"))
        n = F.col("n")
        each = sums.select("column_name", "n", "s", F.inline(F.arrays_zip(F.col("lambdas").alias("lambda"), vector_to_array("v").alias("var"))))
        llf = -n / 2.0 * F.log(F.col("var") * (n - 1) / n) + (F.col("lambda") - 1.0) * F.col("s")
        return each.select("column_name", "lambda", llf.alias("llf"))

    def fit(self, df: DataFrame) -> YeoJohnsonGrid:
        lambdas, step = {c: self.lambdas for c in self.columns}, max(self.lambdas) - min(self.lambdas)
        for _ in range(self.refine):  # a finer grid around the best point
            best = self._choose(self.scores(df, lambdas))
            step = min(step, min((b - a for x in lambdas.values() for a, b in zip(x, x[1:])), default=step))
            lambdas = {c: [best[c] + step * i / 5 for i in range(-5, 6)] for c in self.columns}
        t = self.scores(df, lambdas)
        w = Window.partitionBy("column_name").orderBy(F.desc("llf"), F.asc("lambda"))
        self.table = t.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
        self.best = self._choose(t)
        return self

    @staticmethod
    def _choose(scores: DataFrame) -> dict[str, float]:
        rows = scores.collect()  # a row per column and lambda
        return {c: min((-r["llf"], r["lambda"]) for r in rows if r["column_name"] == c)[1] for c in {r["column_name"] for r in rows}}

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: yeo_johnson(F.col(c).cast("double"), lam) for c, lam in self.best.items()})


def class_balance_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """H3 (cheap form): weight = N / (k * n_c) so every class carries the
    same total weight; used as ``weightCol`` instead of synthesising rows."""
    counts = df.groupBy(F.col(label).alias("_c")).agg(F.count(F.lit(1)).alias("_nc"))
    total, k = counts.agg(F.sum("_nc")).scalar(), counts.agg(F.count(F.lit(1))).scalar()
    w = counts.select("_c", (total / (k * F.col("_nc"))).alias(out))
    return df.join(w, df[label].eqNullSafe(w["_c"]), "left").drop("_c")
