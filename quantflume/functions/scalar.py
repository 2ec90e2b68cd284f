"""Scalar column expressions: cleaning, clipping, labels and special functions. All run inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require(df: DataFrame, *names: str) -> DataFrame:
    """``df``, or ValueError naming the columns it lacks."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def number(col) -> Column:
    """A double, null where the value isn't a number (text is tried, never an error)."""
    return F.expr(f"try_cast({col} as double)") if isinstance(col, str) else col.try_cast("double")


def finite(col) -> Column:
    """Null for NaN and the infinities: missing values are always null here."""
    col = F.col(col) if isinstance(col, str) else col
    return F.when(~F.isnan(col) & (F.abs(col) < float("inf")), col)


def clip(col: Column, low: float | Column, high: float | Column) -> Column:
    """Within [low, high]; null stays null."""
    bound = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.when(col.isNotNull(), F.least(F.greatest(col, bound(low)), bound(high)))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a, b)


def signed_log(col: Column) -> Column:
    """sign(x) * log(1 + |x|)."""
    return F.signum(col) * F.log1p(F.abs(col))


def logistic(col: Column) -> Column:
    """1 / (1 + exp(-x)), with x held within 60."""
    return 1.0 / (1.0 + F.exp(-clip(col, -60.0, 60.0)))


def log_component(col: Column, most: float = 50.0) -> Column:
    """log(1 + max(x, 0)), ``most`` at most; null stays null."""
    return F.when(col.isNotNull(), F.least(F.log1p(F.greatest(col, F.lit(0.0))), F.lit(most)))


def atanh_clipped(col: Column, most: float = 0.999) -> Column:
    return F.atanh(clip(col, -most, most))


def valid_flag(*cols) -> Column:
    """1 if all columns are there, else 0."""
    return reduce(lambda a, b: a & b, [(F.col(c) if isinstance(c, str) else c).isNotNull() for c in cols]).cast("int")


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it doesn't or is null."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def epoch_ms(col: Column) -> Column:
    """Milliseconds from an epoch number in seconds, milliseconds, microseconds or nanoseconds, told apart by magnitude."""
    size = F.abs(col)
    return F.when(size >= 10**17, F.floor(col / 10**6)).when(size >= 10**14, F.floor(col / 10**3)).when(size >= 10**11, col).otherwise(col * 1000).cast("long")


def label_by_cuts(score: Column, cuts: list[Column], names: list[str], undefined: str) -> Column:
    """``names[k]`` for the first cut that the score lies under, else the last; ``undefined`` for null."""
    out = F.when(score.isNull(), undefined)
    for cut, name in zip(cuts, names, strict=False):
        out = out.when(score < cut, name)
    return out.otherwise(names[-1])


def direction(score: Column) -> Column:
    """LONG, SHORT or NEUTRAL by sign."""
    return F.when(score > 0, "LONG").when(score < 0, "SHORT").otherwise("NEUTRAL")


# Wichura's AS 241 (PPND16) coefficients for the normal quantile, constant term first.
_A = (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3)
_B = (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3)
_C = (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4)
_D = (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9)
_E = (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7)
_F = (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15)


def _polynomial(x: Column, coefficients) -> Column:
    out = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = out * x + c
    return out


def normal_quantile(p: Column) -> Column:
    """The standard normal's quantile of p in (0, 1) to about 16 digits (null outside)."""
    q = p - 0.5
    near = 0.180625 - q * q
    tail = F.sqrt(-F.log(F.least(p, 1 - p)))
    middle = q * _polynomial(near, _A) / _polynomial(near, _B)
    r, s = tail - 1.6, tail - 5.0
    outer = F.when(tail <= 5, _polynomial(r, _C) / _polynomial(r, _D)).otherwise(_polynomial(s, _E) / _polynomial(s, _F))
    return F.when((p > 0) & (p < 1), F.when(F.abs(q) <= 0.425, middle).otherwise(F.signum(q) * outer))
