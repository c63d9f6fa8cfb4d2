"""Numeric column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def lenient_double(col: Column | str) -> Column:
    """Cast to double; what is no number (or is NaN) becomes NULL."""
    value = (F.col(col) if isinstance(col, str) else col).try_cast("double")
    return F.when(~F.isnan(value), value)


def half_even(col: Column, digits: int) -> Column:
    """Round half to even at `digits` decimals."""
    scale = F.lit(float(10**digits))
    return F.rint(col * scale) / scale


def clip01(col: Column, default: float = 0.0) -> Column:
    """Clip to [0, 1]; NULL becomes `default` before clipping, since greatest() skips NULLs."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(col, F.lit(default))))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often `body` uses it.

    Catalyst merges projections and would copy an expression into every use; a lambda variable it
    does not.
    """
    return F.transform(F.array(value), lambda v: body(v))[0]


def divide(num: Column, den: Column) -> Column:
    """num / den, NULL where den is 0."""
    return num / F.when(den != 0, den)


def hash52(*cols: Column) -> Column:
    """A 52-bit integer from the md5 of the text of `cols`: exact in a double, equal in other SQL engines."""
    text = F.concat_ws("|", *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


# Coefficients of the published rational approximation AS 241 (PPND16), by region,
# lowest power first.
PPF_CENTRE_NUM = (
    3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
    4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3,
)
PPF_CENTRE_DEN = (
    1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
    2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3,
)
PPF_MIDDLE_NUM = (
    1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
    1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4,
)
PPF_MIDDLE_DEN = (
    1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
    1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9,
)
PPF_TAIL_NUM = (
    6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1,
    2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7,
)
PPF_TAIL_DEN = (
    1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
    7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15,
)


def polynomial(x: Column, coefficients: tuple[float, ...]) -> Column:
    """Horner form of a polynomial given lowest power first."""
    return reduce(lambda acc, c: acc * x + F.lit(c), reversed(coefficients[:-1]), F.lit(coefficients[-1]))


def normal_quantile(p: Column) -> Column:
    """Inverse of the standard normal distribution function for p in (0, 1).

    Bound, since each polynomial uses its argument many times: written out, a few of these behind a join make one generated
    method of tens of kilobytes, and the JVM compiles none above 8 KB.
    """

    def outer(r: Column) -> Column:
        middle = bind(r - F.lit(1.6), lambda x: polynomial(x, PPF_MIDDLE_NUM) / polynomial(x, PPF_MIDDLE_DEN))
        tail = bind(r - F.lit(5.0), lambda x: polynomial(x, PPF_TAIL_NUM) / polynomial(x, PPF_TAIL_DEN))
        return F.when(r <= 5.0, middle).otherwise(tail)

    def value(p: Column) -> Column:
        q = p - F.lit(0.5)
        centre = bind(
            F.lit(0.180625) - q * q, lambda r: q * polynomial(r, PPF_CENTRE_NUM) / polynomial(r, PPF_CENTRE_DEN)
        )
        away = bind(F.sqrt(-F.ln(F.when(q < 0, p).otherwise(F.lit(1.0) - p))), outer)
        return F.when(F.abs(q) <= 0.425, centre).otherwise(F.when(q < 0, -away).otherwise(away))

    return bind(p, value)
