"""Vector columns (array<float>) and unsigned 64-bit numbers, as built-in expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TWO_64 = "18446744073709551616"
TWO_63 = "9223372036854775808"


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(doubles(v), lambda x: x * x)))


def scaled(v: Column, factor: Column) -> Column:
    return F.transform(doubles(v), lambda x: x * factor)


def guarded_unit(v: Column, guard: float = 1e-8) -> Column:
    """Divided by its length; as it is at or below the guard."""
    n = norm(v)
    return F.when(n > guard, F.transform(doubles(v), lambda x: x / n)).otherwise(doubles(v))


def unit(v: Column) -> Column:
    """Divided by its length; a zero vector stays zero."""
    n = norm(v)
    return F.when(n > 0, F.transform(doubles(v), lambda x: x / n)).otherwise(doubles(v))


def u64_to_i64(c: Column) -> Column:
    """Decimal of 0 to 2**64-1 to the bigint of the same bits."""
    c = c.cast("decimal(20,0)")
    return F.when(c >= F.lit(TWO_63).cast("decimal(20,0)"), c - F.lit(TWO_64).cast("decimal(20,0)")).otherwise(c).cast("bigint")


def i64_to_u64(c: Column) -> Column:
    wide = c.cast("decimal(20,0)")
    return F.when(c < 0, wide + F.lit(TWO_64).cast("decimal(20,0)")).otherwise(wide).cast("decimal(20,0)")


def hex_to_u64(h: Column) -> Column:
    return F.conv(h, 16, 10).cast("decimal(20,0)")


@F.pandas_udf(T.ArrayType(T.FloatType()))
def through_half(v: pd.Series) -> pd.Series:
    """Values rounded to half precision, as a float16 vector file would hold them."""
    return v.map(lambda x: None if x is None else np.asarray(x, np.float32).astype(np.float16).astype(np.float32))
