"""Vector functions over array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _same(a: Column, b: Column, value: Column) -> Column:
    return F.when(F.size(a) == F.size(b), value).otherwise(F.when(a.isNotNull() & b.isNotNull(), F.raise_error(F.lit("vectors differ in dimension")).cast("double")))


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cos; 1 if a norm is zero; an error if the dimensions differ."""
    return _same(a, b, F.coalesce(1 - F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(1.0)))


def l2_distance(a: Column, b: Column) -> Column:
    return _same(a, b, F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))))


def dot_distance(a: Column, b: Column) -> Column:
    """The negative dot product."""
    return _same(a, b, -dot(a, b))


def from_json(x: Column) -> Column:
    return F.from_json(x, "array<float>")


def to_json(x: Column) -> Column:
    return F.to_json(x)


def normalize(a: Column) -> Column:
    """Unit length; the zero vector stays."""
    n = norm(a)
    return F.when(n == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / n))


def dimensions(a: Column) -> Column:
    return F.size(a)


METRICS = {"cosine": cosine_distance, "l2": l2_distance, "dot": dot_distance}

_DOT = "aggregate(zip_with(a, b, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), 0.0D, (s, x) -> s + x)"
_NORM = "sqrt(aggregate({0}, 0.0D, (s, x) -> s + CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))"
_NORMS = f"({_NORM.format('a')} * {_NORM.format('b')})"

def _checked(value: str) -> str:
    return f"CASE WHEN a IS NULL OR b IS NULL THEN NULL WHEN size(a) <> size(b) THEN CAST(raise_error('vectors differ in dimension') AS DOUBLE) ELSE {value} END"


#: The same functions for SQL text.
SQL = {
    "vec_distance_cosine(a ARRAY<FLOAT>, b ARRAY<FLOAT>)": ("DOUBLE", _checked(f"coalesce(1 - try_divide({_DOT}, {_NORMS}), 1.0D)")),
    "vec_distance_l2(a ARRAY<FLOAT>, b ARRAY<FLOAT>)": ("DOUBLE", _checked("sqrt(aggregate(zip_with(a, b, (x, y) -> pow(CAST(x AS DOUBLE) - CAST(y AS DOUBLE), 2)), 0.0D, (s, x) -> s + x))")),
    "vec_distance_dot(a ARRAY<FLOAT>, b ARRAY<FLOAT>)": ("DOUBLE", _checked(f"-({_DOT})")),
    "vec_normalize(a ARRAY<FLOAT>)": ("ARRAY<DOUBLE>", f"CASE WHEN {_NORM.format('a')} = 0 THEN transform(a, x -> CAST(x AS DOUBLE)) ELSE transform(a, x -> CAST(x AS DOUBLE) / {_NORM.format('a')}) END"),
    "vec_dimensions(a ARRAY<FLOAT>)": ("INT", "size(a)"),
    "vec_to_json(a ARRAY<FLOAT>)": ("STRING", "to_json(a)"),
    "vec_from_float32(x STRING)": ("ARRAY<FLOAT>", "from_json(x, 'array<float>')"),
}
