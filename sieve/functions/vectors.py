"""Column expressions over ``array<float|double>`` vectors.

Everything here is a built-in higher-order function, so it runs in the JVM
next to the scan. They are the SQL form of the vector operators and the
reference for small inputs; the bulk numeric paths in ``sieve.operators`` use
Arrow batches and NumPy for the matrix products.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def as_double(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def per_element(v: Column, value: Column) -> Column:
    """``value`` repeated once per element of ``v``. Pairing it with ``zip_with``
    evaluates ``value`` once per row; referencing a row-level expression inside
    a ``transform`` lambda would evaluate it again for every element."""
    return F.array_repeat(value, F.size(v))


def l2_normalise(v: Column) -> Column:
    """``x / max(||x||, 1e-12)``; a zero vector stays zero."""
    norm = F.greatest(l2_norm(v), F.lit(EPS))
    return F.zip_with(v, per_element(v, norm), lambda x, n: x.cast("double") / n)


def rotate(v: Column, k: Column | int) -> Column:
    """Cyclic left rotation by ``k`` positions (0 <= k < size)."""
    k = F.lit(k) if isinstance(k, int) else k
    n = F.size(v)
    return F.concat(F.slice(v, k + 1, n - k), F.slice(v, F.lit(1), k))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") + y.cast("double"))


def scale(v: Column, s: Column | float) -> Column:
    s = F.lit(s) if isinstance(s, (int, float)) else s
    return F.zip_with(v, per_element(v, s), lambda x, f: x.cast("double") * f)


def segment(v: Column, index: Column, parts: int) -> Column:
    """Dims ``[index*D/parts, (index+1)*D/parts)`` of ``v`` (0-based index)."""
    seg = F.floor(F.size(v) / F.lit(parts)).cast("int")
    return F.slice(v, index * seg + 1, seg)
