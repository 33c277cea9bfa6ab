"""Vector functions over ARRAY<DOUBLE>, composed of higher-order functions so that they stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession, functions as F

EPS = 1e-8


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """0 when either norm is below 1e-8."""
    na, nb = norm(a), norm(b)
    return F.when((na < EPS) | (nb < EPS), F.lit(0.0)).otherwise(dot(a, b) / (na * nb))


def euclid(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once; inside a lambda it would be computed for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalise(a: Column) -> Column:
    return let(F.greatest(norm(a), F.lit(EPS)), lambda n: F.transform(a, lambda x: x / n))


def vec_not(a: Column, dims: list[int]) -> Column:
    """Sign turned on the given dimensions only."""
    return F.transform(a, lambda x, i: F.when(i.isin(*dims), -x).otherwise(x))


def _weighted(a: Column, b: Column) -> Column:
    def mean(n: Column) -> Column:
        na, nb = n["a"], n["b"]
        return F.zip_with(a, b, lambda x, y: F.when(na + nb < EPS, (x + y) / 2).otherwise((na * x + nb * y) / (na + nb)))

    return let(F.struct(norm(a).alias("a"), norm(b).alias("b")), mean)


def vec_and(a: Column, b: Column, method: str = "average") -> Column:
    """``average``, norm-``weighted`` mean, or ``min``: the value of smaller magnitude (ties take b)."""
    if method == "average":
        return F.zip_with(a, b, lambda x, y: (x + y) / 2)
    if method == "weighted":
        return _weighted(a, b)
    if method == "min":
        return F.zip_with(a, b, lambda x, y: F.when(F.abs(x) < F.abs(y), x).otherwise(y))
    raise ValueError(method)


def vec_or(a: Column, b: Column, method: str = "max") -> Column:
    """``max``: the value of larger magnitude (ties take b), ``average`` or norm-``weighted`` mean."""
    if method == "max":
        return F.zip_with(a, b, lambda x, y: F.when(F.abs(x) > F.abs(y), x).otherwise(y))
    if method == "average":
        return F.zip_with(a, b, lambda x, y: (x + y) / 2)
    if method == "weighted":
        return _weighted(a, b)
    raise ValueError(method)


# Weight of the child's vector by edge type.
ADDED = {"SUBJECT": 0.5, "OBJECT": 0.5, "MODIFICATION": 0.3, "PREPOSITION": 0.4, "SUBORDINATION": 0.6}


def compose(parent: Column, child: Column, edge: Column) -> Column:
    """Parent's vector after taking in a child over an edge of the given type."""
    mean = F.aggregate(child, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(child), F.lit(1))
    weight = F.lit(0.5)
    for name, w in ADDED.items():
        weight = F.when(edge == name, F.lit(w)).otherwise(weight)
    return (
        F.when(edge == "DESCRIPTION", F.zip_with(parent, child, lambda p, c: p * c))
        .when(edge == "SPECIFICATION", let(mean, lambda m: F.transform(parent, lambda p: p * (1 + 0.2 * m))))
        .when(edge == "COORDINATION", F.zip_with(parent, child, lambda p, c: (p + c) / 2))
        .otherwise(F.zip_with(parent, child, lambda p, c: p + weight * c))
    )


def rounded(a: Column, digits: int = 6) -> Column:
    """Rounded elements without negative zero."""
    return F.transform(a, lambda x: F.round(x, digits) + F.lit(0.0))


def register(spark: SparkSession) -> None:
    """SQL functions ``vec_dot``, ``vec_cos``, ``vec_not``, ``vec_and`` and ``vec_or``, as plain SQL bodies."""
    d = "ARRAY<DOUBLE>"
    total = "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"
    square = "aggregate({0}, 0D, (s, x) -> s + x * x)"
    na, nb = f"sqrt({square.format('a')})", f"sqrt({square.format('b')})"
    bodies = {
        f"vec_dot(a {d}, b {d}) RETURNS DOUBLE": total,
        f"vec_cos(a {d}, b {d}) RETURNS DOUBLE": f"CASE WHEN {na} < 1e-8 OR {nb} < 1e-8 THEN 0D ELSE {total} / ({na} * {nb}) END",
        f"vec_not(a {d}, dims ARRAY<INT>) RETURNS {d}": "transform(a, (x, i) -> if(array_contains(dims, i), -x, x))",
        f"vec_and(a {d}, b {d}) RETURNS {d}": "zip_with(a, b, (x, y) -> (x + y) / 2)",
        f"vec_or(a {d}, b {d}) RETURNS {d}": "zip_with(a, b, (x, y) -> if(abs(x) > abs(y), x, y))",
    }
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
