"""Anchor dimensions: the named dimensions 0–50 of a vector, and the geometry of an axis's poles."""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Names of the anchor dimensions in order.
SEMANTIC = """determinatory personal living permanence embodiment magnitude
temporal frequency location manner extent reason attitude relative direction spacialExtent beneficiary
fundamental subject subjectComp objects results instruments sources goals experiencer nominal""".split()
GRAMMATICAL = """tense aspect mood voice person number gender case definiteness polarity animacy countability degree transitivity evidentiality""".split()
LOGICAL = "AND OR XOR NAND IF XIF NOT NOR XNOR".split()
ANCHORS = [*((n, "semantic") for n in SEMANTIC), *((n, "grammatical") for n in GRAMMATICAL), *((n, "logical") for n in LOGICAL)]
INDEX = {name: i for i, (name, _) in enumerate(ANCHORS)}
# Anchor dimension and value of a subtype.
SUBTYPE_VALUES = {
    "SINGULAR": ("number", 0.0), "PLURAL": ("number", 1.0), "MASCULINE": ("gender", -0.5), "FEMININE": ("gender", 0.5),
    "FIRST_PERSON": ("person", -1.0), "SECOND_PERSON": ("person", 0.0), "THIRD_PERSON": ("person", 1.0),
}


def table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, n, k) for i, (n, k) in enumerate(ANCHORS)], "idx int, name string, type string")


def vector(pos: Column, subtypes: Column, dims: int = len(ANCHORS)) -> Column:
    """Anchor vector of a word by its tag and subtypes; the learned dimensions stay zero."""
    value = F.lit(0.0)
    cells: dict[int, list[tuple[Column, float]]] = {}
    cells.setdefault(INDEX["determinatory"], []).append((pos == "DET", 1.0))
    cells.setdefault(INDEX["nominal"], []).append((pos.isin("NOUN", "PRON"), 1.0))
    for name, (anchor, x) in SUBTYPE_VALUES.items():
        cells.setdefault(INDEX[anchor], []).append((F.array_contains(subtypes, name), x))

    def cell(i: Column) -> Column:
        out = value
        for at, options in cells.items():
            for cond, x in options:
                out = F.when((i == at) & cond, F.lit(x)).otherwise(out)
        return out

    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), cell)


def simplex(n: int) -> list[list[float]]:
    """Unit vectors of ``n`` poles in n − 1 dimensions, all at the same distance; one pole is the point [1].

    The classic closed form: coordinate i of vertex i follows from the vertices before, later
    vertices share −x/(n − 1 − i) there.
    """
    if n < 1:
        raise ValueError("an axis has at least one pole")
    if n == 1:
        return [[1.0]]
    out = [[0.0] * (n - 1) for _ in range(n)]
    for i in range(n - 1):
        x = sqrt(1 - sum(v * v for v in out[i][:i]))
        out[i][i] = x
        for j in range(i + 1, n):
            out[j][i] = -x / (n - 1 - i)
    return out


def pole_geometry(names: list[str]) -> list[tuple[str, list[float]]]:
    return list(zip(names, simplex(len(names))))
