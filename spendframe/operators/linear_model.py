"""Least squares of many series at once, from grouped sums.

Every series' sums of products are one row, so a fit costs one aggregation and a small
elimination on arrays, whatever the number of points. Columns are centred and scaled to
unit length, which keeps the system well conditioned. A series of at most as many points as
terms has many solutions; its smallest one comes from the system of its points instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.parsing import computed_once

TOLERANCE = 1e-11  # a pivot below this share of the largest one belongs to a term that the ones before explain


def _dot(left: Column, right: Column) -> Column:
    return F.aggregate(F.zip_with(left, right, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)


def solve(matrix: Column, least: Column, size: int) -> Column:
    """Solution of a symmetric system as an array; ``matrix`` has the right side as its last column.

    Plain elimination; a term whose pivot is not above ``least`` gets 0.
    """
    at = lambda m, i, j: F.get(F.get(m, i), j)

    def eliminate(m: Column, k: Column) -> Column:
        def row_after(row: Column, i: Column) -> Column:
            factor = F.when(at(m, k, k) > least, F.get(row, k) / at(m, k, k)).otherwise(0.0)
            return F.when(i > k, F.transform(row, lambda x, j: x - factor * at(m, k, j))).otherwise(row)

        return F.transform(m, row_after)

    def resolve(m: Column) -> Column:
        def next_term(found: Column, k: Column) -> Column:
            rest = at(m, k, F.lit(size)) - _dot(F.slice(F.get(m, k), k + 2, F.size(found)), found)
            return F.concat(F.array(F.when(at(m, k, k) > least, rest / at(m, k, k)).otherwise(0.0)), found)

        return F.aggregate(F.sequence(F.lit(size - 1), F.lit(0), F.lit(-1)), F.array().cast("array<double>"), next_term)

    steps = F.sequence(F.lit(0), F.lit(size - 2)) if size > 1 else F.array().cast("array<int>")
    return F.get(F.transform(F.array(F.aggregate(steps, matrix, eliminate)), resolve), 0)


def fit(points: DataFrame, keys: list[str], terms: list[str], target: str, order: str) -> DataFrame:
    """One row per series: ``points``, ``level`` and the arrays ``centre`` and ``weight`` of all terms."""
    size = len(terms)
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    first = F.when(F.col("place") <= size, F.struct("place", F.array(*terms).alias("x"), F.col(target).alias("y")))
    sums = points.select(*keys, *terms, target, place.alias("place")).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("points"), F.avg(target).alias("level"),
        F.array(*[F.avg(term) for term in terms]).alias("centre"),
        *[F.sum(F.col(terms[i]) * F.col(terms[j])).alias(f"s_{i}_{j}") for i, j in pairs],
        F.array(*[F.sum(F.col(term) * F.col(target)) for term in terms]).alias("products"),
        F.array_sort(F.collect_list(first)).alias("first"))  # at most ``size`` of them
    n, centre = F.col("points"), F.col("centre")
    square = F.array(*[F.array(*[F.col(f"s_{min(i, j)}_{max(i, j)}") for j in range(size)]) for i in range(size)])
    spread = lambda i: F.get(F.get("square", i), i) - n * F.get(centre, i) * F.get(centre, i)
    places = F.sequence(F.lit(0), F.lit(size - 1))
    # a term without spread beyond its own rounding is a constant
    length = F.transform(places, lambda i: F.when(spread(i) > TOLERANCE * F.get(F.get("square", i), i), F.sqrt(spread(i))))
    away = F.transform("first", lambda p: F.zip_with(p["x"], centre, lambda x, c: x - c))
    rows = computed_once(sums.select(*keys, "points", "level", "centre", "products", "first", square.alias("square")), {"length": length, "away": away})
    unit = lambda i, j: F.when(i == j, 1.0).otherwise(0.0)

    def by_terms(i: Column, j: Column) -> Column:
        # the column behind the last term is the right side
        scaled = (F.get(F.get("square", i), j) - n * F.get(centre, i) * F.get(centre, j)) / (F.get("length", i) * F.get("length", j))
        right = (F.get("products", i) - n * F.get(centre, i) * F.col("level")) / F.get("length", i)
        return F.when(j < size, F.coalesce(scaled, unit(i, j))).otherwise(F.coalesce(right, F.lit(0.0)))

    def by_points(i: Column, j: Column) -> Column:
        # inner products, and the constant that centring took away; unused places hold the identity
        inner = F.when((i < n) & (j < n), _dot(F.get("away", i), F.get("away", j)) + 1.0 / n).otherwise(unit(i, j))
        right = F.when(i < n, F.get("first", i)["y"] - F.col("level")).otherwise(0.0)
        return F.when(j < size, inner).otherwise(right)

    width = F.sequence(F.lit(0), F.lit(size))
    system = lambda cell: F.transform(places, lambda i: F.transform(width, lambda j: cell(i, j)))
    short = n <= size
    built = computed_once(rows, {"system": F.when(short, system(by_points)).otherwise(system(by_terms))})
    largest = F.array_max(F.transform("system", lambda row, i: F.abs(F.get(row, i))))
    solved = computed_once(computed_once(built, {"least": largest * TOLERANCE}), {"z": solve(F.col("system"), F.col("least"), size)})
    from_points = F.transform(places, lambda k: F.aggregate(
        F.sequence(F.lit(0), F.size("first") - 1), F.lit(0.0), lambda total, i: total + F.get("z", i) * F.get(F.get("away", i), k)))
    from_terms = F.transform(places, lambda k: F.coalesce(F.get("z", k) / F.get("length", k), F.lit(0.0)))
    return solved.select(*keys, "points", "level", "centre", F.when(short, from_points).otherwise(from_terms).alias("weight"))


def predicted(terms: list[str]) -> Column:
    """Value of a fitted row at the given terms."""
    value = F.col("level")
    for i, term in enumerate(terms):
        value = value + (F.col(term) - F.get("centre", F.lit(i))) * F.get("weight", F.lit(i))
    return value
