"""DuckDB twin of the linear forecast: the same sums and the same elimination, spelled out."""

from __future__ import annotations

SIZE = 6
TOLERANCE = "1e-11"
_PAIRS = [(i, j) for i in range(SIZE) for j in range(i, SIZE)]
_NAMES = ["t", "t2", "sin1", "cos1", "sin2", "cos2"]


def _features(period: float) -> str:
    return ", ".join([
        "t", "t * t AS t2", *[f"{wave}({k} * pi() * t / {period}) AS {wave}{k // 2}" for k in (2, 4) for wave in ("sin", "cos")]])


def _fit(keys: str) -> str:
    """Common table expressions from ``x`` (keys, date, y and the terms) to ``fits``."""
    away = lambda at, i: f"(first[{at + 1}].x{i} - c{i})"
    sums = ", ".join([
        *[f"avg({n}) AS c{i}" for i, n in enumerate(_NAMES)], *[f"sum({_NAMES[i]} * {_NAMES[j]}) AS s_{i}_{j}" for i, j in _PAIRS],
        *[f"sum({n} * y) AS r_{i}" for i, n in enumerate(_NAMES)]])
    cells = []
    for i, j in _PAIRS:
        unit = "1" if i == j else "0"
        points = " + ".join(f"{away(i, k)} * {away(j, k)}" for k in range(SIZE))
        cells.append(f"CASE WHEN n > {SIZE} THEN coalesce((s_{i}_{j} - n * c{i} * c{j}) / (l_{i} * l_{j}), {unit}) WHEN {j} < n THEN {points} + 1::DOUBLE / n ELSE {unit} END AS a_{i}_{j}")
    for i in range(SIZE):
        cells.append(f"CASE WHEN n > {SIZE} THEN coalesce((r_{i} - n * c{i} * level) / l_{i}, 0) WHEN {i} < n THEN first[{i + 1}].y - level ELSE 0 END AS b_{i}")
    kept = f"{keys}, n, level, first, " + ", ".join([f"c{i}" for i in range(SIZE)] + [f"l_{i}" for i in range(SIZE)])
    parts = [
        f"""moments AS (SELECT {keys}, count(*) AS n, avg(y) AS level, {sums},
    list({{{', '.join([f"'x{i}': {n}" for i, n in enumerate(_NAMES)] + ["'y': y"])}}} ORDER BY date)[1:{SIZE}] AS first FROM x GROUP BY {keys} HAVING count(*) >= 2)""",
        "lengths AS (SELECT *, " + ", ".join(
            f"CASE WHEN greatest(0, s_{i}_{i} - n * c{i} * c{i}) > {TOLERANCE} * s_{i}_{i} THEN sqrt(greatest(0, s_{i}_{i} - n * c{i} * c{i})) END AS l_{i}" for i in range(SIZE)) + " FROM moments)",
        f"cells AS (SELECT {kept}, {', '.join(cells)} FROM lengths)",
        "e0 AS (SELECT *, greatest(" + ", ".join(f"abs(a_{i}_{i})" for i in range(SIZE)) + f") * {TOLERANCE} AS least FROM cells)"]
    for k in range(SIZE - 1):
        factor = {i: f"(CASE WHEN a_{k}_{k} > least THEN a_{k}_{i} / a_{k}_{k} ELSE 0 END)" for i in range(k + 1, SIZE)}
        parts.append(f"e{k + 1} AS (SELECT {kept}, least, " + ", ".join(
            [f"a_{i}_{j}" if i <= k else f"a_{i}_{j} - {factor[i]} * a_{k}_{j} AS a_{i}_{j}" for i, j in _PAIRS]
            + [f"b_{i}" if i <= k else f"b_{i} - {factor[i]} * b_{k} AS b_{i}" for i in range(SIZE)]) + f" FROM e{k})")
    last = f"e{SIZE - 1}"
    for k in reversed(range(SIZE)):
        rest = " - ".join([f"b_{k}"] + [f"a_{k}_{j} * z{j}" for j in range(k + 1, SIZE)])
        parts.append(f"y{k} AS (SELECT *, CASE WHEN a_{k}_{k} > least THEN ({rest}) / a_{k}_{k} ELSE 0 END AS z{k} FROM {last})")
        last = f"y{k}"
    weights = []
    for k in range(SIZE):
        points = " + ".join(f"(CASE WHEN {i} < n THEN z{i} * {away(i, k)} ELSE 0 END)" for i in range(SIZE))
        weights.append(f"CASE WHEN n > {SIZE} THEN coalesce(z{k} / l_{k}, 0) ELSE {points} END AS w{k}")
    parts.append(f"fits AS (SELECT {keys}, n, level, {', '.join(f'c{i}' for i in range(SIZE))}, {', '.join(weights)} FROM y0)")
    return ",\n".join(parts)


MONTH_ENDS = "last_day(CAST(date_trunc('month', z + 1) AS DATE) + to_months(CAST(step - 1 AS INTEGER)))"


def linear_forecast_sql(keys: str, period: float, periods: int, step: int | str = 1, start_after: str | None = None) -> str:
    """Common table expressions from ``points`` (keys, date, cost) to ``predictions``; ``step`` is a number of days or the date after ``z``."""
    ahead = step if isinstance(step, str) else f"z + CAST(step * {step} AS INTEGER)"
    value = " + ".join(["level"] + [f"({n} - c{i}) * w{i}" for i, n in enumerate(_NAMES)])
    last = "max(date)" if start_after is None else f"greatest(max(date), DATE '{start_after}')"
    return f"""quartiles AS (SELECT {keys}, quantile_cont(cost, 0.25) AS q1, quantile_cont(cost, 0.75) AS q3, count(*) AS size FROM points GROUP BY {keys}),
timed AS (SELECT {keys}, date, CASE WHEN size >= 10 THEN greatest(least(cost, q3 + (q3 - q1) * 1.5), q1 - (q3 - q1) * 1.5) ELSE cost END AS y,
    CAST(date - min(date) OVER (PARTITION BY {keys}) AS DOUBLE) AS t FROM points JOIN quartiles USING ({keys})),
x AS (SELECT {keys}, date, y, {_features(period)} FROM timed),
{_fit(keys)},
residuals AS (SELECT {keys}, y, y - ({value}) AS e FROM x JOIN fits USING ({keys})),
quality AS (SELECT {keys}, CASE WHEN count(*) > 2 THEN stddev_pop(e) ELSE 0 END AS spread,
    coalesce(avg(CASE WHEN abs(y) > 1e-6 THEN abs(e / y) END), 1) * 100 AS error FROM residuals GROUP BY {keys}),
ends AS (SELECT {keys}, {last} AS z, min(date) AS series_start FROM points GROUP BY {keys}),
ahead AS (SELECT {keys}, step, {ahead} AS date, CAST({ahead} - series_start AS DOUBLE) AS t
    FROM ends, (SELECT unnest(range(1, {periods + 1})) AS step)),
centres AS (SELECT {keys}, step, date, n, spread, error, greatest(0, {value}) AS p
    FROM (SELECT {keys}, step, date, {_features(period)} FROM ahead) JOIN fits USING ({keys}) JOIN quality USING ({keys})),
predictions AS (SELECT {keys}, step, date, p AS prediction, greatest(0, p - 1.64 * spread * sqrt(1 + step / n)) AS lower, p + 1.64 * spread * sqrt(1 + step / n) AS upper,
    least(100, greatest(0, 100 - error)) AS confidence FROM centres)"""
