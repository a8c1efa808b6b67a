"""Forecast and budget jobs over all tenants."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import budgets, forecast
from ..operators.filters import in_year, select_for_forecast
from ..session import cut_lineage


def detailed_forecast(
    costs: DataFrame, as_of: str, periods: int = 30, granularity: str = "daily",
    model: str = "linear", top: int = 5, filters: dict | None = None,
) -> dict[str, DataFrame]:
    """Forecast of every tenant's total and top services as one grouped job.

    Returns points, history, per-service outlook and executive summary.
    """
    picked = select_for_forecast(costs, **(filters or {}))
    # five outputs share the points and the fits: read the costs and fit once
    points = cut_lineage(forecast.resample(forecast.forecast_series(picked, top), granularity, as_of))
    predictions = cut_lineage(forecast.forecast(points, periods, granularity, model))
    growth = forecast.series_growth(predictions, points)
    summary = forecast.executive_summary(growth, granularity)
    return {
        "forecast": forecast.forecast_output(predictions),
        "history": forecast.history_output(points),
        "services": forecast.service_outlook(growth),
        "summary": summary,
        "cards": forecast.card_values(summary),
    }


def track_budgets(requests: DataFrame, costs: DataFrame, as_of: str, model: str | None = "linear") -> DataFrame:
    """Status of every valid budget; ``model=None`` leaves the projection at 0."""
    tracked = budgets.with_period(budgets.valid_budgets(requests), as_of)
    if model is None:  # without a forecast only the running year matters
        costs = in_year(costs, as_of)
    daily = budgets.scope_daily(costs)
    if model is not None:
        daily = cut_lineage(daily)  # spend and forecast both read it: scan the costs once
    spent = budgets.budget_spend(tracked, daily, as_of)
    if model is not None:
        spent = budgets.budget_projection(spent, daily, as_of, model)
    return budgets.budget_status(spent)
