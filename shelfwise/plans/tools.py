"""Named tools over the tables of a retail store, and the tables of its dashboard."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.fixed import DEFAULT_FORECAST
from shelfwise.operators import anomalies, forecasting, retrieval
from shelfwise.plans import analytics as a


@dataclass(frozen=True)
class Store:
    """What the tools work on; model, codes, metrics and index are optional."""

    sales: DataFrame
    model: RandomForestRegressionModel | None = None
    codes: DataFrame | None = None
    metrics: DataFrame | None = None
    index: retrieval.Index | None = None


def _anomaly_summary(
    store: Store, outlier_fraction: float = 0.05, spike_multiplier: float = 2.0, max_results: int = 5
) -> DataFrame:
    found = anomalies.detect_anomalies(store.sales, outlier_fraction, spike_multiplier)
    return anomalies.top_anomalies(found, max_results)


def _demand_forecast(store: Store, **request) -> DataFrame:
    if store.model is None or store.codes is None:
        raise LookupError("Model not trained yet.")
    row = store.sales.sparkSession.createDataFrame([{**DEFAULT_FORECAST, **request}])
    typed = row.withColumns(
        {
            "target_date": F.col("target_date").cast("date"),
            "price": F.col("price").cast("double"),
            "discount": F.col("discount").cast("double"),
        }
    )
    return forecasting.predict_demand(typed, store.codes, store.model)


def _search_policy(store: Store, query: str = "retail policy", top_k: int = 3) -> DataFrame:
    if store.index is None:
        raise LookupError(retrieval.NO_DOCUMENTS)
    asked = store.sales.sparkSession.createDataFrame([(0, query)], "query_id int, text string")
    return retrieval.retrieve_answers(asked, store.index, top_k)


def _model_info(store: Store) -> DataFrame:
    if store.metrics is None:
        raise LookupError("Model not trained yet.")
    return store.metrics.withColumn("model_name", F.lit(forecasting.MODEL_NAME))


@dataclass(frozen=True)
class Tool:
    description: str
    run: Callable[..., DataFrame]
    parameters: tuple[str, ...] = ()


TOOLS: dict[str, Tool] = {
    "get_sales_overview": Tool("Totals, products, stores and date range.", lambda s: a.overview_text(s.sales)),
    "get_top_products": Tool(
        "Products with the highest revenue.", lambda s, top_n=5: a.ranked_top_n(s.sales, int(top_n)), ("top_n",)
    ),
    "get_category_breakdown": Tool("Revenue per category.", lambda s: a.breakdown_lines(s.sales, "category")),
    "get_region_breakdown": Tool("Revenue per region.", lambda s: a.breakdown_lines(s.sales, "region")),
    "get_monthly_trend": Tool("Revenue per month.", lambda s: a.monthly_trend_short(s.sales)),
    "get_product_detail": Tool(
        "Figures of one product.", lambda s, product_id="": a.product_text(s.sales, product_id), ("product_id",)
    ),
    "get_anomaly_summary": Tool(
        "The strongest sales anomalies.", _anomaly_summary, ("outlier_fraction", "spike_multiplier", "max_results")
    ),
    "get_demand_forecast": Tool("Predicted units of one product on one day.", _demand_forecast, tuple(DEFAULT_FORECAST)),
    "search_policy": Tool("Policy passages for a question.", _search_policy, ("query", "top_k")),
    "get_model_info": Tool("The demand model and its metrics.", _model_info),
}


def run_tool(name: str, store: Store, **params) -> DataFrame:
    if name not in TOOLS:
        raise KeyError(f"Unknown tool: {name}")
    return TOOLS[name].run(store, **params)


def dashboard(store: Store, top_n: int = 10) -> dict[str, DataFrame]:
    """Dashboard tables: key figures, model record, anomaly counts and top anomalies, revenue trends."""
    found = anomalies.detect_anomalies(store.sales)
    tables = {
        "key_metrics": a.key_metrics(store.sales),
        "anomaly_counts": anomalies.anomaly_counts(found),
        "top_anomalies": anomalies.top_anomalies(found, top_n),
        "revenue_trends": a.dashboard_trends(store.sales),
    }
    return tables if store.metrics is None else {**tables, "model_outputs": _model_info(store)}
