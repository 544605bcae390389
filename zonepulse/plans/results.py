"""Query result envelope: the lazy rows plus a small metadata dict.

Mirrors the shape callers of the source application receive (intent,
result type, title, metric, rows, metadata) without collecting: ``rows``
stays a DataFrame and ``row_count`` runs a count only when asked.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from zonepulse.model import DEFAULT_DISPLAY, METRIC_DISPLAY
from zonepulse.plans import queries as Q

# Result titles per intent.
TITLES = {
    "aggregation": "{metric} by {group_by}",
    "top_n_ranking": "Top {n} {group_by} by {metric}",
    "group_comparison": "Comparison of {metric} by {group_by}",
    "trend_analysis": "{metric} trend over last {last_n_weeks} weeks",
    "multivariable_filter": "Multivariable filter matches",
    "growth_analysis": "Top {top_k} zones by Orders growth",
}
# Display format and decimals of the growth columns.
GROWTH_DISPLAY = {
    "current_value": ("integer", 0),
    "baseline_value": ("integer", 0),
    "absolute_growth": ("integer", 0),
    "growth_rate": ("percentage_ratio", 2),
}
RESULT_TYPES = {"trend_analysis": "timeseries"}


def display_config(metric: str) -> dict:
    fmt, decimals = METRIC_DISPLAY.get(str(metric or "").strip(), DEFAULT_DISPLAY)
    return {"value_format": fmt, "decimals": decimals}


@dataclass
class QueryResult:
    intent: str
    title: str
    metric: str
    rows: DataFrame
    metadata: dict = field(default_factory=dict)

    @property
    def result_type(self) -> str:
        return RESULT_TYPES.get(self.intent, "table")

    def row_count(self) -> int:
        return self.rows.count()


def run_query(intent: str, metrics_df: DataFrame, orders_df: DataFrame, **params) -> QueryResult:
    """Dispatch one of the six intents with keyword parameters."""
    intent = intent.strip().lower()
    metric = params.get("metric", "Orders" if intent == "growth_analysis" else "MULTI_CONDITION")
    meta = {k: v for k, v in params.items() if k not in ("metric", "conditions")}
    if intent == "aggregation":
        group_by, filters = Q.resolve_group_by(params["group_by"], params.get("filters"), "drill_down")
        rows = Q.aggregation(metrics_df, orders_df, metric, group_by, params.get("aggregation", "mean"),
                             filters, params.get("week", 0))
        meta.update(group_by=group_by, filters=filters)
    elif intent == "top_n_ranking":
        rows = Q.top_n(metrics_df, orders_df, metric, params.get("group_by", "zone"), params.get("n", 5),
                       params.get("order", "desc"), params.get("filters"), params.get("week", 0))
        meta.setdefault("group_by", params.get("group_by", "zone"))
        meta.setdefault("n", params.get("n", 5))
    elif intent == "group_comparison":
        group_by, filters = Q.resolve_group_by(params["group_by"], params.get("filters"), "clear")
        rows = Q.group_comparison(metrics_df, orders_df, metric, group_by, params.get("aggregation", "mean"),
                                  filters, params.get("week", 0))
        meta.update(group_by=group_by, filters=filters)
    elif intent == "trend_analysis":
        rows = Q.trend(metrics_df, orders_df, metric, params["last_n_weeks"], params.get("aggregation", "mean"),
                       params.get("filters"))
    elif intent == "multivariable_filter":
        rows = Q.multivariable_filter(metrics_df, orders_df, params["conditions"], params.get("logical_operator", "and"),
                                      params.get("filters"), params.get("week", 0))
        meta["conditions"] = [c[0] if not isinstance(c, dict) else c["metric"] for c in params["conditions"]]
    elif intent == "growth_analysis":
        oldest = Q.growth_window(metrics_df, orders_df, params["last_n_weeks"], params.get("filters")).selectExpr("max(week)").first()[0]
        meta["baseline_week"], meta["column_display"] = oldest, dict(GROWTH_DISPLAY)
        rows = Q.growth(metrics_df, orders_df, params["last_n_weeks"], params.get("top_k", 5), params.get("filters"),
                        params.get("include_driver_analysis", False))
        meta.setdefault("top_k", params.get("top_k", 5))
    else:
        raise ValueError(f"Unsupported intent '{intent}'.")
    meta["display"] = display_config(metric)
    fields = {"metric": metric, **meta}
    title = TITLES[intent].format(**{k: fields.get(k, "") for k in ("metric", "group_by", "n", "last_n_weeks", "top_k")})
    return QueryResult(intent, title, metric, rows, meta)
