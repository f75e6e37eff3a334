"""DataFrame operators: growth, views, insights, reshape, catalog."""

from cadence.operators.catalog import entity_catalog, preview, year_bounds
from cadence.operators.growth import (
    aggregate_annual,
    aggregate_quarterly,
    has_columns,
    mask_first_period,
    qoq_growth,
    qoq_of_quarters,
    with_month_dates,
    yoy_growth,
)
from cadence.operators.insight import insights, latest_and_best
from cadence.operators.reshape import (
    clean_numeric,
    drop_nulls,
    flatten_columns,
    keep_positive,
    unpivot_annual,
    unpivot_monthly,
)
from cadence.operators.views import (
    filter_entity,
    filter_year_range,
    format_growth_table,
    growth_view_qoq,
    growth_view_yoy,
    trend_series,
)

__all__ = [
    "aggregate_annual",
    "aggregate_quarterly",
    "clean_numeric",
    "drop_nulls",
    "entity_catalog",
    "filter_entity",
    "filter_year_range",
    "flatten_columns",
    "format_growth_table",
    "growth_view_qoq",
    "growth_view_yoy",
    "has_columns",
    "insights",
    "keep_positive",
    "latest_and_best",
    "mask_first_period",
    "preview",
    "qoq_growth",
    "qoq_of_quarters",
    "trend_series",
    "unpivot_annual",
    "unpivot_monthly",
    "with_month_dates",
    "year_bounds",
    "yoy_growth",
]
