"""Raw returns to modelling panel."""

from __future__ import annotations

from pyspark.sql import DataFrame

from panelyard.config import Settings
from panelyard.operators.metadata import attach_metadata
from panelyard.operators.trailing import add_index_features, add_return_features, spread_assets
from panelyard.operators.turnover import attach_costs
from panelyard.operators.universe import add_target, in_panel_order, post_publication
from panelyard.sources.store import materialise


def build_panel(returns: DataFrame, metadata: DataFrame, causal: DataFrame | None,
                settings: Settings = Settings(), *, cost_keys=("signalname", "yyyymm"),
                with_keys=None, causal_rows: int | None = None,
                flat_turnover: float | None = None) -> DataFrame:
    """Screen, features, metadata, costs, target, in that order.

    Windows run after the publication screen, so they only see rows an investor
    could have held. ``with_keys`` may add columns the cost join needs. The screened
    returns are written once, so the raw source is scanned once for both the windows and
    the index; the feature block is written once for the cost fill and the target.
    """
    df = materialise(post_publication(returns, metadata, settings.universe), "universe")
    df = add_index_features(add_return_features(spread_assets(df)))
    if with_keys is not None:
        df = with_keys(df)
    df = materialise(df, "features")
    df = attach_metadata(df, metadata)
    df = attach_costs(df, causal, settings.costs, on=cost_keys, causal_rows=causal_rows,
                      flat_turnover=flat_turnover)
    df = df.drop(*[k for k in cost_keys if k not in ("signalname", "yyyymm")])
    return in_panel_order(add_target(df, settings.universe.min_assets))
