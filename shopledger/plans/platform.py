"""Customer orders by platform and destination."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopledger.functions import exact_sum
from shopledger.operators import date_range, in_list, option_rows, share_of_total
from shopledger.operators.filters import Dates, selected


def filter_platform_orders(
    orders: DataFrame,
    platforms: Sequence[str] | None = None,
    ship_tos: Sequence[str] | None = None,
    dates: Dates | None = None,
    *,
    end_of_day: bool = False,
) -> DataFrame:
    """Orders of some platforms and destinations in a date range; empty lists mean all."""
    rows = in_list(orders, "platform", platforms, empty="all")
    rows = in_list(rows, "ship_to", ship_tos, empty="all")
    return date_range(rows, "wanted_on", dates, end_of_day=end_of_day)


def platform_options(orders: DataFrame, platforms: Sequence[str] | None = None) -> DataFrame:
    """Platforms, and the destinations and date bounds of the chosen ones."""
    chosen = selected("platform", platforms)
    lists = {"platform": ("platform", F.lit(True)), "ship_to": ("ship_to", chosen)}
    return option_rows(orders, lists, ("wanted_on", chosen))


def by_platform(orders: DataFrame) -> DataFrame:
    """Pieces and amount per platform."""
    return _pieces_and_amount(orders, "platform")


def by_ship_to(orders: DataFrame) -> DataFrame:
    """Pieces and amount per destination."""
    return _pieces_and_amount(orders, "ship_to")


def platform_share(orders: DataFrame) -> DataFrame:
    """Each platform's share of all pieces and of the whole amount."""
    shares = {"pieces": "pieces_share", "amount": "amount_share"}
    return share_of_total(by_platform(orders), shares)


def _pieces_and_amount(orders: DataFrame, key: str) -> DataFrame:
    return (
        orders.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(
            exact_sum(F.col("quantity")).alias("pieces"),
            exact_sum(F.col("amount")).alias("amount"),
        )
    )
