"""Table-level building blocks shared by the reports."""

from shopledger.operators.combine import (
    keys_only_in_first,
    share_of_total,
    side_by_side,
)
from shopledger.operators.filters import (
    ALL,
    date_bounds,
    date_range,
    distinct_sorted,
    equal_to,
    in_list,
    option_rows,
)
from shopledger.operators.grid import dense_fill, fill_months, month_spine, observed
from shopledger.operators.ordered import forward_fill, keep_first, number_rows
from shopledger.operators.ranking import by_key, sorted_by, top_k

__all__ = [
    "ALL",
    "by_key",
    "date_bounds",
    "date_range",
    "dense_fill",
    "distinct_sorted",
    "equal_to",
    "fill_months",
    "forward_fill",
    "in_list",
    "keep_first",
    "keys_only_in_first",
    "month_spine",
    "number_rows",
    "observed",
    "option_rows",
    "share_of_total",
    "side_by_side",
    "sorted_by",
    "top_k",
]
