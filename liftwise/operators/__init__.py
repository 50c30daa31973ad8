"""DataFrame operators: the star join and its roll-ups, and rankings."""

from liftwise.operators.ranking import (
    Key,
    global_rank,
    ordered_ranks,
    rank_by,
    top_bottom_k,
    top_n,
    top_n_per_group,
    top_n_with_rank,
)
from liftwise.operators.star import (
    broadcast_small_dims,
    materialize_summary,
    rollup,
    sales_summary,
    star_join,
    summarise,
)

__all__ = [
    "Key",
    "broadcast_small_dims",
    "global_rank",
    "materialize_summary",
    "ordered_ranks",
    "rank_by",
    "rollup",
    "sales_summary",
    "star_join",
    "summarise",
    "top_bottom_k",
    "top_n",
    "top_n_per_group",
    "top_n_with_rank",
]
