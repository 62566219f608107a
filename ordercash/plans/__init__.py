from ordercash.plans.joins import (
    having_no,
    having_some,
    join_totals,
    left_join_many,
    left_join_one,
    mix,
    pick,
)
from ordercash.plans.paging import newest_first, page, page_after

__all__ = [
    "having_no", "having_some", "join_totals", "left_join_many",
    "left_join_one", "mix", "newest_first", "page", "page_after", "pick",
]
