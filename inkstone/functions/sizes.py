"""Size checks that stand before every broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.session import cut

#: Rows up to which a narrow side may be broadcast.
BROADCAST_ROWS = 200_000


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else without (a shuffled join follows).

    The side is written once, so that counting it and joining with it do not compute it twice.
    """
    side = cut(df)
    return F.broadcast(side) if side.limit(rows + 1).count() <= rows else side
