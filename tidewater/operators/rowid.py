"""Dense row numbers in the order of a frame."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame

ROW = "__tidewater_row__"


def with_row_id(df: DataFrame, order_by=None, name: str = ROW) -> DataFrame:
    """The frame with the column ``name``: 0 to n - 1 in the frame's order, or in that of ``order_by``.

    Partitions are numbered by their sizes and offsets on the JVM; no window
    over a single partition is used. The order of a frame without ``order_by`` is
    that of its source's files.
    """
    os.environ.setdefault("PYARROW_IGNORE_TIMEZONE", "1")  # else the import warns
    from pyspark.pandas.internal import InternalFrame

    if order_by is not None:
        df = df.orderBy(*([order_by] if isinstance(order_by, str) else order_by))
    return InternalFrame.attach_distributed_sequence_column(df, name)
