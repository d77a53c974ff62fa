"""Rows whose foreign key has no parent."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def orphans(child: DataFrame, parent: DataFrame, keys: Mapping[str, str]) -> DataFrame:
    """Child rows with a complete foreign key that no parent row has; ``keys`` maps child to parent columns."""
    have = parent.select(*[F.col(p).alias(f"_parent_{p}") for p in keys.values()])
    same = None
    for c, p in keys.items():
        one = F.col(c) == F.col(f"_parent_{p}")
        same = one if same is None else same & one
    return child.dropna(subset=list(keys)).join(have, same, "left_anti")
