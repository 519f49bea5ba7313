"""Task parameters in maps, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def without_suffix(params: Column, task_number: Column) -> Column:
    """Parameters of one form task, with its ``_<number>`` removed; task 1 does not take those of task 10."""
    suffix = F.concat(F.lit("_"), task_number.cast("string"))
    own = F.map_filter(params, lambda key, _: F.endswith(key, suffix))
    return F.transform_keys(own, lambda key, _: F.substring(key, F.lit(1), F.length(key) - F.length(suffix)))


def param_by_prefix(params: Column, prefix: str) -> Column:
    """Value of the first key, by name, that starts with the prefix."""
    keys = F.filter(F.map_keys(params), lambda key: F.startswith(key, F.lit(prefix)))
    return F.try_element_at(params, F.array_min(keys))
