"""A value worked out once for all that is done with it, where a lambda would work it out for every element."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(use: Callable[..., Column], **values: Column) -> Column:
    """``use`` gets each of ``values`` by its name; inside of it they are variables, not expressions."""
    held = F.array(F.struct(*(value.alias(name) for name, value in values.items())))
    return F.element_at(F.transform(held, lambda x: use(**{name: x[name] for name in values})), 1)
