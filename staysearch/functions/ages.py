"""Occupancy strings: canonical children ages and display labels."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


# Fixed values of the guest-facing label.
ADULTS_LABEL = " взр."
CHILDREN_LABEL = ", дети "


def normalize_ages(ages: Column) -> Column:
    """Comma-separated ages → canonical ascending list; twins stay, zero and junk go."""
    parts = F.split(F.coalesce(ages, F.lit("")), ",")
    # Leading integer of each part, so "5 y" counts as 5 and "abc" as nothing.
    numbers = F.transform(
        parts, lambda part: F.regexp_extract(part, r"^\s*([+-]?\d+)", 1).try_cast("int")
    )
    kept = F.filter(numbers, lambda n: n.isNotNull() & (n != 0))
    return F.array_join(F.array_sort(kept), ",")


def canonical_ages(ages: str | Iterable[int] | None) -> str:
    """The canonical form of one request's ages, for use as a literal: the column's rule."""
    parts = ages.split(",") if isinstance(ages, str) else map(str, ages or ())
    found = [re.match(r"\s*([+-]?\d+)", part) for part in parts]
    return ",".join(str(n) for n in sorted(int(m[1]) for m in found if m) if n)


def variant_label(adults: Column, children_ages: Column) -> Column:
    """Guest-facing label of a variant."""
    grown = F.concat(adults.cast("string"), F.lit(ADULTS_LABEL))
    spaced = F.replace(children_ages, F.lit(","), F.lit(", "))
    with_children = F.concat(grown, F.lit(CHILDREN_LABEL), spaced)
    return F.when(F.coalesce(children_ages, F.lit("")) == "", grown).otherwise(with_children)
