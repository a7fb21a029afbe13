"""Label normalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluiceway.functions.parsing import as_column
from sluiceway.specs import NORMAL, UNKNOWN


def clean_label(c: Column | str) -> Column:
    """Lower case, without one trailing dot."""
    return F.lower(F.regexp_replace(as_column(c), r"\.$", ""))


def binary_label(c: Column | str, negative: str = NORMAL) -> Column:
    """0.0 for the negative class, 1.0 for everything else, null included."""
    return F.when(as_column(c) == F.lit(negative), 0.0).otherwise(1.0)


def label_from_flag(c: Column | str) -> Column:
    """0.0 where a flag is 0 as an integer (fractions cut off); null or unparsable flags
    count as attacks."""
    return F.when(F.abs(as_column(c).try_cast("double")) < 1.0, 0.0).otherwise(1.0)


def category_map(
    c: Column | str,
    groups: dict[str, list[str]],
    default: str = UNKNOWN,
    identity: tuple[str, ...] = (NORMAL,),
) -> Column:
    """Name -> group by fixed member lists; names in ``identity`` map to themselves."""
    name = as_column(c)
    members = [(group, names) for group, names in groups.items()]
    out = None
    for group, names in [(i, [i]) for i in identity] + members:
        hit = name.isin(names)
        out = F.when(hit, F.lit(group)) if out is None else out.when(hit, F.lit(group))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))
