"""Column expressions; all of them are built-ins evaluated in the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column | str) -> Column:
    """Remove any leading and trailing whitespace, not only spaces."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def to_number(c: Column | str, type_name: str = "double") -> Column:
    """Tolerant cast: text that is not a number, NaN included, becomes null, and so
    does a number that the type can't hold, such as a fraction in an integer."""
    value = without_nan(F.col(c) if isinstance(c, str) else c)
    if type_name == "double":
        return value
    typed = value.try_cast(type_name)
    return F.when(typed.cast("double") == value, typed)


def without_nan(c: Column) -> Column:
    """As a double, with null for NaN and for what is not a number."""
    value = c.try_cast("double")
    return F.when(~F.isnan(value), value)


def map_values(c: str, mapping: Mapping, type_name: str) -> Column:
    """Dictionary lookup; a value outside the dictionary becomes null."""
    chain = reduce(
        lambda chain, kv: chain.when(F.col(c) == kv[0], F.lit(kv[1])), mapping.items(), F
    )
    return chain.otherwise(F.lit(None)).cast(type_name)


def right_closed_bucket(c: Column | str, edges: Sequence[float], labels: Sequence[str],
                        include_lowest: bool = False) -> Column:
    """Label of the bin (edges[i], edges[i+1]] that holds the value, else null."""
    c = F.col(c) if isinstance(c, str) else c
    below = c < F.lit(edges[0]) if include_lowest else c <= F.lit(edges[0])
    chain = F.when(below, F.lit(None).cast("string"))
    for upper, label in zip(edges[1:], labels, strict=True):
        chain = chain.when(c <= F.lit(upper), F.lit(label))
    return chain


def equals_flag(c: str, value: str) -> Column:
    """1 where the column equals the value, otherwise 0; null counts as 0."""
    return F.coalesce(F.col(c) == F.lit(value), F.lit(False)).cast("int")


def count_yes(columns: Sequence[str]) -> Column:
    return reduce(add, [equals_flag(c, "Yes") for c in columns])


def churned(c: str = "Churn", collation: str | None = None) -> Column:
    """1 for a churned row whether the column holds text or a bit."""
    text = F.col(c).cast("string")
    if collation:
        text = F.collate(text, collation)
    return F.when(text.isin("Yes", "1"), F.lit(1)).otherwise(F.lit(0))


# --- aggregates -------------------------------------------------------------

def exact_sum(value: Column) -> Column:
    """Sum of doubles that doesn't depend on the order of rows: decimals of ten
    places, plus what these leave over (next to nothing, or a value too large
    for them as a whole)."""
    part = F.coalesce(value.try_cast("decimal(28,10)"), F.lit(0).cast("decimal(28,10)"))
    part = F.when(value.isNotNull(), part)
    return F.sum(part).cast("double") + F.sum(value - part.cast("double"))


def total(name: str) -> Column:
    """Sum of a column without NaN; 0 for a group without values."""
    return F.coalesce(exact_sum(without_nan(F.col(name))), F.lit(0.0))


def mean(name: str) -> Column:
    """Mean of the values that are neither null nor NaN; null if there are none."""
    value = without_nan(F.col(name))
    return F.try_divide(exact_sum(value), F.count(value))


def customers(key: str, unique: bool) -> Column:
    """Distinct customers. When the key has been checked to be unique over the
    whole table, a plain count gives the same figure without shuffling keys."""
    return F.count(key) if unique else F.count_distinct(key)


def significant(c: Column | str, digits: int = 10) -> Column:
    """The value rounded to a number of significant digits."""
    c = F.col(c) if isinstance(c, str) else c
    text = F.format_string(f"%.{digits - 1}e", c)
    return F.when(c.isNotNull(), text.try_cast("double") + F.lit(0.0))
