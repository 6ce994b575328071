"""Functions on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def text(a: Column | str) -> Column:
    """'[1,null,2]'; null for a null array."""
    return F.concat(F.lit("["), F.array_join(F.transform(_c(a), lambda x: x.cast("string")), ",", "null"), F.lit("]"))


def contains(a: Column | str, value) -> Column:
    """false, not null, where the value is absent and the array holds nulls."""
    value = value if isinstance(value, Column) else F.lit(value)
    return F.coalesce(F.exists(_c(a), lambda x: x.eqNullSafe(value)), F.lit(False))


def share_of(a: Column | str, value) -> Column:
    """share of elements equal to a constant; 0 for an empty array."""
    a = _c(a)
    return F.when(F.size(a) > 0, F.size(F.filter(a, lambda x: x.eqNullSafe(F.lit(value)))) / F.size(a)).otherwise(F.lit(0.0))


def share_matching(a: Column | str, value: Column) -> Column:
    """1 - distinct elements other than the value / length."""
    a = _c(a)
    return F.try_divide(F.size(a) - F.size(F.array_except(a, F.array(value))), F.size(a))


def tail(a: Column | str, n: int) -> Column:
    """the last n elements, all of them if there are fewer."""
    a = _c(a)
    return F.slice(a, F.greatest(F.size(a) - n + 1, F.lit(1)), n)


def pad_left(a: Column | str, n: int, value) -> Column:
    """the last n elements, filled up on the left."""
    a = _c(a)
    return F.concat(F.array_repeat(F.lit(value), F.greatest(F.lit(n) - F.size(a), F.lit(0))), tail(a, n))


def keep_in(a: Column | str, values: list) -> Column:
    """F8: elements among the values; null if none is."""
    kept = F.filter(_c(a), lambda x: x.isin(*values))
    return F.when(F.size(kept) > 0, kept)


def without(a: Column | str, gone: Column | str) -> Column:
    """elements that are not in the other array, in order and with repeats."""
    gone = _c(gone)
    return F.filter(_c(a), lambda x: ~F.coalesce(F.array_contains(gone, x), F.lit(False)))


def labels(shown: Column | str, taken: Column | str) -> Column:
    """1 for each shown element that was taken."""
    taken = _c(taken)
    return F.transform(_c(shown), lambda x: F.coalesce(F.array_contains(taken, x), F.lit(False)).cast("int"))


def total(a: Column | str) -> Column:
    """null-skipping sum as double; 0 for an empty array."""
    return F.aggregate(_c(a), F.lit(0.0), lambda s, x: s + F.coalesce(x.cast("double"), F.lit(0.0)))


def mean(a: Column | str) -> Column:
    a = F.array_compact(_c(a))
    return F.try_divide(total(a), F.size(a))


def deviation(a: Column | str) -> Column:
    """Sample standard deviation, null below two elements."""
    a = F.array_compact(_c(a))
    m = mean(a)
    return F.sqrt(F.try_divide(F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)), F.when(F.size(a) > 1, F.size(a) - 1)))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """shared / all distinct elements; null when both are empty."""
    return F.try_divide(F.size(F.array_intersect(_c(a), _c(b))), F.size(F.array_union(_c(a), _c(b))))


def linear_decay(n: Column, ascending: bool = False) -> Column:
    """(n - i) / n for i from 0, reversed if ascending."""
    out = F.transform(F.sequence(F.lit(0), n - 1), lambda i: (n - i) / n)
    return F.when(n > 0, F.reverse(out) if ascending else out)


def exponential_decay(n: Column, rate: float) -> Column:
    """rate^(n - i - 1): the last element weighs 1."""
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.pow(F.lit(rate), n - i - 1)))


def multi_hot(a: Column | str, values: list) -> Column:
    """F16: an indicator for each value of a fixed list."""
    a = _c(a)
    return F.array(*(contains(a, v).cast("int") for v in values))


def clean_names(a: Column | str) -> Column:
    """leading quotes and outer spaces off, lower case, empty ones out, distinct, sorted."""
    a = F.transform(_c(a), lambda x: F.lower(F.trim(F.regexp_replace(x, '^"+', ""))))
    return F.array_sort(F.array_distinct(F.filter(a, lambda x: x.isNotNull() & (x != ""))))
