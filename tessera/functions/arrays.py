"""Array helpers: n-grams and multiset overlap, all native and row-local.

Multiset overlap (sum over shared items of the smaller count) is row-local.
A few shared items are counted; with more of them each side is sorted and
run-length encoded into (value, count) pairs, the two run lists are merged by
one more sort, and adjacent equal values contribute ``least(count_a,
count_b)``: O(n log n).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, fn) -> Column:
    """Evaluate ``value`` once and bind it for ``fn`` (lambdas do not share
    common subexpressions, so repeated references would recompute)."""
    return F.get(F.transform(F.array(value), fn), 0)


def once(**columns: Column) -> Column:
    """A generator of one row with these columns, for ``select``: what is
    generated is computed once, however often it is used afterwards (a plain
    projection may be copied into each use, a filter included)."""
    return F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))


def ngrams(tokens: Column, n: int) -> Column:
    """Contiguous n-grams of a token array, joined by one space (of single
    items: a slice for each would copy the whole array each time)."""
    if n == 1:
        return tokens
    return let(tokens, lambda t: F.when(
        F.size(t) >= n,
        F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)),
                    lambda i: F.concat_ws(" ", *[F.get(t, i + (k - 1)) for k in range(n)])),
    ).otherwise(F.array().cast("array<string>")))


def value_counts(arr: Column) -> Column:
    """Sorted ``array<struct<v, c>>`` of distinct values and their counts."""
    def runs(s):
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1),
                          lambda j: (j == 0) | (F.get(s, j) != F.get(s, j - 1)))
        return let(starts, lambda st: F.transform(
            st, lambda p, i: F.struct(
                F.get(s, p).alias("v"),
                (F.coalesce(F.get(st, i + 1), F.size(s)) - p).cast("long").alias("c"))))
    return let(F.array_sort(arr), lambda s: F.when(F.size(s) > 0, runs(s)))


#: Up to so many shared items their counts are taken one by one.
FEW_SHARED = 8


def multiset_overlap(a: Column, b: Column) -> Column:
    """``sum_x min(count_a(x), count_b(x))`` as a LONG; 0 if either is empty.

    Items in both sides are found first, by hashing: most pairs of texts share
    no n-gram or a few, which are counted; only the others are sorted."""
    def counted(x, y, common):
        def count(side, item):
            return F.size(F.filter(side, lambda v: v == item))
        return F.aggregate(common, F.lit(0).cast("long"), lambda acc, item: acc + F.least(count(x, item), count(y, item)))

    def of(x, y):
        return let(F.array_intersect(x, y), lambda common: F.when(F.coalesce(F.size(common), F.lit(0)) <= 0, F.lit(0).cast("long"))
                   .when(F.size(common) <= FEW_SHARED, counted(x, y, common)).otherwise(_sorted_overlap(x, y)))

    return let(a, lambda x: let(b, lambda y: of(x, y)))


def _sorted_overlap(a: Column, b: Column) -> Column:
    merged = F.array_sort(F.concat(
        F.coalesce(value_counts(a), F.array().cast("array<struct<v:string,c:bigint>>")),
        F.coalesce(value_counts(b), F.array().cast("array<struct<v:string,c:bigint>>"))))

    def total(u):
        return F.aggregate(
            F.sequence(F.lit(1), F.greatest(F.size(u) - 1, F.lit(1))),
            F.lit(0).cast("long"),
            lambda acc, j: acc + F.coalesce(F.when(
                F.get(u, j)["v"] == F.get(u, j - 1)["v"],
                F.least(F.get(u, j)["c"], F.get(u, j - 1)["c"])), F.lit(0).cast("long")))
    return let(merged, total)


def distinct_overlap_ratio(target: Column, source: Column) -> Column:
    """size(set(T) & set(S)) / size(set(T)); NULL when T is empty."""
    t = F.array_distinct(target)
    return F.try_divide(F.size(F.array_intersect(t, F.array_distinct(source))).cast("double"),
                        F.size(t).cast("double"))
