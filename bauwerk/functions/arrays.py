"""Arrays in the JVM: values bound once, runs of elements, and expressions that the optimizer mustn't copy."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Positions that are gathered before they are put to the others, so that a long array isn't copied at each step.
_GATHER = 256


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with more columns, each worked out once a row.

    A Project may be merged with what stands above it, and then a costly expression is copied into every place that reads it: plans
    grow with each step, and so does the time to plan them. A Generate is never merged, nor is a filter moved below it.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value worked out once."""
    return F.transform(F.array(value), use)[0]


def openings(items: Column, start: Column, opens: Callable[[Column, Column], Column], after: Callable[[Column, Column, Column], Column]) -> Column:
    """Positions (from 1) of the items that open a run; the first one always does.

    opens(state, item) tells if the item opens a run, after(state, item, opened) is the state that the next item meets; start, the
    state that the first one meets, gives its type. Linear in the items: what a step keeps is the state, not the run.
    """
    no_ints, no_lists = F.expr("cast(array() as array<int>)"), F.expr("cast(array() as array<array<int>>)")

    def one(held: Column, item: Column) -> Column:
        at, full = held["at"] + 1, F.size(held["near"]) >= _GATHER

        def put(opened: Column) -> Column:
            near = F.when(full, no_ints).otherwise(held["near"])
            return F.struct(
                at.alias("at"), after(held["state"], item, opened).alias("state"), F.when(opened, F.concat(near, F.array(at))).otherwise(near).alias("near"),
                F.when(full, F.concat(held["far"], F.array(held["near"]))).otherwise(held["far"]).alias("far"),
            )

        return let((at == 1) | F.coalesce(opens(held["state"], item), F.lit(True)), put)

    zero = F.struct(F.lit(0).alias("at"), start.alias("state"), no_ints.alias("near"), no_lists.alias("far"))
    return F.aggregate(items, zero, one, lambda held: F.concat(F.flatten(held["far"]), held["near"]))


def runs(items: Column, opens: Column, use: Callable[[Column, Column], Column]) -> Column:
    """use(first item, array of the items after it) for each run. opens: openings(), in a column of its own, as items are."""
    end = lambda k: F.coalesce(F.get(opens, k + 1), F.size(items) + 1)
    return F.transform(opens, lambda a, k: use(F.element_at(items, a), F.slice(items, a + 1, end(k) - a - 1)))
