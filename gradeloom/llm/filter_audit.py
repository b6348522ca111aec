"""What each of some filters removes, in every order, and its exact Shapley value.

Documents are counted by the set of filters that they fail.  From these counts comes
the table of coalitions: how many documents a set of filters removes together.  Every
other figure is a difference in that table: what a step removes is what the filters up
to it remove, less what those before it do.

The Shapley values are the solution of a least-squares problem.  For filters i with
values p(i) and coalitions S that remove v(S), they minimise

    sum over S of k(S) * (v(S) - sum over i in S of p(i))**2,   k(S) = (n - 1) / (C(n, s) * s * (n - s))

under the constraint that they add up to what all filters remove.  The solution is
linear in v, so the normal equations with their constraint are solved once, in rational
numbers, for one right side per coalition; times n! its coefficients are whole numbers,
and the values follow from the table in whole numbers.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from fractions import Fraction
from itertools import permutations
from math import comb, factorial

from pyspark.sql import Column, DataFrame, Window, functions as F

# n filters give n! orders and 2**n coalitions per part.
MAX_FILTERS = 7


def shapley_coefficients(n: int) -> list[list[int]]:
    """For every filter, the factor of each coalition's removals in n! times its Shapley value."""
    coalitions = range(1 << n)
    inside = [[i for i in range(n) if s >> i & 1] for s in coalitions]
    weight = [
        Fraction(n - 1, comb(n, len(s)) * len(s) * (n - len(s))) if 0 < len(s) < n else Fraction(0) for s in inside
    ]
    # Rows: one equation per filter, then the constraint. Columns: values, multiplier, one right side per coalition.
    rows = []
    for i in range(n):
        left = [sum((weight[s] for s in coalitions if i in inside[s] and j in inside[s]), Fraction(0)) for j in range(n)]
        rows.append(left + [Fraction(1)] + [weight[s] if i in inside[s] else Fraction(0) for s in coalitions])
    rows.append([Fraction(1)] * n + [Fraction(0)] + [Fraction(int(s == len(inside) - 1)) for s in coalitions])
    for column in range(n + 1):
        pivot = next(r for r in range(column, n + 1) if rows[r][column])
        rows[column], rows[pivot] = rows[pivot], rows[column]
        rows[column] = [x / rows[column][column] for x in rows[column]]
        for r in range(n + 1):
            if r != column and rows[r][column]:
                rows[r] = [x - rows[r][column] * y for x, y in zip(rows[r], rows[column])]
    scaled = [[factorial(n) * x for x in row[n + 1 :]] for row in rows[:n]]
    if any(x.denominator != 1 for row in scaled for x in row):
        raise ArithmeticError("the Shapley coefficients are not whole numbers")
    return [[int(x) for x in row] for row in scaled]


def failure_rows(
    df: DataFrame, failures: Sequence[Column], text: str = "text", doc_id: str = "doc_id", part: str = "lang"
) -> DataFrame:
    """Per row its ``doc_id``, ``part``, ``failed`` and ``text_hash``, without the text.

    Bit i of ``failed`` is set if condition i holds; an unknown condition does not.  The
    hash has 256 bits; a null text counts as empty, a null part as the empty string.
    """
    failed = F.lit(0)
    for i, condition in enumerate(failures):
        failed = failed + F.when(condition, 1 << i).otherwise(0)
    whole = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return df.select(
        F.col(doc_id).alias("doc_id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        failed.alias("failed"),
        F.unhex(F.sha2(whole, 256)).alias("text_hash"),
    )


def count_failures(rows: DataFrame, marks: Sequence[str] = (), copies: int | None = None) -> DataFrame:
    """Rows ``n`` by ``part``, ``failed`` and boolean ``marks`` (null: false).

    With ``copies``, that bit of ``failed`` is set for rows whose text any row with a
    smaller id has as well; a null id is neither smaller nor larger than others.

    Rows are added up by text before a text's parts meet, so a text in a third of all
    rows comes down to a few rows in every task.  Rows with equal ids count singly.
    """
    flags = [F.coalesce(F.col(mark), F.lit(False)).alias(mark) for mark in marks]
    kinds = ["part", "failed", *marks]
    if copies is None:
        return rows.select("part", "failed", *flags).groupBy(*kinds).agg(F.count("*").alias("n"))
    of_id = rows.select("doc_id", "text_hash", "part", "failed", *flags)
    of_id = of_id.groupBy("doc_id", "text_hash", *kinds).agg(F.count("*").alias("n"))
    known = F.col("doc_id").isNotNull()
    of_text = of_id.groupBy("text_hash", *kinds).agg(
        F.sum("n").alias("n"),
        F.sum(F.when(known, F.col("n")).otherwise(0)).alias("known"),
        F.min(F.when(known, F.struct("doc_id", "n"))).alias("first"),
    )
    # A text has one row for each of its parts and marks here.
    met = of_text.withColumn("least", F.min("first.doc_id").over(Window.partitionBy("text_hash")))
    originals = F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    met = met.withColumn("copied", F.col("known") - F.coalesce(originals, F.lit(0)))
    split = F.inline(
        F.array(
            F.struct(F.col("failed"), (F.col("n") - F.col("copied")).alias("n")),
            F.struct((F.col("failed") + F.lit(1 << copies)).alias("failed"), F.col("copied").alias("n")),
        )
    )
    return met.select("part", *marks, split).groupBy(*kinds).agg(F.sum("n").alias("n"))


def coalition_removals(counts: DataFrame, n_filters: int, marks: Sequence[str] = ()) -> DataFrame:
    """Per ``part`` and ``coalition`` (bits) the rows that fail any of its filters, as ``removed`` and by mark.

    ``rows`` are all rows of the part.  Every part has all coalitions.
    """
    gone = F.col("failed").bitwiseAND(F.col("coalition")) != 0
    summed = counts.groupBy("part", "failed").agg(
        F.sum("n").alias("n"), *(F.sum(F.when(F.col(mark), F.col("n")).otherwise(0)).alias(mark) for mark in marks)
    )
    each = summed.withColumn("coalition", F.explode(F.sequence(F.lit(0), F.lit((1 << n_filters) - 1))))
    return each.groupBy("part", "coalition").agg(
        F.sum("n").alias("rows"),
        F.sum(F.when(gone, F.col("n")).otherwise(0)).alias("removed"),
        *(F.sum(F.when(gone, F.col(mark)).otherwise(0)).alias(mark) for mark in marks),
    )


def audit_filters(counts: DataFrame, filters: str, marks: Mapping[str, str] | None = None) -> DataFrame:
    """One row per part, order of the filters and step; ``filters`` has one letter for each bit.

    ``kept``, ``removed``, ``redundant`` (fail this filter, removed before), ``unique_fails``
    (fail this one only), ``shapley`` (its value times the number of orders), and what of
    each mark the step removes, named by ``marks``.  A part without rows has none here;
    an empty table gives an empty result.
    """
    n, marks = len(filters), dict(marks or {})
    if not 0 < n <= MAX_FILTERS:
        raise ValueError(f"{n} filters; from 1 to {MAX_FILTERS} have a table of all orders")
    orders = list(permutations(range(n)))
    steps = [(order, k) for order in orders for k in range(n)]
    bits = [[1 << i for i in order] for order in orders]
    names = F.lit(["".join(filters[i] for i in order) for order in orders])
    number = F.lit([order[k] for order, k in steps])
    before = F.lit([sum(of[:k]) for of in bits for k in range(n)])
    everything = (1 << n) - 1

    table = coalition_removals(counts, n, list(marks))
    cells = F.sort_array(F.collect_list(F.struct("coalition", "removed", "rows", *marks)))
    parts = table.groupBy("part").agg(cells.alias("cells"))

    def at(coalition: Column | int, name: str) -> Column:
        return F.get("cells", F.lit(coalition) if isinstance(coalition, int) else coalition)[name]

    values = [
        sum((F.lit(c) * at(s, "removed") for s, c in enumerate(row) if c), F.lit(0).cast("long"))
        for row in shapley_coefficients(n)
    ]
    parts = parts.withColumn("values", F.array(*values))
    each = parts.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(len(steps) - 1))))
    each = each.withColumns({"number": F.get(number, F.col("at")), "before": F.get(before, F.col("at"))})
    own = F.call_function("shiftleft", F.lit(1), F.col("number"))
    up_to, others = F.col("before") + own, F.lit(everything) - own

    def here(name: str) -> Column:
        return at(up_to, name) - at(F.col("before"), name)

    return each.select(
        "part",
        F.get(names, F.floor(F.col("at") / n).cast("int")).alias("filter_order"),
        (F.col("at") % n + 1).cast("int").alias("step"),
        (at(0, "rows") - at(up_to, "removed")).alias("kept"),
        here("removed").alias("removed"),
        (at(own, "removed") - here("removed")).alias("redundant"),
        (at(everything, "removed") - at(others, "removed")).alias("unique_fails"),
        *(here(mark).alias(name) for mark, name in marks.items()),
        F.get("values", F.col("number")).alias("shapley"),
    )
