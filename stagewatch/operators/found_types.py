"""Types found from data: one mergeable aggregate over all columns, against every declared type.

A value's type lies in a small lattice: integers are numbers, everything is
text, dates and booleans stand beside numbers.  A column has the least type
that all its values have.  The aggregate holds a count per type and, as a
counterexample, the least value that is not of it; two such profiles are merged
by adding and taking the lesser, so loads can be profiled one by one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import quoted

# How the text of each type looks.
INTEGER, NUMBER = r"^[+-]?[0-9]{1,18}$", r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
DAY, TRUTH = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$", ("true", "false")
KINDS = ["integer", "float", "date", "boolean"]
#: Types found that are fit for a declared type; any is fit for text.
FIT = {"integer": ["none", "integer"], "float": ["none", "integer", "float"], "date": ["none", "date"],
       "boolean": ["none", "boolean"]}


def _is(kind: str, value: Column) -> Column:
    return {"integer": lambda: value.rlike(INTEGER), "float": lambda: value.rlike(NUMBER),
            "date": lambda: value.rlike(DAY) & value.try_cast("date").isNotNull(),
            "boolean": lambda: F.lower(value).isin(*TRUTH)}[kind]()


def type_counts(df: DataFrame, dataset: str) -> DataFrame:
    """``dataset, column_name, n_values``, and per type ``n_<type>`` and ``not_<type>`` (the least value not of it).

    All columns in one aggregate over one scan, no row where the table is empty.  Values are taken as text
    without white space at their ends; empty texts count as null.
    """
    # no key to group by: the least texts would have a grouped aggregate sort every value of every column
    texts = df.select(*[F.trim(quoted(name).cast("string")).alias(f"t{i}") for i, name in enumerate(df.columns)])
    values = texts.select(*[F.when(F.col(t) != "", F.col(t)).alias(t) for t in texts.columns])
    marked = values.select("*", *[_is(k, F.col(t)).alias(f"{t}_{k}") for t in texts.columns for k in KINDS])
    added = marked.agg(F.count(F.lit(1)).alias("n_rows"), *[F.struct(
        F.lit(name).alias("column_name"), F.count(t).alias("n_values"), *[a for k in KINDS for a in (
            F.count_if(f"{t}_{k}").alias(f"n_{k}"), F.min(F.when(~F.col(f"{t}_{k}"), F.col(t))).alias(f"not_{k}"))]).alias(t)
        for t, name in zip(texts.columns, df.columns)]).where("n_rows > 0")
    return added.select(F.inline(F.array(*texts.columns))).select(F.lit(dataset).alias("dataset"), "*")


def merge_type_counts(profiles: list[DataFrame]) -> DataFrame:
    """The profile of several loads from the profiles of each."""
    return reduce(DataFrame.unionByName, profiles).groupBy("dataset", "column_name").agg(
        F.sum("n_values").alias("n_values"), *[a for k in KINDS for a in (
            F.sum(f"n_{k}").alias(f"n_{k}"), F.min(f"not_{k}").alias(f"not_{k}"))])


def found_type() -> Column:
    """The least type of all values of a profiled column; ``none`` where it has no values."""
    n = F.col("n_values")
    out = F.when(n == 0, "none")
    for kind in KINDS:                                            # integer before float: the lesser first
        out = out.when(F.col(f"n_{kind}") == n, kind)
    return out.otherwise("string")


def type_conformance(profile: DataFrame, rules: DataFrame) -> DataFrame:
    """Every profiled column that ``rules`` (``dataset, column_name, expected_type``) declare, against its type.

    ``dataset, column_name, expected_type, found_type, conforms, n_values,
    n_bad, counterexample``.
    """
    j = profile.join(rules.select("dataset", "column_name", "expected_type"), ["dataset", "column_name"])
    kind, found = F.col("expected_type"), found_type()
    fits, bad, example = F.lit(True), F.lit(0).cast("bigint"), F.lit(None).cast("string")
    for k in KINDS:
        fits = F.when(kind == k, found.isin(*FIT[k])).otherwise(fits)
        bad = F.when(kind == k, F.col("n_values") - F.col(f"n_{k}")).otherwise(bad)
        example = F.when(kind == k, F.col(f"not_{k}")).otherwise(example)
    return j.select("dataset", "column_name", "expected_type", found.alias("found_type"), fits.alias("conforms"),
                    "n_values", bad.alias("n_bad"), example.alias("counterexample"))
