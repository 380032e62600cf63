"""Token cost of runs and paired comparison.  Sums are exact (decimals or integers)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTS = ("uncached", "cached", "output")
TOLERANCE = "0.000000001"


def priced(trials: DataFrame, price_in: str, price_cached: str, price_out: str) -> DataFrame:
    """Adds uncached and cost; prices are per million tokens, as decimal text."""

    def part(tokens: Column, price: str) -> Column:
        return tokens.cast("decimal(18,0)") * F.lit(price).cast("decimal(9,4)")

    cost = part(F.col("n_input") - F.col("n_cached"), price_in) + part(F.col("n_cached"), price_cached) + part(F.col("n_output"), price_out)
    out = trials.withColumn("uncached", F.col("n_input") - F.col("n_cached"))
    return out.withColumn("cost", (cost / 1000000).cast("decimal(38,10)"))


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cases in both runs with a_, b_ columns and diff = a - b of the costs."""
    left = a.select("case_id", *[F.col(c).alias(f"a_{c}") for c in a.columns if c != "case_id"])
    right = b.select("case_id", *[F.col(c).alias(f"b_{c}") for c in b.columns if c != "case_id"])
    return left.join(right, "case_id").withColumn("diff", F.col("a_cost") - F.col("b_cost"))


def bucket(diff: Column) -> Column:
    limit = F.lit(TOLERANCE).cast("decimal(12,10)")
    return F.when(diff > limit, "higher").when(diff < -limit, "lower").otherwise("same")


def ratio(numerator: Column, denominator: Column, digits: int = 6) -> Column:
    return F.round(F.try_divide(numerator.cast("double"), denominator.cast("double")), digits)


def reduction(new: Column, base: Column) -> Column:
    return F.round(F.try_divide((base - new).cast("double") * 100, base.cast("double")), 6)
