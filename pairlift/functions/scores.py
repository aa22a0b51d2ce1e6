"""The log-likelihood ratio and the hash draw, as columns and as SQL functions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def x_log_x(x: Column) -> Column:
    """x ln x, 0 at 0."""
    x = x.cast("double")
    return F.when(x == 0, 0.0).otherwise(x * F.log(x))


def llr(k11: Column, k12: Column, k21: Column, k22: Column) -> Column:
    """Twice the mutual information of a 2 x 2 table in counts times nats; 0.0 where rounding makes it negative."""
    every = x_log_x(k11 + k12 + k21 + k22)
    rows = every - x_log_x(k11 + k12) - x_log_x(k21 + k22)
    columns = every - x_log_x(k11 + k21) - x_log_x(k12 + k22)
    matrix = every - x_log_x(k11) - x_log_x(k12) - x_log_x(k21) - x_log_x(k22)
    return F.when(rows + columns < matrix, 0.0).otherwise(2.0 * (rows + columns - matrix))


def contingency(k11: Column, row: Column, other_row: Column, total: Column, kind: str = "observed") -> list[Column]:
    """k11, k12, k21, k22.  "observed" adds k11 to the last cell, which defines the scores here; "textbook" takes it off."""
    k12, k21 = row - k11, other_row - k11
    k22 = (total + k11 if kind == "observed" else total - k11) - k12 - k21
    return [k11, k12, k21, k22]


def draw(seed: int, user: Column, total: Column) -> Column:
    """A number from 0 to total - 1 that depends on (seed, user, total) only."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), user.cast("string"), total.cast("string")))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), total)


def register(spark: SparkSession) -> None:
    """Makes x_log_x(x) and llr(k11, k12, k21, k22) available to SQL; Catalyst inlines both."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION x_log_x(x DOUBLE) RETURNS DOUBLE RETURN CASE WHEN x = 0 THEN 0D ELSE x * ln(x) END")
    every = "x_log_x(k11 + k12 + k21 + k22)"
    gap = (
        f"({every} - x_log_x(k11 + k12) - x_log_x(k21 + k22)) + ({every} - x_log_x(k11 + k21) - x_log_x(k12 + k22))"
        f" - ({every} - x_log_x(k11) - x_log_x(k12) - x_log_x(k21) - x_log_x(k22))"
    )
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION llr(k11 DOUBLE, k12 DOUBLE, k21 DOUBLE, k22 DOUBLE) RETURNS DOUBLE RETURN 2D * greatest(0D, {gap})")
