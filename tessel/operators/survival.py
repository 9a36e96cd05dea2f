"""Survival curves from (time, event) rows, counted per distinct time before any window runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.operators.running import running


def _counts(df: DataFrame, time: str, event: str, by: list[str]) -> DataFrame:
    """(by, t, d, n, at_risk): events and rows of each distinct time, rows not ended before it."""
    per = df.where(F.col(time).isNotNull()).groupBy(*by, F.col(time).alias("t")).agg(F.count_if(F.col(event) != 0).alias("d"), F.count("*").alias("n"))
    return running(per, ["t"], {"at_risk": ("sum", F.col("n"), True)}, by, descending=True)


def kaplan_meier(df: DataFrame, time: str, event: str, by: list[str] | None = None) -> DataFrame:
    """(by, t, at_risk, d, survival, se) at each time with an event; Greenwood's error."""
    by = by or []
    left = F.col("at_risk") - F.col("d")
    term = F.when(left == 0, 0.0).otherwise(F.col("d") / (F.col("at_risk") * left))
    rows = running(_counts(df, time, event, by).where("d > 0"), ["t"], {"survival": ("product", left / F.col("at_risk"), True), "_v": ("sum", term, True)}, by)
    return rows.select(*by, "t", "at_risk", "d", "survival", (F.col("survival") * F.sqrt("_v")).alias("se"))


def median_survival(curve: DataFrame, by: list[str] | None = None) -> DataFrame:
    """First time at which survival is one half at most; infinity if it never is."""
    return curve.groupBy(*(by or [])).agg(F.coalesce(F.min(F.when(F.col("survival") <= 0.5, F.col("t").cast("double"))), F.lit(float("inf"))).alias("median"))


def nelson_aalen(df: DataFrame, time: str, event: str, by: list[str] | None = None) -> DataFrame:
    by = by or []
    share = F.col("d") / F.col("at_risk")
    rows = running(_counts(df, time, event, by).where("d > 0"), ["t"], {"hazard": ("sum", share, True), "_v": ("sum", share / F.col("at_risk"), True)}, by)
    return rows.select(*by, "t", "at_risk", "d", "hazard", F.sqrt("_v").alias("se"))


def aalen_johansen(df: DataFrame, time: str, cause: str, by: list[str] | None = None) -> DataFrame:
    """(by, cause, t, incidence): cumulative incidence of each cause; cause 0 is censoring."""
    by = by or []
    all_ = _counts(df, time, cause, by).where("d > 0")
    before = running(all_, ["t"], {"s": ("product", 1 - F.col("d") / F.col("at_risk"), False)}, by).select(*by, "t", "at_risk", "s")
    per = df.where(F.col(cause) != 0).groupBy(*by, F.col(time).alias("t"), F.col(cause).alias("cause")).agg(F.count("*").alias("k"))
    rows = running(per.join(before, [*by, "t"]), ["t"], {"incidence": ("sum", F.col("s") * F.col("k") / F.col("at_risk"), True)}, [*by, "cause"])
    return rows.select(*by, "cause", "t", "incidence")


def log_rank(df: DataFrame, time: str, event: str, group: str, first) -> DataFrame:
    """observed, expected, variance, chi2 of one group against the rest."""
    rows = df.select(F.col(time).alias("t"), F.col(event).alias("e"), (F.col(group) == F.lit(first)).alias("one"))
    per = rows.groupBy("t").agg(F.count_if(F.col("e") != 0).alias("d"), F.count("*").alias("n"), F.count_if((F.col("e") != 0) & F.col("one")).alias("d1"), F.count_if("one").alias("n1"))
    risk = running(per, ["t"], {"y": ("sum", F.col("n"), True), "y1": ("sum", F.col("n1"), True)}, descending=True).where("d > 0")
    v = F.when(F.col("y") > 1, F.col("d") * F.col("y1") / F.col("y") * (1 - F.col("y1") / F.col("y")) * (F.col("y") - F.col("d")) / (F.col("y") - 1)).otherwise(0.0)
    s = risk.agg(F.sum("d1").alias("observed"), F.sum(F.col("d") * F.col("y1") / F.col("y")).alias("expected"), F.sum(v).alias("variance"))
    return s.withColumn("chi2", (F.col("observed") - F.col("expected")) ** 2 / F.col("variance"))


def person_period(df: DataFrame, time: str, event: str, keys: list[str], width: int) -> DataFrame:
    """One row per subject and period of `width` up to its time; `event` only in the last."""
    last = F.floor(F.col(time) / width).cast("int")
    rows = df.withColumn("period", F.explode(F.sequence(F.lit(0), last)))
    return rows.select(*keys, "period", F.when(F.col("period") == last, F.col(event)).otherwise(0).alias("event"))
