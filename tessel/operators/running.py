"""Running aggregates over all rows in an order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessel.sources.shared import written

#: Rows up to which one window does: a bounded table, whatever it was aggregated from.
ONE_WINDOW = 200_000
#: For each kind: the aggregate of a range, how two of them meet, and the value of no rows.
_KINDS = {
    "sum": (F.sum, lambda a, b: a + b, 0),
    "product": (F.product, lambda a, b: a * b, 1.0),
    "min": (F.min, F.least, None),
    "max": (F.max, F.greatest, None),
}


def running(df: DataFrame, order: list[str], columns: dict[str, tuple[str, Column, bool]], by: list[str] | None = None, descending: bool = False) -> DataFrame:
    """Add columns name -> (kind, value, inclusive): the kind (sum, product, min or max) of `value` over
    the rows up to this one in `order`, with it if inclusive, within `by`.

    The rows are written and counted. At most `ONE_WINDOW` of them go through one window; more are dealt out by ranges of (by, order) and written with their range's number; each range is
    reduced to one row per group, those few rows are run through, and every range then runs through
    its own rows on top of what came before. Rows that tie in `order` stay in one range; their order
    among each other is open. Where there are no rows before, a sum is 0, a product 1, min and max null.
    """
    by = by or []
    ends = [*[F.col(k) for k in by], *[F.desc(c) if descending else F.col(c) for c in order]]
    values = {f"_v_{name}": value for name, (_, value, _) in columns.items()}
    base = written(df.withColumns(values))
    if base.count() <= ONE_WINDOW:
        frame = Window.partitionBy(*by).orderBy(*[F.desc(c) if descending else F.col(c) for c in order])
        out = {}
        for name, (kind, _, inclusive) in columns.items():
            whole, _, none = _KINDS[kind]
            here = whole(f"_v_{name}").over(frame.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
            out[name] = here if none is None else F.coalesce(here, F.lit(none))
        return base.withColumns(out).drop(*values)
    spread = written(base.repartitionByRange(*ends).withColumn("_part", F.spark_partition_id()), instead=base)
    parts = spread.groupBy(*by, "_part").agg(*[_KINDS[kind][0](f"_v_{name}").alias(f"_p_{name}") for name, (kind, _, _) in columns.items()])
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)], F.col("_part").alias("_q"), *[_KINDS[kind][0](f"_p_{name}").over(earlier).alias(f"_p_{name}") for name, (kind, _, _) in columns.items()])
    same = F.col("_part") == F.col("_q")
    for i, k in enumerate(by):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inner = Window.partitionBy(*by, "_part").orderBy(*[F.desc(c) if descending else F.col(c) for c in order])
    out = {}
    for name, (kind, _, inclusive) in columns.items():
        whole, meet, none = _KINDS[kind]
        here = whole(f"_v_{name}").over(inner.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
        sides = (F.col(f"_p_{name}"), here) if none is None else (F.coalesce(f"_p_{name}", F.lit(none)), F.coalesce(here, F.lit(none)))
        out[name] = meet(*sides)
    return spread.join(parts, same).withColumns(out).drop(*values, *[f"_p_{name}" for name in columns], *[f"_k{i}" for i in range(len(by))], "_part", "_q")


def quantiles(df: DataFrame, value: str, shares: list[float]) -> DataFrame:
    """One row (n, q): exact quantiles at the shares as an array, interpolated between neighbours; null without rows.

    Values are counted first and run through in ranges, so no task holds all of them.
    """
    per = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("_x")).agg(F.count("*").alias("_t"))
    rows = running(per, ["_x"], {"_before": ("sum", F.col("_t"), False)})
    rows = rows.crossJoin(F.broadcast(per.agg(F.coalesce(F.sum("_t"), F.lit(0)).alias("_n"))))

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("_before") <= place) & (place < F.col("_before") + F.col("_t")), F.col("_x")))

    out = []
    for share in shares:
        h = (F.col("_n") - 1) * F.lit(float(share))
        low = F.floor(h)
        part = F.max(h - low)
        out.append(at(low) + part * (at(F.least(low + 1, F.col("_n") - 1)) - at(low)))
    return rows.agg(F.max("_n").alias("n"), F.array(*out).alias("q"))
