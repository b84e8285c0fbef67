"""Latency statistics over timings, and a small runner that makes them."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest_rank(df: DataFrame, group: list[str], value: str, shares: dict[str, float], parts: int = 1024) -> DataFrame:
    """Mean and nearest-rank percentiles of each group: the value at round(share * (n - 1)), half to even.

    Values are counted, cut into ``parts`` ranges of a group, and the ranges counted; ranks are then sought in the ranges that
    hold them alone. So a task sees a group's ranges, or one range's distinct values, and never a whole group.
    """
    keys = [f"_g{k}" for k in range(len(group))]
    counted = df.where(F.col(value).isNotNull()).groupBy(*(F.col(g).alias(k) for g, k in zip(group, keys)), F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    steps = [1 << k for k in range((parts - 1).bit_length() - 1, -1, -1)]
    cuts = counted.groupBy(*keys).agg(F.percentile_approx("_v", [k / parts for k in range(1, parts)], 10 * parts).alias("_cuts"))
    cuts = cuts.select(*(F.col(k).alias(f"{k}_") for k in keys), "_cuts")
    same = lambda: reduce(and_, (F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys))
    part = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda low, step: F.when(F.get("_cuts", low + step - 1) <= F.col("_v"), low + step).otherwise(low))
    dealt = counted.join(cuts, same()).select(*keys, "_v", "_n", part.alias("_part"))
    sizes = dealt.groupBy(*keys, "_part").agg(F.sum("_n").alias("_size"), F.sum(F.col("_v") * F.col("_n")).alias("_sum"))
    by = Window.partitionBy(*keys)
    upto = sizes.withColumns({"_upto": F.sum("_size").over(by.orderBy("_part")), "_all": F.sum("_size").over(by), "_total": F.sum("_sum").over(by)})
    at = lambda share: F.bround(F.lit(share) * (F.col("_all") - 1), 0) + 1
    wanted = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), at(s).alias("at")) for name, s in shares.items())))
    held = upto.select("*", wanted.alias("_w")).where((F.col("_w.at") <= F.col("_upto")) & (F.col("_w.at") > F.col("_upto") - F.col("_size")))
    held = held.select(*(F.col(k).alias(f"{k}_") for k in keys), F.col("_part").alias("_part_"), "_w.name", (F.col("_w.at") - F.col("_upto") + F.col("_size")).alias("_at"), (F.col("_total") / F.col("_all")).alias("_avg"))
    inside = dealt.join(held, same() & (F.col("_part") == F.col("_part_"))).withColumn("_upto", F.sum("_n").over(Window.partitionBy(*keys, "_part", "name").orderBy("_v")))
    out = inside.where(F.col("_upto") >= F.col("_at")).groupBy(*keys)
    picks = [F.min(F.when(F.col("name") == name, F.col("_v"))).alias(name) for name in shares]
    return out.agg(F.first("_avg").alias("avg"), *picks).withColumnsRenamed(dict(zip(keys, group)))


def rounded_ms(c: Column) -> Column:
    return F.bround(c, 1)


def timed(run: Callable[[], object], times: int = 6, warm_up: int = 1) -> dict[str, float]:
    """Milliseconds of ``run``: average, median and 95th percentile by nearest rank."""
    for _ in range(warm_up):
        run()
    took = []
    for _ in range(times):
        began = time.perf_counter()
        run()
        took.append((time.perf_counter() - began) * 1000)
    took.sort()
    rank = lambda share: took[max(0, min(len(took) - 1, round(share * (len(took) - 1))))]
    return {"total_avg": round(sum(took) / len(took), 1), "total_p50": round(rank(0.5), 1), "total_p95": round(rank(0.95), 1)}
