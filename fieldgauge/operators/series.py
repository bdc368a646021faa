"""Time series of samples: bucket means, rates, percentiles and interpolation.

Ordered operators cut a series into spans of the time axis, a day each, and a day with many samples into spans of about equal
row counts, by a counted histogram of it. Each span is ordered on its own, and what crosses a span border is carried over from
one row per span, so a run, or a day, that holds most samples is still spread over many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_POINTS = 500
SPAN = 86_400.0
# Rows of a span; a span ends with the slice that passes them. Slices of a day are its histogram, of 1.3 seconds each.
SPAN_ROWS, SLICES = 1 << 20, 1 << 16
# Bins of one step of refinement: after two steps a bin of 3 % of a value holds some 2^16 different doubles at most.
NARROWER = 1 << 16
# Fixed values of the run summary: bytes of an empty database, and the full vehicle year.
EMPTY_DB_MB = 18
FULL_RUN_UNITS = 1500 * 365


def bucket_width(duration: float, max_points: int = MAX_POINTS) -> int:
    """Width that keeps a series under max_points buckets."""
    return max(1, math.ceil(duration / max_points))


def sample_window(samples: DataFrame, t: str, end: float, before: float = 5.0, after: float = 20.0) -> DataFrame:
    """Samples from shortly before the start to shortly after the end."""
    return samples.where(F.col(t).between(-before, end + after))


def load_window(samples: DataFrame, t: str, end: float) -> DataFrame:
    return samples.where(F.col(t).between(0, end))


def clean_worker_cpu(samples: DataFrame, cpu: str, memory: str) -> DataFrame:
    """A worker that is gone (no memory, or a negative delta) has no CPU use."""
    meaningless = (F.col(memory) <= 0) | (F.col(cpu) < 0)
    return samples.withColumn(cpu, F.when(meaningless, 0.0).otherwise(F.col(cpu)))


def bucket_means(samples: DataFrame, t: str, bucket: Column | float, metrics: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Mean of each metric per time bucket, placed at the bucket's centre."""
    width = bucket if isinstance(bucket, Column) else F.lit(bucket)
    staged = samples.withColumn("_w", width).withColumn("_b", F.floor(F.col(t) / F.col("_w")))
    means = staged.groupBy(*keys, "_b", "_w").agg(*[F.avg(m).alias(m) for m in metrics])
    return means.select(*keys, ((F.col("_b") + 0.5) * F.col("_w")).alias("t"), *metrics)


def weighted_mean(weight: Column, value: Column, floor: float = 1.0) -> Column:
    """Sum of weight times value over the weights, which count as at least `floor`."""
    return F.coalesce(F.sum(weight * value), F.lit(0.0)) / F.greatest(F.lit(floor), F.coalesce(F.sum(weight), F.lit(0.0)))


def weighted_mean_or_zero(weight: Column, value: Column) -> Column:
    total = F.sum(weight)
    return F.when(total > 0, F.sum(weight * value) / total).otherwise(0.0)


def with_spans(samples: DataFrame, run: str, t: str, span: float = SPAN, rows: int | None = None) -> DataFrame:
    """Add `_span`, a number that grows with t within a run: of the day, or of a part of a day with more than `rows` rows.

    The histogram of such days alone is joined, by slice; where there is none, adaptive execution leaves the join out.
    """
    rows = rows or SPAN_ROWS
    cut = samples.withColumn("_slice", F.floor(F.col(t) / F.lit(span / SLICES)).cast("long"))
    day = F.floor(F.col("_slice") / SLICES)
    whole = Window.partitionBy(run, "_day")
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = cut.groupBy(run, "_slice").agg(F.count("*").alias("_n")).withColumn("_day", day)
    dense = counts.withColumns({"_all": F.sum("_n").over(whole), "_part": F.floor(before / rows)}).where(F.col("_all") > rows)
    found = cut.join(dense.select(run, "_slice", "_part"), [run, "_slice"], "left")
    number = F.shiftleft(day.cast("long"), 31) + F.coalesce("_part", F.lit(0))
    return found.select(*samples.columns, number.alias("_span"))


def with_previous(samples: DataFrame, run: str, t: str, columns: Sequence[str], span: float = SPAN) -> DataFrame:
    """Add prev_<column> (and prev_<t>) of the sample before, in t order within a run.

    t is unique within a run.
    """
    fields = F.struct(F.col(t), *[F.col(c) for c in columns if c != t])
    cut = with_spans(samples, run, t, span)
    inside = Window.partitionBy(run, "_span").orderBy(t)
    across = Window.partitionBy(run).orderBy("_span")
    edges = cut.groupBy(run, "_span").agg(F.max_by(fields, F.col(t)).alias("_last"))
    carried = edges.withColumn("_carried", F.lag("_last").over(across)).drop("_last")
    joined = cut.withColumn("_near", F.lag(fields).over(inside)).join(carried, [run, "_span"])
    previous = joined.withColumn("_prev", F.coalesce("_near", "_carried"))
    names = [t, *[c for c in columns if c != t]]
    return previous.select(*samples.columns, *[F.col("_prev")[c].alias(f"prev_{c}") for c in names])


def counter_rates(samples: DataFrame, run: str, t: str, counters: Sequence[str], means: Sequence[tuple[str, str]] = (), span: float = SPAN) -> DataFrame:
    """Change per second of each counter between samples; the first sample gives nothing.

    means pairs (total time, calls) give the mean time per call, 0 without calls.
    """
    needed = list(dict.fromkeys([*counters, *[c for pair in means for c in pair]]))
    with_prev = with_previous(samples, run, t, needed, span).where(F.col(f"prev_{t}").isNotNull())
    change = lambda c: F.col(c) - F.col(f"prev_{c}")
    rates = [(change(c) / change(t)).alias(f"{c}_per_s") for c in counters]
    averages = [F.when(change(n) > 0, F.try_divide(change(total), change(n))).otherwise(0.0).alias(f"{total}_mean") for total, n in means]
    return with_prev.select(run, t, *rates, *averages)


def rolling_delta(samples: DataFrame, run: str, t: str, total: str, span: float = SPAN) -> DataFrame:
    """Total minus the total before; the first sample counts from 0."""
    with_prev = with_previous(samples, run, t, [total], span)
    return with_prev.select(run, t, (F.col(total) - F.coalesce(f"prev_{total}", F.lit(0))).alias(f"{total}_delta"))


def poll_throughput(polls: DataFrame, run: str, t: str, done: str, span: float = SPAN) -> DataFrame:
    """Files per hour between polls; the first poll counts from (0, 0)."""
    with_prev = with_previous(polls, run, t, [done], span)
    elapsed = F.greatest(F.lit(1e-6), F.col(t) - F.coalesce(f"prev_{t}", F.lit(0.0)))
    finished = F.col(done) - F.coalesce(f"prev_{done}", F.lit(0))
    return with_prev.select(run, t, done, (finished / elapsed * 3600).alias("files_per_hour"))


def overall_throughput(polls: DataFrame, run: str, t: str, done: str) -> DataFrame:
    last = F.max(done) / F.greatest(F.lit(1e-6), F.max(t)) * 3600
    return polls.groupBy(run).agg(last.alias("files_per_hour"))


def interpolate(samples: DataFrame, targets: DataFrame, run: str, t: str, y: str, span: float = SPAN) -> DataFrame:
    """Value of each run at the target times.

    Up to 0 the value is 0; before the first sample it lies on the line from the origin;
    past the last sample it stays; in between it is linear. Times are unique in samples.
    """
    point = F.struct(F.col(t).alias("t"), F.col(y).cast("double").alias("y"))
    marked = samples.select(run, F.col(t).cast("double").alias(t), point.alias("_s")).unionByName(
        targets.select(run, F.col(t).cast("double").alias(t), F.lit(None).cast("struct<t:double,y:double>").alias("_s"))
    )
    cut = with_spans(marked, run, t, span).withColumn("_rank", F.when(F.col("_s").isNull(), 0).otherwise(1))
    before_row = (Window.unboundedPreceding, -1)
    # A target sorts before a sample of the same time: its next sample is that one.
    upward = Window.partitionBy(run, "_span").orderBy(t, "_rank").rowsBetween(*before_row)
    downward = Window.partitionBy(run, "_span").orderBy(F.desc(t), F.desc("_rank")).rowsBetween(*before_row)
    edges = cut.groupBy(run, "_span").agg(F.max_by("_s", F.col("_s.t")).alias("_last"), F.min_by("_s", F.col("_s.t")).alias("_first"))
    spans_up = Window.partitionBy(run).orderBy("_span").rowsBetween(*before_row)
    spans_down = Window.partitionBy(run).orderBy(F.desc("_span")).rowsBetween(*before_row)
    carried = edges.select(
        run,
        "_span",
        F.last("_last", ignorenulls=True).over(spans_up).alias("_carried_prev"),
        F.last("_first", ignorenulls=True).over(spans_down).alias("_carried_next"),
    )
    placed = (
        cut.withColumn("_near_prev", F.last("_s", ignorenulls=True).over(upward))
        .withColumn("_near_next", F.last("_s", ignorenulls=True).over(downward))
        .where(F.col("_s").isNull())
        .join(carried, [run, "_span"])
        .withColumn("_p", F.coalesce("_near_prev", "_carried_prev"))
        .withColumn("_n", F.coalesce("_near_next", "_carried_next"))
    )
    at = F.col(t)
    linear = F.col("_p.y") + (F.col("_n.y") - F.col("_p.y")) * (at - F.col("_p.t")) / (F.col("_n.t") - F.col("_p.t"))
    value = (
        F.when(at <= 0, 0.0)
        .when(F.col("_n").isNull(), F.col("_p.y"))
        .when(F.col("_p").isNull(), F.col("_n.y") * at / F.col("_n.t"))
        .otherwise(linear)
    )
    return placed.select(run, t, value.alias(y))


def _ordered_bin(x: Column) -> Column:
    """A coarse integer that never decreases as x grows (about 3 % of x per step)."""
    step = lambda v: F.floor(F.ln(v) * 32) + 30_000
    return F.when(x > 0, step(x)).when(x < 0, -step(-x)).otherwise(0).cast("int")


def _narrowed(rows: DataFrame, keys: list[str], step: str) -> DataFrame:
    """Keep the values of the part of each key's range, cut into `NARROWER` bins, that holds the wanted rank."""
    low, high, x = (F.col(c).cast("double") for c in ("_lo", "_hi", "_x"))
    rows = rows.withColumn(step, F.coalesce(F.floor(F.try_divide(x - low, high - low) * NARROWER), F.lit(0)))
    bins = rows.groupBy(*keys, step).agg(F.sum("_n").alias("_bin_n"), F.first("_rest").alias("_rest"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    running = Window.partitionBy(*keys).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    hit = bins.withColumn("_before", F.coalesce(F.sum("_bin_n").over(running), F.lit(0)))
    hit = hit.where((F.col("_before") <= F.col("_rest")) & (F.col("_rest") < F.col("_before") + F.col("_bin_n")))
    hit = hit.select(*keys, step, (F.col("_rest") - F.col("_before")).alias("_rest"), "_lo", "_hi")
    return rows.drop("_rest", "_lo", "_hi").join(hit, [*keys, step])


def nearest_rank(samples: DataFrame, groups: Sequence[str], x: str, percentiles: dict[str, float]) -> DataFrame:
    """Nearest-rank percentiles, exact: the value at index min(n - 1, int(p * n)), and the largest.

    Equal values are counted first. The rank is then found in coarse value bins of about 3 % of a value, and the bins that hold a
    wanted rank are narrowed twice, so that no group of values, however they are spread, is ordered whole.
    """
    groups = list(groups)
    counts = samples.where(F.col(x).isNotNull()).groupBy(*groups, F.col(x).alias("_x")).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn("_bin", _ordered_bin(F.col("_x")))
    bins = counts.groupBy(*groups, "_bin").agg(F.sum("_n").alias("_bin_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    whole = Window.partitionBy(*groups)
    running = whole.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(float(p)).alias("p")) for name, p in percentiles.items()])
    hits = (
        bins.withColumn("_before", F.coalesce(F.sum("_bin_n").over(running), F.lit(0)))
        .withColumn("_total", F.sum("_bin_n").over(whole))
        .withColumn("_max", F.max("_hi").over(whole))
        .withColumn("_w", F.explode(wanted))
        .withColumn("_index", F.least(F.col("_total") - 1, F.floor(F.col("_w.p") * F.col("_total"))))
        .where((F.col("_before") <= F.col("_index")) & (F.col("_index") < F.col("_before") + F.col("_bin_n")))
        .select(*groups, "_bin", F.col("_w.name").alias("_name"), (F.col("_index") - F.col("_before")).alias("_rest"), "_total", "_max", "_lo", "_hi")
    )
    keys = [*groups, "_name"]
    rows = _narrowed(_narrowed(counts.join(hits, [*groups, "_bin"]), keys, "_step1"), keys, "_step2")
    inside = Window.partitionBy(*keys).orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("_upto", F.sum("_n").over(inside)).where((F.col("_upto") > F.col("_rest")) & (F.col("_upto") - F.col("_n") <= F.col("_rest")))
    return found.groupBy(*groups).agg(
        F.max("_total").alias("n"),
        *[F.max(F.when(F.col("_name") == name, F.col("_x"))).alias(name) for name in percentiles],
        F.max("_max").alias("max"),
    )


def run_summary(samples: DataFrame, run: str, t: str, done: str, rate: str, latency: str, load: str, load_ms: str, gauges: Sequence[str], size_mb: str) -> DataFrame:
    """One row per run: totals, rate, weighted latency, load per unit, averages and peaks."""
    total, elapsed = F.max(done), F.max(t)
    loads = F.coalesce(F.sum(load), F.lit(0.0))
    size = F.max_by(size_mb, t)
    per_run = samples.groupBy(run).agg(
        total.alias("total"),
        elapsed.alias("elapsed_s"),
        weighted_mean(F.col(rate), F.col(latency)).alias("latency_mean"),
        F.max(latency).alias("latency_max"),
        loads.alias("loads"),
        weighted_mean_or_zero(F.col(load), F.col(load_ms)).alias("load_ms_mean"),
        *[F.avg(g).alias(f"{g}_avg") for g in gauges],
        *[F.max(g).alias(f"{g}_max") for g in gauges],
        size.alias("size_mb"),
    )
    per_second = F.when(F.col("elapsed_s") != 0, F.try_divide("total", "elapsed_s")).otherwise(0.0)
    per_unit = lambda amount: F.when(F.col("total") != 0, F.try_divide(amount, F.col("total")))
    return per_run.withColumn("rate", per_second).select(
        run,
        "total",
        "elapsed_s",
        "rate",
        "latency_mean",
        "latency_max",
        F.coalesce(per_unit(F.col("loads")), F.lit(0.0)).alias("loads_per_unit"),
        "load_ms_mean",
        *[f"{g}_avg" for g in gauges],
        *[f"{g}_max" for g in gauges],
        "size_mb",
        per_unit((F.col("size_mb") - EMPTY_DB_MB) * 1024).alias("kb_per_unit"),
        F.when(F.col("rate") != 0, F.try_divide(F.lit(float(FULL_RUN_UNITS)), F.col("rate"))).alias("eta_s"),
    )
