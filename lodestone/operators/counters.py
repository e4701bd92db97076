"""Counters, rates and alerts over metric samples, and their text exposition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .buckets import DAY_US, with_previous, with_running_sum

# The metrics of the exposition, in order, with kind and help.
METRICS = (
    ("connections_total", "counter", "Total number of connections accepted."),
    ("active_connections", "gauge", "Current number of active connections."),
    ("uploads_total", "counter", "Total number of file uploads."),
    ("downloads_total", "counter", "Total number of file downloads."),
    ("deletes_total", "counter", "Total number of file deletes."),
    ("replication_total", "counter", "Total number of replication operations."),
    ("errors_total", "counter", "Total number of errors."),
    ("bytes_uploaded_total", "counter", "Total bytes uploaded."),
    ("bytes_downloaded_total", "counter", "Total bytes downloaded."),
)


# Help of a process's own metrics.
PROCESS_HELP = {
    "uptime_seconds": "Server uptime in seconds.", "goroutines": "Current number of goroutines.", "memory_alloc_bytes": "Allocated memory in bytes.",
    "memory_sys_bytes": "System memory in bytes.", "gc_runs_total": "Total number of GC runs.", "build_info": "Build information.",
}


def totals(samples: DataFrame, instance: str = "user_id") -> DataFrame:
    """Counters of each instance from its events; open and closed connections make the gauge."""
    kind = F.col("event_type")
    amount = F.col("value").cast("bigint")
    return samples.groupBy(F.col(instance).alias("instance")).agg(
        F.count(F.lit(1)).alias("connections_total"), (F.count_if(kind == "signup") - F.count_if(kind == "error")).alias("active_connections"),
        F.count_if(kind == "purchase").alias("uploads_total"), F.count_if(kind == "view").alias("downloads_total"), F.count_if(kind == "error").alias("deletes_total"),
        F.count_if(kind == "click").alias("replication_total"), F.count_if(kind == "error").alias("errors_total"),
        F.coalesce(F.sum(F.when(kind == "purchase", amount)), F.lit(0)).alias("bytes_uploaded_total"), F.coalesce(F.sum(F.when(kind == "view", amount)), F.lit(0)).alias("bytes_downloaded_total"),
    )


def exposition(counted: DataFrame, prefix: str = "store") -> DataFrame:
    """``line_no, line``: help, type and value of every metric, summed over instances."""
    sums = counted.agg(*(F.sum(m).alias(m) for m, _, _ in METRICS))
    lines: list[Column] = []
    for m, kind, text in METRICS:
        name = f"{prefix}_{m}"
        lines += [F.lit(f"# HELP {name} {text}"), F.lit(f"# TYPE {name} {kind}"), F.concat(F.lit(f"{name} "), F.col(m).cast("string"))]
    return sums.select(F.posexplode(F.array(*lines)).alias("line_no", "line"))


def rates(samples: DataFrame, when: Column, range_s: int, step_s: int, ts_us: str = "ts_us", by: str = "user_id") -> DataFrame:
    """``by, window_end, per_second``: events that ``when`` picks, in windows of ``range_s`` every ``step_s``.

    A plain count by the range; no extrapolation to its ends.
    """
    step, span = step_s * 1_000_000, range_s // step_s
    first = F.floor(F.col(ts_us) / step) + 1
    ends = F.explode(F.sequence(first, first + (span - 1)))
    return samples.where(when).select(by, ends.alias("w")).groupBy(by, "w").agg(F.count(F.lit(1)).alias("n")).select(by, (F.col("w") * step).alias("window_end_us"), (F.col("n") / range_s).alias("per_second"))


def gauges(samples: DataFrame, by: str, value: Column, bad: Column) -> DataFrame:
    """``by, total, mebibytes, error_percent``: a gauge summed over instances, its sum in mebibytes, and the share of bad samples."""
    total = F.sum(value)
    return samples.groupBy(by).agg(total.alias("total"), (total / F.lit(1048576.0)).alias("mebibytes"), (F.lit(100.0) * F.count_if(bad) / F.count(F.lit(1))).alias("error_percent"))


#: The answer of a health check.
HEALTH = "OK"


def process_lines(prefix: str, uptime_s: float, tasks: int, alloc: int, reserved: int, gc_runs: int, host: str) -> list[str]:
    """The lines of a process's own six metrics, after those of ``exposition``."""
    rows = (("uptime_seconds", "gauge", f"{uptime_s:.2f}"), ("goroutines", "gauge", tasks), ("memory_alloc_bytes", "gauge", alloc), ("memory_sys_bytes", "gauge", reserved), ("gc_runs_total", "counter", gc_runs))
    out = [x for (name, kind, value) in rows for x in (f"# HELP {prefix}_{name} {PROCESS_HELP[name]}", f"# TYPE {prefix}_{name} {kind}", f"{prefix}_{name} {value}")]
    return [*out, f"# HELP {prefix}_build_info {PROCESS_HELP['build_info']}", f"# TYPE {prefix}_build_info gauge", f'{prefix}_build_info{{hostname="{host}"}} 1']


def increase(samples: DataFrame, by: str, ts: str, value: str, bucket: Column | None = None) -> DataFrame:
    """The growth of counters that may start anew from 0: a fall counts the new value whole.

    ``bucket`` cuts the order of a hot key; by default into days, if ``ts`` is in microseconds.
    """
    rows = with_previous(samples, [by], [ts], F.struct(F.col(value).alias("v")), F.floor(F.col(ts) / DAY_US) if bucket is None else bucket, "__p")
    before = F.col("__p.v")
    step = F.when(before.isNull(), 0).when(F.col(value) < before, F.col(value)).otherwise(F.col(value) - before)
    return rows.withColumn("__d", step).groupBy(by).agg(F.sum("__d").alias("increase"))


def alerts(series: DataFrame, fires: Column, hold_us: int, by: str, ts: str, bucket: Column | None = None) -> DataFrame:
    """``by, since, until``: stretches of consecutive samples where ``fires`` holds, at least ``hold_us`` long.

    An island's samples share the count of quiet ones before them.
    """
    cut = F.floor(F.col(ts) / DAY_US) if bucket is None else bucket
    counted = with_running_sum(series.withColumn("__f", fires), [by], [ts], F.when(F.col("__f"), 0).otherwise(1), cut, "__g")
    islands = counted.where("__f").groupBy(by, "__g").agg(F.min(ts).alias("since"), F.max(ts).alias("until"))
    return islands.where(F.col("until") - F.col("since") >= hold_us).select(by, "since", "until")
