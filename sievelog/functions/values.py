"""Time, numeric and nested-value column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sievelog.functions.text import extract_int

RELATIVE_HOURS = {"last_hour": 1, "last_day": 24, "last_week": 168, "last_month": 720}
TIMESTAMP_FORMATS = [
    "yyyy-MM-dd'T'HH:mm:ss,SSS", "yyyy-MM-dd HH:mm:ss.SS", "yyyy-MM-dd HH:mm:ss.SSS", "yyyy-MM-dd HH:mm:ss",
]


def micros(ts: Column) -> Column:
    """Microseconds since the epoch; works for both timestamp types under a UTC session."""
    return F.unix_micros(ts.cast("timestamp"))


def parse_timestamp(text: Column, fallback: Column | None = None) -> Column:
    """ISO text, or one of a list of formats; what cannot be read is null or the fallback."""
    tries = [F.try_to_timestamp(text)] + [F.try_to_timestamp(text, F.lit(f)) for f in TIMESTAMP_FORMATS]
    return F.coalesce(*tries, *([fallback] if fallback is not None else []))


def is_weekend(ts: Column) -> Column:
    return (F.weekday(ts) >= 5).cast("int")


def local_time(ts: Column, offset_hours: int = 3) -> Column:
    return ts + F.make_dt_interval(hours=F.lit(offset_hours))


def is_business_hours(ts: Column, start: int = 8, end: int = 18) -> Column:
    return ((F.hour(ts) >= start) & (F.hour(ts) < end) & (F.weekday(ts) < 5)).cast("int")


def is_night(ts: Column, start: int = 0, end: int = 6) -> Column:
    return ((F.hour(ts) >= start) & (F.hour(ts) < end)).cast("int")


def time_slice(ts: Column, minutes: int) -> Column:
    """Start of the fixed-width slice, in microseconds since the epoch."""
    width = minutes * 60_000_000
    return (F.floor(micros(ts) / F.lit(width)) * width).cast("bigint")


def slice_minutes(range_hours: float) -> int:
    """Slice width by range length."""
    return 30 if range_hours <= 24 else 60 if range_hours <= 168 else 240


def bucket_label(ts: Column, days: int) -> Column:
    """Hourly labels up to three days, daily beyond."""
    if days <= 3:
        return F.date_format(F.date_trunc("hour", ts.cast("timestamp")), "yyyy-MM-dd'T'HH:00")
    return F.date_format(ts, "yyyy-MM-dd")


def hour_label(text: Column) -> Column:
    """Hour by position in an ISO string, ?? when the string is too short."""
    return F.when(F.length(text) >= 13, F.substring(text, 12, 2)).otherwise("??")


def since(ts: Column, reference: Column, keyword: str) -> Column:
    return ts >= reference - F.make_dt_interval(hours=F.lit(RELATIVE_HOURS[keyword]))


# ---- numbers ----

def metric_of(attr: Column, texts: list[Column], name: str) -> Column:
    """A number from the attribute object, else from the first text that carries it, else 0."""
    tries = [F.try_variant_get(attr, f"$.{name}", "bigint")]
    tries += [extract_int(t, f'"{name}":(\\d+)', default=None) for t in texts]
    return F.coalesce(*tries, F.lit(0).cast("bigint"))


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, 0 where the bottom is not positive."""
    return F.when(bottom > 0, top.cast("double") / bottom.cast("double")).otherwise(F.lit(0.0).cast("double"))


def performance_score(is_collscan: Column, docs: Column, keys: Column) -> Column:
    return F.when(is_collscan == 1, docs * 2).otherwise(F.greatest(F.lit(0).cast("bigint"), docs - keys))


def severity_level(score: Column) -> Column:
    return (F.when(score >= 80, "CRITICAL").when(score >= 60, "HIGH").when(score >= 40, "MEDIUM")
            .when(score >= 20, "LOW").otherwise("INFO"))


def risk_category(score: Column) -> Column:
    return (F.when(score < -0.8, "critical").when(score < -0.75, "high").when(score < -0.7, "medium")
            .otherwise("low"))


# ---- ordered series held in an array (bounded: one value per past analysis, never per log line) ----

def _at(arr: Column, i: Column) -> Column:
    return F.try_element_at(arr, i.cast("int"))


def _fsum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0).cast("double"), lambda a, v: a + v)


def series_mean(arr: Column) -> Column:
    return F.when(F.size(arr) > 0, _fsum(arr) / F.size(arr)).otherwise(F.lit(0.0).cast("double"))


def series_std(arr: Column) -> Column:
    """Sample standard deviation, 0 below two values."""
    mean = series_mean(arr)
    square = F.aggregate(arr, F.lit(0.0).cast("double"), lambda a, v: a + (v - mean) * (v - mean))
    return F.when(F.size(arr) >= 2, F.sqrt(square / (F.size(arr) - 1))).otherwise(F.lit(0.0).cast("double"))


def weighted_mean(arr: Column) -> Column:
    """Linear weights 1..n, the newest value heaviest."""
    n = F.size(arr)
    top = _fsum(F.transform(arr, lambda v, i: v * (i + 1)))
    return F.when(n > 0, top / (n * (n + 1) / 2)).otherwise(F.lit(0.0).cast("double"))


def ewma_last(arr: Column, alpha: float) -> Column:
    """Last value of the exponentially weighted mean, seeded with the first value."""
    rest = F.slice(arr, 2, F.greatest(F.size(arr) - 1, F.lit(0)))
    return F.aggregate(rest, _at(arr, F.lit(1)), lambda acc, v: F.lit(alpha) * v + F.lit(1 - alpha) * acc)


def ewma_series(arr: Column, alpha: float) -> Column:
    step = lambda acc, v: F.array_append(
        acc, F.when(F.size(acc) == 0, v).otherwise(F.lit(alpha) * v + F.lit(1 - alpha) * F.element_at(acc, -1)))
    return F.aggregate(arr, F.array().cast("array<double>"), step)


def robust_baseline(df: DataFrame, arr: str) -> DataFrame:
    """Adds centre and spread of an array column: from four values on the mean inside 1.5 IQR (quartiles by index),
    else median and standard deviation. Staged, so that the sorted array and its quartiles are computed once."""
    n = F.size(arr)
    half, s = F.floor(n / 2), F.col("_sorted")
    zero = F.lit(0.0).cast("double")
    df = df.withColumn("_sorted", F.array_sort(arr)).withColumns({
        "_q1": _at(s, F.floor(n / 4) + 1), "_q3": _at(s, F.floor(F.lit(3) * n / 4) + 1),
        "_median": F.when(n % 2 == 1, _at(s, half + 1)).otherwise((_at(s, half) + _at(s, half + 1)) / 2)})
    q1, q3 = F.col("_q1"), F.col("_q3")
    iqr = q3 - q1
    df = df.withColumn("_inside", F.filter(s, lambda v: (v >= q1 - F.lit(1.5) * iqr) & (v <= q3 + F.lit(1.5) * iqr)))
    mean = F.when(F.size("_inside") > 0, _fsum(F.col("_inside")) / F.size("_inside")).otherwise(F.col("_median"))
    return df.withColumns({
        "centre": F.when(n == 0, zero).when(n < 4, F.col("_median")).otherwise(mean),
        "spread": F.when(n == 0, zero).when((n < 4) | (iqr <= 0), series_std(F.col(arr))).otherwise(iqr / 2),
    }).drop("_sorted", "_q1", "_q3", "_median", "_inside")


def cusum_changes(arr: Column, mean: Column, std: Column) -> Column:
    """Positions (from 0) of change points: drift half a sigma, threshold three sigma, sums reset on a hit. Mean and
    deviation are columns of the row, so that they are not recomputed for every element."""
    zero = F.lit(0.0).cast("double")

    def step(acc, v):
        up = F.greatest(zero, acc["up"] + v - mean - std * 0.5)
        down = F.greatest(zero, acc["down"] - v + mean - std * 0.5)
        hit = (up > std * 3) | (down > std * 3)
        return F.struct(
            F.when(hit, zero).otherwise(up).alias("up"), F.when(hit, zero).otherwise(down).alias("down"),
            (acc["i"] + 1).alias("i"),
            F.when(hit, F.array_append(acc["hits"], acc["i"])).otherwise(acc["hits"]).alias("hits"))

    none = F.array().cast("array<int>")
    start = F.struct(zero.alias("up"), zero.alias("down"), F.lit(1).alias("i"), none.alias("hits"))
    rest = F.slice(arr, 2, F.greatest(F.size(arr) - 1, F.lit(0)))
    return F.when((F.size(arr) < 4) | (std == 0), none).otherwise(F.aggregate(rest, start, step)["hits"])


def regression(arr: Column) -> dict[str, Column]:
    """Least squares of the values on their positions 0..n-1."""
    n = F.size(arr).cast("double")
    sx, sxx = n * (n - 1) / 2, (n - 1) * n * (2 * n - 1) / 6
    sxy = _fsum(F.transform(arr, lambda v, i: v * i))
    slope = F.when(n < 2, F.lit(0.0)).otherwise((n * sxy - sx * _fsum(arr)) / (n * sxx - sx * sx))
    return {"slope": slope.cast("double"), "mean_x": (sx / n).cast("double")}


def r_squared(arr: Column, mean: Column, slope: Column, intercept: Column) -> Column:
    total = _fsum(F.transform(arr, lambda v: (v - mean) * (v - mean)))
    rest = _fsum(F.transform(arr, lambda v, i: (v - slope * i - intercept) * (v - slope * i - intercept)))
    return F.when((total > 0) & (F.size(arr) >= 2), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - rest / total))).otherwise(
        F.lit(0.0)).cast("double")


def interval_margin(arr: Column, slope: Column, intercept: Column, at_x: Column, t_value: float = 2.0) -> Column:
    """Half width of the regression prediction interval at position at_x."""
    n = F.size(arr).cast("double")
    rest = _fsum(F.transform(arr, lambda v, i: (v - slope * i - intercept) * (v - slope * i - intercept)))
    se = F.sqrt(rest / (n - 2))
    mean_x = (n - 1) / 2
    sxx = n * (n * n - 1) / 12
    return F.lit(t_value) * se * F.sqrt(F.lit(1.0) + F.lit(1.0) / n + (at_x - mean_x) * (at_x - mean_x) / sxx)


def residual_consistency(arr: Column, slope: Column, intercept: Column) -> Column:
    """1 minus the distance of the Durbin-Watson value from 2, less a penalty when the last three residuals
    share a sign."""
    res = F.transform(arr, lambda v, i: v - (slope * i + intercept))
    n = F.size(arr)
    steps = F.zip_with(F.slice(res, 2, F.greatest(n - 1, F.lit(0))), F.slice(res, 1, F.greatest(n - 1, F.lit(0))),
                       lambda a, b: (a - b) * (a - b))
    total = _fsum(F.transform(res, lambda r: r * r))
    last3 = F.slice(res, -3, 3)
    biased = F.forall(last3, lambda r: r > 0) | F.forall(last3, lambda r: r < 0)
    score = F.greatest(F.lit(0.0), F.lit(1.0) - F.abs(_fsum(steps) / total - 2) / 2)
    penalised = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score - F.when(biased, 0.15).otherwise(0.0)))
    return F.when(n < 4, F.lit(0.5)).when(total == 0, F.lit(1.0)).otherwise(penalised).cast("double")


def hour_runs(hours: Column) -> Column:
    """Runs of at least three consecutive hours, as 'first-last' strings."""
    s = F.array_sort(F.array_distinct(hours))
    starts = F.filter(s, lambda h: ~F.array_contains(s, h - 1))
    ends = F.filter(s, lambda h: ~F.array_contains(s, h + 1))
    runs = F.zip_with(starts, ends, lambda a, b: F.when(b - a >= 2, F.concat_ws("-", a, b)))
    return F.array_compact(runs)
