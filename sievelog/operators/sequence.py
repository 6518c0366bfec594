"""Ordered operators over very long per-key sequences.

A host can hold a third of all lines, so no window here is partitioned by host alone. Lines are cut into
(key, time chunk, slot) pieces; what a piece needs from earlier pieces (row count, last row, running sums) comes
from a summary with one row per piece. Chunks have a fixed width in time; a chunk with more lines than a piece may hold
is split at its quantiles, so pieces are bounded also where all lines of a host fall into one second.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sievelog.functions.values import micros
from sievelog.operators.lookup import null_safe

CHUNK_MICROS = 5 * 60 * 1_000_000
BLOCK_ROWS = 100_000
#: Lines of a piece, and the most slots a chunk is split into (a power of two).
PIECE_ROWS, SLOTS = 500_000, 1024


def _chunked(df: DataFrame, ts: str, chunk_micros: int) -> DataFrame:
    """Lines without a time form the last chunk."""
    chunk = F.floor(micros(F.col(ts)) / F.lit(chunk_micros)).cast("bigint")
    return df.withColumn("_chunk", F.coalesce(chunk, F.lit(2**62)))


def pieces(df: DataFrame, keys: list[str], ts: str, tie: str, chunk_micros: int = CHUNK_MICROS, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Adds `_chunk` and `_slot`: pieces in the order of (ts, tie), of about `piece_rows` lines at most.

    Only chunks with more lines look further: quantiles of their lines' places (time within the chunk, then tie within the
    chunk's range of ties) by one sketch a chunk, and each line's place among those cuts. A tie that is no integer does
    not split lines of one time. Equal places stay together, and a chunk has SLOTS slots at most.
    """
    rows = _chunked(df, ts, chunk_micros)
    whole = dict(df.dtypes)[tie] in ("tinyint", "smallint", "int", "bigint")
    number = F.col(tie).cast("bigint") if whole else F.lit(0).cast("bigint")
    narrow = rows.select(*keys, "_chunk", F.col(ts).alias("_ts"), number.alias("_tie"))
    heavy = (narrow.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_n"), F.min("_tie").alias("_low"), F.max("_tie").alias("_high"))
             .filter(F.col("_n") > piece_rows))

    def place(time, order):
        """Time in the chunk above the tie's share of its range, as one number of 62 bits at most."""
        bits = 62 - chunk_micros.bit_length()
        span = F.col("_high").cast("double") - F.col("_low") + 1
        return (F.coalesce(F.pmod(micros(time), F.lit(chunk_micros)), F.lit(0)) * F.lit(1 << bits)
                + F.least(F.floor((order.cast("double") - F.col("_low")) / span * float(1 << bits)), F.lit((1 << bits) - 1)))

    parts = [i / SLOTS for i in range(1, SLOTS)]
    cuts = (null_safe(narrow, heavy, [*keys, "_chunk"]).groupBy(*keys, "_chunk")
            .agg(F.percentile_approx(place(F.col("_ts"), F.col("_tie")), parts, 10 * SLOTS).alias("_cuts"), F.first("_n").alias("_n"),
                 F.first("_low").alias("_low"), F.first("_high").alias("_high")))
    told = null_safe(rows, cuts, [*keys, "_chunk"], "left")
    # the number of cuts at or below a line, by halving; a piece takes as many slots as fill it
    steps = F.array(*[F.lit(SLOTS >> k) for k in range(1, SLOTS.bit_length())])
    below = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get("_cuts", at + step - 1) <= F.col("_place"), at + step).otherwise(at))
    slot = F.floor(below * F.ceil(2 * F.col("_n") / F.lit(piece_rows)) / F.lit(SLOTS))
    return (told.withColumn("_place", F.when(F.col("_cuts").isNotNull(), place(F.col(ts), number)))
            .withColumn("_slot", F.when(F.col("_cuts").isNull(), 0).otherwise(slot).cast("int"))
            .drop("_place", "_cuts", "_n", "_low", "_high"))


def with_previous(df: DataFrame, keys: list[str], ts: str, tie: str, values: list[str],
                  latest: dict[str, Column] | None = None, chunk_micros: int = CHUNK_MICROS,
                  piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Adds `seq` (1-based position inside the key), `prev_<value>` of the line before, and for every entry of
    `latest` the newest non-null value of that expression on any earlier line.

    One shuffle of the lines, on their piece; the summary that links pieces has one row per piece and reads
    only the columns it needs.
    """
    latest = latest or {}
    piece = [*keys, "_chunk", "_slot"]
    rows = pieces(df, keys, ts, tie, chunk_micros, piece_rows).withColumns({f"_e_{n}": e for n, e in latest.items()})
    order = F.struct(ts, tie)
    by_key = Window.partitionBy(*keys).orderBy("_chunk", "_slot")
    earlier = by_key.rowsBetween(Window.unboundedPreceding, -1)
    ends = [F.max_by(F.struct(*values), order).alias("_last")] if values else []
    ends += [F.max_by(f"_e_{n}", F.when(F.col(f"_e_{n}").isNotNull(), order)).alias(f"_end_{n}") for n in latest]
    links = (rows.groupBy(*piece).agg(F.count(F.lit(1)).alias("_n"), *ends)
             .select(*piece,
                     F.coalesce(F.sum("_n").over(earlier), F.lit(0)).cast("bigint").alias("_before"),
                     *([F.lag("_last").over(by_key).alias("_carry")] if values else []),
                     *[F.last(f"_end_{n}", True).over(earlier).alias(f"_from_{n}") for n in latest]))
    inside = Window.partitionBy(*piece).orderBy(ts, tie)
    above = inside.rowsBetween(Window.unboundedPreceding, -1)
    out = (null_safe(rows, links, piece).withColumn("_pos", F.row_number().over(inside))
           .withColumns({f"_lag_{v}": F.lag(v).over(inside) for v in values})
           .withColumns({f"_up_{n}": F.last(f"_e_{n}", True).over(above) for n in latest}))
    new = {"seq": (F.col("_before") + F.col("_pos")).cast("bigint")}
    for v in values:
        new[f"prev_{v}"] = F.when(F.col("_pos") > 1, F.col(f"_lag_{v}")).otherwise(F.col(f"_carry.{v}"))
    for n in latest:
        new[n] = F.coalesce(f"_up_{n}", f"_from_{n}")
    return out.withColumns(new).select(*df.columns, *new)


def rolling_mean(df: DataFrame, keys: list[str], value: str, rows: int, name: str,
                 block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Mean of the last `rows` lines by `seq`. Blocks have a fixed number of lines, and the tail of a block is
    copied into the next one, so every task has the same size however long the key is."""
    at = F.col("seq") - 1
    block = F.floor(at / F.lit(block_rows)).cast("bigint")
    is_tail = at % block_rows >= block_rows - (rows - 1)
    spread = (df.withColumn("_home", block)
              .withColumn("_block", F.explode(F.when(is_tail, F.array("_home", F.col("_home") + 1))
                                              .otherwise(F.array("_home")))))
    frame = Window.partitionBy(*keys, "_block").orderBy("seq").rowsBetween(-(rows - 1), 0)
    return (spread.withColumn(name, F.avg(F.col(value).cast("double")).over(frame))
            .filter(F.col("_home") == F.col("_block")).drop("_home", "_block"))


def span_chunks(span_micros: int, chunk_micros: int) -> int:
    """Into how many chunks of equal width a span is cut: the least number that divides it with chunks of at most
    `chunk_micros`, looked for up to sixteen times as fine; else the largest below that divides it."""
    least = -(-span_micros // chunk_micros)
    finer = (k for k in range(least, 16 * least) if span_micros % k == 0)
    return next(finer, None) or next(k for k in range(least, 0, -1) if span_micros % k == 0)


def trailing_sums(df: DataFrame, keys: list[str], ts: str, sums: dict[str, Column], span_micros: int,
                  chunk_micros: int = CHUNK_MICROS) -> DataFrame:
    """Sums over the trailing time span (t - span, t], peers included, as a table keyed by (keys, _us).

    The span is a whole number of chunks, so it consists of the end of one chunk (what lies after t - span there), the
    whole chunks between, and the start of the chunk of t. Each part is added up on its own and nothing is subtracted: a
    sum of fractions carries no error from lines outside its span, however long the key is. A sum is null when no line of
    the span has a value. Lines without a time have one row of their own, with the sum over all of them.
    """
    names = list(sums)
    pieces_in_span = span_chunks(span_micros, chunk_micros)
    width = F.lit(span_micros // pieces_in_span)
    base = (df.withColumn("_us", micros(F.col(ts))).groupBy(*keys, "_us")
            .agg(*[F.sum(e).alias(n) for n, e in sums.items()]))
    # the place t of a line, and for its end of the span the place t - span, with nothing to add
    at = F.explode(F.array(F.struct(F.lit(0).alias("_mark"), F.col("_us").alias("_at")),
                           F.struct(F.lit(1).alias("_mark"), (F.col("_us") - span_micros).alias("_at")))).alias("_p")
    points = base.select(*keys, "_us", at, *names).select(
        *keys, "_us", "_p.*", F.floor(F.col("_p._at") / width).cast("bigint").alias("_chunk"),
        *[F.when(F.col("_p._mark") == 0, F.col(n)).alias(n) for n in names])
    upto = Window.partitionBy(*keys, "_chunk").orderBy("_at", "_mark").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*keys, "_chunk").orderBy(F.col("_at").desc(), F.col("_mark").desc()).rowsBetween(Window.unboundedPreceding, 0)
    parts = points.select(*keys, "_us", "_mark", *[
        F.when(F.col("_mark") == 0, F.sum(n).over(upto)).otherwise(F.sum(n).over(after)).alias(n) for n in names])
    edges = parts.groupBy(*keys, "_us").agg(*[
        F.max(F.when(F.col("_mark") == m, F.col(n))).alias(f"_{m}_{n}") for n in names for m in (0, 1)])
    edges = edges.withColumn("_chunk", F.floor(F.col("_us") / width).cast("bigint"))
    if pieces_in_span > 1:
        between = Window.partitionBy(*keys).orderBy("_chunk").rangeBetween(1 - pieces_in_span, -1)
        whole = (base.withColumn("_chunk", F.floor(F.col("_us") / width).cast("bigint")).groupBy(*keys, "_chunk")
                 .agg(*[F.sum(n).alias(n) for n in names])
                 .select(*keys, "_chunk", *[F.when(F.col("_chunk").isNotNull(), F.sum(n).over(between)).alias(f"_2_{n}") for n in names]))
        edges = null_safe(edges, whole, [*keys, "_chunk"])
    marks = (1, 2, 0) if pieces_in_span > 1 else (1, 0)

    def total(n: str) -> Column:
        zero = F.lit(0).cast(base.schema[n].dataType)
        found = [F.col(f"_{m}_{n}") for m in marks]
        return F.when(F.coalesce(*found).isNotNull(), sum([F.coalesce(c, zero) for c in found[1:]], F.coalesce(found[0], zero)))
    return edges.select(*keys, "_us", *[total(n).cast(base.schema[n].dataType).alias(n) for n in names])


def newest(df: DataFrame, keys: list[str], ts: str, tie: str, n: int,
           chunk_micros: int = CHUNK_MICROS, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """The newest n rows of every key, for large n: rows per piece give the piece in which the n-th newest row
    lies; newer pieces pass whole, only that one piece is ranked. Lines without a time count as the newest."""
    piece = [*keys, "_chunk", "_slot"]
    rows = pieces(df, keys, ts, tie, chunk_micros, piece_rows)
    back = (Window.partitionBy(*keys).orderBy(F.col("_chunk").desc(), F.col("_slot").desc())
            .rowsBetween(Window.unboundedPreceding, -1))
    edges = (rows.groupBy(*piece).agg(F.count(F.lit(1)).alias("_n"))
             .withColumn("_newer", F.coalesce(F.sum("_n").over(back), F.lit(0)))
             .filter(F.col("_newer") < n))
    kept = null_safe(rows, edges, piece)
    whole = kept.filter(F.col("_newer") + F.col("_n") <= n)
    rank = F.row_number().over(Window.partitionBy(*piece).orderBy(F.col(ts).desc(), F.col(tie).desc()))
    partial = (kept.filter(F.col("_newer") + F.col("_n") > n).withColumn("_rank", rank)
               .filter(F.col("_rank") <= n - F.col("_newer")).drop("_rank"))
    return whole.unionByName(partial).drop("_chunk", "_slot", "_n", "_newer")


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of every key. Up to the window-group-limit threshold Spark keeps a per-task heap of n
    rows before its shuffle, so a hot key costs n rows per task."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")
