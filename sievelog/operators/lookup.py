"""Joins of an aggregate or dimension back to its facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def attach(facts: DataFrame, lookup: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join a lookup back to its facts. Nothing runs and nothing is held while the plan is built: Spark broadcasts the
    lookup when its measured bytes are below the session's limit, and else shuffles both sides and splits hot keys."""
    return facts.join(lookup, on, how)


def null_safe(rows: DataFrame, links: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join on keys of which null equals null; the keys stay once."""
    named = links.select(*[F.col(k).alias(f"_on_{k}") for k in on], *[c for c in links.columns if c not in on])
    same = [F.col(k).eqNullSafe(F.col(f"_on_{k}")) for k in on]
    return rows.join(named, same, how).drop(*[f"_on_{k}" for k in on])


def with_count(df: DataFrame, key: list[str], name: str) -> DataFrame:
    """Rows per key on every row: one map-side combined aggregate joined back, never a window over the key."""
    counts = df.groupBy(*key).agg(F.count(F.lit(1)).alias(name))
    renamed = counts.select(*[F.col(k).alias(f"_k_{k}") for k in key], name)
    joined = attach(df.withColumns({f"_k_{k}": F.col(k) for k in key}), renamed, [f"_k_{k}" for k in key])
    return joined.withColumn(name, F.coalesce(F.col(name), F.lit(0).cast("bigint"))).drop(*[f"_k_{k}" for k in key])
