"""Differences between two copies of a data set, field by field."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compare_copies(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    fields: Mapping[str, Column | str],
    latest: str | None = None,
    names: tuple[str, str] = ("left", "right"),
) -> DataFrame:
    """``(keys..., finding)``: ``missing_in_<side>``, or the name of each field that differs.

    Both sides are tagged, united and grouped once by ``keys``, so one shuffle serves all, and
    a key never meets more than its own rows. ``fields`` maps the reported name to the value
    compared. Of a side's rows with one key that with the greatest ``latest`` holds (null is
    least; ties: greatest fields). Null equals null only, in fields and in keys. Repeated rows
    change nothing; an empty side makes every key missing there. Other columns aren't read.
    """
    own = [f"k{i}" for i in range(len(keys))]

    def tagged(side: DataFrame, tag: int) -> DataFrame:
        values = [(F.expr(v) if isinstance(v, str) else v).alias(f"f{i}") for i, v in enumerate(fields.values())]
        row = F.struct(*([F.col(latest).alias("at")] if latest else []), *values)
        return side.select(*[F.col(k).alias(o) for k, o in zip(keys, own)], row.alias("v"), F.lit(tag).alias("tag"))

    grouped = (
        tagged(left, 0)
        .unionByName(tagged(right, 1))
        .groupBy(*own)
        .agg(F.max(F.when(F.col("tag") == 0, F.col("v"))).alias("a"), F.max(F.when(F.col("tag") == 1, F.col("v"))).alias("b"))
    )
    pairs = ", ".join(f"struct('{name}' as name, not (a.f{i} <=> b.f{i}) as differs)" for i, name in enumerate(fields))
    finding = (
        f"case when b is null then array('missing_in_{names[1]}') when a is null then array('missing_in_{names[0]}') "
        f"else transform(filter(array({pairs}), x -> x.differs), x -> x.name) end"
    )
    return grouped.select(*[F.col(o).alias(k) for o, k in zip(own, keys)], F.explode(F.expr(finding)).alias("finding"))
