"""Column-level data quality profile of loads, and the loads that no longer look like the one before."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auditframe.runtime import written

#: Shares of a column's non-null values: a mask is dominant from the first on, and rare below the second.
DOMINANT, RARE = 0.2, 0.01

#: Forms a column may declare: the masks a well-formed value can have, and its value as a number (null: off form).
FORMS = {
    "date": (r"\A9999-99-99\z", "case when substring(value, 1, 4) <> '0000' then datediff(try_to_date(value, 'yyyy-MM-dd'), date'1970-01-01') end"),
    "number": (r"\A[ \t\n\x0b\f\r]*[+-]?(?:9+\.?9*|\.9+)(?:[aA][+-]?9+)?[ \t\n\x0b\f\r]*\z", r"try_cast(regexp_replace(value, '\\s', '') as double)"),
}


def mask(value: Column) -> Column:
    """Character classes: a digit is 9, a lower-case letter a, a capital A; every other character stands for itself."""
    for letters, sign in (("[0-9]", "9"), (r"\p{Lu}", "A"), (r"[\p{L}&&[^\p{Lu}]]", "a")):
        value = F.regexp_replace(value, letters, sign)
    return value


def short_mask(value: Column) -> Column:
    """The mask with every run of one class written once, so that it doesn't depend on lengths."""
    return F.regexp_replace(mask(value), r"([9aA])\1+", "$1+")


def value_counts(rows: DataFrame, by: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """``(by..., field_name, value, n)``, the one shuffle of the rows, with partial sums before it.

    All that the profile needs follows from these counts, so a load or value that holds much of
    the table is small from here on.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("value")) for f in fields]))
    return rows.select(*by, pairs.alias("x")).groupBy(*by, "x.field_name", "x.value").agg(F.count(F.lit(1)).alias("n"))


def judged_counts(counts: DataFrame, forms: Mapping[str, str]) -> DataFrame:
    """Adds mask, ``off_form`` (null values and columns without a form: false) and ``number``, the value of the form."""
    mask_fits, number = F.lit(True), F.lit(None).cast("double")
    for field, form in forms.items():
        pattern, value = FORMS[form]
        here = F.col("field_name") == field
        mask_fits = F.when(here, F.col("full_mask").rlike(pattern)).otherwise(mask_fits)
        number = F.when(here & F.col("full_mask").rlike(pattern), F.expr(value).cast("double")).otherwise(number)
    number = F.when(F.abs(number) < float("inf"), number)
    formed = F.col("field_name").isin(*forms) if forms else F.lit(False)
    return (
        counts.withColumn("full_mask", mask(F.col("value")))
        .withColumn("number", number)
        .withColumn("off_form", F.coalesce(formed & (F.col("value") != "") & F.col("number").isNull(), F.lit(False)))
        .withColumn("mask", F.regexp_replace("full_mask", r"([9aA])\1+", "$1+"))
        .drop("full_mask")
    )


def lower_medians(judged: DataFrame, by: Sequence[str]) -> DataFrame:
    """``(by..., field_name, median)``: the lower of two middle numbers, exactly.

    Numbers first fall into buckets that keep their order (64 an octave, so at most some
    130,000 a group); only the bucket holding the middle is then ordered by value.
    """
    group = [*by, "field_name"]
    bucket = F.floor(64 * F.log2(1 + F.abs("number"))) * F.signum("number")
    numbers = judged.filter("number is not null").select(*group, "number", "n", bucket.cast("int").alias("bucket"))
    buckets = numbers.groupBy(*group, "bucket").agg(F.sum("n").alias("m"))
    over = Window.partitionBy(*group)
    upto = F.sum("m").over(over.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    middle = (
        buckets.select(*group, "bucket", "m", upto.alias("upto"), F.floor((F.sum("m").over(over) + 1) / 2).alias("rank"))
        .filter("upto >= rank and upto - m < rank")
        .select(*group, "bucket", (F.col("rank") - F.col("upto") + F.col("m")).alias("rank"))
    )
    inside = numbers.join(middle, [*group, "bucket"])
    upto = F.sum("n").over(over.orderBy("number").rowsBetween(Window.unboundedPreceding, 0))
    return inside.select(*group, "number", "rank", upto.alias("upto")).filter("upto >= rank").groupBy(*group).agg(F.min("number").alias("median"))


def rare_masks(rows: DataFrame, by: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """``(by..., field_name, mask, n, example)``: the masks that are rare in their own load, how many values have them, and the least of these.

    A mask is rare if its share is below ``RARE``, or if a single value has it and it isn't dominant: in
    a small load one value is a larger share already.
    """
    group = [*by, "field_name"]
    judged = judged_counts(value_counts(rows, by, fields), {})
    masks = judged.filter("value is not null").groupBy(*group, "mask").agg(F.sum("n").alias("n"), F.min("value").alias("example"))
    shares = masks.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*group)))
    return shares.filter((F.col("share") < RARE) | ((F.col("n") == 1) & (F.col("share") < DOMINANT))).select(*group, "mask", "n", "example")


def mask_statistics(judged: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """``(by..., field_name, dominant_masks, rare_share, mask_shift)`` from the masks' shares of each load.

    ``rare_share`` is the share of values whose mask is rare in its own load; ``mask_shift`` is the
    total variation distance of the mask distributions of a load and the load before it.
    """
    group = [*by, "field_name"]
    series = [c for c in group if c != order]
    masks = judged.filter("value is not null").groupBy(*group, "mask").agg(F.sum("n").alias("n"))
    totals = masks.groupBy(*group).agg(F.sum("n").alias("all"))
    shares = masks.join(totals, group).withColumn("share", F.col("n") / F.col("all"))
    own = shares.groupBy(*group).agg(
        F.array_sort(F.collect_list(F.when(F.col("share") >= DOMINANT, F.col("mask")))).alias("dominant_masks"),
        F.sum(F.when(F.col("share") < RARE, F.col("share")).otherwise(0.0)).alias("rare_share"),
    )
    following = totals.withColumn("next", F.lead(order).over(Window.partitionBy(*series).orderBy(order))).select(*group, "next")
    before = shares.join(following, group).filter("next is not null").select(*series, F.col("next").alias(order), "mask", (-F.col("share")).alias("share"))
    shift = shares.select(*series, order, "mask", "share").unionByName(before).groupBy(*group, "mask").agg(F.abs(F.sum("share")).alias("gap"))
    first = totals.withColumn("first", F.lag(order).over(Window.partitionBy(*series).orderBy(order)).isNull()).select(*group, "first")
    shift = shift.join(first, group).groupBy(*group).agg(F.when(~F.first("first"), F.sum("gap") / 2).alias("mask_shift"))
    return own.join(shift, group, "left")


def load_statistics(judged: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts, ranges and medians of every column of every load."""
    group = [*by, "field_name"]
    stats = judged.groupBy(*group).agg(
        F.sum("n").alias("rows"),
        F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("nulls"),
        F.count("value").alias("distinct_values"),
        F.min("value").alias("least_value"), F.max("value").alias("greatest_value"),
        F.min("number").alias("least_number"), F.max("number").alias("greatest_number"),
        F.sum(F.when(F.col("off_form"), F.col("n")).otherwise(0)).alias("off_form"),
    )
    return stats.join(lower_medians(judged, by), group, "left")


def profile_loads(rows: DataFrame, by: Sequence[str], order: str, fields: Sequence[str], forms: Mapping[str, str]) -> DataFrame:
    """One row for each load (``by``, of which ``order`` numbers the loads) and column.

    Null values count as rows only. An empty string is a value that is never off form. Rows
    count as often as they are delivered. An empty table gives an empty profile. Columns not
    named are not read, so their names can't clash; nulls in ``by`` form loads of their own.
    """
    judged = written(judged_counts(value_counts(rows, by, fields), forms), "judged")
    return load_statistics(judged, by).join(mask_statistics(judged, by, order), [*by, "field_name"], "left")


def _moved(a: str, na: str, b: str, nb: str, hundredths: int) -> str:
    """a / na and b / nb are more than so many hundredths apart, in whole numbers; an empty load has no share."""
    a, na, b, nb = (f"cast({x} as decimal(18, 0))" for x in (a, na, b, nb))
    return f"({na} > 0 and {nb} > 0 and abs({a} * {nb} - {b} * {na}) * 100 > {hundredths} * {na} * {nb})"


def shifted_loads(
    rows: DataFrame, by: Sequence[str] = ("feed", "load_no"), order: str = "load_no", forms: Mapping[str, str] | None = None, categories: Sequence[str] = ("status",)
) -> DataFrame:
    """``(by..., field_name)`` of each column that moved against the load before: p5_found's rule.

    ``forms`` maps the columns with a form to ``date`` or ``number``; ``categories`` are compared
    value by value. A share is undefined, and never moves, where a load has no value to share.
    """
    forms = {"occurred_on": "date", "duration_ms": "number"} if forms is None else forms
    judged = written(judged_counts(value_counts(rows, by, [*forms, *categories]), forms).drop("mask"), "judged")
    group = [*by, "field_name"]
    series = [c for c in group if c != order]
    in_order = Window.partitionBy(*series).orderBy(order)
    stats = written(load_statistics(judged, by), "load-statistics").withColumn("known", F.col("rows") - F.col("nulls"))
    seen = ("rows", "nulls", "known", "off_form", "median")
    pairs = stats.select(*group, *seen, F.lag(order).over(in_order).isNull().alias("first"), *[F.lag(c).over(in_order).alias(f"old_{c}") for c in seen], F.lead(order).over(in_order).alias("next"))
    dates = ", ".join(f"'{f}'" for f, form in forms.items() if form == "date") or "''"
    numbers = ", ".join(f"'{f}'" for f, form in forms.items() if form == "number") or "''"
    moved = pairs.filter("not first").filter(
        f"{_moved('nulls', 'rows', 'old_nulls', 'old_rows', 10)} or {_moved('off_form', 'known', 'old_off_form', 'old_known', 10)}"
        f" or (field_name in ({dates}) and (median < old_median or median > old_median + 30))"
        f" or (field_name in ({numbers}) and (median > 1.5 * old_median or old_median > 1.5 * median))"
    )
    chosen = judged.filter(F.col("field_name").isin(*categories)).filter("value is not null").select(*group, "value", "n")
    steps = pairs.select(*group, "next", "known", "old_known", "first")
    held = chosen.select(*group, "value", "n", F.lit(0).cast("long").alias("old_n"))
    left = chosen.join(steps.filter("next is not null").select(*group, "next"), group).select(*series, F.col("next").alias(order), "value", F.lit(0).cast("long").alias("n"), F.col("n").alias("old_n"))
    shares = held.unionByName(left).groupBy(*group, "value").agg(F.sum("n").alias("n"), F.sum("old_n").alias("old_n"))
    changed = shares.join(steps.filter("not first"), group).filter(_moved("n", "known", "old_n", "old_known", 15))
    return moved.select(*group).unionByName(changed.select(*group)).distinct()
