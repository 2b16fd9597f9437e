"""Schema metadata and referential integrity of databases, from catalog rows and from tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of the catalog reader, one shape for all kinds: object, column, foreign_key, index, pragma, quick_check, violation.
CATALOG_SCHEMA = "db string, kind string, ord bigint, type string, name string, tbl_name string, hidden bigint, not_null bigint, pk bigint, text_value string, int_value bigint"


def table_counts(catalog: DataFrame) -> DataFrame:
    """``(db, name, ...)``: column, key, foreign-key and index counts of every table; zero where it has none."""
    tables = catalog.filter("kind = 'object' and type = 'table'").select("db", "name")
    of = lambda kind: (F.col("kind") == kind)
    column = of("column")
    counts = catalog.filter("kind in ('column', 'foreign_key', 'index')").groupBy("db", F.col("tbl_name").alias("name")).agg(
        F.count_if(column).alias("column_count"), F.count_if(column & (F.col("hidden") != 0)).alias("hidden_column_count"), F.count_if(column & (F.col("not_null") != 0)).alias("not_null_column_count"),
        F.count_if(column & (F.col("pk") != 0)).alias("primary_key_column_count"), F.count_if(of("foreign_key")).alias("foreign_key_count"), F.count_if(of("index")).alias("index_count"),
    )
    return tables.join(counts, ["db", "name"], "left").na.fill(0)


def object_counts(catalog: DataFrame) -> DataFrame:
    return catalog.filter("kind = 'object'").groupBy("db", "type").agg(F.count(F.lit(1)).alias("n"))


def orphans(child: DataFrame, parent: DataFrame, child_keys: Sequence[str], parent_keys: Sequence[str]) -> DataFrame:
    """Child rows whose key no parent has; a key with a null part refers to nothing and is no violation."""
    # rows travel as structs, so that no column name can clash
    keyed = child.dropna(subset=list(child_keys)).select(F.struct("*").alias("row"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(child_keys)])
    wanted = parent.select(*[F.col(p).alias(f"p{i}") for i, p in enumerate(parent_keys)])
    met = [F.col(f"c{i}") == F.col(f"p{i}") for i in range(len(child_keys))]
    on = met[0]
    for more in met[1:]:
        on = on & more
    return keyed.join(wanted, on, "left_anti").select("row.*")
