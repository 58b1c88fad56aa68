"""General operators: first-wins and preferred rows, carried headers, sequences, ranges, facets, constraint checks.

Order is always an explicit column. Ranks that only need a few rows of a group are written so that Spark limits
groups before the shuffle; group summaries are aggregates, so they combine on the map side.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specloom.fixed import CHANGES_KEPT, MAX_COMPARED


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once: a generator of one row, into which no later filter or projection is merged."""
    return df.select(*[F.col(c) for c in df.columns if c != name], F.explode(F.array(value)).alias(name))


def first_rows(df: DataFrame, keys: list[str], *order: Column, n: int = 1) -> DataFrame:
    """The first n rows of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r_", F.row_number().over(w)).where(F.col("_r_") <= n).drop("_r_")


def preferred_rows(df: DataFrame, keys: list[str], prefer: Column, *order: Column) -> DataFrame:
    """One row a key: the first that is preferred, else the first."""
    return first_rows(df, keys, F.coalesce(prefer, F.lit(False)).desc(), *order)


def carry_forward(df: DataFrame, keys: list[str], order: list[Column], value: Column, name: str) -> DataFrame:
    """The last value above each row that isn't null: an as-of join of rows with the headers over them."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def orphans(df: DataFrame, key: str, other: DataFrame, other_key: str) -> DataFrame:
    """Rows whose key isn't null and has no partner."""
    return df.where(F.col(key).isNotNull()).join(other.select(F.col(other_key).alias("_k_")), F.col(key) == F.col("_k_"), "left_anti")


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def outside_domain(df: DataFrame, column: str, domain: Iterable[str]) -> DataFrame:
    return df.where(~F.col(column).isin(*domain) | F.col(column).isNull())


def pivot_compare(df: DataFrame, row: str, column: str, value: Column, columns: list[str]) -> DataFrame:
    """A row for each attribute, a column for each of at most four compared things."""
    if not 0 < len(columns) <= MAX_COMPARED:
        raise ValueError(f"one to {MAX_COMPARED} can be compared")
    return df.where(F.col(column).isin(*columns)).groupBy(row).pivot(column, columns).agg(F.first(value, ignorenulls=True))


def differs(*values: Column) -> Column:
    """More than one present, and not all the same."""
    present = F.array_compact(F.array(*values))
    return (F.size(present) > 1) & (F.size(F.array_distinct(present)) > 1)


def newest(changes: DataFrame, *order: str, n: int = CHANGES_KEPT) -> DataFrame:
    """The feature of the change log: its newest n rows."""
    return changes.orderBy(*[F.desc(c) for c in order]).limit(n)


def unique_ids(df: DataFrame, base: str, order: str, taken: DataFrame, name: str = "id") -> DataFrame:
    """df with an id for each row: its base, else base-2, base-3 ..., the first that neither taken (id) nor a row before it has.

    Rows come in the order of the column order, which has no value twice. The numbers of a base that are taken and
    its rows are sorted together, so that no row looks for its number by trying. An id that two bases spell alike
    (r-2 is one of r, and a base) goes to the earlier row; what stands behind in the other base is numbered again.
    """
    left, done = df, None
    while True:
        ids = taken.select("id") if done is None else taken.select("id").unionByName(done.select(F.col(name).alias("id")))
        own = left.select(F.col(base).alias("_b"), F.col(order).alias("_o"))
        bases = own.select("_b").distinct()
        tail = r"-([2-9]|[1-9][0-9]+)$"
        held = ids.select(F.col("id").alias("_b"), F.lit(1).cast("long").alias("n")).unionByName(ids.where(F.regexp_like("id", F.lit(tail))).select(F.regexp_replace("id", tail, "").alias("_b"), F.regexp_extract("id", tail, 1).try_cast("long").alias("n")))
        held = held.where("n IS NOT NULL").distinct().join(bases, "_b", "left_semi")
        # the i-th taken number n leaves n - i free ones below it: the j-th free number is j and all n with n - i < j
        skip = held.select("_b", (F.col("n") - F.row_number().over(Window.partitionBy("_b").orderBy("n"))).alias("at"), F.lit(0).alias("kind"), F.lit(None).cast(df.schema[order].dataType).alias("_o"))
        rows = own.select("_b", (F.row_number().over(Window.partitionBy("_b").orderBy("_o")) - 1).cast("long").alias("at"), F.lit(1).alias("kind"), "_o")
        w = Window.partitionBy("_b").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        number = skip.unionByName(rows).withColumn("n", F.col("at") + 1 + F.sum(1 - F.col("kind")).over(w)).where("kind = 1")
        named = number.select("_b", "_o", F.when(F.col("n") == 1, F.col("_b")).otherwise(F.concat_ws("-", "_b", F.col("n").cast("string"))).alias(name))
        lost = named.withColumn("_r", F.row_number().over(Window.partitionBy(name).orderBy("_o"))).where("_r > 1").groupBy("_b").agg(F.min("_o").alias("_from"))
        met = left.join(named, (left[base] == F.col("_b")) & (left[order] == F.col("_o"))).drop("_b", "_o")
        if not lost.take(1):
            return met if done is None else done.unionByName(met)
        split = met.join(lost, met[base] == F.col("_b"), "left")
        ok = F.col("_from").isNull() | (F.col(order) < F.col("_from"))
        good = split.where(ok).drop("_b", "_from")
        done = good if done is None else done.unionByName(good)
        left = split.where(~ok).drop("_b", "_from", name)


def positions(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with name, the rows' numbers from 1 in an order without ties, and no task that gets all rows.

    A hash picks some keys of the order; their quantiles cut it into ranges, which are ranked one by one and follow
    on each other by their counts. order: expressions that are never null. df is read several times.
    """
    n = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])
    df = df.withColumn("_key_", key)
    total = df.count()
    some = df.select("_key_").where(F.pmod(F.xxhash64("_key_"), F.lit(max(1, total // (20 * n)))) == 0).collect()  # about 20 keys a range
    keys = sorted(tuple(r[0]) for r in some)
    bounds = sorted({keys[i * len(keys) // n] for i in range(1, n)}) if keys else []
    kinds = [f.dataType for f in df.schema["_key_"].dataType.fields]
    literal = lambda b: F.struct(*[F.lit(v).cast(t).alias(f"k{i}") for i, (v, t) in enumerate(zip(b, kinds, strict=True))])
    part = F.size(F.filter(F.array(*map(literal, bounds)), lambda b: b <= F.col("_key_"))) if bounds else F.lit(0)
    df = df.withColumn("_part_", part)
    offsets, seen = {}, 0
    for r in sorted(df.groupBy("_part_").agg(F.count("*").alias("n")).collect()):  # a row for each range
        offsets[r["_part_"]], seen = seen, seen + r["n"]
    first = F.get(F.array(*[F.lit(offsets.get(i, 0)).cast("long") for i in range(len(bounds) + 1)]), F.col("_part_"))
    return df.withColumn(name, F.row_number().over(Window.partitionBy("_part_").orderBy("_key_")) + first).drop("_part_", "_key_")
