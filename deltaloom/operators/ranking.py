"""Order-dependent operators: quotas, budgets, pages, ordered distinct rows, chains of hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quota(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group; Spark keeps n rows a group before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= n)


def top(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows."""
    return df.orderBy(*order).limit(n)


def page(df: DataFrame, order: list[Column], offset: int, size: int) -> DataFrame:
    """Rows offset+1 .. offset+size of a total order."""
    return df.orderBy(*order).offset(offset).limit(size)


def page_after(df: DataFrame, column: str, cursor, size: int) -> DataFrame:
    """The next rows after a cursor value of a unique column: no row before the cursor is sorted."""
    rows = df if cursor is None else df.where(F.col(column) > F.lit(cursor))
    return rows.orderBy(column).limit(size)


def slots(df: DataFrame, first: Column, index: str, n: int) -> DataFrame:
    """At most n rows, those for which ``first`` holds before others; in their own order again."""
    return df.orderBy((~first).cast("int"), index).limit(n).orderBy(index)


def unit_budget(df: DataFrame, pending: Column, key: str, n: int) -> DataFrame:
    """All rows with state: the first n pending ones by key run, other pending ones wait, the rest is done."""
    bound = df.where(pending).orderBy(key).limit(n).agg(F.max(key).alias("bound"))
    chosen = bound.first()[0]
    run = pending & (F.col(key) <= F.lit(chosen)) if chosen is not None else F.lit(False)
    return df.withColumn("state", F.when(run, "run").when(pending, "pending").otherwise("done"))


def byte_budget(df: DataFrame, group: list[str], order: list[Column], size: Column, limit: int) -> DataFrame:
    """The longest run of first rows of each group whose sizes add up to at most ``limit``."""
    running = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("used", F.sum(size).over(running)).where(F.col("used") <= limit)


def ordered_distinct(df: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """The first row of each key in the given order, by one aggregation."""
    return df.groupBy(*keys).agg(F.min(order).alias(order), *[F.min_by(v, order).alias(v) for v in values])


def chain_breaks(df: DataFrame, group: list[str], sequence: str, digest: str | None = None, previous: str | None = None) -> DataFrame:
    """Rows whose sequence number doesn't follow the one before, or whose ``previous`` isn't the digest before."""
    w = Window.partitionBy(*group).orderBy(sequence)
    gap = F.col(sequence) - F.lag(sequence).over(w)
    rows = df.withColumn("gap", gap)
    broken = F.col("gap") != 1
    if digest and previous:
        rows = rows.withColumn("expected", F.lag(digest).over(w))
        broken = broken | (F.col("expected").isNotNull() & ~F.col(previous).eqNullSafe(F.col("expected")))
    return rows.where(broken)


def with_end(df: DataFrame, group: list[str], start: str, last: Column) -> DataFrame:
    """Each row's end: the start of the next row of its group, or ``last``."""
    return df.withColumn("end", F.coalesce(F.lead(start).over(Window.partitionBy(*group).orderBy(start)), last))


def detail_budget(df: DataFrame, first: Column, first_order: list[Column], order: list[Column], n: int, group: list[str] | None = None) -> DataFrame:
    """At most n rows (of each group): those for which ``first`` holds in ``first_order``, then others in ``order``; with shown, the place."""
    keys = group or []
    first = F.coalesce(first, F.lit(False))

    def ranked(rows: DataFrame, by: list[Column]) -> DataFrame:
        rows = rows if keys else top(rows, by, n)  # without groups, what is left is one page
        return rows.withColumn("shown", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where(F.col("shown") <= n)

    ahead = ranked(df.where(first), first_order)
    taken = ahead.groupBy(*keys).agg(F.count("*").cast("int").alias("taken_"))
    rest = ranked(df.where(~first), order)
    rest = rest.join(taken, keys, "left") if keys else rest.join(F.broadcast(taken), F.lit(True))  # one row
    rest = rest.withColumn("shown", F.col("shown") + F.coalesce("taken_", F.lit(0))).drop("taken_")
    return ahead.unionByName(rest.where(F.col("shown") <= n).select(ahead.columns))


def size_profile(df: DataFrame, group: list[str], order: list[Column], profiles: list[tuple[str, dict[str, int]]], fixed: int, limit: int) -> DataFrame:
    """(group, profile, bytes): the first profile whose rendered size is within the limit, null where none is.

    A profile takes, of each size column that it names, the first so many rows.  Rows are ranked once, only
    the first of each group that any profile can show, and all profiles' sizes are sums of one aggregation.
    """
    most = max([n for _, takes in profiles for n in takes.values()], default=0)
    names = {name: f"size_{i}" for i, (name, _) in enumerate(profiles)}
    ranked = df.withColumn("place_", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("place_") <= max(most, 1))
    zero = F.lit(0).cast("long")
    size = lambda takes: sum((F.when(F.col("place_") <= n, F.col(c)).otherwise(0) for c, n in takes.items()), zero)
    sums = ranked.groupBy(*group).agg(*[(F.sum(size(takes)) + fixed).alias(names[name]) for name, takes in profiles])
    chosen = F.coalesce(*[F.when(F.col(c) <= limit, F.struct(F.lit(name).alias("profile"), F.col(c).alias("bytes"))) for name, c in names.items()])
    return sums.select(*group, chosen.alias("x")).select(*group, "x.profile", "x.bytes")
