"""Deterministic samples and splits: order by hash, quotas by largest remainder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written

#: Leading hex digits by which hashes are counted: 4,096 counts for each group.
DIGITS = 3


def hash_order(seed: int, salt: Column | str, key: Column) -> Column:
    """Hex sha256 of seed:salt:id; hex sorts as the digest does."""
    salt = F.lit(salt) if isinstance(salt, str) else salt
    return F.sha2(F.concat(F.lit(f"{seed}:"), salt, F.lit(":"), key.cast("string")), 256)


def tuple_text(*columns: str) -> Column:
    """A stratum's name: values in quotes and parentheses, None for null."""
    one = lambda c: F.when(F.col(c).isNull(), F.lit("None")).otherwise(F.concat(F.lit("'"), F.col(c).cast("string"), F.lit("'")))
    return F.concat(F.lit("("), F.concat_ws(", ", *(one(c) for c in columns)), F.lit(",)" if len(columns) == 1 else ")"))


def quotas(rows: DataFrame, strata: list[str], take: Column | int) -> DataFrame:
    """stratum and its quota of `take`: floors, then one more for the largest remainders (of equals the first by name).

    Only one row per stratum is sorted as a whole, never the table.
    """
    counts = rows.groupBy(tuple_text(*strata).alias("stratum")).agg(F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy()
    share = counts.withColumn("share", F.col("n") * take / F.sum("n").over(everything)).withColumn("base", F.floor("share"))
    left = F.lit(take) - F.sum("base").over(everything) if isinstance(take, int) else take - F.sum("base").over(everything)
    rank = F.row_number().over(Window.orderBy(F.desc(F.col("share") - F.col("base")), "stratum"))
    return share.withColumn("left", left).withColumn("rank", rank).select("stratum", (F.col("base") + F.when(F.col("rank") <= F.col("left"), 1).otherwise(0)).cast("long").alias("quota"))


def smallest_by_hash(rows: DataFrame, group: str, order_hash: str, wanted: DataFrame) -> DataFrame:
    """Of each group the `quota` rows with the smallest hash (hex text, each row its own); wanted: group, quota.

    Counts by the hash's first digits (combined before the shuffle) say up to which of them a group's rows are taken whole;
    only the rows of the boundary digits are sorted, so a group that holds most of the table isn't sorted in one task.
    """
    digits = F.substring(order_hash, 1, DIGITS)
    counts = rows.groupBy(group, digits.alias("__digits")).agg(F.count(F.lit(1)).alias("__n"))
    upto = F.sum("__n").over(Window.partitionBy(group).orderBy("__digits").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    run = counts.withColumn("__upto", upto).join(wanted, group)
    # The first digits at which the quota is reached, and how many rows of theirs it still takes.
    border = run.filter(F.col("__upto") >= F.col("quota")).groupBy(group).agg(F.min(F.struct("__digits", (F.col("quota") - F.col("__upto") + F.col("__n")).alias("rest"))).alias("b"))
    limits = wanted.join(border, group, "left").select(group, "quota", F.col("b.__digits").alias("__border"), F.col("b.rest").alias("__rest"))
    marked = rows.join(limits, group).filter((F.col("quota") > 0) & (F.col("__border").isNull() | (digits <= F.col("__border"))))
    whole = marked.filter(F.col("__border").isNull() | (digits < F.col("__border")))
    inside = Window.partitionBy(group).orderBy(order_hash)
    part = marked.filter(digits == F.col("__border")).withColumn("__rank", F.row_number().over(inside)).filter(F.col("__rank") <= F.col("__rest")).drop("__rank")
    return whole.unionByName(part).drop("quota", "__border", "__rest")


def stratified_take(rows: DataFrame, key: str, strata: list[str], take: int, seed: int, salt: str) -> DataFrame:
    """Rows taken, with the hash that orders them (column `order_hash`). Keys must differ."""
    named = rows.withColumn("__stratum", tuple_text(*strata))
    named = named.withColumn("__hash", hash_order(seed, F.concat(F.lit(f"{salt}:"), F.col("__stratum")), F.col(key)))
    picked = smallest_by_hash(named, "__stratum", "__hash", quotas(rows, strata, take).withColumnRenamed("stratum", "__stratum"))
    return picked.drop("__stratum", "__hash").withColumn("order_hash", hash_order(seed, salt, F.col(key)))


def stratified_sample_ids(rows: DataFrame, key: str, strata: list[str], take: int, seed: int) -> DataFrame:
    """ord and id of a stratified sample in the order of ids; all ids if there are no more than asked for."""
    if take <= 0:
        raise ValueError("a sample takes one row at least")
    picked = rows.select(key) if rows.count() <= take else stratified_take(rows, key, strata, take, seed, "sample").select(key)
    return positions(picked.select(F.col(key).alias("id")), ["id"]).select("ord", "id")


def positions(rows: DataFrame, order: list[Column | str], name: str = "ord") -> DataFrame:
    """Adds a position from 0 over the whole table, in the given order (which must tell all rows apart to be fixed).

    Ranges are sorted in parallel and written once, each row with its range and place; both the ranges' counts and
    the rows are then read from that table. So no other run of the range sort, with other bounds, can come between.
    """
    sorted_rows = rows.select("*", F.struct(*order).alias("__order")).repartitionByRange("__order").sortWithinPartitions("__order").drop("__order")
    # The number of the task in the upper bits, the row's place there in the lower 33.
    placed = written(sorted_rows.withColumn("__placed", F.monotonically_increasing_id()))
    part, place = F.shiftright("__placed", 33), F.col("__placed").bitwiseAND(F.lit((1 << 33) - 1))
    counts = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # One row for each task of the sort.
    starts = counts.select("__part", before.alias("__before"))
    return placed.withColumn("__part", part).join(starts, "__part").withColumn(name, (F.col("__before") + place).cast("long")).drop("__part", "__before", "__placed")


def build_splits(rows: DataFrame, key: str, strata: list[str], seed: int, dev_share: float = 0.05, grpo_train: int = 900, grpo_validation: int = 100) -> DataFrame:
    """split, id, order_hash: dev by strata, train the rest, and a stratified subset of each."""
    rows = rows.select(key, *strata)
    total = rows.count()
    n_dev = round(total * dev_share)
    # Read by four parts below: written once.
    dev = written(stratified_take(rows, key, strata, n_dev, seed, "sft_dev"))
    train = rows.join(dev.select(key), key, "left_anti")
    parts = {
        "sft_train": train.withColumn("order_hash", hash_order(seed, "sft_train", F.col(key))),
        "sft_dev": dev,
        "grpo_train": stratified_take(train, key, strata, min(grpo_train, total - n_dev), seed, "grpo_train"),
        "grpo_validation": stratified_take(dev.drop("order_hash"), key, strata, min(grpo_validation, n_dev), seed, "grpo_validation"),
    }
    out = None
    for name, part in parts.items():
        part = part.select(F.lit(name).alias("split"), F.col(key).alias("id"), "order_hash")  # noqa: PLW2901
        out = part if out is None else out.unionByName(part)
    return out


def take_per_bucket(rows: DataFrame, bucket: str | list[str], wanted: dict, key: str, seed: int) -> DataFrame:
    """A fixed number of rows from each bucket asked for, in the order asked (column bucket_order).

    bucket: a column, or several, whose values then stand in wanted as tuples, as in a sample by mode and difficulty.
    """
    columns = [bucket] if isinstance(bucket, str) else bucket
    spark = rows.sparkSession
    kinds = dict(rows.dtypes)
    values = [(*((b,) if isinstance(bucket, str) else b), i, n) for i, (b, n) in enumerate(wanted.items())]
    asked = spark.createDataFrame(values, ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), "bucket_order int", "quota long"])).withColumn("__bucket", F.col("bucket_order"))
    # A row for each bucket asked for: stated by the caller, so small.
    named = rows.join(F.broadcast(asked.drop("quota")), columns).withColumn("__hash", hash_order(seed, F.concat_ws(":", *columns), F.col(key)))
    return smallest_by_hash(named, "__bucket", "__hash", asked.select("__bucket", "quota")).select(*rows.columns, "bucket_order")


def take(rows: DataFrame, n: int, key: str, seed: int, salt: str = "sample") -> DataFrame:
    """n rows by hash order; all rows for n <= 0."""
    return rows.orderBy(hash_order(seed, salt, F.col(key)), key).limit(n) if n > 0 else rows


def curriculum(rows: DataFrame, stage: str, expected: dict[str, int]) -> DataFrame:
    """Adds stage_order; raises if a stage's count isn't the expected one or a row has no stage."""
    found = {r[stage]: r["count"] for r in rows.groupBy(stage).count().collect()}
    if found != expected:
        raise ValueError(f"stages have {found}, not {expected}")
    order = F.create_map(*(F.lit(x) for i, s in enumerate(expected) for x in (s, i)))
    return rows.withColumn("stage_order", order[F.col(stage)])


def overlaps(splits: DataFrame, left: str, right: str) -> DataFrame:
    """Ids in both splits."""
    return splits.filter(F.col("split") == left).select("id").intersect(splits.filter(F.col("split") == right).select("id"))
