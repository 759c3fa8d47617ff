"""Building blocks that keep hot groups out of single tasks.

A scenario, serial number or tree node may hold a third of all rows, so none of the helpers sorts or
collects a whole group in one task:

* `with_position` numbers the rows of a group through buckets of the integer index;
* `range_parts` pins range partitions, over which running sums combine like over buckets;
* `skew_join` salts the keys that are proven to be heavy;
* `spread` uses all cores for heavy row-wise work on few input partitions;
* `materialize` cuts lineage with a written table in the cluster's shared folder, `materialize_bucketed` also
  keeps later joins on the same keys from moving it.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# One bucket holds at most this many rows of a group, because the index is unique in its group.
BUCKET_WIDTH = 1 << 20

# Temporary folder per local application without a configured one.
_LOCAL_FOLDERS: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for written intermediates: the session's `spark.checkpoint.dir`.

    Only a local session without that setting gets a temporary folder; on a cluster a folder of one
    machine would be lost with it, so there the setting is required.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="caseflow-")
    return _LOCAL_FOLDERS[app]


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/caseflow/{uuid.uuid4().hex}/{name}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back.

    Survives lost executors (unlike a cache), cuts the lineage of iterative jobs, pins down
    non-deterministic parts such as sampled range bounds, and gives the planner true file sizes, so
    that it broadcasts the result only if it is below `spark.sql.autoBroadcastJoinThreshold`.
    """
    spark = df.sparkSession
    folder = new_folder(spark, name)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def discard(*tables: DataFrame) -> None:
    """Delete the folders of tables made by `materialize` that nothing will read again.

    Call it only when what was made of them is itself written: a lost task runs again from the newer tables.
    """
    for table in tables:
        context = table.sparkSession.sparkContext
        hadoop = context._jvm.org.apache.hadoop.fs
        for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            path = hadoop.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def materialize_bucketed(df: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
    """Write `df` to the shared folder in hash buckets of `keys`, as many as the session has shuffle partitions.

    Tables bucketed alike are joined on these keys bucket by bucket, so that the wide one does not move again. The
    keys should be near unique, as a bucket is one task. The table stays in the session's catalog under a name of its own.
    """
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"caseflow_{name}_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, *keys)
    dealt.write.format("parquet").option("path", new_folder(spark, name)).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)
    return spark.table(table)


def spread(df: DataFrame, rows_per_task: int | None = None) -> DataFrame:
    """Spread few input partitions over all cores, for narrow rows ahead of heavy row-wise work.

    There are at least as many parts as cores, and with `rows_per_task` so many that a part has about that many rows: a task
    does not grow with the input. Inputs that already have enough partitions are left alone, so large inputs of cheap rows do
    not shuffle. The count of a Parquet table reads its footers only.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = cores if rows_per_task is None else max(cores, -(-df.count() // rows_per_task))
    return df if df.rdd.getNumPartitions() >= parts else df.repartition(parts)


def same_key_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where two nulls are equal too; the keys appear once."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in on], *[c for c in right.columns if c not in on])
    condition = F.lit(True)
    for key in on:
        condition = condition & F.col(key).eqNullSafe(F.col(f"_r_{key}"))
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in on])


def without_order(df: DataFrame, order: str) -> DataFrame:
    """Problem rows of `with_position`: those without an index have no position."""
    return df.filter(F.col(order).isNull())


def with_position(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    *,
    first: int | None = None,
    last: int | None = None,
    previous: bool = False,
    width: int = BUCKET_WIDTH,
) -> DataFrame:
    """Add `position` (1-based, by integer column `order` within `keys`) and `group_n`.

    Null keys are a group like any other; rows without an index have no position, `without_order` returns them.
    `order` must be unique within `keys`. Rows are counted per bucket of `width` index values (map-side
    combined), bucket offsets are prefix sums over buckets of buckets, and rows are numbered inside
    their bucket. Hence a task sorts at most `width` rows of a group, however large the group is.
    `first` / `last` keep the leading / trailing n rows and drop whole buckets before the rows move.
    `previous` adds `previous_idx`, the next lower index of the group.
    """
    keys = list(keys)
    by_bucket = keys + ["_bucket"]
    bucketed = df.filter(F.col(order).isNotNull()).withColumn("_bucket", F.expr(f"CAST(`{order}` AS BIGINT) div {width}L"))
    edges = bucketed.groupBy(*by_bucket).agg(
        F.count(F.lit(1)).alias("_n"), F.max(order).cast("bigint").alias("_hi")
    ).withColumn("_super", F.expr(f"_bucket div {width}L"))
    supers = edges.groupBy(*keys, "_super").agg(F.sum("_n").alias("_sn"), F.max("_hi").alias("_shi"))

    across = Window.partitionBy(*keys).orderBy("_super")
    supers = supers.select(
        *keys,
        "_super",
        F.coalesce(F.sum("_sn").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_sbefore"),
        F.lag("_shi").over(across).alias("_sprev"),
        F.sum("_sn").over(Window.partitionBy(*keys)).alias("group_n"),
    )
    within = Window.partitionBy(*keys, "_super").orderBy("_bucket")
    offsets = same_key_join(edges, supers, keys + ["_super"]).select(
        *by_bucket,
        "_n",
        "group_n",
        (
            F.col("_sbefore")
            + F.coalesce(F.sum("_n").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ).alias("_before"),
        F.coalesce(F.lag("_hi").over(within), F.col("_sprev")).alias("_prev_hi"),
    )
    if first is not None:
        offsets = offsets.filter(F.col("_before") < first)
    if last is not None:
        offsets = offsets.filter(F.col("group_n") - F.col("_before") - F.col("_n") < last)

    local = Window.partitionBy(*by_bucket).orderBy(order)
    placed = same_key_join(bucketed, offsets, by_bucket).withColumn("position", F.col("_before") + F.row_number().over(local))
    if previous:
        placed = placed.withColumn(
            "previous_idx", F.coalesce(F.lag(F.col(order).cast("bigint")).over(local), F.col("_prev_hi"))
        )
    if first is not None:
        placed = placed.filter(F.col("position") <= first)
    if last is not None:
        placed = placed.filter(F.col("position") > F.col("group_n") - last)
    return placed.drop("_bucket", "_n", "_before", "_prev_hi")


def range_parts(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Range-partition by `order` and pin the part number of every row as `_part`.

    The sampled bounds may differ between two evaluations, so the result is written once.
    """
    parted = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    return materialize(parted, name)


def skew_join(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    how: str = "left",
    *,
    salt_by: Sequence[str],
    rows_per_task: int = 1 << 18,
    most_keys: int = 10_000,
) -> DataFrame:
    """Join `big` to `small` (unique per `on`), dealing keys with many rows of `big` over several tasks.

    A key is heavy above `rows_per_task` rows and above 1/most_keys of all rows. Fewer than `most_keys` keys
    can hold so large a share, so the list of heavy keys has a proven bound and is broadcast; it is found by a
    map-side combined count. A heavy key gets as many salts as it fills tasks; its rows scatter over them by
    a hash of `salt_by`, which gives the same bucket when a lost task runs again, and its single partner row
    is repeated. Null keys match nothing and scatter widely.
    """
    if how not in ("left", "inner"):
        raise ValueError(f"how={how!r}: only left and inner joins can be salted on the left side")
    on = list(on)
    counts = big.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    total = big.agg(F.count(F.lit(1)).alias("_all"))
    load = F.greatest(F.lit(rows_per_task).cast("double"), total.scalar() / most_keys)
    heavy = F.broadcast(  # fewer than `most_keys` rows
        counts.filter(F.col("_n") > load).select(*on, F.ceil(F.col("_n") / load).cast("int").alias("_salts"))
    )
    any_null = F.lit(False)
    for key in on:
        any_null = any_null | F.col(key).isNull()
    salts = F.when(any_null, F.lit(most_keys)).otherwise(F.coalesce("_salts", F.lit(1)))
    salted_big = big.join(heavy, on, "left").withColumn("_salt", F.pmod(F.xxhash64(*salt_by), salts).cast("int"))
    salted_small = small.join(heavy, on, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))
    )
    return salted_big.drop("_salts").join(salted_small.drop("_salts"), on + ["_salt"], how).drop("_salt")
