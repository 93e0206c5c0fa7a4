"""Stored tables: layout, incremental append, keyed upsert, retention, archive, export.

Events are Parquet under `event_date=`, ZSTD, sorted by site and time inside files: a day prunes by
directory, a site by row-group statistics, and many small sites do not become many small files. The
cold archive is laid out under `site_id=` / `event_date=`. Writes go through a rebalance, with which
Spark splits a hot partition over several tasks and merges small ones. Jobs write only the
partitions they touch and never overwrite a path they are reading."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from datetime import date, datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from footfall.functions.numbers import union_all

HOT_PARTITIONS = ["event_date"]
COLD_PARTITIONS = ["site_id", "event_date"]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder shared by the cluster (spark.checkpoint.dir). It must be set wherever
    executors run on other machines; a local session without it gets a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def with_event_date(events: DataFrame, column: str = "timestamp") -> DataFrame:
    return events.withColumn("event_date", F.to_date(column))


def _write(df: DataFrame, path: str, partitions: list[str], mode: str, overwrite: str = "dynamic") -> None:
    spread = df.hint("rebalance", *partitions)
    order = [*partitions, *[c for c in ("site_id", "timestamp") if c in df.columns and c not in partitions]]
    (spread.sortWithinPartitions(*order).write.mode(mode).option("partitionOverwriteMode", overwrite)
     .option("compression", "zstd").partitionBy(*partitions).parquet(path))


def write_events(events: DataFrame, path: str, mode: str = "append") -> None:
    _write(with_event_date(events), path, HOT_PARTITIONS, mode)


def read_events(spark: SparkSession, *paths: str) -> DataFrame:
    """Events under the paths; columns are matched by name, absent ones are NULL."""
    frames = [spark.read.option("mergeSchema", "true").parquet(p) for p in paths]
    return unified_view(*frames)


def with_id(events: DataFrame) -> DataFrame:
    """Events without an id get one from their content: the same record again is the same event, two different
    records are two."""
    content = F.sha2(F.to_json(F.struct(*sorted(c for c in events.columns if c not in ("id", "event_date")))), 256)
    return events.withColumn("id", F.coalesce("id", F.concat(F.lit("h_"), F.substring(content, 1, 32))))


def unseen(batch: DataFrame, stored: DataFrame, keys: tuple[str, ...] = ("site_id", "id")) -> DataFrame:
    """Rows of the batch that are not stored yet, each once: appending them twice changes nothing.
    Grouping keeps the smallest row of a key, so the result does not depend on arrival order."""
    one_each = first_per_key(batch, list(keys))
    return one_each.join(stored.select(*keys), list(keys), "left_anti")


def first_per_key(df: DataFrame, keys: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*keys, "_r.*").select(
        *df.columns)


def stored_at(spark: SparkSession, path: str, schema: StructType) -> DataFrame | None:
    """The table under the path, None before its first run."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def append_new(spark: SparkSession, batch: DataFrame, path: str, *archived: str) -> None:
    """Append the rows of a batch that neither the table nor its archive has. Of both only the days in
    the batch are read back; the list of those days comes to the driver and prunes directories, so one
    event with an odd date adds one day. Events without an id are known by their content. Rows are grouped only
    if keys repeat in the batch, and joined with the stored ones only if some are there."""
    batch = with_id(batch)
    dated = with_event_date(batch)
    days = [r[0] for r in dated.select("event_date").distinct().collect()]
    if not days:
        return
    keys = ["site_id", "id"]
    there = [t.filter(F.col("event_date").isin(days)).select(*keys)
             for p in (path, *archived) if (t := stored_at(spark, p, dated.schema)) is not None]
    # one count over the keys alone tells which of the joins and groupings of whole rows are needed
    stored = union_all(there).filter("site_id IS NOT NULL") if there else batch.select(*keys).limit(0)
    each = batch.select(*keys, F.lit(1).alias("new")).unionByName(stored.select(*keys, F.lit(0).alias("new"))).groupBy(*keys).agg(
        F.sum("new").alias("new"), F.count("*").alias("all")).filter("new > 0")
    repeated, known, fresh = each.agg(
        F.count_if(F.col("new") > 1), F.count_if(F.col("all") > F.col("new")), F.count_if(F.col("all") == F.col("new"))).first()
    if not fresh:
        return
    new = first_per_key(batch, keys) if repeated else batch
    for t in there if known else []:
        new = new.join(t, keys, "left_anti")
    write_events(new, path)


def latest_per_key(df: DataFrame, keys: list[str], newest: list[str]) -> DataFrame:
    """The newest row per key. A maximum over structs merges map-side, so a key with very many
    versions sends one row per task."""
    rest = [c for c in df.columns if c not in keys and c not in newest]
    picked = F.max(F.struct(*newest, *rest)).alias("_r")
    return df.groupBy(*keys).agg(picked).select(*keys, "_r.*").select(*df.columns)


def upsert_by_key(stored: DataFrame, changes: DataFrame, keys: list[str], newest: list[str]) -> DataFrame:
    """Stored rows with the changes applied. Re-reading old changes is harmless."""
    return latest_per_key(stored.unionByName(changes, allowMissingColumns=True), keys, newest)


def overwrite_touched(df: DataFrame, path: str, partitions: list[str]) -> None:
    """Replace exactly the partitions present in `df`; the others stay."""
    _write(df, path, partitions, "overwrite")


def full_rebuild(df: DataFrame, path: str, partitions: list[str]) -> None:
    """Drop everything under the path and write the table anew."""
    _write(df, path, partitions, "overwrite", "static")


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a write to the path was completed."""
    try:
        spark.read.text(f"{path}/_SUCCESS")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def replace_partitions(
    spark: SparkSession, build: Callable[[], DataFrame], path: str, partitions: list[str], staged: str | None = None,
) -> None:
    """Replace the partitions in `build()`, which may read `path`. The rows are written to `staged` first. A
    caller that names this folder, one for each run, can repeat a run that failed while partitions were
    replaced: finished rows are found there and not built again."""
    staged = staged or scratch_path(spark, "staged")
    if not finished(spark, staged):
        build().write.mode("overwrite").parquet(staged)
    overwrite_touched(spark.read.parquet(staged), path, partitions)


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a whole table, if it is there."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def drop_days(spark: SparkSession, path: str, days: list[date]) -> None:
    """Remove whole days of a table; days that are not there are left out."""
    for day in days:
        drop_path(spark, f"{path}/event_date={day}")


def small_file_days(spark: SparkSession, path: str, target_bytes: int) -> list[date]:
    """Days with over twice as many files as their bytes need. Lists the files; reads none."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    needed = F.ceil(F.sum("length") / target_bytes)
    days = files.groupBy("event_date").agg(F.count("*").alias("n"), needed.alias("needed")).filter("n > 2 * needed")
    return [r[0] for r in days.select(F.col("event_date").cast("date")).collect()]


def compact_days(spark: SparkSession, path: str, schema: StructType, target_bytes: int = 256 << 20, staged: str | None = None) -> None:
    """Pack the small files of the days that have many into large ones, sorted by site and time, so that row groups
    hold few sites again. Nobody else may write to those days meanwhile; for `staged` see `replace_partitions`: a
    packing that failed while days were replaced is finished by its repetition."""
    stored = stored_at(spark, path, with_event_date(spark.createDataFrame([], schema)).schema)
    if stored is None:
        return
    staged = staged or scratch_path(spark, "packed")
    if not finished(spark, staged):
        days = small_file_days(spark, path, target_bytes)
        if not days:
            return
    replace_partitions(spark, lambda: stored.filter(F.col("event_date").isin(days)), path, HOT_PARTITIONS, staged)


# Default and limits of a retention policy, and the age for archiving, in days.
RETENTION_DEFAULT, RETENTION_MIN, RETENTION_MAX = 365, 30, 3650
ARCHIVE_DAYS = 30


def retention_cutoffs(policies: DataFrame, as_of: datetime) -> DataFrame:
    """(site_id, cutoff) of the enabled policies; the kept span is limited to 30..3650 days."""
    days = F.least(F.greatest(F.coalesce(F.nullif("retention_days", F.lit(0)), F.lit(RETENTION_DEFAULT)),
                              F.lit(RETENTION_MIN)), F.lit(RETENTION_MAX))
    now = F.lit(as_of.isoformat(sep=" ")).cast("timestamp_ntz")
    return policies.filter("enabled").select(
        "site_id", (now - F.make_dt_interval(days)).alias("cutoff"))


def _expired(df: DataFrame, cutoffs: DataFrame, column: str) -> DataFrame:
    limit = F.to_date("cutoff") if column == "date" else F.col("cutoff")
    value = F.col(column) if column == "date" else F.col(column).cast("timestamp_ntz")
    return df.join(cutoffs, "site_id", "left").withColumn(
        "_expired", F.coalesce(value < limit, F.lit(False))).drop("cutoff")


def apply_retention(df: DataFrame, cutoffs: DataFrame, column: str = "timestamp") -> DataFrame:
    """Rows that stay. Sites without an enabled policy keep everything. Applying it again, or after
    a re-delivery of old rows, gives the same table."""
    return _expired(df, cutoffs, column).filter(~F.col("_expired")).drop("_expired")


def retention_report(df: DataFrame, cutoffs: DataFrame, column: str = "timestamp") -> DataFrame:
    """Rows deleted and kept per site."""
    return _expired(df, cutoffs, column).groupBy("site_id").agg(
        F.count_if("_expired").alias("deleted"), F.count_if(~F.col("_expired")).alias("kept"))


def is_cold(column: str, as_of: datetime, archive_days: int = ARCHIVE_DAYS) -> Column:
    return F.to_date(column) < F.lit((as_of - timedelta(days=archive_days)).date())


def _merge_cold(goes: DataFrame, cold_path: str, staged: str | None) -> None:
    """Add rows to their days in the cold path; known rows stay once."""
    def build() -> DataFrame:
        cold = stored_at(goes.sparkSession, cold_path, goes.schema)
        if cold is None:
            return goes
        days = goes.select(*COLD_PARTITIONS).distinct()
        both = cold.join(days, COLD_PARTITIONS, "left_semi").select(*goes.columns).unionByName(goes)
        return first_per_key(both, [*COLD_PARTITIONS, "id"])

    replace_partitions(goes.sparkSession, build, cold_path, COLD_PARTITIONS, staged)


def archive_cold(
    hot: DataFrame, cold_path: str, hot_path: str, as_of: datetime,
    archive_days: int = ARCHIVE_DAYS, column: str = "timestamp", staged: str | None = None,
) -> None:
    """Merge days older than `archive_days` into the cold path, then write the remaining rows as the new
    hot table. A day that is cold already keeps its rows: late ones are added, known ones stay once.
    `hot_path` must differ from where `hot` is read; `archive_stored` works in place. `staged`: see
    `replace_partitions`."""
    old, dated = is_cold(column, as_of, archive_days), with_event_date(hot, column)
    _merge_cold(dated.filter(old), cold_path, staged)
    full_rebuild(dated.filter(~old), hot_path, HOT_PARTITIONS)


def archive_stored(
    spark: SparkSession, hot_path: str, cold_path: str, as_of: datetime,
    archive_days: int = ARCHIVE_DAYS, staged: str | None = None,
) -> None:
    """As `archive_cold` for a stored hot table: cold days are merged, then their folders are dropped; the
    other days are not touched. Only those days are read. No other job may write them meanwhile."""
    goes = spark.read.parquet(hot_path).filter(is_cold("event_date", as_of, archive_days))
    days = [r[0] for r in goes.select("event_date").distinct().collect()]
    if days:
        _merge_cold(goes, cold_path, staged)
        drop_days(spark, hot_path, days)


def delete_expired(spark: SparkSession, path: str, cutoffs: DataFrame, staged: str | None = None) -> None:
    """Apply retention to stored events in place. Days up to the last cutoff are read; those without
    expired rows stay as they are, those with nothing else are dropped as folders, the rest is replaced.
    `staged`: see `replace_partitions`."""
    last = cutoffs.agg(F.max(F.to_date("cutoff"))).first()[0]
    if last is None:
        return
    marked = _expired(spark.read.parquet(path).filter(F.col("event_date") <= F.lit(last)), cutoffs, "timestamp")
    days = marked.groupBy("event_date").agg(
        F.count_if("_expired").alias("gone"), F.count_if(~F.col("_expired")).alias("kept")).filter("gone > 0").collect()
    if partly := [r.event_date for r in days if r.kept]:
        stay = marked.filter(F.col("event_date").isin(partly) & ~F.col("_expired")).drop("_expired")
        replace_partitions(spark, lambda: stay, path, HOT_PARTITIONS, staged)
    drop_days(spark, path, [r.event_date for r in days if not r.kept])


def unified_view(hot: DataFrame, *cold: DataFrame) -> DataFrame:
    """Hot and cold rows as one table; without cold parts it is the hot table."""
    out = hot
    for part in cold:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with header; quotes are doubled inside quoted fields, NULL is an empty field."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').option(
        "quote", '"').option("nullValue", "").option("emptyValue", "").csv(path)


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
