"""Tables of segments under a manifest: appended, read as of a version, compacted, and kept within an age and a size.

A segment is what one append has of one slice of time, a folder ``batch=../slice=..`` bucketed as in ``facts.write_table``. A version of the
manifest lists the segments of the table, one row each, so it grows with appends and slices and never with rows or files; compaction makes the
segments of a slice one again. A change writes its new segments first and then renames a draft to the next version's file, which only one writer
can: the others take up the new version and try again. Nothing is deleted before ``vacuum``, so a reader goes on with the files of its version, and
an append that failed half way is no part of the table. Renaming must fail where the file exists, as streams ask of the folder of their checkpoints.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshlens.functions import net, times
from meshlens.sources import facts, settings, staging

SEGMENT = "batch string, slice long, bytes long, rows long, first long, last long"
DAY = 86_400_000


class Superseded(RuntimeError):
    """Segments that a change replaces are no longer in the table."""


@dataclass(frozen=True)
class Retention:
    """Bounds of a table: milliseconds, bytes and rows; None is no bound."""

    max_age: int | None = None
    max_bytes: int | None = None
    max_rows: int | None = None

    @classmethod
    def of(cls, spark: SparkSession, table: str, overrides: dict[str, str] | None = None) -> Retention:
        """The bounds set for a table as ``meshlens.<table>.max_age`` (an interval, as ``90 days``), ``.max_bytes`` and ``.max_rows``."""
        given = {k: settings.option(spark, f"{table}.{k}", overrides) for k in ("max_age", "max_bytes", "max_rows")}
        age = given.pop("max_age")
        return cls(None if age is None else round(times.Interval.parse(age).seconds * 1000), **{k: None if v is None else int(v) for k, v in given.items()})


def expired(segments: DataFrame, now: int, keep: Retention) -> DataFrame:
    """Segments that a retention gives up: those older than ``max_age``, and the oldest while all that is left is beyond a size.

    Age and order go by the last time in a segment, of equal ones the smaller (slice, batch) goes first. The newest segment stays, whatever its size.
    A size counts a segment with all newer ones; a single window over the manifest's few rows.
    """
    newest_first = Window.orderBy(F.desc("last"), F.desc("slice"), F.desc("batch"))
    sums = newest_first.rowsBetween(Window.unboundedPreceding, 0)
    over = F.lit(False)
    if keep.max_age is not None:
        over |= F.lit(now) - F.col("last") > keep.max_age
    for size, bound in (("bytes", keep.max_bytes), ("rows", keep.max_rows)):
        if bound is not None:
            over |= F.sum(size).over(sums) > bound
    marked = segments.withColumns({"_over": over, "_place": F.row_number().over(newest_first)})
    return marked.where("_over AND _place > 1").drop("_over", "_place")


def create(spark: SparkSession, path: str, schema: T.StructType) -> None:
    """An empty table; one that exists stays as it is."""
    if not _versions(spark, path):
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{path}/_schema")
        _commit(spark, path, 0, spark.createDataFrame([], SEGMENT))


def append(rows: DataFrame, path: str, ip: str, ts: str = "start", last: str = "stop", slice_ms: int = DAY, buckets: int = facts.BUCKETS, batch: str | None = None) -> None:
    """Add ``rows`` as one segment a slice of time. A named ``batch`` that is in the table is not added again, so a stream's repeated batch adds nothing.

    Rows without a time go to slice 0 of time 0; an address of null is a bucket of its own. Tasks write ranges of (slice, bucket, time), so no slice
    or bucket is one task. An empty ``rows`` adds no segment; columns named as the folders (batch, slice, ip_bucket) are refused.
    """
    spark = rows.sparkSession
    if taken := {"batch", "slice", "ip_bucket"} & {c.lower() for c in rows.columns}:
        raise ValueError(f"columns {sorted(taken)} are names of folders")
    create(spark, path, rows.schema)
    batch = f"b{batch or uuid.uuid4().hex}"
    if segments(spark, path).where(F.col("batch") == batch).limit(1).count():
        return
    keyed = rows.withColumns({"slice": F.coalesce(times.div(F.col(ts) - F.pmod(ts, F.lit(slice_ms)), slice_ms), F.lit(0)), "ip_bucket": net.bucket(F.col(ip), buckets)})
    _write(keyed, path, batch, ts)
    added = _described(spark, path, batch, ts, last)
    _change(spark, path, lambda old: old.where(F.col("batch") != batch).unionByName(added))


def purge(spark: SparkSession, path: str, now: int, keep: Retention) -> int:
    """Take expired segments out of the table; their number. ``vacuum`` frees their files."""
    gone = 0

    def without(old: DataFrame) -> DataFrame:
        nonlocal gone
        out = expired(old, now, keep)
        gone = out.count()
        return old.join(out.select("batch", "slice"), ["batch", "slice"], "left_anti")

    _change(spark, path, without)
    return gone


def compact(spark: SparkSession, path: str, ts: str = "start", last: str = "stop") -> int:
    """Make the segments of each slice that has several of them one; the number of segments replaced.

    Fails with ``Superseded``, and changes nothing, if one of them has left the table meanwhile.
    """
    several = segments(spark, path).withColumn("_n", F.count("*").over(Window.partitionBy("slice"))).where("_n > 1").drop("_n")
    old = several.select("batch", "slice").collect()
    if not old:
        return 0
    batch = f"b{uuid.uuid4().hex}"
    _write(_scan(spark, path, old), path, batch, ts)
    added = _described(spark, path, batch, ts, last)
    gone = spark.createDataFrame(old, "batch string, slice long")

    def swapped(now: DataFrame) -> DataFrame:
        if now.join(gone, ["batch", "slice"], "left_semi").count() != len(old):
            raise Superseded(path)
        return now.join(gone, ["batch", "slice"], "left_anti").unionByName(added)

    _change(spark, path, swapped)
    return len(old)


def read(
    spark: SparkSession, path: str, version: int | None = None, start: int | None = None, stop: int | None = None, cidr: tuple[int, int] | None = None,
    ip: str = "ip_src", start_column: str = "start", stop_column: str = "stop", buckets: int = facts.BUCKETS,
) -> DataFrame:
    """Rows of a version, the newest by default, that overlap [start, stop[, with ``ip`` in ``cidr``.

    Segments whose times lie outside are not listed; of the others buckets prune folders and statistics row groups.
    """
    wanted = segments(spark, path, version)
    if start is not None:
        wanted = wanted.where(F.col("last").isNull() | (F.col("last") >= start))
    if stop is not None:
        wanted = wanted.where(F.col("first").isNull() | (F.col("first") < stop))
    rows = _scan(spark, path, wanted.select("batch", "slice").collect())
    out = facts.pruned(rows, start, stop, cidr, ip, start_column, stop_column, buckets)
    return out.drop("batch", "slice", "ip_bucket")


def segments(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The manifest of a version, the newest by default."""
    found = _versions(spark, path)
    if not found or (version is not None and version not in found):
        raise ValueError(f"{path} has no version {version if version is not None else 0}")
    return spark.read.schema(SEGMENT).parquet(f"{path}/_manifest/{found[max(found) if version is None else version]}")


def versions(spark: SparkSession, path: str) -> list[int]:
    return sorted(_versions(spark, path))


def vacuum(spark: SparkSession, path: str, keep_versions: int = 1) -> int:
    """Delete versions but the newest ``keep_versions``, and the segments that only they have; the number of folders deleted.

    Readers of the versions that stay are not disturbed. Run it while nothing is appended or compacted: what these have written but not
    yet committed is in no version.
    """
    found = _versions(spark, path)
    kept = sorted(found)[-max(1, keep_versions) :]
    live = {(r.batch, r.slice) for v in kept for r in segments(spark, path, v).select("batch", "slice").collect()}
    fs, root = _fs(spark, path)
    gone = [s for b in fs.listStatus(root) if b.getPath().getName().startswith("batch=") for s in fs.listStatus(b.getPath()) if s.isDirectory() and _place(s) not in live]
    for s in gone:
        fs.delete(s.getPath(), True)
    for v in sorted(set(found) - set(kept)):
        fs.delete(_at(spark, f"{path}/_manifest/v{v:09d}"), False)
        fs.delete(_at(spark, f"{path}/_manifest/{found[v]}"), True)
    return len(gone)


def _place(status) -> tuple[str, int]:
    folder = status.getPath()
    return folder.getParent().getName().removeprefix("batch="), int(folder.getName().removeprefix("slice="))


def _write(rows: DataFrame, path: str, batch: str, ts: str) -> None:
    out = rows.repartitionByRange("slice", "ip_bucket", ts).sortWithinPartitions("slice", "ip_bucket", ts)
    out.drop("batch").write.partitionBy("slice", "ip_bucket").mode("overwrite").parquet(f"{path}/batch={batch}")


def _described(spark: SparkSession, path: str, batch: str, ts: str, last: str) -> DataFrame:
    """Manifest rows of what has been written: sizes from the file listing, counts and times from the Parquet columns."""
    where = f"{path}/batch={batch}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(where)
    sizes = files.groupBy(F.regexp_extract("path", "/slice=(-?[0-9]+)/", 1).cast("long").alias("slice")).agg(F.sum("length").alias("bytes"))
    rows = spark.read.schema(_schema(spark, path)).option("basePath", path).parquet(where)
    facts_ = rows.groupBy("slice").agg(F.count("*").alias("rows"), F.min(ts).alias("first"), F.max(F.greatest(ts, last)).alias("last"))
    return staging.staged(sizes.join(facts_, "slice").select(F.lit(batch).alias("batch"), "slice", "bytes", "rows", "first", "last"), "segments")


def _schema(spark: SparkSession, path: str) -> T.StructType:
    kept = spark.read.parquet(f"{path}/_schema").schema
    return T.StructType([*kept.fields, T.StructField("batch", T.StringType()), T.StructField("slice", T.LongType()), T.StructField("ip_bucket", T.LongType())])


def _scan(spark: SparkSession, path: str, places: list) -> DataFrame:
    schema = _schema(spark, path)
    if not places:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(*[f"{path}/batch={b}/slice={s}" for b, s in places])


def _at(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    where = _at(spark, path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _versions(spark: SparkSession, path: str) -> dict[int, str]:
    """Folder of each version."""
    fs, root = _fs(spark, f"{path}/_manifest")
    if not fs.exists(root):
        return {}
    out = {}
    for s in fs.listStatus(root):
        name = s.getPath().getName()
        if s.isFile() and name.startswith("v"):
            out[int(name[1:])] = spark.read.text(f"{path}/_manifest/{name}").first().value
    return out


def _commit(spark: SparkSession, path: str, version: int, rows: DataFrame) -> bool:
    """Write ``rows`` as that version of the manifest; False if another writer was first."""
    folder = f"data-{uuid.uuid4().hex}"
    rows.coalesce(1).write.parquet(f"{path}/_manifest/{folder}")
    fs, draft = _fs(spark, f"{path}/_manifest/{folder}.draft")
    out = fs.create(draft, False)
    out.write(bytearray(folder.encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context = spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(draft, _at(spark, f"{path}/_manifest/v{version:09d}"), options)
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" not in str(e.java_exception):
            raise
        fs.delete(draft, False)
        fs.delete(_at(spark, f"{path}/_manifest/{folder}"), True)
        return False
    return True


def _change(spark: SparkSession, path: str, change: Callable[[DataFrame], DataFrame]) -> None:
    """Put ``change`` of the newest version in its place, from anew while other writers come first."""
    while True:
        base = max(_versions(spark, path))
        if _commit(spark, path, base + 1, change(segments(spark, path, base))):
            return
