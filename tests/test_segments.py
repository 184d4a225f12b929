"""Tables under a manifest: bounds kept while readers run, writers that meet, batches that repeat."""

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from meshlens.sources import segments, settings
from meshlens.sources.segments import DAY, Retention

SHAPE = "ip_src long, start long, stop long, n long"


def rows(spark, days, seed=1, n=40):
    rng = random.Random(seed)
    out = [(rng.choice([7, 7, None, rng.randrange(50)]), t := d * DAY + rng.randrange(DAY - 10), t + rng.randrange(9), rng.randrange(100)) for d in days for _ in range(n)]
    return spark.createDataFrame(out, SHAPE)


def put(df, path, **more):
    segments.append(df, path, "ip_src", buckets=4, **more)


def taken(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def path():
    return tempfile.mkdtemp(prefix="spark-") + "/table"


def brute(parts, now, keep):
    """Segments that stay, by the rule as it is told: the oldest go while anything is beyond a bound, the newest never."""
    order = sorted(parts, key=lambda r: (r.last, r.slice, r.batch))
    left = list(order)
    for r in order[:-1]:
        old = keep.max_age is not None and now - r.last > keep.max_age
        size = [(keep.max_bytes, sum(x.bytes for x in left)), (keep.max_rows, sum(x.rows for x in left))]
        if old or any(bound is not None and total > bound for bound, total in size):
            left.remove(r)
    return {(r.batch, r.slice) for r in left}


def test_purge_keeps_bounds_and_the_newest(spark, path):
    put(rows(spark, range(6)), path)
    put(rows(spark, [2, 3], 2, 15), path)
    parts = segments.segments(spark, path).collect()
    assert len(parts) == 8 and all(r.bytes > 0 for r in parts) and sum(r.rows for r in parts) == 270
    now = 6 * DAY
    sizes = sum(r.bytes for r in parts)
    for keep in (Retention(), Retention(max_age=3 * DAY), Retention(max_bytes=sizes // 2), Retention(max_rows=95), Retention(max_rows=0), Retention(2 * DAY, sizes // 3, 60)):
        gone = segments.expired(segments.segments(spark, path), now, keep)
        assert {(r.batch, r.slice) for r in parts} - {(r.batch, r.slice) for r in gone.collect()} == brute(parts, now, keep), keep


def test_a_reader_goes_on_until_vacuum(spark, path):
    df = rows(spark, range(4))
    put(df, path)
    reader, version = segments.read(spark, path, buckets=4), segments.versions(spark, path)[-1]
    assert segments.purge(spark, path, 4 * DAY, Retention(max_rows=80)) == 2
    put(rows(spark, [3], 5), path)
    assert segments.compact(spark, path) == 2
    assert taken(reader) == taken(df) == taken(segments.read(spark, path, version, buckets=4))
    late = df.where(F.col("start") >= 2 * DAY).unionByName(rows(spark, [3], 5))
    assert taken(segments.read(spark, path, buckets=4)) == taken(late)
    assert segments.vacuum(spark, path) == 4 and len(segments.versions(spark, path)) == 1
    assert taken(segments.read(spark, path, buckets=4)) == taken(late)
    with pytest.raises(ValueError, match="no version"):
        segments.read(spark, path, version)


def test_reads_list_what_they_need(spark, path):
    df = rows(spark, range(5))
    put(df, path)
    got = segments.read(spark, path, start=2 * DAY, stop=3 * DAY, cidr=(4, 30), buckets=4)
    assert taken(got) == taken(df.where(f"stop >= {2 * DAY} AND start < {3 * DAY} AND ip_src BETWEEN 4 AND 7"))
    assert all("slice=2/" in f or "slice=1/" in f for f in got.inputFiles())
    narrow = segments.read(spark, path, cidr=(6, 31), buckets=4)
    plan = narrow._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [ip_bucket" in plan and "PushedFilters: [IsNotNull(ip_src)" in plan


def test_writers_meet(spark, path, monkeypatch):
    put(rows(spark, [0, 1]), path)
    put(rows(spark, [1], 9), path)
    commit, met = segments._commit, []

    def late(spark_, path_, version, change):
        if not met:  # another writer comes first
            met.append(1)
            put(rows(spark, [4], 11), path)
        return commit(spark_, path_, version, change)

    monkeypatch.setattr(segments, "_commit", late)
    put(rows(spark, [5], 12), path)
    assert segments.read(spark, path, buckets=4).count() == 40 * 5 and len(segments.versions(spark, path)) == 5
    assert not commit(spark, path, 2, segments.segments(spark, path))

    def purged(spark_, path_, version, change):
        monkeypatch.setattr(segments, "_commit", commit)
        segments.purge(spark, path, 9 * DAY, Retention(max_rows=50))
        return commit(spark_, path_, version, change)

    monkeypatch.setattr(segments, "_commit", purged)
    with pytest.raises(segments.Superseded):
        segments.compact(spark, path)
    assert segments.read(spark, path, buckets=4).count() == 40


def test_batches_repeat_and_awkward_rows(spark, path):
    df = rows(spark, [0])
    put(df, path, batch="7")
    put(df, path, batch="7")
    assert segments.read(spark, path, buckets=4).count() == 40 and len(segments.versions(spark, path)) == 2
    put(df.limit(0), path)
    odd = spark.createDataFrame([(1, None, None, 3), (None, 5, None, None), (None, -DAY - 1, 4, 4)], SHAPE)
    put(odd, path)
    assert taken(segments.read(spark, path, buckets=4)) == taken(df.unionByName(odd))
    assert {r.slice for r in segments.segments(spark, path).collect()} == {0, -2}
    with pytest.raises(ValueError, match="names of folders"):
        put(df.withColumn("Slice", F.lit(1)), path)
    empty = tempfile.mkdtemp(prefix="spark-") + "/empty"
    segments.create(spark, empty, df.schema)
    assert segments.read(spark, empty).count() == 0 and segments.purge(spark, empty, 0, Retention(max_rows=0)) == 0 and segments.compact(spark, empty) == 0


def test_bounds_are_settings(spark, monkeypatch):
    monkeypatch.setenv("MESHLENS_TRAFFIC_1MIN_MAX_BYTES", "5000")
    spark.conf.set("meshlens.traffic.1min.max_age", "2 days 1h")
    spark.conf.set("meshlens.traffic.1min.max_rows", "9")
    try:
        assert Retention.of(spark, "traffic.1min", {"traffic.1min.max_rows": "7"}) == Retention(49 * 3_600_000, 5000, 7)
        assert Retention.of(spark, "dns.1min") == Retention() and settings.option(spark, "none", default="x") == "x"
    finally:
        spark.conf.unset("meshlens.traffic.1min.max_age")
        spark.conf.unset("meshlens.traffic.1min.max_rows")
