"""Files of a series: mixed timestamps, order over splits, and the tree of hashes."""

import hashlib
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from foldspark.sources.market import canonical_row, fingerprint, read_market_csv
from foldspark.sources.times import parse_time

UTC = timezone.utc
THIRD = datetime(2024, 1, 3, tzinfo=UTC)
EVENING = datetime(2024, 1, 3, 22, 5, tzinfo=UTC)
FORMS = {
    THIRD: ["2024-01-03", "2024/1/3", "2024.01.03", "20240103", "01/03/2024", "1-3-2024", "Jan 3 2024", "January 3, 2024", "Jan. 3rd, 2024", "jan-03-2024", "3 Jan 2024", "03-JAN-2024", "3 January, 2024", "3Jan 2024", "Wed, 3 Jan 2024", "Wednesday, January 3, 2024", "2024 Jan 3", "2024-Jan-03", " 2024-01-03 ", "2024-01-03T00:00:00Z", "2024-01-03 02:00+02:00", "2024-01-02T19:00:00-0500", "2024-01-03 12:00 AM", "20240103 00:00"],
    EVENING: ["2024-01-03T22:05", "2024-01-03 22:05:00", "01/03/2024 10:05 PM", "Jan 3, 2024, 10:05pm", "3 Jan 2024 22:05:00 GMT", "2024-01-04T00:05:00+02", "2024-01-03 22:05:00.000000Z", "20240103T22:05:00"],
    datetime(2024, 1, 13, tzinfo=UTC): ["13/01/2024", "01/13/2024", "13.1.2024"],
    datetime(2024, 9, 30, 1, 2, 3, 456000, tzinfo=UTC): ["Sept 30 2024 01:02:03.456", "2024-09-30 01:02:03,456", "2024-09-30T01:02:03.456000999Z"],
    datetime(2024, 2, 1, tzinfo=UTC): ["2024-02", "2024-02-01"],
    datetime(2024, 1, 1, tzinfo=UTC): ["2024"],
}
REFUSED = ["", "bad-date", "2024-13-01", "2024-02-30", "01/32/2024", "13/13/2024", "3 Foo 2024", "Janu 3 2024", "01/03/24", "2024-01-03 25:00", "2024-01-03 13:00 PM", "2024-01-03 10:61", "2024-01-03T10:00:00+99:00", "10:00", "2024-01/03", "2024-01-03 x", "1704067200"]


def test_each_text_by_its_shape(spark):
    texts = [t for forms in FORMS.values() for t in forms] + REFUSED
    random.Random(0).shuffle(texts)
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    got = {r["t"]: r["s"] for r in df.select("t", parse_time("t").cast("long").alias("s")).collect()}
    for time, forms in FORMS.items():
        assert {t: got[t] for t in forms} == {t: int(time.timestamp()) for t in forms}
    assert {t: got[t] for t in [*REFUSED, None]} == dict.fromkeys([*REFUSED, None])
    fractions = df.filter("t LIKE '%456%'").select(parse_time("t").cast("double").alias("s")).collect()
    assert {round(r["s"] % 1, 6) for r in fractions} == {0.456}


def test_forms_mix_in_one_file(spark, tmp_path):
    lines = ["2024-01-02,1,1", "Jan 3 2024,2,1", "01.04.2024,3,1", "5 January 2024,4,1", "20240106,5,1", "2024-01-07T00:00:00+01:00,6,1"]
    path = tmp_path / "mixed.csv"
    path.write_text("timestamp,close,volume\n" + "\n".join(lines) + "\n")
    made = read_market_csv(spark, str(path)).observations.orderBy("ts")
    assert [r["close"] for r in made.collect()] == [1, 2, 3, 4, 5, 6]


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_order_over_splits(spark, tmp_path, small_splits):
    """Faults between every two neighbouring lines of a file of some ten splits, so at each edge of a split too."""
    start = datetime(2020, 1, 1)
    lines = [f"{start + timedelta(hours=i)},{100 + i},{i}" for i in range(600)]

    def read(changed):
        path = tmp_path / f"{hash(tuple(changed)) & 2**60}.csv"
        path.write_text("\n".join(["timestamp,close,volume", *changed]) + "\n")
        return read_market_csv(spark, str(path))

    fine = read(lines)
    splits = fine.observations.select("ts").rdd.getNumPartitions()
    assert splits >= 8 and fine.metadata()["raw_observations"] == 600
    size, edges = 0, []
    for i, line in enumerate(["timestamp,close,volume", *lines]):
        if size // 2000 != (size + len(line) + 1) // 2000:
            edges.append(i - 1)
        size += len(line) + 1
    for i in edges[:4]:
        for at in (i - 1, i, i + 1):
            swapped = [*lines[:at], lines[at + 1], lines[at], *lines[at + 2 :]]
            with pytest.raises(ValueError, match="increasing"):
                read(swapped)
            with pytest.raises(ValueError, match="unique"):
                read([*lines[: at + 1], lines[at], *lines[at + 1 :]])
    with pytest.raises(ValueError, match="unique"):
        read([*lines, lines[10]])  # a repeat far away


@pytest.mark.parametrize("run", [2, 5, 4096])
def test_fingerprint_is_a_tree(spark, run):
    rows = [(s, i, float(i * i % 7), 1.0) for s, n in (("a", 1), ("b", 5), ("c", 23)) for i in range(n)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "series_id string, ts long, close double, volume double").withColumn("ts", F.timestamp_seconds("ts"))
    texts = {}
    for r in df.select("series_id", "ts", canonical_row(df).alias("t")).orderBy("ts").collect():
        texts.setdefault(r["series_id"], []).append(r["t"])
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = {}
    for s, level in texts.items():
        level = [sha(t) for t in level]
        while True:
            level = [sha("\n".join(level[i : i + run])) for i in range(0, len(level), run)]
            if len(level) == 1:
                break
        want[s] = level[0]
    assert {r["series_id"]: r["sha256"] for r in fingerprint(df, run).collect()} == want
    alone = fingerprint(df.filter("series_id = 'b'"), run).first()
    assert alone["sha256"] == want["b"]  # whatever other series are longer
