"""Sniffed scans, kept results, archives by ranges, provenance."""

from __future__ import annotations

import gzip
import hashlib
import io
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from colocus.operators.provenance import Run
from colocus.sources import archives, cache, files
from colocus.sources.store import listing

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "id long, name string, score double"


# separators


@pytest.mark.parametrize("sep", [";", ",", "\t", "|"])
@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(alphabet='ab ;,|"\t\n', max_size=8), min_size=1, max_size=6))
def test_dialect_of_quoted_values(sep, values):
    import csv

    out = io.StringIO(newline="")
    w = csv.writer(out, delimiter=sep, quoting=csv.QUOTE_NONNUMERIC)
    w.writerow(["id", "name", "score"])
    for i, v in enumerate(values):
        w.writerow([i, v, 0.5])
    assert files.dialect(out.getvalue().encode(), True) == (sep, ["id", "name", "score"])


def test_dialect_of_odd_heads():
    assert files.dialect(b"", True) is None
    assert files.dialect(b"\xef\xbb\xbfa;b\r\n1;2\r\n", True) == (";", ["a", "b"])
    assert files.dialect(b"word\none\ntwo\n", True) == (",", ["word"])
    assert files.dialect(b"a\tb,c\n1\t2\n3\t4,5\n5\t", False) == ("\t", ["a", "b,c"])  # the last record is cut off
    with pytest.raises(ValueError):
        files.dialect(b"a,b\n1\n2;3;4\n1|2\n5\t5\t5\n", True)


def test_mixed_files_are_one_table(spark, tmp_path):
    (tmp_path / "a b.csv").write_text('id;name;score\n1;"x;y";0.5\n2;;\n')
    (tmp_path / "b.csv").write_text("id\tname\tscore\n3\tz\t1\n")
    (tmp_path / "c.csv.gz").write_bytes(gzip.compress(b"id,name,score\n4,q,2.5\n"))
    (tmp_path / "d.csv").write_text("")
    df = files.read_sniffed(spark, str(tmp_path), SCHEMA)
    assert sorted(map(tuple, df.collect())) == [(1, "x;y", 0.5), (2, None, None), (3, "z", 1.0), (4, "q", 2.5)]
    assert files.read_sniffed(spark, str(tmp_path), SCHEMA, ["name"]).columns == ["name"]
    (tmp_path / "e.csv").write_text("id,score,name\n1,2,x\n")
    with pytest.raises(ValueError, match="e.csv"):
        files.read_sniffed(spark, str(tmp_path), SCHEMA)


def test_only_the_head_of_a_file_is_looked_at(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id;name;score\n" + "1;x;2\n" * 50_000 + "no more of this\n")
    r = files.dialects(spark, str(tmp_path), head=1000).first()
    assert (r.separator, r.header, r.fault) == (";", ["id", "name", "score"], None)


# kept results


def test_results_are_kept_by_parameters_and_inputs(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "in"))
    made = []

    def ask(limit, **more):
        def build():
            made.append(limit)
            return spark.read.parquet(str(tmp_path / "in")).filter(F.col("id") < limit)

        return cache.cached(spark, str(tmp_path / "kept"), "below", {"limit": limit, **more}, [str(tmp_path / "in")], build)

    df, hit = ask(4, a=1)
    assert not hit and df.count() == 4
    df, hit = ask(4, a=1)
    assert hit and df.count() == 4 and made == [4]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1 and "DataFilters: []" in plan and all("kept/below" in f for f in df.inputFiles())
    assert not ask(5, a=1)[1] and not ask(4, a=2)[1]
    spark.range(10, 12).write.mode("append").parquet(str(tmp_path / "in"))
    assert not ask(4, a=1)[1] and made == [4, 5, 4, 4]
    assert len(listing(spark, str(tmp_path / "in"))) == len(list((tmp_path / "in").glob("*.parquet")))


def test_the_second_of_two_writers_drops_its_copy(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "in"))

    def other():
        return spark.range(7).toDF("mine")

    def build():  # while this one computes, another writer finishes
        cache.cached(spark, str(tmp_path / "kept"), "n", {}, [str(tmp_path / "in")], other)
        return spark.range(5).toDF("late")

    df, hit = cache.cached(spark, str(tmp_path / "kept"), "n", {}, [str(tmp_path / "in")], build)
    assert not hit and df.columns == ["mine"] and df.count() == 7
    assert [p.name[:1] for p in (tmp_path / "kept" / "n").iterdir() if not p.name.startswith(".")] != ["_"]
    assert len(list((tmp_path / "kept" / "n").glob("*"))) == 1


def test_a_failed_build_leaves_nothing_to_find(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "in"))
    ask = lambda build: cache.cached(spark, str(tmp_path / "kept"), "n", {}, [str(tmp_path / "in")], build)
    with pytest.raises(Exception, match="boom"):
        ask(lambda: spark.range(3).select(F.raise_error(F.lit("boom"))))
    df, hit = ask(lambda: spark.range(3))
    assert not hit and df.count() == 3


# archives


def test_members_round_trip(spark, tmp_path):
    rows = [(f"m{i}/é {i}.txt", b"x" * i if i % 3 else None) for i in range(200)] + [("big", bytes(range(256)) * 5000)]
    df = spark.createDataFrame(rows, "member string, content binary").repartition(3)
    made = archives.write_archives(df, f"file://{tmp_path}/zips", archive_bytes=5_000).cache()
    assert made.agg(F.sum("members")).first()[0] == len(rows) and made.count() > 5
    entries = archives.members(made)
    got = archives.contents(entries, task_bytes=500).collect()
    assert {r.member: bytes(r.content) for r in got} == {m: c or b"" for m, c in rows} and all(r.fault is None for r in got)
    assert archives.contents(entries.limit(0)).count() == 0
    one = entries.filter("member = 'big'").first()
    with zipfile.ZipFile(one.archive.removeprefix("file://")) as z:
        assert hashlib.md5(z.read("big")).digest() == hashlib.md5(rows[-1][1]).digest()


def test_faulty_members_say_so(spark, tmp_path):
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("good", b"good " * 100)
        z.writestr("bad", bytes(range(250)))
        z.writestr(zipfile.ZipInfo("stored"), b"plain", zipfile.ZIP_STORED)
        z.writestr("other", b"x" * 99, zipfile.ZIP_BZIP2)
        z.mkdir("folder")
    raw = bytearray(path.read_bytes())
    raw[raw.index(bytes(range(100, 150))) + 3] ^= 255
    path.write_bytes(raw)
    entries = archives.members(spark.createDataFrame([(str(path),)], "archive string"))
    got = {r.member: (r.content and bytes(r.content), r.fault) for r in archives.contents(entries).collect()}
    assert got["good"] == (b"good " * 100, None) and got["stored"] == (b"plain", None)
    assert got["bad"] == (None, "wrong checksum") and got["other"] == (None, "method 12") and len(got) == 4
    lost = archives.contents(entries.filter("member = 'good'").withColumn("at", F.lit(7).cast("long"))).first()
    assert lost.fault == "no member there"


def test_files_are_held_to_their_manifest(spark, tmp_path):
    for name, data in (("a", b"one"), ("b", b"two" * 1_000_000), ("c", b"")):
        (tmp_path / name).write_bytes(data)
    rows = [(str(tmp_path / n), len(d), hashlib.sha256(d).hexdigest().upper()) for n, d in (("a", b"one"), ("b", b"two" * 1_000_000), ("c", b""))]
    df = spark.createDataFrame(rows, "path string, bytes long, sha256 string")
    assert archives.manifest_faults(df).count() == 0
    (tmp_path / "a").write_bytes(b"0ne")
    assert [r.path for r in archives.manifest_faults(df).collect()] == [str(tmp_path / "a")]


# provenance


def test_records_ride_along_with_one_run(spark, tmp_path):
    """The reads and the sink are counted in one job run; digests do not depend on the order of rows."""
    orders = spark.read.parquet(f"{FOLDER}/orders.parquet").select("o_orderkey", F.when(F.col("o_orderkey") % 4 > 0, F.col("o_custkey")).alias("o_custkey"))
    tracker = spark.sparkContext.statusTracker()
    records = []
    for parts in (1, 7):
        spark.sparkContext.setJobGroup(f"provenance-{parts}", "")
        run = Run(spark, "r")
        df = run.read(orders.repartition(parts), "orders", FOLDER)
        run.write(df.filter("o_custkey IS NOT NULL"), "known", "there", lambda x: x.write.mode("overwrite").parquet(str(tmp_path / "out")))
        records.append(run.records)
        rows = spark.sparkContext.statusTracker().getJobIdsForGroup(f"provenance-{parts}")
        assert 1 <= len(rows) <= 2  # the write, with its shuffle as a job of its own
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert tracker is not None
    read, wrote = records[0]
    n, known = orders.count(), orders.filter("o_custkey IS NOT NULL").count()
    assert (read["rows"], read["nulls"], read["role"]) == (n, {"o_orderkey": 0, "o_custkey": n - known}, "read")
    assert (wrote["rows"], wrote["nulls"]) == (known, {"o_orderkey": 0, "o_custkey": 0})
    assert [r["digest"] for r in records[0]] == [r["digest"] for r in records[1]] and read["digest"] != wrote["digest"]
    md5 = sum(int(hashlib.md5("\x1f".join("\x1e" if v is None else str(v) for v in r).encode()).hexdigest()[:8], 16) for r in orders.collect())
    assert int(read["digest"]) == md5


def test_no_rows_are_a_record_too(spark, tmp_path):
    run = Run(spark, "r")
    df = run.read(spark.range(5).filter("false"), "none")
    run.write(df, "none", "there", lambda x: x.write.mode("overwrite").parquet(str(tmp_path / "out")))
    assert [(r.role, r["rows"], r.nulls) for r in run.table().collect()] == [("read", 0, {"id": 0}), ("write", 0, {"id": 0})]
