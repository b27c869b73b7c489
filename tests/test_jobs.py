"""The jobs: whole runs against their SQL, reruns, growing input, failures halfway."""

from __future__ import annotations

import json
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import queries, spatial_features, text_audit
from jobs.common import config_of

FOLDER = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]


def rows_of(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_jobs_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS FROM '{FOLDER}/{t}.parquet'")
    found = con.execute(queries.ORACLES[name])
    names = [c[0] for c in found.description]
    df = queries.QUERIES[name](spark, FOLDER)
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(r[names.index(c)] for c in sorted(names)) for r in found.fetchall()), key=lambda r: [(v is None, str(v)) for v in r])
    assert rows_of(df) == want


def audit(spark, path, name="in", **settings):
    return text_audit.run(spark, str(path / name), f"{FOLDER}/labels.parquet", str(path / "out"), str(path / "ck"), config_of(text_audit.__file__) | settings)


def test_audit_takes_only_what_is_new(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    docs.filter("doc_id % 2 = 0").repartition(3).write.parquet(str(tmp_path / "in"))
    first = audit(spark, tmp_path, files_each=2)
    taken = [r["rows"] for r in first.records if r["name"].startswith("documents of batch")]
    assert len(taken) == 2 and sum(taken) == docs.filter("doc_id % 2 = 0").count()
    odd = spark.createDataFrame([(900, None, None, None, 0), (901, " \n", "", "src1", 2), (901, " \n", "", "src1", 2)], docs.schema)
    docs.filter("doc_id % 2 = 1").union(odd).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    second = audit(spark, tmp_path)
    assert [r["rows"] for r in second.records if r["name"].startswith("documents of batch")] == [docs.filter("doc_id % 2 = 1").count() + 3]
    got = rows_of(text_audit.summary(spark, str(tmp_path / "out")))
    agreed = rows_of(spark.read.parquet(str(tmp_path / "out" / "agreement")))
    third = audit(spark, tmp_path)
    assert not [r for r in third.records if "batch" in r["name"]]
    assert rows_of(text_audit.summary(spark, str(tmp_path / "out"))) == got
    # the same documents at once, in another folder
    docs.union(odd).write.parquet(str(tmp_path / "once" / "in"))
    audit(spark, tmp_path / "once")
    assert rows_of(text_audit.summary(spark, str(tmp_path / "once" / "out"))) == got
    assert rows_of(spark.read.parquet(str(tmp_path / "once" / "out" / "agreement"))) == agreed
    kinds = {r.doc_id: r["class"] for r in spark.read.parquet(str(tmp_path / "out" / "classified")).collect()}
    assert kinds[900] == kinds[901] == "empty" and len(kinds) == docs.count() + 2


def test_a_batch_that_failed_halfway_is_repeated(spark, tmp_path, monkeypatch):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    docs.repartition(2).write.parquet(str(tmp_path / "in"))
    whole = text_audit.against

    def fails(*args):
        raise RuntimeError("lost")

    monkeypatch.setattr(text_audit, "against", fails)
    with pytest.raises(Exception, match="lost"):
        audit(spark, tmp_path)
    monkeypatch.setattr(text_audit, "against", whole)
    audit(spark, tmp_path)
    counts = spark.read.parquet(str(tmp_path / "out" / "counts"))
    assert counts.agg(F.sum("n")).first()[0] == docs.count() == spark.read.parquet(str(tmp_path / "out" / "classified")).count()


def test_audit_of_an_empty_table(spark, tmp_path):
    spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0).write.parquet(str(tmp_path / "in"))
    audit(spark, tmp_path)
    assert text_audit.summary(spark, str(tmp_path / "out")).count() == 0
    assert spark.read.parquet(str(tmp_path / "out" / "agreement")).count() == 1


def test_agreement_is_that_of_the_rows(spark, tmp_path):
    spark.read.parquet(f"{FOLDER}/documents.parquet").write.parquet(str(tmp_path / "in"))
    audit(spark, tmp_path)
    truth = {r.doc_id: "good" if r.quality == 1 else "poor" for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    said = {r.doc_id: r["class"] for r in spark.read.parquet(str(tmp_path / "out" / "classified")).collect()}
    both = [(t, "good" if said[i] in ("prose", "long") else "poor") for i, t in truth.items() if i in said and said[i] != "empty"]
    same = sum(a == b for a, b in both) / len(both)
    chance = sum(sum(a == c for a, _ in both) * sum(b == c for _, b in both) for c in ("good", "poor")) / len(both) ** 2
    r = spark.read.parquet(str(tmp_path / "out" / "agreement")).first()
    assert r.n == len(both) and r.agreement == pytest.approx(same) and r.kappa == pytest.approx((same - chance) / (1 - chance))


def test_fewer_blocks_renew_only_theirs(spark, tmp_path):
    events, target, config = f"{FOLDER}/events.parquet", str(tmp_path / "out"), config_of(spatial_features.__file__)
    record = spatial_features.run(spark, events, target, config)
    n = spark.read.parquet(events).count()
    assert [r["rows"] for r in record.records if r["role"] == "read"] == [n]
    before = rows_of(spatial_features.features(spark, target))
    assert {r["name"]: r["rows"] for r in record.records if r["role"] == "write" and r["name"] != "edges"} == {b: sum(x[0] == b for x in before) for b in config["blocks"]}
    files = {p: p.stat().st_mtime_ns for p in Path(target, "features").glob("block=*/*.parquet")}
    spatial_features.run(spark, events, target, config | {"blocks": ["mixing"]})
    after = {p: p.stat().st_mtime_ns for p in Path(target, "features").glob("block=*/*.parquet")}
    assert {p for p in files if "block=mixing" not in str(p)} == {p for p in after if "block=mixing" not in str(p) and files.get(p) == after[p]}
    assert rows_of(spatial_features.features(spark, target)) == before
    small = spatial_features.run(spark, events, str(tmp_path / "none"), config | {"least_cells": 10_000, "blocks": ["composition", "mixing"]})
    assert all(r["rows"] == 0 for r in small.records)


def test_settings_come_from_files(tmp_path):
    own = config_of(text_audit.__file__)
    (tmp_path / "c.json").write_text(json.dumps({"short_words": 9}))
    assert config_of(text_audit.__file__, str(tmp_path / "c.json")) == own | {"short_words": 9}
    (tmp_path / "d.json").write_text(json.dumps({"shrot_words": 9}))
    with pytest.raises(ValueError, match="shrot_words"):
        config_of(text_audit.__file__, str(tmp_path / "d.json"))


def test_command_line(tmp_path):
    args = [sys.executable, "-m", "jobs.text_audit", "--documents", f"{FOLDER}/documents.parquet", "--labels", f"{FOLDER}/labels.parquet", "--target", str(tmp_path / "out"), "--checkpoint", str(tmp_path / "ck")]
    ran = subprocess.run(args, cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert ran.returncode == 0, ran.stderr[-2000:]
    assert "text_audit write composition: " in ran.stderr and list((tmp_path / "out" / "composition").glob("class=prose/*.parquet"))
