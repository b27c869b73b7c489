"""Counts kept up over a stream equal the counts of the whole table."""

from __future__ import annotations

from colocus.operators.cohort import crosstab
from colocus.sources.tables import cells
from colocus.streaming import composition


def test_stream_equals_batch(spark, tmp_path):
    whole = cells(spark, "/root/testdata/sf0.001").select("image", "cell_id", "x", "y", "class")
    whole.repartition(5).write.parquet(str(tmp_path / "in"))
    stream = composition.arriving_cells(spark, str(tmp_path / "in"), files_each=2)
    query = composition.keep_counts(composition.class_counts(stream, [0, 1, 2]), str(tmp_path / "out"), str(tmp_path / "ck"))
    query.awaitTermination(120)
    got = composition.latest_counts(spark, str(tmp_path / "out")).drop("n")
    want = crosstab(whole, "image", "class", [0, 1, 2], "class_")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
