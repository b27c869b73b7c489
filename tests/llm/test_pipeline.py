"""Each stage of the pipeline on awkward rows."""

from __future__ import annotations

import pytest

import corpus_pipeline as P
from tests.llm.test_corpus import ODD, key

LONG = " ".join(f"w{i}" for i in range(80))
ROWS = [*ODD, (10, LONG), (11, LONG), (11, LONG), (None, LONG), (12, "x " + LONG + " tail"), (13, "\n".join(["same line of words here"] * 40))]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, repeated and long rows, near copies, and columns with the operators' own names."""
    rows = [(i, t, "en", "s" if (i or 0) % 2 else None, len(t or ""), 5, 6, 7) for i, t in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words long, node long, _row long")


@pytest.mark.parametrize("name,stage", P.STAGES)
def test_a_stage_on_awkward_rows(spark, odd, name, stage):
    out = stage(spark, odd, "")
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=key) if name != "packing" else out.collect()
    assert stage(spark, odd.limit(0), "").count() == 0
    if name == "packing":
        assert out.select("doc_id").distinct().count() == len({i for i, _ in ROWS})
        assert sum(r.length for r in got if r.doc_id == 1) == 1  # a null text: its end id
        return
    assert out.columns == odd.columns and {r["lang"] for r in out.collect()} <= {"en"}
    if name == "quality_rules":
        assert {i for i, _ in got} <= {7, 10, 11, 12, 13, None} and got.count((11, LONG)) in (0, 2)
    elif name == "near_duplicates":
        ids = [i for i, _ in got]
        assert 10 in ids and 11 not in ids and 12 not in ids and (None, LONG) not in got
        assert {1, 2, 3} <= set(ids) and ids.count(5) == 0  # wordless texts link with nothing; 4 and 5 are equal
    elif name == "repeated_passages":
        left = dict(got)
        assert {10, 11, 13}.isdisjoint(left) and {1, 2, 3, 4, 5, 6} <= set(left)  # texts that repeat throughout go, blank ones stay
        assert left[4] == "one two" and "tail" in left[12] and len(left[12]) < 20
    else:
        assert set(got) <= {(i, t) for i, t in ROWS} and all(got.count(r) <= 2 * ROWS.count(r) for r in got)
