"""Rows found in texts: a worker takes and hands on a bounded part of a batch."""

import pyarrow as pa
import pytest

from weftline.operators import documents, segment


def batches_of(spark, monkeypatch, make):
    """What the Arrow function of ``make()`` yields for one large batch."""
    held = {}
    df = spark.createDataFrame([(1, "x")], "id long, text string")
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: held.update(run=run) or self)
    make(df)
    texts = [f"text {i % 7} " + "word. " * 4000 for i in range(1000)]
    batch = pa.RecordBatch.from_pydict({"id": list(range(1000)), "text": texts})
    return list(held["run"](iter([batch])))


@pytest.mark.parametrize("make", [lambda df: segment.uniform_rows(df, "id", "text", 1000), lambda df: segment.headed_rows(df, "id", "text"), lambda df: documents.parsed_rows(df, "id", "text", lambda t: [(t,)], "t string")])
def test_a_worker_hands_on_bounded_parts(spark, monkeypatch, make):
    got = batches_of(spark, monkeypatch, make)
    assert len(got) > 10 and max(b.nbytes for b in got) < 3 * documents.HAND_ON
    assert sorted(set(k for b in got for k in b.column(0).to_pylist())) == list(range(1000))


def test_a_repeated_text_is_looked_at_once_a_slice(spark, monkeypatch):
    seen = []
    batches_of(spark, monkeypatch, lambda df: documents.parsed_rows(df, "id", "text", lambda t: seen.append(t) or [(len(t),)], "n int"))
    assert len(seen) <= 7 * -(-1000 // documents.READ)
