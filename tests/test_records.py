"""Prediction records written by tasks in order, their listing, and documents written item by item."""

import json

import pytest

from foldspark.plans.records import in_order, prediction_records, read_records, write_document, write_records


@pytest.fixture(scope="module")
def rows(spark):
    made = [(s, i, i, m, float(i) / 7, float(i + k)) for s, n in (("b", 40), ("a", 25)) for i in range(5, n) for k, m in enumerate(("zero", "it's"))]
    return spark.createDataFrame(made[::-1], "series_id string, ts long, row_idx long, model string, actual double, prediction double")


def test_sink(spark, rows, tmp_path):
    records = prediction_records(rows, ["zero", "it's"])
    folder = f"file://{tmp_path}/sink"
    listing = [tuple(r) for r in write_records(records, folder).collect()]
    assert sum(r[1] for r in listing) == records.count() == 55
    assert [r[2:4] for r in listing] == sorted(r[2:4] for r in listing) and len(listing) > 1
    # Files one after another are in order, each by itself too.
    lines = [json.loads(line) for r in listing for line in (tmp_path / "sink/records" / r[0]).read_text().splitlines()]
    assert [(x["series_id"], x["row_idx"]) for x in lines] == [(s, i) for s, n in (("a", 25), ("b", 40)) for i in range(5, n)]
    back = read_records(spark, folder, records.schema)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, records.collect()))
    (tmp_path / "sink/records/part-stray.json").write_text('{"series_id": "z"}\n')  # not in the listing
    assert read_records(spark, folder, records.schema).count() == 55
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_records(spark, f"file://{tmp_path}/none", records.schema)


def test_empty_sink(spark, rows, tmp_path):
    records = prediction_records(rows.filter("false"), ["zero"])
    assert write_records(records, f"file://{tmp_path}/e").collect() == []
    assert read_records(spark, f"file://{tmp_path}/e", records.schema).collect() == []


def test_documents_by_items(spark, rows, tmp_path):
    items = list(in_order(prediction_records(rows, ["zero", "it's"])))
    assert items[0] == {"timestamp": "5", "actual": 5 / 7, "zero": 5.0, "it's": 6.0} and len(items) == 55
    for document in ({"a": {"b": [1, "x"]}, "n": None}, {}, {"list": 3, "é": "\n"}):
        for some in (items, []):
            path = write_document(tmp_path / "d/doc.json", document, "list", iter(some))
            assert json.loads(path.read_text()) == {**document, "list": some}
