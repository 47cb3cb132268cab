import json
import os

import pytest
from conftest import rows
from pyspark.sql import functions as F

from weir.plans.ingest import put_text
from weir.sources import xml as xs
from weir.sources.devices import normalize_device_messages
from weir.sources.envelope import envelope
from weir.sources.files import export_files, incremental_files, merged, resolve_schema, stored_schema
from weir.sources.state_vectors import StateVectorDataSource, parse_state_vectors, read_state_vectors
from weir.streaming.sinks import to_memory
from weir.streaming.tables import append_new

XML = """<list><sp id="1"><name>Ape</name><year>1900</year><tag>x</tag><tag>y</tag></sp>
<sp id="2"><name>Bat</name><year>1950</year></sp><sp><name>Cat</name><year>1960</year></sp></list>"""
NEW_XML = """<list><sp id="3"><name>Dog</name><year>1970</year><population>12</population></sp></list>"""
XSD = """<?xml version="1.0"?><xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:element name="sp"><xs:complexType><xs:sequence>
<xs:element name="name" type="xs:string"/><xs:element name="year" type="xs:integer"/>
<xs:element name="tag" type="xs:string" minOccurs="0" maxOccurs="unbounded"/></xs:sequence>
<xs:attribute name="id" type="xs:int"/></xs:complexType></xs:element></xs:schema>"""
SCHEMA = "_id INT, name STRING, year INT, tag ARRAY<STRING>"


def test_xml_attributes_and_repeats(spark):
    df = xs.xml_rows(spark, put_text(spark, XML, "x"), "sp")
    got = {r.name: (r._id, r.tag) for r in df.collect()}
    assert got == {"Ape": (1, ["x", "y"]), "Bat": (2, None), "Cat": (None, None)}


def test_xml_text_only_rows_are_values(spark):
    assert rows(xs.xml_rows(spark, put_text(spark, XML, "x"), "name")) == [("Ape",), ("Bat",), ("Cat",)]


def test_xml_view(spark):
    xs.xml_view(spark, "species", put_text(spark, XML, "x"), "sp")
    assert spark.sql("SELECT count(*) FROM species WHERE year < 1955").first()[0] == 2


def test_xsd_splits_rows(spark):
    xsd = put_text(spark, XSD, "xsd")
    schema = f"{SCHEMA}, {xs.CORRUPT} STRING"
    good, bad = xs.split_valid(xs.xml_rows(spark, put_text(spark, XML, "x"), "sp", schema, xsd))
    assert good.count() == 3 and bad.count() == 0
    good, bad = xs.split_valid(xs.xml_rows(spark, put_text(spark, NEW_XML, "x"), "sp", schema, xsd))
    assert good.count() == 0 and "population" in bad.first()[0]


def test_unmatched_fields_are_rescued(spark):
    expected = spark.createDataFrame([], SCHEMA).schema
    out = xs.rescue_unmatched(xs.xml_rows(spark, put_text(spark, NEW_XML, "x"), "sp"), expected)
    assert out.columns == [*expected.names, "_rescued_data"]
    assert json.loads(out.first()._rescued_data) == {"population": 12}


def test_schema_is_stored_and_evolves(spark, tmp_path):
    data, kept = str(tmp_path / "d"), str(tmp_path / "s")
    spark.createDataFrame([(1,)], "a INT").write.json(data)
    assert resolve_schema(spark, data, "json", kept).names == ["a"]
    spark.createDataFrame([(2, "x")], "a INT, b STRING").write.mode("append").json(data)
    assert resolve_schema(spark, data, "json", kept).names == ["a"]
    assert resolve_schema(spark, data, "json", kept, evolve=True).names == ["a", "b"]
    assert stored_schema(spark, kept)[1] == 2
    assert stored_schema(spark, str(tmp_path / "none")) is None


def test_only_new_files_are_read(spark, tmp_path):
    land, table, ck = (str(tmp_path / n) for n in ("l", "t", "c"))
    for part in (spark.range(5), spark.range(5, 8)):
        export_files(part, land, "json", 2)
        append_new(incremental_files(spark, land, "json", "id BIGINT"), table, ck)
    assert rows(spark.read.parquet(table)) == [(i,) for i in range(8)]
    append_new(incremental_files(spark, land, "json", "id BIGINT"), table, ck)
    assert spark.read.parquet(table).count() == 8
    with pytest.raises(ValueError):
        incremental_files(spark, land, "json")


def vector(*changes):
    v = ["abc", "CS1 ", "Malta", "0", "10", "14.4", "35.9", "900", "false", "100.5", "90", "1.5", "[1,2]", "950", "1000", "true", "0", "3"]
    for i, x in changes:
        v[i] = x
    return v


def test_state_vectors(spark):
    given = [vector(), vector()[:16], vector((6, None)), vector((9, "fast"), (15, None)), vector()[:17], vector((0, None))]
    df = spark.createDataFrame([(5, v) for v in given], "time BIGINT, state ARRAY<STRING>")
    out = parse_state_vectors(df).collect()
    assert len(out) == 3
    assert out[0].time_position.timestamp() == 0 and out[0].sensors == [1, 2] and out[0].category == 3
    assert out[1].velocity is None and out[1].spi is None
    assert out[2].category is None and len(out[0]) == 18


def test_state_vector_options():
    for bad in ({}, {"path": "x", "client_id": "i"}, {"path": "x", "region": "moon"}):
        with pytest.raises(ValueError):
            StateVectorDataSource(bad)
    assert StateVectorDataSource({"path": "x"}).schema() == "time BIGINT, state ARRAY<STRING>"


def snapshot(folder, time, *vectors):
    file = folder / f"states_{time}.json"
    file.write_text(json.dumps({"time": time, "states": list(vectors)}))
    return file


def test_state_vector_batch_and_region(spark, tmp_path):
    snapshot(tmp_path, 100, ["abc", "C", "Malta", None, 10, 14.4, 35.9, None, False, 1, 2, 3, None, 4, None, True, 0])
    snapshot(tmp_path, 200, ["def", "C", "Peru", None, 10, -76.0, -10.0, None, True, 1, 2, 3, [7], 4, "77", False, 0])
    every = read_state_vectors(spark, str(tmp_path), "global")
    assert rows(every, "icao24", "on_ground", "sensors", "squawk") == [("abc", False, None, None), ("def", True, [7], "77")]
    assert rows(read_state_vectors(spark, str(tmp_path), "EUROPE"), "icao24") == [("abc",)]
    assert read_state_vectors(spark, str(tmp_path)).count() == 0      # default: North America


def test_state_vector_stream_takes_each_snapshot_once(spark, tmp_path):
    land, ck = tmp_path / "land", str(tmp_path / "ck")
    land.mkdir()
    one = lambda icao: [icao, "C", "Malta", None, 10, 14.4, 35.9, None, False, 1, 2, 3, None, 4, None, True, 0]
    snapshot(land, 100, one("a"))
    run = lambda: append_new(
        read_state_vectors(spark, str(land), "EUROPE", stream=True, manifest=str(tmp_path / "taken")).select("icao24"), str(tmp_path / "t"), ck)
    run()
    late = snapshot(land, 200, one("b"), one("c"))
    os.utime(late, (1, 1))                         # a file whose time lies before all that was taken
    run()
    run()
    assert rows(spark.read.parquet(str(tmp_path / "t"))) == [("a",), ("b",), ("c",)]


def test_broken_snapshot_fails_the_query(spark, tmp_path):
    (tmp_path / "states_1.json").write_text("{not json")
    with pytest.raises(Exception):
        read_state_vectors(spark, str(tmp_path), "GLOBAL").collect()


def test_device_messages(spark):
    msgs = [
        {"clientId": "a", "timestamp": "2024-01-01T00:00:00Z", "location": {"latitude": 1.5, "speed": "NaN"}},
        {"clientId": "b", "timestamp": "2024-01-01T02:00:00+02:00", "acceleration": {"x": "Infinity", "y": 2}},
        {"clientId": "c", "timestamp": "yesterday"}, {"clientId": "d"},
    ]
    df = spark.createDataFrame([(json.dumps(m),) for m in msgs], "m STRING")
    out = {r.client_id: r for r in normalize_device_messages(df, "m").collect()}
    assert set(out) == {"a", "b"}
    assert out["a"].timestamp == out["b"].timestamp == 1_704_067_200_000_000
    assert out["a"].latitude == 1.5 and out["a"].speed is None and out["b"].acceleration_x is None
    assert out["b"].acceleration_y == 2.0 and len(out["a"].id) == 36


def test_envelope_keeps_headers(spark):
    rec = spark.createDataFrame([("t", 1, b"v", [("k", b"x")])], "topic STRING, offset BIGINT, value BINARY, headers ARRAY<STRUCT<key: STRING, value: BINARY>>")
    out = envelope(rec.withColumn("timestamp", F.current_timestamp()))
    assert out.columns == ["topic", "offset", "timestamp", "msg", "headers"] and out.first().msg == "v"


def test_merged_schemas_keep_nested_fields_and_widen():
    from pyspark.sql.types import StructType

    old = StructType.fromDDL("a STRUCT<x: INT>, b INT, c ARRAY<STRUCT<p: INT>>, d DATE, e INT, g STRING")
    new = StructType.fromDDL("a STRUCT<x: BIGINT, y: STRING>, b DOUBLE, c ARRAY<STRUCT<q: INT>>, d TIMESTAMP, e BOOLEAN, f INT, g ARRAY<STRING>")
    want = StructType.fromDDL("a STRUCT<x: BIGINT, y: STRING>, b DOUBLE, c ARRAY<STRUCT<p: INT, q: INT>>, d TIMESTAMP, e STRING, g ARRAY<STRING>, f INT")
    assert merged(old, new).simpleString() == want.simpleString()
