"""Schemas of JSON lines over all files."""

import json

from pyspark.sql import functions as F

from postlens.sources import field_kinds, merged_schema, read_lines, schema_drift

FIRST = [{"data": {"id": "1", "text": "a", "n": 1}}, {"data": {"id": "2", "text": "b"}}]
LATER = [
    {"data": {"id": "3", "text": "c", "n": 1.5, "tags": ["x", "y"]}, "late": True},
    {"data": {"id": 4, "text": None, "more": {"k": [{"a": 1}, {"b": "z"}]}}, "none": None},
    {"data": "no object", "big": 123456789012345678901234567890, "odd name.": 1, "empty": {}, "list": []},
]


def write(folder, name, rows, extra=""):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(row) + "\n" for row in rows) + extra)


def brute(files):
    kinds = {}

    def walk(value, path, file):
        kind = {bool: "BOOLEAN", float: "DOUBLE", str: "STRING", dict: "OBJECT", list: "ARRAY"}.get(type(value), "VOID")
        if type(value) is int:
            kind = "BIGINT" if abs(value) < 1 << 63 else "DOUBLE"
        if path or kind != "OBJECT":
            entry = kinds.setdefault((path, kind), [0, set()])
            entry[0] += 1
            entry[1].add(file)
        for name, inner in value.items() if kind == "OBJECT" else ():
            walk(inner, (*path, name), file)
        for inner in value if kind == "ARRAY" else ():
            walk(inner, (*path, "[]"), file)

    for file, rows in files.items():
        for row in rows:
            walk(row, (), file)
    return {(path, kind, n, len(found)) for (path, kind), (n, found) in kinds.items()}


def test_kinds_of_all_files(spark, tmp_path):
    write(tmp_path / "in", "a.json", FIRST)
    write(tmp_path / "in", "b.json", LATER, extra='\nnot json\n[1, "x"]\n5\n')
    write(tmp_path / "in", "c.json", LATER[:1])
    kinds = field_kinds(spark, str(tmp_path / "in"))
    found = {(tuple(r["path"]), r["kind"], r["n_values"], r["n_files"]) for r in kinds.collect()}
    assert found == brute({"a": FIRST, "b": [*LATER, [1, "x"], 5], "c": LATER[:1]})
    late = kinds.where(F.col("path") == F.array(F.lit("late"))).first()
    assert late["first_file"].endswith("b.json")


def test_drift_and_schema(spark, tmp_path):
    write(tmp_path / "in", "a.json", FIRST)
    write(tmp_path / "in", "b.json", LATER)
    kinds = field_kinds(spark, str(tmp_path / "in"))
    drift = {tuple(r["path"]): (r["kinds"], r["conflict"]) for r in schema_drift(kinds).collect()}
    assert drift["data",] == (["OBJECT", "STRING"], True)
    assert drift["data", "id"] == (["BIGINT", "STRING"], True)
    assert drift["data", "n"] == (["BIGINT", "DOUBLE"], False)
    assert drift["data", "text"] == (["STRING", "VOID"], False)
    schema = merged_schema(kinds)
    assert schema["data"].dataType.simpleString() == "string"
    assert [f.name for f in schema] == ["big", "data", "empty", "late", "list", "none", "odd name."]
    objects = field_kinds(spark, str(tmp_path / "in" / "a.json")).union(
        field_kinds(spark, str(tmp_path / "in" / "b.json")).where("path[0] != 'data' OR size(path) > 1")
    )
    merged = merged_schema(objects)["data"].dataType.simpleString()
    assert merged == "struct<id:string,more:struct<k:array<struct<a:bigint,b:string>>>,n:double,tags:array<string>,text:string>"
    lines = read_lines(spark, str(tmp_path / "in"), merged_schema(objects))
    assert sorted(str(r[0]) for r in lines.select("data.id").collect()) == ["1", "2", "3", "4", "None"]


def test_no_lines(spark, tmp_path):
    write(tmp_path / "in", "a.json", [], extra="\n\nno json\n")
    kinds = field_kinds(spark, str(tmp_path / "in"))
    assert kinds.count() == 0 and schema_drift(kinds).count() == 0
    assert merged_schema(kinds).fields == []
