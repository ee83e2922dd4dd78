"""Key paths over a table: dotted names and keys, lists, what is missing."""

import json

import pytest

from quillspark.operators import keypaths


@pytest.fixture(scope="module")
def found(spark):
    entities = [
        ("x/App.md", "App", "The App", {"title": "T", "list": [1, {"k": None}], "a.b": "dotted", "a": {"b": "nested", "0": "zero"}, "it's": 1}),
        ("x/App.v2.md", "App.v2", "App.v2", {"list": "of v2"}),
        ("y/App.md", "App", "Other", {"title": "later"}),
        ("y/services.md", "services", "services", {"Web": {"ports": "of the note"}}),
    ]
    e = spark.createDataFrame([(p, s, t, json.dumps(h)) for p, s, t, h in entities], "rel_path string, stem string, title string, metadata_json string")
    s = spark.createDataFrame([("Web", "web_*", "80", "h", "n", "1", "r", "x/App.md")], ", ".join(f"{c} string" for c in keypaths._FIELDS))
    asked = ["App.title", "app.list.0", "App.list.1.k", "App.list.1.z", "App.list.2", "App.a.b", "App.a.0", "App.v2.list", "App.it's", "entities.App.title", "services.web.ports", "services.web_*.host",
             "services.Web", "services.Nope.x", "y/App.title", "The App.title", "nothing.x", "", " . ", "App"]
    rows = keypaths.lookup(spark.createDataFrame([(a,) for a in asked + ["App.title"]], "path string"), s, e).collect()
    assert len({r.path for r in rows}) == len(rows)
    return {r.path: (r.source, r.rel_path, None if r.value is None else json.loads(r.value), r.value) for r in rows}


@pytest.mark.parametrize("path, source, rel_path, value", [
    ("App.title", "notes", "x/App.md", "T"), ("app.list.0", "notes", "x/App.md", 1), ("App.a.b", "notes", "x/App.md", "dotted"), ("App.a.0", "notes", "x/App.md", "zero"),
    ("App.v2.list", "notes", "x/App.v2.md", "of v2"), ("App.it's", "notes", "x/App.md", 1), ("entities.App.title", "entities", "x/App.md", "T"), ("services.web.ports", "services", "x/App.md", "80"),
    ("services.web_*.host", "services", "x/App.md", "h"), ("y/App.title", "notes", "y/App.md", "later"), ("The App.title", "notes", "x/App.md", "T"),
])
def test_values(found, path, source, rel_path, value):
    assert found[path][:3] == (source, rel_path, value)


def test_what_leads_nowhere(found):
    assert found["App.list.1.k"][3] == "null" and found["App.list.1.z"][3] is None and found["App.list.2"][3] is None
    assert found["services.Nope.x"][1:] == ("y/services.md", None, None)  # falls through to the note of that name
    assert not {"nothing.x", "", " . "} & set(found) and found["App"][2]["title"] == "T" and found["services.Web"][2]["ports"] == "80"
