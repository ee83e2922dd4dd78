"""One vault through the whole engine."""

import io
import json
import os
import time

import pytest

from quillspark import cli, rpc
from quillspark.engine import Engine
from quillspark.operators import checks, graph, mutate, sqlgate, sync
from quillspark.plans.project import parse_notes
from quillspark.sources import vault
from quillspark.sources.store import locked
from quillspark.sources.vault import VaultError, contained

HEAD = "---\ntitle: {0}\ndate: 2024-01-01\ntype: system\ntags: [alpha, beta]\nsummary: the {0} note\n{1}---\n\n"
NOTES = {
    "INDEX.md": HEAD.format("Index", "") + "[[40-Systems/Ingress]] [[App]] [[40-Systems/Db]] [[40-Systems/_Hidden]] [[20-Projects/Shop]]\n",
    "40-Systems/Ingress.md": HEAD.format("Ingress", 'ports: ["80:8080"]\nrelations:\n  routes_to: "[[App]]"\n') + "# 🚪 Gate\nLets caching traffic in.\n\n## Checks\n```bash:verify\ntest -d 40-Systems\n```\n",
    "40-Systems/App.md": HEAD.format("App", "relations:\n  depends_on: ['[[40-Systems/Db|base]]']\n") + "Uses [[Db]] and [the gate](Ingress.md). Caching here, caching there.\n\n## Invariants\n- stays up\n",
    "40-Systems/Db.md": HEAD.format("Db", "") + "Back to [[Ingress]].\n",
    "40-Systems/_Hidden.md": HEAD.format("Hidden", "") + "```\n[[fenced]]\n```\n",
    "20-Projects/Shop.md": "---\ntitle: Shop\ntype: project\n---\nSells things.\n",
    "60-Scripts/ok.sh": "echo ok\n",
}


@pytest.fixture
def root(tmp_path):
    for name, text in NOTES.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    return tmp_path


def test_sync_counts_and_keeps_rows(spark, root):
    e = Engine(spark, root)
    first = e.sync()
    assert (first.added, first.updated, first.total, first.parse_errors) == (6, 6, 6, [])
    assert e.sync().unchanged == 6
    (root / "40-Systems/Db.md").write_text("---\ntitle: Bad: Db\n---\nx")
    (root / "20-Projects/Shop.md").write_bytes(b"\xff\xfe\xfd")
    (root / "40-Systems/_Hidden.md").unlink()
    dry = e.sync(dry_run=True)
    assert (dry.updated, dry.deleted) == (1, 1)
    r = e.sync()
    assert (r.added, r.updated, r.deleted, r.unchanged, len(r.parse_errors), len(r.read_errors)) == (0, 1, 1, 4, 1, 1)
    assert {n["rel_path"] for n in e.notes()} == set(NOTES) - {"40-Systems/_Hidden.md", "60-Scripts/ok.sh"}
    assert len(e.sync().parse_errors) == 1


def test_runs_add_layers_and_now_and_then_a_base(spark, root, monkeypatch):
    monkeypatch.setattr(sync, "MOST_LAYERS", 3)
    e, numbers = Engine(spark, root), []
    e.sync()
    for i in range(4):
        (root / "40-Systems/Db.md").write_text(HEAD.format("Db", "") + f"state {i} [[App]]\n")
        if i == 1:
            (root / "40-Systems/_Hidden.md").unlink()
        if i == 2:
            (root / "40-Systems/_Hidden.md").write_text(HEAD.format("Hidden", "") + "back\n")
        e.sync()
        numbers.append(len(sync.layers(root)))
        t = sync.current(spark, root)
        fresh = sync.tables(parse_notes(vault.notes(spark, root)[0]))
        for name in sync.KEYS:
            rows = lambda x: sorted(map(str, x[name].collect()))  # noqa: B023, E731
            assert rows(t) == rows(fresh), name
    assert numbers == [2, 3, 1, 2]
    files = lambda: {str(p) for p in sync.home(root).glob("v*-*")}
    before = files()
    e.sync()
    assert files() == before


def test_files_that_cannot_be_read_have_an_error(spark, root):
    (root / "big.md").write_bytes(b"x" * (vault.MOST_BYTES + 1))
    (root / "latin.md").write_bytes(b"\xff")
    got = {r.rel_path: r for r in vault.read_files(spark, root, ["INDEX.md", "40-Systems/_Hidden.md", "big.md", "latin.md", "gone.md"]).collect()}
    assert got["INDEX.md"].content == NOTES["INDEX.md"] and got["40-Systems/_Hidden.md"].error is None
    assert "larger" in got["big.md"].error and got["latin.md"].error == "not UTF-8" and got["gone.md"].error and got["gone.md"].content is None


def test_reads(spark, root):
    e = Engine(spark, root)
    hits, notice = e.search("caching", with_graph=True)
    assert [h["stem"] for h in hits] == ["App", "Ingress"] and notice and "**" in hits[0]["snippet"]
    assert hits[0]["upstream"] and "1. [" in e.compact(hits)
    assert e.search("caching", mode="bm25", domain="20-Projects")[0] == []
    with pytest.raises(VaultError):
        e.search("x", mode="vector")
    assert e.read("ingress", section="gate").startswith("# 🚪 Gate")
    assert e.read("App", toc=True).endswith("## Invariants")
    contract = e.contract("Ingress")
    assert contract["ports"] == ["Ingress: 80:8080"] and contract["dependencies"] == ["App"] and len(contract["verifications"]) == 1
    assert {u["source_rel"] for u in e.blast("[[Db]]")["upstream"]} == {"40-Systems/App.md", "INDEX.md", "40-Systems/App.md"}
    with pytest.raises(VaultError):
        e.blast("nothing")
    tree = e.map("Ingress", 3, "down")
    assert '"cycle": true' in json.dumps(tree) and tree["boundary_sinks"][0]["name"] == "Ingress"
    assert e.get("App.tags.1") == "beta" and e.get("services.Ingress.ports") == "80:8080" and e.get("entities.App.title") == "App"
    assert [p["stem"] for p in e.projects()] == ["Shop"]
    assert len(e.notes("40-systems/")) == 4 and e.notes("") == [n for n in e.notes() if n["domain"] == ""]


def test_hybrid_with_an_embedder(spark, root):
    embed = lambda texts: [[float("caching" in t.lower()), 1.0] for t in texts]
    hits, notice = Engine(spark, root, embed).search("caching")
    assert notice is None and {h["stem"] for h in hits[:2]} == {"App", "Ingress"}


def test_sql_gate(spark, root):
    e = Engine(spark, root)
    assert e.query("-- note\nSELECT count(*) AS n FROM entities;") == [{"n": 6}]
    assert e.query("WITH a AS (SELECT stem FROM entities WHERE stem = 'App') SELECT * FROM a") == [{"stem": "App"}]
    for bad in ("DROP TABLE entities", "WITH d AS (SELECT 1) DELETE FROM entities", "SELECT 1; SELECT 2", "SELECT reflect('java.lang.System', 'exit')", "SELECT * FROM parquet.`/tmp/x`", "VALUES (1)", "SET a=b"):
        with pytest.raises(Exception):
            e.query(bad)


#: Statements that the gate must refuse, and some that it must not.
_GATED = {
    "SELECT `java_method`('java.lang.Math', 'abs', -1)": True, "SELECT (SELECT reflect('java.lang.Math', 'abs', -1))": True, "WITH a AS (SELECT `try_reflect`('java.lang.Math', 'abs', -1) AS x) SELECT * FROM a": True,
    "SELECT * FROM region LATERAL VIEW reflect('a', 'b') e": True, "SELECT * FROM region WHERE r_name IN (SELECT `java_method`('java.lang.Math', 'abs', -1))": True, "SELECT IDENTIFIER('reflect')('java.lang.Math', 'abs', -1)": True,
    "SELECT * FROM parquet.`/etc`": True, "SELECT TRANSFORM(r_name) USING 'cat' FROM region": True, "WITH d AS (SELECT 1) DELETE FROM region": True, "INSERT INTO region VALUES (1)": True, "SELECT 1; SELECT 2": True,
    "EXPLAIN DROP TABLE region": True, "SELECT input_file_name() FROM region": True, "SELECT current_user": True, "SELECT * FROM unknown_table": True, "VALUES (1)": True, "SELECT * FROM region |> SET r_name = reflect('java.lang.Math', 'abs', -1)": True,
    "-- a note\nSELECT count(*) FROM region;": False, "/* a */ WITH r AS (SELECT 1 AS x) SELECT x FROM r": False, "EXPLAIN SELECT * FROM region": False, "SELECT `upper`(r_name) FROM region": False,
    "SELECT r_name, 'DROP TABLE x; reflect(1)' AS s FROM region WHERE EXISTS (SELECT 1 FROM region)": False,
}


@pytest.mark.parametrize("statement", _GATED)
def test_what_the_gate_refuses(spark, statement):
    spark.createDataFrame([("a",)], "r_name string").createOrReplaceTempView("region")
    try:
        sqlgate.check(spark, statement, ["region"])
        assert not _GATED[statement]
    except sqlgate.SqlRefused:
        assert _GATED[statement]
    finally:
        spark.catalog.dropTempView("region")


def test_sql_rows_functions_and_matches(spark, root):
    e = Engine(spark, root)
    assert e.query("SELECT 1 AS a, 2 AS a, CAST('xy' AS binary) AS b") == [{"a": 2, "b": "<blob len=2>"}]
    many = e.query_result("SELECT id FROM range(600)")
    assert len(many["rows"]) == 500 and many["truncated"]
    got = e.query("SELECT n.stem, m.score, m.snippet, 'note_match(''x'')' AS s FROM note_match('caching') m JOIN notes n USING (rel_path) ORDER BY m.score DESC")
    assert [r["stem"] for r in got] == ["App", "Ingress"] and "**" in got[0]["snippet"] and got[0]["s"] == "note_match('x')"
    assert e.query("SELECT s.title FROM notes, LATERAL sections(body) AS s WHERE stem = 'App'") == [{"title": "Invariants"}]
    with pytest.raises(sqlgate.SqlRefused):
        e.query("SELECT repeat('x', 5000000) AS s")


def test_a_deadline_ends_a_long_query(spark):
    rows = spark.range(200_000)
    began = time.monotonic()
    with pytest.raises(sqlgate.SqlRefused, match="took more"):
        sqlgate.run(spark, {"r": rows}, "SELECT sum(a.id * b.id % 7) AS s FROM r a CROSS JOIN r b", deadline=2)
    assert time.monotonic() - began < 4


def test_only_changed_notes_are_embedded_and_orphans_go(spark, root):
    seen = root / ".seen"

    def embed(texts):
        with open(seen, "a") as f:
            f.writelines(t.split("]")[0] + "\n" for t in texts)
        return [[float("caching" in t.lower()), 1.0] for t in texts]

    e = Engine(spark, root, embed)
    embedded = lambda: sync.sync_vectors(spark, root, embed)
    e.sync()
    assert embedded() == 6 and embedded() == 0
    whole = sync.stored_vectors(spark, root)
    assert whole.select("rel_path").distinct().count() == 6 and {r.dim for r in whole.collect()} == {2} and all(len(r.vector_blob) == 8 for r in whole.collect())
    (root / "40-Systems/Db.md").write_text(NOTES["40-Systems/Db.md"] + "more caching\n")
    (root / "40-Systems/_Hidden.md").unlink()
    seen.write_text("")
    e.sync()
    assert embedded() == 1 and "Db" in seen.read_text() and "App" not in seen.read_text()
    now = sync.stored_vectors(spark, root)
    meta = sync.current(spark, root)["file_meta"]
    assert {r.rel_path for r in now.collect()} == {r.rel_path for r in meta.collect()}
    assert now.join(meta, ["rel_path", "content_hash"], "left_anti").count() == 0
    assert e.query("SELECT count(DISTINCT rel_path) AS n FROM note_vectors") == [{"n": 5}]
    seen.write_text("")
    assert e.search("caching", mode="vector")[0] and "Document" not in seen.read_text()


def test_readers_and_writers_mean_the_same_note(spark, root):
    (root / "40-Systems/Two-Words.md").write_text(HEAD.format("A Title", ""))
    notes = Engine(spark, root).tables()["entities"]
    for name in ("app", "40-Systems/App", "40-Systems/App.md", "/40-Systems/App", "two words", "a title", "40-Systems/Two Words", "nothing", "Systems/App"):
        read = [r.rel_path for r in graph.resolve(notes, name).collect()]
        assert sorted(read) == sorted(mutate.candidates(root, name)), name


def test_links_may_mean_notes_that_the_index_skips(spark, root):
    (root / "node_modules").mkdir()
    (root / "node_modules/Lib.md").write_text(HEAD.format("Lib", ""))
    (root / "40-Systems/Db.md").write_text(NOTES["40-Systems/Db.md"] + "[[node_modules/Lib]] [[nowhere]]\n")
    e = Engine(spark, root)
    assert e.verify()["broken_wikilinks"] == [["40-Systems/Db.md", "nowhere"]]
    assert "node_modules/Lib.md" not in {n["rel_path"] for n in e.notes()}


def test_tree_nodes_have_paths(spark, root):
    tree = Engine(spark, root).map("App", 1, "down")
    assert {n["rel_path"] for n in tree["down"]} == {"40-Systems/Db.md"}


def test_audits(spark, root):
    e = Engine(spark, root)
    lint = e.lint()
    assert lint["errors"] == ["'20-Projects/Shop.md' (project) lacks date, tags, summary, status"] and lint["total_notes"] == 6
    assert e.verify()["passed"], e.verify()
    (root / "40-Systems/Lone.md").write_text(HEAD.format("Lone", "") + "[[nowhere]] [x](gone.md) [[App]] [a](https://b.c)")
    (root / "40-Systems/Systems-MOC.md").write_text(HEAD.format("Systems", "") + "[[App]]\n")
    (root / "60-Scripts/bad.sh").write_text("if\n")
    found = e.verify()
    assert found["broken_wikilinks"] == [["40-Systems/Lone.md", "nowhere"]] and found["broken_markdown_links"] == [["40-Systems/Lone.md", "gone.md"]]
    assert "40-Systems/Lone.md" in found["orphan_notes"]
    assert any("Bash syntax" in x for x in e.lint()["errors"])
    (root / "20-Projects/Bad.md").write_text("---\ntitle: Bad: Note\n---\n")
    plan = e.reconcile(dry_run=True)
    assert "title: Bad: Note" in (root / "20-Projects/Bad.md").read_text() and len(plan["actions"]) >= 2
    e.reconcile()
    assert '"Bad: Note"' in (root / "20-Projects/Bad.md").read_text() and "- [[40-Systems/Lone]]" in (root / "40-Systems/Systems-MOC.md").read_text()


def test_edits(spark, root):
    e = Engine(spark, root)
    e.set("App", "status", "live", typed=False)
    e.set("App", "limits.cpu", "2", typed=False)
    assert e.get("App.status") == "live" and e.get("App.limits.cpu") == 2
    e.append("App", "Notes", "hello")
    e.replace("App", "Notes", "bye")
    assert "bye" in e.read("App", section="Notes") and "hello" not in e.read("App")
    assert e.write("30-Agents/New", "# Fresh\n") == "30-Agents/New.md" and e.get("New.title") == "Fresh"
    with pytest.raises(VaultError):
        e.write("30-Agents/New", "again")
    for bad in ("../x", "/etc/x", ".quillspark/x", "a\nb"):
        with pytest.raises(VaultError):
            e.write(bad, "x")
    before = "---\ntitle: Bad: Note\n---\nx"
    (root / "20-Projects/Bad.md").write_text(before)
    with pytest.raises(ValueError):
        e.set("Bad", "a", 1)
    assert (root / "20-Projects/Bad.md").read_text() == before
    assert "[shop] did it" in e.log("shop", "did it", "me")
    text, found = e.daily()
    assert found and text.rstrip().endswith("[me]: [shop] did it") and "write 30-Agents/New.md -> exit 0" in text
    with pytest.raises(VaultError):
        e.daily("../../x")
    (root / "20-Projects/App.md").write_text("# App\n")
    with pytest.raises(VaultError, match="may mean"):
        mutate.set_value(root, "App", "a", 1)


def test_file_modes_line_ends_and_lock(root):
    path = root / "40-Systems/Db.md"
    path.write_bytes(path.read_bytes().replace(b"\n", b"\r\n"))
    os.chmod(path, 0o600)
    mutate.append_section(root, "Db", "Log", "x")
    assert path.stat().st_mode & 0o777 == 0o600 and b"\r\n" in path.read_bytes() and b"\n" not in path.read_bytes().replace(b"\r\n", b"")
    with locked(root), pytest.raises(VaultError, match="another writer"), locked(root, 0.1):
        pass
    os.symlink("/etc", root / "40-Systems/out")
    with pytest.raises(VaultError):
        contained(root, "40-Systems/out/passwd")


def test_checks(spark, root, monkeypatch):
    e = Engine(spark, root)
    assert e.test() | {"results": 0} == {"total": 1, "passed": 1, "failed": 0, "results": 0}
    assert e.test("ingress", dry_run=True)["results"][0]["executed"] is False
    with pytest.raises(VaultError):
        e.test("nothing")
    monkeypatch.setenv("QUILLSPARK_CHECK_TIMEOUT", "1")
    assert checks.run_one("sleep 30 & sleep 30", root)[0] == 124
    assert len(checks.run_one("head -c 3000000 /dev/zero | tr '\\0' a", root)[1]) < 2_100_000
    assert checks.run_one("rm x", root)[0] == 126


def test_server(spark, root):
    e = Engine(spark, root)
    ask = lambda method, ident=1, **params: rpc.handle(e, json.dumps({"jsonrpc": "2.0", "id": ident, "method": method, "params": params}).encode())
    tool = lambda name, **a: ask("tools/call", name=name, arguments=a)["result"]
    assert len(ask("tools/list")["result"]["tools"]) == 20 and ask("ping")["result"] == {}
    assert "App" in tool("search", query="caching", limit="3")["content"][0]["text"]
    assert json.loads(tool("get", keypath="App.tags.0")["content"][0]["text"])["value"] == "alpha"
    assert tool("read", path="nothing")["isError"] and tool("lint")["isError"]
    assert ask("tools/call", name="get", arguments={})["error"]["code"] == -32602 and ask("nope")["error"]["code"] == -32601
    assert rpc.handle(e, b"{") ["error"]["code"] == -32700 and rpc.handle(e, b'{"jsonrpc": "2.0", "method": "ping"}') is None
    assert "Index" in ask("resources/read", uri="quillspark://note/INDEX")["result"]["contents"][0]["text"]
    one = b'{"jsonrpc": "2.0", "id": 7, "method": "ping"}'
    out = io.BytesIO()
    rpc.serve(e, io.BytesIO(one + b"\nContent-Length: %d\r\n\r\n" % len(one) + one), out)
    assert [json.loads(x)["id"] for x in out.getvalue().splitlines()] == [7, 7]


def test_command_line(spark, root, capsys):
    run = lambda *a: cli.run(Engine(spark, root), cli.parser().parse_args(a))
    assert run("map", "Ingress", "--direction", "down") == 0 and "└──" in capsys.readouterr().out
    assert run("lint") == 1 and run("verify") == 0 and run("test") == 0
    assert run("search", "caching", "--compact") == 0 and run("query", "SELECT 1 AS a") == 0 and run("ls") == 0
    with pytest.raises(SystemExit) as e:
        run("map", "Ingress", "--direction", "sideways")
    assert e.value.code == 2
