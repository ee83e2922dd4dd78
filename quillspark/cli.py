"""Command line over one vault. Exit codes: 0 done, 1 failed or an audit that doesn't pass, 2 wrong arguments."""

from __future__ import annotations

import argparse
import json
import sys

from quillspark.engine import Engine, tree_lines
from quillspark.functions import yamltext


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillspark")
    p.add_argument("--vault")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *args: str, aliases: tuple[str, ...] = (), **options):
        """args: names, optional ones with ? at the end. options: flags, by their default."""
        c = sub.add_parser(name, aliases=list(aliases))
        c.set_defaults(command=name)
        for a in args:
            c.add_argument(a.rstrip("?"), **({"nargs": "?"} if a.endswith("?") else {}))
        for k, v in options.items():
            flag = "--" + k.replace("_", "-")
            if v is False:
                c.add_argument(flag, action="store_true")
            elif isinstance(v, list):
                c.add_argument(flag, choices=v, default=v[0])
            else:
                c.add_argument(flag, type=int if isinstance(v, int) or k == "budget" else str, default=v)

    add("search", "query", domain=None, limit=10, with_graph=False, mode=["hybrid", "bm25", "vector"], compact=False)
    add("read", "note", aliases=("cat",), section=None, toc=False, budget=None)
    add("contract", "note", json=False)
    add("blast", "target")
    add("map", "target", depth=2, direction=["both", "up", "down"], json=False)
    add("services")
    add("projects")
    add("get", "keypath")
    add("query", "sql")
    add("log", "project", "summary", device=None)
    add("write", "path", "content?", overwrite=False, raw=False)
    add("replace", "note", "heading", "content")
    add("set", "note", "key", "value")
    add("append", "note", "heading", "content")
    add("daily", "date?")
    add("list", "domain?", aliases=("ls",))
    add("lint")
    add("verify")
    add("test", "note?", dry_run=False)
    add("reconcile", dry_run=False)
    add("setup-models")
    add("serve")
    return p


def show(value) -> None:
    print(value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, indent=2, default=str))


def run(e: Engine, a: argparse.Namespace) -> int:
    match a.command:
        case "search":
            hits, notice = e.search(a.query, a.domain, a.limit, a.with_graph, a.mode)
            show(e.compact(hits) if a.compact else hits)
            if notice:
                print(notice, file=sys.stderr)
        case "read":
            show(e.read(a.note, a.section, a.toc, a.budget))
        case "contract":
            found = e.contract(a.note)
            show(found if a.json else yamltext.dump(json.loads(json.dumps(found, default=str))))
        case "map":
            found = e.map(a.target, a.depth, a.direction)
            show(found if a.json else "\n".join(x for way in ("up", "down") if way in found for x in [f"{found['target']} ({way})", *tree_lines(found[way])]))
        case "query":
            got = e.query_result(a.sql)
            show(got["rows"])
            if got["truncated"]:
                print(f"only the first {len(got['rows'])} rows", file=sys.stderr)
        case "blast" | "get":
            show(getattr(e, a.command)(vars(a)[{"blast": "target", "get": "keypath"}[a.command]]))
        case "services" | "projects":
            show(getattr(e, a.command)())
        case "log":
            show(e.log(a.project, a.summary, a.device))
        case "write":
            show(e.write(a.path, sys.stdin.read() if a.content is None else a.content, a.overwrite, a.raw))
        case "set":
            e.set(a.note, a.key, a.value, typed=False)
            show(f"set {a.key} in {a.note}")
        case "append" | "replace":
            getattr(e, a.command)(a.note, a.heading, a.content)
            show(f"{a.command} {a.note} #{a.heading}")
        case "daily":
            show(e.daily(a.date)[0])
        case "list":
            show(e.notes(a.domain))
        case "lint" | "verify":
            found = getattr(e, a.command)()
            show(found)
            return int(not found["passed"])
        case "test":
            found = e.test(a.note, a.dry_run)
            show(found)
            return int(found["failed"] > 0)
        case "reconcile":
            show(e.reconcile(a.dry_run))
        case "setup-models":
            show("No models are shipped: pass an embedder to Engine")
        case "serve":
            from quillspark.rpc import serve

            serve(e, sys.stdin.buffer, sys.stdout.buffer)
    return 0


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("quillspark").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    try:
        return run(Engine(spark, a.vault), a)
    except (ValueError, OSError) as err:
        print(f"error: {err}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
