"""Incremental projection: notes whose hash changed are parsed anew, all others keep their rows.

A projection is a list of layers, each a folder of Parquet tables: a base, and on it what later runs found, with the paths
whose rows in the layers below are gone. A run writes the rows of changed notes only. A small pointer file lists the
layers, so a reader sees a whole version or the one before it; a run that would make too many layers or gone paths writes
a new base instead."""

from __future__ import annotations

import json
import shutil
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import diff, rank, vector
from quillspark.plans.project import SCHEMA, parse_notes, views
from quillspark.sources import vault
from quillspark.sources.store import locked, write_whole

#: Part of a version's name: a projection of another layout is built anew, never migrated.
LAYOUT = "4"
#: Layers, and gone paths in all of them (each reader broadcasts these), up to which a run adds a layer.
MOST_LAYERS, MOST_GONE = 8, 100_000
#: Key by which each table's rows belong to a note.
KEYS = {"file_meta": "rel_path", "notes": "rel_path", "entities": "rel_path", "services": "rel_path", "relations": "source_rel", "invariants": "source_rel", "verifications": "source_rel", "chunks": "rel_path", "parse_errors": "rel_path", "postings": "rel_path", "lengths": "rel_path"}
#: Tables that SQL sees.
SHOWN = [t for t in KEYS if t not in ("postings", "lengths")]


@dataclass
class Report:
    added: int = 0
    updated: int = 0
    deleted: int = 0
    unchanged: int = 0
    total: int = 0
    parse_errors: list[str] = field(default_factory=list)
    read_errors: list[str] = field(default_factory=list)
    dry_run: bool = False
    duration_ms: int = 0


def home(root: Path) -> Path:
    return root / vault.STATE


def _pointer(root: Path) -> Path:
    return home(root) / "current"


def layers(root: Path) -> list[dict]:
    """[{name, gone}], the base first: the folders of the current version and how many paths each takes from those below."""
    at = _pointer(root)
    try:
        found = json.loads(at.read_text()) if at.is_file() else []
    except ValueError:  # of another layout
        return []
    fits = all(x["name"].startswith(f"v{LAYOUT}-") and (home(root) / x["name"]).is_dir() for x in found)
    return found if fits else []


def current(spark: SparkSession, root: Path) -> dict[str, DataFrame] | None:
    """The tables of the current version, if there is one of this layout."""
    found = layers(root)
    if not found:
        return None
    read = lambda layer, t: spark.read.parquet(f"file://{home(root)}/{layer['name']}/{t}")
    out = {}
    for t, key in KEYS.items():
        rows = read(found[0], t)
        for layer in found[1:]:
            if layer["gone"]:
                gone = read(layer, "gone")
                rows = rows.join(F.broadcast(gone), F.col(key) == F.col("gone_path"), "left_anti")
            rows = rows.unionByName(read(layer, t))
        out[t] = rows
    return out


def tables(parsed: DataFrame) -> dict[str, DataFrame]:
    out = views(parsed)
    placed = rank.postings(out["notes"])
    index = {"postings": placed, "lengths": rank.lengths(out["notes"], placed)}
    return out | index | {"parse_errors": parsed.where("parse_error is not null").select("rel_path", "parse_error")}


def changes(spark: SparkSession, old: dict[str, DataFrame] | None, raw: DataFrame, protected: list[str]) -> DataFrame:
    """(rel_path, status). A note that can't be read, or lies behind a link or a closed folder, is never deleted."""
    before = old["file_meta"] if old else spark.createDataFrame([], "rel_path string, content_hash string, size bigint")
    unread = raw.where("content is null").select("rel_path")
    found = diff.diff(before, raw.where("content is not null"))
    if protected:
        roots = spark.createDataFrame([(p,) for p in protected], "p string")
        safe = before.join(F.broadcast(roots), (F.col("rel_path") == F.col("p")) | F.col("rel_path").startswith(F.concat("p", F.lit("/"))), "left_semi")
        unread = unread.unionByName(safe.select("rel_path"))
    kept = found.join(unread.distinct().withColumn("_kept", F.lit(True)), "rel_path", "left")
    status = F.when((F.col("status") == "deleted") & F.col("_kept").isNotNull(), "unchanged").otherwise(F.col("status"))
    return kept.select("rel_path", status.alias("status"))


def sync(spark: SparkSession, root: Path, dry_run: bool = False) -> Report:
    """Bring the projection up to date. A dry run only counts."""
    began = time.monotonic()
    raw, protected = vault.notes(spark, root)
    raw = raw.cache()
    seen, old = layers(root), current(spark, root)
    todo = changes(spark, old, raw, protected).cache()
    try:
        got = diff.counters(todo).first().asDict()
        out = Report(**got, dry_run=dry_run, read_errors=[f"{r.rel_path}: {r.error}" for r in raw.where("error is not null").orderBy("rel_path").collect()])
        if not dry_run and (old is None or got["updated"] or got["deleted"]):
            with locked(root):
                if layers(root) != seen:  # another run published since
                    todo.unpersist()
                    old = current(spark, root)
                    todo = changes(spark, old, raw, protected).cache()
                _publish(spark, root, old, raw, todo)
        now = current(spark, root)
        if now is not None:
            out.parse_errors = [f"{r.rel_path}: {r.parse_error}" for r in now["parse_errors"].orderBy("rel_path").collect()]
        out.duration_ms = int((time.monotonic() - began) * 1000)
        return out
    finally:
        todo.unpersist()
        raw.unpersist()


def _publish(spark: SparkSession, root: Path, old: dict[str, DataFrame] | None, raw: DataFrame, todo: DataFrame) -> None:
    """Write the changed notes as a layer, or, where there is no base or too much on it, all notes as a base."""
    fresh = parse_notes(raw.join(todo.where("status in ('added', 'updated')").select("rel_path"), "rel_path", "left_semi")).cache()
    gone = todo.where("status in ('updated', 'deleted')").select(F.col("rel_path").alias("gone_path"))
    below, n = layers(root), gone.count()
    if len(below) >= MOST_LAYERS or n + sum(x["gone"] for x in below) > MOST_GONE:
        below, n = [], 0
    name = f"v{LAYOUT}-{uuid.uuid4().hex}"
    folder = home(root) / name
    try:
        for t, rows in tables(fresh).items():
            if old is not None and not below:
                stays = todo.where("status = 'unchanged'").select(F.col("rel_path").alias("_kept"))
                rows = old[t].join(stays, F.col(KEYS[t]) == F.col("_kept"), "left_semi").unionByName(rows)
            (rank.by_term(rows) if t == "postings" else rows).write.parquet(f"file://{folder}/{t}")
        if n:
            gone.write.parquet(f"file://{folder}/gone")
        now = [*below, {"name": name, "gone": n}]
        last = {x["name"] for x in layers(root)}
        write_whole(_pointer(root), json.dumps(now))
        keep = last | {x["name"] for x in now}  # the version before stays for readers that are under way
        for other in home(root).glob("v*-*"):
            if other.name not in keep:
                shutil.rmtree(other, ignore_errors=True)
    except BaseException:
        shutil.rmtree(folder, ignore_errors=True)
        raise
    finally:
        fresh.unpersist()


# --- stored vectors


def stored_vectors(spark: SparkSession, root: Path) -> DataFrame | None:
    """The note vectors as they were last written."""
    at = home(root) / "vectors"
    name = at.read_text().strip() if at.is_file() else ""
    folder = home(root) / name
    return spark.read.parquet(f"file://{folder}") if name.startswith(f"n{LAYOUT}-") and folder.is_dir() else None


def sync_vectors(spark: SparkSession, root: Path, embedder: Callable[[list[str]], list[list[float]]]) -> int:
    """Embed the notes whose text changed and drop the vectors of texts that are gone; the number of notes embedded.

    Embedding runs outside the lock; what is written is held against the hashes that are current then."""
    now, old = current(spark, root), stored_vectors(spark, root)
    if now is None:
        return 0
    missing = vector.to_embed(now["file_meta"], old) if old is not None else now["file_meta"].select("rel_path", "content_hash")
    n = missing.count()
    if old is not None and not n and not old.join(now["file_meta"], ["rel_path", "content_hash"], "left_anti").limit(1).count():
        return 0
    draft, name = (f"n{LAYOUT}-{uuid.uuid4().hex}" for _ in range(2))
    made = vector.embed(now["chunks"].join(missing, "rel_path"), embedder)
    made = made.drop("embed_text").withColumn("vector_blob", vector.to_blob("vector")).drop("vector")
    try:
        made.write.parquet(f"file://{home(root)}/{draft}")
        with locked(root):
            fresh = spark.read.schema(made.schema).parquet(f"file://{home(root)}/{draft}")
            kept = fresh if old is None else old.unionByName(fresh)
            vector.still_current(kept, current(spark, root)["file_meta"]).write.parquet(f"file://{home(root)}/{name}")
            at = home(root) / "vectors"
            last = at.read_text().strip() if at.is_file() else ""
            write_whole(at, name)
            for other in home(root).glob("n*-*"):
                if other.name not in (name, last):
                    shutil.rmtree(other, ignore_errors=True)
    except BaseException:
        for x in (draft, name):
            shutil.rmtree(home(root) / x, ignore_errors=True)
        raise
    return n


def empty(spark: SparkSession) -> dict[str, DataFrame]:
    return tables(spark.createDataFrame([], SCHEMA))
