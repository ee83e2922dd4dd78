"""Vaults: folders of Markdown notes. Discovery and containment on the driver, contents in tasks."""

from __future__ import annotations

import os
import socket
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_BYTES = 8 << 20
SKIPPED = {"node_modules", "__pycache__", "_templates"}
STATE = ".quillspark"
#: Folders and files by which a vault is known; fixed values.
MARKERS = ["INDEX.md", "01-Daily", "20-Projects", "40-Systems"]
_SCHEMA = "rel_path string, content_hash string, size bigint, content string, error string"


class VaultError(ValueError):
    """A path outside the vault, a missing vault, or an unreadable note."""


def machine_id() -> str:
    return os.environ.get("QUILLSPARK_HOST") or os.environ.get("HOSTNAME") or socket.gethostname().split(".")[0] or "local"


def expanded(path: str) -> Path:
    return Path(os.path.expanduser(os.path.expandvars(path)))


def discover(explicit: str | None = None) -> Path:
    """The vault's root: as given, from QUILLSPARK_VAULT, from ~/.config/quillspark/vault, else the nearest folder above that looks like one."""
    for given in (explicit, os.environ.get("QUILLSPARK_VAULT")):
        if given:
            root = expanded(given)
            if not root.is_dir():
                raise VaultError(f"no vault at '{root}'")
            return root.resolve()
    config = Path.home() / ".config/quillspark/vault"
    if config.is_file() and (root := expanded(config.read_text().strip())).is_dir():
        return root.resolve()
    here = Path.cwd().resolve()
    for folder in (here, *here.parents):
        if folder != Path.home() and sum((folder / m).exists() for m in MARKERS) >= 2:
            return folder
    raise VaultError("no vault found: give one, set QUILLSPARK_VAULT, or start inside one")


def contained(root: Path, rel_path: str) -> Path:
    """The path inside the vault; escapes, hidden parts and links that lead outside are errors."""
    clean = rel_path.strip().replace("\\", "/").lstrip("/")
    if not clean or "\0" in clean:
        raise VaultError("empty or invalid path")
    parts = [p for p in clean.split("/") if p not in ("", ".")]
    depth = 0
    for p in parts:
        depth += -1 if p == ".." else 1
        if depth < 0:
            raise VaultError(f"'{rel_path}' leaves the vault")
    path = Path(os.path.normpath(root.resolve() / "/".join(parts)))
    real = path.resolve()
    if not path.is_relative_to(root.resolve()) or not real.is_relative_to(root.resolve()):
        raise VaultError(f"'{rel_path}' leaves the vault")
    if any(p.startswith(".") for p in path.relative_to(root.resolve()).parts):
        raise VaultError(f"'{rel_path}' is hidden")
    return path


def walk(root: Path, suffix: str = ".md", below: tuple[str, ...] = ("",), skipped: set[str] = SKIPPED) -> tuple[list[str], list[str]]:
    """(files, protected): relative paths in order. Linked notes and folders that can't be read are protected from deletion."""
    files, protected = [], []

    def failed(e: OSError) -> None:
        protected.append(os.path.relpath(e.filename, root).replace(os.sep, "/"))

    for part in below:
        for folder, names, found in os.walk(root / part, onerror=failed):
            names[:] = sorted(n for n in names if not n.startswith(".") and n not in skipped)
            for name in found:
                if not name.startswith(".") and name.endswith(suffix):
                    rel = os.path.relpath(os.path.join(folder, name), root).replace(os.sep, "/")
                    (protected if os.path.islink(os.path.join(folder, name)) else files).append(rel)
    return sorted(files), sorted(protected)


def _opened(base: str, most: int = 32 << 20):
    """Arrow function from names to what the files hold, at most about so many bytes at a time. Of a file beyond the limit only
    the length is read; one that went since it was listed has an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("rel_path", pa.string()), ("length", pa.int64()), ("bytes", pa.binary()), ("failed", pa.string())])
        for batch in batches:
            rows, held = [], 0
            for rel in batch.column("rel_path").to_pylist():
                try:
                    n = os.path.getsize(f"{base}/{rel}")
                    got = Path(f"{base}/{rel}").read_bytes() if n <= MOST_BYTES else b""
                    rows.append((rel, max(n, len(got)), got, None))
                    held += len(got)
                except OSError as e:
                    rows.append((rel, None, None, e.strerror or "unreadable"))
                if held >= most:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def read_files(spark: SparkSession, root: Path, files: list[str], a_task: int = 5000) -> DataFrame:
    """(rel_path, content_hash, size, content, error) of files by name: one scan whatever their number, dealt to tasks that open
    them. (Spark's own file listing drops names that begin with _.)

    Notes that are unreadable, too large or not UTF-8 have an error and no content."""
    if not files:
        return spark.createDataFrame([], _SCHEMA)
    names = spark.createDataFrame(pa.table({"rel_path": pa.array(files, pa.string())}))
    dealt = names.repartition(max(spark.sparkContext.defaultParallelism, -(-len(files) // a_task)))
    out = dealt.mapInArrow(_opened(str(root.resolve())), "rel_path string, length bigint, bytes binary, failed string")
    fits = F.col("length") <= MOST_BYTES
    valid = F.expr("is_valid_utf8(bytes)")
    problem = F.when(F.col("failed").isNotNull(), F.col("failed")).when(~fits, F.lit(f"larger than {MOST_BYTES} bytes")).when(~valid, F.lit("not UTF-8"))
    return out.select(
        "rel_path",
        F.sha2("bytes", 256).alias("content_hash"),
        F.col("length").alias("size"),
        F.when(fits & valid, F.col("bytes").cast("string")).alias("content"),
        problem.alias("error"),
    )


def notes(spark: SparkSession, root: Path) -> tuple[DataFrame, list[str]]:
    files, protected = walk(root)
    return read_files(spark, root, files), protected


def linkable(spark: SparkSession, root: Path) -> DataFrame:
    """The notes that links may mean: all but templates and what begins with a dot."""
    return read_files(spark, root, walk(root, skipped={"_templates"})[0])


def assets(spark: SparkSession, root: Path) -> DataFrame:
    """All files below the config and script folders."""
    files = [f for part in ("50-Configs", "60-Scripts") if (root / part).is_dir() for f in walk(root, "", (part,))[0]]
    return read_files(spark, root, files)
