"""Writing to a vault: one writer at a time, whole files or nothing. Driver-side by nature: single small files."""

from __future__ import annotations

import fcntl
import os
import tempfile
import time
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from quillspark.sources.vault import MOST_BYTES, STATE, VaultError

LOCK_WAIT_S = 10


@contextmanager
def locked(root: Path, wait: float = LOCK_WAIT_S) -> Iterator[None]:
    """The vault's writer lock; a link in its place is refused, and a wait beyond the limit is an error."""
    at = root / f"{STATE}.lock"
    try:
        fd = os.open(at, os.O_RDWR | os.O_CREAT | os.O_NOFOLLOW, 0o600)
    except OSError as e:
        raise VaultError(f"can't open the lock '{at.name}': {e.strerror}") from e
    try:
        end = time.monotonic() + wait
        while True:
            try:
                fcntl.flock(fd, fcntl.LOCK_EX | fcntl.LOCK_NB)
                break
            except BlockingIOError:
                if time.monotonic() > end:
                    raise VaultError(f"another writer has held the vault for {wait:g} s") from None
                time.sleep(0.05)
        yield
    finally:
        os.close(fd)


def write_whole(path: Path, text: str) -> None:
    """Replace a file at once; its mode stays, and a reader sees the old or the new text."""
    path.parent.mkdir(parents=True, exist_ok=True)
    fd, temporary = tempfile.mkstemp(prefix=".", suffix=".tmp", dir=path.parent)
    try:
        with os.fdopen(fd, "wb") as f:
            f.write(text.encode())
            f.flush()
            os.fsync(f.fileno())
        os.chmod(temporary, path.stat().st_mode & 0o7777 if path.exists() else 0o644)
        os.replace(temporary, path)
    except BaseException:
        Path(temporary).unlink(missing_ok=True)
        raise


def read_text(path: Path) -> str:
    if path.stat().st_size > MOST_BYTES:
        raise VaultError(f"'{path.name}' is larger than {MOST_BYTES} bytes")
    try:
        return path.read_bytes().decode()
    except UnicodeDecodeError as e:
        raise VaultError(f"'{path.name}' is not UTF-8") from e
