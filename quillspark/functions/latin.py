"""Case and accents as the projection compares them."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _plain_latin() -> tuple[str, str]:
    """Letters U+00C0 to U+024F that decompose into an ASCII letter and marks, and that letter."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in range(0xC0, 0x250)]
    pairs = [(a, b[0]) for a, b in pairs if len(b) > 1 and b[0].isascii() and all(unicodedata.combining(x) for x in b[1:])]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _plain_latin()
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def nocase(c: Column | str) -> Column:
    """The key by which names compare: only A-Z is folded."""
    return F.translate(F.col(c) if isinstance(c, str) else c, _UPPER, _LOWER)


def unaccented(c: Column) -> Column:
    """Without accents. A text of ASCII alone, which one count of its bytes shows, isn't looked up letter by letter."""
    return F.when(F.octet_length(c) == F.char_length(c), c).otherwise(F.translate(c, ACCENTED, PLAIN))


def tokens(c: Column | str) -> Column:
    """Runs of letters and digits, lowered, without accents."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_extract_all(F.lower(unaccented(F.coalesce(c, F.lit("")))), F.lit(r"[\p{L}\p{N}]+"), 0)


def like_escaped(text: str) -> str:
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def domain_is(domain: str | None, path: str = "rel_path", column: str = "domain", blank_is_none: bool = True) -> Column:
    """Equal to the domain, or below it as a path (in any ASCII case). Slashes at the end don't count; blank may mean all."""
    domain = (domain or "").strip().rstrip("/") if blank_is_none else (domain or "").rstrip("/")
    if blank_is_none and not domain:
        return F.lit(True)
    return (F.col(column) == domain) | nocase(path).like(like_escaped(domain.translate(str.maketrans(_UPPER, _LOWER))) + "/%")
