"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, URL schemes, plus-digit, digit pairs and identifier cues
("iban", "ssn", ...). Small deterministic parsers then expand each anchor to both sides and validate what they find.

Kinds of the base set: email, ip, card, phone. Each kind is what a left-to-right scan for its grammar finds, matches
never overlapping within a kind; a match that fails its check (octets, Luhn, digit count) is dropped and not retried.
Kinds that the anchors add: url_user (user or user:password in front of a URL's host), iban (checked mod 97), ssn and
account (digits behind a cue), secret (the value that a cue such as "token" or "api_key" is set to, or a key of a known form). Base spans are never removed or changed by the added ones.

Nulls and edges: a null text is empty and has no spans; very long texts are handled whole; repeated rows give repeated
results; doc_id is carried as it is, null included; an empty table gives an empty result; extra columns are ignored.
Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from quillspark.llm.common import slices, tidied

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url_user", "iban", "ssn", "account", "secret")
_ORDER = {k: i for i, k in enumerate(KINDS)}

#: Words that announce an identifier, each with the kind that is read behind it.
CUES = {"iban": "iban", "ssn": "ssn", "social security": "ssn", "account": "account", "acct": "account", "konto": "account", "cuenta": "account", "compte": "account"}
CUES |= dict.fromkeys(["token", "secret", "password", "passwd", "api key", "api_key", "api-key", "apikey", "access_key", "access key", "private_key"], "secret")
#: Beginnings of keys of known forms, each with the form of the whole.
KEYS = {"akia": re.compile(r"AKIA[0-9A-Z]{16}(?![0-9A-Za-z])").match, "ghp_": re.compile(r"ghp_[0-9A-Za-z]{36}(?![0-9A-Za-z])").match}
#: Digits that an account number behind a cue has.
ACCOUNT_DIGITS = (6, 17)

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
_number = re.compile(r"[0-9]+").match
_chain = re.compile(r"[0-9](?:[\x20-]?[0-9])+").match
_dial = re.compile(r"[0-9][\x20().0-9-]+").match
_userinfo = re.compile(r"[^\s/@?#]+@").match
_behind = re.compile(r"(?:\s+(?:number|no\.?|nr\.?|n°|num\.?))?\s*[:#=]?\s*", re.I).match
_iban = re.compile(r"[A-Za-z]{2}[0-9]{2}(?:\x20?[A-Za-z0-9]){11,30}").match
_ssn = re.compile(r"[0-9]{3}([- ])[0-9]{2}\1[0-9]{4}(?![0-9])").match
_account = re.compile(r"[0-9](?:[\x20-]?[0-9])+").match
_set_to = re.compile(r"\s*[:=]\s*[\"']?([0-9A-Za-z+/_.~=-]{16,})").match
_digits = str.maketrans("", "", " -().+")


def _anchors() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    a.add_word("@", ("@", 1))
    a.add_word("://", ("url", 3))
    for d in "0123456789":
        a.add_word("+" + d, ("dial", 2))
        for e in "0123456789":
            a.add_word(f"{d}.{e}", ("dot", 3))
            for sep in ("", " ", "-"):
                a.add_word(f"{d}{sep}{e}", ("pair", 2 + len(sep)))
    for cue, kind in CUES.items():
        a.add_word(cue, ("cue", len(cue), kind))
    for head in KEYS:
        a.add_word(head, ("key", len(head), head))
    a.make_automaton()
    return a


_AUTOMATON = None


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _octet(text: str, a: int, b: int) -> bool:
    part = text[a:b].lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def iban_ok(text: str) -> bool:
    x = text.replace(" ", "").upper()
    if not 15 <= len(x) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


def spans(text: str) -> list[tuple[str, int, int]]:
    """All (kind, start, end) of a text by start, then kind as listed."""
    global _AUTOMATON
    if _AUTOMATON is None:
        _AUTOMATON = _anchors()
    out: list[tuple[str, int, int]] = []
    past = dict.fromkeys(KINDS, 0)  # where the scan for a kind goes on
    low = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # A-Z only: offsets stay
    for last, what in _AUTOMATON.iter(low):
        kind, at = what[0], last - what[1] + 1
        if kind == "pair":
            if at < past["card"]:
                continue
            end = past["card"] = _chain(text, at).end()
            if end - at >= 14:
                number = text[at:end].translate(_digits)
                if 14 <= len(number) <= 19 and luhn(number):
                    out.append(("card", at, end))
        elif kind == "dot":
            if at < past["ip"]:
                continue
            start = at
            while start > past["ip"] and "0" <= text[start - 1] <= "9":
                start -= 1
            parts, end = [(start, at + 1)], at + 1
            while len(parts) < 4 and end + 1 < len(text) and text[end] == "." and (m := _number(text, end + 1)):
                parts.append((end + 1, end := m.end()))
            past["ip"] = end
            if len(parts) == 4 and all(_octet(text, a, b) for a, b in parts):
                out.append(("ip", start, end))
        elif kind == "@":
            start, left = at, past["email"]
            while start > left and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _domain(text, at + 1)):
                out.append(("email", start, m.end()))
                past["email"] = m.end()
        elif kind == "dial":
            run = _dial(text, at + 1)
            if run:
                end = run.end()
                while not "0" <= text[end - 1] <= "9":
                    end -= 1
                if end - at >= 4 and 10 <= len(text[at:end].translate(_digits)) <= 15:
                    out.append(("phone", at, end))
        elif kind == "url":
            if at >= past["url_user"] and (m := _userinfo(text, last + 1)) and m.end() - 1 > last + 1:
                out.append(("url_user", last + 1, m.end() - 1))
                past["url_user"] = m.end()
        elif kind == "key":
            if at >= past["secret"] and (m := KEYS[what[2]](text, at)) and not (at and text[at - 1].isalnum()):
                out.append(("secret", at, m.end()))
                past["secret"] = m.end()
        else:
            _behind_cue(text, at, last + 1, what[2], past, out)
    out.sort(key=lambda x: (x[1], _ORDER[x[0]]))
    return out


def _behind_cue(text: str, at: int, end: int, kind: str, past: dict[str, int], out: list[tuple[str, int, int]]) -> None:
    """Read an identifier behind a cue that stands as a word of its own."""
    if at < past[kind] or at and text[at - 1].isalnum() or end < len(text) and text[end].isalpha():
        return
    if kind == "secret":  # a long value of letters and digits, set by : or =
        if (m := _set_to(text, end)) and any(c.isdigit() for c in m[1]) and any(c.isalpha() for c in m[1]):
            out.append((kind, *m.span(1)))
            past[kind] = m.end()
        return
    start = _behind(text, end).end()
    if start == end:
        return
    if kind == "iban":
        if m := _iban(text, start):
            stop = m.end()
            while stop - start >= 15 and not iban_ok(text[start:stop]):  # the next words may have been read along
                stop = text.rfind(" ", start, stop)
            if stop - start >= 15:
                out.append((kind, start, stop))
                past[kind] = stop
        return
    m = (_ssn if kind == "ssn" else _account)(text, start)
    if m and (kind == "ssn" or ACCOUNT_DIGITS[0] <= len(m[0].translate(_digits)) <= ACCOUNT_DIGITS[1]):
        out.append((kind, start, m.end()))
        past[kind] = m.end()


def joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def masked(text: str, found: list[tuple[str, int, int]]) -> str:
    """The text with each stretch of overlapping spans replaced by a mark that names its first kind."""
    if not found:
        return text
    out, at = [], 0
    stretch: list = []
    for kind, a, b in found:
        if stretch and a < stretch[2]:
            stretch[2] = max(stretch[2], b)
            continue
        if stretch:
            out += [text[at : stretch[1]], f"<{stretch[0].upper()}>"]
            at = stretch[2]
        stretch = [kind, a, b]
    return "".join([*out, text[at : stretch[1]], f"<{stretch[0].upper()}>", text[stretch[2] :]])


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, n_added, base_sha256, spans): one row a document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "n_added", "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            cols: list[list] = [[] for _ in names[1:]]
            for text in batch.column("text").to_pylist():
                found = spans(text or "")
                base = [x for x in found if x[0] in BASE]
                row = [sum(x[0] == k for x in base) for k in BASE] + [len(found) - len(base), hashlib.sha256(joined(base).encode()).hexdigest(), joined(found)]
                for c, v in zip(cols, row):
                    c.append(v)
            arrays = [pa.array(c, pa.int64() if i < 5 else pa.string()) for i, c in enumerate(cols)]
            yield pa.record_batch([batch.column("doc_id"), *arrays], names)

    schema = f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, n_added long, base_sha256 string, spans string"
    return docs.select("doc_id", "text").mapInArrow(tidied(run), schema)


def redact(docs: DataFrame) -> DataFrame:
    """The same documents and columns with personal data in `text` masked; `n_chars`, where there is one, follows."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = [t if t is None else masked(t, spans(t)) for t in batch.column("text").to_pylist()]
            cols = [batch.column(n) for n in names]
            cols[names.index("text")] = pa.array(texts, batch.schema.field("text").type)
            if "n_chars" in names:
                at = names.index("n_chars")
                old = cols[at].to_pylist()
                cols[at] = pa.array([o if t is None else len(t) for t, o in zip(texts, old)], batch.schema.field("n_chars").type)
            yield pa.record_batch(cols, names)

    return docs.mapInArrow(tidied(run), docs.schema)
