"""YAML of note headers: dates and yes/no stay text, numbers are decimal only. Uses PyYAML where it is installed."""

from __future__ import annotations

import json
import re

try:
    import yaml
except ImportError:  # a small reader of flat headers stands in
    yaml = None

_PLAIN_INT, _PLAIN_FLOAT = r"[-+]?(0|[1-9][0-9]*)$", r"[-+]?([0-9]+\.[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?$"

if yaml is not None:

    class _Loader(yaml.SafeLoader):
        yaml_implicit_resolvers: dict = {}

    for _tag, _pattern, _first in (
        ("bool", r"(true|True|TRUE|false|False|FALSE)$", "tTfF"),
        ("null", r"(~|null|Null|NULL|)$", "~nN\0"),
        ("int", _PLAIN_INT, "-+0123456789"),
        ("float", _PLAIN_FLOAT, "-+.0123456789"),
        ("merge", r"<<$", "<"),
    ):
        _Loader.add_implicit_resolver(f"tag:yaml.org,2002:{_tag}", re.compile(_pattern), list(_first) if _tag != "null" else ["~", "n", "N", ""])


class YamlError(ValueError):
    """The text is not YAML that we can read."""


def load(text: str):
    if yaml is None:
        return _flat(text)
    try:
        return yaml.load(text, Loader=_Loader)
    except (yaml.YAMLError, ValueError, TypeError) as e:
        raise YamlError(str(e)) from e


def _scalar(text: str):
    text = text.strip()
    if text[:1] in "\"'" and text[-1:] == text[:1] and len(text) > 1:
        return text[1:-1]
    if text.startswith("[") and text.endswith("]"):
        return [_scalar(x) for x in text[1:-1].split(",") if x.strip()]
    if text[:1] in "[{&*!|>%@`" or ": " in text:
        raise YamlError(f"can't read {text!r}")
    if re.match(_PLAIN_INT, text):
        return int(text)
    if re.match(_PLAIN_FLOAT, text):
        return float(text)
    return {"": None, "~": None, "null": None, "true": True, "false": False}.get(text, text)


def _flat(text: str):
    out: dict = {}
    key = None
    for line in text.splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        if m := re.match(r"\s*- (.*)", line):
            if key is None:
                raise YamlError("a list without a key")
            out[key] = [*(out[key] or []), _scalar(m[1])]
        elif m := re.match(r"([\w.-]+):(?:\s+(.*))?$", line):
            key, out[m[1]] = m[1], _scalar(m[2] or "")
        else:
            raise YamlError(f"can't read {line!r}")
    return out or None


def dump(header: dict) -> str:
    """A header as YAML, keys in their order."""
    if yaml is not None:
        class Dumper(yaml.SafeDumper):
            yaml_implicit_resolvers = _Loader.yaml_implicit_resolvers

            def increase_indent(self, flow=False, indentless=False):
                return super().increase_indent(flow, False)

        return yaml.dump(header, Dumper=Dumper, sort_keys=False, allow_unicode=True, width=1 << 20)
    return "".join(f"{k}: {json.dumps(v, ensure_ascii=False)}\n" for k, v in header.items())


def scalar(value) -> str:
    """One value as YAML that `load` reads back: plain where that is safe, else in double quotes."""
    if isinstance(value, str):
        try:
            plain = bool(re.fullmatch(r"[^\W\d][\w ./+-]*", value)) and value == value.strip() and load(value) == value
        except YamlError:
            plain = False
        if plain:
            return value
        return re.sub(r"[^ -~]", lambda m: m[0] if m[0].isprintable() else f"\\U{ord(m[0]):08x}", json.dumps(value, ensure_ascii=False))
    return json.dumps(value)
