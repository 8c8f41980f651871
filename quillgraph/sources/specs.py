"""Source specs: ``kind:value?param=..`` strings that name what to read."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from urllib.parse import parse_qsl, unquote

# The kinds a spec can have, and what is read without one.
NAMED = ("codex:memories", "codex:sessions", "codex:skills")
DEFAULT = "codex:memories"


@dataclass(frozen=True)
class SourceSpec:
    kind: str
    value: str
    params: dict[str, str] = field(default_factory=dict)
    raw: str = ""


def parse_spec(raw: str) -> SourceSpec:
    """Parse one spec; blank keys are dropped, values are URL-decoded."""
    text = raw.strip()
    if not text:
        raise ValueError("empty source spec")
    head, _, query = text.partition("?")
    params = {k.strip(): v for k, v in parse_qsl(query, keep_blank_values=True) if k.strip()}
    if head in NAMED:
        return SourceSpec(head, head.split(":", 1)[1], params, raw)
    kind, sep, value = head.partition(":")
    if not sep or kind not in ("file", "glob") or not value:
        raise ValueError(f"unknown source spec: {raw}")
    return SourceSpec(kind, unquote(value), params, raw)


def parse_specs(values: list[str] | None, fallback: str = DEFAULT) -> list[SourceSpec]:
    return [parse_spec(v) for v in (values or [fallback])]


def unique(values: list[str]) -> list[str]:
    """Without repeats, in order."""
    return list(dict.fromkeys(values))


def glob_root(pattern: str) -> str:
    """The folder before the first wildcard."""
    head = re.split(r"[*?]", pattern, maxsplit=1)[0]
    return head.rsplit("/", 1)[0] or "/"


def glob_regex(pattern: str) -> str:
    """``**`` crosses folders, ``*`` and ``?`` do not."""
    out = []
    for part in re.findall(r"\*\*|\*|\?|[^*?]+", pattern):
        out.append({"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part) or re.escape(part))
    return "^" + "".join(out) + "$"


def clamp(value: int | None, default: int, low: int, high: int) -> int:
    """An option within its bounds."""
    return default if value is None else max(low, min(high, value))
