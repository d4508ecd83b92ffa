"""Settings from layers: files of ``key: value`` lines, then the environment."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import fields, replace

from notegraph.settings import DEFAULT, Settings

PREFIX = "NOTEGRAPH_"


def parse_flat(text: str) -> dict[str, str]:
    """``key: value`` lines; comments, blank lines and nested lines are skipped, quotes dropped."""
    out = {}
    for line in text.splitlines():
        if line[:1] in ("#", " ", "\t", "") or ":" not in line:
            continue
        key, _, value = line.partition(":")
        out[key.strip()] = value.split(" #")[0].strip().strip("\"'")
    return {k: v for k, v in out.items() if v}


def settings(*layers: Mapping[str, str], env: Mapping[str, str] | None = None, base: Settings = DEFAULT) -> Settings:
    """Later layers win, the environment over all; values take the field's own type."""
    merged: dict[str, str] = {}
    for layer in layers:
        merged |= layer
    merged |= {k[len(PREFIX) :].lower(): v for k, v in (env or {}).items() if k.startswith(PREFIX)}
    known = {f.name: getattr(base, f.name) for f in fields(base)}
    return replace(base, **{k: type(known[k])(v) for k, v in merged.items() if k in known and isinstance(known[k], (int, float))})
