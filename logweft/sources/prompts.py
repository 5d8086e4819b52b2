"""Prompt sections from Markdown files with a front matter that names each section."""

from __future__ import annotations

import re
from pathlib import Path

SECTION = re.compile(r"(?ms)^---[ \t]*\nid:[ \t]*(\S+)[ \t]*\n(?:(?!---)[^\n]*\n)*---[ \t]*\n(.*?)(?=^---[ \t]*\nid:|\Z)")


def fragments(text: str) -> dict[str, str]:
    """Sections by id; an id that comes twice is an error."""
    out: dict[str, str] = {}
    for m in SECTION.finditer(text):
        if m[1] in out:
            raise ValueError(f"section {m[1]} comes twice")
        out[m[1]] = m[2].strip()
    return out


def load_fragment(path: str, section: str) -> str:
    got = fragments(Path(path).read_text(encoding="utf-8"))
    if section not in got:
        raise KeyError(f"no section {section} in {path}")
    return got[section]


def render(text: str, **values: object) -> str:
    """{{name}} replaced; a name without a value is an error."""
    def one(m: re.Match) -> str:
        if m[1] not in values:
            raise KeyError(m[1])
        return str(values[m[1]])

    return re.sub(r"\{\{\s*(\w+)\s*\}\}", one, text)
