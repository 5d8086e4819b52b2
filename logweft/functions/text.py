"""Small driver-side text helpers."""

from __future__ import annotations

import json
import re


def first_json(text: str) -> dict | None:
    """The first JSON object of a reply, fenced ones first."""
    decoder = json.JSONDecoder()
    for part in [*re.findall(r"(?s)```(?:json)?\s*\n?(.*?)```", text), text]:
        for m in re.finditer(r"\{", part):
            try:
                got, _ = decoder.raw_decode(part, m.start())
            except ValueError:
                continue
            if isinstance(got, dict):
                return got
    return None


def preview(text: str, chars: int = 320) -> str:
    """One line of at most ``chars`` characters."""
    flat = " ".join(text.split())
    return flat if len(flat) <= chars else flat[: chars - 3] + "..."


def table_cell(value: object) -> str:
    return str("" if value is None else value).replace("|", "\\|").replace("\n", " ")


def decode_urls(text: str) -> str:
    """The driver's counterpart of ``extract.decode_urls``, for single texts."""
    from urllib.parse import unquote_plus

    out = []
    for line in text.split("\n"):
        for a, b in (("%26amp;", "&"), ("%26gt;", ">"), ("%26lt;", "<")):
            line = line.replace(a, b)
        out.append(unquote_plus(line))
    return "\n".join(out)
