"""Settings from the environment and from a file of NAME=value lines; what the environment says comes first."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping

_LINE = re.compile(r"\s*(?:export\s+)?([A-Za-z_]\w*)\s*=\s*(.*?)\s*")


def read_settings(text: str) -> dict[str, str]:
    """Settings of a file's text; empty lines, comments and other lines say nothing, quotes around a value are dropped."""
    out = {}
    for line in text.splitlines():
        if not line.lstrip().startswith("#") and (m := _LINE.fullmatch(line)):
            name, value = m.groups()
            out[name] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"" else value
    return out


def settings(path: str | None = None, environment: Mapping[str, str] | None = None) -> dict[str, str]:
    """The file's settings, if there is such a file, under those of the environment."""
    environment = os.environ if environment is None else environment
    held = {}
    if path and os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            held = read_settings(f.read())
    return held | dict(environment)
