"""Settings files: KEY=VALUE lines."""

from __future__ import annotations

import os
from collections.abc import MutableMapping
from pathlib import Path


#: Fixed value: what an example file holds in place of a key.
PLACEHOLDER = "your_key_here"


def load_env(path: str | Path, into: MutableMapping[str, str] | None = None) -> dict[str, str]:
    """Reads a file of KEY=VALUE lines into the environment, or ``into``; what is set already stays.

    Blank lines, comments, lines without "=", empty values and the placeholder
    are passed over. A file that is not there has no settings. Returns what was
    added.
    """
    target = os.environ if into is None else into
    file, added = Path(path), {}
    for line in file.read_text(encoding="utf-8").splitlines() if file.exists() else ():
        key, _, value = (part.strip() for part in line.strip().partition("="))
        if key and value not in ("", PLACEHOLDER) and not key.startswith("#") and key not in target:
            added[key] = target[key] = value
    return added
