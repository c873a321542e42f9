"""Telling page text from scanned text."""

from __future__ import annotations

import re

_OPEN_END = re.compile(r"[.!?:…][\"'»)\]]*\s*$")
_LOWER_START = re.compile(r"\s*[a-zà-öø-ÿ]")


def is_scanned(text: str | None) -> bool:
    """True where lines break inside sentences, as on a scanned page.

    Page text has one paragraph or entry to a line, so no line ends open with the next one
    going on in lower case. Null, empty and blank texts are neither.
    """
    if not text:
        return False
    lines = [x for x in text.split("\n") if x.strip()]
    return any(not _OPEN_END.search(a) and _LOWER_START.match(b) for a, b in zip(lines, lines[1:]))
