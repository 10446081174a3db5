"""Durations such as 7d or 1h."""

from __future__ import annotations

import re

from ..errors import InvalidRequest

_UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}


def seconds(text: str) -> int:
    found = re.fullmatch(r"\s*(\d+)\s*([smhdw])\s*", text)
    if not found:
        raise InvalidRequest(f"not a duration: {text!r}")
    return int(found[1]) * _UNITS[found[2]]
