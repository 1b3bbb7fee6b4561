"""One parser for the ways in which dialects write durations. All come out as microseconds."""

from __future__ import annotations

import re

# Microseconds of each unit. Months and years are flat, as the dialects with such literals have them.
UNITS = {
    "n": 0.001, "ns": 0.001, "u": 1, "us": 1, "µ": 1, "a": 1_000, "ms": 1_000, "s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000,
    "d": 86_400_000_000, "w": 604_800_000_000, "mo": 2_592_000_000_000, "y": 31_536_000_000_000,
}
WORDS = {
    "nanosecond": "ns", "microsecond": "us", "millisecond": "ms", "second": "s", "sec": "s", "minute": "m", "min": "m", "hour": "h", "day": "d", "week": "w", "month": "mo", "year": "y",
}
_SHORT = re.compile(r"(\d+(?:\.\d+)?)(ns|us|ms|mo|[nuµasmhdwy])")
_ISO = re.compile(r"P(?:(\d+)Y)?(?:(\d+)M)?(?:(\d+)W)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?")
_LONG = re.compile(r"(\d+(?:\.\d+)?)\s*([a-zA-Z]+)")


def micros(text: str) -> int:
    """'5m', '1h30m', '100a', 'PT1H', '15 minutes', 'hour': microseconds. Anything else is an error."""
    s = text.strip()
    if s and _SHORT.sub("", s) == "":
        return round(sum(float(n) * UNITS[u] for n, u in _SHORT.findall(s)))
    if s.upper().startswith("P") and len(s) > 1 and (m := _ISO.fullmatch(s.upper())):
        return round(sum(float(n or 0) * UNITS[u] for n, u in zip(m.groups(), ("y", "mo", "w", "d", "h", "m", "s"))))
    parts = _LONG.findall(s) or [("1", s)]
    if _LONG.sub("", s).replace(",", "").strip() in ("", s):
        try:
            return round(sum(float(n) * UNITS[WORDS[u.lower().rstrip("s") if u.lower() not in ("ms", "us", "ns") else u]] for n, u in parts))
        except KeyError:
            pass
    raise ValueError(f"not a duration: {text!r}")
