"""Durations, times, byte sizes and numbers as text."""

from __future__ import annotations

import math
import re
from datetime import datetime, timezone

UNIT_MS = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000, "y": 31_536_000_000}
DURATION = r"(?:\d+y)?(?:\d+w)?(?:\d+d)?(?:\d+h)?(?:\d+m(?!s))?(?:\d+s)?(?:\d+ms)?"


def parse_duration(text: str) -> int:
    """``1h30m`` -> milliseconds."""
    if not text or not re.fullmatch(DURATION, text):
        raise ValueError(f"not a valid duration: {text!r}")
    return sum(int(n) * UNIT_MS[u] for n, u in re.findall(r"(\d+)(ms|[ywdhms])", text))


def format_duration(ms: int) -> str:
    """Milliseconds -> the shortest usual form; years and weeks only where nothing remains."""
    if ms == 0:
        return "0s"
    out, rest = "", abs(ms)
    for unit, whole in (("y", True), ("w", True), ("d", False), ("h", False), ("m", False), ("s", False), ("ms", False)):
        size = UNIT_MS[unit]
        if rest >= size and not (whole and rest % size):
            out += f"{rest // size}{unit}"
            rest %= size
    return ("-" if ms < 0 else "") + out


def parse_step(text: str | float) -> int:
    """Seconds as a number, or a duration -> milliseconds, positive."""
    try:
        seconds = float(text)
    except ValueError:
        ms = parse_duration(str(text))
    else:
        if not math.isfinite(seconds) or abs(seconds) > 9.2e15:
            raise ValueError(f"cannot parse {text!r} to a valid duration")
        ms = round(seconds * 1000)
    if ms <= 0:
        raise ValueError("zero or negative step is not accepted")
    return ms


def parse_time(text: str | float) -> int:
    """Epoch seconds (rounded to ms) or RFC 3339 (cut to ms) -> epoch milliseconds."""
    try:
        seconds = float(text)
    except ValueError:
        match = re.fullmatch(r"(\d{4}-\d\d-\d\d[Tt]\d\d:\d\d:\d\d)(\.\d+)?([Zz]|[+-]\d\d:\d\d)", str(text))
        if not match:
            raise ValueError(f"cannot parse {text!r} to a valid timestamp") from None
        whole = datetime.fromisoformat(match[1].upper() + match[3].upper().replace("Z", "+00:00"))
        return int(whole.astimezone(timezone.utc).timestamp()) * 1000 + int(((match[2] or ".0")[1:] + "000")[:3])
    if not math.isfinite(seconds):
        raise ValueError(f"cannot parse {text!r} to a valid timestamp")
    return math.floor(seconds * 1000 + 0.5)


def parse_bytes(text: str) -> int:
    """``512M`` -> bytes; K, M and G are binary."""
    match = re.fullmatch(r"(\d+)([KMG]?)", text.strip())
    if not match:
        raise ValueError(f"not a valid byte size: {text!r}")
    return int(match[1]) << {"": 0, "K": 10, "M": 20, "G": 30}[match[2]]


def format_float(value: float) -> str:
    """Shortest round-trip decimal without exponent; +Inf, -Inf, NaN."""
    if math.isnan(value):
        return "NaN"
    if math.isinf(value):
        return "+Inf" if value > 0 else "-Inf"
    text = repr(float(value))
    if "e" in text:
        mantissa, _, exponent = text.partition("e")
        sign = "-" if mantissa.startswith("-") else ""
        digits = mantissa.lstrip("-")
        whole, _, part = digits.partition(".")
        shift = int(exponent)
        if shift >= 0:
            part = part.ljust(shift, "0")
            text = sign + whole + part[:shift] + ("." + part[shift:] if part[shift:].strip("0") else "")
        else:
            text = sign + "0." + "0" * (-shift - 1) + whole + (part if part.strip("0") else "")
    return text.removesuffix(".0")
