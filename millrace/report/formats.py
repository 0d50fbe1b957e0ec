"""Numbers as people read them."""

from __future__ import annotations


def percent(x: float) -> str:
    return f"{100 * x:.0f}%"


def money(x: float) -> str:
    return f"${x:,.2f}"


def _scaled(n: float, units: tuple[str, ...], step: float, first: str, rest: str, last: str) -> str:
    x = n
    for i, unit in enumerate(units):
        if abs(x) < step:
            return (first if i == 0 else rest).format(x, unit)
        x /= step
    return f"{x:.1f}{last}"


def human(n: float) -> str:
    return _scaled(n, ("", "K", "M", "B"), 1000, "{:g}{}", "{:.0f}{}", "T")


def human_tokens(n: float) -> str:
    return _scaled(float(n), ("", "K", "M", "B"), 1000, "{:.0f}{}", "{:.1f}{}", "T")


def size(n: float) -> str:
    return _scaled(float(n), ("B", "KB", "MB", "GB"), 1024, "{:.0f}{}", "{:.1f}{}", "TB")


def many(n: int, one: str, more: str | None = None) -> str:
    return f"{n} {one if n == 1 else more or one + 's'}"
