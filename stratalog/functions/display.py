"""Texts for a console: sizes, times, ranges, bars, curves, trees and panels."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

BLOCKS = "▁▂▃▄▅▆▇█"
#: Shares of a resource from which on it is worth a look, and critical.
HIGH, CRITICAL = 70.0, 90.0


def sparkline(values: Sequence[float]) -> str:
    """One block for each value, by its place between the least and the largest; the lowest for all if they are equal."""
    if not values:
        return ""
    low, high = min(values), max(values)
    top = len(BLOCKS) - 1
    return "".join(BLOCKS[0 if high <= low else round((v - low) / (high - low) * top)] for v in values)


def size_text(size: float) -> str:
    """1.5 KB of 1536."""
    for unit in ("B", "KB", "MB", "GB"):
        if abs(size) < 1024:
            return f"{size:.0f} {unit}" if unit == "B" else f"{size:.1f} {unit}"
        size /= 1024
    return f"{size:.1f} TB"


def time_text(seconds: float) -> str:
    return f"{seconds:.0f} s" if seconds < 60 else f"{seconds / 60:.1f} min" if seconds < 3600 else f"{seconds / 3600:.1f} h"


def range_text(start, end) -> str:
    """A range of times; the day of the end only if it is another one."""
    if start is None or end is None:
        return "-"
    return f"{start:%Y-%m-%d %H:%M} - {end:%H:%M}" if start.date() == end.date() else f"{start:%Y-%m-%d %H:%M} - {end:%Y-%m-%d %H:%M}"


def bar(percent: float | None, width: int = 20) -> str:
    """[#####...............] 25.0 % with a mark where a threshold is reached; - for none."""
    if percent is None:
        return "-"
    filled = round(min(100.0, max(0.0, percent)) / 100 * width)
    mark = " !!" if percent >= CRITICAL else " !" if percent >= HIGH else ""
    return f"[{'#' * filled}{'.' * (width - filled)}] {percent:.1f} %{mark}"


def tree(title: str, children: Iterable[tuple[str, object]]) -> str:
    own = list(children)
    return "\n".join([title, *(f"{'└' if i == len(own) - 1 else '├'}─ {name}: {value}" for i, (name, value) in enumerate(own))])


def panel(title: str, lines: Iterable[str]) -> str:
    own = [x for line in lines for x in str(line).splitlines()]
    width = max([len(title) + 2, *map(len, own)])
    return "\n".join([f"┌ {title} {'─' * (width - len(title))}┐", *(f"│ {x:<{width}} │" for x in own), f"└{'─' * (width + 2)}┘"])


def table(headings: Sequence[str], rows: Iterable[Sequence[object]]) -> str:
    """Columns as wide as their longest cell; numbers to the right."""
    plain = [list(r) for r in rows]
    shown = [["-" if c is None else f"{c:.4g}" if isinstance(c, float) else str(c) for c in r] for r in plain]
    widths = [max([len(h), *(len(r[i]) for r in shown)]) for i, h in enumerate(headings)]
    lines = ["  ".join(h.ljust(w) for h, w in zip(headings, widths, strict=True)).rstrip()]
    for r, p in zip(shown, plain, strict=True):
        lines.append("  ".join(c.rjust(w) if isinstance(v, (int, float)) and not isinstance(v, bool) else c.ljust(w) for c, v, w in zip(r, p, widths, strict=True)).rstrip())
    return "\n".join(lines)
