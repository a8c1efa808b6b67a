"""Header matching for billing files."""

from __future__ import annotations

_AS_UNDERSCORE = str.maketrans(" -", "__")


def _plain(header: str, slash: bool) -> str:
    """How headers are compared: case and outer blanks do not count, separators are alike."""
    plain = header.strip().lower().translate(_AS_UNDERSCORE)
    return plain.replace("/", "_") if slash else plain


def resolve(columns: list[str], candidates: list[str], slash: bool = False) -> str | None:
    """The source header that stands for a field, ranked by the place of its candidate; of equal headers the last one."""
    places: dict[str, int] = {}
    for place, candidate in enumerate(candidates):
        places.setdefault(_plain(candidate, slash), place)
    ranked = [(places[plain], -position, column) for position, column in enumerate(columns) if (plain := _plain(column or "", slash)) in places]
    return min(ranked)[2] if ranked else None


def quoted(column: str) -> str:
    """Column name safe against dots and slashes."""
    return "`" + column.replace("`", "``") + "`"
