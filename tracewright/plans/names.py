"""Names of carried columns that would clash with an operator's own."""

from __future__ import annotations

from collections.abc import Iterable, Sequence


def carried(names: Sequence[str], taken: Iterable[str]) -> list[str]:
    """Output names of carried columns: one that clashes with an operator's column gets underscores appended."""
    used = {t.lower() for t in taken}
    out = []
    for n in names:
        while n.lower() in used:
            n += "_"
        used.add(n.lower())
        out.append(n)
    return out
