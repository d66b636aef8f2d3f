"""Control strings that stand inside text: which sets of them can be found again without doubt."""

from __future__ import annotations

from collections.abc import Sequence


def check_marks(marks: Sequence[str]) -> None:
    """Raise if marks are empty or equal, or if one can start inside another.

    Without such overlaps a mark in a text is found where it was put, whatever stands before and
    after it.
    """
    if not all(marks) or len(set(marks)) < len(marks):
        raise ValueError(f"marks must be different and not empty: {list(marks)}")
    for mark in marks:
        for at in range(1, len(mark)):
            rest = mark[at:]
            other = next((m for m in marks if m.startswith(rest) or rest.startswith(m)), None)
            if other:
                raise ValueError(f"{other!r} can start inside {mark!r}")
