"""Bounded samples of labelled texts."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterable
from typing import TypeVar

Label = TypeVar("Label")


def fitting(rows: Iterable[tuple[str, Label]], characters: int, of: Callable[[Label], Hashable] = lambda label: label) -> list[tuple[str, Label]]:
    """The (text, label) rows, in their order, that fit into ``characters`` of each class (``of`` a label).

    A text that does not fit is passed over; those after it are not.
    """
    found: list[tuple[str, Label]] = []
    left: dict[Hashable, int] = {}
    for text, label in rows:
        kind = of(label)
        if len(text) <= left.setdefault(kind, characters):
            left[kind] -= len(text)
            found.append((text, label))
    return found
