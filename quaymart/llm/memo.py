"""A bounded memo for results of repeated words, and objects that outlive a task."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any


_KEPT: dict[str, tuple[Any, Any]] = {}


def per_worker(kind: str, key: Any, make: Callable[[], Any]) -> Any:
    """The object of this kind that this Python process made for ``key``. Spark uses a worker for many tasks, and what
    an encoder has learned in one serves the next; of each kind one object is kept, so another key replaces it."""
    held = _KEPT.get(kind)
    if held is None or held[0] != key:
        held = _KEPT[kind] = (key, make())
    return held[1]


class Memo(dict):
    """``memo[word]`` computes once. At most two generations of ``limit`` words are held: when the
    young one is full it becomes the old one, and words met again move back, so frequent words stay.
    Words longer than ``longest`` are computed each time and never held."""

    def __init__(self, compute: Callable[[str], Any], limit: int = 150_000, longest: int = 200):
        super().__init__()
        self.compute, self.limit, self.longest, self.old = compute, limit, longest, {}

    def __missing__(self, word: str) -> Any:
        found = self.old.get(word)
        if found is None:
            found = self.compute(word)
        if len(word) <= self.longest:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[word] = found
        return found
