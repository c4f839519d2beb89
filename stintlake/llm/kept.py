"""What a worker process remembers of the words that it has met, within a bound of bytes."""

from __future__ import annotations

from collections.abc import Callable

#: Bytes that a generation of a map may take, and the length of the longest key that is kept.
BYTES, LONGEST = 32 << 20, 64
#: What an entry takes, and what a character of its key adds (with the value, that grows with it).
ENTRY, CHARACTER = 150, 6


class Kept(dict):
    """Key to ``make(key)``. At most two generations of ``limit`` bytes are kept: a full one becomes the old one, whose
    entries move on when they are met again."""

    def __init__(self, make: Callable, limit: int = BYTES):
        super().__init__()
        self.make, self.limit, self.size, self.old = make, limit, 0, {}

    def __missing__(self, key):
        value = self.old.pop(key, None)
        if value is None:
            value = self.make(key)
        if (n := len(key)) <= LONGEST:
            self.size += ENTRY + CHARACTER * n
            if self.size > self.limit:
                self.old = dict(self)
                self.clear()
                self.size = 0
            self[key] = value
        return value


_HELD: dict = {}


def held(name, build: Callable):
    """What the tasks of one operator share in a process. A process holds it for one operator at a time: when another asks,
    it is let go, so that stages that follow one another don't add up."""
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = build()
    return _HELD[name]
