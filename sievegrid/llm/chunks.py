"""Cutting text at places where no tokenizer of the public files joins across.

All the pre-token patterns used here let white space join only what follows it,
so a run of white space with the run of other characters after it (a chunk) is
encoded alike alone and inside its text. Encoding therefore needs to happen once
per distinct chunk and worker.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

#: White space as the Unicode property has it; Python's own classes add U+001C to U+001F.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CHUNK = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
WORD = re.compile(f"[^{SPACE}]+")
_SEPARATORS = "\x1c\x1d\x1e\x1f"


def chunks(text: str) -> list[str]:
    return CHUNK.findall(text)


def words(text: str) -> list[str]:
    """Runs of other than white space."""
    if any(c in text for c in _SEPARATORS):
        return WORD.findall(text)
    return text.split()


class Memo(dict):
    """A cache of `encode` per worker, in two generations: when one is full it becomes the old one, and what is
    used again moves to the new one. The limit, of one generation, bounds memory only; what is asked for is
    always computed.
    """

    def __init__(self, encode: Callable[[list[str]], Iterable], limit: int = 150_000):
        super().__init__()
        self.encode, self.limit, self.old = encode, limit, {}

    def fill(self, rows: Iterable[Iterable[str]]) -> None:
        """Holds what the keys of rows need, encoding new ones many at a time."""
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()
        old, new = self.old, []
        for k in set().union(*rows):
            if k not in self:
                if k in old:
                    self[k] = old[k]
                else:
                    new.append(k)
        for i in range(0, len(new), 50_000):
            part = new[i : i + 50_000]
            self.update(zip(part, self.encode(part), strict=True))

    def __missing__(self, key: str):
        value = self.old.get(key)
        if value is None:
            value = next(iter(self.encode([key])))
        self[key] = value
        return value
