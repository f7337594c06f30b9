"""A bounded memory of encoded words, shared by the tokenizing operators."""

from __future__ import annotations

import weakref
from collections.abc import Callable

_ALL: weakref.WeakSet = weakref.WeakSet()


def claim(mine: Remembered | None = None) -> None:
    """Forget what other operators have remembered in this worker; workers live on from stage to stage."""
    for other in list(_ALL):
        if other is not mine:
            other.forget()


def give_back() -> None:
    """Return freed memory to the machine at the end of a task; else a worker that waits keeps what its largest task took."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


class Remembered(dict):
    """Word -> bytes for the words met last: two generations, of which the older one goes when the younger is full.

    A word that is not known is computed where it is looked up, so ``map(words.__getitem__, ...)`` is all that a text takes.
    """

    def __init__(self, compute: Callable[[str], bytes], size: int = 200_000, longest: int = 48):
        super().__init__()
        self.compute, self.size, self.longest = compute, size, longest
        self.old: dict = {}
        _ALL.add(self)

    __hash__ = object.__hash__

    def __eq__(self, other: object) -> bool:
        return self is other

    def forget(self) -> None:
        self.clear()
        self.old = {}

    def __missing__(self, word: str) -> bytes:
        got = self.old.get(word)
        if got is None:
            got = self.compute(word)
            if len(word) > self.longest:
                return got
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[word] = got
        return got

    def join(self, words: list[str]) -> bytes:
        """The words' bytes, joined in their order."""
        return b"".join(map(self.__getitem__, words))
