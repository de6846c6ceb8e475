"""Memory of Python workers: a bounded cache of what was made of the keys met lately, and giving back what a task used."""

from __future__ import annotations

import ctypes
import weakref
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa

#: The caches of this process, and the operator (module) whose task it ran last.
_caches: weakref.WeakValueDictionary = weakref.WeakValueDictionary()
_last: list[str] = []


def forgettable(cache) -> None:
    """cache.forget() is called when this worker process turns to tasks of another operator."""
    _caches[id(cache)] = cache


def _turn_to(operator: str) -> None:
    if _last and _last[0] != operator:
        for cache in list(_caches.values()):
            cache.forget()
    _last[:] = [operator]


def _release() -> None:
    """Give free memory back to the system: Arrow's, and the C library's where it offers that."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def giving_back(run: Callable) -> Callable:
    """run for mapInArrow, which empties the caches of other operators when its task begins and gives unused memory back
    when it ends: the worker process stays for later tasks of other stages, beside the executor's JVM."""

    @wraps(run)
    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _turn_to(run.__module__)
        yield from run(batches)
        _release()

    return inner


class Recent(dict):
    """recent[key] is make(key). Two generations of `size` keys each are kept; a key longer than `longest` is made anew
    each time. So memory is bounded whatever the input."""

    def __init__(self, make: Callable, size: int = 400_000, longest: int = 48):
        super().__init__()
        self.make, self.size, self.longest, self.old = make, size, longest, {}
        forgettable(self)

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.longest:
            self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value

    def forget(self) -> None:
        self.clear()
        self.old = {}
