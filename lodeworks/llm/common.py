"""What the operators share: text expressions, a worker's cache, and the library's shared storage and checked broadcasts."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodeworks.storage import bounded, new_path, remove, remove_path, spread_table, stored, table

__all__ = ["bounded", "new_path", "remove", "remove_path", "spread_table", "stored", "table"]

#: White space of the word and line rules: space and U+0009 to U+000D.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, other letters kept."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def text_of(c: Column) -> Column:
    """Null texts count as empty."""
    return F.coalesce(c, F.lit(""))


def worker_cache(key: tuple, make: Callable[[], Any]) -> Any:
    """What make() returned first in this Python process: a worker loads a vocabulary once and not once a task."""
    held = sys.modules.setdefault("_lodeworks_worker", types.ModuleType("_lodeworks_worker"))
    if key not in vars(held).setdefault("kept", {}):
        held.kept[key] = make()
    return held.kept[key]


class Remembered(dict):
    """make(word) of words lately met, and of those met before that: frequent words outlive a full cache; long words are not kept."""

    def __init__(self, make: Callable[[str], Any], size: int, longest: int = 64):
        super().__init__()
        self.make, self.size, self.longest, self.older = make, size, longest, {}

    def __missing__(self, word: str) -> Any:
        made = self.older.pop(word, None)
        if made is None:
            made = self.make(word)
        if len(word) <= self.longest:
            if len(self) >= self.size:
                self.older = dict(self)
                self.clear()
            self[word] = made
        return made
