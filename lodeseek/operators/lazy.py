"""Models that are named, not sent: each Python worker loads one when it first needs it, and keeps it for later tasks."""

from __future__ import annotations

import importlib
from dataclasses import dataclass
from functools import lru_cache
from typing import Any


@dataclass(frozen=True)
class Lazy:
    """``target`` ("module:name") called with the arguments, pairs of a name and a value that can be hashed."""

    target: str
    arguments: tuple[tuple[str, Any], ...] = ()


@lru_cache(maxsize=8)
def load_model(model: Lazy) -> Any:
    """The model, loaded once in a process."""
    module, _, name = model.target.partition(":")
    return getattr(importlib.import_module(module), name)(**dict(model.arguments))


def loaded(model: Any) -> Any:
    return load_model(model) if isinstance(model, Lazy) else model
