"""Models that stay loaded in a Python worker."""

from __future__ import annotations

import uuid
import weakref
from collections import OrderedDict
from collections.abc import Callable
from typing import TypeVar

Model = TypeVar("Model")

# Models held by one worker at a time; the one unused for longest goes first.
MOST_HELD = 4

_names: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()
_held: OrderedDict[str, object] = OrderedDict()


def held(name: str, factory: Callable[[], Model]) -> Model:
    if name not in _held:
        while len(_held) >= MOST_HELD:
            _held.popitem(last=False)
        _held[name] = factory()
    _held.move_to_end(name)
    return _held[name]


def once_per_worker(factory: Callable[[], Model]) -> Callable[[], Model]:
    """``factory`` called once by each reused Python worker, however many tasks it runs.

    Spark unpickles a function for every task, so the model is kept in this module, under a name
    that the driver gives to each factory.
    """
    name = _names.setdefault(factory, uuid.uuid4().hex)
    return lambda: held(name, factory)
