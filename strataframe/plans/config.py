"""Nested configurations with ids, references and targets from a registry."""

from __future__ import annotations

import re
from collections.abc import Callable
from copy import deepcopy

REFERENCE = re.compile(r"@([\w:]+)")
SEP = "::"


class Config:
    """A nested dict or list read and written by ids such as ``train::steps::0``.

    A string ``@id`` stands for the resolved value of that id.  A dict with ``_target_`` becomes the
    call of a registered function with its other items; ``_disabled_`` leaves it out.  Strings are
    never run as code."""

    def __init__(self, data: dict, targets: dict[str, Callable] | None = None):
        self.data, self.targets = deepcopy(data), dict(targets or {})
        self._made: dict[str, object] = {}

    def get(self, id_: str = ""):
        found = self.data
        for part in filter(None, id_.split(SEP)):
            found = found[int(part)] if isinstance(found, list) else found[part]
        return found

    def set(self, id_: str, value) -> None:
        *parents, last = id_.split(SEP)
        at = self.get(SEP.join(parents))
        at[int(last) if isinstance(at, list) else last] = value
        self._made.clear()

    def update(self, values: dict) -> None:
        for id_, value in values.items():
            self.set(id_, value)

    def resolve(self, id_: str = "", waiting: tuple[str, ...] = ()):
        """The value of an id with all references and targets in it resolved."""
        if id_ in waiting:
            raise ValueError(f"circular reference: {' -> '.join([*waiting, id_])}")
        if id_ not in self._made:
            self._made[id_] = self._resolved(self.get(id_), id_, (*waiting, id_))
        return self._made[id_]

    def _resolved(self, value, id_: str, waiting: tuple[str, ...]):
        child = lambda k: f"{id_}{SEP}{k}" if id_ else str(k)
        if isinstance(value, str) and (m := REFERENCE.fullmatch(value)):
            return self.resolve(m[1], waiting)
        if isinstance(value, list):
            return [self.resolve(child(i), waiting) for i in range(len(value)) if not self._off(value[i])]
        if isinstance(value, dict):
            items = {k: self.resolve(child(k), waiting) for k in value if k not in ("_target_", "_disabled_") and not self._off(value[k])}
            if "_target_" in value:
                return self.targets[value["_target_"]](**items)
            return items
        return value

    @staticmethod
    def _off(value) -> bool:
        return isinstance(value, dict) and bool(value.get("_disabled_"))
