"""Named extensions: readers, document types, skills, providers."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any


class Registry:
    def __init__(self, what: str):
        self.what, self._found = what, {}

    def register(self, name: str, replace: bool = False) -> Callable[[Any], Any]:
        def add(item: Any) -> Any:
            if name in self._found and not replace:
                raise ValueError(f"{self.what} {name!r} is registered already")
            self._found[name] = item
            return item

        return add

    def __getitem__(self, name: str) -> Any:
        if name not in self._found:
            raise KeyError(f"no {self.what} {name!r}; there are {', '.join(sorted(self._found)) or 'none'}")
        return self._found[name]

    def __iter__(self):
        return iter(sorted(self._found))


SKILLS, EMBEDDERS, CHATS = Registry("skill"), Registry("embedder"), Registry("chat provider")
SOURCES, CLASSIFIERS = Registry("content source"), Registry("document type")


def migrated(table: Any, version: int, steps: list[Callable[[Any], Any]]) -> tuple[Any, int]:
    """A table brought from its version to the newest one, and that version: ``steps[i]`` takes version i to i + 1."""
    for step in steps[version:]:
        table = step(table)
    return table, max(version, len(steps))


class Hooks:
    """Callbacks by event name; one that fails is handed to ``failed`` and the others still run."""

    def __init__(self, failed: Callable[[str, Exception], None] = lambda event, e: None):
        self._on: dict[str, list[Callable[..., None]]] = {}
        self.failed = failed

    def on(self, event: str, fn: Callable[..., None]) -> None:
        self._on.setdefault(event, []).append(fn)

    def emit(self, event: str, **values: Any) -> None:
        for fn in self._on.get(event, []):
            try:
                fn(**values)
            except Exception as e:
                self.failed(event, e)
