"""Numbered states of a table: what readers see changes at once, by one file that appears."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import SparkSession

from foliospark.sources.files import Files


class Conflict(RuntimeError):
    """Another writer has put a newer state in place; what was prepared on the old one must be done again."""


class Manifest:
    """States below `<root>/_manifest`, one JSON file each; the one of the highest number counts.

    A state is written beside its place and renamed into it, so a reader finds the old state or the new one. Of two
    writers that start from the same state the second gets a Conflict.
    """

    FOLDER = "_manifest"

    def __init__(self, spark: SparkSession, root: str):
        self.files = Files(spark, root)

    def _epochs(self) -> list[int]:
        return [int(n[:-5]) for n in self.files.names(self.FOLDER) if n.endswith(".json") and n[:-5].isdigit()]

    def latest(self) -> tuple[int, dict[str, Any]]:
        """(epoch, state); epoch 0 and an empty state before the first commit."""
        epoch = max(self._epochs(), default=0)
        return epoch, self.at(epoch) if epoch else {}

    def at(self, epoch: int) -> dict[str, Any]:
        return json.loads(self.files.read(f"{self.FOLDER}/{epoch:012d}.json"))

    def commit(self, base: int, state: dict[str, Any]) -> int:
        """Puts the state that follows state `base` in place."""
        if max(self._epochs(), default=0) != base or not self.files.create(f"{self.FOLDER}/{base + 1:012d}.json", json.dumps(state)):
            raise Conflict(f"state {base} of {self.files.root} is not the last one any more")
        return base + 1

    def forget(self, keep: int = 2) -> list[dict[str, Any]]:
        """Removes all but the last `keep` states; the states that stay."""
        epochs = sorted(self._epochs())
        for epoch in epochs[:-keep]:
            self.files.delete(f"{self.FOLDER}/{epoch:012d}.json")
        return [self.at(e) for e in epochs[-keep:]]


class Section:
    """A table's part of a state that several tables share: looks like a manifest of its own."""

    def __init__(self, manifest: Manifest, name: str, states: dict[str, Any], writable: bool):
        self.name, self._states, self._writable = name, states, writable
        self.files = manifest.files.below(name)

    def latest(self) -> tuple[int, dict[str, Any]]:
        return 0, self._states.get(self.name, {})

    def commit(self, base: int, state: dict[str, Any]) -> int:
        """Notes the table's new state; it holds when the whole state is committed."""
        if not self._writable:
            raise PermissionError(f"{self.name} is open for reading; change it inside a change of its store")
        self._states[self.name] = state
        return 0
