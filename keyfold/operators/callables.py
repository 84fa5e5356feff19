"""The fold algebra as Python callables, for stateful streams and sorted runs."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Fold:
    """(state, input) -> state."""

    run: Callable[[Any, Any], Any]

    def __call__(self, s: Any, a: Any) -> Any:
        return self.run(s, a)

    def contramap(self, f: Callable) -> Fold:
        return Fold(lambda s, a: self.run(s, f(a)))

    def contra_collect(self, f: Callable) -> Fold:
        """``f`` gives None for inputs that it does not match: those leave the state as it is."""

        def run(s: Any, a: Any) -> Any:
            b = f(a)
            return s if b is None else self.run(s, b)

        return Fold(run)

    def transform_state(self, get: Callable, put: Callable) -> Fold:
        return Fold(lambda s, a: put(s, self.run(get(s), a)))

    def transform(self, get: Callable, put: Callable) -> Fold:
        return Fold(lambda s, a: put(s, self.run(get(s, a), a), a))

    def then(self, other: Fold) -> Fold:
        return Fold(lambda s, a: other.run(self.run(s, a), a))

    def filter(self, cond: Callable[[Any, Any], bool]) -> Fold:
        return Fold(lambda s, a: self.run(s, a) if cond(s, a) else s)

    def handle_error(self, f: Callable[[Any, Any, Exception], Any]) -> Fold:
        """Recover from this fold's error, with the state before it."""

        def run(s: Any, a: Any) -> Any:
            try:
                return self.run(s, a)
            except Exception as e:  # noqa: BLE001
                return f(s, a, e)

        return Fold(run)

    @staticmethod
    def set(value: Any) -> Fold:
        return Fold(lambda s, a: value)

    @staticmethod
    def modify(f: Callable[[Any], Any]) -> Fold:
        return Fold(lambda s, a: f(s))

    @staticmethod
    def tap(f: Callable[[Any], None]) -> Fold:
        return Fold(lambda s, a: (f(s), s)[1])


class FoldOption(Fold):
    """The same over an optional state: None is no state."""

    def then(self, other: Fold) -> FoldOption:
        def run(s: Any, a: Any) -> Any:
            first = self.run(s, a)
            return None if first is None else other.run(first, a)

        return FoldOption(run)

    def filter(self, cond: Callable[[Any, Any], bool]) -> FoldOption:
        return FoldOption(lambda s, a: self.run(s, a) if s is None or cond(s, a) else s)

    def handle_error(self, f: Callable[[Any, Any, Exception], Any]) -> FoldOption:
        """Without a state an error gives None."""
        safe = Fold(self.run).handle_error(lambda s, a, e: None if s is None else f(s, a, e))
        return FoldOption(safe.run)

    @staticmethod
    def empty() -> FoldOption:
        return FoldOption(lambda s, a: None)

    @staticmethod
    def set(value: Any) -> FoldOption:
        return FoldOption(lambda s, a: value)

    @staticmethod
    def modify(f: Callable[[Any, Any], Any]) -> FoldOption:
        return FoldOption(lambda s, a: None if s is None else f(s, a))

    @staticmethod
    def tap(f: Callable[[Any, Any], None]) -> FoldOption:
        return FoldOption(lambda s, a: (f(s, a), s)[1])

    def expand(self, other: Callable[[Any], Any]) -> FoldOption:
        return FoldOption(lambda s, a: other(self.run(s, a)))


@dataclass
class Extras:
    """What an enhanced fold may ask of its key."""

    asked: bool = False

    def persist_now(self) -> None:
        self.asked = True


@dataclass(frozen=True)
class EnhancedFold:
    """(extras, state or None, input) -> state or None."""

    run: Callable[[Extras, Any, Any], Any]

    @staticmethod
    def of(fold: Fold) -> EnhancedFold:
        return EnhancedFold(lambda x, s, a: fold.run(s, a))

    @staticmethod
    def empty() -> EnhancedFold:
        return EnhancedFold(lambda x, s, a: None)

    def then(self, other: EnhancedFold) -> EnhancedFold:
        def run(x: Extras, s: Any, a: Any) -> Any:
            first = self.run(x, s, a)
            return None if first is None else other.run(x, first, a)

        return EnhancedFold(run)

    def filter(self, cond: Callable[[Any, Any], bool]) -> EnhancedFold:
        return EnhancedFold(lambda x, s, a: self.run(x, s, a) if s is None or cond(s, a) else s)

    def handle_error(self, f: Callable[[Any, Any, Exception], Any]) -> EnhancedFold:
        def run(x: Extras, s: Any, a: Any) -> Any:
            try:
                return self.run(x, s, a)
            except Exception as e:  # noqa: BLE001
                return None if s is None else f(s, a, e)

        return EnhancedFold(run)


@dataclass(frozen=True)
class Tick:
    """state -> state, when a timer fires."""

    run: Callable[[Any], Any]

    @staticmethod
    def unchanged() -> Tick:
        return Tick(lambda s: s)

    def to_fold(self) -> Fold:
        return Fold(lambda s, a: self.run(s))

    def optional(self) -> Tick:
        """Runs only where a state is there."""
        return Tick(lambda s: None if s is None else self.run(s))


def newer(fold: FoldOption, version: Callable[[Any], int], offset: Callable[[Any], int]) -> FoldOption:
    """Skip records at or before the version that the state has."""
    return fold.filter(lambda s, a: offset(a) > version(s))


def newer_sequence(fold: FoldOption, seq: Callable[[Any], int], first: Callable[[Any], int | None]) -> FoldOption:
    def cond(s: Any, a: Any) -> bool:
        start = first(a)
        return start is not None and start > seq(s)

    return fold.filter(cond)


@dataclass
class KeyMemory:
    """Buffers and marks of one key: what a flush would write, and the offset that it holds back."""

    state: Any = None
    journal: list = field(default_factory=list)
    snapshot: Any = None
    dirty: bool = False
    ever_persisted: bool = False
    hold: int | None = None
    last_persist: float | None = None

    def remember(self, snapshot: Any) -> None:
        """An equal snapshot is not written again."""
        self.dirty = self.dirty or snapshot != self.snapshot
        self.snapshot = snapshot

    def recovered(self, state: Any) -> None:
        """A state that was read is not written back before it changes."""
        self.state = self.snapshot = state
        self.dirty, self.ever_persisted = False, state is not None

    def flush(self, write: Callable[[dict[str, Any]], None] | None = None) -> dict[str, Any]:
        """What is to be written: the key the first time, the journal, and the snapshot if it changed. If ``write`` fails, nothing is forgotten."""
        out = {"key": not self.ever_persisted, "journal": list(self.journal), "snapshot": self.snapshot if self.dirty else None}
        if write:
            write(out)
        self.journal, self.dirty, self.ever_persisted = [], False, True
        return out

    def delete(self) -> bool:
        """Whether storage must be told: only if anything was ever written or read."""
        told, self.ever_persisted = self.ever_persisted, False
        self.state = self.snapshot = self.hold = None
        self.journal, self.dirty = [], False
        return told


def fold_batch(memory: KeyMemory, fold: EnhancedFold, records: Iterable, offset: Callable[[Any], int], persist: Callable[[KeyMemory, Any], None] | None = None) -> bool:
    """Fold one key's records of a batch. Every record is journalled; the key is deleted only if the state after the last one is None. Whether it lives."""
    for r in records:
        extras = Extras()
        if memory.hold is None:
            memory.hold = offset(r)
        state = fold.run(extras, memory.state, r)
        memory.state = state
        memory.journal.append(r)
        if state is not None:
            memory.remember(state)
            if extras.asked and persist:
                persist(memory, r)
    if memory.state is None:
        memory.delete()
        return False
    return True


def tick_batch(memory: KeyMemory, tick: Tick) -> bool:
    """Run a tick; a None state deletes the key. Whether it lives."""
    memory.state = tick.run(memory.state)
    if memory.state is None:
        memory.delete()
        return False
    memory.remember(memory.state)
    return True


def additional_persist(cooldown: float, now: Callable[[Any], float], write: Callable[[Any, Any], None], offset: Callable[[Any], int]) -> Callable[[KeyMemory, Any], None]:
    """Persist on request, at most once per cooldown (strictly longer ago); requests within it are dropped, and a success holds the next offset."""

    def persist(memory: KeyMemory, record: Any) -> None:
        if memory.last_persist is None or now(record) - memory.last_persist > cooldown:
            memory.flush(lambda out: write(out, record))
            memory.last_persist, memory.hold = now(record), offset(record) + 1

    return persist
