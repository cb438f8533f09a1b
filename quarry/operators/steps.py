"""Steps that depend on each other, run in order; and the steps that make a graph useful."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any


class StepError(ValueError):
    pass


@dataclass(frozen=True)
class Step:
    """run takes the context (a dict that steps read and add to) and may return a summary."""

    name: str
    run: Callable[[dict[str, Any]], Any]
    after: tuple[str, ...] = ()


@dataclass
class Runner:
    steps: list[Step] = field(default_factory=list)

    def add(self, step: Step) -> Runner:
        if any(s.name == step.name for s in self.steps):
            raise StepError(f"step {step.name!r} is there already")
        self.steps.append(step)
        return self

    def order(self) -> list[Step]:
        """Every step behind those that it names; of free ones the first added goes first."""
        known = {s.name for s in self.steps}
        for s in self.steps:
            unknown = [a for a in s.after if a not in known]
            if unknown:
                raise StepError(f"step {s.name!r} waits for unknown {', '.join(unknown)}")
        out: list[Step] = []
        left = list(self.steps)
        while left:
            done = {s.name for s in out}
            free = next((s for s in left if done.issuperset(s.after)), None)
            if free is None:
                raise StepError(f"steps wait for each other: {', '.join(sorted(s.name for s in left))}")
            out.append(free)
            left.remove(free)
        return out

    def run(self, context: dict[str, Any], only: Iterable[str] | None = None) -> dict[str, Any]:
        """Summaries by step; with only, the named steps (what they wait for is taken as done)."""
        chosen = None if only is None else set(only)
        return {s.name: s.run(context) for s in self.order() if chosen is None or s.name in chosen}
