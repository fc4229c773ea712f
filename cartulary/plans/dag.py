"""A graph of named steps, run in an order that its dependencies allow."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from graphlib import CycleError, TopologicalSorter


class DagError(ValueError):
    """Steps that can't be ordered."""


@dataclass(frozen=True)
class Step:
    name: str
    run: Callable[[dict], None]
    needs: tuple[str, ...] = ()


def run_steps(steps: list[Step], context: dict) -> list[str]:
    """Runs every step after those it needs, in order of declaration otherwise; returns the order."""
    named = {s.name: s for s in steps}
    if len(named) < len(steps):
        raise DagError("a step is declared twice")
    for step in steps:
        if missing := [n for n in step.needs if n not in named]:
            raise DagError(f"{step.name} needs unknown steps {missing}")
    try:
        order = list(TopologicalSorter({s.name: s.needs for s in steps}).static_order())
    except CycleError as error:
        raise DagError(f"steps need each other: {error.args[1]}") from error
    for name in order:
        named[name].run(context)
    return order
