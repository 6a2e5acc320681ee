"""A pipeline's output as a thing with a state: how it is written, and what a late change makes stale."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..errors import StarloomError

#: state -> states it may go to
MOVES = {"declared": {"building", "retired"}, "building": {"fresh", "failed"}, "fresh": {"stale", "building", "retired"}, "stale": {"building", "retired"}, "failed": {"building", "retired"}, "retired": set()}


@dataclass
class PipelineArtifact:
    """``time`` is the output's time column, ``unit`` the period that is written at once, ``key`` its key if rows are replaced."""

    name: str
    time: str | None = None
    unit: str = "day"
    key: tuple[str, ...] = ()
    append_only: bool = False
    state: str = "declared"
    history: list[tuple[str, str]] = field(default_factory=list)

    def to(self, state: str, why: str = "") -> PipelineArtifact:
        if state not in MOVES[self.state]:
            raise StarloomError(f"{self.name} is {self.state}; it can't become {state}")
        self.history.append((state, why))
        self.state = state
        return self

    def write_mode(self) -> str:
        """append, merge, overwrite_partitions or overwrite."""
        if self.append_only:
            return "append"
        if self.key:
            return "merge"
        return "overwrite_partitions" if self.time else "overwrite"

    def backfill(self, first: str, last: str) -> str:
        """The condition on the output that a change of the input from first to last (excluded) makes stale: whole periods."""
        if not self.time:
            return "TRUE"
        lo = f"date_trunc('{self.unit}', timestamp_ntz'{first}')"
        hi = f"date_trunc('{self.unit}', timestamp_ntz'{last}' - INTERVAL '0.000001' second) + INTERVAL '1' {self.unit}"
        return f"{self.time} >= {lo} AND {self.time} < {hi}"
