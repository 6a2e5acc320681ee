"""What to ask next: by the entropy of signatures, by annotations of columns, and by the trail so far."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

#: Entropy, as a share of its greatest value, above which paths are too mixed to name one of them.
MIXED = 0.5


@dataclass(frozen=True)
class Column:
    """What is declared about a column."""

    table: str
    name: str
    additive: bool | None = None
    role: str | None = None
    hierarchy: tuple[str, ...] = ()
    temporal: bool = False
    grain: str | None = None
    derived_from: tuple[str, ...] = ()


@dataclass(frozen=True)
class Suggestion:
    kind: str
    subject: str
    text: str
    score: float = 1.0


@dataclass
class Trail:
    """Steps of a session: (operation, subject)."""

    steps: list[tuple[str, str]] = field(default_factory=list)

    def add(self, operation: str, subject: str) -> Trail:
        self.steps.append((operation, subject))
        return self


def entropy_share(counts: list[int]) -> float:
    """Entropy of counts as a share of the greatest possible one; 0 for one kind or none."""
    total = sum(counts)
    if total == 0 or len(counts) < 2:
        return 0.0
    return -sum(c / total * math.log2(c / total) for c in counts if c) / math.log2(len(counts))


def stage(counts: list[int]) -> str:
    """explore while paths are of many kinds, else focus on the frequent one."""
    return "explore" if entropy_share(counts) > MIXED else "focus"


def by_annotations(columns: list[Column]) -> list[Suggestion]:
    out = []
    for c in columns:
        subject = f"{c.table}.{c.name}"
        if c.additive is True:
            out.append(Suggestion("sum", subject, f"sum {subject} by any dimension"))
        if c.additive is False:
            out.append(Suggestion("average", subject, f"average {subject}; sums of it mean nothing"))
        if c.hierarchy:
            out += [Suggestion("roll up", subject, f"{a} to {b}", 0.8) for a, b in zip(c.hierarchy, c.hierarchy[1:], strict=False)]
        if c.temporal:
            out += [Suggestion("trend", subject, f"by {unit} of {subject}", s) for unit, s in (("month", 0.9), ("quarter", 0.7), ("year", 0.6))]
        if c.role:
            out.append(Suggestion("role", subject, f"as {c.role}", 0.7))
        out += [Suggestion("lineage", subject, f"from {d}", 0.5) for d in c.derived_from]
    return sorted(out, key=lambda s: (-s.score, s.subject, s.kind, s.text))


def by_trail(trail: Trail, columns: list[Column]) -> list[Suggestion]:
    """Follow-ups of the last step; what has been done already isn't suggested."""
    if not trail.steps:
        return []
    operation, subject = trail.steps[-1]
    follow = {
        "filter": [("group", "see how the filtered rows are spread")],
        "group": [("having", "keep the groups that matter"), ("rank", "order the groups"), ("roll up", "the next level")],
        "aggregate": [("rank", "order the groups"), ("trend", "by time")],
        "rank": [("drill down", "into the first ones")],
        "trend": [("compare", "with the period before")],
        "join": [("filter", "on the joined table"), ("group", "by its columns")],
        "path": [("signature", "which label sequences there are"), ("trim", "to what both ends reach")],
    }.get(operation, [])
    done = set(trail.steps)
    out = [Suggestion(k, subject, why, 1 - i / 10) for i, (k, why) in enumerate(follow) if (k, subject) not in done]
    seen = {s for _, s in trail.steps}
    grains = {c.grain for c in columns if f"{c.table}.{c.name}" in seen and c.grain}
    if len(grains) > 1:
        out.insert(0, Suggestion("grain", subject, "facts of different grains: aggregate them first", 1.5))
    return out


def suggest(columns: list[Column], trail: Trail, counts: list[int] | None = None, most: int = 10) -> list[Suggestion]:
    """Both kinds, the best first; while the paths are mixed, annotations come before the trail."""
    a, t = by_annotations(columns), by_trail(trail, columns)
    both = [*a, *t] if counts is not None and stage(counts) == "explore" else [*t, *a]
    return list(dict.fromkeys(both))[:most]
