"""Watching: spans and metrics of what runs, records of schema changes and checks, and notices to those concerned."""

from __future__ import annotations

import functools
import json
import time
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import contracts
from ..sources.table import VersionedTable


@dataclass
class Span:
    name: str
    attributes: dict = field(default_factory=dict)
    parent: str | None = None
    id: str = field(default_factory=lambda: uuid.uuid4().hex[:16])
    start: float = field(default_factory=time.time)
    end: float | None = None
    error: str | None = None

    @property
    def seconds(self) -> float:
        return (self.end or time.time()) - self.start


class Collector:
    """Spans and metrics of one process; exporters get spans as they end."""

    def __init__(self, *exporters: Callable[[Span], None]):
        self.spans: list[Span] = []
        self.counters: dict[tuple, float] = defaultdict(float)
        self.gauges: dict[tuple, float] = {}
        self.values: dict[tuple, list[float]] = defaultdict(list)
        self._exporters, self._open = exporters, []

    @contextmanager
    def span(self, name: str, **attributes) -> Iterator[Span]:
        s = Span(name, attributes, self._open[-1].id if self._open else None)
        self._open.append(s)
        try:
            yield s
        except Exception as e:
            s.error = f"{type(e).__name__}: {e}"
            raise
        finally:
            self._open.pop()
            s.end = time.time()
            self.spans.append(s)
            for x in self._exporters:
                x(s)

    def count(self, name: str, by: float = 1, **labels) -> None:
        self.counters[(name, *sorted(labels.items()))] += by

    def gauge(self, name: str, value: float, **labels) -> None:
        self.gauges[(name, *sorted(labels.items()))] = value

    def record(self, name: str, value: float, **labels) -> None:
        self.values[(name, *sorted(labels.items()))].append(value)

    def traced(self, name: str | None = None, **attributes):
        """A decorator: a span for every call, its seconds recorded, failures counted."""

        def wrap(f):
            @functools.wraps(f)
            def run(*a, **k):
                try:
                    with self.span(name or f.__name__, **attributes) as s:
                        return f(*a, **k)
                except Exception:
                    self.count("failures", span=name or f.__name__)
                    raise
                finally:
                    self.record("seconds", s.seconds, span=name or f.__name__)

            return run

        return wrap

    def counted(self, df: DataFrame, name: str) -> DataFrame:
        """The frame with its rows counted as they pass; ``name`` is the observation's, see ``observed``."""
        from pyspark.sql import Observation

        seen = Observation(name)
        self._observations = getattr(self, "_observations", {}) | {name: seen}
        return df.observe(seen, F.count(F.lit(1)).alias("rows"))

    def observed(self, name: str) -> int:
        """Rows that passed ``counted``, once an action on the frame has run."""
        n = self._observations[name].get["rows"]
        self.gauge("rows", n, frame=name)
        return n


def to_json_lines(write: Callable[[str], object]) -> Callable[[Span], None]:
    return lambda s: write(json.dumps(asdict(s) | {"seconds": s.seconds}) + "\n") and None


def to_console(s: Span) -> None:
    print(f"{s.name} {s.seconds:.3f} s" + (f" failed: {s.error}" if s.error else ""))


#: What a schema change is called, how grave it is, and what it asks for: (change_type, tier, requires_migration, requires_backfill).
CHANGE_KINDS = (
    ("added", "safe", False, False),
    ("added_required", "additive", True, True),
    ("widened", "additive", True, False),
    ("narrowed", "breaking", True, True),
    ("type_changed", "breaking", True, True),
    ("not_null", "breaking", True, True),
    ("removed", "breaking", True, False),
)


class Observatory:
    """Dimensions and facts of watched datasets below one folder, as ``plans.observatory`` reports on them."""

    SCHEMAS = {
        "datasets": "dataset_id bigint, dataset_name string, layer string",
        "kinds": "evo_type_id bigint, change_type string, tier string, requires_migration boolean, requires_backfill boolean",
        "rules": "rule_id bigint, rule_name string, severity string",
        "changes": "dataset_id bigint, evo_type_id bigint, column_name string, detected_at timestamp_ntz",
        "checks": "dataset_id bigint, rule_id bigint, violation_count bigint, checked_at timestamp_ntz",
    }

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.tables = {n: VersionedTable(spark, f"{folder.rstrip('/')}/{n}") for n in self.SCHEMAS}
        for n, t in self.tables.items():
            if not t.versions():
                seed = [(i, *k) for i, k in enumerate(CHANGE_KINDS, 1)] if n == "kinds" else []
                t.write(spark.createDataFrame(seed, self.SCHEMAS[n]))

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name].read()

    def _member(self, table: str, sk: str, key: str, value: str, **more) -> int:
        """The surrogate key of a dataset or rule; a new one is added (these are few: a row each)."""
        found = self[table].filter(F.col(key) == value).select(sk).first()
        if found:
            return found[0]
        new = (self[table].agg({sk: "max"}).first()[0] or 0) + 1
        self.tables[table].write(self.spark.createDataFrame([(new, value, *more.values())], self.SCHEMAS[table]))
        return new

    def ingest_evolution(self, dataset: str, layer: str, change: contracts.Evolution, at: str, batch: str | None = None) -> int:
        """Record a schema change; returns the number of facts."""
        kinds = {r.change_type: r.evo_type_id for r in self["kinds"].collect()}
        named = [*change.safe, *((("added_required" if k == "added" else k), c) for k, c in change.additive), *change.breaking]
        of = self._member("datasets", "dataset_id", "dataset_name", dataset, layer=layer)
        rows = [(of, kinds[k], c, at) for k, c in named]
        self._add("changes", rows, batch)
        return len(rows)

    def ingest_quality(self, dataset: str, layer: str, violations: list[dict], at: str, batch: str | None = None) -> int:
        """Record a report's violations (rule, severity, violations); returns the number of facts."""
        of = self._member("datasets", "dataset_id", "dataset_name", dataset, layer=layer)
        rows = [(of, self._member("rules", "rule_id", "rule_name", v["rule"], severity=v["severity"]), v["violations"], at) for v in violations]
        self._add("checks", rows, batch)
        return len(rows)

    def _add(self, table: str, rows: list[tuple], batch: str | None) -> None:
        if rows:
            text = self.SCHEMAS[table].replace("timestamp_ntz", "string")
            when = self.SCHEMAS[table].split(",")[-1].split()[0]
            df = self.spark.createDataFrame(rows, text)
            self.tables[table].write(df.withColumn(when, df[when].cast("timestamp_ntz")), batch)


PRIORITIES = ("P1", "P2", "P3", "P4")


@dataclass(frozen=True)
class Rule:
    """Who hears of which events: ``when`` is a condition on an event (a dict)."""

    name: str
    when: Callable[[dict], bool]
    channels: tuple[str, ...]
    priority: str = "P3"
    escalate_after: float | None = None
    quiet: float = 0.0


@dataclass
class Notice:
    rule: str
    event: dict
    channel: str
    priority: str
    at: float
    answered: bool = False


class Router:
    """Events to channels by rules; what nobody answers in time goes up a priority and out again."""

    def __init__(self, channels: dict[str, Callable[[Notice], None]], rules: list[Rule] | None = None, clock: Callable[[], float] = time.time):
        self.channels, self.rules, self.clock = channels, list(rules or []), clock
        self.sent: list[Notice] = []
        self.failed: list[tuple[Notice, str]] = []
        self._last: dict[tuple, float] = {}

    def _send(self, n: Notice) -> None:
        try:
            self.channels[n.channel](n)
            self.sent.append(n)
        except Exception as e:  # one channel's failure is not the others'
            self.failed.append((n, str(e)))

    def route(self, event: dict) -> list[Notice]:
        """Notices of an event; a rule stays quiet about the same subject for a while if it says so."""
        out, now = [], self.clock()
        for r in self.rules:
            if not r.when(event):
                continue
            same = (r.name, event.get("subject"))
            if now - self._last.get(same, -1e18) < r.quiet:
                continue
            self._last[same] = now
            for c in r.channels:
                out.append(Notice(r.name, event, c, r.priority, now))
                self._send(out[-1])
        return out

    def escalate(self) -> list[Notice]:
        """Unanswered notices whose time is up, one priority higher; P1 is sent again as P1."""
        by_name, now, out = {r.name: r for r in self.rules}, self.clock(), []
        for n in list(self.sent):
            r = by_name.get(n.rule)
            if r and r.escalate_after is not None and not n.answered and now - n.at >= r.escalate_after:
                n.answered = True  # the new notice takes its place
                up = PRIORITIES[max(0, PRIORITIES.index(n.priority) - 1)]
                out.append(Notice(n.rule, n.event, n.channel, up, now))
                self._send(out[-1])
        return out
