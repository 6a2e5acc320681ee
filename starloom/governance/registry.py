"""Contracts as things with versions: what a dataset promises, who may rely on it, and how fresh it has to be."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ContractError
from ..operators import contracts

#: Where a contract holds: on what comes in, on what is kept, on what goes out.
SOURCE, STATE, OUTPUT = "source", "state", "output"


@dataclass(frozen=True, order=True)
class Version:
    major: int = 1
    minor: int = 0
    patch: int = 0

    @classmethod
    def parse(cls, text: str) -> Version:
        m = re.fullmatch(r"v?(\d+)\.(\d+)\.(\d+)", text)
        if not m:
            raise ContractError(f"no version: {text!r}")
        return cls(*map(int, m.groups()))

    def after(self, change: contracts.Evolution) -> Version:
        """The next version that a schema change asks for."""
        if change.breaking:
            return Version(self.major + 1)
        if change.additive or change.safe:
            return Version(self.major, self.minor + 1)
        return Version(self.major, self.minor, self.patch + 1)

    def serves(self, asked: Version) -> bool:
        """Whether who relies on ``asked`` can read this one."""
        return self.major == asked.major and self >= asked

    def __str__(self) -> str:
        return f"{self.major}.{self.minor}.{self.patch}"


@dataclass(frozen=True)
class SLA:
    """Hours that the newest row may be old, share of batches that must pass, and hours until someone answers."""

    fresh_hours: float | None = None
    time_column: str = "loaded_at"
    pass_rate: float = 1.0
    answer_hours: float = 24.0

    def rules(self, as_of: str) -> list[contracts.Rule]:
        return [] if self.fresh_hours is None else [contracts.freshness(self.time_column, self.fresh_hours, as_of)]

    def met(self, passed: int, batches: int) -> bool:
        return batches == 0 or passed >= self.pass_rate * batches


@dataclass(frozen=True)
class DataContract:
    name: str
    schema: T.StructType
    rules: tuple[contracts.Rule, ...] = ()
    version: Version = Version()
    stage: str = OUTPUT
    owner: str = ""
    sla: SLA = SLA()

    def evolved(self, schema: T.StructType) -> tuple[DataContract, contracts.Evolution]:
        change = contracts.evolution(self.schema, schema)
        return replace(self, schema=schema, version=self.version.after(change)), change

    def check(self, df: DataFrame, as_of: str | None = None) -> Report:
        """All rules, the schema and freshness in one report."""
        asked = [contracts.column_exists(f.name) for f in self.schema] + [contracts.type_match(f.name, f.dataType.simpleString()) for f in self.schema if f.name in df.columns]
        found = contracts.report(df, [*asked, *self.rules, *(self.sla.rules(as_of) if as_of else [])]).collect()  # a row a rule
        return Report(self.name, str(self.version), [r.asDict() for r in found])


@dataclass
class Report:
    contract: str
    version: str
    violations: list[dict] = field(default_factory=list)

    @property
    def has_errors(self) -> bool:
        return any(v["severity"] == contracts.ERROR for v in self.violations)

    @property
    def has_warnings(self) -> bool:
        return any(v["severity"] == contracts.WARNING for v in self.violations)

    def summary(self) -> str:
        if not self.violations:
            return f"{self.contract} {self.version}: met"
        return f"{self.contract} {self.version}: " + "; ".join(f"{v['rule']} ({v['detail']}): {v['violations']}" for v in self.violations)

    def to_dict(self) -> dict:
        return {"contract": self.contract, "version": self.version, "has_errors": self.has_errors, "violations": self.violations}


class Registry:
    """All versions of all contracts."""

    def __init__(self):
        self._contracts: dict[str, list[DataContract]] = {}

    def register(self, c: DataContract) -> DataContract:
        """Add a contract; a breaking change needs a new major version."""
        known = self._contracts.setdefault(c.name, [])
        if known:
            last = known[-1]
            if c.version <= last.version:
                raise ContractError(f"{c.name} {c.version} isn't after {last.version}")
            if contracts.evolution(last.schema, c.schema).breaking and c.version.major == last.version.major:
                raise ContractError(f"{c.name} {c.version} breaks {last.version} without a new major version")
        known.append(c)
        return c

    def get(self, name: str, version: str | None = None) -> DataContract:
        """The newest contract, or the newest that serves a version."""
        found = self._contracts.get(name, [])
        if version is not None:
            found = [c for c in found if c.version.serves(Version.parse(version))]
        if not found:
            raise ContractError(f"no contract {name}" + (f" that serves {version}" if version else ""))
        return found[-1]

    def names(self) -> list[str]:
        return sorted(self._contracts)


def gated(df: DataFrame, contract: DataContract, emit=None, as_of: str | None = None) -> DataFrame:
    """The frame, if the contract is met; the outcome goes to ``emit(kind, details)`` either way."""
    report = contract.check(df, as_of)
    if emit:
        emit("failed" if report.has_errors else "passed", report.to_dict())
    if report.has_errors:
        raise ContractError(report.summary())
    return df


def split(df: DataFrame, contract: DataContract, conditions: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(rows that pass, rows that don't with ``reasons``) by named SQL conditions on single rows."""
    failed = F.filter(F.array(*(F.when(~F.coalesce(F.expr(c), F.lit(False)), F.lit(n)) for n, c in conditions.items())), lambda x: x.isNotNull())
    told = df.withColumn("reasons", failed)
    return told.filter(F.size("reasons") == 0).drop("reasons"), told.filter(F.size("reasons") > 0)
