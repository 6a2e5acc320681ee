"""Changes between what is declared of a table and what is there, and the steps that lead from one to the other."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DestructiveMigrationError, MigrationError
from ..operators import scd
from ..sources.table import VersionedTable

AUDIT = {"checksum": "string", "is_current": "boolean", "valid_from": "timestamp_ntz", "valid_to": "timestamp_ntz"}


@dataclass(frozen=True)
class Model:
    """A declared table: columns with types, natural key, and the type of its history (0: none, 1 or 2)."""

    name: str
    columns: dict[str, str]
    key: tuple[str, ...] = ()
    scd: int = 0
    defaults: dict = field(default_factory=dict)

    def all_columns(self) -> dict[str, str]:
        return self.columns | (AUDIT if self.scd == 2 else {})


@dataclass(frozen=True)
class Step:
    """kind: create, add, drop, type, key, version (history begins) or flatten (it ends)."""

    kind: str
    table: str
    column: str = ""
    detail: str = ""

    @property
    def destructive(self) -> bool:
        return self.kind in ("drop", "flatten") or self.kind == "type" and self.detail.endswith("narrower")


_ORDER = ("tinyint", "smallint", "int", "bigint", "float", "double")


def difference(model: Model, found: T.StructType | None, key: tuple[str, ...] | None = None) -> list[Step]:
    """Steps from a table's schema (None: there is no table) and key to the model."""
    if found is None:
        return [Step("create", model.name)]
    have = {f.name: f.dataType.simpleString() for f in found}
    out, versioned = [], "valid_to" in have and "is_current" in have
    if model.scd == 2 and not versioned:
        out.append(Step("version", model.name))
    if model.scd != 2 and versioned:
        out.append(Step("flatten", model.name, detail="history goes"))
    for c, kind in model.columns.items():
        if c not in have:
            out.append(Step("add", model.name, c, kind))
        elif have[c] != kind:
            narrow = have[c] not in _ORDER or kind not in _ORDER or _ORDER.index(kind) < _ORDER.index(have[c])
            out.append(Step("type", model.name, c, f"{have[c]} to {kind}, {'narrower' if narrow and kind != 'string' else 'wider'}"))
    out += [Step("drop", model.name, c) for c in have if c not in model.columns and c not in AUDIT]
    if key is not None and tuple(key) != tuple(model.key):
        out.append(Step("key", model.name, detail=f"{', '.join(key)} to {', '.join(model.key)}"))
    return out


def guard(steps: list[Step], allow_destructive: bool = False) -> list[Step]:
    bad = [s for s in steps if s.destructive]
    if bad and not allow_destructive:
        raise DestructiveMigrationError("; ".join(f"{s.kind} {s.table}.{s.column} {s.detail}".strip() for s in bad))
    return steps


def applied(df: DataFrame, model: Model, steps: list[Step], as_of: str) -> DataFrame:
    """The rows after the steps.  A new key must tell the rows apart (the current ones, with a history)."""
    for s in sorted(steps, key=lambda s: s.kind == "version"):  # a history begins with the new columns
        if s.kind == "add":
            df = df.withColumn(s.column, F.lit(model.defaults.get(s.column)).cast(model.columns[s.column]))
        elif s.kind == "drop":
            df = df.drop(s.column)
        elif s.kind == "type":
            df = df.withColumn(s.column, F.expr(f"try_cast(`{s.column}` as {model.columns[s.column]})"))
        elif s.kind == "flatten":
            df = scd.history_dropped(df)
        elif s.kind == "version":
            df = scd.initialised(df, as_of).withColumn("checksum", scd.row_hash([c for c in model.columns if c not in model.key]))
        elif s.kind == "key":
            now = df.filter("is_current") if "is_current" in df.columns else df
            if not now.groupBy(*model.key).count().filter("count > 1").isEmpty():
                raise MigrationError(f"{', '.join(model.key)} doesn't tell the rows of {model.name} apart")
    return df.select(*model.all_columns())


def migrate(table: VersionedTable, model: Model, as_of: str, key: tuple[str, ...] | None = None, allow_destructive: bool = False) -> list[Step]:
    """Bring a table to its model in one version; returns the steps."""
    found = T.StructType.fromJson(table.details()["schema"]) if table.versions() else None
    steps = guard(difference(model, found, key), allow_destructive)
    if found is None:
        schema = ", ".join(f"`{c}` {k}" for c, k in model.all_columns().items())
        table.overwrite(table.spark.createDataFrame([], schema))
    elif steps:
        table.overwrite(applied(table.read(), model, steps, as_of))
    return steps


def script(model: Model, steps: list[Step]) -> str:
    """The steps as SQL statements, for engines whose tables change in place; destructive ones are marked."""
    out = []
    for s in steps:
        text = {
            "create": f"CREATE TABLE {s.table} ({', '.join(f'{c} {k}' for c, k in model.all_columns().items())})",
            "add": f"ALTER TABLE {s.table} ADD COLUMN {s.column} {s.detail}",
            "drop": f"ALTER TABLE {s.table} DROP COLUMN {s.column}",
            "type": f"ALTER TABLE {s.table} ALTER COLUMN {s.column} TYPE {model.columns.get(s.column, '')}",
            "version": "; ".join(f"ALTER TABLE {s.table} ADD COLUMN {c} {k}" for c, k in AUDIT.items()),
            "flatten": f"DELETE FROM {s.table} WHERE NOT is_current; " + "; ".join(f"ALTER TABLE {s.table} DROP COLUMN {c}" for c in AUDIT),
            "key": f"-- key of {s.table}: {s.detail}",
        }[s.kind]
        out.append(("-- destructive\n" if s.destructive else "") + text + ("" if text.startswith("--") else ";"))
    return "\n".join(out)
