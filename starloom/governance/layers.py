"""Layers from raw to meaning, and promotion one step at a time."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..errors import SchemaError
from ..sources.table import VersionedTable
from .registry import DataContract, gated

LAYERS = ("bronze", "silver", "gold", "semantic")


def next_layer(layer: str) -> str | None:
    at = LAYERS.index(layer)
    return LAYERS[at + 1] if at + 1 < len(LAYERS) else None


def may_promote(source: str, target: str) -> bool:
    if source not in LAYERS or target not in LAYERS:
        raise SchemaError(f"layers are {', '.join(LAYERS)}")
    return next_layer(source) == target


@dataclass
class Layered:
    """A folder of tables by layer.  What goes up a layer has to meet the contract that the layer has for it."""

    spark: object
    folder: str
    contracts: dict[tuple[str, str], DataContract] = field(default_factory=dict)

    def table(self, layer: str, name: str) -> VersionedTable:
        if layer not in LAYERS:
            raise SchemaError(f"layers are {', '.join(LAYERS)}")
        return VersionedTable(self.spark, f"{self.folder.rstrip('/')}/{layer}/{name}")

    def promote(self, name: str, source: str, target: str, make=lambda df: df, change: str | None = None, emit=None) -> int:
        """Make a layer's table from the one below by ``make(frame)``."""
        if not may_promote(source, target):
            raise SchemaError(f"{source} doesn't lead to {target} in one step")
        out: DataFrame = make(self.table(source, name).read())
        if (target, name) in self.contracts:
            out = gated(out, self.contracts[target, name], emit)
        return self.table(target, name).overwrite(out, change)
