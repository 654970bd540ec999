"""What the variables of a query stand for."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Binding:
    """A variable: node and edge are struct columns, rels an array of edge structs, path a struct."""

    kind: str  # node, edge, rels, path, value
    column: str
    type: T.DataType
    labels: tuple[str, ...] = ()
    #: property that holds a node's id, where all its labels share it
    id_name: str | None = None

    @property
    def col(self) -> Column:
        return F.col(f"`{self.column}`")

    def field_type(self, name: str) -> T.DataType:
        return self.type[name].dataType


@dataclass
class State:
    """The rows so far and the variables in them. df is None before the first clause.

    joined: the rows come from a join, so computing them twice is worth avoiding.
    """

    df: DataFrame | None = None
    scope: dict[str, Binding] = field(default_factory=dict)
    joined: bool = False

    def copy(self) -> State:
        return State(self.df, dict(self.scope), self.joined)
