"""Running queries over a graph."""

from __future__ import annotations

from dataclasses import dataclass, field
from collections.abc import Callable

from pyspark.sql import DataFrame

from graphloam.cypher.compiler import Compiler
from graphloam.cypher.graph import Graph
from graphloam.cypher.parser import parse
from graphloam.cypher.types import T


@dataclass(frozen=True)
class Procedure:
    """A table-valued function for CALL."""

    least: int
    most: int
    run: Callable[..., DataFrame]
    types: dict[str, T] = field(default_factory=dict)


class GraphSession:
    """Read queries over one graph; other versions by ``AT``."""

    def __init__(self, graph: Graph, *, at: Callable[[str], Graph] | None = None, procedures: dict[str, Procedure] | None = None) -> None:
        self.graph = graph
        self.at = at
        self.procedures = procedures or {}

    def run(self, text: str, params: dict | None = None) -> DataFrame:
        return Compiler(self.graph, params, at=self.at, procedures=self.procedures).run(parse(text))
