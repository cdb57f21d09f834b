"""Named plug-ins: sources, normalizers, classifiers, builders and sinks, and the protocols that they follow."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any, Generic, Protocol, TypeVar, runtime_checkable

from pyspark.sql import DataFrame, SparkSession

from tabweave.operators import build, classify, normalize, sinks
from tabweave.schema import GraphSet, TableSet

T = TypeVar("T")


@runtime_checkable
class TableExtractor(Protocol):
    def can_handle(self, source: Any) -> bool: ...

    def extract(self, spark: SparkSession, source: Any) -> TableSet: ...


@runtime_checkable
class DocumentReader(Protocol):
    def read(self, spark: SparkSession, path: str) -> DataFrame: ...


@runtime_checkable
class TableClassifier(Protocol):
    def classify(self, tables: TableSet) -> DataFrame: ...


@runtime_checkable
class GraphBuilder(Protocol):
    def __call__(self, tables: TableSet) -> tuple[DataFrame, DataFrame]: ...


@runtime_checkable
class Serializer(Protocol):
    def __call__(self, graphs: GraphSet, depth: int | None = None) -> DataFrame: ...


@runtime_checkable
class Normalizer(Protocol):
    def __call__(self, tables: TableSet) -> TableSet: ...


class Registry(Generic[T]):
    """Names for things of one kind."""

    def __init__(self, kind: str) -> None:
        self.kind = kind
        self._known: dict[str, T] = {}

    def register(self, name: str, thing: T) -> T:
        self._known[name] = thing
        return thing

    def decorator(self, name: str) -> Callable[[T], T]:
        return lambda thing: self.register(name, thing)

    def get(self, name: str) -> T:
        if name not in self._known:
            raise KeyError(f"no {self.kind} is called {name!r}; there are {', '.join(self.available()) or 'none'}")
        return self._known[name]

    def has(self, name: str) -> bool:
        return name in self._known

    def available(self) -> list[str]:
        return sorted(self._known)


class HeuristicClassifier:
    """The rule-based classifier; ``rules`` (names and score columns over the features) replace the built-in ones."""

    def __init__(self, rules: dict | None = None) -> None:
        self.rules = rules

    def classify(self, tables: TableSet) -> DataFrame:
        return classify.classify(tables, only=self.rules)


extractors: Registry = Registry("extractor")
normalizers: Registry = Registry("normalizer")
classifiers: Registry = Registry("classifier")
builders: Registry = Registry("builder")
serializers: Registry = Registry("serializer")

for _name in ("whitespace", "whitespace_keep_indent", "merged_cells", "data_types", "multipage_stitch"):
    normalizers.register(_name, getattr(normalize, _name))
classifiers.register("heuristic", HeuristicClassifier)
for _name, _builder in build.BUILDERS.items():
    builders.register(_name, _builder)
for _name in ("markdown", "cypher", "graphml", "json", "summary"):
    serializers.register(_name, lambda gs, depth=None, fmt=_name: sinks.export(gs, fmt, depth))
