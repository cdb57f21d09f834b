"""Tables as typed graphs, at corpus scale, on Spark DataFrames."""

from importlib import import_module
from typing import Any

_HOME = {
    "tabweave.plans.api": (
        "ContextSerializer", "GraphRetriever", "GraphStore", "PerformanceMetrics", "PipelineConfig", "build_graphs", "classify_tables", "documents", "evaluate", "export_graphs",
        "extract_tables", "joined", "langchain_retriever", "latency_stats", "llamaindex_retriever", "monitor", "normalize_tables", "retrieve_context",
    ),
    "tabweave.plans.registry": (
        "DocumentReader", "GraphBuilder", "HeuristicClassifier", "Normalizer", "Registry", "Serializer", "TableClassifier", "TableExtractor", "builders", "classifiers", "extractors",
        "normalizers", "serializers",
    ),
    "tabweave.schema": ("ARCHETYPES", "GraphSet", "TableSet"),
    "tabweave.operators.retrieve": ("Retrieved",),
}
_WHERE = {name: module for module, names in _HOME.items() for name in names}
__all__ = sorted(_WHERE)


def __getattr__(name: str) -> Any:
    """Public names are looked up when they are used, so that executors import only what they need."""
    if name not in _WHERE:
        raise AttributeError(f"module 'tabweave' has no attribute {name!r}")
    return getattr(import_module(_WHERE[name]), name)
