"""All queries of the library, without those of the llm subpackage."""

from engramite.plans import audit, graph, knowledge, lifecycle, lineage, metrics, mistakes, more, numeric, recall, scans, sequence, versions  # noqa: F401
from engramite.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
