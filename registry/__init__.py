"""Every query with its SQL counterpart, over the sample tables."""

from registry import adhoc, documents, graph, inorder, io, star, text  # noqa: F401
from registry.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
