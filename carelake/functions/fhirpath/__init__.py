"""Path expressions: parse() to a tree, evaluate() over a document, compiled() to Spark columns."""

from .interp import Context, evaluate
from .parser import parse

__all__ = ["Context", "evaluate", "parse"]
