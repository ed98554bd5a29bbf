"""The seven-verb statement language: parse, validate, compile to DataFrame plans."""

from .parser import MqlError, parse
from .validate import SemanticError, validate

__all__ = ["MqlError", "SemanticError", "parse", "validate"]
