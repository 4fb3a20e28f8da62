"""The pattern language: parser, trees, automata, pattern sets."""

from .ast import PatternError, PatternSyntaxError, PatternTooComplex, UnsupportedPattern
from .parser import parse
from .registry import PatternSet, try_parse

__all__ = ["PatternError", "PatternSet", "PatternSyntaxError", "PatternTooComplex", "UnsupportedPattern", "parse", "try_parse"]
