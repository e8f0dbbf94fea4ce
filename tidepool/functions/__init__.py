"""Column functions: null-safe numbers, texts, bits, vectors, addresses and intervals."""

from .intervals import ActionRange, two_level_action
from .values import (
    clean_text,
    dot,
    flag,
    hamming,
    hex_halves,
    number,
    orientation_of,
    sorted_unique,
    tag_problems,
    vector_norm,
)

__all__ = [
    "ActionRange", "clean_text", "dot", "flag", "hamming", "hex_halves", "number", "orientation_of", "sorted_unique", "tag_problems", "two_level_action",
    "vector_norm",
]
