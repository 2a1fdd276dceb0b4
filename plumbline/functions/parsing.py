"""Patterns for texts that read as numbers or truth values, and texts that mean "missing"."""

from __future__ import annotations

# What a CSV cell may hold instead of a value.
MISSING_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Forms of numbers and truth values.
INTEGER_TEXT = "^\\s*[+-]?[0-9]+\\s*$"
DOUBLE_TEXT = "^\\s*[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?\\s*$|^\\s*[+-]?(inf|infinity|Inf|Infinity|INF|INFINITY)\\s*$"
TRUE_TEXTS = ["True", "TRUE", "true"]
FALSE_TEXTS = ["False", "FALSE", "false"]
