"""Numbers as the texts reports use, as SQL."""

from __future__ import annotations


def percent(share: str) -> str:
    """0.1234 as ``12.3%``."""
    return f"format_string('%.1f%%', {share} * 100D)"


def _trimmed(text: str) -> str:
    """A decimal text without trailing zeros."""
    return f"trim(TRAILING '.' FROM trim(TRAILING '0' FROM {text}))"


def four_digits(value: str) -> str:
    """At most four significant digits, no trailing zeros, exponent from 1e4 and below 1e-4.

    The exponent after rounding decides the form, so that 9999.9 becomes 1e+04.
    """
    scientific = f"format_string('%.3e', {value})"
    exponent = f"CAST(substring_index({scientific}, 'e', -1) AS INT)"
    # Ties go to the even digit.
    large = " ".join(f"WHEN {e} THEN bround({value}, {3 - e})" for e in range(4, 13))
    scientific = f"format_string('%.3e', CASE {exponent} {large} ELSE {value} END)"
    mantissa = _trimmed(f"substring_index({scientific}, 'e', 1)")
    plain = " ".join(
        f"WHEN {e} THEN format_string('%.{3 - e}f', bround({value}, {3 - e}))" for e in range(-4, 4)
    )
    plain = f"CASE {exponent} {plain} END"
    return (
        f"CASE WHEN {value} = 0 THEN '0'"
        f" WHEN {exponent} = 3 THEN {plain}"
        f" WHEN {exponent} BETWEEN -4 AND 2 THEN {_trimmed(plain)}"
        f" WHEN {value} IS NOT NULL"
        f" THEN concat({mantissa}, 'e', substring_index({scientific}, 'e', -1)) END"
    )
