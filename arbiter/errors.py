"""The one error of malformed input."""

from __future__ import annotations


class DataValidationError(ValueError):
    """Input that breaks a declared rule; nothing is repaired silently."""
