"""Errors: all are ``ValueError`` too, with a stable code."""

from __future__ import annotations


class GlyphError(ValueError):
    code = "other"


class InvalidArgumentError(GlyphError):
    code = "invalid_argument"


class ResourceLimitError(GlyphError):
    code = "resource_limit"


class UnsupportedError(GlyphError):
    code = "unsupported"
