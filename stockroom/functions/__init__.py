"""Column functions: every one returns a ``Column`` of built-in expressions."""

from . import dates, numbers, text  # noqa: F401
