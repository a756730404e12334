"""Options and plan choices."""

from .options import ParseOptions

__all__ = ["ParseOptions"]
