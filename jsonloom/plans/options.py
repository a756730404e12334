"""Parse options and limits."""

from __future__ import annotations

from dataclasses import dataclass

#: Default nesting limit, largest input in bytes, largest child count of a tape word.
MAX_DEPTH, MAX_BYTES, MAX_COUNT = 1024, 2**32 - 1 - 64, 0xFFFFFF


@dataclass(frozen=True)
class ParseOptions:
    """``error_policy`` "stage" reports the first error of the first failing stage, "earliest" the least offset within the first failing phase."""

    max_depth: int = MAX_DEPTH
    max_input_bytes: int = MAX_BYTES
    error_policy: str = "stage"

    def __post_init__(self) -> None:
        if self.error_policy not in ("stage", "earliest"):
            raise ValueError(f"unknown error policy {self.error_policy!r}")
