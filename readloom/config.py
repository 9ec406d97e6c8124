"""Settings of extraction, clustering and consensus, checked on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field

MAX_BARCODE = 64
MAX_FLANK = 255


@dataclass(frozen=True)
class Context:
    """A barcode between flanking sequences: ``^`` and ``$`` anchor it, one run of N is the barcode."""

    prefix: str
    length: int
    suffix: str
    starts: bool = False
    ends: bool = False

    @classmethod
    def parse(cls, pattern: str) -> "Context":
        body = pattern.removeprefix("^")
        starts = body != pattern
        stem = body.removesuffix("$")
        ends = stem != body
        upper = stem.upper()
        first, last = upper.find("N"), upper.rfind("N")
        if first < 0:
            raise ValueError("a context pattern needs a run of N for the barcode")
        if set(upper[first : last + 1]) != {"N"}:
            raise ValueError("the N of a context pattern must stand together")
        if last - first + 1 > MAX_BARCODE:
            raise ValueError(f"a barcode has at most {MAX_BARCODE} bases")
        if first > MAX_FLANK or len(stem) - last - 1 > MAX_FLANK:
            raise ValueError(f"a flank has at most {MAX_FLANK} bases")
        return cls(stem[:first], last - first + 1, stem[last + 1 :], starts, ends)


@dataclass(frozen=True)
class Extraction:
    """Where a read holds its barcode: at a fixed place, or in a context, which overrides the place."""

    start: int = 0
    length: int = 15
    context: Context | None = None
    max_context_mismatches: int = 1
    max_indels: int = 1

    def __post_init__(self):
        if self.context is None and not 1 <= self.length <= MAX_BARCODE:
            raise ValueError(f"a barcode has 1 to {MAX_BARCODE} bases")
        if self.start < 0:
            raise ValueError("the barcode cannot start before the read")
        if self.max_indels > 2:
            raise ValueError("at most 2 indels")
        if self.max_context_mismatches < 0:
            raise ValueError("context mismatches cannot be negative")

    @property
    def fixed(self) -> bool:
        return self.context is None


@dataclass(frozen=True)
class Settings:
    """All settings of the pipeline; the defaults are those of its command line."""

    extraction: Extraction = field(default_factory=Extraction)
    max_mismatches: int = 2
    max_n: int = 2
    gap: float = -1.0
    align: bool = True
    max_line: int = 100_000

    def __post_init__(self):
        if not 0 <= self.max_n <= 5:
            raise ValueError("max_n is 0 to 5")
        if self.max_line < 1024:
            raise ValueError("max_line is at least 1024")
        if self.max_mismatches < 0:
            raise ValueError("mismatches cannot be negative")
