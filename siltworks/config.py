"""Options and limits. Limits are off by default; `REFERENCE_LIMITS` has those of a single-node tool."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Limits:
    max_bytes: int | None = None
    max_rows: int | None = None
    max_fuzzy_rows: int | None = None
    max_fuzzy_pairs: int | None = None
    max_pdf_pages: int | None = None


REFERENCE_LIMITS = Limits(50 * 1024 * 1024, 500_000, 50_000, 10_000, 100)

#: Fill strategies; any other text means AUTO.
AUTO, ZERO, UNKNOWN, DROP = "auto", "zero", "unknown", "drop"
#: Targets of date normalisation, by their strftime names.
DATE_TARGETS = {"%Y-%m-%d": "yyyy-MM-dd", "%d/%m/%Y": "dd/MM/yyyy", "%m/%d/%Y": "MM/dd/yyyy", "%d-%m-%Y": "dd-MM-yyyy"}


@dataclass(frozen=True)
class CleanOptions:
    fill: str = AUTO
    fix_encoding: bool = True
    remove_empty_cols: bool = True
    remove_dup_cols: bool = True
    remove_const_cols: bool = False
    snake_case: bool = False
    trim_spaces: bool = True
    remove_empty_rows: bool = True
    normalize_emails: bool = False
    normalize_phones: bool = False
    normalize_dates: bool = False
    date_target: str = "%Y-%m-%d"
    #: Values that no known format takes go to a general parser, in Python workers.
    lenient_dates: bool = False
    email_columns: tuple[str, ...] = field(default_factory=tuple)
    phone_columns: tuple[str, ...] = field(default_factory=tuple)
    date_columns: tuple[str, ...] = field(default_factory=tuple)


class RowLimitExceeded(ValueError):
    def __init__(self, row_count: int, max_rows: int, name: str) -> None:
        self.row_count, self.max_rows, self.name = row_count, max_rows, name
        super().__init__(f"{name}: {row_count:,} rows, more than the limit of {max_rows:,}")
