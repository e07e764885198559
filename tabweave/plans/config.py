"""The run's configuration: one frozen document that is compiled to a DataFrame plan."""

from __future__ import annotations

import dataclasses
import hashlib
import json
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Config:
    # columns
    columns: tuple[str, ...] | None = None
    exclude: tuple[str, ...] = ()
    column_order: tuple[str, ...] = ()
    column_template: str | None = None
    rename: dict[str, str] = field(default_factory=dict)
    # rows
    filters: tuple[tuple[str, str, str], ...] = ()
    filter_logic: str = "and"
    sort: tuple[tuple[str, bool], ...] = ()
    sort_numeric_aware: bool = True
    case_sensitive: bool = False
    dedupe: bool = True
    dedupe_columns: tuple[str, ...] | None = None
    dedupe_keep: str = "first"
    dedupe_aggregate: str = "none"
    dedupe_separator: str = "; "
    fuzzy_threshold: float | None = None
    fuzzy_block_by: tuple[str, ...] = ()
    # cells
    trim: bool = True
    case: str = "none"
    empty_value: str = ""
    fill_blank: bool = False
    transforms: tuple[tuple, ...] = ()
    redact: bool = False
    redaction_token: str = "[REDACTED]"
    # reshape
    unpivot: tuple[str, ...] = ()
    unpivot_name: str = "variable"
    unpivot_value: str = "value"
    pivot_column: str | None = None
    pivot_value: str | None = None
    pivot_index: tuple[str, ...] | None = None
    pivot_aggregate: str = "first"
    pivot_separator: str = "; "
    # inputs
    delimiter: str | None = None
    encoding: str | None = None
    header_normalize: str = "none"
    schema_mode: str = "union"
    source_column: str | None = None
    source_path: bool = False
    invalid_rows: str = "fail"
    quarantine: str | None = None
    max_file_bytes: int | None = 512 << 20
    max_rows: int | None = 1_000_000
    max_columns: int | None = 16_384
    max_cell_bytes: int | None = 1 << 20
    max_json_nesting: int | None = 32
    max_decompressed_bytes: int | None = 1 << 30
    # contract and repairs
    contract: dict | None = None
    validation_mode: str = "strict"
    repairs: tuple[dict, ...] = ()
    # output
    out_delimiter: str = ","
    out_encoding: str = "utf-8"
    quoting: str = "minimal"
    header: bool = True
    line_ending: str = "\n"
    collision: str = "replace"
    manifest: bool = True

    def document(self) -> dict:
        return dataclasses.asdict(self)

    @classmethod
    def of(cls, document: dict) -> Config:
        """The configuration of a document; unknown fields are an error."""
        known = {f.name: f for f in dataclasses.fields(cls)}
        if extra := set(document) - set(known):
            raise ValueError(f"unknown fields: {', '.join(sorted(extra))}")
        deep = lambda v: tuple(deep(x) for x in v) if isinstance(v, list) else v
        return cls(**{k: v if isinstance(v, dict) else deep(v) for k, v in document.items()})

    def identity(self) -> str:
        return hashlib.sha256(json.dumps(self.document(), sort_keys=True, default=str).encode()).hexdigest()
