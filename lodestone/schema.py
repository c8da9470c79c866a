"""Schemas and fixed vocabularies of the source-facts model."""

from __future__ import annotations

REFERENCE = ("file", "line", "start_col", "end_col", "symbol", "kind")
FACTS = "file string, line bigint, start_col bigint, end_col bigint, symbol string, kind string, symbol_type string"

#: Encoded tables: their columns and the dictionary that each id column points to (None: a plain number).
TABLES: dict[str, dict[str, str | None]] = {
    "Reference": {"file_id": "Symbol", "line": None, "start_col": None, "end_col": None, "symbol_id": "Symbol", "kind_id": "ReferenceType"},
    "ReferenceIndex": {"symbol_id": "Symbol", "kind_id": "ReferenceType", "file_id": "Symbol", "line": None, "start_col": None, "end_col": None},
    "Symbol": {"symbol_id": "Symbol", "type_id": "SymbolType"},
    "SymbolTypeIndex": {"type_id": "SymbolType", "symbol_id": "Symbol"},
    "GlobalSymbol": {"symbol_id": "Symbol"},
}
DICTIONARIES = ("Symbol", "SymbolType", "ReferenceType")

# Reference and symbol kinds of the model.
LOCAL_TYPES = ("LocalVariable", "Parameter")
PATH_TYPE = "Path"
DEFINITION, DECLARATION = "Definition", "Declaration"

TRACE = "cwd string, pidlist array<bigint>, argv array<string>"
