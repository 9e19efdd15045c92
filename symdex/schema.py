"""Schemas of the fact tables. Lines are 1-based; a missing text may be null or empty and both mean absent."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_DDL = {
    "files": "id bigint, path string, mtime_ms bigint, content_hash bigint, is_gem boolean",
    "symbols": "id bigint, file_id bigint, name string, kind string, line int, col int, end_line int, return_type string, doc string, parent_name string, visibility string, value_snippet string, type_round int",
    "refs": "file_id bigint, name string, line int, col int, scope_id bigint, arg_count int, receiver_type string",
    "params": "symbol_id bigint, position int, name string, kind string, type_hint string, confidence int, description string",
    "local_vars": "file_id bigint, name string, line int, col int, type_hint string, confidence int, scope_id bigint, class_id bigint, is_block_param boolean, round int, said_confidence int",
    "mixins": "class_id bigint, module_name string, kind string",
    "sem_tokens": "file_id bigint, tokens array<struct<dline:int,dcol:int,len:int,type:int,mods:int>>, prev_tokens array<struct<dline:int,dcol:int,len:int,type:int,mods:int>>",
    "diagnostics": "file_id bigint, line int, col int, message string, severity int, code string",
    "i18n_keys": "file_id bigint, key string, value string, locale string",
    "routes": "file_id bigint, http_method string, path_pattern string, helper_name string, controller string, action string, line int, col int",
    "lines": "file_id bigint, n int, text string",
    "calls": "file_id bigint, name string, line int, col int, receiver string, known string, methods array<string>, block string, symbol_id bigint",
    "meta": "key string, value string",
}
#: What is made from other tables and kept beside them.
_DERIVED = {"reach": "via string, root string, node string, depth int", "trigrams": "gram string, file_id bigint"}
TABLES: dict[str, T.StructType] = {}


def schema(name: str) -> T.StructType:
    if name not in TABLES:
        TABLES[name] = T._parse_datatype_string((_DDL | _DERIVED)[name])
    return TABLES[name]


def names() -> list[str]:
    return list(_DDL)


#: Tables that each derived one is made from.
SOURCES = {"reach": ("symbols", "mixins", "files"), "trigrams": ("lines",)}

#: Unique keys, for insert-or-ignore.
KEYS = {
    "files": ["path"],
    "refs": ["file_id", "name", "line", "col"],
    "params": ["symbol_id", "position"],
    "local_vars": ["file_id", "name", "line", "col"],
    "routes": ["file_id", "http_method", "path_pattern", "line"],
    "sem_tokens": ["file_id"],
    "meta": ["key"],
}


def present(c: str | Column) -> Column:
    """Null for absent, whichever way it is stored."""
    return F.nullif(F.col(c) if isinstance(c, str) else c, F.lit(""))
