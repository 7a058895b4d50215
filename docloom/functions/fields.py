"""Key-value fields of lines, and tables of text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.text import is_valid_key, title_case_key

FIELD = "struct<key:string,value:string,confidence:double>"


def _field(line: Column) -> Column:
    """The field of a trimmed line, or null: `Key: value` first, else two or more spaces between key and value."""
    colon = F.instr(line, ":")
    key, value = F.trim(F.substring(line, F.lit(1), colon - 1)), F.trim(F.substring(line, colon + 1, F.length(line)))
    dots = F.length(value) - F.length(F.replace(value, F.lit(".")))
    by_colon = (colon > 0) & is_valid_key(key) & (value != "") & (dots <= 2)
    gap = F.regexp_instr(line, F.lit(" {2,}"))
    left, right = F.trim(F.substring(line, F.lit(1), gap - 1)), F.trim(F.substring(line, gap, F.length(line)))
    words = F.size(F.split(left, r"\s+"))
    aligned = (gap > 1) & is_valid_key(left) & (right != "") & (F.octet_length(right) <= 100) & (words <= 4)

    def made(k: Column, v: Column, c: float) -> Column:
        return F.struct(title_case_key(k).alias("key"), v.alias("value"), F.lit(c).alias("confidence"))

    return F.when(by_colon, made(key, value, 0.9)).when(aligned, made(left, right, 0.75))


def key_values(text: Column) -> Column:
    """array of fields in line order, duplicates kept; none for null."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\r?\n"), lambda s: F.trim(s))
    return F.filter(F.transform(lines, _field), lambda f: f.isNotNull())


def field_value(fields: Column, key: str) -> Column:
    """The value of the first field of that key in either case, or null."""
    return F.get(F.filter(fields, lambda f: F.lower(f["key"]) == key.lower()), F.lit(0))["value"]


TABLE = T.ArrayType(T.StructType([T.StructField("rows", T.ArrayType(T.ArrayType(T.StringType()))), T.StructField("has_header", T.BooleanType()), T.StructField("start_line", T.IntegerType())]))
_GAP = re.compile(r" {2,}")


def split_columns(line: str) -> list[str]:
    """Cells: by pipes (empty cells dropped), else tabs, else runs of two spaces or more."""
    line = line.strip()
    if line.startswith("|"):
        return [c.strip() for c in line.split("|") if c.strip()]
    if "\t" in line:
        return [c.strip() for c in line.split("\t")]
    return [c.strip() for c in _GAP.split(line) if c.strip()]


def is_separator_line(line: str) -> bool:
    line = line.strip()
    return bool(line) and not set(line) - set("-=| :") and sum(line.count(c) for c in "-=") >= 2


def looks_like_header(cells: list[str]) -> bool:
    return all(len(c.encode()) <= 20 and not any("0" <= d <= "9" for d in c) for c in cells)


def find_tables(text: str, min_rows: int = 2) -> list[dict]:
    """Runs of lines with equally many columns, two at least; a separator may stand below the first line."""
    lines = text.splitlines()
    out, i = [], 0
    while i < len(lines):
        first = split_columns(lines[i])
        rows, separated, j = [first], False, i + 1
        if len(first) >= 2 and not is_separator_line(lines[i]):
            if j < len(lines) and is_separator_line(lines[j]):
                separated, j = True, j + 1
            while j < len(lines) and not is_separator_line(lines[j]) and len(cells := split_columns(lines[j])) == len(first):
                rows.append(cells)
                j += 1
            if len(rows) >= min_rows:
                out.append({"rows": rows, "has_header": separated or looks_like_header(first), "start_line": i + 1})
                i = j
                continue
        i += 1
    return out


@F.pandas_udf(TABLE)
def tables(texts):
    """array<struct(rows, has_header, start_line)>; scanning lines depends on the ones before, so it is not an expression."""
    return texts.map(lambda t: find_tables(t or ""))


def column_count(table: Column) -> Column:
    return F.array_max(F.transform(table["rows"], F.size))


def header(table: Column) -> Column:
    """The header's cells, or null."""
    return F.when(table["has_header"], F.get(table["rows"], F.lit(0)))


def data_rows(table: Column) -> Column:
    """The rows below the header."""
    first = F.when(table["has_header"], 2).otherwise(1)
    return F.slice(table["rows"], first, F.size(table["rows"]))


def row_count(table: Column) -> Column:
    return F.size(table["rows"])


def nothing_extracted(provider: str) -> Column:
    """extracted() of a text without tables, fields and entities, with confidence 0."""
    none = F.struct(F.array().cast(TABLE).alias("tables"), F.array().cast(f"array<{FIELD}>").alias("key_values"), F.array().cast("array<struct<entity_type:string,value:string,start:int,end:int>>").alias("entities"))
    return F.struct(none["tables"].alias("tables"), none["key_values"].alias("key_values"), none["entities"].alias("entities"), F.lit(0).alias("field_count"), F.lit(0.0).alias("confidence"), F.lit(provider).alias("provider"))


def extracted(text: Column, with_tables: bool = True, with_fields: bool = True, with_entities: bool = True) -> Column:
    """struct(tables, key_values, entities, field_count, confidence, provider); a part that isn't wanted is empty and not computed."""
    from docloom.functions.entities import entities

    t = tables(text) if with_tables else F.array().cast(TABLE)
    k = key_values(text) if with_fields else F.array().cast(f"array<{FIELD}>")
    e = entities(text) if with_entities else F.array().cast("array<struct<entity_type:string,value:string,start:int,end:int>>")
    return F.struct(t.alias("tables"), k.alias("key_values"), e.alias("entities"), (F.size(k) + F.size(e)).alias("field_count"), F.lit(1.0).alias("confidence"), F.lit("heuristic").alias("provider"))
