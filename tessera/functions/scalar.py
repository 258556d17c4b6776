"""Scalar functions of the dialect as Spark SQL: a template of the arguments, or a function of their texts."""

from __future__ import annotations

import re
from collections.abc import Callable


def _substring(s: str, start: str, length: str | None = None) -> str:
    return f"substring({s}, greatest({start}, 1){f', {length}' if length else ''})"


def _date_add(sign: str) -> Callable[..., str]:
    def build(d: str, n: str, unit: str = "DAY") -> str:
        part = unit.strip("'\"").upper().rstrip("S")
        return f"timestampadd({part}, {sign}({n}), {d})" if part != "DAY" or unit != "DAY" else f"date_add({d}, {sign}({n}))"

    return build


def _cast(value: str, kind: str) -> str:
    return f"try_cast({value} AS {TYPES.get(kind.strip().upper(), kind)})"


def _json_object(*pairs: str) -> str:
    return f"to_json(named_struct({', '.join(pairs)}))"


def _typeof(j: str) -> str:
    v = f"try_parse_json({j})"
    kind = f"schema_of_variant({v})"
    return (
        f"CASE WHEN {j} IS NULL THEN NULL WHEN trim({j}) = 'null' THEN 'null' WHEN {v} IS NULL THEN 'invalid'"
        f" WHEN {kind} LIKE 'OBJECT%' THEN 'object' WHEN {kind} LIKE 'ARRAY%' THEN 'array' WHEN {kind} = 'STRING' THEN 'string'"
        f" WHEN {kind} = 'BOOLEAN' THEN 'boolean' ELSE 'number' END"
    )


#: Letters of strftime and of to_char patterns in those of Spark (fixed values).
_PERCENT = {"%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%I": "hh", "%M": "mm", "%S": "ss", "%p": "a", "%j": "DDD", "%b": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE"}
_CHAR = {"YYYY": "yyyy", "YY": "yy", "MM": "MM", "DD": "dd", "HH24": "HH", "HH12": "hh", "HH": "HH", "MI": "mm", "SS": "ss", "MON": "MMM", "MONTH": "MMMM"}


def _pattern(text: str, letters: dict[str, str]) -> str:
    """A pattern literal in Spark's letters; other letters in it are quoted, for Spark would read them as fields."""
    if not text.startswith("'"):
        return text
    found = "|".join(sorted(map(re.escape, letters), key=len, reverse=True))
    return "'" + re.sub(rf"({found})|([A-Za-z]+)", lambda m: letters[m[1]] if m[1] else rf"\'{m[2]}\'", text[1:-1]) + "'"


def _strftime(first: str, second: str) -> str:
    value, text = (first, second) if second.startswith("'%") or not first.startswith("'") else (second, first)
    return f"date_format({value}, {_pattern(text, _PERCENT)})"


def _merged(a: str, b: str) -> str:
    """Objects merged at the top, the right one winning; null unless both are objects. Keys come out sorted."""
    left, right = (f"from_json({x}, 'map<string,variant>')" for x in (a, b))
    whole = f"map_concat(map_filter({left}, (k, v) -> NOT map_contains_key({right}, k)), {right})"
    both = " AND ".join(f"schema_of_variant(try_parse_json({x})) LIKE 'OBJECT%'" for x in (a, b))
    return f"CASE WHEN {both} THEN to_json(parse_json(to_json({whole}))) END"


#: Column types of the dialect in Spark (fixed values).
TYPES = {
    "SMALLINT": "SMALLINT", "TINYINT": "SMALLINT", "INT": "INT", "INTEGER": "INT", "BIGINT": "BIGINT", "SERIAL": "BIGINT",
    "FLOAT": "DOUBLE", "DOUBLE": "DOUBLE", "REAL": "DOUBLE", "DECIMAL": "DECIMAL(38,18)", "NUMERIC": "DECIMAL(38,18)",
    "MONEY": "DECIMAL(19,4)", "BOOLEAN": "BOOLEAN", "BOOL": "BOOLEAN", "TIMESTAMP": "TIMESTAMP", "DATETIME": "TIMESTAMP_NTZ",
    "DATE": "DATE", "TIME": "STRING", "INTERVAL": "STRING", "TEXT": "STRING", "VARCHAR": "STRING", "CHAR": "STRING",
    "CHARACTER": "STRING", "CLOB": "STRING", "NCHAR": "STRING", "NVARCHAR": "STRING", "NTEXT": "STRING", "BLOB": "BINARY",
    "BYTEA": "BINARY", "BINARY": "BINARY", "VARBINARY": "BINARY", "UUID": "STRING", "JSONB": "STRING", "JSON": "STRING",
    "INET": "STRING", "SET": "ARRAY<STRING>", "ZSET": "ARRAY<STRUCT<score: DOUBLE, member: STRING>>",
    "SORTEDSET": "ARRAY<STRUCT<score: DOUBLE, member: STRING>>",
}

FUNCTIONS: dict[str, str | Callable[..., str]] = {
    "RANDOM": "rand()",
    "LOG": lambda x, y=None: f"ln({x})" if y is None else f"log({x}, {y})",
    "STRFTIME": _strftime,
    "TO_CHAR": lambda v, text: f"date_format({v}, {_pattern(text, _CHAR)})",
    "TIME_FORMAT": lambda v, text: f"date_format({v}, {_pattern(text, _PERCENT)})",
    "DATE_FORMAT": lambda v, text: f"date_format({v}, {_pattern(text, _PERCENT) if '%' in text else text})",
    "TO_DATE": lambda v, text=None: f"to_date({v})" if text is None else f"to_date({v}, {_pattern(text, _CHAR)})",
    "TO_TIMESTAMP": lambda v, text=None: f"to_timestamp({v})" if text is None else f"to_timestamp({v}, {_pattern(text, _CHAR)})",
    "LEN": "length({0})",
    "SUBSTRING": _substring,
    "SUBSTR": _substring,
    "TRIM": r"regexp_replace({0}, '^\\s+|\\s+$', '')",
    "LTRIM": r"trim(LEADING ' \t\n\r' FROM {0})",
    "RTRIM": r"trim(TRAILING ' \t\n\r' FROM {0})",
    "CEILING": "ceil({0})",
    "MOD": "mod({0}, nullif({1}, 0))",
    "POW": "power({0}, {1})",
    "SQRT": "CASE WHEN ({0}) >= 0 THEN sqrt({0}) END",
    "NOW": "current_timestamp()",
    "CURRENT_TIMESTAMP": "current_timestamp()",
    "CURRENT_DATE": "current_date()",
    "GETDATE": "current_timestamp()",
    "SYSDATE": "current_timestamp()",
    "LOCALTIME": "current_timestamp()",
    "LOCALTIMESTAMP": "localtimestamp()",
    "GEN_RANDOM_UUID": "uuid()",
    "NEWID": "uuid()",
    "EXTRACT": lambda part, d: f"extract({part} FROM {d})",
    "DATE_ADD": _date_add(""),
    "DATEADD": _date_add(""),
    "DATE_SUB": _date_add("-"),
    "DATEDIFF": "datediff({0}, {1})",
    "ISNULL": "ifnull({0}, {1})",
    "CAST": _cast,
    "CONVERT": _cast,
    "GROUP_CONCAT": lambda c, sep="','": f"listagg(cast({c} AS STRING), {sep}) WITHIN GROUP (ORDER BY {c})",
    "STRING_AGG": lambda c, sep="','": f"listagg(cast({c} AS STRING), {sep}) WITHIN GROUP (ORDER BY {c})",
    "JSON_EXTRACT": "coalesce(to_json(try_variant_get(try_parse_json({0}), {1}, 'variant')), CASE WHEN try_parse_json({0}) IS NOT NULL THEN 'null' END)",
    "JSON_EXTRACT_TEXT": "coalesce(get_json_object({0}, {1}), '')",
    "JSON_ARRAY_LENGTH": "json_array_length({0})",
    "JSON_KEYS": "array_sort(json_object_keys({0}))",
    "JSON_TYPEOF": _typeof,
    "JSON_VALID": "(try_parse_json({0}) IS NOT NULL)",
    "JSON_SET": "tessera_json_set({0}, {1}, cast({2} AS STRING))",
    "JSON_REMOVE": "tessera_json_remove({0}, {1})",
    "JSON_MERGE": _merged,
    "JSON_ARRAY_APPEND": "tessera_json_array_append({0}, cast({1} AS STRING))",
    "JSON_OBJECT": _json_object,
    "JSON_ARRAY": lambda *v: f"to_json(array({', '.join(v)}))",
}
