"""The dialect's SQL text as Spark SQL: a tokenizer and a rewrite of what differs; Spark parses and plans the rest.

Rewritten are functions with comma forms, LIKE (which ignores case), JSON operators, and $n parameters.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from tessera.functions.scalar import FUNCTIONS

_TOKEN = re.compile(
    r"(?P<space>\s+|--[^\n]*)|(?P<string>'(?:[^']|'')*')|(?P<param>\$\d+)|(?P<number>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)"
    r"|(?P<name>[A-Za-z_][A-Za-z_0-9]*|`[^`]+`|\"[^\"]+\")|(?P<op>->>|->|@>|<@|\?\||\?&|\?|<>|!=|<=|>=|\|\||::|.)",
    re.DOTALL,
)
JSON_OPS = {"->>", "->", "@>", "<@", "?", "?|", "?&"}


@dataclass(frozen=True)
class Token:
    kind: str
    text: str


class DialectError(ValueError):
    """Text that the dialect does not have."""


def tokens(sql: str) -> list[Token]:
    found = [Token(m.lastgroup or "op", m.group()) for m in _TOKEN.finditer(sql)]
    return [t for t in found if t.kind != "space"]


def statements(sql: str) -> list[str]:
    """Statements of a script: cut at semicolons outside strings, comments and BEGIN ... END bodies."""
    out, start, depth, first = [], 0, 0, ""
    for m in _TOKEN.finditer(sql):
        word = m.group().upper()
        if m.lastgroup == "space":
            continue
        first = first or word
        if first == "CREATE" and word == "BEGIN":
            depth += 1
        elif word == "END" and depth:
            depth -= 1
        elif word == ";" and not depth:
            out.append(sql[start : m.start()].strip())
            start, first = m.end(), ""
    return [s for s in [*out, sql[start:].strip()] if s]


def _closing(toks: list[Token], at: int) -> int:
    depth = 0
    for i in range(at, len(toks)):
        if toks[i].text == "(":
            depth += 1
        elif toks[i].text == ")":
            depth -= 1
            if not depth:
                return i
    raise DialectError("a parenthesis is not closed")


def _arguments(toks: list[Token]) -> list[list[Token]]:
    out: list[list[Token]] = [[]]
    depth = 0
    for t in toks:
        depth += (t.text == "(") - (t.text == ")")
        if t.text == "," and not depth:
            out.append([])
        else:
            out[-1].append(t)
    return out if out != [[]] else []


def json_path(key: str) -> str:
    """The path of a key, as a SQL text: a key is a name of its own, dots and all, unless it starts with $."""
    if key.startswith("'$"):
        return key
    if key.isdigit():
        return f"'$[{key}]'"
    if key.startswith("'"):
        return "'$[\\'" + key[1:-1].replace("\\'", "\\\\\\'") + "\\']'"
    return f"concat('$[\\'', {key}, '\\']')"


def _json(op: str, left: str, right: str) -> str:
    path = json_path(right)
    if op == "->>":
        return f"get_json_object({left}, {path})"
    if op == "->":
        return f"to_json(try_variant_get(try_parse_json({left}), {path}, 'variant'))"
    if op == "@>":
        return f"tessera_json_contains({left}, {right})"
    if op == "<@":
        return f"tessera_json_contains({right}, {left})"
    keys = f"json_object_keys({left})"
    if op == "?":
        return f"coalesce(array_contains({keys}, {right}), false)"
    wanted = f"transform(split({right}, ','), k -> trim(k))"
    found = f"arrays_overlap({keys}, {wanted})" if op == "?|" else f"size(array_except({wanted}, {keys})) = 0"
    return f"coalesce({found}, false)"


def rewrite(sql: str) -> str:
    """Spark SQL of one statement. Parameters $1, $2 ... become the named parameters :p1, :p2 ..."""
    return joined(tokens(sql))


def joined(toks: list[Token]) -> str:
    out: list[str] = []
    i = 0
    while i < len(toks):
        t = toks[i]
        following = toks[i + 1].text if i + 1 < len(toks) else ""
        if t.kind == "relation":
            piece = t.text
        elif t.kind == "string":
            piece = "'" + t.text[1:-1].replace("\\", "\\\\").replace("''", "\\'") + "'"
        elif t.kind == "param":
            piece = f":p{t.text[1:]}"
        elif t.kind == "name" and t.text.startswith('"'):
            piece = f"`{t.text[1:-1]}`"
        elif t.kind == "name" and t.text.upper() == "LIKE":
            piece = "ILIKE"
        elif t.kind == "name" and following == "(":
            end = _closing(toks, i + 1)
            inside = toks[i + 2 : end]
            piece = _call(t.text, inside)
            i = end
        elif t.text in JSON_OPS and out:
            right, i = _operand(toks, i + 1)
            left = out.pop()
            while len(out) >= 2 and out[-1] == ".":
                left = out.pop(-2) + out.pop() + left
            piece = _json(t.text, left, right)
            i -= 1
        else:
            piece = t.text
        out.append(piece)
        i += 1
    return re.sub(r"\s*\.\s*(?=[A-Za-z_`*])", ".", " ".join(out))


def _operand(toks: list[Token], at: int) -> tuple[str, int]:
    if at >= len(toks):
        raise DialectError("an operand is missing")
    if toks[at].text == "(":
        end = _closing(toks, at) + 1
    elif at + 1 < len(toks) and toks[at].kind == "name" and toks[at + 1].text == "(":
        end = _closing(toks, at + 1) + 1
    else:
        end = at + 1
        while end + 1 < len(toks) and toks[end].text == "." and toks[end + 1].kind == "name":
            end += 2
    return joined(toks[at:end]), end


def _call(name: str, inside: list[Token]) -> str:
    form = FUNCTIONS.get(name.upper())
    words = {t.text.upper() for t in inside if t.kind == "name"}
    standard = name.upper() == "CAST" and "AS" in words or name.upper() in ("EXTRACT", "TRIM", "SUBSTRING") and "FROM" in words
    if form is None or standard:
        return f"{name}({joined(inside)})"
    arguments = [joined(a) for a in _arguments(inside)]
    try:
        return form(*arguments) if callable(form) else form.format(*arguments)
    except (IndexError, TypeError) as wrong:
        raise DialectError(f"{name} does not take {len(arguments)} arguments") from wrong
