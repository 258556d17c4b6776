"""Finds the relations that query text names, on tokens: never inside strings, function calls or names of other things."""

from __future__ import annotations

from collections.abc import Callable

from tessera.dialect.rewrite import DialectError, Token

#: Words that cannot be the alias of a relation (fixed values of the dialect).
RESERVED = set(
    "where group order having limit offset join inner left right full cross natural on using union intersect except tablesample semi anti window lateral "
    "fetch when then set values returning pivot unpivot".split()
)
#: Words after which a comma no longer parts relations.
CLAUSES = set("where group order having limit offset on using union intersect except window select set".split())
#: Functions whose arguments have a FROM of their own.
WITH_FROM = {"extract", "trim", "substring", "substr", "overlay", "position"}
#: Functions that make rows and read nothing.
MAKERS = {"range", "explode", "explode_outer", "posexplode", "inline", "stack"}


def plain(name: str) -> str:
    return name[1:-1] if name[:1] in '`"' else name.lower()


def relations(toks: list[Token], resolve: Callable[[str], str], scope: frozenset[str] = frozenset()) -> list[Token]:
    """Tokens with every named relation replaced by a relation token with the text that resolve gives for its name.

    Names of WITH clauses stay. What resolve does not know it refuses, so no query reads what the session does not show.
    """
    words = [t.text.lower() if t.kind == "name" else "" for t in toks]
    own = {plain(toks[i].text) for i in range(len(toks) - 2) if toks[i].kind == "name" and words[i + 1] == "as" and toks[i + 2].text == "(" and words[i] not in ("as",)} if "with" in words else set()
    scope = scope | own
    out: list[Token] = []
    frames: list[dict] = [{"from": False, "call": False}]
    expect = False
    i = 0
    while i < len(toks):
        t, word = toks[i], words[i]
        top = frames[-1]
        if t.text == "(":
            before = words[i - 1] if i else ""
            frames.append({"from": expect, "call": before in WITH_FROM})
            # "FROM (a JOIN b)" holds relations, "FROM (SELECT" a query of its own
            expect = expect and (i + 1 < len(toks) and words[i + 1] not in ("select", "with", "values"))
        elif t.text == ")":
            if len(frames) > 1:
                frames.pop()
            expect = False
        elif word == "from" and not top["call"] and not (i and words[i - 1] == "distinct" and i > 1 and words[i - 2] in ("is", "not")):
            expect = top["from"] = True
        elif word == "join":
            expect = True
        elif t.text == "," and top["from"]:
            expect = True
        elif word == "table" and not expect and (not out or out[-1].text in ("(",) or out[-1].kind == "name" and out[-1].text.lower() in ("union", "all", "except", "intersect")):
            raise DialectError("TABLE is not a query here")
        elif word in CLAUSES:
            top["from"] = expect = False
        elif word in ("lateral", "only") and expect:
            pass
        elif expect and t.kind == "name":
            chain = [plain(t.text)]
            j = i + 1
            while j + 1 < len(toks) and toks[j].text == "." and toks[j + 1].kind == "name":
                chain.append(plain(toks[j + 1].text))
                j += 2
            following = toks[j] if j < len(toks) else Token("end", "")
            expect = False
            if following.text == "(":
                if chain[-1] not in MAKERS:
                    raise DialectError(f"{'.'.join(chain)} is no relation")
            elif not (len(chain) == 1 and chain[0] in scope):
                text = resolve(".".join(chain))
                named = following.kind == "name" and following.text.lower() not in RESERVED
                alias = "" if named else f" AS `{chain[-1]}`"
                out.append(Token("relation", text + alias))
                i = j
                continue
        elif expect and t.kind == "string":
            raise DialectError("text is no relation")
        out.append(t)
        i += 1
    return out
