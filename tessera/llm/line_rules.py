"""Line-first cleaning: rules judge every line, failing lines go, and documents that lose too much text are rejected."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Characters that the base counts as symbols (fixed values of the contract).
SYMBOLS = "#*$%&|<>"
#: What may end a sentence, with closing marks after it (fixed values).
ENDS = re.compile(r"""[.!?:;…。！？]["'”’»)\]]*$""")
#: Separators of menus and bread crumbs (fixed values).
SEPARATORS = {"|", "»", "«", ">", ">>", "/", "•", "·", "::", "→"}
#: Words of menus, in the languages of the corpus (fixed values).
MENU = {
    "startseite", "suche", "anmelden", "abmelden", "registrieren", "kontakt", "hilfe", "impressum", "weiter", "zurück", "drucken", "teilen",
    "warenkorb", "konto", "menü", "accueil", "recherche", "connexion", "déconnexion", "inscription", "aide", "suivant", "précédent", "retour",
    "partager", "imprimer", "panier", "compte", "inicio", "buscar", "entrar", "salir", "registro", "contacto", "ayuda", "siguiente", "anterior",
    "volver", "compartir", "imprimir", "carrito", "cuenta", "menú",
    "home", "menu", "search", "login", "logout", "register", "about", "contact", "faq", "help", "sitemap", "next",
    "previous", "prev", "back", "top", "share", "print", "subscribe", "newsletter", "account", "cart", "skip", "navigation",
}
#: Phrases of notices that sites repeat, in the languages of the corpus (fixed values).
BOILERPLATE = re.compile(
    r"lorem ipsum|all rights reserved|terms of (?:use|service)|privacy policy|cookie policy|(?:use|uses|accept) cookies"
    r"|enable javascript|javascript is (?:disabled|required)|click here|read more|sign (?:in|up) (?:to|for)"
    r"|copyright (?:\(c\)|©|\d{4})|licensed under|without warranty"
    r"|alle rechte vorbehalten|nutzungsbedingungen|datenschutzerklärung|hier klicken|mehr lesen|tous droits réservés"
    r"|conditions d['’]utilisation|politique de confidentialité|cliquez ici|lire la suite|todos los derechos reservados"
    r"|términos de uso|política de privacidad|haga clic aquí|leer más",
    re.IGNORECASE,
)


@dataclass(frozen=True)
class LineRules:
    """Limits of the rules. Shares are of the line's words."""

    bare_words: int = 12  # a line with fewer words and no sentence mark anywhere is no sentence
    symbol_share: float = 0.2  # symbols per word, from this on
    mark_share: float = 0.3  # words that end in doubled marks such as !!
    separator_share: float = 0.15
    menu_share: float = 0.6
    repeat_share: float = 0.5  # words equal to the word before
    shout_share: float = 0.7  # words in capitals, in lines of shout_words or more
    shout_words: int = 6
    max_loss: float = 0.5  # share of a document's word characters that failing lines may hold

    def verdict(self, line: str, words: list[str]) -> str:
        """The first rule that a line with words fails: punctuation, navigation or boilerplate; '' if it passes."""
        n = len(words)
        if sum(map(line.count, SYMBOLS)) >= max(2, self.symbol_share * n):
            return "navigation" if line.count("|") >= max(2, self.separator_share * n) else "punctuation"
        if n >= 3 and sum(w.endswith(("!!", "??", "!?", "?!")) for w in words) >= self.mark_share * n:
            return "punctuation"
        if sum(w in SEPARATORS for w in words) >= max(2, self.separator_share * n):
            return "navigation"
        marked = ENDS.search(line.rstrip()) is not None
        if not marked and sum(w.strip(".,:;!?").lower() in MENU for w in words) >= max(1, self.menu_share * n):
            return "navigation"
        if n < self.bare_words and not marked and not any(ENDS.search(w) for w in words):
            return "punctuation"
        if BOILERPLATE.search(line):
            return "boilerplate"
        if n >= 8 and sum(a == b for a, b in zip(words, words[1:], strict=False)) >= self.repeat_share * (n - 1):
            return "boilerplate"
        if n >= self.shout_words and sum(w.isupper() and len(w) > 1 for w in words) >= self.shout_share * n:
            return "boilerplate"
        return ""


def split_words(line: str) -> list[str]:
    """Words between the six ASCII white-space characters; str.split() would also split at others."""
    return [w.decode("utf-8", "surrogatepass") for w in line.encode("utf-8", "surrogatepass").split()]


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    joined = b"".join(words)
    chars = len(joined) - sum(joined.count(bytes([x])) for x in range(0x80, 0xC0)) if not joined.isascii() else len(joined)
    symbols = sum(joined.count(s.encode()) for s in SYMBOLS)
    seen: set[bytes] = set()
    again = 0
    for line in raw.split(b"\n"):
        if line.strip(b" \t\n\v\f\r"):
            key = line if len(line) < 64 else hashlib.sha256(line).digest()
            again += key in seen
            seen.add(key)
    ids: dict[bytes, int] = {}
    codes = [ids.setdefault(w, len(ids)) for w in words]
    return n, chars, symbols, again, repeated_words(np.array(codes, np.int64), len(ids))


def repeated_words(codes: np.ndarray, kinds: int) -> int:
    """Words, as numbers under kinds, that lie in a window of three that stands twice or more: a few numbers a word in memory."""
    if len(codes) < 4:
        return 0
    pairs = codes[:-2] * kinds + codes[1:-1]
    if kinds >= 1 << 20:  # pairs are numbered anew, so that windows fit 64 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, place, count = np.unique(pairs * kinds + codes[2:], return_inverse=True, return_counts=True)
    often = count[place] > 1
    marked = np.zeros(len(codes), bool)
    for i in range(3):
        marked[i : len(codes) - 2 + i] |= often
    return int(marked.sum())


def clean(text: str, rules: LineRules) -> tuple[str, dict[str, int], int, int]:
    """Text without failing lines; lines failed by rule; word characters lost, and in all. Empty lines stay."""
    kept: list[str] = []
    failed = {"punctuation": 0, "navigation": 0, "boilerplate": 0}
    seen: set[str] = set()
    lost = total = 0
    for line in text.split("\n"):
        words = split_words(line)
        size = sum(map(len, words))
        total += size
        why = rules.verdict(line, words) if words else ""
        if words and not why and line in seen and len(words) >= 3:
            why = "boilerplate"  # the same line again
        if words:
            seen.add(line)
        if why:
            failed[why] += 1
            lost += size
        else:
            kept.append(line)
    return "\n".join(kept), failed, lost, total


SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        *(T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        T.StructField("base_failed", T.BooleanType()),
        T.StructField("kept", T.BooleanType()),
        *(T.StructField(f"n_{c}", T.LongType()) for c in ("punctuation", "navigation", "boilerplate")),
        T.StructField("lost_chars", T.LongType()),
    ]
)


def line_quality(docs: DataFrame, rules: LineRules | None = None, with_text: bool = False) -> DataFrame:
    """Judge whole documents line by line; one row for each row of the input, no shuffle, one batch in memory.

    Null text counts as empty: no words, so base_failed and not kept. Texts of any length are judged whole. Repeated
    rows give repeated results; doc_id may be null; an empty table gives no rows; other columns are left out. A
    document without failing lines is kept unless the base fails it (under 50 words, or more than half of its words
    in repeated 3-word windows). with_text adds clean_text, the text without its failing lines.
    """
    rules = rules or LineRules()
    schema = T.StructType([*SCHEMA.fields, *([T.StructField("clean_text", T.StringType())] if with_text else [])])
    names = schema.names

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                counts = base_counts(text)
                text_left, failed, lost, total = clean(text, rules)
                bad = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
                kept = not bad and lost <= rules.max_loss * total
                row = (doc_id, *counts, bad, kept, *failed.values(), lost)
                rows.append((*row, text_left) if with_text else row)
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            arrow = [pa.bool_() if f.dataType == T.BooleanType() else pa.string() if f.dataType == T.StringType() else pa.int64() for f in schema]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, arrow, strict=True)], names=names)

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(judge, schema)
