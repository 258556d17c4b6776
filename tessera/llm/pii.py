"""Personal data: base patterns, loose candidates, gradient-boosted trees on format and context, calibrated thresholds."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import spans_text, stage, tagged, unstage, with_matches

#: Base forms (fixed values of the contract). A run of the first part's characters fails from every start if it fails
#: from its first, so a match starts where a run does or where the last match ended (\G); that, and possessive
#: quantifiers where nothing after could need a character back, keep the search linear.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
#: High-recall generators; their spans overlap those of the base and of each other. A number gives characters back, 29 at
#: most, to end on a digit: what follows it in running text is a space or a mark of its own class.
LOOSE = {
    "loose_number": r"(?<![A-Za-z0-9])[+(]?[0-9][0-9().\x20/-]{4,29}[0-9](?![A-Za-z0-9])",
    "loose_email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:@|\(at\)|\[at\]|\{at\})\x20?[A-Za-z0-9-]{1,64}+(?:\x20?(?:\.|\(dot\)|\[dot\]|\{dot\})\x20?[A-Za-z0-9-]{1,64}+){1,8}+",
    "loose_account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
}
_OCTET = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: Words near a span that tell what it is (fixed values, in the four languages of the corpus and as abbreviations).
CONTEXT = {
    "call": r"(?i)\b(?:phone|tel|telephone|call|mobile|cell|fax|telefon|teléfono|téléphone|handy|appel)\b",
    "pay": r"(?i)\b(?:card|visa|mastercard|amex|iban|account|konto|tarjeta|carte|compte|cuenta|bank)\b",
    "net": r"(?i)\b(?:ip|host|server|address|addr|gateway|subnet)\b",
    "mail": r"(?i)\b(?:e-?mail|mail|contact|write|correo|courriel)\b",
    "personal": r"(?i)\b(?:ssn|social|passport|birth|born|dob|id|ausweis|pasaporte)\b",
    "amount": r"(?i)(?:[$€£]|\b(?:usd|eur|page|chapter|isbn|version|vol|no)\b)",
}
#: Forms that numbers take which are no personal data: dates, amounts, versions, book numbers (fixed values).
PLAIN = {
    "date": r"^(?:[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)?[0-9]{2}|(?:19|20)[0-9]{2}[./-][0-9]{1,2}[./-][0-9]{1,2})(?:[\x20].*)?$",
    "year": r"^(?:1[5-9]|20)[0-9]{2}(?:[\x20/-]+(?:(?:1[5-9]|20)[0-9]{2}|[0-9]{2}))?$",
    "thousands": r"^[0-9]{1,3}(?:[.\x20][0-9]{3})+$",
    "book": r"^97[89][\x20-]?[0-9]",
}
FEATURES = (
    "length", "digits", "groups", "dots", "dashes", "spaces", "slashes", "parens", "letters", "plus", "luhn", "at", "spelt_at",
    "spelt_dot", "first_group", "last_group", "longest_group", "context_digits", "capital_after",
    *(f"near_{k}" for k in CONTEXT), *(f"plain_{k}" for k in PLAIN), *(f"is_{k}" for k in LOOSE),
)


def _count(value: Column, symbol: str) -> Column:
    return (F.length(value) - F.length(F.replace(value, F.lit(symbol), F.lit("")))).cast("double")


def _base_passes(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _passing(kind: str) -> Column:
    """The matches of a base kind, without those that fail its check."""
    return F.filter(kind, lambda x: _base_passes(kind, x["value"]))


def _features(c: Column) -> list[Column]:
    """Format and context of a candidate struct<kind, value, before, after>, in the order of FEATURES."""
    value, near = c["value"], F.concat_ws(" ", c["before"], c["after"])
    digits = F.regexp_replace(value, "[^0-9]", "")
    groups = F.filter(F.split(value, "[^0-9A-Za-z]+"), lambda g: g != "")
    last = F.element_at(groups, F.when(F.size(groups) > 0, -1))
    letters = F.length(F.regexp_replace(value, "[^A-Za-z]", ""))
    return [
        F.length(value).cast("double"),
        F.length(digits).cast("double"),
        F.size(groups).cast("double"),
        *(_count(value, symbol) for symbol in ".- /("),
        letters.cast("double"),
        value.startswith("+").cast("double"),
        (F.length(digits).between(12, 19) & (letters == 0) & F.call_function("luhn_check", digits)).cast("double"),
        value.contains("@").cast("double"),
        value.rlike(r"(?i)[({\[]at[)}\]]").cast("double"),
        value.rlike(r"(?i)[({\[]dot[)}\]]").cast("double"),
        F.length(F.get(groups, F.lit(0))).cast("double"),
        F.length(last).cast("double"),
        F.aggregate(groups, F.lit(0), lambda a, g: F.greatest(a, F.length(g))).cast("double"),
        F.length(F.regexp_replace(near, "[^0-9]", "")).cast("double"),
        last.rlike("^[A-Z]").cast("double"),
        *(near.rlike(p).cast("double") for p in CONTEXT.values()),
        *(value.rlike(p).cast("double") for p in PLAIN.values()),
        *((c["kind"] == k).cast("double") for k in LOOSE),
    ]


def scored_candidates(docs: DataFrame, near: int = 32) -> DataFrame:
    """doc_id, n_<base kind>, base spans, and loose: array of kind, start, end, base (meets a base span), x (features).

    Context is read up to the next candidate of the kind, near code points at most.
    """
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("_text"))
    found = with_matches(text, "_text", BASE | LOOSE, {k: near for k in LOOSE})
    for kind in BASE:
        found = found.withColumn(kind, _passing(kind))
    base = F.concat(*(tagged(F.col(k), rank, k) for rank, k in enumerate(BASE)))

    def candidates(kind: str) -> Column:
        def one(x: Column, side: Column) -> Column:
            hit = F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
            fields = (x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), side["before"].alias("before"), side["after"].alias("after"))
            return F.struct(F.lit(kind).alias("kind"), *fields, hit.alias("base"))

        return F.zip_with(kind, f"around_{kind}", one)

    counts = [f"n_{k}" for k in BASE]
    sides = [f"around_{k}" for k in LOOSE]
    found = found.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in BASE), base.alias("base"), *LOOSE, *sides)
    found = found.select("doc_id", *counts, "base", F.concat(*map(candidates, LOOSE)).alias("loose"))
    features = F.transform(
        "loose",
        lambda c: F.struct(
            *(c[k].alias(k) for k in ("kind", "start", "end", "base")), F.array(*(F.coalesce(x, F.lit(0.0)) for x in _features(c))).alias("x")
        ),
    )
    return found.withColumn("loose", features)


# ---- learning rows: made, not taken from the corpus, so that what the base patterns miss can be a positive

#: Shapes by what they are: 9 is a digit, 8 a digit over 0, A a capital, a a letter, W a word; the rest stands as it is (fixed values).
SHAPES = {
    "call": (
        "899-999-9999", "(899) 999-9999", "899 999 9999", "899.999.9999", "0899 9999999", "(0899) 9999999", "0899/9999999", "08 99 99 99 99", "08.99.99.99.99",
        "899 999 999", "899 99 99 99", "+89 899 9999999", "+8 (899) 999-9999", "1-899-999-9999", "0899-99999999", "00 89 899 999999", "089 9999-9999",
    ),
    "personal": ("899-99-9999", "8 99 99 99 999 999 99", "99999999-8", "89/999999/8", "899 999 999"),
    "pay": ("8999.9999.9999.9999", "8999/9999/9999/9999", "8999 - 9999 - 9999 - 9999", "8999  9999  9999  9999", "8999.999999.99999", "AA89 9999 9999 9999 9999 99", "AA89 AAAA 9999 9999 9999 99", "AA89 9999 9999 9999 9999 9999", "AA8999999999999999999999"),
    "mail": (
        "W (at) W (dot) com", "W [at] W [dot] org", "W(at)W.de", "W at@W.es", "W.W (at) W.fr", "W @ W.net", "W@ W . com", "W{at}W{dot}com", "W_W8 [at] W-W.com", "W.W@W (dot) org", "W89 (at) W.com",
    ),
    "none": (
        "1899-1999", "2018/19", "2019-08-12", "08/12/2019", "12.08.1999", "8 999 999", "89.999.999", "8.99999999", "89.9999 8.9999", "978-8-99-999999-8", "978 8999999998",
        "899-899", "8999 9999", "89-899", "1024 768", "89/99/8999", "8.9.99", "2019-08-12 08", "899999", "8999999", "8999 8999 8999", "89 899 8999 89", "8-8-8", "899 9", "8999/999",
        "8999999999999999", "899999999999999999", "8999 9999 9999 9999", "8999.9999.9999.9999", "899999999999", "9 9 9 9 9 9 9", "8-8 8-8 8-8", "89:99 89:99", "A8-9999-99", "AA89 AAAA AAAA AAAA", "AA89 AAAAAAAA", "AA99 A9A9 A9A9", "W @ W. W", "W (at) W. W", "W @ W. A", "W@W. W", "W [at] W. Aaa", "W (at) W . Aaa",
    ),
}
#: Words before a shape, by what it is, in the languages of the corpus; none stands for a shape without a hint (fixed values).
HINTS = {
    "call": ("call", "phone", "tel", "mobile:", "Telefon", "teléfono", "téléphone", "fax", ""),
    "personal": ("ssn", "SSN:", "passport", "id", "Ausweis", "pasaporte", "social security"),
    "pay": ("card", "visa", "IBAN", "Konto", "tarjeta", "carte", "account", ""),
    "mail": ("mail", "contact", "write to", "correo", "courriel", "email:", ""),
    "none": ("in", "page", "version", "chapter", "ISBN", "vol", "no", "USD", "on", "total", "", "", "the", "von", "de"),
}


def made_texts(rows: int, seed: int) -> list[tuple[int, str, int, int]]:
    """(row, text, start, end): a made-up sentence for each row, and where in it personal data stands; -1, -1 where none does."""
    rng = random.Random(seed)
    vowels, others = "aeiou", "bcdfghlmnprstvw"

    def word() -> str:
        return "".join(rng.choice(others) + rng.choice(vowels) for _ in range(rng.randrange(1, 4))) + rng.choice(("", "n", "s", "r"))

    def filled(shape: str) -> str:
        out = []
        for s in shape:
            one = {"9": "0123456789", "8": "123456789", "A": "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}.get(s)
            out.append(word() if s == "W" else rng.choice(one) if one else s)
        return "".join(out)

    def checked(value: str, valid: bool) -> str:
        """Card numbers pass the Luhn sum, other numbers of that length fail it."""
        digits = [int(c) for c in value if c.isdigit()]
        if not 12 <= len(digits) <= 19 or any(c.isalpha() for c in value):
            return value
        total = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed([*digits[:-1], 0])))
        right = -total % 10
        return value[:-1] + str(right if valid else (right + rng.randrange(1, 10)) % 10)

    made = []
    for row in range(rows):
        kind = rng.choice(("call", "personal", "pay", "mail", "none", "none", "none", "none"))
        about = rng.choice(HINTS["none"] if rng.random() < 0.15 else HINTS[kind])
        before = " ".join([*(word() for _ in range(rng.randrange(0, 6))), *([about] if about else [])])
        value = checked(filled(rng.choice(SHAPES[kind])), kind == "pay")
        after = rng.choice(("", ".", ",", " ", ")", ";")) + " " + " ".join(word() for _ in range(rng.randrange(0, 6)))
        start = len(before) + bool(before)
        span = (start, start + len(value)) if kind != "none" else (-1, -1)
        made.append((row, f"{before} {value}{after}" if before else value + after, *span))
    return made


def learning_rows(spark: SparkSession, rows: int, seed: int) -> DataFrame:
    """row, kind, x, y of the candidates in made-up texts: y is 1 where personal data covers half of a candidate or more."""
    made = spark.createDataFrame(made_texts(rows, seed), "doc_id long, text string, _from int, _to int")
    found = scored_candidates(made).join(made.select("doc_id", "_from", "_to"), "doc_id")
    each = found.select("doc_id", "_from", "_to", F.explode("loose").alias("c"))
    covered = F.least("c.end", "_to") - F.greatest("c.start", "_from")
    return each.select(F.col("doc_id").alias("row"), "c.kind", "c.x", (2 * covered >= F.col("c.end") - F.col("c.start")).cast("double").alias("y"))


def tree_column(node, x: Column) -> Column:
    """A fitted decision tree as a CASE expression over an array column of features."""
    if node.getClass().getSimpleName() == "LeafNode":
        return F.lit(float(node.prediction()))
    split = node.split()
    left, right = tree_column(node.leftChild(), x), tree_column(node.rightChild(), x)
    return F.when(F.get(x, F.lit(int(split.featureIndex()))) <= float(split.threshold()), left).otherwise(right)


def fit_trees(rows: DataFrame, rounds: int, depth: int, seed: int):
    """Boosted trees on rows (x array<double>, y double): a function from a feature array to a probability column.

    None if the rows are of one class: nothing can be learnt from those.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    if rows.agg(F.count_distinct("y")).first()[0] < 2:
        return None
    data = rows.select(array_to_vector("x").alias("features"), F.col("y").alias("label"))
    model = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.3, seed=seed, cacheNodeIds=False).fit(data)
    trees = [(w, t._call_java("rootNode")) for w, t in zip(model.treeWeights, model.trees, strict=True)]

    def probability(x: Column) -> Column:
        margin = sum((tree_column(root, x) * w for w, root in trees), F.lit(0.0))
        return 1 / (1 + F.exp(-2 * margin))

    return probability


def calibrate(scored: DataFrame, precision: float, least: int, bins: int = 200) -> dict[str, float]:
    """For each kind the lowest score from which on held-back candidates are positive at the wanted precision.

    scored: kind, score, y. Scores are counted in bins, so that kinds x bins rows reach the driver. Kinds with fewer
    than least held-back positives from there on have no threshold.
    """
    counted = scored.groupBy("kind", F.floor(F.col("score") * bins).cast("int").alias("bin")).agg(
        F.sum("y").alias("positive"), F.count("*").alias("all")
    )
    limits: dict[str, float] = {}
    rows = counted.collect()
    for kind in sorted({r["kind"] for r in rows}):
        positive = everything = 0.0
        for r in sorted((r for r in rows if r["kind"] == kind), key=lambda r: -r["bin"]):
            positive, everything = positive + r["positive"], everything + r["all"]
            # the lower end of a one-sigma interval, so that few held-back rows promise little
            share = positive / everything
            if positive >= least and share - (share * (1 - share) / everything) ** 0.5 >= precision:
                limits[kind] = r["bin"] / bins
    return limits


def fitted(spark: SparkSession, rows: int, rounds: int, depth: int, precision: float, least: int, seed: int):
    """Probability of a feature array as a column, and thresholds by kind: fitted on the even made-up rows, calibrated on the odd."""
    made = stage(learning_rows(spark, rows, seed), "pii-made")
    probability = fit_trees(made.where("row % 2 = 0"), rounds, depth, seed)
    judged = made.where("row % 2 = 1").select("kind", probability(F.col("x")).alias("score"), "y")
    limits = calibrate(judged, precision, least)
    unstage(made)
    return probability, limits


def scan_pii(
    docs: DataFrame,
    made: int = 6000,
    rounds: int = 16,
    depth: int = 5,
    precision: float = 0.97,
    least: int = 30,
    seed: int = 7,
) -> DataFrame:
    """Personal data in every whole text: one row for each row of the input.

    Base spans stay. Loose generators propose further spans that may overlap: numbers of 6 to 31 symbols, addresses with a
    spelt or spaced at, account numbers. Boosted trees tell them from dates, amounts, versions and the like by format and
    context. They are fitted on made texts with known personal data and hard negatives in the languages of the corpus,
    seeded and made in number, not on the corpus: a candidate that no base pattern meets can be a positive there, and
    results do not change with the size of the input. Thresholds by kind are the lowest that hold precision on the half of
    the made texts that the trees have not seen. Every candidate of the corpus is scored, by CASE expressions; those over
    their threshold that meet no base span are added, as kinds loose_number, loose_email and loose_account.

    Candidates are found in one pass and staged; later passes read those, not the texts. Null and empty texts have no
    spans; repeated rows are treated alike; an empty table gives no rows; other columns are left out.
    Returns doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_loose, n_spans.
    """
    found = stage(scored_candidates(docs), "pii")
    probability, limits = fitted(docs.sparkSession, made, rounds, depth, precision, least, seed)
    added = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
    if limits:

        def wanted(c: Column) -> Column:
            limit = F.lit(2.0)
            for kind, value in limits.items():
                limit = F.when(c["kind"] == kind, F.lit(value)).otherwise(limit)
            return ~c["base"] & (probability(c["x"]) >= limit)

        def as_span(c: Column) -> Column:
            rank = F.array_position(F.array(*map(F.lit, LOOSE)), c["kind"]).cast("int") + len(BASE) - 1
            return F.struct(c["start"].alias("start"), rank.alias("rank"), c["kind"].alias("kind"), c["end"].alias("end"))

        added = F.transform(F.filter("loose", wanted), as_span)
    return found.withColumn("_added", added).select(
        "doc_id",
        *(f"n_{k}" for k in BASE),
        F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"),
        spans_text(F.concat("base", "_added")).alias("spans"),
        F.size("_added").cast("long").alias("n_loose"),
        (F.size("base") + F.size("_added")).cast("long").alias("n_spans"),
    )
