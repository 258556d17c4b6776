"""Secret scan: patterns of known forms, and a randomness test battery on other tokens with false-discovery control."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import spans_text, stage, tagged, with_matches

#: Base forms (fixed values of the contract). Look-behinds and possessive quantifiers only spare retries: of a run of
#: hexadecimal digits, and from an AKIA on, the whole rest always matches, so the shorter ones are those that fail.
ASSIGN = r"(?:(?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
BASE = {
    "assign": ASSIGN,
    "access": r"AKIA[A-Z0-9]{16,}+",
    "hex": r"(?<![0-9a-f])[0-9a-f]{24,}+",
}
#: Tokens that the battery tests: runs of symbols of the encodings below.
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}"

_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Letters by how common they are in written text: common, middling, rare (fixed values, for the languages of the corpus).
_COMMON = ("aeinorst", "cdfghlmpu", "bjkqvwxyz")
_CAPITALS = tuple(x.upper() for x in _COMMON)
#: Encodings from narrow to wide: name, pattern, alphabet in order of symbol values, cells whose counts chi-squared compares.
#: The cells cut the alphabet where written text is least even, so that few symbols suffice (fixed values).
ENCODINGS = (
    ("hex", "^[0-9a-f]+$", _DIGITS + "abcdef", ("01234", "56789", "abc", "def")),
    ("hex_upper", "^[0-9A-F]+$", _DIGITS + "ABCDEF", ("01234", "56789", "ABC", "DEF")),
    ("base32", "^[A-Z2-7]+$", _UPPER + "234567", (*_CAPITALS, "234567")),
    ("base36", "^[0-9a-z]+$", _DIGITS + _LOWER, (_DIGITS, *_COMMON)),
    ("base62", "^[0-9A-Za-z]+$", _DIGITS + _UPPER + _LOWER, (_DIGITS, *_CAPITALS, *_COMMON)),
    ("base64", "^[0-9A-Za-z+/]+$", _UPPER + _LOWER + _DIGITS + "+/", (*_CAPITALS, *_COMMON, _DIGITS + "+/")),
    ("base64url", "^[0-9A-Za-z_-]+$", _UPPER + _LOWER + _DIGITS + "-_", (*_CAPITALS, *_COMMON, _DIGITS + "-_")),
)
#: Kinds of symbols between which runs are counted.
_KINDS = (_DIGITS, _UPPER, _LOWER, "+/-_")
#: Log of the combined statistic in identifiers, paths and compounds of n symbols: normal about level + slope * ln(n / 20)
#: with this spread (fixed values, of a reference of 60,000 made of dictionary words in nine forms).
ORDINARY = {"level": 3.35, "slope": 0.85, "spread": 0.3}
#: Upper ends of the length bands in which false discoveries are controlled apart; the last band is open.
BANDS = (24, 32, 48, 80)
BIN = 0.05


def normal_tail(z: Column) -> Column:
    """Chance that a standard normal is z or more, after Abramowitz and Stegun 26.2.17 (fixed coefficients)."""
    x = F.least(F.abs(z), F.lit(30.0))
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.greatest(F.exp(-x * x / 2) / 2.5066282746310002 * poly, F.lit(1e-200))
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _of_encoding(code: Column, values: list) -> Column:
    """The entry of a literal list that belongs to an encoding's place in ENCODINGS, from 1."""
    return F.element_at(F.array(*(F.array(*map(F.lit, v)) if isinstance(v, tuple) else F.lit(v) for v in values)), code)


def _battery(tokens: Column) -> Column:
    """Tests of tokens array<struct<start, end, value>>: struct<start, end, encoding, n, fisher, random, log_p>.

    Three tests against a uniform random string of the token's encoding and length: chi-squared of the counts by cell of
    the alphabet (one-sided, cube-root normal), runs of digits, capitals, small letters and marks (exact mean and variance
    at that length), and lag-1 serial correlation of symbol values. fisher is -2 times the sum of the logs of their p
    values, random its chance for a random string (chi-squared with 6 degrees). log_p is log10 of the chance that ordinary
    text of that length has so small a fisher: short tokens cannot get as far below 0 as long ones.
    Steps are transforms of their own, so that each intermediate array is made once.
    """
    shares = [[len(set(k) & set(e[2])) / len(e[2]) for k in _KINDS] for e in ENCODINGS]
    squares, cubes = ([sum(q**i for q in s) for s in shares] for i in (2, 3))
    named = F.transform(tokens, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.rtrim(t["value"], F.lit("=")).alias("value")))

    def code(value: Column) -> Column:
        out = F.lit(None).cast("int")
        for i, (_, pattern, *_) in reversed(list(enumerate(ENCODINGS, 1))):
            out = F.when(value.rlike(pattern), F.lit(i)).otherwise(out)
        return out

    coded = F.transform(
        F.filter(named, lambda t: ~t["value"].rlike("^[0-9]*$")),
        lambda t: F.struct(*(t[c].alias(c) for c in ("start", "end", "value")), F.length(t["value"]).cast("double").alias("n"), code(t["value"]).alias("code")),
    )
    kinds = "".join(str(i) * len(k) for i, k in enumerate(_KINDS))

    def counted(t: Column) -> Column:
        value, alphabet = t["value"], _of_encoding(t["code"], [e[2] for e in ENCODINGS])
        size = F.length(alphabet).cast("double")
        cells = _of_encoding(t["code"], [e[3] for e in ENCODINGS])

        def part(acc: Column, cell: Column) -> Column:
            expected = t["n"] * F.length(cell) / size
            off = F.length(value) - F.length(F.call_function("translate", value, cell, F.lit(""))) - expected
            return acc + off * off / expected

        return F.struct(
            *(t[c].alias(c) for c in ("start", "end", "n", "code")),
            F.aggregate(cells, F.lit(0.0), part).alias("chi"),
            (F.size(cells) - 1).cast("double").alias("free"),
            (F.length(F.regexp_replace(F.translate(value, "".join(_KINDS), kinds), r"(.)\1*+", "x")) - 1).cast("double").alias("changes"),
            F.transform(F.split(value, ""), lambda c: F.instr(alphabet, c).cast("double")).alias("x"),
        )

    counts = F.transform(F.filter(coded, lambda t: t["code"].isNotNull()), counted)
    keep = ("start", "end", "n", "code", "chi", "free", "changes")
    centred = F.transform(
        counts,
        lambda t: F.struct(*(t[c].alias(c) for c in (*keep, "x")), (F.aggregate(t["x"], F.lit(0.0), lambda a, v: a + v) / t["n"]).alias("mean")),
    )

    def moments(t: Column) -> Column:
        start = F.struct(F.lit(None).cast("double").alias("last"), F.lit(0.0).alias("products"), F.lit(0.0).alias("squares"))

        def step(acc: Column, v: Column) -> Column:
            d = v - t["mean"]
            return F.struct(
                d.alias("last"), (acc["products"] + F.coalesce(acc["last"] * d, F.lit(0.0))).alias("products"), (acc["squares"] + d * d).alias("squares")
            )

        return F.struct(*(t[c].alias(c) for c in keep), F.aggregate(t["x"], start, step).alias("m"))

    def tested(t: Column) -> Column:
        n, free = t["n"], t["free"]
        s2, s3 = (_of_encoding(t["code"], x) for x in (squares, cubes))
        z_chi = (F.pow(t["chi"] / free, 1 / 3) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
        spread = (n - 1) * (s2 - s2 * s2) + 2 * (n - 2) * (s3 - s2 * s2)
        z_runs = (t["changes"] - (n - 1) * (1 - s2)) / F.sqrt(spread)
        z_serial = F.when(t["m"]["squares"] > 0, (t["m"]["products"] / t["m"]["squares"] + 1 / n) * F.sqrt(n)).otherwise(F.lit(30.0))
        logs = F.log(normal_tail(z_chi)) + F.log(2 * normal_tail(F.abs(z_runs))) + F.log(2 * normal_tail(F.abs(z_serial)))
        return F.struct(*(t[c].alias(c) for c in ("start", "end", "n", "code")), F.greatest(-2 * logs, F.lit(0.01)).alias("fisher"))

    def judged(t: Column) -> Column:
        half = t["fisher"] / 2
        ordinary = ORDINARY["level"] + ORDINARY["slope"] * F.log(t["n"] / 20)
        return F.struct(
            t["start"].alias("start"),
            t["end"].alias("end"),
            _of_encoding(t["code"], [e[0] for e in ENCODINGS]).alias("encoding"),
            t["n"].cast("int").alias("n"),
            t["fisher"].alias("fisher"),
            (F.exp(-half) * (1 + half + half * half / 2)).alias("random"),
            F.log10(normal_tail((ordinary - F.log(t["fisher"])) / ORDINARY["spread"])).alias("log_p"),
        )

    return F.transform(F.transform(F.transform(centred, moments), tested), judged)


def _band(n: Column) -> Column:
    out = F.lit(len(BANDS))
    for i, upto in reversed(list(enumerate(BANDS))):
        out = F.when(n <= upto, F.lit(i)).otherwise(out)
    return out


def scan_secrets(docs: DataFrame, discovery_rate: float = 0.05, battery_level: float = 0.001) -> DataFrame:
    """Secrets in every whole text: one row for each row of the input.

    Spans of the base forms stay. Every other token of 20 or more symbols goes through the battery of its inferred
    encoding, whose three p values are combined after Fisher. Those that the battery does not tell from random at
    battery_level, and whose combined statistic ordinary text of that length would not reach, are added as kind random:
    Benjamini-Hochberg over all tokens of a length band in the corpus holds the expected share of ordinary tokens among
    those added at discovery_rate. Tokens that are digits alone, or that mix marks of several encodings, are not tested.
    The p values are counted in bins of 0.05 of their log10: at most 5 bands x 4000 bins, whatever the corpus.
    Tokens inside a base span are not tested.

    Spans are found in one pass and staged; the second pass reads those, not the texts. Null and empty texts have no
    spans; repeated rows are scanned alike; an empty table gives no rows; other columns are left out.
    Returns doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random.
    """
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("_text"))
    found = with_matches(text, "_text", BASE | {"token": TOKEN}).drop("_text")
    found = found.withColumn("assign", F.filter("assign", lambda x: F.length(F.regexp_extract(x["value"], ASSIGN, 1)) >= 6))
    base = F.concat(*(tagged(F.col(k), rank, k) for rank, k in enumerate(BASE)))
    found = found.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in BASE), base.alias("base"), "token")
    free = F.filter("token", lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    found = found.withColumn("token", free).withColumn("token", _battery(F.col("token")))
    found = stage(found, "secrets")

    tested = found.select(F.explode("token").alias("t"))
    bins = tested.groupBy(_band(F.col("t.n")).alias("band"), F.floor(F.col("t.log_p") / BIN).cast("int").alias("bin"))
    bins = bins.agg(F.count("*").alias("rows"))
    order = Window.partitionBy("band").orderBy("bin")
    ranked = bins.withColumn("upto", F.sum("rows").over(order)).withColumn("all", F.sum("rows").over(Window.partitionBy("band")))
    # a bin is taken whole, at its upper end, if p <= rate * rank / tests holds there
    good = ranked.where((F.col("bin") + 1) * BIN <= F.log10(F.lit(discovery_rate) * F.col("upto") / F.col("all")))
    limits = good.groupBy("band").agg(F.max("bin").alias("bin"))
    limits = limits.agg(F.map_from_entries(F.collect_list(F.struct("band", "bin"))).alias("_limits"))  # 5 entries at most

    chosen = F.filter(
        "token",
        lambda t: (t["random"] >= battery_level) & F.coalesce(F.floor(t["log_p"] / BIN) <= F.element_at("_limits", _band(t["n"])), F.lit(False)),
    )
    extra = tagged(F.col("_chosen"), len(BASE), "random")
    return (
        found.join(F.broadcast(limits))
        .withColumn("_chosen", chosen)
        .select(
            "doc_id",
            "n_assign",
            "n_access",
            "n_hex",
            F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"),
            spans_text(F.concat("base", extra)).alias("spans"),
            F.size("_chosen").cast("long").alias("n_random"),
        )
    )
