"""Secret spans: fixed patterns, and long tokens that pass a randomness test battery. DataFrame functions only.

Fixed patterns give the base spans, leftmost and non-overlapping for each kind. The battery adds spans of kind `random`:

* a candidate is a whole run of 20 or more of `A-Za-z0-9+/_-` with a letter and a digit, padding aside; a name
  before '=' is a run of its own. Its encoding is the smallest of the known alphabets that holds it; a run that mixes `+/`
  with `_-` is tested by its whole pieces in either alphabet, which may overlap;
* three tests ask whether its symbols look drawn at random from that alphabet: chi-squared uniformity, runs above and
  below the middle, and lag-one serial correlation. The smallest of the three p-values, corrected for three tests, is
  the candidate's;
* in each stratum of encoding and length band, random tokens have p-values spread evenly, so twice the candidates with
  p of one half or more estimates their number. The lowest threshold is taken at which the candidates beyond that number
  are at most a given share (the false discovery rate) of those let through. All documents count.

A null text is empty. Texts without spans get empty arrays. Positions are code points, ends exclusive. Equal rows give
equal results. Other columns are kept whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadgauge.llm.shared import row_of, text_or_empty

#: The patterns of the base kinds, in their order, and the least characters that a match needs.
ASSIGN = (
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
LEAST_VALUE = 6
KINDS = ("assign", "access", "hex", "random")


def _run(more: str) -> str:
    """Whole runs of letters, digits and the symbols of `more`. A '=' before a run is no part of it, after it only as padding."""
    symbols = f"A-Za-z0-9{more}"
    mixed = f"(?=[A-Za-z{more}]*[0-9])(?=[0-9{more}]*[A-Za-z])"
    return f"(?<![{symbols}]){mixed}[{symbols}]{{20,}}(?![{symbols}])(?:={{1,2}}(?![A-Za-z0-9+/_=-]))?"


CANDIDATE = _run("+/_-")
#: What a run is searched for if no alphabet holds all of it.
PIECES = (_run("+/"), _run("_-"))
#: Encodings by size: what a token is made of, and the order of its symbols.
ENCODINGS = (
    ("hex", "^[0-9a-f]+$", "0123456789abcdef"),
    ("upper hex", "^[0-9A-F]+$", "0123456789ABCDEF"),
    ("base32", "^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("lower base36", "^[0-9a-z]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("upper base36", "^[0-9A-Z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base62", "^[0-9A-Za-z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "^[0-9A-Za-z+/]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "^[0-9A-Za-z_-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
#: First lengths of the length bands.
LENGTH_BANDS = (20, 32, 64, 128)
BINS = 20
LEAST_P = 0.01
BLOCK = 256


def _prefix_sums(lengths: Column) -> Column:
    """Running totals of an array of numbers, by blocks so that long arrays stay affordable."""

    def running(numbers: Column) -> Column:
        zero = F.array().cast("array<bigint>")
        return F.aggregate(
            numbers, zero, lambda done, x: F.concat(done, F.array(x + F.coalesce(F.get(done, F.size(done) - 1), F.lit(0))))
        )

    n_blocks = F.ceil(F.size(lengths) / F.lit(BLOCK)).cast("int")
    blocks = F.transform(
        F.sequence(F.lit(1), n_blocks), lambda b: F.slice(lengths, (b - 1) * BLOCK + 1, F.lit(BLOCK))
    )
    inner = F.transform(blocks, running)
    totals = running(F.transform(inner, lambda block: F.element_at(block, -1)))
    lifted = F.transform(
        inner, lambda block, b: F.transform(block, lambda x: x + F.when(b > 0, F.get(totals, b - 1)).otherwise(F.lit(0)))
    )
    return F.when(F.size(lengths) == 0, F.array().cast("array<bigint>")).otherwise(F.flatten(lifted))


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches with their places: array<struct<start bigint, end bigint, value string>>.

    The pieces between matches and the matches themselves alternate, so places are running totals of their lengths.
    """
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    steps = F.zip_with(
        values, F.slice(pieces, 1, F.size(values)), lambda value, piece: (F.length(piece) + F.length(value)).cast("bigint")
    )
    placed = F.zip_with(
        values,
        _prefix_sums(steps),
        lambda value, end: F.struct((end - F.length(value)).alias("start"), end.alias("end"), value.alias("value")),
    )
    none = F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")
    return F.when(F.size(values) == 0, none).otherwise(placed)


def _spans(found: Column, kind: str) -> Column:
    rank = KINDS.index(kind)
    return F.transform(
        found,
        lambda x: F.struct(
            x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind")
        ),
    )


def _upper_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal Z, by a rational approximation good to seven places."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    series = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-z * z / 2) * 0.3989422804014327 * series
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _pick(encoding: Column, value: Callable[[tuple[str, str, str]], object]) -> Column:
    return F.element_at(F.array(*(F.lit(value(e)) for e in ENCODINGS)), encoding)


def _encoding(token: Column) -> Column:
    """The number of the first alphabet, from 1, that holds all symbols of a token; null if none does."""
    found = F.lit(None).cast("int")
    for number, (_, shape, _) in reversed(list(enumerate(ENCODINGS, start=1))):
        found = F.when(token.rlike(shape), F.lit(number)).otherwise(found)
    return found


def candidates(text: Column) -> Column:
    """The matches of CANDIDATE, those of mixed alphabets piece by piece."""

    def pieces(x: Column) -> Column:
        inside = F.concat(*(matches(x["value"], piece) for piece in PIECES))
        moved = F.transform(
            inside,
            lambda p: F.struct(
                (p["start"] + x["start"]).alias("start"), (p["end"] + x["start"]).alias("end"), p["value"].alias("value")
            ),
        )
        return F.when(x["value"].rlike("[+/]") & x["value"].rlike("[_-]"), moved).otherwise(F.array(x))

    return F.flatten(F.transform(matches(text, CANDIDATE), pieces))


def tested(found: Column) -> Column:
    """Candidates with encoding, length band and p-value: array<struct<start, end, encoding, band, p>>."""
    coded = F.transform(
        found, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.rtrim(x["value"], F.lit("=")).alias("token"))
    )
    coded = F.transform(coded, lambda x: x.withField("encoding", _encoding(x["token"])))
    coded = F.filter(coded, lambda x: x["encoding"].isNotNull())
    coded = F.transform(
        coded,
        lambda x: F.struct(
            x["start"].alias("start"),
            x["end"].alias("end"),
            x["encoding"].alias("encoding"),
            F.length(x["token"]).cast("double").alias("n"),
            _pick(x["encoding"], lambda e: float(len(e[2]))).alias("k"),
            F.transform(F.split(x["token"], ""), lambda c: _symbol(c, x["encoding"])).alias("codes"),
        ),
    )
    measured = F.transform(coded, _measured)
    return F.transform(measured, _judged)


def _symbol(letter: Column, encoding: Column) -> Column:
    return F.position(letter, _pick(encoding, lambda e: e[2])).cast("double")


def _pair(left: Column, right: Column) -> Column:
    return F.struct(left.alias("left"), right.alias("right"))


def _measured(x: Column) -> Column:
    """Squares of the symbol counts, symbols above the middle, runs, and the lag-one product sum."""
    codes, middle = x["codes"], (x["k"] + 1) / 2
    pairs = F.zip_with(F.slice(codes, 2, F.size(codes)), F.slice(codes, 1, F.size(codes) - 1), _pair)
    start = F.struct(F.lit(0.0).alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("squares"))
    # A run's square grows by 2 run + 1 as the run grows by one.
    counted = F.aggregate(
        F.array_sort(codes),
        start,
        lambda acc, c: F.when(
            c == acc["last"],
            F.struct(c.alias("last"), (acc["run"] + 1).alias("run"), (acc["squares"] + 2 * acc["run"] + 1).alias("squares")),
        ).otherwise(F.struct(c.alias("last"), F.lit(1.0).alias("run"), (acc["squares"] + 1).alias("squares"))),
    )
    changes = F.size(F.filter(pairs, lambda p: (p["left"] > middle) != (p["right"] > middle)))
    products = F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + (p["left"] - middle) * (p["right"] - middle))
    return F.struct(
        x["start"].alias("start"),
        x["end"].alias("end"),
        x["encoding"].alias("encoding"),
        x["n"].alias("n"),
        x["k"].alias("k"),
        counted["squares"].alias("squares"),
        F.size(F.filter(codes, lambda c: c > middle)).cast("double").alias("above"),
        (changes + 1).cast("double").alias("runs"),
        products.alias("products"),
    )


def _judged(x: Column) -> Column:
    n, k = x["n"], x["k"]
    freedom = k - 1
    chi = F.greatest(F.lit(0.0), x["squares"] * k / n - n)
    z_chi = (F.pow(chi / freedom, F.lit(1 / 3)) - (1 - 2 / (9 * freedom))) / F.sqrt(2 / (9 * freedom))
    expected = 1 + 2 * x["above"] * (n - x["above"]) / n
    spread = (expected - 1) * (expected - 2) / (n - 1)
    z_runs = F.when(spread > 0, (x["runs"] - expected) / F.sqrt(spread)).otherwise(F.lit(9.0))
    z_serial = x["products"] / ((k * k - 1) / 12 * F.sqrt(n - 1))
    least = F.least(_upper_tail(z_chi), 2 * _upper_tail(F.abs(z_runs)), 2 * _upper_tail(F.abs(z_serial)))
    band = sum(((n >= first).cast("int") for first in LENGTH_BANDS[1:]), F.lit(0))
    return F.struct(
        x["start"].alias("start"),
        x["end"].alias("end"),
        x["encoding"].alias("encoding"),
        band.alias("band"),
        (1 - F.pow(1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), least)), F.lit(3.0))).alias("p"),
    )


def thresholds(text_rows: DataFrame, false_share: float) -> dict[tuple[int, int], float]:
    """The least p-value let through in each stratum. `text_rows` has one column, text; all its rows count."""
    tests = text_rows.select(F.explode(tested(candidates(F.col("text")))).alias("t"))
    binned = F.least(F.floor(F.col("t.p") * BINS), F.lit(BINS - 1)).cast("int")
    counts = tests.groupBy(F.col("t.encoding").alias("encoding"), F.col("t.band").alias("band"), binned.alias("bin"))
    # At most one row for each alphabet, length band and bin.
    strata: dict[tuple[int, int], list[int]] = {}
    for row in counts.count().collect():
        strata.setdefault((row["encoding"], row["band"]), [0] * BINS)[row["bin"]] = row["count"]
    return {stratum: least for stratum, bins in strata.items() if (least := _threshold(bins, false_share)) is not None}


def _threshold(bins: list[int], false_share: float) -> float | None:
    random = min(sum(bins), 2 * sum(bins[BINS // 2 :]))
    for first in range(BINS):
        through = sum(bins[first:])
        least = max(LEAST_P, first / BINS)
        if through and through - random * (1 - least) <= false_share * through:
            return least
    return None


def secret_spans(docs: DataFrame, false_share: float = 0.1) -> DataFrame:
    """(row, text, base, spans): row holds all columns given; base and spans are arrays of (start, rank, end, kind) by
    start, then kind. `spans` has the base ones and the random tokens, which may lie in base ones."""
    rows = docs.select(row_of(docs).alias("row"), text_or_empty().alias("text"))
    least = thresholds(rows.select("text"), false_share)
    text = F.col("text")
    assigned = F.filter(
        matches(text, ASSIGN), lambda x: F.length(F.regexp_extract(x["value"], ASSIGN, 1)) >= LEAST_VALUE
    )
    kinds = (_spans(assigned, "assign"), _spans(matches(text, ACCESS), "access"), _spans(matches(text, HEX), "hex"))
    rows = rows.withColumn("base", F.array_sort(F.concat(*kinds)))
    if not least:
        return rows.withColumn("spans", F.col("base"))
    def lets_through(x: Column) -> Column:
        found = F.lit(False)
        for (encoding, band), p in sorted(least.items()):
            found = found | ((x["encoding"] == encoding) & (x["band"] == band) & (x["p"] >= p))
        return found

    random = F.filter(tested(candidates(text)), lets_through)
    return rows.withColumn("spans", F.array_sort(F.concat("base", _spans(random, "random"))))


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def number_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span, overlapping ones as one, replaced by a mark."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        return F.when(
            s["start"] >= acc["at"],
            F.struct(s["end"].alias("at"), F.concat(acc["parts"], F.array(gap, F.lit(mark))).alias("parts")),
        ).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["parts"].alias("parts")))

    cut = F.aggregate(
        spans,
        start,
        step,
        lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))),
    )
    return F.when(F.size(spans) == 0, text).otherwise(cut)
