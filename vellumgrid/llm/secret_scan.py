"""Secret scans by a randomness test battery, in DataFrame functions only.

Known shapes (assignments, access keys, long hexadecimal) are the base. The battery adds runs of key-like characters: each
gets an encoding and with it an alphabet; a chi-squared statistic of its uniformity, a runs test over the kinds of its characters
(capitals, small letters, digits, signs) and a serial correlation. A run that fails as random in any of the three is none. For the others, the p-value is
that of text: how likely so even a use of the alphabet, and so many changes of kind, are at this length in words, identifiers and
paths (the two joined by Fisher's method). Longer runs tell more, so false discoveries are controlled (Benjamini-Hochberg) within
classes of length, over all documents. The control needs only a histogram of p-values, whose size is fixed.

A text is read in time linear in its length but for lists of matches, which take the power 1.5 of their number.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumgrid.llm.common import table, text_of

#: Kinds in the order of ties, their patterns, the group that is measured and its least length.
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
RANDOM = "random"
#: A whole run of key-like characters, and padding; of these are tested those with a digit and a letter, or with a capital after a small letter.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}"
#: Names before a key, as in sk_live_..., belong to its span but not to what is tested.
PREFIX = r"^(?:[A-Za-z0-9]{1,12}[_-]){1,3}(?=[A-Za-z0-9+/]{16,}=*$)"
_MIXED = r"[0-9][^0-9]*[A-Za-z]|[A-Za-z][^A-Za-z]*[0-9]|[a-z][A-Z]"
_CAPITALS, _SMALL, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Encoding, pattern, alphabet; how often two characters of a text in that alphabet agree, and how often its kind of character changes.
ENCODINGS = (
    ("hex", r"^[0-9a-f]+$", _DIGITS + "abcdef", 0.12, 0.15),
    ("HEX", r"^[0-9A-F]+$", _DIGITS + "ABCDEF", 0.12, 0.15),
    ("base32", r"^[A-Z2-7]+$", _CAPITALS + "234567", 0.085, 0.10),
    ("base36", r"^[a-z0-9]+$", _SMALL + _DIGITS, 0.075, 0.15),
    ("BASE36", r"^[A-Z0-9]+$", _CAPITALS + _DIGITS, 0.075, 0.15),
    ("alnum", r"^[A-Za-z0-9]+$", _CAPITALS + _SMALL + _DIGITS, 0.065, 0.25),
    ("base64", r"^[A-Za-z0-9+/]+$", _CAPITALS + _SMALL + _DIGITS + "+/", 0.065, 0.30),
    ("base64url", r"^[A-Za-z0-9_-]+$", _CAPITALS + _SMALL + _DIGITS + "-_", 0.065, 0.35),
)
#: Lower ends of the classes of length within which false discoveries are controlled.
LENGTHS = (16, 20, 24, 32, 48, 96)
#: Share of false discoveries, and the p-value under which a run isn't random.
DISCOVERY_RATE, NOT_RANDOM = 0.01, 0.001
#: Bins a decade and decades of the histogram of p-values.
BINS, DECADES = 20, 40
#: Code points of a text that a redaction cuts at a time.
BLOCK = 4096

_SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` applied to a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _running(values: Column, join: Callable[[Column, Column], Column], nothing: int) -> Column:
    """Running results of an associative `join` over an array of int, first included. In blocks of about the root of its size, since a
    fold copies the list that it makes."""

    def fold(items: Column, kind: str, add: Callable[[Column, Column], Column], after: Callable[[Column, Column], Column]) -> Column:
        start = F.struct(F.lit(nothing).alias("at"), F.array().cast(kind).alias("out"))
        return F.aggregate(items, start, lambda a, x: F.struct(after(a["at"], x).cast("int").alias("at"), F.concat(a["out"], F.array(add(a["at"], x))).alias("out")))

    step = lambda at, x: join(at, x).cast("int")

    def blocks(v: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(v).cast("double"))).cast("int")
        firsts = F.sequence(F.lit(1), F.size(v), size)
        parts = F.transform(firsts, lambda at: fold(F.slice(v, at, size), "array<int>", step, step))
        return F.flatten(fold(parts, "array<array<int>>", lambda at, p: F.transform(p["out"], lambda x: step(at, x)), lambda at, p: step(at, p["at"]))["out"])

    return _once(values, lambda v: F.when(F.size(v) > 0, blocks(v)).otherwise(F.array().cast("array<int>")))


def _placed(body: Column, pattern: str) -> Column:
    """Array of (start, end, m) of the leftmost matches that don't overlap, in code points: the pieces between matches give the places."""

    def placed(found: Column) -> Column:
        ends = _running(F.transform(found, lambda x: x["gap"] + F.length(x["m"])), lambda a, b: a + b, 0)
        return F.zip_with(found, ends, lambda x, end: F.struct((end - F.length(x["m"])).alias("start"), end.alias("end"), x["m"].alias("m")))

    pieces, whole = F.split(body, pattern, -1), F.regexp_extract_all(body, F.lit(pattern), F.lit(0))
    paired = F.zip_with(pieces, whole, lambda p, m: F.struct(F.length(p).alias("gap"), m.alias("m")))
    return _once(F.filter(paired, lambda x: x["m"].isNotNull()), placed)


def base_spans(body: Column) -> Column:
    """All base spans, by start, then kind."""
    found = []
    for rank, (kind, pattern, group, least) in enumerate(BASE):
        spans = F.filter(_placed(body, pattern), lambda x: F.length(F.regexp_extract(x["m"], pattern, group)) >= least)
        spans = F.transform(spans, lambda x: F.struct(x["start"], F.lit(rank).alias("rank"), x["end"], F.lit(kind).alias("kind")))
        found.append(F.when(body.rlike(pattern), spans).otherwise(F.array()).cast(_SPAN))
    return F.sort_array(F.concat(*found))


def _tail(z: Column) -> Column:
    """P(Z > z) of the normal distribution, to within a third of a percent in either tail."""
    x = F.abs(z)
    upper = F.exp(-x * x / 2) / (math.sqrt(2 * math.pi) * (0.661 * x + 0.339 * F.sqrt(x * x + 5.51)))
    return F.when(z >= 0, upper).otherwise(1 - upper)


def _characters(text: Column) -> Column:
    return F.array_remove(F.split(text, ""), "")


def _kind_of(alphabet: str) -> str:
    return "".join("U" if c in _CAPITALS else "l" if c in _SMALL else "0" if c in _DIGITS else "-" for c in alphabet)


def _change(alphabet: str) -> float:
    """How often the kind changes from one random character to the next."""
    kinds = _kind_of(alphabet)
    return 1 - sum((kinds.count(k) / len(kinds)) ** 2 for k in set(kinds))


def _facts_of(name: str, pattern: str, alphabet: str, agree: float, change: float) -> Column:
    at_random = _change(alphabet)
    values = {"alphabet": alphabet, "kinds": _kind_of(alphabet), "k": float(len(alphabet)), "agree": agree, "change": change, "at_random": at_random}
    return F.struct(*(F.lit(v).alias(n) for n, v in values.items()))


def battery(text: Column, e: Column) -> Column:
    """p of a text of that encoding that is no secret; 1 if the text fails as random."""

    def tests(codes: Column) -> Column:
        n = F.length(text).cast("double")
        squares = F.aggregate(_characters(e["alphabet"]), F.lit(0.0), lambda a, c: a + F.pow(n - F.length(F.replace(text, c, F.lit(""))), F.lit(2.0)))
        runs = F.length(F.regexp_replace(F.call_function("translate", text, e["alphabet"], e["kinds"]), "U+|l+|0+|-+", "x"))
        total = F.aggregate(codes, F.lit(0.0), lambda a, c: a + c)
        own = F.aggregate(codes, F.lit(0.0), lambda a, c: a + c * c)
        lagged = F.aggregate(F.transform(codes, lambda c, i: F.when(i > 0, (c * F.get(codes, i - 1)).cast("double")).otherwise(0.0)), F.lit(0.0), lambda a, c: a + c)
        ends = (F.get(codes, F.lit(0)) + F.get(codes, F.size(codes) - 1)).cast("double")
        facts = F.struct(n.alias("n"), squares.alias("squares"), (runs - 1).cast("double").alias("changes"), (total / n).alias("mean"), own.alias("own"), lagged.alias("lagged"), ends.alias("ends"), e.alias("e"))
        return _once(facts, lambda x: _once(_statistics(x), _decide))

    return _once(F.transform(_characters(text), lambda c: F.instr(e["alphabet"], c) - 1), tests)


def _statistics(x: Column) -> Column:
    """Standard scores of the three tests of randomness, and of evenness and changes as in text."""
    n, mean, e = x["n"], x["mean"], x["e"]
    k, q, t = e["k"], e["at_random"], e["change"]
    chi = x["squares"] * k / n - n - (k - 1)
    variance = F.greatest(x["own"] - n * mean * mean, F.lit(1e-9))
    # sum over neighbours of (a - mean) * (b - mean)
    together = x["lagged"] - mean * (2 * n * mean - x["ends"]) + (n - 1) * mean * mean
    shift = n * (k * e["agree"] - 1)  # a text's excess over chance, which grows with its length
    return F.struct(
        (chi / F.sqrt(2 * (k - 1))).alias("chi"),
        ((x["changes"] - (n - 1) * q) / F.sqrt((n - 1) * q * (1 - q))).alias("runs"),
        (together / variance * F.sqrt(n)).alias("serial"),
        ((shift - chi) / F.sqrt(2 * (k - 1) + 4 * shift)).alias("even"),
        ((x["changes"] - (n - 1) * t) / F.sqrt((n - 1) * t * (1 - t))).alias("changing"),
    )


def _decide(z: Column) -> Column:
    random = (_tail(z["chi"]) >= NOT_RANDOM) & (2 * _tail(F.abs(z["runs"])) >= NOT_RANDOM) & (2 * _tail(F.abs(z["serial"])) >= NOT_RANDOM)
    both = lambda p: F.when(random, p * (1 - F.log(p))).otherwise(1.0)
    return _once(F.greatest(_tail(z["even"]) * _tail(z["changing"]), F.lit(10.0 ** -(DECADES + 5))), both)


def candidates(body: Column, base: Column) -> Column:
    """Array of (start, end, length class, p) of key-like runs that no base span holds whole."""

    def scored(x: Column) -> Column:
        return _once(F.regexp_replace(x["m"], f"{PREFIX}|=+$", ""), lambda core: inferred(x, core))

    def inferred(x: Column, core: Column) -> Column:
        chosen = reduce(lambda other, e: F.when(core.rlike(e[1]), _facts_of(*e)).otherwise(other), reversed(ENCODINGS), F.lit(None))
        p = _once(chosen, lambda e: F.when(e.isNotNull(), battery(core, e)).otherwise(1.0))
        size = reduce(lambda other, k: F.when(F.length(core) >= LENGTHS[k], F.lit(k)).otherwise(other), range(len(LENGTHS)), F.lit(0))
        return F.struct(x["start"], x["end"], size.alias("size"), p.alias("p"))

    def free(found: Column) -> Column:
        """Those that reach past every base span that begins no later: one sweep over both by start."""
        ours = F.transform(found, lambda x: F.struct(x["start"].alias("at"), F.lit(1).alias("run"), F.lit(0).alias("end"), x.alias("x")))
        theirs = F.transform(base, lambda b: F.struct(b["start"].alias("at"), F.lit(0).alias("run"), b["end"].alias("end"), F.lit(None).cast("struct<start:int,end:int,m:string>").alias("x")))
        return _once(F.sort_array(F.concat(theirs, ours)), swept)

    def swept(row: Column) -> Column:
        reach = _running(F.transform(row, lambda r: r["end"]), lambda a, b: F.greatest(a, b), 0)
        return F.transform(F.filter(F.zip_with(row, reach, lambda r, high: F.struct(r["x"].alias("x"), high.alias("high"))), lambda r: r["x"].isNotNull() & (r["x"]["end"] > r["high"])), lambda r: scored(r["x"]))

    found = F.filter(_placed(body, CANDIDATE), lambda x: x["m"].rlike(_MIXED))
    return F.when(body.rlike(CANDIDATE), _once(found, lambda f: F.when(F.size(f) > 0, free(f)).otherwise(F.array()))).otherwise(F.array()).cast("array<struct<start:int,end:int,size:int,p:double>>")


def _with_candidates(rows: DataFrame) -> DataFrame:
    """Columns of rows, which has one named body, with base and runs."""
    return rows.withColumn("base", base_spans(F.col("body"))).withColumn("runs", candidates(F.col("body"), F.col("base")))


def _bin(p: Column) -> Column:
    return F.least(F.floor(-F.log10(F.greatest(p, F.lit(10.0**-DECADES))) * BINS), F.lit(BINS * DECADES)).cast("int")


def thresholds(bodies: DataFrame, rate: float = DISCOVERY_RATE) -> dict[int, int]:
    """The least bin of p-values that is a discovery, for each class of length; the driver gets a histogram of fixed size."""
    run = _with_candidates(bodies.select("body")).select(F.explode("runs").alias("r")).select("r.size", _bin(F.col("r.p")).alias("bin"))
    counts: dict[int, dict[int, int]] = {}
    for size, at, n in run.groupBy("size", "bin").count().collect():
        counts.setdefault(size, {})[at] = n
    found = {}
    for size, bins in counts.items():
        total, so_far = sum(bins.values()), 0
        for at in sorted(bins, reverse=True):
            so_far += bins[at]
            if 10 ** (-at / BINS) * total <= rate * so_far:
                found[size] = at
    return found


def scan(docs: DataFrame, rate: float = DISCOVERY_RATE) -> DataFrame:
    """All input columns, and `found`: the spans (start, rank, end, kind) of base and method, by start, then kind, in code points.

    A null text counts as empty and has no span; rows that repeat stay repeated, and each counts in the control of false discoveries;
    spans of one start go by kind as listed, method last. Only an input column named found is replaced.
    """
    names = [c for c in docs.columns if c != "found"]
    ready = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), text_of(F.col("text").cast("string")).alias("body"))
    limits = thresholds(ready, rate)
    passes = lambda x: reduce(lambda a, b: a | b, ((x["size"] == size) & (_bin(x["p"]) >= at) for size, at in limits.items()), F.lit(False))
    added = F.transform(F.filter("runs", passes), lambda x: F.struct(x["start"], F.lit(len(BASE)).alias("rank"), x["end"], F.lit(RANDOM).alias("kind"))).cast(_SPAN)
    return _with_candidates(ready).select("row.*", F.sort_array(F.concat("base", added)).alias("found"))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each stretch of spans (sorted by start) replaced by the mark; without a span it stays as it is, null too."""

    def cut(blocks: Column, low: Column, high: Column) -> Column:
        """Code points from low to high, from blocks of BLOCK."""
        inside = lambda b: F.substring(F.get(blocks, b), F.greatest(low - b * BLOCK, F.lit(0)) + 1, F.least(high - b * BLOCK, F.lit(BLOCK)) - F.greatest(low - b * BLOCK, F.lit(0)))
        whole = F.transform(F.sequence(F.floor(low / BLOCK).cast("int"), F.floor((high - 1) / BLOCK).cast("int")), inside)
        return F.when(high > low, F.array_join(whole, "")).otherwise("")

    def pieces(blocks: Column) -> Column:
        reach = _running(F.transform(spans, lambda x: x["end"]), lambda a, b: F.greatest(a, b), 0)

        def with_reach(ends: Column) -> Column:
            before = F.concat(F.array(F.lit(0)), F.slice(ends, F.lit(1), F.size(ends) - 1))
            parts = F.zip_with(spans, before, lambda x, low: F.when((x["start"] >= low) | (low == 0), F.concat(cut(blocks, low, x["start"]), F.lit(mark))).otherwise(""))
            return F.concat(F.array_join(parts, ""), cut(blocks, F.element_at(ends, -1), F.length(text)))

        return _once(reach, with_reach)

    return F.when(F.size(spans) > 0, _once(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)), pieces)).otherwise(text)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All spans of every document, counted by base kind; see `scan`."""
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("found", lambda x: x["kind"] != RANDOM)
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        F.col("doc_id").cast("long"), *(count(kind).alias(f"n_{kind}") for kind, *_ in BASE), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("found")).alias("spans")
    )
