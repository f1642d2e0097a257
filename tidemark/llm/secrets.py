"""Secret scans: fixed forms and sliding-window entropy.

Fixed forms are assignments to names such as ``password`` or ``api_key``,
access key ids and long runs of hex digits.  Beyond them, candidate strings
(all runs of 16 or more letters, digits and ``+/_=-``) are searched with a
sliding window of 20 characters, or 16 in runs shorter than that: counts of the
window's characters are updated by the one that enters and the one that leaves,
and with them the sum of c * log2(c), from which the window's Shannon entropy
follows.  The threshold depends on the window and on the character class of
the candidate: hex digits, letters and digits mixed, letters of both cases,
letters of one case (of 20 or more only: shorter words of a language reach the
same entropy).  Windows at or above it are merged into spans, unless the
candidate is on the allow list or the span overlaps a fixed form.

DataFrame functions only, one pass over each text, nothing is shuffled.  Sums
are integers (millionths), so results do not depend on the order of updates.

Defined results: a null text counts as empty and has no spans; repeated rows
are scanned alike; other columns pass unchanged.
"""

from __future__ import annotations

from math import ceil, floor, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds in output order, their patterns, least lengths.
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = (r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?"
          r"([A-Za-z0-9+/_.=-]+)")
ACCESS = r"AKIA[A-Z0-9]{12,}"          # a shorter run fails as a whole: no other match in it
HEX = r"[0-9a-f]{32,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
ALLOWED = (
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",     # UUID
    r"(?i)example|placeholder|changeme|dummy|xxxx",
    r"0123456789|abcdefghij|(?i)qwertyuiop",
    r"^[0-9+/_=-]+$",                                            # numbers and rules
    r"^[a-z0-9_-]*(/[a-z0-9_-]*){2,}$",                          # paths
)
# Class of a candidate (the first whose pattern finds something), and the least
# entropy of a window of 20 and of 16 characters; None: not looked at.
CLASSES = (
    (r"^[0-9a-fA-F]+$", 3.0, 2.75),
    (r"[0-9].*[A-Za-z]|[A-Za-z].*[0-9]", 3.75, 3.5),
    (r"[a-z].*[A-Z]", 3.85, 3.6),
    (r"[A-Za-z]", 3.7, None),
)
LONG, SHORT = 20, 16
MILLION = 1_000_000
SPAN = "array<struct<start:int,end:int,hit:string>>"


def located(text: Column, pattern: str) -> Column:
    """Matches of a pattern, leftmost and without overlap, with their places
    (code points, end exclusive)."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.filter(F.zip_with(hits, F.split(text, pattern, -1),
                               lambda h, g: F.struct(h.alias("h"), g.alias("g"))),
                    lambda x: x["h"].isNotNull())

    def add(acc, x):
        start = acc["at"] + F.length(x["g"])
        end = start + F.length(x["h"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(
            start.alias("start"), end.alias("end"), x["h"].alias("hit")))).alias("out"))
    found = F.aggregate(both, F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out")),
                        add, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(SPAN))


def _sum_limit(bits: float, window: int) -> int:
    """Largest sum of c * log2(c), in millionths, at an entropy of ``bits``."""
    return floor((log2(window) - bits) * window * MILLION + 1e-6)


def hot_ranges(word: Column, limit: Column, window: int = LONG) -> Column:
    """array<struct<start, end>>: merged windows of a word whose entropy sum is
    at most ``limit``."""
    weight = F.array(*[F.lit(round(c * log2(c) * MILLION) if c else 0).cast("long")
                       for c in range(window + 1)])
    at = lambda c: F.element_at(weight, c + 1)
    codes = F.transform(F.split(word, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    moves = F.filter(
        F.zip_with(codes, F.concat(F.array_repeat(F.lit(0), window), codes),
                   lambda i, o: F.struct(i.alias("i"), o.alias("o"))),
        lambda x: x["i"].isNotNull())

    def slide(acc, x):
        enters, leaves = x["i"], x["o"]
        gone = F.when(leaves > 0, F.element_at(acc["counts"], F.greatest(leaves, F.lit(1)))) \
            .otherwise(F.lit(0))
        have = F.element_at(acc["counts"], enters) - F.when(enters == leaves, 1).otherwise(0)
        total = (acc["sum"] + at(have + 1) - at(have)
                 - F.when(gone > 0, at(gone) - at(F.greatest(gone - 1, F.lit(0)))).otherwise(0))
        counts = F.transform(acc["counts"], lambda c, k: c + F.when(k + 1 == enters, 1).otherwise(0)
                             - F.when(k + 1 == leaves, 1).otherwise(0))
        end = acc["end"] + 1
        start = end - window
        span = lambda s: F.array(F.struct(s.alias("start"), end.alias("end")))
        last = F.get(acc["out"], F.size(acc["out"]) - 1)
        grown = F.when((start < 0) | (total > limit), acc["out"]).when(
            last["end"] >= start,
            F.concat(F.slice(acc["out"], F.lit(1), F.size(acc["out"]) - 1), span(last["start"]))
        ).otherwise(F.concat(acc["out"], span(start)))
        return F.struct(counts.alias("counts"), total.alias("sum"), end.alias("end"),
                        grown.alias("out"))
    first = F.struct(F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"),
                     F.lit(0).cast("long").alias("sum"), F.lit(0).alias("end"),
                     F.array().cast("array<struct<start:int,end:int>>").alias("out"))
    return F.aggregate(moves, first, slide, lambda acc: acc["out"])


def find_secrets(docs: DataFrame, classes=CLASSES,
                 allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """``docs`` plus ``base`` and ``added``: arrays of (start, rank, kind, end),
    sorted; ``rank`` is the place of the kind in KINDS."""
    text = F.coalesce(F.col("text"), F.lit(""))

    def tagged(spans, kind):
        return F.transform(spans, lambda s: F.struct(
            s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"),
            F.lit(kind).alias("kind"), s["end"].alias("end")))
    assign = F.filter(located(text, ASSIGN),
                      lambda s: F.length(F.regexp_extract(s["hit"], ASSIGN, 2)) >= 8)
    out = docs.withColumn("_base", F.array_sort(F.concat(
        tagged(assign, "assign"), tagged(located(text, ACCESS), "access"),
        tagged(located(text, HEX), "hex"))))

    def suspicious(s):
        fine = F.lit(False)
        for pattern in allowed:
            fine = fine | s["hit"].rlike(pattern)
        return ~fine

    def by_class(word, window, value):
        """``value`` (of bits) of the class of a word, null if it has none."""
        out = F.lit(None)
        for pattern, *bits in reversed(classes):
            own = bits[window == SHORT]
            out = F.when(word.rlike(pattern), F.lit(None) if own is None else
                         F.lit(value(own)).cast("long")).otherwise(out)
        return out

    def hot(word, window):
        # a window has no more entropy than log2 of the word's different characters
        enough = F.size(F.array_distinct(F.split(word, ""))) >= by_class(
            word, window, lambda bits: ceil(2 ** bits - 1e-9))
        limit = by_class(word, window, lambda bits: _sum_limit(bits, window))
        return F.when(enough, hot_ranges(word, limit, window)).otherwise(
            F.array().cast("array<struct<start:int,end:int>>"))

    def ranges(s):
        spans = F.when(F.length(s["hit"]) >= LONG, hot(s["hit"], LONG)) \
            .otherwise(hot(s["hit"], SHORT))
        return F.transform(spans, lambda r: F.struct(
            (s["start"] + r["start"]).alias("start"), (s["start"] + r["end"]).alias("end")))
    found = F.flatten(F.transform(F.filter(located(text, CANDIDATE), suspicious), ranges))
    new = F.filter(found, lambda r: ~F.exists(
        "_base", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])))
    return (out.withColumn("added", F.array_sort(tagged(new, "entropy")))
            .withColumnRenamed("_base", "base"))


def spelled(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
