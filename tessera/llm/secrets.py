"""Secret scans in DataFrame functions only: fixed patterns, and sliding-window Shannon entropy of candidate strings.

Base kinds are `assign`, `access` and `hex`. The method adds kind `entropy`: a candidate is a maximal run of 20 or more of
[A-Za-z0-9+/_=-] that holds at least two of lower case, upper case and digits. Its character class (hex digits; letters with
digits; letters only) sets the entropy that one of its windows of 20 characters must reach. The sum of c * log2(c) over the
window's character counts c changes only for the character that leaves and the one that enters. Candidates that match the
allow list are left out. Positions are code points, ends exclusive.

Edge cases: a null text counts as empty and has no spans; a null id is kept; repeated rows give repeated rows; overlapping
spans of different kinds are all reported; an empty table gives an empty result; extra columns are ignored; a text of any
length is scanned whole, in time that grows with its length and its number of matches.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .spread import let

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
WINDOW, STRETCH = 20, 64
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Entropy in bits that a window must reach, by character class.
THRESHOLDS = {"hex": 3.0, "mixed": 3.5, "letters": 4.1}
ALLOW = r"(?i)example|placeholder|your[_-]|(.)\1{7,}|0123456789|abcdefghij"
KINDS = ["assign", "access", "hex", "entropy"]


def running(sizes: Column) -> Column:
    """Running totals of a non-empty array of integers: totals of stretches first, then inside each stretch, so that no step
    copies more than a stretch or the list of stretches."""

    def totals(of: Column, start: Column) -> Column:
        return F.aggregate(of, F.array(start), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))

    def inside(parts: Column, before: Column) -> Column:
        return F.flatten(F.transform(parts, lambda x, i: F.slice(totals(x, F.get(before, i)), 2, STRETCH)))

    last = F.floor((F.size(sizes) - 1) / STRETCH).cast("int")
    parts = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(sizes, k * STRETCH + 1, STRETCH))
    add_up = lambda x: F.aggregate(x, F.lit(0), lambda a, y: a + y)
    return let(parts, lambda p: let(totals(F.transform(p, add_up), F.lit(0)), lambda before: inside(p, before)))


def spans(text: Column, pattern: str, group: int = 0, keep=None) -> Column:
    """Spans (start, end) of a pattern's leftmost matches; keep: which matches count, from the group's text."""

    def placed(found: Column, sizes: Column, ends: Column) -> Column:
        at = F.transform(found, lambda w, i: F.struct(
            (F.get(ends, i) - F.get(sizes, i)).alias("start"), F.get(ends, i).alias("end"), (F.lit(True) if keep is None else keep(w)).alias("ok")
        ))
        return F.transform(F.filter(at, lambda s: s["ok"]), lambda s: s.dropFields("ok"))

    def ends_of(gaps: Column, sizes: Column) -> Column:
        # one gap more than matches
        return running(F.transform(sizes, lambda n, i: n + F.length(F.get(gaps, i))))

    none = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    whole = F.transform(F.regexp_extract_all(text, F.lit(pattern), 0), F.length)
    found = F.regexp_extract_all(text, F.lit(pattern), group)
    gaps = F.split(text, pattern, -1)
    some = let(whole, lambda n: let(gaps, lambda g: let(ends_of(g, n), lambda e: placed(found, n, e))))
    return F.when(text.rlike(pattern), some).otherwise(none)


def window_entropy(word: Column, width: int = WINDOW) -> Column:
    """Largest Shannon entropy, in bits, of the windows of `width` characters of a word that has at least so many. One step a
    character: its count goes up, that of the character which leaves the window goes down, and the sum of c * log2(c) changes
    by the terms of these two."""
    terms = F.array(*(F.lit(c * math.log2(c) if c else 0.0) for c in range(width + 1)))

    def count(state: Column, code: Column, more: int) -> Column:
        def changed(c: Column) -> Column:
            counts = F.concat(F.slice(state["counts"], 1, code - 1), F.array(c + more), F.slice(state["counts"], code + 1, len(ALPHABET)))
            return F.struct(counts.alias("counts"), (state["s"] - F.get(terms, c) + F.get(terms, c + more)).alias("s"), state["least"].alias("least"))

        return let(F.get(state["counts"], code - 1), changed)

    def walk(codes: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            left = let(state, lambda a: F.when(i >= width, count(a, F.get(codes, i - width), -1)).otherwise(a))
            both = let(left, lambda a: count(a, F.get(codes, i), 1))
            return let(both, lambda a: F.struct(
                a["counts"].alias("counts"), a["s"].alias("s"), F.when(i >= width - 1, F.least(a["least"], a["s"])).otherwise(a["least"]).alias("least")
            ))

        start = F.struct(F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"), F.lit(0.0).alias("s"), F.lit(math.inf).alias("least"))
        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), start, step, lambda a: a["least"])

    codes = F.transform(F.regexp_extract_all(word, F.lit("."), 0), lambda x: F.instr(F.lit(ALPHABET), x))
    return F.lit(math.log2(width)) - let(codes, walk) / width


def suspicious(word: Column) -> Column:
    lower, upper, digit = word.rlike("[a-z]"), word.rlike("[A-Z]"), word.rlike("[0-9]")
    limit = (
        F.when(word.rlike("^[0-9a-fA-F]+$"), THRESHOLDS["hex"]).when(digit, THRESHOLDS["mixed"]).otherwise(THRESHOLDS["letters"])
    )
    two = lower.cast("int") + upper.cast("int") + digit.cast("int") >= 2
    return F.when(two & ~word.rlike(ALLOW), window_entropy(word) >= limit).otherwise(False)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) with spans an array of (start, kind number, end, kind), in order of start and kind."""
    t = F.col("text")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = [spans(t, ASSIGN, 2, lambda v: F.length(v) >= 12), spans(t, ACCESS), spans(t, HEX), spans(t, CANDIDATE, 0, suspicious)]
    d = d.select("doc_id", *(x.alias(f"s{i}") for i, x in enumerate(found)))

    def tagged(i: int) -> Column:
        return F.transform(f"s{i}", lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("k"), s["end"].alias("end"), F.lit(KINDS[i]).alias("kind")))

    return d.select("doc_id", F.sort_array(F.concat(*map(tagged, range(4)))).alias("spans"))


def secret_digest(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, a hash of the base spans and all spans as text, per document."""
    d = scan_secrets(docs)
    base = F.filter("spans", lambda s: s["k"] < 3)

    def count(i: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["k"] == i)).cast("long")

    def joined(a: Column) -> Column:
        return F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    return d.select(
        "doc_id", *(count(i).alias(f"n_{KINDS[i]}") for i in range(3)),
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )
