"""Secret scans with DataFrame functions only.

Base kinds (``assign``, ``access``, ``hex``) are the leftmost non-overlapping
matches of ``BASE_PATTERNS`` whose length reaches the kind's minimum; a match
that is too short is dropped and what it covers isn't tried again. Positions come
from the lengths of what lies between the matches.

The method adds ``entropy`` spans: candidate strings outside the base spans in
which a sliding window reaches the Shannon entropy asked for in the string's
character class. As the window moves on by one character only two counts change; the
counts are carried along, and with them the entropy; the time taken is linear in the
text. An allow-list suppresses added spans (identifiers such as UUIDs, integrity hashes,
placeholders, and strings the caller names); base spans always stay.

Positions are code points, ends exclusive. A null or empty text has no spans.
Repeated rows give repeated results; an empty table gives no rows; other columns
of the input don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "entropy")
BASE_KINDS = KINDS[:3]
#: In the syntax of java.util.regex: letters of the key words in either case.
BASE_PATTERNS = {
    "assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}
MIN_LENGTH = {"assign": 12, "access": 18, "hex": 16}

WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Character classes, tried in this order: pattern of the whole string, least entropy in bits.
CLASSES = (
    ("hex", r"(?=.*[0-9])(?=.*[a-fA-F])[0-9a-fA-F]+", 3.0),
    ("alnum", r"(?=.*[0-9].*[0-9])((?=.*[a-z])[a-z0-9]+|(?=.*[A-Z])[A-Z0-9]+)", 3.6),
    ("base64", r"(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/_=-]+", 3.8),
)
ALLOW_PATTERNS = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^sha(256|384|512)-",
    r"(?i)example|placeholder|changeme|dummy|sample|redacted",
    r"(?i)1234567|abcdefg|(.)\1{5}",
)

_SPAN = "struct<start:int,kind:int,stop:int,value:string>"
#: Rows of a part of a walk.
_PART = 128


def _none() -> Column:
    return F.array().cast(f"array<{_SPAN}>")


def _bind(value: Column, use) -> Column:
    """``use(value)`` with *value* computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _walk(rows: Column, neutral: int, join, step) -> Column:
    """The spans that ``step(carried, row)`` keeps on the way along *rows*.

    *step* gives what is carried on, whether a span stays, and the span. Spark copies
    all that an aggregate has gathered at each of its steps; so the way is cut into
    parts, each begins with what those before it carry (by *join*), and the time taken
    is linear in the number of rows.
    """

    def along(part: Column, begin: Column) -> Column:
        def move(state: Column, row: Column) -> Column:
            onward, keep, span = step(state["carried"], row)
            return F.struct(onward.alias("carried"), F.when(keep, F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

        return F.aggregate(part, F.struct(begin.alias("carried"), _none().alias("spans")), move, lambda state: state["spans"])

    def parted(every: Column) -> Column:
        places = F.sequence(F.lit(0), F.floor(F.greatest(F.size(every) - 1, F.lit(0)) / _PART).cast("int"))
        return F.transform(places, lambda i: F.slice(every, i * _PART + 1, _PART))

    def walked(parts: Column) -> Column:
        ends = F.transform(parts, lambda part: F.aggregate(part, F.lit(neutral), lambda carried, row: step(carried, row)[0]))
        start = F.struct(F.lit(neutral).alias("carried"), F.array().cast("array<int>").alias("begins"))
        begins = F.aggregate(ends, start, lambda state, end: F.struct(join(state["carried"], end).alias("carried"), F.concat(state["begins"], F.array(state["carried"])).alias("begins")), lambda state: state["begins"])
        return F.flatten(F.zip_with(parts, begins, along))

    return _bind(_bind(rows, parted), walked)


def _matches(text: Column, pattern: str, kind: int, least: int = 0, group: int = 0) -> Column:
    """Spans of all matches of *pattern* whose *group* has *least* characters."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    rows = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("whole"), value.alias("value"))

    def step(at: Column, row: Column) -> tuple[Column, Column, Column]:
        begin = at + F.length(row["gap"])
        stop = begin + F.coalesce(F.length(row["whole"]), F.lit(0))
        keep = F.coalesce(F.length(row["value"]) >= least, F.lit(False))
        span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), stop.alias("stop"), (row["value"] if kind == len(BASE_KINDS) else F.lit(None).cast("string")).alias("value"))
        return stop, keep, span

    return _walk(rows, 0, lambda a, b: a + b, step)


def _apart(base: Column, candidates: Column) -> Column:
    """The candidates that overlap no base span: a pass forwards and one backwards."""
    is_base = lambda row: row["kind"] < len(BASE_KINDS)

    def ahead(reach: Column, row: Column) -> tuple[Column, Column, Column]:
        return F.when(is_base(row), F.greatest(reach, row["stop"])).otherwise(reach), is_base(row) | (row["start"] >= reach), row

    def back(reach: Column, row: Column) -> tuple[Column, Column, Column]:
        return F.when(is_base(row), row["start"]).otherwise(reach), ~is_base(row) & (row["stop"] <= reach), row

    forwards = _walk(F.array_sort(F.concat(base, candidates)), 0, F.greatest, ahead)
    return _walk(F.reverse(forwards), (1 << 31) - 1, F.least, back)


#: Counts are held 12 to a long, five bits each, from the character ``+`` on (up to ``z``).
_FIRST_CHAR, _PER_LONG, _LONGS = 43, 12, 7
_UNIT = 1 << 40


def _peak_entropy(value: Column) -> Column:
    """The highest entropy, in bits, of any WINDOW characters of a candidate string.

    The window's counts are carried along. As it moves on, the count of the character
    that leaves and of the one that enters change, and the sum of count * log2(count),
    in whole units of 2**-40, by what these two make.
    """
    weight = F.array(*[F.lit(round(c * math.log2(c) * _UNIT) if c else 0).cast("long") for c in range(WINDOW + 2)])

    def peak(codes: Column, weights: Column) -> Column:
        def held(counts: Column, code: Column) -> Column:
            return F.call_function("shiftright", F.get(counts, F.floor(code / _PER_LONG).cast("int")), (code % _PER_LONG) * 5).bitwiseAND(F.lit(31).cast("long")).cast("int")

        def one(code: Column, place: Column) -> Column:
            bit = F.call_function("shiftleft", F.lit(1).cast("long"), (code % _PER_LONG) * 5)
            return F.when(F.floor(code / _PER_LONG) == place, bit).otherwise(F.lit(0).cast("long"))

        def step(state: Column, i: Column) -> Column:
            enters, leaves = F.get(codes, i), F.get(codes, i - WINDOW)
            less = F.when(i >= WINDOW, F.transform(state["counts"], lambda c, place: c - one(leaves, place))).otherwise(state["counts"])
            old = F.when(i >= WINDOW, held(state["counts"], leaves)).otherwise(F.lit(1))  # a count of 1 weighs as much as none

            def enter(counts: Column) -> Column:
                now = held(counts, enters)
                total = state["sum"] + F.get(weights, old - 1) - F.get(weights, old) + F.get(weights, now + 1) - F.get(weights, now)
                least = F.when(i >= WINDOW - 1, F.least(state["least"], total)).otherwise(state["least"])
                return F.struct(F.transform(counts, lambda c, place: c + one(enters, place)).alias("counts"), total.alias("sum"), least.alias("least"))

            return _bind(less, enter)

        start = F.struct(F.array_repeat(F.lit(0).cast("long"), _LONGS).alias("counts"), F.lit(0).cast("long").alias("sum"), F.lit((1 << 63) - 1).alias("least"))
        lowest = F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), start, step, lambda state: state["least"])
        return F.lit(math.log2(WINDOW)) - lowest / F.lit(WINDOW * _UNIT)

    codes = F.transform(F.split(value, ""), lambda c: F.ascii(c) - _FIRST_CHAR)
    return _bind(codes, lambda c: _bind(weight, lambda w: peak(c, w)))


def looks_random(value: Column, allow: Sequence[str] = ()) -> Column:
    """Whether a candidate string reaches its class's entropy and isn't allowed."""
    need = F.lit(None).cast("double")
    for _, pattern, least in reversed(CLASSES):
        need = F.when(value.rlike(f"^(?:{pattern})$"), F.lit(least)).otherwise(need)
    allowed = F.lit(False)
    for pattern in ALLOW_PATTERNS:
        allowed = allowed | value.rlike(pattern)
    if allow:
        allowed = allowed | value.isin(list(allow))
    return F.when(need.isNull() | allowed, F.lit(False)).otherwise(_peak_entropy(value) >= need - 1e-9)


def base_spans(text: Column) -> Column:
    """Base spans of *text*, sorted by start."""
    return F.array_sort(
        F.concat(
            F.when(text.rlike(BASE_PATTERNS["assign"]), _matches(text, BASE_PATTERNS["assign"], 0, MIN_LENGTH["assign"], group=2)).otherwise(_none()),
            F.when(F.contains(text, F.lit("AKIA")), _matches(text, BASE_PATTERNS["access"], 1, MIN_LENGTH["access"])).otherwise(_none()),
            # Runs are maximal, so asking for 16 characters at once finds the same matches.
            F.when(text.rlike(r"[0-9a-f]{16}"), _matches(text, r"[0-9a-f]{16,}", 2)).otherwise(_none()),
        )
    )


def entropy_spans(text: Column, base: Column, allow: Sequence[str] = ()) -> Column:
    """Candidate strings of *text* apart from *base* that look random."""
    candidates = _apart(base, _matches(text, CANDIDATE, len(BASE_KINDS)))
    return F.when(text.rlike(CANDIDATE), F.filter(candidates, lambda s: looks_random(s["value"], allow))).otherwise(_none())


def scan(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", allow: Sequence[str] = ()) -> DataFrame:
    """Per row of *docs*: the id, counts by base kind, a digest of the base spans, all spans."""
    rows = docs.select(docs[id_col].alias(id_col), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    rows = rows.select(id_col, "text", base_spans(F.col("text")).alias("base"))
    rows = rows.select(id_col, "base", entropy_spans(F.col("text"), F.col("base"), allow).alias("added"))
    rows = rows.select(id_col, "base", F.array_sort(F.concat("base", "added")).alias("every"))
    name = F.array(*[F.lit(k) for k in KINDS])

    def joined(spans: str) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"], s["stop"])), ",")

    def number(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    counts = [number(k).alias(f"n_{kind}") for k, kind in enumerate(BASE_KINDS)]
    return rows.select(id_col, *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("every").alias("spans"))
