"""Secret scans: fixed patterns, and sliding-window entropy of candidate strings. DataFrame functions only."""

from __future__ import annotations

import math
from pyspark.sql import Column, DataFrame, functions as F

from kerbline.llm.common import column, free_name, let

# Fixed values of the contract: kinds in their order, pattern, group whose length counts, least length.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (("assign", ASSIGN, 2, 8), ("access", "AKIA[A-Z0-9]+", 0, 16), ("hex", "[0-9a-f]{32,}", 0, 32))

WINDOW = 20
CANDIDATE = f"[A-Za-z0-9+/_=-]{{{WINDOW},}}"
#: Character classes by the first pattern that a whole candidate matches, and the least entropy in bits of a window.
CLASSES = (("hex", "^[0-9A-Fa-f]+$", 3.0), ("alphanumeric", "^[0-9A-Za-z]+$", 3.7), ("base64", "", 3.85))
#: Candidates that any of these finds are no secrets: counting sequences, words for examples, UUIDs, and plain words or
#: numbers joined by one separator each (paths, slugs, dates, dotted names).
ALLOWED = (
    "0123456789|1234567890|abcdefghij|ABCDEFGHIJ|(.)\\1{7}",
    "(?i)example|sample|dummy|placeholder|changeme|your[-_]",
    "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "^[-+/_=]*(?:[A-Za-z]+|[0-9]+)(?:[-+/_=]+(?:[A-Za-z]+|[0-9]+))*[-+/_=]*$",
)
#: Long candidates are cut into pieces of so many windows that overlap by a window less one character: none is lost.
_PIECE = 256
_SCALE = 1 << 20
#: c * log2(c) of a count, as whole numbers, so that sums are exact in any order.
_TERMS = [0] + [round(c * math.log2(c) * _SCALE) for c in range(1, WINDOW + 1)]
SPAN = "struct<start:int,end:int,kind:string,nth:int>"


def _bound(bits: float) -> int:
    """The largest sum of count terms at which a window has at least ``bits`` of entropy."""
    return math.floor((math.log2(WINDOW) - bits) * WINDOW * _SCALE)


def _found(text: Column, pattern: str, group: int) -> Column:
    """``start, end, whole, value`` of every match, leftmost and not overlapping, in code points.

    Matches and the pieces between them come from the same search, so running lengths give the places.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    places = F.aggregate(
        F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("whole"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value")),
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int,whole:string,value:string>>)").alias("out")),
        lambda acc, x: let(acc["at"] + F.char_length(x["gap"]), lambda start: F.struct(
            (start + F.coalesce(F.char_length(x["whole"]), F.lit(0))).alias("at"),
            F.when(x["whole"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(
                start.alias("start"), (start + F.char_length(x["whole"])).alias("end"), x["whole"].alias("whole"), x["value"].alias("value"))))).alias("out"))),
        lambda acc: acc["out"])
    # Most texts have no match and are searched once only.
    return F.when(text.rlike(pattern), places).otherwise(F.expr("cast(array() as array<struct<start:int,end:int,whole:string,value:string>>)"))


def _count(s: Column, c: Column) -> Column:
    return F.char_length(s) - F.char_length(F.replace(s, c, F.lit("")))


def _term(count: Column) -> Column:
    return F.element_at(F.lit(_TERMS), (count + 1).cast("int"))


def _least_sum(candidate: Column) -> Column:
    """The least sum of count terms over the windows of a candidate: where entropy is highest.

    The first window of a piece is counted whole. Each next one drops a character and takes one: only the terms of these
    two counts change, and both are counted in the part that the windows share.
    """

    def first(piece: Column) -> Column:
        return let(F.substr(piece, F.lit(1), F.lit(WINDOW)), lambda w: F.aggregate(
            F.array_distinct(F.split(w, "")), F.lit(0).cast("long"), lambda s, c: s + F.when(c == "", F.lit(0)).otherwise(_term(_count(w, c)))))

    def slide(piece: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            kept = F.substr(piece, i + 1, F.lit(WINDOW - 1))
            return let(F.struct(_count(kept, F.substr(piece, i, F.lit(1))).alias("gone"), _count(kept, F.substr(piece, i + WINDOW, F.lit(1))).alias("new")), lambda n: let(
                acc["now"] - _term(n["gone"] + 1) + _term(n["gone"]) + _term(n["new"] + 1) - _term(n["new"]),
                lambda now: F.struct(now.alias("now"), F.least(acc["least"], now).alias("least"))))

        steps = F.filter(F.sequence(F.lit(0), F.char_length(piece) - WINDOW), lambda i: i > 0)
        return let(first(piece), lambda s: F.aggregate(steps, F.struct(s.alias("now"), s.alias("least")), step, lambda acc: acc["least"]))

    pieces = F.transform(F.sequence(F.lit(0), F.char_length(candidate) - WINDOW, F.lit(_PIECE)), lambda o: F.substr(candidate, o + 1, F.lit(_PIECE + WINDOW - 1)))
    return F.array_min(F.transform(pieces, slide))


def _high_entropy(candidate: Column, allowed: tuple[str, ...]) -> Column:
    worth = candidate.rlike("[0-9]") & candidate.rlike("[A-Za-z]")
    for pattern in allowed:
        worth = worth & ~candidate.rlike(pattern)
    bound = F.lit(_bound(CLASSES[-1][2]))
    for _, pattern, bits in reversed(CLASSES[:-1]):
        bound = F.when(candidate.rlike(pattern), F.lit(_bound(bits))).otherwise(bound)
    return F.when(worth, _least_sum(candidate) <= bound).otherwise(F.lit(False))


def _kept(hits: Column, kind: str, nth: int, least: int) -> Column:
    return F.transform(F.filter(hits, lambda x: F.char_length(x["value"]) >= least), lambda x: F.struct(
        x["start"].alias("start"), x["end"].alias("end"), F.lit(kind).alias("kind"), F.lit(nth).alias("nth")))


def scan(docs: DataFrame, text: str = "text", spans: str = "spans", allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """``docs`` with ``spans``: an array of ``(start, end, kind, nth)`` by start, then kind.

    Places count code points, ends are exclusive. Kinds ``assign``, ``access`` and ``hex`` are the fixed patterns (``nth`` 1
    to 3) and always stay. Kind ``entropy`` (``nth`` 4) is a run of at least 20 letters, digits and ``+/_=-``, with a digit
    and a letter, that overlaps none of them, matches no pattern of ``allowed``, and has a window of 20 characters with at
    least the entropy set for its character class. Null and empty texts have no spans; texts are scanned whole.
    """
    if spans.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"column {spans} exists already; pass another name")
    body = F.coalesce(column(text), F.lit(""))
    base = F.expr(f"cast(array() as array<{SPAN}>)")
    for nth, (kind, pattern, group, least) in enumerate(BASE, 1):
        base = F.concat(base, _kept(_found(body, pattern, group), kind, nth, least))
    tokens = F.filter(_found(body, CANDIDATE, 0), lambda x: _high_entropy(x["whole"], allowed))
    more = F.transform(tokens, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit("entropy").alias("kind"), F.lit(4).alias("nth")))
    both = let(F.struct(base.alias("base"), more.alias("more")), lambda s: F.concat(s["base"], F.filter(
        s["more"], lambda m: ~F.exists(s["base"], lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))))
    by_place = F.transform(F.array_sort(F.transform(both, lambda x: F.struct(x["start"].alias("start"), x["nth"].alias("nth"), x["end"].alias("end"), x["kind"].alias("kind")))),
                           lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), x["nth"].alias("nth")))
    return docs.withColumn(spans, by_place)


def listed(spans: Column) -> Column:
    """``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", length: str | None = None, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """``docs`` with every found span of ``text`` replaced by ``mark``; overlapping spans share one mark.

    Texts without spans, empty and null ones stay as they are. The column ``length``, if named, gets the new number of code
    points where a text changed. No row is dropped.
    """
    found = free_name(docs, "found_spans")
    body = column(text)
    clean = F.aggregate(
        column(found), F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda acc, x: F.struct(
            F.when(x["start"] >= acc["at"], F.concat(acc["out"], F.substr(body, acc["at"] + 1, x["start"] - acc["at"]), F.lit(mark))).otherwise(acc["out"]).alias("out"),
            F.greatest(acc["at"], x["end"]).alias("at")),
        lambda acc: F.concat(acc["out"], F.substr(body, acc["at"] + 1)))
    # The clean text gets a name of its own first: a select that names it ``text`` again would lend that name to its other columns.
    fresh = free_name(docs, "clean_text")
    hit = F.size(column(found)) > 0
    out = scan(docs, text, found, allowed).withColumn(fresh, F.when(hit, clean).otherwise(body))
    if length is not None:
        out = out.withColumn(length, F.when(hit, F.char_length(column(fresh)).cast(docs.schema[length].dataType)).otherwise(column(length)))
    return out.withColumn(text, column(fresh)).select(*[column(c) for c in docs.columns])
