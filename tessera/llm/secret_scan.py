"""Secret scanning with DataFrame functions only.

Strict patterns (assignments, access keys, long hexadecimal runs) are found
with built-in regular expression functions; positions follow from the lengths
of the pieces between matches, summed in blocks so that time stays linear.  The
method adds candidate strings of high entropy outside assignments: for each
character class (hexadecimal, alphanumeric, base64) a window slides over the
candidate and its Shannon entropy is kept by incremental counts: a character
that enters or leaves changes one count and one term of sum(c*log2(c)).  The
largest window entropy is compared with the threshold of the class.  An
allow-list suppresses placeholders, UUIDs, strings without both letters and
digits, and paths and options made of words and numbers.

Defined results: null and empty texts hold nothing, an empty table gives no
rows; spans are half-open code point ranges, ordered by start, kind and end; a
candidate that holds a strict access key or hexadecimal run is not reported
again; an entropy equal to its threshold counts; repeated rows (null ids too)
are processed row by row; texts are processed whole, in time about linear in
their length; ``find_secrets`` and ``mask_secrets`` keep all other columns,
whatever their names (an existing ``out_col`` is replaced), ``secret_report``
returns its own columns only.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.columns import before, let, nothing
from tessera.llm.textbatch import fresh

WINDOW = 20
#: Code points of one piece of text when texts are put together again.
PIECE = 1024

# The strict patterns.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 12, 18, 16

#: Every strict match that counts contains a match of these (used to skip clean texts early).
_MAY_ASSIGN = r"""(?=[PSTApsta])(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
_MAY_RUN = r"[A-Za-z0-9+/_=-]{16}"
#: Leftmost runs of at least the length that counts are the leftmost runs of any length that have it.
_LONG_ACCESS, _LONG_HEX = rf"AKIA[A-Z0-9]{{{MIN_ACCESS - 4},}}", rf"[0-9a-f]{{{MIN_HEX},}}"
_CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{WINDOW},}}"

#: Entropy in bits over one window that a string of the class must exceed.
THRESHOLDS = {"hex": 3.0, "alnum": 3.6, "base64": 3.8}
ALLOW = (
    r"(?i)example|sample|placeholder|changeme|your[_-]|xxxx|0123456789|abcdefgh|^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"
    r"|^[^0-9]*$|^[^A-Za-z]*$"
    # Paths and options: no letter after a digit and no lone small letter before a capital, which random strings hold.
    r"|^(?=[/_=+-]|(?:[^/]*+/){3})(?-i:(?!.*(?:[0-9][A-Za-z]|(?<![a-z])[a-z][A-Z])))"
)
KINDS = ("assign", "access", "hex", "entropy")


_SPANS = "array<struct<a:int,b:int,s:string>>"


def _place(matches: Column) -> Column:
    """Structs (a, b, s) of matches given as structs (gap, s): the length before each match, and its text."""

    def put(all_: Column) -> Column:
        ends = before(F.transform(all_, lambda m: m["gap"] + F.length(m["s"])), 0, lambda x, y: x + y)
        return F.zip_with(all_, ends, lambda m, at: F.struct((at + m["gap"]).alias("a"), (at + m["gap"] + F.length(m["s"])).alias("b"), m["s"].alias("s")))

    return let(matches, put)


def located(text: Column, pattern: str) -> Column:
    """All leftmost matches as structs (a, b, s): code point range and text."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def places(found: Column) -> Column:
        zipped = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), found, lambda g, w: F.struct(F.length(g).alias("gap"), w.alias("s")))
        return F.when(F.size(found) > 0, _place(zipped)).otherwise(nothing(_SPANS))

    return let(whole, places)


def window_entropy(s: Column, window: int = WINDOW) -> Column:
    """Largest Shannon entropy, in bits, of any ``window`` consecutive ASCII characters.

    The counts are a string with a character for each ASCII code; the one that
    enters and the one that leaves are changed when the window moves.  Null if
    ``s`` is shorter than the window.
    """
    zero = 48  # the character that stands for a count of none
    weight = lambda c: F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(0.0)
    count = lambda n, code: F.ascii(F.substring(n, code + 1, F.lit(1))) - zero
    change = lambda n, code, c: F.overlay(n, F.chr(c + zero), code + 1, F.lit(1))
    state = F.struct(F.lit(chr(zero) * 128).alias("n"), F.lit(0.0).alias("f"), F.lit(1e9).alias("low"))

    def leave(acc: Column, code: Column) -> Column:
        def gone(c: Column) -> Column:
            return F.struct(change(acc["n"], code, c - 1).alias("n"), (acc["f"] + weight(c - 1) - weight(c)).alias("f"), acc["low"].alias("low"))

        return F.when(code < 0, acc).otherwise(let(count(acc["n"], code), gone))

    def enter(acc: Column, code: Column, full: Column) -> Column:
        def come(c: Column) -> Column:
            f = acc["f"] + weight(c + 1) - weight(c)
            return F.struct(change(acc["n"], code, c + 1).alias("n"), f.alias("f"), F.when(full, F.least(acc["low"], f)).otherwise(acc["low"]).alias("low"))

        return let(count(acc["n"], code), come)

    def best(codes: Column) -> Column:
        leaving = F.concat(F.array_repeat(F.lit(-1), window), codes)
        moves = F.transform(
            F.arrays_zip(codes.alias("come"), F.slice(leaving, F.lit(1), F.size(codes)).alias("go")),
            lambda x, i: F.struct(x["come"].alias("come"), x["go"].alias("go"), (i >= window - 1).alias("full")),
        )
        step = lambda acc, x: let(leave(acc, x["go"]), lambda kept: enter(kept, x["come"], x["full"]))
        return F.aggregate(moves, state, step, lambda acc: F.lit(math.log2(window)) - acc["low"] / window)

    codes = F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.ascii(c))
    return F.when(F.length(s) >= window, let(codes, best))


def char_class(s: Column) -> Column:
    return F.when(s.rlike("^[0-9a-fA-F-]+$"), "hex").when(s.rlike("^[A-Za-z0-9]+$"), "alnum").otherwise("base64")


def find_secrets(docs: DataFrame, *, text_col: str = "text", out_col: str = "secrets") -> DataFrame:
    """``docs`` with an array of structs (kind, a, b): strict and entropy spans."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    taken = [*docs.columns, out_col]
    assigns, rest, run = (fresh(taken, n) for n in ("assigns", "rest", "run"))
    tag = lambda kind, spans: F.transform(spans, lambda x: F.struct(F.lit(kind).alias("kind"), x["a"].alias("a"), x["b"].alias("b")))
    none = nothing(_SPANS)
    may_assign = (F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))) & text.rlike(_MAY_ASSIGN)
    long_enough = lambda x: F.length(F.regexp_extract(x["s"], ASSIGN, 2)) >= MIN_ASSIGN
    found = docs.withColumns({assigns: F.when(may_assign, F.filter(located(text, ASSIGN), long_enough)).otherwise(none), run: text.rlike(_MAY_RUN)})
    # Assignments are blanked out, so that no candidate overlaps one and positions stay.
    blank = lambda m: F.concat(m["gap"], F.repeat(F.lit(" "), F.length(m["s"])))
    blanked = F.when(F.size(assigns) > 0, let(_gaps(text, F.col(assigns)), lambda g: F.concat(F.array_join(F.transform(g["pieces"], blank), ""), g["tail"])))
    found = found.withColumn(rest, F.coalesce(blanked, text))
    strict = [
        tag("assign", F.col(assigns)),
        tag("access", F.when(F.col(run) & F.contains(text, F.lit("AKIA")), located(text, _LONG_ACCESS)).otherwise(none)),
        tag("hex", F.when(F.col(run) & text.rlike(_LONG_HEX), located(text, _LONG_HEX)).otherwise(none)),
    ]
    # Only the candidates that are left are measured.
    limit = F.create_map(*[F.lit(x) for pair in THRESHOLDS.items() for x in pair])
    secret = F.filter(
        F.when(F.col(run) & F.col(rest).rlike(_CANDIDATE), located(F.col(rest), _CANDIDATE)).otherwise(none),
        lambda c: ~c["s"].rlike(f"{_LONG_ACCESS}|{_LONG_HEX}") & ~c["s"].rlike(ALLOW) & (window_entropy(c["s"]) >= F.element_at(limit, char_class(c["s"]))),
    )
    return found.withColumn(out_col, F.concat(*strict, tag("entropy", secret))).drop(assigns, rest, run)


def _gaps(text: Column, spans: Column) -> Column:
    """Struct (pieces, tail): text before each of the disjoint ordered spans (a, b, s), with s, and text behind the last.

    The text is cut into pieces first, so that no part of it is passed over for every span.
    """
    chunks = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0))

    def part(all_: Column, a: Column, b: Column) -> Column:
        first = F.floor(a / PIECE).cast("int")
        count = F.floor((b - 1) / PIECE).cast("int") - first + 1
        cut = F.transform(
            F.slice(all_, first + 1, count),
            lambda c, i: let((first + i) * PIECE, lambda at: F.substring(c, F.greatest(a - at, F.lit(0)) + 1, F.least(b - at, F.lit(PIECE)) - F.greatest(a - at, F.lit(0)))),
        )
        return F.when(b > a, F.array_join(cut, "")).otherwise("")

    def whole(v: Column) -> Column:
        ends = F.concat(F.array(F.lit(0)), F.transform(v["spans"], lambda x: x["b"]))
        pieces = F.zip_with(
            F.slice(ends, F.lit(1), F.size(v["spans"])), v["spans"], lambda from_, x: F.struct(part(v["chunks"], from_, x["a"]).alias("gap"), x["s"].alias("s"))
        )
        return F.struct(pieces.alias("pieces"), part(v["chunks"], F.element_at(ends, -1), F.length(text)).alias("tail"))

    return let(F.struct(chunks.alias("chunks"), spans.alias("spans")), whole)


def render(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    rank = lambda k: F.array_position(F.lit(list(KINDS)), k)
    keyed = F.transform(spans, lambda x: F.struct(x["a"], rank(x["kind"]), x["b"], x["kind"].alias("kind")))
    return F.array_join(
        F.transform(F.array_sort(keyed), lambda x: F.concat_ws(":", x["kind"], x["a"].cast("string"), x["b"].cast("string"))), ","
    )


def _of_kind(kind: str) -> Callable[[Column], Column]:
    return lambda x: x["kind"] == kind


def secret_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: strict counts by kind, their digest, and all spans."""
    spans = fresh([id_col, text_col], "spans")
    found = find_secrets(docs.select(id_col, text_col), text_col=text_col, out_col=spans).drop(text_col)
    strict = F.filter(spans, lambda x: x["kind"] != "entropy")
    counts = [F.size(F.filter(spans, _of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return found.select(
        id_col, *counts, F.sha2(render(strict).cast("binary"), 256).alias("base_sha256"), render(F.col(spans)).alias("spans")
    )


def _merged(spans: Column) -> Column:
    """Disjoint ordered structs (a, b, s) that cover the same places; s is empty."""
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"))))

    def heads(all_: Column) -> Column:
        """Spans that begin at or behind the end of all before, with that end."""
        covered = before(F.transform(all_, lambda x: x["b"]), 0, F.greatest)
        zipped = F.zip_with(all_, covered, lambda x, m: F.struct(x["a"].alias("a"), m.alias("m")))
        return F.struct(F.filter(zipped, lambda x: x["a"] >= x["m"]).alias("heads"), F.array_max(F.transform(all_, lambda x: x["b"])).alias("end"))

    def close(v: Column) -> Column:
        ends = F.concat(F.transform(F.slice(v["heads"], F.lit(2), F.size(v["heads"])), lambda x: x["m"]), F.array(v["end"]))
        return F.zip_with(v["heads"], ends, lambda x, b: F.struct(x["a"].alias("a"), b.alias("b"), F.lit("").alias("s")))

    return F.when(F.size(spans) > 0, let(let(ordered, heads), close)).otherwise(nothing(_SPANS))


def mask_secrets(docs: DataFrame, *, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span replaced; overlapping spans are replaced together."""
    spans = fresh(docs.columns, "spans")
    found = find_secrets(docs, text_col=text_col, out_col=spans)
    text = F.col(text_col)
    masked = lambda g: F.concat(F.array_join(F.transform(g["pieces"], lambda m: F.concat(m["gap"], F.lit(mask))), ""), g["tail"])
    return found.withColumn(text_col, F.when(F.size(spans) > 0, let(_gaps(text, _merged(F.col(spans))), masked)).otherwise(text)).drop(spans)
