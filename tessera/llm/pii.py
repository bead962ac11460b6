"""Personal data by bootstrapped contextual extraction.

Strict patterns give the *seed* entities (e-mail, IPv4, payment card, phone).
Looser shapes of the same kinds give *candidates* that no strict span overlaps
(a phone without country code or with another number right behind it, an
address written ``name at host dot org``, an IPv6 address, a card beside other
digits; a card must still pass its checksum).  Each occurrence induces lexical
patterns (kind, before, after, shape) of several widths: the word before and
the word after together, each alone, the two words before, and the word before or
after with the shape of the identifier (digits and letters as classes).  A shape
without any context is no pattern.  A number counts as one word and the edge of
the text as another; a side left open is empty.

Patterns and instances (kind, normalised identifier) form a bipartite graph,
which Spark scores in rounds.  Seeds have confidence 1, candidates 0 at first.
A pattern's confidence is the mean confidence of its distinct instances, its
support the number of those that are seeds or believed (confidence at least
``min_confidence``).  A pattern with ``min_confidence`` and ``min_support`` is
accepted and lends its confidence to its candidates, by noisy-or over all
accepted patterns they occur in.  Candidates believed in one round support new
patterns in the next, also such that no seed occurs in.  Confidences only rise;
rounds end when none rises by more than ``REST`` and no pattern gains support.
Accepted patterns mark every candidate that occurs in them.

Texts are read twice: for the graph, and to mark.  Edges are counted before
they are shuffled, so a pattern that a third of all texts share is one row per
task and instance; joins along edges are salted, so no pattern or instance is
one task's alone.

Defined results: null and empty texts hold nothing, an empty table gives no
rows; spans are half-open code point ranges; overlapping kinds are all reported,
ordered by start, kind and end; a candidate that overlaps a strict span is not
one; repeated rows (null ids too) are processed row by row, and count once in
the graph; texts are processed whole in time linear in their length; other
columns pass through ``redact`` under any name, ``span_report`` returns its own
columns only.
"""

from __future__ import annotations

import hashlib
import ipaddress
import itertools
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.textbatch import map_slices, replace_column
from tessera.runtime import cut_lineage, release

KINDS = ("email", "ip", "card", "phone")
REST = 1e-9
MIN_CONFIDENCE = 0.9
MIN_SUPPORT = 5
PATTERN_BLOCK = 100_000
SALTS = 32

_DIGIT, _RUN, _LETTERS = re.compile("[0-9]"), re.compile("[0-9]+"), re.compile("[A-Za-z]+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only begin where a run of digits begins: it would have taken the digits before, and a match ends with its
# run. Saying so keeps long runs from being tried at every digit; said after the first digit, the search for one stays fast.
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Loose shapes of the same kinds; an address is looked for outwards from its "at".
_LOOSE_AT = re.compile(r"\x20?(?:\(at\)|\[at\]|@)\x20?|\x20at\x20")
_LOOSE_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:(?:\x20?(?:\(dot\)|\[dot\])\x20?|\x20dot\x20|\.)[A-Za-z0-9-]+)+")
_LOOSE = {
    "card": re.compile(r"(?<![0-9])(?:[0-9]{12,19}|[0-9]{4}([\x20.-])[0-9]{4}\1[0-9]{4}\1[0-9]{3,4}|[0-9]{4}([\x20.-])[0-9]{6}\2[0-9]{5})(?![0-9])"),
    "ip": re.compile(
        r"(?<![0-9.])[0-9]{1,3}(?:(?:\x20?(?:\[\.\]|\(\.\)|\[dot\]|\(dot\)|\.)\x20?|\x20dot\x20|-)[0-9]{1,3}){3}(?![0-9])"
    ),
    "phone": re.compile(r"(?<![0-9+])(?:\+[0-9]{1,3}[\x20.-])?\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,6}(?![0-9])"),
}
_MAY_BE_EMAIL = re.compile(r"@|\(at\)|\[at\]|\x20dot\x20|\(dot\)|\[dot\]")
_MAY_BE_IPV6 = re.compile(r":[0-9A-Fa-f]{0,4}:")
_IPV6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:])")
_NEXT = re.compile(r"\W*([^\W\d_]+|[\d_]+)")
#: Context words of their own: the edges of the text, a number, and a side left open.
BEGIN, END, NUMBER, OPEN = "^", "$", "0", ""


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if k % 2:
            v = v * 2 - 9 * (v > 4)
        total += v
    return total % 10 == 0


def _is_octet(digits: str) -> bool:
    short = digits.lstrip("0")
    return len(short) <= 3 and int(short or "0") <= 255


def _is_ipv6(text: str) -> bool:
    try:
        return len(text) > 2 and bool(ipaddress.IPv6Address(text))
    except ValueError:
        return False


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found outwards from each ``@`` so that no run is rescanned."""
    out, at, done = [], text.find("@"), 0
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        tail = _DOMAIN.match(text, at + 1) if begin < at else None
        done = tail.end() if tail else at + 1
        if tail:
            out.append((begin, done))
        at = text.find("@", done)
    return out


def strict_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the strict patterns, in order of start, then kind."""
    found = [("email", a, b) for a, b in emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(map(_is_octet, m[0].split("."))):
                found.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            digits = _digits(m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_digits(m[0])) <= 15:
                    found.append(("phone", *m.span()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def _loose_emails(text: str) -> list[tuple[int, int]]:
    out, done = [], 0
    for at in _LOOSE_AT.finditer(text):
        begin = at.start()
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        tail = _LOOSE_DOMAIN.match(text, at.end()) if begin < at.start() else None
        done = tail.end() if tail else at.end()
        if tail:
            out.append((begin, done))
    return out


def loose_spans(text: str, strict: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Candidates of the loose shapes that no strict span overlaps."""
    found = []
    if _MAY_BE_EMAIL.search(text):
        found += [("email", a, b) for a, b in _loose_emails(text)]
    if _DIGIT.search(text):
        for m in _LOOSE["card"].finditer(text):
            if luhn(_digits(m[0])):
                found.append(("card", *m.span()))
        for m in _LOOSE["ip"].finditer(text):
            if all(map(_is_octet, _RUN.findall(m[0]))):
                found.append(("ip", *m.span()))
        for m in _LOOSE["phone"].finditer(text):
            if 7 <= len(_digits(m[0])) <= 15:
                found.append(("phone", *m.span()))
    if _MAY_BE_IPV6.search(text):
        found += [("ip", *m.span()) for m in _IPV6.finditer(text) if _is_ipv6(m[0])]
    if not found:
        return []
    taken = sorted((a, b) for _, a, b in strict)
    out, k = [], 0
    for s in sorted(found, key=lambda s: (s[1], KINDS.index(s[0]))):
        while k < len(taken) and taken[k][1] <= s[1]:
            k += 1
        if k == len(taken) or taken[k][0] >= s[2]:
            out.append(s)
    return out


def _words_on(near: Callable[[int], tuple[str, bool]], edge: str, count: int) -> list[str]:
    """The first ``count`` words of what ``near`` gives in growing pieces, then the edge.

    ``near(n)`` is the next n characters and whether nothing follows them.
    """
    size = 64
    while True:
        piece, whole = near(size)
        out, at = [], 0
        while len(out) < count and (m := _NEXT.match(piece, at)) and (whole or m.end() < len(piece)):
            out.append(NUMBER if m[1][0] == "_" or m[1][0].isdigit() else m[1].lower())
            at = m.end()
        if len(out) == count:
            return out
        if whole:
            return [*out, edge]
        size *= 4


def context(text: str, begin: int, end: int) -> tuple[list[str], str]:
    """Lower-cased words before (nearest first, two at most) and the word after."""
    before = _words_on(lambda n: (text[max(0, begin - n) : begin][::-1], n >= begin), BEGIN, 2)
    after = _words_on(lambda n: (text[end : end + n], end + n >= len(text)), END, 1)
    return [w[::-1] for w in before], after[0]


def shape(kind: str, text: str) -> str:
    """Digits as 9 and letters as a; in addresses a run of a class is one character."""
    if kind in ("card", "phone"):
        return _DIGIT.sub("9", text)
    return _RUN.sub("9", _LETTERS.sub("a", text))


def induced(text: str, kind: str, begin: int, end: int) -> list[tuple[str, str, str]]:
    """Patterns (before, after, shape) of one occurrence, without repeats."""
    before, after = context(text, begin, end)
    near = before[0]
    form = shape(kind, text[begin:end])
    out = [(near, after, OPEN), (near, OPEN, OPEN), (OPEN, after, OPEN), (near, OPEN, form), (OPEN, after, form)]
    if len(before) == 2:
        out.append((f"{before[1]} {near}", OPEN, OPEN))
    return out


def normal_form(kind: str, text: str) -> str:
    if kind == "ip" and ":" in text:
        return ipaddress.IPv6Address(text).compressed
    if kind == "ip":
        return ".".join(_RUN.findall(text))
    return text.lower() if kind == "email" else _digits(text)


def render(spans: list[tuple[str, int, int]]) -> str:
    rank = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], rank[s[0]], s[2])))


PATTERN = ["kind", "before", "after", "shape"]
_EDGE = T.StructType([*[T.StructField(c, T.StringType()) for c in (*PATTERN, "instance")], T.StructField("seed", T.BooleanType())])


def occurrences(docs: DataFrame, text_col: str) -> DataFrame:
    """A row for each strict or loose span and each pattern it induces, once for a batch."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = set()
        for text in batch.column(0).to_pylist():
            if not text:
                continue
            strict = strict_spans(text)
            for seed, spans in ((True, strict), (False, loose_spans(text, strict))):
                for kind, a, b in spans:
                    instance = hashlib.sha256(normal_form(kind, text[a:b]).encode()).hexdigest()[:32]
                    rows.update((kind, *p, instance, seed) for p in induced(text, kind, a, b))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
        types = [pa.string()] * 5 + [pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=_EDGE.names)

    return docs.select(text_col).mapInArrow(map_slices(text_col, work), _EDGE)


def noisy_or(confidence: Column) -> Column:
    return 1 - F.exp(F.sum(F.log1p(-F.least(confidence, F.lit(0.999)))))


def _along(edges: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Edges with the columns of their nodes; each node's edges are dealt over ``SALTS`` parts."""
    salted = nodes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return edges.join(salted, [*keys, "salt"])


def score_patterns(
    edges: DataFrame,
    *,
    rounds: int | None = None,
    min_confidence: float = MIN_CONFIDENCE,
    min_support: int = MIN_SUPPORT,
) -> DataFrame:
    """Patterns with confidence, support, number of candidates and ``accepted``, when all rest (or after ``rounds``).

    Patterns without any candidate that also lack the support are left out: they
    can neither be accepted nor lend anything.
    """
    graph = cut_lineage(edges.groupBy(*PATTERN, "instance").agg(F.max("seed").alias("seed")))
    known = graph.groupBy(*PATTERN).agg(F.count_if("seed").alias("seeds"), F.count(F.lit(1)).alias("instances"))
    known = cut_lineage(
        known.withColumn("candidates", F.col("instances") - F.col("seeds")).where((F.col("candidates") > 0) | (F.col("seeds") >= min_support))
    )
    # The salt of an edge comes from its other end as a whole, so edges of one node differ in it.
    salt = F.pmod(F.xxhash64(*PATTERN, "instance"), F.lit(SALTS)).cast("int")
    unseen = cut_lineage(graph.where(~F.col("seed")).select(*PATTERN, "instance", salt.alias("salt")))
    accepted = (F.col("confidence") >= min_confidence) & (F.col("support") >= min_support)
    patterns = known.select(*PATTERN, "candidates", F.col("seeds").alias("support"), (F.col("seeds") / F.col("instances")).alias("confidence"))
    before = None
    for _ in itertools.count() if rounds is None else range(rounds):
        lending = patterns.where(accepted & (F.col("candidates") > 0)).select(*PATTERN, "confidence")
        believed = _along(unseen, lending, PATTERN).groupBy("kind", "instance").agg(noisy_or(F.col("confidence")).alias("belief"))
        gained = (
            _along(unseen, believed, ["kind", "instance"])
            .groupBy(*PATTERN)
            .agg(F.sum("belief").alias("gained"), F.count_if(F.col("belief") >= min_confidence).alias("more"))
        )
        patterns = cut_lineage(
            known.join(gained, PATTERN, "left").select(
                *PATTERN,
                "candidates",
                (F.col("seeds") + F.coalesce("more", F.lit(0))).alias("support"),
                ((F.col("seeds") + F.coalesce("gained", F.lit(0.0))) / F.col("instances")).alias("confidence"),
            )
        )
        if before is not None:
            # Only patterns with candidates can change; none is ever lost.
            old = before.where("candidates > 0").select(*PATTERN, F.col("support").alias("old_support"), F.col("confidence").alias("old_confidence"))
            rising = (F.col("support") > F.col("old_support")) | (F.col("confidence") > F.col("old_confidence") + REST)
            rests = patterns.join(old, PATTERN).where(rising).isEmpty()
            release(before)
            if rests:
                break
        before = patterns
    return patterns.withColumn("accepted", accepted)


def accepted_blocks(patterns: DataFrame, block: int = PATTERN_BLOCK) -> list[frozenset]:
    """Accepted patterns with candidates, in sets of about ``block``, the bound of one broadcast."""
    kept = cut_lineage(patterns.where(F.col("accepted") & (F.col("candidates") > 0)).select(*PATTERN))
    total = kept.count()
    blocks = -(-total // block)
    return [
        frozenset(tuple(r) for r in kept.where(F.pmod(F.xxhash64(*PATTERN), F.lit(blocks)) == k).toLocalIterator())
        for k in range(blocks)
    ]


def learn(docs: DataFrame, *, text_col: str = "text", **options) -> list[frozenset]:
    """Accepted context patterns of all of ``docs``."""
    return accepted_blocks(score_patterns(occurrences(docs, text_col), **options))


def all_spans(text: str, blocks: list) -> tuple[list, list]:
    """Strict spans, and the candidates that stand in an accepted context."""
    strict = strict_spans(text)
    more = []
    if blocks:
        for kind, a, b in loose_spans(text, strict):
            around = induced(text, kind, a, b)
            if any((kind, *p) in block.value for block in blocks for p in around):
                more.append((kind, a, b))
    return strict, more


def span_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per document: strict counts by kind, their digest, and all spans."""
    source = docs.select(id_col, text_col)
    context_ = docs.sparkSession.sparkContext
    blocks = [context_.broadcast(b) for b in learn(source, text_col=text_col, **options)]
    names = [f"n_{k}" for k in KINDS]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, digests, spans = [], [], []
        for text in batch.column(text_col).to_pylist():
            strict, more = all_spans(text or "", blocks)
            counts.append([sum(s[0] == k for s in strict) for k in KINDS])
            digests.append(hashlib.sha256(render(strict).encode()).hexdigest())
            spans.append(render([*strict, *more]))
        return pa.RecordBatch.from_arrays(
            [batch.column(id_col), *[pa.array([c[i] for c in counts], pa.int64()) for i in range(4)], pa.array(digests), pa.array(spans)],
            names=[id_col, *names, "base_sha256", "spans"],
        )

    schema = T.StructType(
        [source.schema[id_col], *[T.StructField(n, T.LongType()) for n in names], T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
    )
    return source.mapInArrow(map_slices(text_col, work), schema)


def redact(docs: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets, e.g. ``[EMAIL]``.

    Overlapping spans are replaced together, by the kind that begins first.
    """
    context_ = docs.sparkSession.sparkContext
    blocks = [context_.broadcast(b) for b in learn(docs, text_col=text_col, **options)]

    def clean(text: str | None) -> str | None:
        strict, more = all_spans(text or "", blocks)
        if not strict and not more:
            return text
        out, at = [], 0
        for kind, a, b in sorted([*strict, *more], key=lambda s: (s[1], -s[2])):
            if a >= at:
                out += [text[at:a], f"[{kind.upper()}]"]
            at = max(at, b)
        return "".join([*out, text[at:]])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(text_col).to_pylist()
        return replace_column(batch, text_col, pa.array(list(map(clean, texts)), type=pa.string()))

    return docs.mapInArrow(map_slices(text_col, work), docs.schema)
