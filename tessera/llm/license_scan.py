"""License scanning with DataFrame functions only: an exact set-similarity join.

Phrases are located word by word.  The method joins text blocks with license
notice templates on token sets.  The blocks of a template are all windows of
``SPAN`` times its words over the whole normalised text, whatever its line
breaks; block and template match if the block holds at least ``threshold`` of
the template's distinct tokens.  Tokens are ordered from rare to frequent by
their document frequency in the whole corpus.  With k = ceil(threshold *
tokens) needed, a matching block must hold one of the template's first
``tokens - k + 1`` tokens (prefix filter), so only the surroundings of these are
looked at.  They must hold k of the template's tokens (length filter) from the
shared one on (positional filter: it is the first one shared by some window).
What passes is verified window by window, so the result is exact.

The templates are a constant of this module and stand in the plan as a literal
map from prefix tokens, so a row is joined with them where it is read: nothing
is shuffled but the document frequencies of the templates' tokens.

Defined results: null and empty texts have no words and no labels, an empty
table gives no rows; words are runs of digits, a-z and characters beyond ASCII
after lower-casing A-Z, and nothing else is folded; every row is judged by its
own text, so rows with null or repeated ids are like others; equal containments
of several windows keep the last window around a token; a score is the best
containment of any template (0 without a shared prefix token); texts are
processed whole, in time about linear in their length; other columns are not
returned by ``license_report`` and are kept, whatever their names, by
``match_blocks`` (an existing ``out_col`` is replaced).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.columns import before, let, nothing
from tessera.llm.textbatch import fresh

# Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Wording of public license notices, as normalised words.
TEMPLATES = {
    "gpl": [
        "this work is licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    ],
    "lgpl": ["this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"],
    "apache": [
        "licensed under the apache license version 2 0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    ],
    "cc-by": [
        "licensed under cc by 4 0",
        "this work is licensed under a creative commons attribution 4 0 international license",
    ],
    "cc-by-nc": ["licensed under cc by nc 4 0"],
    "cc-by-sa": ["licensed under cc by sa 4 0"],
    "mit": [
        "released under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    ],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "mpl": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
}
THRESHOLD = 0.9
#: Words of a block for each word of the template; the rest is room for inserted words.
SPAN = 1.5
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def normalised(text: Column) -> Column:
    """Words with one space before, between and after; a lone space if none."""
    # Of all characters beyond ASCII, lower() makes a letter a-z of the Kelvin sign alone; what it makes of others
    # stays beyond ASCII (in whole or in part), so no phrase or template can tell. This is much faster than translate().
    folded = F.lower(F.replace(text, F.lit("\u212a"), F.lit("\u212b")))
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(folded, SEPARATORS, " ")), F.lit(" "))


def template_rows() -> list[tuple[int, str, str]]:
    return [(i, label, words) for i, (label, words) in enumerate((k, w) for k, v in TEMPLATES.items() for w in v)]


def vocabulary() -> list[str]:
    return sorted({w for _, _, words in template_rows() for w in words.split()})


def document_frequency(words: Column, tokens: list[str], docs: DataFrame) -> dict[str, int]:
    """In how many texts of ``docs`` each of ``tokens`` occurs, over all texts."""
    held = F.array_intersect(F.split(F.trim(words), " "), F.lit(tokens))
    rows = docs.select(F.explode(held).alias("token")).groupBy("token").count().collect()  # a row for each token at most
    return dict.fromkeys(tokens, 0) | {r[0]: r[1] for r in rows}


def phrase_places(words: Column, phrase: str) -> Column:
    """Word positions at which ``phrase`` begins."""
    size = len(phrase.split())
    spaces = lambda s: F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))

    def places(gaps: Column) -> Column:
        inner = F.transform(F.slice(gaps, F.lit(1), F.size(gaps) - 1), spaces)
        put = lambda own: F.zip_with(own, before(F.transform(own, lambda n: n + size - 1), 0, lambda x, y: x + y), lambda n, at: at + n - 1)
        return let(inner, put)

    found = let(F.split(words, f"(?<= ){phrase}(?= )", -1), places)
    return F.when(F.contains(words, F.lit(f" {phrase} ")), found).otherwise(nothing("array<int>"))


MATCH = "array<struct<block:int,template:int,label:string,containment:double>>"


def match_blocks(docs: DataFrame, *, text_col: str = "text", out_col: str = "matches", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with an array of matching windows (block, template, label, containment).

    ``block`` is the window's first word.  Around each shared prefix token the
    best window is returned.
    """
    held = fresh([*docs.columns, out_col], "words")
    source = docs.withColumn(held, normalised(F.coalesce(F.col(text_col), F.lit(""))))
    return _with_matches(source, held, out_col, threshold).drop(held)


def _with_matches(docs: DataFrame, held: str, out_col: str, threshold: float) -> DataFrame:
    """``match_blocks`` over texts already normalised in the column ``held``."""
    tokens = vocabulary()
    frequency = document_frequency(F.col("w"), tokens, docs.select(F.col(held).alias("w")))
    order = {t: i for i, t in enumerate(sorted(tokens, key=lambda t: (frequency[t], t)))}
    prefix: dict[str, list[Column]] = {}
    reach = 0
    for i, label, text in template_rows():
        own = sorted(set(text.split()), key=order.get)
        need = math.ceil(threshold * len(own) - 1e-9)
        span = math.ceil(SPAN * len(text.split()))
        reach = max(reach, span)
        for at, token in enumerate(own[: len(own) - need + 1]):
            fields = {"rest": own[at:], "template": i, "label": label, "own": own, "need": need, "span": span}
            prefix.setdefault(token, []).append(F.struct(*[F.lit(v).alias(k) for k, v in fields.items()]))
    rare = sorted(prefix, key=order.get)
    table = F.create_map(*[x for t in rare for x in (F.lit(t), F.array(*prefix[t]))])

    def probe(w: Column) -> Column:
        places = F.filter(F.transform(w, lambda t, i: F.struct(i.alias("at"), t.alias("token"))), lambda x: x["token"].isin(rare))
        return F.flatten(F.transform(places, lambda x: around(w, x["at"], F.element_at(table, x["token"]))))

    def around(w: Column, at: Column, templates: Column) -> Column:
        """Best window of each template whose prefix holds the word at ``at``."""

        def pick(t: Column) -> Column:
            low = F.greatest(at - (t["span"] - 1), F.lit(0))
            high = F.least(at + t["span"], F.size(w)) - 1
            near = F.transform(F.sequence(low, high), lambda k: F.get(w, k))
            return let(near, lambda n: best(n, low, t))

        def best(near: Column, low: Column, t: Column) -> Column:
            windows = F.transform(
                F.sequence(F.lit(0), at - low), lambda k: F.struct(F.size(F.array_intersect(F.slice(near, k + 1, t["span"]), t["own"])).alias("n"), k.alias("k"))
            )
            passed = F.size(F.array_intersect(near, t["rest"])) >= t["need"]
            return F.when(passed, let(F.array_max(windows), lambda m: found(m, low, t))).otherwise(nothing(MATCH))

        def found(m: Column, low: Column, t: Column) -> Column:
            one = F.struct((low + m["k"]).alias("block"), t["template"].alias("template"), t["label"].alias("label"), (m["n"] / F.size(t["own"])).alias("containment"))
            return F.when(m["n"] >= t["need"], F.array(one)).otherwise(nothing(MATCH))

        return F.flatten(F.transform(templates, pick))

    any_rare = " (" + "|".join(rare) + ") "
    matches = F.array_distinct(let(F.split(F.trim(held), " "), probe))
    return docs.withColumn(out_col, F.when(F.col(held).rlike(any_rare), matches).otherwise(nothing(MATCH)))


def license_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: words, phrase places, phrase labels, all labels and a score.

    The score is the best containment, or 1 where a phrase stands literally.
    """
    taken = [id_col, text_col]
    held, places, base, more = (fresh(taken, n) for n in ("words", "places", "phrases", "matches"))
    found = docs.select(id_col, normalised(F.coalesce(F.col(text_col), F.lit(""))).alias(held))
    found = _with_matches(found, held, more, threshold)
    w = F.col(held)
    spaces = F.length(w) - F.length(F.replace(w, F.lit(" "), F.lit("")))
    found = found.select(
        id_col,
        more,
        F.when(w == "  ", 0).otherwise(spaces - 1).cast("long").alias("n_words"),
        F.array(*[phrase_places(w, p) for p in PHRASES]).alias(places),
    )
    labels = F.lit(list(PHRASES.values()))
    held_labels = F.filter(F.zip_with(places, labels, lambda p, label: F.when(F.size(p) > 0, label)), lambda x: x.isNotNull())
    found = found.select(id_col, "n_words", F.flatten(places).alias(places), held_labels.alias(base), more)
    return found.select(
        id_col,
        "n_words",
        F.size(places).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"),
        F.array_max(places).cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union(base, F.transform(more, lambda x: x["label"]))), ",").alias("labels"),
        F.when(F.size(base) > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform(more, lambda x: x["containment"])), F.lit(0.0))).alias("score"),
    )
