"""Mixing, filter audit and resampling against brute force, and their edge cases."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tessera.llm import filter_audit, mixing, queries, resample

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
RUN = re.compile(r"[^\x20\x09-\x0D]+")
CLASH = "size target source_size place copies taken weight failed part digest id label_id good toxic n_words bucket score nth many __at __part".split()


def folded(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").collect()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, copies, repeated rows and columns whose names clash."""
    long = "alpha Beta gamma delta " * 60_000
    texts = [
        (1, None, "a"), (2, "", "a"), (3, "one", "b"), (3, "one", "b"), (4, long, None), (5, " \n\t ", None), (None, "no id", "a"), (None, "no id", "a"),
        (6, "one", ""), (7, "é\x0bü " * 60 + "$", "b"), (8, "x" * 300_000, "c"), (9, "", "zero"), (10, None, "zero"), (11, "alpha beta gamma delta " * 8, "c"),
    ]
    rows = [(i, t, s, *["keep"] * len(CLASH)) for i, t, s in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in CLASH))


# ---------------------------------------------------------------- mixing


def targets_by_force(sizes, share=1.5, most=2.0, weights=(3, 1, 2)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    held, total = set(), share * sum(sizes.values())
    while True:
        rest = sum(w[s] for s in order if s not in held)
        level = (total - sum(most * sizes[s] for s in held)) / rest if rest else 0
        more = {s for s in order if s not in held and w[s] * level > most * sizes[s]}
        if not more:
            return {s: most * sizes[s] if s in held else w[s] * level for s in order}
        held |= more


def check_mixture(rows, texts):
    """Sizes, targets, whole copies, totals near their targets."""
    sizes = Counter()
    for _, text, source in texts:
        sizes[source] += len(RUN.findall(text or ""))
    want = targets_by_force(sizes)
    taken, largest = Counter(), Counter()
    for r in rows:
        assert r.taken == r.copies * r.size and r.taken <= 2 * r.size
        key = r.source
        assert math.isclose(r.target, want[key], abs_tol=1e-6) and r.source_size == sizes[key]
        rate = want[key] / sizes[key] if sizes[key] else 0
        assert not r.size or math.floor(rate) <= r.copies <= math.ceil(rate)
        taken[key] += r.taken
        largest[key] = max(largest[key], r.size)
    for s, w in want.items():
        assert abs(taken[s] - w) <= 2 * largest[s] + 1


def test_mixture_follows_targets_on_the_table(spark, documents):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = queries.op11_mixing(spark, SF).collect()
    source = {r.doc_id: r.source for r in documents}
    assert Counter(r.doc_id for r in rows) == Counter(source.keys())
    size = {r.doc_id: len(RUN.findall(r.text or "")) for r in documents}
    assert all(r.size == size[r.doc_id] for r in rows)
    named = [Row(**r.asDict(), source=source[r.doc_id]) for r in rows]
    check_mixture(named, [(r.doc_id, r.text, r.source) for r in documents])
    dealt_anew = mixing.mixture_report(docs.repartition(13, "text")).collect()  # other files and partitions
    assert sorted(rows) == sorted(dealt_anew)
    total = sum(r.taken for r in rows)
    assert abs(total / (1.5 * sum(size.values())) - 1) < 0.05  # ten documents a source


def test_targets_are_reshared_until_none_is_above(spark):
    sizes = {"a": 10, "b": 1000, "c": 1, "d": 0, None: 500, "e": 3}
    sized = spark.createDataFrame(list(sizes.items()), "source string, size long")
    for share in (0.0, 0.5, 1.5, 2.0, 3.0):
        got = {r.source: r.target for r in mixing.source_targets(sized, mixing.cycled_weights(sized), share=share).collect()}
        want = targets_by_force(sizes, share)
        assert all(math.isclose(got[s], want[s], abs_tol=1e-9) for s in sizes), share
    with pytest.raises(ValueError):
        mixing.source_targets(sized, mixing.cycled_weights(sized).where("source <> 'a'"))


def test_mixture_of_odd_and_empty_tables(spark, odd):
    rows = mixing.mixture_report(odd).collect()
    assert len(rows) == odd.count() and mixing.mixture_report(odd.limit(0)).count() == 0
    sizes = sorted((r.doc_id or 0, r.size) for r in rows)
    assert sizes == sorted((r.doc_id or 0, len(RUN.findall(r.text or ""))) for r in odd.collect())
    assert {r.target for r in rows if r.doc_id in (9, 10)} == {0.0} and all(r.copies == 0 for r in rows if r.size == 0)
    mixed = mixing.mix(odd, copies_col="copies")
    assert mixed.columns == [*[c for c in odd.columns if c != "copies"], "copies"]
    took = Counter(r.doc_id for r in mixed.collect())
    want = Counter()
    for r in rows:
        want[r.doc_id] += r.copies
    assert took == +want and mixing.mix(odd.limit(0)).columns == odd.columns and mixing.mix(odd.limit(0)).count() == 0
    assert mixing.mix(odd, copies_col="copies").where("copies not in (0, 1)").count() == 0


def test_word_counts_of_sliced_batches():
    import pyarrow as pa

    texts = ["a b", None, "", " x", "y ", "\x0bz\x1c w", "q"]
    whole = pa.array(texts)
    assert mixing.word_counts(whole).tolist() == [len(RUN.findall(t or "")) for t in texts] == [2, 0, 0, 1, 1, 1, 1]
    assert mixing.word_counts(whole.slice(2, 4)).tolist() == [0, 1, 1, 1] and mixing.word_counts(whole.slice(1, 2)).tolist() == [0, 0]


def test_a_hot_source_of_equal_sizes_is_sampled_evenly(spark):
    sized = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit(7).cast("long").alias("size"))
    targets = spark.createDataFrame([("s", 210_000, 140_000.0)], "source string, source_size long, target double")
    rows = sorted(mixing.expected_copies(sized, targets).collect())
    assert abs(sum(r.copies for r in rows) - 20_000) <= 1
    copies = np.array([r.copies for r in rows])
    assert set(copies) == {0, 1} and copies.reshape(-1, 3).sum(axis=1).tolist() == [2] * 10_000  # every third is left out


# ---------------------------------------------------------------- filter audit


def failures(docs):
    """Set of failed filters of every (doc_id, text, source) row."""
    out = []
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    for i, t, s in docs:
        t = t or ""
        w = RUN.findall(t)
        bad = set()
        bad |= {"A"} if len(w) < 50 else set()
        bad |= {"B"} if 100 * len(set(w)) < 65 * len(w) else set()
        bad |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 5 * len(t) else set()
        bad |= {"D"} if re.search("[#$%&*|]", t) else set()
        bad |= {"E"} if i is not None and least[t] < i else set()
        out.append((i, s or "", bad))
    return out


def audit_by_force(docs, good, toxic):
    """Every order applied to every document, one step after another."""
    rows = defaultdict(Counter)
    for i, part, bad in failures(docs):
        for order in map("".join, permutations("ABCDE")):
            gone = False
            for step, f in enumerate(order, 1):
                c = rows[part, order, step]
                here = f in bad and not gone
                c["redundant"] += f in bad and gone
                gone |= f in bad
                c["kept"] += not gone
                c["removed"] += here
                c["unique_fails"] += bad == {f}
                c["good_lost"] += here and i in good
                c["toxic_lost"] += here and i in toxic
    shapley = Counter()
    for (part, order, step), c in rows.items():
        shapley[part, order[step - 1]] += c["removed"]
    return {k: {**c, "shapley": shapley[k[0], k[1][k[2] - 1]]} for k, c in rows.items()}


def as_dict(audit):
    rows = audit.collect()
    out = {(r.part, r.filter_order, r.step): {c: r[c] for c in (*filter_audit.COUNTS, "shapley")} for r in rows}
    assert len(out) == len(rows)
    return out


def test_audit_equals_every_order_by_force(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    good, toxic = ({r.doc_id for r in labels if r[c] == 1} for c in ("quality", "toxic"))
    want = audit_by_force([(r.doc_id, r.text, r.source) for r in documents], good, toxic)
    got = as_dict(queries.op12_filter_audit(spark, SF))
    assert got == {k: {c: int(v.get(c, 0)) for c in (*filter_audit.COUNTS, "shapley")} for k, v in want.items()}
    assert any(v["redundant"] for v in got.values()) and any(v["unique_fails"] for v in got.values())


def test_audit_of_odd_and_empty_tables(spark, odd):
    labels = spark.createDataFrame([(3, 1, None), (3, 0, 1), (6, 1, 0), (None, 1, 1), (4, None, 1)], "doc_id long, quality int, toxic int")
    docs = [(r.doc_id, r.text, r.source) for r in odd.collect()]
    want = audit_by_force(docs, {3, 6}, {3, 4})
    got = as_dict(filter_audit.interaction_audit(odd, labels))
    assert got == {k: {c: int(v.get(c, 0)) for c in (*filter_audit.COUNTS, "shapley")} for k, v in want.items()}
    assert filter_audit.interaction_audit(odd.limit(0), labels).count() == 0
    assert filter_audit.interaction_audit(odd, labels.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


def test_audit_takes_words_across_blocks(monkeypatch):
    text = ("Aa bb cc " * 40 + "z" * 70 + " \x0b d#").encode()
    want = filter_audit.failed_by_text(text, len(text))
    for block in (1, 3, 7, 64):
        monkeypatch.setattr(filter_audit, "_BLOCK", block)
        assert [w for b in filter_audit.word_blocks(text) for w in b] == text.split()
        assert filter_audit.failed_by_text(text, len(text)) == want == 0b1110


# ---------------------------------------------------------------- resampling


def scores_by_force(docs, bench):
    """(doc_id, n_features, weight, score, rank) by the definition."""

    def grams(t):
        w = folded(t)
        return len(w), Counter(" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1))

    bucket = lambda g: zlib.crc32(g.encode()) % 10_000
    counted = {k: grams(t) for k, (_, t) in enumerate(docs)}
    s, t = Counter(), Counter()
    for _, c in counted.values():
        for g, n in c.items():
            s[bucket(g)] += n
    for x in bench:
        for g, n in grams(x)[1].items():
            t[bucket(g)] += n
    ss, tt = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (ss + 10_000) / ((s[b] + 1) * (tt + 10_000)))) for b in range(10_000)]
    rows = []
    for k, (i, _) in enumerate(docs):
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(g)] * n for g, n in counted[k][1].items())
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((i, sum(counted[k][1].values()), weight, score, counted[k][0]))
    fit = sorted((k for k, r in enumerate(rows) if r[4] >= 20), key=lambda k: (-rows[k][3], rows[k][0] is None, rows[k][0] or 0))
    rank = {k: n + 1 for n, k in enumerate(fit[: 5 * len(fit) // 100])}
    return [(*r[:4], rank.get(k)) for k, r in enumerate(rows)]


def some(rows):
    return Counter(tuple(r) for r in rows)


def test_resampling_equals_brute_force_on_the_table(spark, documents):
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = queries.op13_resampling(spark, SF).collect()
    assert some(got) == some(scores_by_force([(r.doc_id, r.text) for r in documents], bench))
    assert sum(r["rank"] is not None for r in got) > 3


def test_resampling_of_odd_and_empty_tables(spark, odd, monkeypatch):
    bench = spark.createDataFrame([(1, "alpha beta gamma"), (2, None), (2, "é one")], "item_id long, text string")
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    got = resample.resampling_report(odd, bench).collect()
    assert some(got) == some(scores_by_force(docs, ["alpha beta gamma", "", "é one"]))
    assert resample.resampling_report(odd.limit(0), bench).count() == 0
    none = resample.resampling_report(odd, bench.limit(0)).collect()
    assert some(none) == some(scores_by_force(docs, []))
    weighted = resample.importance_weights(odd, bench)
    assert set(weighted.columns) == {*odd.columns, "n_features"} and weighted.where("size = 'keep'").count() == len(docs)


def test_resampling_draws_ties_by_id_and_repeated_rows(spark):
    line = "alpha beta gamma delta " * 6
    rows = [(i % 50, line) for i in range(200)] + [(None, line)] * 20 + [(900 + i, "short") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    bench = spark.createDataFrame([(1, "gamma")], "item_id long, text string")
    got = resample.resampling_report(docs, bench).collect()
    want = scores_by_force(rows, ["gamma"])
    assert some(r[:4] for r in got) == some(r[:4] for r in want)
    drawn = lambda x: sorted((r[4], r[3]) for r in x if r[4] is not None)
    assert drawn(got) == drawn(want) and len(drawn(got)) == 11
    kept = resample.resample(docs, bench)
    assert kept.columns == docs.columns and some(kept.collect()) == some((r[0], line) for r in want if r[4] is not None)


def test_features_do_not_depend_on_pieces(monkeypatch):
    texts = [b"One two three one two three four", b"", b"x", "é two three".encode() * 5, b"a b", b" ", b"tail of words here"]

    def counted():
        out = Counter()
        for group, carried in resample._grouped(texts):
            buckets, numbers, rows = resample.features(group, carried)
            out.update(zip(rows.tolist(), buckets[numbers].tolist(), strict=True))
        return out

    want = Counter()
    for k, t in enumerate(texts):
        w = folded(t.decode())
        want.update((k, zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000) for n in (1, 2, 3) for i in range(len(w) - n + 1))
    for piece in (1, 2, 5, 11, 30, 1 << 20):
        monkeypatch.setattr(resample, "PIECE", piece)
        assert counted() == want, piece
