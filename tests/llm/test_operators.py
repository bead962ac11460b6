"""Operators against brute force on small fixtures, and their edge cases."""

import base64
import hashlib
import math
import re
import time
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tessera.llm import ann, bpe, chat, decontam, langid, license_scan, membership, ngram_join, pii, queries, secret_scan, toxicity

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
DOC = "doc_id long, text string, lang string, source string, n_chars long, spans string, score double"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


#: Names of helper columns that operators have or had.
CLASH = "window_hits language gone_id gone_hash row order assigns rest run spans words places phrases matches secrets token_count".split()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows and columns whose names clash."""
    long = "alpha beta gamma delta " * 5000
    dense = "Ab1/" * 50_000 + " " + "f0" * 50_000 + " " + "9" * 50_000 + " " + "é" * 50_000
    texts = [(1, None), (2, ""), (3, "one"), (3, "one"), (4, long), (5, " \n\t "), (None, "no id"), (6, "mail a@b.co or +1 (555) 555-0100 or 4111 1111 1111 1111 or 10.0.0.1")]
    rows = [(i, t, "en", None, 0, "x", 0.5, *["keep"] * (len(CLASH) - 1)) for i, t in [*texts, (7, dense)]]
    return spark.createDataFrame(rows, f"{DOC}, " + ", ".join(f"{c} string" for c in CLASH if c != "spans"))


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def empty(spark):
    return spark.createDataFrame([], DOC)


def test_every_operator_takes_odd_and_empty_tables(spark, odd):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta alpha beta gamma delta alpha beta"), (2, None), (None, "one"), (1, "")], "item_id long, text string")
    labels = spark.createDataFrame([(3, 1), (3, 0), (4, 0), (None, 1), (6, None)], "doc_id long, toxic int")
    none = odd.limit(0)
    for docs, n in ((odd, 9), (none, 0)):
        assert langid.language_report(docs).count() == n
        assert decontam.contamination_report(docs, bench).count() == n
        assert decontam.contamination_report(docs, bench.limit(0)).where("n_hit = 0").count() == n
        assert toxicity.toxicity_report(docs, labels).count() == n
        assert toxicity.toxicity_report(docs, labels.limit(0)).where("score < 1e-9").count() == n
        assert pii.span_report(docs).count() == n
        assert bpe.token_digests(docs, RANKS).count() == n
        assert secret_scan.secret_report(docs).count() == n
        assert license_scan.license_report(docs).count() == n
        assert ngram_join.near_duplicates(docs).count() == (7 if n else 0)
    hit = {(r.doc_id, r.text and r.text[:4]): r.window_hits for r in decontam.find_windows(odd.withColumn("window_hits", F.lit(1)), bench).collect()}
    assert [tuple(s) for s in hit[4, "alph"].hit_spans] == [(0, 19_998)] and hit[3, "one"].hit_items == ["null"] and hit[1, None].n_words == 0


def test_operators_that_pass_rows_on_keep_every_column(spark, odd):
    """Also the pipeline's stages, on an odd table and an empty one."""
    import corpus_pipeline

    bench = spark.createDataFrame([(1, "alpha beta gamma delta alpha beta gamma delta alpha beta")], "item_id long, text string")
    passing = [
        lambda d: langid.keep_identified(d, min_score=0.0), lambda d: decontam.decontaminate(d, bench), lambda d: decontam.decontaminate(d, bench, action="cut"),
        pii.redact, secret_scan.mask_secrets, ngram_join.drop_near_duplicates,
    ]
    for keep in passing:
        out = keep(odd)
        assert out.columns == odd.columns and {v for r in out.select("row", "words", "language").distinct().collect() for v in r} == {"keep"}
        assert keep(odd.limit(0)).count() == 0
    kept = lambda k: sorted((r.doc_id or 0) for r in passing[k](odd).collect())
    assert kept(0) == [0, 3, 3, 4, 6, 7] and kept(1) == [0, 1, 2, 3, 3, 5, 6, 7] and kept(5) == [0, 1, 2, 3, 4, 5, 6, 7]
    out = bpe.encode(odd, RANKS, ids_col="i", offsets_col="o")
    assert out.columns == [*odd.columns, "i", "o"] and out.where("doc_id = 7").first().row == "keep"
    plain = odd.select(*corpus_pipeline.DOCUMENT)
    for name, stage in corpus_pipeline.STAGES:
        for docs in (plain, plain.limit(0)):
            out = stage(spark, docs, SF)
            assert out.columns[: len(plain.columns)] == plain.columns, name
            assert out.count() <= docs.count()


def test_defined_results(spark, odd):
    lang = {(r.doc_id, r.lang_pred, r.score) for r in langid.language_report(odd).collect()}
    assert {(1, "und", 0.0), (2, "und", 0.0), (5, "und", 0.0)} <= lang
    spans = {r.doc_id: r for r in pii.span_report(odd).collect()}
    assert (spans[6].n_email, spans[6].n_ip, spans[6].n_card, spans[6].n_phone) == (1, 1, 1, 1)
    assert spans[1].spans == "" and spans[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    near = {r.doc_id: r for r in ngram_join.near_duplicates(odd).collect()}
    assert all(near[i].class_id == i and near[i].n_links == 0 for i in near)


def test_ann_recall_ties_and_unusable_vectors(spark):
    rng = np.random.default_rng(3)
    E = rng.standard_normal((600, 16)).astype(np.float32)
    E[5] = E[6] = E[100]
    rows = [(i, [float(v) for v in x]) for i, x in enumerate(E)]
    rows += [(1000, None), (1100, [0.0] * 16), (1200, [float("nan")] * 16), (1300, [1.0]), (1400, [None] + [1.0] * 15), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert set(got) == {0, 100, 200, 300, 400, 500}
    assert [got[100][k] for k in (1, 2)] == [(5, 0.0), (6, 0.0)]
    hits = []
    for q, found in got.items():
        assert sorted(found) == list(range(1, 11))
        d = np.sqrt(((E.astype(float) - E[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        best = set(np.lexsort((np.arange(600), d))[:10].tolist())
        hits.append(len(best & {v for v, _ in found.values()}) / 10)
        assert all(abs(s - d[v]) < 1e-12 for v, s in found.values())
    assert np.mean(hits) >= 0.9
    assert ann.nearest(df.where("vec_id < 0"), F.col("vec_id") % 100 == 0).count() == 0
    assert ann.nearest(df.where("vec_id < 4"), F.col("vec_id") == 0).count() == 3


def test_ann_repeated_rows_and_ids(spark, monkeypatch):
    """Every query id has k different neighbours once, by the smallest distance of any of its rows."""
    rng = np.random.default_rng(5)
    E = rng.standard_normal((60, 8)).astype(np.float32)
    rows = [(i % 40, E[i]) for i in range(60)] + [(i % 40, E[i]) for i in range(0, 60, 3)] + [(50, E[7])] * 3
    df = spark.createDataFrame([(i, [float(v) for v in x], "x") for i, x in rows], "vec_id long, embedding array<float>, ids string")
    D = lambda a, b: float(np.sqrt(((a.astype(float) - b.astype(float)) ** 2).sum()))
    for depth, tables, probes in ((1, 1, 16), (2, 1, 256), (3, 2, 4096)):  # all keys: the search is exact
        for block in (8192, 7):
            monkeypatch.setattr(ann, "BLOCK", block)
            got = {}
            found = ann.nearest(df, F.col("vec_id").isin(0, 7, 50), depth=depth, tables=tables, probes=probes)
            for r in found.collect():
                got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
            for q in (0, 7, 50):
                best = {}
                for a in (x for i, x in rows if i == q):
                    for i, b in rows:
                        if i != q:
                            best[i] = min(best.get(i, 9e9), D(a, b))
                want = sorted((d, i) for i, d in best.items())[:10]
                assert sorted(got[q]) == [(n + 1, i, pytest.approx(d, abs=1e-12)) for n, (d, i) in enumerate(want)]


def test_ann_probes_grow_until_the_measured_recall_and_exact_scans(spark, monkeypatch):
    rng = np.random.default_rng(12)
    E = rng.standard_normal((700, 16))
    df = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(E)], "vec_id long, embedding array<double>")
    want = {}
    for q in range(0, 700, 50):
        d = np.sqrt(((E - E[q]) ** 2).sum(1))
        d[q] = np.inf
        want[q] = [int(i) for i in np.lexsort((np.arange(700), d))[:10]]

    def found(**how):
        out = {}
        for r in ann.nearest(df, F.col("vec_id") % 50 == 0, **how).collect():
            out.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
        return out

    monkeypatch.setattr(ann, "PROBES", (1, 24, 1))
    monkeypatch.setattr(ann, "TABLES", (2, 2, 2))
    share = lambda got: np.mean([len(set(got[q].values()) & set(want[q])) / 10 for q in want])
    low, high = share(found(depth=2, probes=24)), share(found(depth=2))
    assert low < 0.7 and high >= 0.88
    for block, bytes_ in ((1024, 64 << 20), (3, 0)):
        monkeypatch.setattr(ann, "SCAN_BLOCK", block)
        monkeypatch.setattr(ann, "QUERY_BYTES", bytes_)  # the second: vectors are shipped
        assert {q: [v for _, v in sorted(g.items())] for q, g in found(exact=True).items()} == want
        assert share(found(depth=1, probes=32)) == 1.0


def test_ann_recall_on_the_tables(spark):
    """Recall and the share of rows met; depth 2 is what tables of 10,000 rows and more get."""
    for sf, depth in (("sf0.01", None), ("sf0.1", None), ("sf0.1", 2)):
        d = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
        rows = d.where(ann.usable(F.col("embedding"))).select("vec_id", "embedding").collect()
        ids, E = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=float)
        plan = ann.search_plan(len(E), E.shape[1]) if depth is None else (depth, ann.TABLES[depth - 1], ann.PROBES[depth - 1])
        model = ann.CrossPolytope(E.shape[1], E.mean(0), plan[1], plan[0])
        at = np.flatnonzero(ids % 100 == 0)
        keys, asked = model.keys(E), model.probes(E[at], plan[2])
        met = np.mean([np.any([np.isin(keys[:, t], asked[q, t]) for t in range(plan[1])], axis=0).mean() for q in range(len(at))])
        assert met < (0.55 if plan[0] == 1 else 0.25)
        got = {}
        for r in ann.nearest(d, F.col("vec_id") % 100 == 0, depth=depth).collect():  # probes as measured
            got.setdefault(r.query_id, set()).add(r.vec_id)
        recall = []
        for i in at.tolist():
            dist = np.sqrt(((E - E[i]) ** 2).sum(1))
            dist[i] = np.inf
            recall.append(len(set(ids[np.lexsort((ids, dist))[:10]].tolist()) & got[int(ids[i])]) / 10)
        assert np.mean(recall) >= 0.9, (sf, plan, np.mean(recall))
    assert [ann.search_plan(n, 64)[0] for n in (500, 8_192, 8_193, 10**6, 10**7, 10**9)] == [1, 1, 2, 2, 3, 4]


def test_language_held_out_accuracy_and_mixtures(spark, documents):
    rows = [r for r in queries.op2_language_id(spark, SF).collect() if r.held_out]
    assert np.mean([r.lang_pred == documents[r.doc_id].lang for r in rows]) >= 0.95
    model = langid.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    by = {lang: next(d.text for d in documents.values() if d.lang == lang and d.n_chars > 1500)[:1200] for lang in ("en", "de")}
    names, scores, sizes = model.predict([by["en"] + " " + by["de"], by["en"]])
    assert sizes[0] == 2 and 0.3 < scores[0] < 0.75 and (names[1], sizes[1]) == ("en", 1)


def test_language_sets_equal_mixture_inference_by_force():
    """EM by plain loops to full rest, sets in order of the full mixture, penalised likelihood."""
    rng = np.random.default_rng(21)
    names = [f"l{i}" for i in range(6)]
    letters = [list("abcdefgh"), list("ghijklmn"), list("mnopqrst"), list("stuvwxyz"), list("äöüßéèêà"), list("абвгдежз")]
    write = lambda k, n: "".join(str(x) for x in rng.choice(letters[k], n))
    counts = np.zeros((langid.BINS, 6))
    for k in range(6):
        grams, n = langid.trigrams(write(k, 20_000))
        counts[grams, k] += n
    model = langid.Mixture(names, counts)

    def force(text):
        grams, c = langid.trigrams(text)
        p, n = model.p[grams].astype(float), c.sum()

        def em(pi):
            for _ in range(3000):
                w = p * pi
                pi = (c[:, None] * w / w.sum(1, keepdims=True)).sum(0) / n
            return pi

        one = int((c @ np.log(p)).argmax())
        best, chosen = float((c @ np.log(p)).max()), np.eye(6)[one]
        order = [one, *[k for k in np.argsort(-em(np.full(6, 1 / 6))) if k != one]]
        for m in range(2, 7):
            start = np.zeros(6)
            start[order[:m]] = 1 / m
            pi = em(start)
            value = float(c @ np.log(p @ pi)) - langid.PENALTY * np.log(n + 1) * (m - 1)
            if value <= best:
                break
            best, chosen = value, pi
        return chosen

    texts = []
    for size in (1, 2, 3, 5, 6):
        for _ in range(6):
            own = rng.choice(6, size, replace=False)
            texts.append(" ".join(write(int(k), int(rng.integers(150, 400))) for k in own))
    got = model.predict([*texts, "", "12"])
    for t, name, score, size in zip(texts, *got, strict=False):
        want = force(t)
        assert size == (want > 0).sum() and name == names[int(want.argmax())] and abs(score - want.max()) < 0.02
    assert max(got[2]) == 6 and got[0][-2:] == ["und", "und"]  # no limit on the set
    # Small parts give the same answers as one.
    held, langid.HELD = langid.HELD, 600
    try:
        again = model.predict(texts)
    finally:
        langid.HELD = held
    assert again[0] == got[0][: len(texts)] and again[2] == got[2][: len(texts)] and np.allclose(again[1], got[1][: len(texts)], atol=1e-4)


def test_language_sample_takes_repeated_rows_once(spark):
    rows = [(1, "aaa bbb", "x")] * 300 + [(None, "aaa bbb", "x")] * 300 + [(i, "zzz yyy", "y") for i in range(2, 12)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_train=10_000)
    grams, n = langid.trigrams("aaa bbb")
    p = model.p[grams, model.languages.index("x")]
    assert np.allclose(p, (2 * n + langid.SMOOTHING) / (2 * n.sum() + langid.SMOOTHING * langid.BINS), rtol=1e-5)


def test_mixed_documents_are_rejected_by_the_language_stage(spark, documents):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    by = {lang: next(d.text for d in documents.values() if d.lang == lang and d.n_chars > 1500)[:900] for lang in sorted({d.lang for d in documents.values() if d.lang})}
    more = spark.createDataFrame([(-1, " ".join(by.values()), None, "x", 0), (-2, "12 34", None, "x", 0), (-3, None, None, "x", 0)], docs.schema)
    kept = {r.doc_id for r in corpus_pipeline.keep_known_language(spark, docs.unionByName(more), SF).collect()}
    assert kept == set(documents)


def brute_windows(text, items, n=10):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        own = words(t)
        size = min(n, len(own))
        wins = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if size else set()
        for i in range(len(w) - size + 1) if size else ():
            if tuple(w[i : i + size]) in wins:
                hit |= set(range(i, i + size))
                found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_decontamination_matches_brute_force_in_any_blocks(spark, block):
    items = [(1, "a b c d e f g h i j k l"), (2, "x y"), (11, "Été a b"), (3, "")]
    texts = ["z A,b c d e f g h i j! z x  y", "Été a B a b c", "", None, "a b c d e f g h i", "x y x y"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for r in decontam.contamination_report(docs, bench, block_bytes=block).collect():
        want = brute_windows(texts[r.doc_id], items)
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == want and r.contaminated == (want[1] > 0)
    cut = {r.doc_id: r.text for r in decontam.decontaminate(docs, bench, action="cut", block_bytes=block).collect()}
    assert cut[5] == "" and cut[4] == texts[4] and cut[0].startswith("z ") and "c d" not in cut[0]
    kept = {r.doc_id for r in decontam.decontaminate(docs, bench, block_bytes=block).collect()}
    assert kept == {2, 3, 4}


def test_decontamination_of_a_large_benchmark_on_the_table(spark, documents):
    """Beyond one broadcast windows are joined: the same rows, also with repeated items and texts."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.unionByName(docs.limit(20)).withColumn("digest", F.lit("keep"))
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    bench = bench.unionByName(bench.withColumn("item_id", F.col("item_id") + 1000)).unionByName(bench.limit(3))
    small, large = (sorted(decontam.contamination_report(docs, bench, block_bytes=b).collect()) for b in (1 << 30, 10))
    assert small == large and any(r.contaminated for r in small)
    cut = [sorted(decontam.decontaminate(docs, bench, action="cut", block_bytes=b).select("doc_id", "text", "digest").collect()) for b in (1 << 30, 10)]
    assert cut[0] == cut[1] and cut[0][0].digest == "keep"


def test_toxicity_separates_held_out_texts(spark):
    rng = np.random.default_rng(0)
    vocab = ["lorem", "ipsum", "dolor", "amet", "tempor", "magna", "aliqua"]
    rows = []
    for i in range(600):
        t = list(rng.choice(vocab, 40))
        if i % 4 == 0:
            t.insert(int(rng.integers(40)), "vilecreature")
        rows.append((i, " ".join(t), int(i % 4 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    out = {r.doc_id: r for r in toxicity.toxicity_report(df.select("doc_id", "text"), df.select("doc_id", "toxic")).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert all(out[i].held_out for i, _, _ in held) and len(held) > 50
    assert np.mean([out[i].predicted == y for i, _, y in held]) >= 0.97
    assert all(0 <= r.score <= 1 for r in out.values())


def test_toxicity_weights_equal_a_dense_regression(monkeypatch):
    """Naive Bayes ratios and the penalised fit, against dense matrices and many plain steps."""
    rng = np.random.default_rng(22)
    vocab = ["lorem", "ipsum", "dolor", "amet", "tempor", "magna"]
    texts, y = [], []
    for i in range(60):
        t = list(rng.choice(vocab, 12))
        if i % 3 == 0:
            t.insert(int(rng.integers(12)), "vile")
        texts.append(" ".join(t))
        y.append(int(i % 3 == 0))
    y = np.array(y)
    bags = [toxicity.GramSet()(t) for t in texts]
    names = np.unique(np.concatenate(bags))
    X = np.array([np.isin(names, b) for b in bags], dtype=float)
    p, q = 1 + X[y == 1].sum(0), 1 + X[y == 0].sum(0)
    ratio = np.log((p / (y == 1).sum()) / (q / (y == 0).sum()))
    ratio[p + q < 5] = 0
    ratio /= np.sqrt((X * ratio**2).sum(1).mean())
    A, sign = X * ratio, np.where(y == 1, 1.0, -1.0)
    v, b = np.zeros(len(names)), 0.0
    for _ in range(400):  # Newton's method on the dense problem
        m = A @ v + b
        s1 = 1 / (1 + np.exp(sign * m))
        Z = np.column_stack([A, np.ones(len(y))])
        grad = -(Z.T @ (sign * s1)) + toxicity.L2 * np.append(v, 0)
        H = (Z.T * (s1 * (1 - s1))) @ Z + np.diag([*[toxicity.L2] * len(v), 1e-9])
        step = np.linalg.solve(H, grad)
        v, b = v - step[:-1], b - step[-1]
        if np.abs(step).max() < 1e-10:
            break
    monkeypatch.setattr(toxicity, "CHUNK", 300)
    weights, intercept = toxicity._fit_weights(bags, y)
    got = np.array([weights[bag].sum() + intercept for bag in bags])
    assert np.corrcoef(got, A @ v + b)[0, 1] > 0.9999 and np.abs(got - (A @ v + b)).max() < 0.05
    model = toxicity.train(bags, y)
    want = np.array([model.score(t) for t in texts])
    assert np.all((want >= 0.5) == (y == 1))


def brute_pii(t):
    digits = lambda m: re.sub("[^0-9]", "", m[0])

    def luhn(d):
        v = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(d))]
        return sum(x - 9 * (x > 9) for x in v) % 10 == 0

    tests = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    }
    found = [(k, *m.span()) for k, (p, ok) in tests.items() for m in re.finditer(p, t) if ok(m)]
    return sorted(found, key=lambda s: (s[1], list(tests).index(s[0])))


def test_strict_personal_data_matches_the_patterns():
    rng = np.random.default_rng(5)
    parts = ["a", "b.c", "@", "x-y", ".", "co", " ", "@@", "+1", "555", "-", "(2)", "10.0.0.1", "4111111111111111", "%", "é", "+", "12.3", "999"]
    for _ in range(3000):
        t = "".join(rng.choice(parts, int(rng.integers(1, 14))))
        assert pii.strict_spans(t) == brute_pii(t), t
    assert pii.emails("a" * 200_000 + "@") == []
    for t in ("1.2.3.4.5.6.7.8.9", "12.34.56.7890.1.2.3.4", "0001.255.256.1 000255.1.1.1", "1..2.3.4.5"):
        assert [s for s in pii.strict_spans(t) if s[0] == "ip"] == [s for s in brute_pii(t) if s[0] == "ip"], t
    assert pii.strict_spans("1" * 200_000) == [] and pii.strict_spans("9" * 5000 + ".1.1.1") == []
    assert pii.strict_spans("0" * 5000 + "9.1.1.1") == [("ip", 0, 5007)]


def test_bootstrapped_contexts_find_unseen_identifiers(spark):
    rows = [(i, f"please call me +1 (555) 555-0{100 + i} today friend") for i in range(30)]
    rows += [(100, "please call me (555) 555-0999 today friend"), (101, "the sum was (555) 555-0999 in all")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.spans for r in pii.span_report(df).collect()}
    assert out[100] == "phone:15:29" and out[101] == ""
    clean = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert clean[100] == "please call me [PHONE] today friend" and clean[101] == rows[-1][1] and clean[0] == clean[100]


def test_one_sided_and_edge_contexts_find_unseen_identifiers(spark):
    after = [f"word{chr(97 + i)}" for i in range(20)]
    rows = [(i, f"phone: +1 (555) 555-0{100 + i}, {w}") for i, w in enumerate(after)]
    rows += [(20 + i, f"server {w} 10.0.0.{i + 1}") for i, w in enumerate(after)]
    rows += [(40 + i, f"maybe +1 (555) 555-0{200 + i} {w}") for i, w in enumerate(after)]
    rows += [(60 + i, f"maybe (555) 555-0{300 + i} {w}s") for i, w in enumerate(after)]
    more = ["phone: (555) 555-0999, Bob", "7 phone: (555) 555-0998", "other 10[.]0[.]0[.]77", "router fe80::1", "at 12:30:45", "other 10[.]0[.]0[.]77 x"]
    rows += list(enumerate(more, 100))
    out = {r.doc_id: r.spans for r in pii.span_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [out[100 + i] for i in range(6)] == ["phone:7:21", "phone:9:23", "ip:6:21", "ip:7:14", "", ""]
    assert not any(out[60 + i] for i in range(20))  # as many unseen as strict ones: the cue is not trusted


def brute_graph(texts, rounds, min_confidence=0.9, min_support=5):
    """Accepted patterns by plain dictionaries."""
    members, seeds = {}, set()
    for t in texts:
        strict = pii.strict_spans(t)
        for seed, spans in ((True, strict), (False, pii.loose_spans(t, strict))):
            for kind, a, b in spans:
                instance = (kind, pii.normal_form(kind, t[a:b]))
                for p in pii.induced(t, kind, a, b):
                    members.setdefault((kind, *p), {}).setdefault(instance, False)
                    members[(kind, *p)][instance] |= seed
    belief, accepted = {}, {}
    for _ in range(rounds + 1):
        confidence, support = {}, {}
        for p, own in members.items():
            value = [1.0 if seed else belief.get(i, 0.0) for i, seed in own.items()]
            confidence[p] = sum(value) / len(value)
            support[p] = sum(seed or belief.get(i, 0) >= min_confidence for i, seed in own.items())
        accepted = {p for p in members if confidence[p] >= min_confidence and support[p] >= min_support}
        miss = {}
        for p in accepted:
            for i, seed in members[p].items():
                if not seed:
                    miss[i] = miss.get(i, 1.0) * (1 - min(confidence[p], 0.999))
        belief = {i: 1 - m for i, m in miss.items()}
    return {p for p in accepted if not all(members[p].values())}


def test_later_rounds_accept_patterns_that_no_seed_supports(spark):
    texts = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)} phone: +1 (555) 555-{1000 + i}, x{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(150)]
    texts += [f"q{chr(97 + i)} phone: (555) 555-{3000 + i}, y{chr(97 + i)}" for i in range(12)]  # seen beside seeds
    texts += [f"r{chr(97 + i)} dial (555) 555-{3000 + i}. z{chr(97 + i)}" for i in range(12)]  # the same elsewhere
    texts += ["now dial (555) 555-4999. gone", *[f"sum is (555) 555-{4990 + i}. gone" for i in range(5)]]
    texts += [None, "", texts[0]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    edges = pii.occurrences(df, "text").persist()
    for rounds in (1, 2, 20, None):
        found = pii.score_patterns(edges, rounds=rounds).where("accepted and candidates > 0").collect()
        assert {tuple(r[c] for c in pii.PATTERN) for r in found} == brute_graph([t or "" for t in texts], rounds or 300), rounds
    late = ("phone", "dial", "", "")
    assert late not in brute_graph([t or "" for t in texts], 0) and late in brute_graph([t or "" for t in texts], 20)
    spans = {r.doc_id: r.spans for r in pii.span_report(df).collect()}
    assert spans[174] == "phone:9:23" and spans[150].startswith("phone:") and not any(spans[175 + i] for i in range(5))


def test_personal_data_query_equals_brute_force_on_the_table(spark, documents):
    texts = {d: r.text or "" for d, r in documents.items()}
    accepted = brute_graph(texts.values(), 300)
    n = 0
    for r in queries.op5_pii(spark, SF).collect():
        t = texts[r.doc_id]
        base = brute_pii(t)
        more = [s for s in pii.loose_spans(t, base) if any((s[0], *p) in accepted for p in pii.induced(t, *s))]
        render = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], pii.KINDS.index(s[0]), s[2])))
        assert r.base_sha256 == hashlib.sha256(render(base).encode()).hexdigest() and r.spans == render(base + more)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in pii.KINDS]
        n += 1
    assert n == len(texts)


def test_contexts_and_candidates_have_no_length_limit():
    far = "alpha" + " " * 100_000
    t = far + "4111111111111111" + "!" * 100_000 + "omega"
    a = len(far)
    assert pii.context(t, a, a + 16) == (["alpha", pii.BEGIN], "omega")
    word = "b" * 100_000
    assert pii.context(f"{word} 1.2.3.4", 100_001, 100_008) == ([word, pii.BEGIN], pii.END)
    name = "x" * 500
    t = f"write {name} at {name} dot org now"
    assert pii.loose_spans(t, []) == [("email", 6, 6 + 500 + 4 + 500 + 8)]
    assert pii.loose_spans("a" * 200_000 + " at " + "b" * 200_000, []) == [] and pii.loose_spans("met at home. And", []) == []


def test_tokens_equal_the_reference_tokeniser_and_round_trip(spark, documents):
    ranks = bpe.load_ranks(RANKS)
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coder = bpe.ByteBpe(ranks)
    rng = np.random.default_rng(1)
    parts = ["a", "s", "'", "'s", "'re", "'ll", "'ve", " ", "  ", "\n", "\t", "1", "²", "!", "é", "日本", "́", "😀", "　", "\x1c", " '", "'d"]
    texts = ["".join(rng.choice(parts, int(rng.integers(0, 40)))) for _ in range(2000)] + ["", "x" * 50_000, " " * 999]
    for t, ids in zip(texts, coder.encode_batch(texts), strict=True):
        assert ids == known.encode_ordinary(t), t
        assert coder.decode(ids) == t.encode()
    df = spark.createDataFrame([(1, "it's a test", 9), (2, None, 9), (3, "", 9)], "doc_id long, text string, token_ids int")
    enc = bpe.encode(df, RANKS)
    row = enc.where("doc_id = 1").first()
    assert row.token_ids == known.encode_ordinary("it's a test") and row.token_offsets[0] == 0
    assert {r.doc_id: r.back for r in bpe.decode(enc, RANKS, text_col="back").collect()} == {1: "it's a test", 2: "", 3: ""}


def test_token_query_equals_the_reference_tokeniser_on_the_table(spark, documents):
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})
    n = 0
    for r in queries.op6_bpe(spark, SF).collect():
        t = documents[r.doc_id].text or ""
        ids = known.encode_ordinary(t)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
        n += 1
    assert n == len(documents)


def test_tokens_around_every_code_point():
    ranks = bpe.load_ranks(RANKS)
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coder = bpe.ByteBpe(ranks)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    for at in range(0, len(points), 4096):
        t = "".join(f"a{c} {c}1" for c in points[at : at + 4096])
        assert coder.encode_batch([t])[0] == known.encode_ordinary(t), at


def test_long_and_short_slices_are_merged_alike():
    ranks = bpe.load_ranks(RANKS)
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coder = bpe.ByteBpe(ranks)
    rng = np.random.default_rng(15)
    for n in (2, 9, 60, 127, 128, 129, 400, 3000):
        for letters in ("ab", "etaoin", "abcdefghijklmnopqrstuvwxyz", "x"):
            t = "".join(rng.choice(list(letters), n))
            want = known.encode_ordinary(t)
            assert list(coder.merge(t.encode())) == want and (t.encode() in ranks or list(coder._merge_long(t.encode())) == want)


def test_scan_of_transition_functions_equals_stepping():
    machine = bpe.Transducer()
    symbols = np.random.default_rng(2).integers(0, 9, 5000).astype(np.uint8)
    state, want = bpe.START, []
    for s in symbols:
        state = bpe._step(state, int(s))[0]
        want.append(state)
    assert machine.apply_start[machine.scan(machine.of_symbol[symbols])].tolist() == want


def brute_secrets(t):
    tests = {
        "assign": (r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 12),
        "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
        "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 16),
    }
    found = [(k, *m.span()) for k, (p, ok) in tests.items() for m in re.finditer(p, t) if ok(m)]
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(found, key=lambda s: (s[1], list(tests).index(s[0]))))


def test_secrets_and_window_entropy(spark):
    rng = np.random.default_rng(4)
    parts = ["password", "PASSWD", "token", "api_key", "=", ": ", '"', " ", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "abcdefabcdef", "é", "x", "Secret"]
    texts = ["".join(rng.choice(parts, int(rng.integers(1, 10)))) for _ in range(400)]
    texts += ["key Zq8xR2mLw9Tj4VbN7cKd1PsH end", "see zzzzzzzzzzzzzzzzzzzzzzzzzzzz1", "id 123e4567-e89b-12d3-a456-426614174000 ok", "😀 token=abcdefabcdef12"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r for r in secret_scan.secret_report(df).collect()}
    for i, t in enumerate(texts):
        assert out[i].base_sha256 == hashlib.sha256(brute_secrets(t).encode()).hexdigest(), t
    assert out[400].spans == "entropy:4:28" and out[401].spans == "" and out[402].spans == "" and out[403].spans == "assign:2:22"
    s = "Zq8xR2mLw9Tj4VbN7cKd1PsHaaaaaaaaaaaaaaaaaaaa"
    best = 0.0
    for i in range(len(s) - 19):
        w = s[i : i + 20]
        best = max(best, -sum(w.count(c) / 20 * math.log2(w.count(c) / 20) for c in set(w)))
    got = spark.createDataFrame([(s,)], "s string").select(secret_scan.window_entropy(F.col("s"))).first()[0]
    assert abs(got - best) < 1e-9
    assert secret_scan.mask_secrets(df.where("doc_id = 403")).first().text == "😀 [SECRET]"


def test_long_base64_keys_are_secrets_and_paths_are_not(spark):
    rng = np.random.default_rng(9)
    keys = [base64.b64encode(rng.bytes(n)).decode() for n in (30, 66, 129, 258) for _ in range(50)]
    paths = ["/usr/local/share/doc/python3/readme2024", "src/main/java/toolKit/part01/Widget2", "--max-retry-count-of-worker=25", "a/" * 20_000 + "b1"]
    df = spark.createDataFrame(list(enumerate(f"see {t} end" for t in [*keys, *paths])), "doc_id long, text string")
    out = {r.doc_id: r.spans for r in secret_scan.secret_report(df).collect()}
    missed = [k for i, k in enumerate(keys) if out[i] != f"entropy:4:{4 + len(k)}"]
    assert not missed and not any(out[len(keys) + i] for i in range(len(paths)))


def brute_classes(texts, n=5, threshold=0.8):
    sets = {}
    for d, t in texts.items():
        w = words(t)
        size = min(n, len(w))
        sets[d] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if w else set()
    root, links = {d: d for d in texts}, dict.fromkeys(texts, 0)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(texts), 2):
        both = len(sets[a] & sets[b])
        if both and both >= threshold * (len(sets[a]) + len(sets[b]) - both):
            links[a] += 1
            links[b] += 1
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {d: (find(d), links[d]) for d in texts}


def test_near_duplicates_match_brute_force(spark, documents, monkeypatch):
    rng = np.random.default_rng(6)
    texts = {}
    for g in range(8):
        base = [f"w{x}" for x in rng.integers(0, 400, 80)]
        for k in range(12):
            t = list(base)
            for _ in range(k % 4):
                t[int(rng.integers(80))] = f"v{rng.integers(50)}"
            texts[g * 100 + k] = " ".join(t)
    texts |= {900: "", 901: "a b", 902: "a b", 903: "a b c"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = brute_classes(texts)
    for rows in (1 << 14, 4):  # one block for a group, then many
        monkeypatch.setattr(ngram_join, "BLOCK_ROWS", rows)
        monkeypatch.setattr(ngram_join, "TILE", 5)
        got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.near_duplicates(df).collect()}
        assert got == want
    kept = {r.doc_id for r in ngram_join.drop_near_duplicates(df).collect()}
    assert kept == {d for d, (c, _) in want.items() if c == d}
    own = {d: r.text for d, r in documents.items()}
    assert {r.doc_id: (r.class_id, r.n_links) for r in queries.op8_ngram_join(spark, SF).collect()} == brute_classes(own)


def test_near_duplicates_in_groups_with_an_empty_block(spark, monkeypatch):
    rng = np.random.default_rng(7)
    texts = {}
    for g in range(8):
        base = [f"w{x}" for x in rng.integers(0, 400, 80)]
        texts |= {2 * g: " ".join(base), 2 * g + 1: " ".join([*base, "end"])}
    # Two blocks for two members; by their hashes some groups leave one of them empty.
    monkeypatch.setattr(ngram_join, "BLOCK_GRAMS", 100)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    blocks = [r[0] for r in df.select(F.pmod(F.xxhash64("doc_id"), F.lit(2))).collect()]
    assert any(blocks[2 * g] == blocks[2 * g + 1] for g in range(8))
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.near_duplicates(df).collect()}
    assert got == brute_classes(texts) == {d: (d - d % 2, 1) for d in texts}


def test_near_duplicates_of_ids_that_are_strings(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [("b", base), ("a", base + " end"), ("c", "other words"), (None, base), ("", base)]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.near_duplicates(df).collect()}
    assert got == {"": ("", 2), "a": ("", 2), "b": ("", 2), "c": ("c", 0)}
    assert sorted((r.doc_id is None, r.doc_id) for r in ngram_join.drop_near_duplicates(df).collect()) == [(False, ""), (False, "c"), (True, None)]


def test_key_filter_passes_every_key_and_few_others(spark, monkeypatch):
    keys = spark.range(3000).select(F.xxhash64("id").alias("key"))
    more = spark.range(10_000).select("id", F.xxhash64("id").alias("key"))
    passed = {r.id for r in more.where(membership.key_filter(keys, "key").may_hold(F.col("key"))).collect()}
    assert set(range(3000)) <= passed and len(passed) < 3200
    monkeypatch.setattr(membership, "LEAST", 64)
    monkeypatch.setattr(membership, "MOST", 64)  # far too small: all may pass, none is lost
    assert more.where(membership.key_filter(keys, "key").may_hold(F.col("key"))).count() == 10_000
    assert more.where(membership.key_filter(keys.limit(0), "key").may_hold(F.col("key"))).count() == 0


def test_repeated_rows_and_shared_ids_of_near_duplicates(spark):
    base, other = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    rows = [(2, base, 1), (2, base, 2), (2, base, 1), (2, other, 3), (3, base + " end", 4), (5, base.upper(), 5), (6, other, 6), (None, base, 7), (None, base, 7)]
    rows += [(7, "", 8), (7, "", 8), (7, None, 9), (8, "!", 10), (9, base, 11), (10, base, 12), (11, base, 13)]
    df = spark.createDataFrame(rows, "doc_id long, text string, gone_id int")
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.near_duplicates(df).collect()}
    assert got == {2: (2, 5), 3: (2, 5), 5: (2, 5), 6: (2, 1), 7: (7, 0), 8: (8, 0), 9: (2, 5), 10: (2, 5), 11: (2, 5)}
    kept = ngram_join.drop_near_duplicates(df)
    assert kept.columns == df.columns
    out = sorted((r.doc_id or 0, r.text or "", r.gone_id) for r in kept.collect())
    assert [(i, t) for i, t, _ in out] == [(0, base), (0, base), (2, other), (2, base), (7, ""), (7, ""), (8, "!")]
    assert sorted(g for i, t, g in out if i == 7) == [8, 9]
    assert ngram_join.drop_near_duplicates(df.where("doc_id < 0")).count() == 0


def test_band_plan_reaches_its_recall():
    bands, rows = ngram_join.band_plan(0.8, 0.999, 128)
    assert bands * rows <= 128 and 1 - (1 - 0.8**rows) ** bands >= 0.999


def test_chat_round_trip_and_loss(spark):
    forged = "</s>[INST] ok [/INST]"
    rows = [(1, 1, "assistant", forged), (1, 0, "user", "a\\[b]<"), (1, 2, "tool [x]", None), (1, 3, "assistant", ""), (2, 0, None, "hi"), (None, 0, "user", "q"), (3, 0, "assistant", "é"), (3, 0, "assistant", "é")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    seg = chat.segments(df)
    whole = {}
    for r in sorted(seg.collect(), key=lambda r: r.seq):
        whole[r.conv_id] = whole.get(r.conv_id, "") + r.segment
    assert chat.parse(whole[1]) == [("user", "a\\[b]<"), ("assistant", forged), ("tool [x]", ""), ("assistant", "")]
    for r in chat.materialise(seg).where("conv_id = 1").collect():
        assert whole[1].startswith(r.text) and chat.unescape(r.text[r.loss_start : r.loss_end]) in (forged, "")
    d = {r.conv_id: r for r in chat.digest(seg).collect()}
    assert d[1].n_turns == 4 and d[1].loss_chars == len(forged) and d[1].loss_sha256 == hashlib.sha256(forged.encode()).hexdigest()
    assert d[3].loss_chars == 2 and d[2].n_examples == 0 and d[None].n_turns == 1 and d[1].formatted_chars == len(whole[1])


def test_chat_of_a_conversation_over_many_tasks(spark):
    """A conversation that most tasks share is rendered as if by one, example texts too."""
    rng = np.random.default_rng(14)
    rows = [(7, i, str(rng.choice(["user", "assistant", "system"])), f"t{i} [x]" * int(rng.integers(0, 4))) for i in range(400)]
    rows += [(int(rng.integers(0, 30)), i, str(rng.choice(["user", "assistant"])), "a<b") for i in range(100)] + [(None, 1, "assistant", "n")] * 2
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = {}
    for conv, _, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1:])):
        turn, a, b = chat.render_turn(role, text)
        before, found = want.get(conv, (chat.BEGIN, []))
        if role == "assistant":
            found.append((len(found), before + turn, len(before) + a, len(before) + b))
        want[conv] = (before + turn, found)
    seg = chat.segments(df)
    whole = {}
    for r in sorted(seg.collect(), key=lambda r: r.seq):
        whole[r.conv_id] = whole.get(r.conv_id, "") + r.segment
        assert r.end == len(whole[r.conv_id])
    assert whole == {c: w for c, (w, _) in want.items()}
    got = {}
    for r in sorted(chat.materialise(seg).collect(), key=lambda r: r.example):
        got.setdefault(r.conv_id, []).append((r.text, r.loss_start, r.loss_end))
    assert got == {c: [x[1:] for x in f] for c, (_, f) in want.items() if f}
    out = {r.conv_id: r for r in chat.digest(seg).collect()}
    for c, (w, found) in want.items():
        reply = "".join(chat.unescape(t[a:b]) for _, t, a, b in found)
        assert (out[c].n_examples, out[c].loss_chars, out[c].formatted_chars) == (len(found), len(reply), len(w))
        assert out[c].loss_sha256 == hashlib.sha256(reply.encode()).hexdigest()
    assert chat.conversation_report(df.limit(0)).count() == 0 and chat.materialise(chat.segments(df.limit(0))).count() == 0


def test_license_places_and_templates(spark):
    texts = {
        1: "x\nLicensed under the Apache License, Version 2.0.\ny",
        2: "CC BY cc-by MIT license",
        3: "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        4: "the apache and the license",
        5: None,
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    out = {r.doc_id: r for r in license_scan.license_report(df).collect()}
    assert (out[1].n_base, out[1].first_word, out[1].labels) == (1, 4, "apache")
    assert (out[2].n_base, out[2].first_word, out[2].last_word, out[2].base_labels) == (3, 0, 4, "cc-by,mit")
    assert out[3].labels == "bsd" and out[3].base_labels == "" and out[3].score == 1.0
    assert (out[4].labels, out[4].n_words, out[5].n_words, out[5].first_word) == ("", 5, 0, None)
    # The prefix, length and positional filters lose nothing: compare with all pairs.
    want = {}
    for d, t in texts.items():
        for line in (t or "").split("\n"):
            own = set(words(line))
            for _, label, tpl in license_scan.template_rows():
                tokens = set(tpl.split())
                if len(own & tokens) >= math.ceil(license_scan.THRESHOLD * len(tokens) - 1e-9):
                    want.setdefault(d, set()).add(label)
    got = {}
    for r in license_scan.match_blocks(df).collect():
        for m in r.matches:
            got.setdefault(r.doc_id, set()).add(m.label)
    assert got == want


def test_license_blocks_do_not_depend_on_line_breaks(spark):
    lgpl = license_scan.TEMPLATES["lgpl"][0].split()
    rng = np.random.default_rng(8)
    texts = {
        1: "/* x\n" + "\n".join(" * " + " ".join(lgpl[i : i + 6]) for i in range(0, len(lgpl), 6)) + "\n */ y",
        2: " filler".join(f" {w}" + " z" * 20 for w in "licensed under cc by 4 0".split()),
        3: "z " * 300 + " ".join(lgpl) + " z" * 300,
    }
    for i in range(60):  # pieces of notices, with words dropped and put in
        tpl = [str(rng.choice(license_scan.template_rows(), axis=0)[2]).split() for _ in range(3)]
        texts[10 + i] = " ".join(w for t in tpl for w in t for w in ([] if rng.random() < 0.04 else [w, "z"] if rng.random() < 0.3 else [w]))
    want = {}
    for d, t in texts.items():
        own = words(t)
        for n, label, tpl in license_scan.template_rows():
            tokens, span = set(tpl.split()), math.ceil(license_scan.SPAN * len(tpl.split()))
            most = max(len(tokens & set(own[k : k + span])) for k in range(len(own)))
            if most >= math.ceil(license_scan.THRESHOLD * len(tokens) - 1e-9):
                want[d, n] = most / len(tokens)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {}
    for r in license_scan.match_blocks(df).collect():
        for m in r.matches:
            got[r.doc_id, m.template] = max(m.containment, got.get((r.doc_id, m.template), 0))
    assert got == want and len(want) > 60
    labels = {r.doc_id: r.labels for r in license_scan.license_report(df.where("doc_id < 10")).collect()}
    assert labels == {1: "lgpl", 2: "", 3: "lgpl"}


def brute_licenses(text):
    """Row of the query by plain loops: words, places, labels and score."""
    own, places, base, best = words(text), [], set(), {}
    for phrase, label in license_scan.PHRASES.items():
        p = phrase.split()
        found = [i for i in range(len(own)) if own[i : i + len(p)] == p]
        places += found
        base |= {label} if found else set()
    for _, label, tpl in license_scan.template_rows():
        tokens, span = set(tpl.split()), math.ceil(license_scan.SPAN * len(tpl.split()))
        most = max([len(tokens & set(own[k : k + span])) for k in range(len(own))], default=0)
        if most >= math.ceil(license_scan.THRESHOLD * len(tokens) - 1e-9):
            best[label] = max(best.get(label, 0), most / len(tokens))
    score = 1.0 if base else max(best.values(), default=0.0)
    edge = lambda f: f(places) if places else None
    return len(own), len(places), edge(min), edge(max), ",".join(sorted(base)), ",".join(sorted(base | set(best))), pytest.approx(score)


def test_license_query_equals_brute_force_on_the_table(spark, documents):
    found = queries.op10_license_scan(spark, SF).collect()
    assert len(found) == len(documents) and any(r.labels for r in found)
    for r in found:
        assert tuple(r)[1:] == brute_licenses(documents[r.doc_id].text)


def test_license_labels_belong_to_rows_not_ids(spark):
    kelvin = "this wor\u212a is licensed under the gnu general public license version 3"
    lesser = license_scan.TEMPLATES["lgpl"][0]
    texts = [lesser, "nothing here", lesser, None, kelvin, "MIT license. " * 30_000, "licensed " * 60_000]
    df = spark.createDataFrame([(i, t, 1.0) for i, t in zip([None, None, 7, 7, 8, 9, 10], texts, strict=True)], "doc_id long, words string, matches double")
    found = license_scan.license_report(df, text_col="words").collect()
    assert sorted((r.doc_id or 0, r.labels) for r in found) == sorted(zip([0, 0, 7, 7, 8, 9, 10], ["lgpl", "", "lgpl", "", "gpl", "mit", ""], strict=True))
    by = {r.doc_id: r for r in found}
    assert (by[9].n_base, by[9].first_word, by[9].last_word) == (30_000, 0, 59_998)
    # The Kelvin sign is no letter k.
    w = spark.createDataFrame([(kelvin,)], "t string").select(license_scan.normalised(F.col("t"))).first()[0]
    assert "work" not in w
    # Of all other code points beyond ASCII none is folded to letters a-z alone.
    points = spark.range(0x80, 0x110000).where("id < 55296 or id > 57343").select("id", F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    assert [r.id for r in points.where(F.lower("c").rlike("^[\\x00-\\x7F]+$")).collect()] == [0x212A]
    kept = license_scan.match_blocks(df, text_col="words")
    assert kept.columns == ["doc_id", "words", "matches"] and kept.count() == 7


def test_long_texts_of_many_matches_end_soon(spark):
    rng = np.random.default_rng(12)
    letters = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")
    image = "".join(rng.choice(letters, 100_000))
    rows = [(1, "ab12 " * 200_000), (2, "deadbeef00112233 " * 60_000), (3, f"see {image} end"), (4, "token=abcdef012345xyz " * 30_000), (5, "secret=ab " * 60_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    began = time.monotonic()
    out = {r.doc_id: r for r in secret_scan.secret_report(df).collect()}
    masked = {r.doc_id: r.text for r in secret_scan.mask_secrets(df).collect()}
    assert time.monotonic() - began < 90
    assert out[1].spans == "" and out[2].n_hex == 60_000 and out[3].spans == "entropy:4:100004" and out[4].n_assign == 30_000 and out[5].spans == ""
    for i, t in rows:
        if i != 3:
            assert out[i].base_sha256 == hashlib.sha256(brute_secrets(t).encode()).hexdigest()
    assert masked == {1: rows[0][1], 2: "[SECRET] " * 60_000, 3: "see [SECRET] end", 4: "[SECRET] " * 30_000, 5: rows[4][1]}


def test_entropy_spans_equal_a_window_scan_by_force(spark):
    rng = np.random.default_rng(13)
    alphabets = ["0123456789abcdef", "abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789", "abAB12+/", "aB3"]
    texts, want = [], []
    for _ in range(300):
        parts = ["".join(rng.choice(list(str(rng.choice(alphabets))), int(rng.integers(5, 70)))) for _ in range(int(rng.integers(1, 4)))]
        texts.append(" , ".join(parts))
        spans = []
        for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", texts[-1]):
            s = m[0]
            if re.search(r"AKIA[A-Z0-9]{14,}|[0-9a-f]{16,}", s) or re.search(secret_scan.ALLOW.replace("(?i)", "", 1).replace("(?-i:", "(?-i:"), s, re.I):
                continue
            best = max(-sum(c / 20 * math.log2(c / 20) for c in Counter(s[i : i + 20]).values()) for i in range(len(s) - 19))
            kind = "hex" if re.fullmatch("[0-9a-fA-F-]+", s) else "alnum" if re.fullmatch("[A-Za-z0-9]+", s) else "base64"
            if best >= secret_scan.THRESHOLDS[kind] + 1e-9:
                spans.append(f"entropy:{m.start()}:{m.end()}")
            elif best >= secret_scan.THRESHOLDS[kind] - 1e-9:
                spans = None  # a tie in floating point: not compared
                break
        want.append(spans)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    checked = 0
    for r in secret_scan.secret_report(df).collect():
        if want[r.doc_id] is not None:
            assert [s for s in r.spans.split(",") if s.startswith("entropy")] == want[r.doc_id], texts[r.doc_id]
            checked += len(want[r.doc_id])
    assert checked > 50


def test_overlapping_secrets_are_masked_together_and_columns_kept(spark):
    t = "x 0123456789abcdefapi_key=0123456789abcdef0123 y password: 'hunter2hunter2' z"
    df = spark.createDataFrame([(1, t, 5, 6), (1, t, 5, 6), (None, None, 7, 8)], "doc_id long, text string, assigns int, secrets int")
    out = secret_scan.mask_secrets(df)
    assert out.columns == df.columns
    assert sorted((r.text or "", r.assigns) for r in out.collect()) == [("", 7), ("x [SECRET] y [SECRET]' z", 5), ("x [SECRET] y [SECRET]' z", 5)]
    assert set(secret_scan.find_secrets(df).columns) == {"doc_id", "text", "assigns", "secrets"}


def test_secret_query_equals_brute_force_on_the_table(spark, documents):
    for r in queries.op7_secret_scan(spark, SF).collect():
        want = brute_secrets(documents[r.doc_id].text or "")
        kinds = [s.split(":")[0] for s in want.split(",")]
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [kinds.count(k) for k in ("assign", "access", "hex")]
        assert set(filter(None, want.split(","))) <= set(r.spans.split(","))


def test_pipeline_stages_take_effect(spark, documents):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert len(corpus_pipeline.STAGES) == 5
    classes = brute_classes({d: r.text for d, r in documents.items()})
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    known = {r.doc_id for r in corpus_pipeline.keep_known_language(spark, docs, SF).collect()}
    firsts = {d for d, (c, _) in classes.items() if c == d}
    assert known == set(documents)  # nothing clean is rejected, so classes are those of all documents
    want = {d for d in firsts if not brute_windows(documents[d].text, items)[1]}
    assert set(out) == want
    ranks = bpe.ByteBpe(bpe.load_ranks(RANKS))
    for d, r in out.items():
        assert not brute_pii(r.text) and r.n_chars == len(r.text)
        assert ranks.decode(r.token_ids).decode() == r.text
        if not brute_pii(documents[d].text):
            assert r.text == documents[d].text
