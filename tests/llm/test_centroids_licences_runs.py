"""Centroid clustering, licence scan and periodic runs against brute force, and on awkward input."""

import hashlib
import json
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelweave.llm import centroids, license_scan, queries, word_runs
from panelweave.llm.oracle import ORACLE
from tools.check_oracle import compare, duck

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name", ["op11_centroid_search", "op12_license_scan"])
def test_queries_equal_their_sql(spark, name):
    assert name in ORACLE and compare(spark, duck(FOLDER), FOLDER, name) is None


# Centroids


def plain_clusters(rows, k, rounds, seed, dims):
    """(id, cluster, distance) of every usable vector, by comparing it with every centroid, in Python's numbers."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v):
            kept.append((i, [int(np.floor(256 * float(x))) for x in v]))
    digest = lambda i: hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()
    means = [v for _, v in sorted(kept, key=lambda r: (r[0] is None, digest(r[0]), r[1]))[:k]]
    for last in range(rounds + 1):
        best = []
        for _, v in kept:
            best.append(min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), c) for c, m in enumerate(means)))
        if last == rounds:
            return [(i, c, d) for (i, _), (d, c) in zip(kept, best, strict=True)], means
        for c in range(len(means)):
            own = [v for (_, v), (_, b) in zip(kept, best, strict=True) if b == c]
            if own:
                means[c] = [sum(column) // len(own) for column in zip(*own, strict=True)]


def test_clusters_against_all_distances(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(4)]) for i in range(150)]
    rows += [(i, rows[i % 7][1]) for i in range(150, 190)]  # equal vectors, so ties
    rows += [(3, rows[3][1]), (3, [0.5] * 4)]  # repeated ids
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    float_rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    expected, means = plain_clusters(float_rows, 12, 4, 7, 4)
    got = centroids.cluster_vectors(df, 12, 4, 7, dims=4).collect()
    assert sorted((r.vec_id, r.cluster, r.distance) for r in got) == sorted(expected)
    assert {r.cluster: r.centroid for r in got} == {c: means[c] for _, c, _ in expected}
    total = sum(d for _, _, d in expected)
    assert {r.inertia for r in got} == {total}
    assert all(r.cluster_inertia == sum(d for _, c, d in expected if c == r.cluster) for r in got)


def test_orchard_search_finds_the_first_nearest_and_measures_less():
    rng = np.random.default_rng(2)
    centres = np.concatenate([rng.integers(-9, 9, (30, 2)), [[0, 0], [0, 0]]])
    x = rng.integers(-9, 9, (500, 2))
    best, least = centroids.nearest(x, centres, centroids.neighbours(centres))
    every = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
    assert (best == every.argmin(axis=1)).all() and (least == every.min(axis=1)).all()
    order, stop = centroids.neighbours(centres)
    # A vector on its centroid stops at the first other one that is farther than nothing.
    assert stop[0, -1] > 0 and (stop >= 0).all() and len(order) == 32


def test_clusters_of_awkward_vectors(spark):
    schema = "vec_id long, embedding array<double>, label int, cluster int, id string, distance int"
    rows = [
        (None, [1.0, 2.0], 1, 5, "x", 2),
        (1, None, None, 5, "x", 2),
        (2, [None, 1.0], 1, 5, "x", 2),
        (3, [float("nan"), 1.0], 1, 5, "x", 2),
        (4, [1.0], 1, 5, "x", 2),
        (5, [1e300, -1e300], 1, None, None, None),
        (6, [], 1, 5, "x", 2),
        (7, [0.0, 0.0], 1, 5, "x", 2),
        (7, [0.0, 0.0], 1, 5, "x", 2),
    ]
    df = spark.createDataFrame(rows, schema)
    got = centroids.cluster_vectors(df, 9, 2, 2, dims=2).collect()
    assert sorted((r.vec_id is not None, r.vec_id or 0) for r in got) == [(False, 0), (True, 5), (True, 7), (True, 7)]
    assert all(r.distance == 0 and r.inertia == 0 for r in got)
    # Equal vectors: the smaller number takes both.
    assert len({r.cluster for r in got if r.vec_id == 7}) == 1
    most = centroids.largest_component(2)
    assert [r.centroid for r in got if r.vec_id == 5] == [[most, -most]]
    empty = centroids.cluster_vectors(df.limit(0), 9, 2, 2, dims=2)
    assert empty.count() == 0 and empty.columns == got[0].__fields__


# Licences


def plain_licences(text, templates, percent):
    """Places of phrases and matching blocks of one text, template by template."""
    words_of = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = words_of(text)
    places = []
    for phrase, label in license_scan.PHRASES.items():
        parts = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(parts)] == parts]
    blocks = []
    for t in templates:
        own = set(words_of(t.text.lower()))
        kind = "line" if t.within == "\n" else "paragraph"
        for b, block in enumerate(re.split(t.within, text)):
            common = len(own & set(words_of(block)))
            if 100 * common >= percent * len(own):
                blocks.append((kind, b, t.label, common / len(own)))
    return len(words), sorted(places), sorted(blocks)


def licence_texts():
    rng = random.Random(3)
    vocabulary = sorted({w for t in license_scan.TEMPLATES for w in t.text.split()}) + ["über", "x1", "Straße"]
    texts = [None, "", " \n\n ", "All rights\nreserved. CC BY cc, by CC-BY-NC 4.0", "reserved rights all", "general public license" * 2]
    for t in license_scan.TEMPLATES:
        words = t.text.split()
        for missing in (0, 1, 2, 3, 5):
            kept = [w for i, w in enumerate(words) if i not in set(rng.sample(range(len(words)), min(missing, len(words))))]
            rng.shuffle(kept)
            texts.append("Some words.\n" + " ".join(kept).title() + "\n \nmore\x0b\n\nAnd " + "\n".join(kept) + "\nend.")
    for _ in range(60):
        texts.append("".join(rng.choice(vocabulary) + rng.choice(["  ", " ", " ", "\n", "\n\t\n", "-", "é"]) for _ in range(150)))
    return texts


@pytest.mark.parametrize("percent", [90, 60])
def test_licences_against_every_block_and_template(spark, percent):
    texts = licence_texts()
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS)
    got = license_scan.scan_licences(df, percent=percent).collect()
    assert len(got) == len(texts) and sum(len(r.blocks) for r in got) > 50
    for r in got:
        found = [tuple(p) for p in r.places], sorted(tuple(b) for b in r.blocks)
        assert (r.n_words, *found) == plain_licences(texts[r.row.doc_id], license_scan.TEMPLATES, percent)


def test_licences_of_awkward_rows(spark):
    long = "word " * 100_000 + "\nReleased under the MIT License.\n" + "z" * 100_000
    rows = [(1, long, "a", "b", "c"), (None, None, None, None, None), (2, "x", "a", "b", "c"), (2, "x", "a", "b", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, words string, blocks string, row string")
    got = license_scan.scan_licences(df).collect()
    assert sorted((r.row.doc_id or 0, r.n_words, len(r.blocks)) for r in got) == [(0, 0, 0), (1, 100_006, 1), (2, 1, 0), (2, 1, 0)]
    assert license_scan.scan_licences(df.limit(0)).count() == 0
    assert license_scan.scan_licences(df, templates=[]).count() == 4


def test_licence_scan_runs_no_python_and_shuffles_no_documents(spark):
    df = spark.read.parquet(f"{FOLDER}/documents.parquet")
    plan = license_scan.scan_licences(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


# Runs


def plain_runs(words):
    """Runs by their definition, period by period."""
    runs = []
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            own = words[i : i + length]
            if j > i and length >= max(6, 4 * q) and not any(own[r:] == own[:-r] for r in range(1, q)):
                runs.append((i, length, q))
            i = max(j, i + 1)
    return sorted(runs)


def plain_collapsed(words, runs):
    gone = {k for i, length, q in runs for k in range(i + q, i + length)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def periodic_words(rng):
    words = []
    for _ in range(rng.randrange(6)):
        base = [rng.choice("abc") for _ in range(rng.randrange(1, 30))]
        words += (base * 200)[: rng.randrange(200)]
    return words


@pytest.mark.parametrize("together", [1 << 18, 50])
def test_runs_against_the_definition(spark, monkeypatch, together):
    rng = random.Random(together)
    texts = [periodic_words(rng) for _ in range(150)]
    monkeypatch.setattr(word_runs, "TOGETHER", together)
    for words, (runs, kept) in zip(texts, zip(*searched(texts), strict=True), strict=True):
        assert [tuple(r) for r in runs.tolist()] == plain_runs(words)
        assert kept.decode() == plain_collapsed(words, plain_runs(words))


def searched(texts):
    return word_runs._searched([[w.encode() for w in words] for words in texts])


def test_wavelet_tree_successors():
    rng = np.random.default_rng(1)
    values = rng.permutation(777)
    tree = word_runs.WaveletTree(values)
    low = rng.integers(0, 777, 500)
    high = np.minimum(777, low + rng.integers(0, 90, 500))
    after = rng.integers(0, 777, 500)
    expected = [min((v for v in values[a:b] if v > x), default=-1) for a, b, x in zip(low, high, after, strict=True)]
    assert tree.successor(low, high, after).tolist() == expected


def test_periodic_run_query_against_plain_python(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.QUERIES["op13_word_runs"](spark, FOLDER).collect()}
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    chosen = 0
    for doc_id, text in docs:
        words = (text or "").encode().split()
        words = [w.decode() for w in words]
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            chosen += 1
        # Long texts only up to a bound that keeps the definition's cost in check.
        if n > 3000:
            continue
        runs = plain_runs(words)
        row = got[doc_id]
        assert row.n_runs == len(runs)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
        assert (row.start, row.length, row.period) == best
        assert row.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert row.runs_sha256 == sha("".join(f"{i},{length},{q}\n" for i, length, q in runs))
        assert row.collapsed_sha256 == sha(plain_collapsed(words, runs))
    assert chosen > 10 and len(got) == len(docs)


def test_runs_of_awkward_rows(spark):
    long = "a b c " * 60_000
    rows = [(1, long, "x"), (None, None, None), (2, "", "x"), (3, "a\x1ca a " * 6, "x"), (3, "a\x1ca a " * 6, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = sorted(word_runs.word_runs(df).collect(), key=lambda r: r.doc_id or 0)
    assert [(r.doc_id, r.n_words, json.dumps([list(x) for x in r.runs]), r.collapsed) for r in got] == [
        (None, 0, "[]", ""),
        (1, 180_000, "[[0, 180000, 3]]", "a b c"),
        (2, 0, "[]", ""),
        (3, 6, "[[0, 6, 1]]", "a\x1ca a"),
        (3, 6, "[[0, 6, 1]]", "a\x1ca a"),
    ]
    assert word_runs.word_runs(df.limit(0)).count() == 0
    awkward = spark.createDataFrame([(None, "a b"), (7, None)], "doc_id long, text string")
    assert [r.text for r in queries.repeating_words(awkward).orderBy(F.asc_nulls_first("doc_id")).collect()] == ["a b", ""]
