"""Whitening, periodic runs and exact deduplication against plain versions and on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import oracle
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import exact, queries, runs, whitening

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASHING = "doc_id long, text string, row long, key string, best string, _row int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# 11: whitening

def usable(rows):
    return [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows
            if v and all(c is not None and math.isfinite(c) for c in v)]


def check_white(got, rows, components=4):
    rows = usable(rows)
    fit = np.array(sorted({tuple(v) for _, v in rows}), float)
    n, sums = len(fit), fit.sum(0)
    away = fit - sums / n
    cov = away.T @ away / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    by = defaultdict(list)
    for r in got:
        by[r["vec_id"]].append(r)
    assert len(got) == len(rows) * components
    sign = {}
    for i, v in rows:
        own = sorted(by[i], key=lambda r: r["component"])[:components]
        for k, r in enumerate(own):
            expected = (np.array(v) - sums / n) @ vectors[:, k] / math.sqrt(values[k])
            if k not in sign and abs(expected) > 1e-3:
                sign[k] = math.copysign(1, expected * r["whitened"])
            assert abs(r["whitened"] * sign.get(k, 1) - expected) < 1e-9 * (1 + abs(expected))
            assert (r["component"], r["n"]) == (k + 1, n)
            assert r["deviation"] == sum((n * c - int(s)) ** 2 for c, s in zip(v, sums))
            assert math.isclose(r["explained"], values[k] / np.trace(cov), rel_tol=1e-9)
            assert r["identity_error"] < 1e-9


def test_whitening(spark):
    got = queries.QUERIES["op11_whitening"](spark, FOLDER).collect()
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet")
            .select("vec_id", "embedding").collect()]
    check_white(got, rows)


VECTORS = "vec_id long, embedding array<float>, x int, label string, n int"


def test_whitening_of_odd_rows(spark):
    r = random.Random(3)
    rows = [(i, [r.gauss(0, 3 - k / 4) for k in range(6)]) for i in range(60)]
    rows += [(60, None), (61, []), (62, [1.0, None, 2.0, 0.0, 0.0, 0.0]), (63, [math.nan] * 6),
             (64, [math.inf] + [0.0] * 5)]
    rows += [(100 + i, rows[0][1]) for i in range(50)]
    odd = [(200, [1.0, 2.0])]                   # of another length
    df = spark.createDataFrame([(i, v, 1, "a", 2) for i, v in rows + odd], VECTORS)
    got = whitening.whiten(df).collect()
    assert {g["vec_id"] for g in got} == {*range(60), *range(100, 150)}
    check_white(got, rows)
    # Repeated rows, and rows without id.
    twice = spark.createDataFrame([(i, v, 1, "a", 2) for i, v in rows[:20] * 2 + [(None, rows[1][1])]],
                                  VECTORS)
    assert whitening.whiten(twice).count() == 41 * 4


def test_whitening_of_few_directions(spark):
    def white(vectors):
        return whitening.whiten(spark.createDataFrame(
            [(i, v, 1, "a", 2) for i, v in enumerate(vectors)], VECTORS)).collect()

    assert white([]) == [] and white([[1.0, 2.0]]) == [] and white([[1.0, 2.0]] * 3) == []
    line = white([[float(i), 2.0 * i, 0.5] for i in range(5)])
    assert {r["component"] for r in line} == {1} and len(line) == 5
    assert math.isclose(line[0]["explained"], 1)
    plane = white([[float(i), float(i * i)] for i in range(5)])
    assert {r["component"] for r in plane} == {1, 2}
    equal = white(np.vstack([np.eye(5), -np.eye(5)]).tolist())    # all eigenvalues equal
    assert len(equal) == 40 and max(r["identity_error"] for r in equal) < 1e-12


@pytest.mark.parametrize("seed,d", [(0, 1), (1, 4), (2, 9), (3, 40), (4, 150)])
def test_leading_pairs(seed, d):
    a = np.random.default_rng(seed).standard_normal((d, 2 * d))
    v, asked = a @ a.T, []

    def times(u):
        asked.append(u.shape[1])
        return v @ u

    values, vectors = whitening.leading(times, d, 4)
    assert np.allclose(values, np.linalg.eigvalsh(v)[::-1][:4], rtol=1e-12)
    assert np.linalg.norm(v @ vectors - vectors * values, axis=0).max() <= 1e-12 * values[0]
    assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-12)
    assert len(asked) <= 200 and max(asked) <= 2 * (4 + whitening.EXTRA)


def test_minres_solves_indefinite_systems():
    r = np.random.default_rng(5)
    q, _ = np.linalg.qr(r.standard_normal((30, 30)))
    a = q @ np.diag(np.linspace(-2, 5, 30)) @ q.T
    b = np.column_stack([r.standard_normal((30, 2)), np.zeros(30)])
    x = whitening.minres(lambda t: a @ t, b, 60, 1e-12)
    assert np.allclose(a @ x, b, atol=1e-8)


def test_deviations_beyond_64_bits():
    x = np.array([[2 ** 40, 1], [0, 0]])
    got = whitening._squares(x, 2 ** 30, np.array([5, 7])).to_pylist()
    assert got == [None, 25 + 49]


# 12: runs

def brute_runs(words):
    out, n = {}, len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, k, q) for (s, k), q in out.items())


def brute_row(words):
    found = sorted(brute_runs(words), key=lambda r: (r[0], r[2]))
    gone = {i for s, k, q in found for i in range(s + q, s + k)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    return (len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            sha("".join(f"{s},{k},{q}\n" for s, k, q in found)),
            sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_runs(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.QUERIES["op12_runs"](spark, FOLDER).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        assert got[i] == brute_row(planted(i, WORD.findall(t or ""))), i


def periodic(r):
    words = []
    while len(words) < r.randrange(1, 700):
        if r.random() < 0.6:
            p = [r.choice("abcdefgh") if r.random() < 0.5 else str(r.randrange(500))
                 for _ in range(r.choice([1, 2, 3, 5, 8, 15, 16, 17, 18, 31, 32, 33, 34, 63, 64, 65, 90]))]
            words += (p * 8)[:len(p) * r.choice([3, 4, 4, 5, 6]) + r.randrange(-2, 3)]
            if r.random() < 0.3 and words:
                words[r.randrange(len(words))] = "odd"
        else:
            words += [r.choice("ab") if r.random() < 0.4 else str(r.randrange(900)) for _ in range(20)]
    return words


@pytest.mark.parametrize("seed", range(25))
def test_runs_of_random_periodic_texts(seed):
    r = random.Random(seed)
    docs = [periodic(r) for _ in range(6)] + [[], ["a"], ["a"] * 5, ["a"] * 6, list("ab" * 400)]
    r.shuffle(docs)
    got = runs._reported(pa.array([" ".join(d) for d in docs], pa.large_string()))
    names = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    assert list(zip(*(got[c].to_pylist() for c in names))) == [brute_row(d) for d in docs]


def test_runs_of_odd_rows(spark):
    long = ["w%d" % (i % 5000) for i in range(40_000)]
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "a b " * 2_000), (5, "a b " * 2_000),
            (None, "é é\té\né é  é é é é é"), (7, " ".join(long)), (None, None),
            (8, "x y z " * 3 + "x y"), (9, "x y z " * 4)]
    df = spark.createDataFrame([(i, t, 1, "k", "b", 2) for i, t in rows], CLASHING)
    got = sorted(tuple(r) for r in runs.report(df).select("n_words", "n_runs", "length", "period").fillna(
        -1).collect())
    words = [WORD.findall(t or "") for _, t in rows]
    assert got == sorted((len(w), *((brute_row(w)[0], *brute_row(w)[2:4]) if len(w) < 5_000 else
                                    (1, 40_000, 5_000))) if len(w) > 5 and brute_runs(w[:30_000])
                         else (len(w), 0, -1, -1) for w in words)
    assert runs.report(df.limit(0)).count() == 0
    kept = runs.collapsed(df)
    assert kept.columns == df.columns
    texts = {(r["doc_id"], r["text"]) for r in kept.collect()}
    assert {(5, "a b"), (9, "x y z"), (1, None), (2, ""), (3, " \t\n"), (4, "one")} <= texts
    assert {tuple(r) for r in runs.all_runs(df).where("doc_id = 9").collect()} == {(9, 0, 12, 3)}
    assert runs.made_periodic(df).count() == len(rows)


# 13: exact copies

def brute_copies(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i))
    return sorted((i, min(groups[k])[1], len(groups[k]), i == min(groups[k])[1], sha(k))
                  for i, t in rows for k in [re.sub(r"[\x20\x09-\x0D]", "", t or "")])


def test_exact(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    got = queries.QUERIES["op13_exact"](spark, FOLDER)
    assert sorted(map(tuple, got.collect())) == brute_copies(rows)
    assert oracle.actual(got) == oracle.expected(oracle.connect(FOLDER), queries.ORACLES["op13_exact"])


def test_exact_hot_group(spark):
    r = random.Random(1)
    rows = [(i, r.choice(["one text", "one  text", "onetext\n"]) if i % 3 == 0 else f"text {i % 40}")
            for i in range(900)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert sorted(map(tuple, exact.report(df).collect())) == brute_copies(rows)
    stay = {r[1] for r in brute_copies(rows)}
    assert {r["doc_id"] for r in exact.distinct(df).collect()} == stay


def test_exact_tells_collisions_apart(spark):
    rows = [(i, f"text {i % 7}") for i in range(60)] + [(60, None), (61, ""), (62, "\t")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)

    def weak(text):
        return F.length(text)

    columns = ["doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha256"))]
    got = exact.grouped(df, hashed=weak).select(*columns)
    assert sorted(map(tuple, got.collect())) == brute_copies(rows)


def test_exact_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "x" * 50_000), (5, "x" * 50_000), (5, "x" * 50_000),
            (None, "no id"), (None, "noid"), (7, "noid "), (None, "alone"), (8, "é é"), (9, "éé")]
    df = spark.createDataFrame([(i, t, 1, "k", "b", 2) for i, t in rows], CLASHING)
    got = defaultdict(list)
    for r in exact.report(df).collect():
        got[r["doc_id"]].append((r["keep_id"], r["group_size"], r["kept"]))
    assert got[3] == [(3, 3, True)] and got[1] == [(3, 3, False)] and got[4] == [(4, 3, True)]
    assert got[5] == [(4, 3, False)] * 2
    # The longest first: "no id" and "noid " are equally long, and an id comes before none.
    assert got[7] == [(7, 3, True)]
    assert sorted(map(str, got[None])) == sorted(map(str, [(7, 3, False)] * 2 + [(None, 1, True)]))
    assert got[8] == [(8, 1, True)] and got[9] == [(9, 1, True)]
    kept = exact.distinct(df)
    assert kept.columns == df.columns and kept.count() == 6
    assert exact.report(df.limit(0)).count() == 0 and exact.distinct(df.limit(0)).count() == 0
    # Rows of one id with equal texts are still one group, of which one row stays.
    same = spark.createDataFrame([(1, "a b")] * 3, "doc_id long, text string")
    assert sorted(r["kept"] for r in exact.report(same).collect()) == [False, False, True]
