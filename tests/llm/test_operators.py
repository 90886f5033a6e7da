"""The text operators against brute force, on the smallest tables and on odd rows."""

import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import brute
import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import (components, fingerprints, lines, minhash, packing, pages, pii, queries,
                          repetition, sharding, toxicity, unigram, words)

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string, hash int"
LONG = "wort " * 30_000
ODD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one two three"), (5, "one two three"), (6, "One Two THREE"),
    (7, LONG), (8, "x" * 60_000), (9, "a b c d e f g h i j k l m n o p q r s t"),
    (10, "a b c d e f g h i j k l m n o p q r s t"), (11, "é ü 日本 🙂\n\n" * 40),
    (12, "mail me: jo.do@mail.example.org, card 4111 1111 1111 1111, ip 10.0.0.255."),
    (12, "mail me: jo.do@mail.example.org, card 4111 1111 1111 1111, ip 10.0.0.255."),
    (None, "no id at all, but some words in it that make a line"), (None, None),
    (13, "a line of text that is here twice\na line of text that is here twice\nshort"),
    (14, "a line of text that is here twico\r\nanother line that stands alone"),
    (15, "a line of text that i here twice"),
]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", None, None if t is None else len(t), "x", 1)
                                  for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return sorted((r["doc_id"], r["text"]) for r in docs.collect())


def by_id(df, key="doc_id"):
    rows = df.collect()
    out = {r[key]: r for r in rows}
    assert len(out) == len(rows)
    return out


# 1: fingerprints

def check_edited(got, texts):
    for k, (i, t) in enumerate(texts):
        t, n = t or "", texts[(k + 1) % len(texts)][1] or ""
        q = len(t) // 4
        edited = t[:len(t) - q] + n[:q]
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (
            len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
        if edited == t:
            assert got[i]["near_edited"] == 1
    prints = defaultdict(set)
    for i, t in texts:
        prints[t or ""].add(got[i]["fingerprint"])
    assert all(len(v) == 1 for v in prints.values())


def test_fingerprints(docs, texts):
    got = by_id(fingerprints.edited_fingerprints(docs))
    check_edited(got, texts)
    assert np.mean([g["near_edited"] > g["near_next"] for g in got.values()]) > 0.97


def test_fingerprints_of_odd_rows(spark):
    rows = sorted({(i, t) for i, t in ODD if i is not None}, key=lambda r: r[0])
    check_edited(by_id(fingerprints.edited_fingerprints(table(spark, rows))), rows)
    assert fingerprints.edited_fingerprints(table(spark, ODD)).count() == len(ODD)
    alone = by_id(fingerprints.edited_fingerprints(table(spark, [(1, "only one here")])))
    assert alone[1]["near_next"] == 1
    assert fingerprints.edited_fingerprints(table(spark, [])).count() == 0


def test_fingerprint_is_a_multiset_hash(spark):
    df = spark.createDataFrame([("p one.\nq two words\np one.", "q two words\np one.\n\np one.",
                                 "p one.\nq two words", "p one.")], "a string, b string, c string, d string")
    f = {c: fingerprints.fingerprint(F.col(c)) for c in "abcd"}
    r = df.select(
        (fingerprints.as_text(f["a"]) == fingerprints.as_text(f["b"])).alias("order"),
        (fingerprints.as_text(f["a"]) == fingerprints.as_text(f["c"])).alias("count"),
        (fingerprints.as_text(fingerprints.combine(f["c"], f["d"])) ==
         fingerprints.as_text(f["a"])).alias("plus"),
        (fingerprints.as_text(fingerprints.combine(f["a"], f["d"], -1)) ==
         fingerprints.as_text(f["c"])).alias("minus")).first()
    assert (r["order"], r["count"], r["plus"], r["minus"]) == (True, False, True, True)


# 2: packing

def check_packed(rows, texts):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(queries.tokenizer("word_bpe_49k.json"))
    windows, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append(r)
    for w in windows.values():
        ends = list(itertools.accumulate((n for _, n in sorted(w)), initial=0))
        assert [o for o, _ in sorted(w)] == ends[:-1] and ends[-1] <= packing.CAPACITY
    for i, t in texts:
        ids = np.array(model.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        own = sorted(pieces[i], key=lambda r: r["start"])
        assert [r["start"] for r in own] == list(range(0, len(ids), packing.CAPACITY))
        for r in own:
            part = ids[r["start"]:r["start"] + r["length"]]
            assert len(part) == r["length"] and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(part.tobytes())
    lengths = [r["length"] for r in rows]
    assert Counter(sum(n for _, n in w) for w in windows.values()) == brute.best_fit_fills(
        lengths, packing.CAPACITY)


def test_packing(docs, texts):
    check_packed(packing.pack(docs, queries.tokenizer("word_bpe_49k.json")).collect(), texts)


def test_packing_of_odd_rows(spark):
    path = queries.tokenizer("word_bpe_49k.json")
    rows = list({r[0]: r for r in ODD if r[0] is not None}.values()) + [
        (20, "a.́b é.x <|endoftext|> foo<|startoftext|>bar it's I'LL. 12.5%off a,b;c ΣΑΣ. İx.")]
    check_packed(packing.pack(table(spark, rows), path).collect(), rows)
    assert packing.pack(table(spark, ODD), path).where("start = 0").count() == len(ODD)
    assert packing.pack(table(spark, []), path).count() == 0


@pytest.mark.parametrize("seed", range(40))
def test_best_fit_decreasing(seed):
    r = random.Random(seed)
    capacity = r.choice([1, 5, 16, 40])
    lengths = [r.randint(1, capacity) for _ in range(r.randint(0, 60))]
    fills, seen = Counter(), Counter()
    for length, rank, n, first, offset in packing.best_fit_decreasing(Counter(lengths), capacity):
        assert rank == seen[length]
        seen[length] += n
        for w in range(first, first + n):
            assert fills[w] == offset
            fills[w] += length
    assert seen == Counter(lengths)
    assert Counter(fills.values()) == brute.best_fit_fills(lengths, capacity)


# 3: toxicity

def test_ordinal_regression_recovers_order():
    r = np.random.default_rng(0)
    x = r.normal(size=(3000, 2))
    y = np.digitize(2 * x[:, 0] + r.logistic(size=3000), [-1.0, 1.0, 3.0])
    rows, columns = np.repeat(np.arange(3000), 2), np.tile([0, 1], 3000)
    w, theta = toxicity.fit_ordinal(rows, columns, x.ravel(), y, 2)
    assert abs(w[0] - 2) < 0.3 and abs(w[1]) < 0.2
    assert np.allclose(theta, [-1, 1, 3], atol=0.4)


def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    hold = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    model = toxicity.fit(docs, labels.where(~hold))
    rows = [(x["p1"] >= 0.5, x["label"]) for x in toxicity.grade(docs, model).join(
        labels.where(hold).select("doc_id", F.col("toxic").alias("label")), "doc_id").collect()]
    hits = sum(p for p, y in rows if y) / sum(1 for _, y in rows if y)
    wrong = sum(p for p, y in rows if not y) / sum(1 for _, y in rows if not y)
    assert hits > 0.88 and wrong < 0.02


def test_toxicity_of_odd_rows(spark):
    labels = spark.createDataFrame([(4, 1, "x"), (9, 0, "x"), (None, 1, "x"), (10, None, "x")],
                                   "doc_id long, toxic int, text string")
    model = toxicity.fit(table(spark, ODD), labels)
    assert toxicity.grade(table(spark, ODD), model).count() == len(ODD)
    nothing = toxicity.fit(table(spark, ODD), labels.where("false"))
    assert toxicity.grade(table(spark, ODD), nothing).where("toxic").count() == 0
    assert toxicity.grade(table(spark, []), nothing).count() == 0


# 4: MinHash

def check_links(got, texts):
    for i, (n, component) in brute.linked(texts).items():
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (
            n, component, component == i), i


def test_minhash(docs, texts):
    check_links(by_id(minhash.link(docs)), texts)


def test_minhash_groups_of_near_copies(spark):
    """Copies of a text that drift apart: links chain through the group."""
    r = random.Random(3)
    rows, n = [], 0
    for group in range(4):
        words = [f"w{r.randrange(5000)}" for _ in range(120)]
        for copy in range(25):
            own = list(words)
            for _ in range(r.randrange(6)):
                own[r.randrange(120)] = f"v{r.randrange(9000)}"
            rows.append((n, " ".join(own)))
            n += 1
            if copy % 8 == 7:
                words = own
    check_links(by_id(minhash.link(table(spark, rows))), rows)


def test_minhash_of_a_group_around_a_template(spark):
    """Rows of one hub share most of what sets them apart from it, and are no pairs for that."""
    hub = list(range(1000, 1100))

    def row(rep, own):
        added, removed = sorted([*range(20), *own]), hub[60:]
        return 1, rep, 100, 100, added + removed, True

    def own(k):
        return [10_000 * k + i for i in range(20)]

    rows = [row(k, own(k)) for k in range(2, 62)] + [row(62, own(2)), row(63, own(3)), row(63, own(3))]
    apart = spark.createDataFrame(rows, "hub long, rep long, n int, m int, delta array<long>, far boolean")
    nothing = spark.createDataFrame([], "node long, component long")
    assert sorted(map(tuple, minhash._across(apart, nothing).collect())) == [(62, 2), (63, 3)]
    joined = spark.createDataFrame([(62, 2)], "node long, component long")
    assert sorted(map(tuple, minhash._across(apart, joined).collect())) == [(63, 3)]


def test_minhash_pairs_between_far_and_near_rows(spark):
    """Families on a common template against brute force, so that links cross components."""
    r = random.Random(9)
    rows, n = [], 0
    for _ in range(6):
        template = [f"t{r.randrange(10**6)}" for _ in range(60)]
        for _ in range(14):
            words = list(template)
            for _ in range(r.randrange(1, 5)):
                at = r.randrange(len(words))
                words[at:at + r.randrange(1, 6)] = [f"w{r.randrange(60)}" for _ in range(r.randrange(0, 6))]
            n += 1
            rows.append((n, " ".join(words)))
    r.shuffle(rows)
    check_links(by_id(minhash.link(table(spark, rows))), rows)


def test_minhash_of_odd_rows(spark):
    rows = list({r[0]: r for r in ODD if r[0] is not None}.values())
    check_links(by_id(minhash.link(table(spark, rows))), rows)
    got = minhash.link(table(spark, ODD)).collect()
    assert len(got) == len(ODD)
    assert all(r["component_id"] is None and r["kept"] for r in got if r["doc_id"] is None)
    kept = minhash.keep_one(table(spark, ODD))
    assert kept.columns == table(spark, []).columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == [
        1, 2, 3, 4, 7, 8, 9, 11, 12, 12, 13, 14, 15]
    assert minhash.link(table(spark, [])).count() == 0


def test_rows_of_one_id_share_their_links(spark):
    a, b, c = "k l m n o p q", "r s t u v w x", "y z a b c d e"
    got = minhash.link(table(spark, [(1, a), (3, a), (3, b), (2, b), (5, c)])).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(1, 1), (3, 1), (2, 1), (5, 5)}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    r = random.Random(seed)
    links = [(r.randrange(40), r.randrange(40)) for _ in range(25)] + [(50 + i, 51 + i) for i in range(20)]
    root = {x: x for p in links for x in p}
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = components.components(spark.createDataFrame(links, "a long, b long"))
    tied = {x for a, b in links if a != b for x in (a, b)}
    assert {(x["node"], x["component"]) for x in got.collect()} == {(x, root[x]) for x in tied}


# 5: sharding

def check_shards(rows, texts, old, new):
    slots, sizes = defaultdict(list), Counter()
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    if sizes:
        most, mean = max(r["size"] for r in rows), sum(sizes.values()) / new
        assert all(abs(sizes[j] - mean) <= (old + 1) * most for j in range(new))
    return sizes


def test_sharding(docs, texts):
    rows = sharding.reshard(docs, 12, 16).collect()
    sizes = check_shards(rows, texts, 12, 16)
    moved = sum(r["size"] for r in rows if r["shard"] != r["old_shard"]) / sum(sizes.values())
    assert moved < 0.35


def test_sharding_of_odd_rows(spark, tmp_path):
    df = table(spark, ODD)
    check_shards(sharding.reshard(df, 3, 5).collect(), ODD, 3, 5)
    assert sharding.reshard(table(spark, []), 3, 5).count() == 0
    rows = df.where("doc_id is not null").dropDuplicates(["doc_id"])
    moved = rows.join(sharding.reshard(rows, 3, 5).select("doc_id", "old_shard", "shard"), "doc_id")
    changed = sharding.rewrite(moved, "shard", "old_shard", str(tmp_path / "a"), str(tmp_path / "b"))
    files = spark.read.parquet(str(tmp_path / "b"))
    want = {(r["doc_id"], r["shard"]) for r in moved.collect() if r["shard"] in changed}
    assert {(r["doc_id"], r["shard"]) for r in files.collect()} == want


@pytest.mark.parametrize("seed", range(20))
def test_cheapest_flow(seed):
    r = random.Random(seed)
    old = {i: r.randrange(30) for i in range(r.randint(1, 5))}
    total, new = sum(old.values()), r.randint(1, 6)
    cuts = sorted(r.randint(0, total) for _ in range(new - 1))
    capacity = {j: b - a for j, (a, b) in enumerate(zip([0, *cuts], [*cuts, total]))}
    flow = sharding.cheapest_flow(old, capacity)
    for i, v in old.items():
        assert sum(x for (a, _), x in flow.items() if a == i) == v
    for j, v in capacity.items():
        assert sum(x for (_, b), x in flow.items() if b == j) == v
    # What can stay, stays: the least that has to move is known in closed form.
    assert sum(x for (a, b), x in flow.items() if a != b) == total - sum(
        min(v, capacity.get(i, 0)) for i, v in old.items())


# 6: lines

def check_lines(got, texts, **options):
    want = brute.dropped_lines(texts, **options)
    for i, t in texts:
        assert got[i]["dropped"] == want.get(i, []), i
        assert got[i]["n_lines"] == (len(t.split("\n")) if t else 0)


def test_lines(spark, texts):
    """The registered query with its own parameters, over the whole table."""
    check_lines(by_id(queries.QUERIES["op6_lines"](spark, FOLDER)), texts, edits=3, least=1)


def test_lines_of_rows_that_share_an_id(spark):
    """A drop holds for a line, not for what stands in its place in another row."""
    rows = [(1, "R"), (None, "A\nB"), (None, "C\nR"), (5, "D\nR"), (5, "E\nF\nG"), (None, "H\nA")]
    df = table(spark, rows)
    got = sorted((str(r["doc_id"]), r["n_lines"], tuple(r["dropped"]))
                 for r in lines.report(df, edits=3, least=1).collect())
    assert got == sorted([("1", 1, ()), ("None", 2, ()), ("None", 2, (1,)), ("5", 2, (1,)), ("5", 3, ()),
                          ("None", 2, (1,))])
    left = {(r["doc_id"], r["text"]) for r in lines.without_repeats(df, edits=3, least=1).collect()}
    assert left == {(1, "R"), (None, "A\nB"), (None, "C"), (5, "D"), (5, "E\nF\nG"), (None, "H")}


def test_lines_of_one_template(spark, monkeypatch):
    """Lines that differ in a number alone: all found, without comparing all pairs."""
    met = []
    counted = lines._near

    def near(pairs, *args):
        met.append(pairs.count())
        return counted(pairs, *args)

    monkeypatch.setattr(lines, "_near", near)
    r, n = random.Random(4), 400
    rows = [(i, f"Item number {r.randrange(10 ** 6, 10 ** 7)} is now in stock at our store")
            for i in range(n)]
    check_lines(by_id(lines.report(table(spark, rows), edits=3)), rows, edits=3)
    assert sum(met) < n * (n - 1) / 2 / 4


def test_lines_one_edit_apart(spark):
    r = random.Random(5)
    rows = []
    for i in range(60):
        line = "".join(r.choice("ab") for _ in range(20 + i % 3))
        if rows and r.random() < 0.6:
            line = r.choice(rows)[1].split("\n")[0]
            p = r.randrange(len(line) + 1)
            line = line[:p] + r.choice(["", "a", "b", "é"]) + line[p + r.randrange(2):]
        rows.append((i, line + "\n" + line[::-1] + "\nshort"))
    check_lines(by_id(lines.report(table(spark, rows))), rows)


def test_lines_of_odd_rows(spark):
    rows = list({r[0]: r for r in ODD if r[0] is not None}.values())
    check_lines(by_id(lines.report(table(spark, rows))), rows)
    assert lines.report(table(spark, ODD)).count() == len(ODD)
    out = lines.without_repeats(table(spark, ODD))
    assert out.columns == table(spark, []).columns
    left = {r["doc_id"]: r for r in out.collect()}
    assert left[13]["text"] == "a line of text that is here twice\nshort"
    assert left[14]["text"] == "another line that stands alone" and left[14]["n_chars"] == 30
    assert 15 not in left and left[1]["text"] is None and left[2]["text"] == ""
    assert lines.without_repeats(table(spark, [])).count() == 0


@pytest.mark.parametrize("edits,letters,copies", [(2, "abcdefgh é", 2), (3, "abcdefgh é日", 2),
                                                  (3, "ab", 1), (3, "abcdefgh", 70)])
def test_lines_several_edits_apart(spark, edits, letters, copies):
    r = random.Random(edits)
    bases = ["".join(r.choice(letters) for _ in range(20 + 3 * i)).strip(" ") + "." * 3
             for i in range(120 // (copies + 1) + 1)]
    rows = []
    for base in bases:
        for _ in range(copies + 1):
            line = base
            for _ in range(r.randrange(6) if rows else 0):
                p = r.randrange(len(line) + 1)
                line = line[:p] + r.choice(["", *letters.replace(" ", "")]) + line[p + r.randrange(2):]
            rows.append((len(rows), line))
    r.shuffle(rows)
    want = {i for i, x in rows for j, y in rows if j < i and (x == y or brute.edit_distance(x, y, edits) <= (
        min(edits, min(len(x), len(y)) // 10) if min(len(x), len(y)) >= 20 else 0))}
    got = by_id(lines.report(table(spark, rows), edits=edits))
    assert {i for i, _ in rows if got[i]["dropped"]} == want and want


def test_a_replaced_word_is_near(spark):
    rows = [(1, "The quick brown fox jumps over the lazy dog."),
            (2, "The quick brown cat jumps over the lazy dog."),
            (3, "The quick brown bears jump over the lazy dog.")]
    got = by_id(queries.op6(table(spark, rows), None))
    assert [got[i]["dropped"] for i in (1, 2, 3)] == [[], [0], []]


def test_few_lines_of_a_spot_need_no_variants(spark, monkeypatch):
    """Lines that share a piece with few others are paired at once, none of their variants is made."""
    def refuse(rows):
        raise AssertionError("variants of lines that are few")

    monkeypatch.setattr(lines, "_variants", refuse)
    r = random.Random(7)
    bases = ["".join(r.choice("abcdefgh é") for _ in range(60)).strip() for _ in range(20)]
    rows = [(3 * i + k, x[:p] + "日" + x[p + 1:] if k else x) for i, x in enumerate(bases)
            for k, p in enumerate((0, 5, len(x) - 3))]
    check_lines(by_id(lines.report(table(spark, rows), edits=3)), rows, edits=3)


def test_lines_of_a_large_spot_write_no_pairs(spark, monkeypatch):
    """Near copies that share a piece and their letters: each line looks for one that is near."""
    written = []
    counted = lines._met

    def met(*args):
        pairs = counted(*args)
        written.append(pairs.count())
        return pairs

    monkeypatch.setattr(lines, "_met", met)
    r, n = random.Random(8), 60
    head, tail = "The same beginning of a line of text, ", "abcdefghijklmnopqrstuvwxyz" * 2
    rows = [(i, head + "".join(r.sample(tail, len(tail)))) for i in range(n)]
    rows += [(n + i, x[:50] + "." + x[51:]) for i, x in rows[::7]]
    check_lines(by_id(lines.report(table(spark, rows), edits=3)), rows, edits=3)
    assert sum(written) < n


def test_a_task_gives_back_memory(monkeypatch):
    from types import SimpleNamespace

    freed = []
    pool = SimpleNamespace(release_unused=lambda: freed.append(True))
    monkeypatch.setattr(pa, "default_memory_pool", lambda: pool)
    out = words.lean(iter)([1, 2])
    assert next(out) == 1 and not freed
    assert list(out) == [2] and freed


def test_bags_of_near_lines_are_alike(spark):
    pairs = [("a" * 40 + "zz", "a" * 40), ("é日" * 30, "é日" * 30 + "xyz"), ("b" * 99, "b" * 96 + "cde"),
             ("one two three four", "five six seven eight")]
    bags = [lines._bags(*lines._codes(pa.array(p))).view("int64").tolist() for p in pairs]
    got = spark.createDataFrame(bags, "one long, two long").select(lines._alike("one", "two", 3)).collect()
    assert [x[0] for x in got] == [True, True, True, False]


def test_short_lines_repeat(spark):
    rows = [(1, "Les.\nhome\n\n \nx"), (2, " Les.\nHome\n\nhome\ny"), (3, "x"), (4, "xs")]
    got = by_id(queries.op6(table(spark, rows), None))
    assert [got[i]["dropped"] for i in (1, 2, 3, 4)] == [[], [0, 3], [0], []]
    assert sum(r["n_exact"] for r in got.values()) == 3
    left = by_id(corpus_pipeline.line_dedup(spark, table(spark, rows), FOLDER))
    assert {i: r["text"] for i, r in left.items()} == {
        1: rows[0][1], 2: "Home\n\ny", 4: "xs"}


# 7: repetition

def test_rules(docs, texts):
    got = by_id(repetition.assess(docs))
    for i, t in texts:
        r = got[i]
        assert tuple(r)[1:6] == brute.rule_columns(t)
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])


def test_rules_of_odd_rows(spark):
    for r, (i, t) in zip(repetition.assess(table(spark, ODD).coalesce(1)).collect(), ODD):
        assert tuple(r)[:6] == (i, *brute.rule_columns(t or ""))
    kept = repetition.keep_good(table(spark, ODD))
    assert kept.columns == table(spark, []).columns and kept.count() == 0
    assert repetition.assess(table(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(30))
def test_suffix_array_repeats(seed):
    r = random.Random(seed)
    words = np.array([r.randrange(3) for _ in range(r.randint(0, 40))], np.int64)
    text = np.sort(np.array([r.randrange(3) for _ in words], np.int64))
    got = repetition.repeats(words, text)
    for i in range(len(words)):
        def common(j):
            k = 0
            while max(i, j) + k < len(words) and text[i + k] == text[j + k] == text[i] and (
                    words[i + k] == words[j + k]):
                k += 1
            return k
        assert got[i] == max((common(j) for j in range(len(words)) if j != i and text[j] == text[i]),
                             default=0)


# 8: personal data

def check_spans(got, texts):
    for i, t in texts:
        want = brute.base_spans(t or "")
        kinds = Counter(k for *_, k in want)
        assert got[i]["base_sha256"] == brute.digest(want), i
        assert all(got[i][f"n_{k}"] == kinds[k] for k in brute.BASE)
        listed = set(got[i]["spans"].split(","))
        assert all(f"{k}:{s}:{e}" in listed for s, _, e, k in want)


def test_personal_data(docs, texts):
    check_spans(by_id(pii.detect(docs)), texts)


def test_personal_data_of_odd_rows(spark):
    rows = [r for r in ODD if r[0] not in (None, 12)] + [
        (20, "a@b.c_d@e.f x@y 1.2.3.4.5.6.7.8 999.1.1.1 01.002.0003.255 1.2.3"),
        (21, "4111-1111-1111-1111 4111 1111 1111 1112 0000000000000 1 2 3"),
        (22, "+1 (555) 010-9999 +49 30 1234 +12345678 +1((((((((2 +49.30.123456.78"),
        (23, "🙂 é a.b+c%d-e@ex-ample.co.uk. 🙂 ip:10.10.10.10"),
        (24, "IBAN DE89 3704 0044 0532 0130 00 and DE89370400440532013001, ssn 078-05-1120; "
             'token = "3fdf5a35c7b8d733c0b5", commit 3fdf5a35c7b8d733c0b5'), (25, "@" * 500 + "." * 500),
        (26, "a.c." * 3000 + "@" + "b.c" * 3000)]
    got = by_id(pii.detect(table(spark, rows)))
    check_spans(got, rows)
    added = [s.split(":")[0] for s in got[24]["spans"].split(",")]
    assert added.count("iban") == 1 and "national_id" in added and added.count("secret") == 1
    assert pii.detect(table(spark, ODD)).count() == len(ODD)
    out = pii.redact(table(spark, ODD))
    assert out.columns == table(spark, []).columns
    left = {r["doc_id"]: r for r in out.collect()}
    assert left[12]["text"] == "mail me: <EMAIL>, card <CARD>, ip <IP>."
    assert left[12]["n_chars"] == len(left[12]["text"]) and left[12]["_row"] == "x"
    assert left[9]["text"] == ODD[8][1] and left[1]["text"] is None
    assert pii.redact(table(spark, [])).count() == 0


# 9: pages

PAGE = """<html><head><title>T</title><style>p{}</style></head><body><div id="header"><h1>Site</h1></div>
<div class="menu"><a href=1>Home</a> <a href=2>News</a></div><div class="notice">We use cookies.</div>
<div class="content"><h2>Title</h2><p>Para one &amp; two with   spaces<br>next. <p>Short.</p>
<ul><li>item one<li>item two</ul><div class="comments"><p>Reader says hi</p></div>
<form><label>Name</label></form></div><div class="sidebar">Other stuff</div>
<script>var x = "<p>no</p>";</script><div id=footer>(c)</div></body></html>"""


def test_main_text(spark):
    rows = [(1, "u", PAGE, 1), (2, None, None, 1), (3, "u", "", 1), (None, "u", "plain words", 1),
            (4, "u", "<p>", 1), (4, "u", "<p>", 1), (5, "u", "<div>" * 3000 + "deep", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in pages.extract(df.coalesce(1)).collect()]
    text = "Title\nPara one & two with spaces next.\nShort.\nitem one\nitem two"
    assert got == [(1, text, len(text)), (2, "", 0), (3, "", 0), (None, "plain words", 11),
                   (4, "", 0), (4, "", 0), (5, "deep", 4)]
    assert pages.extract(df.where("false")).count() == 0


def test_main_text_of_given_pages(spark):
    """The given pages hold their article in one element: a regular expression finds it."""
    import html
    import re

    for r in queries.QUERIES["op9_main_text"](spark, FOLDER).join(
            spark.read.parquet(f"{FOLDER}/pages.parquet").select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split())
                 for x in re.split(r"</?(?:p|h1)>", article)]
        assert r["text"] == "\n".join(x for x in parts if x)


def test_main_text_over_sibling_boxes():
    words = "some words of an article that goes on and on. "
    parts = [(words * n).strip() for n in (3, 21, 6)]
    html = ("<body><div class=menu><a href=1>Home</a></div><div id=post>" + "".join(
        f"<div><p>{x}</p></div>" for x in parts) + "</div><div id=footer>(c)</div></body>")
    assert pages.main_text(html) == "\n".join(parts)
    nested = html.replace("<div><p>", "<div><div><p>", 1).replace("</p></div>", "</p></div></div>", 1)
    assert pages.main_text(nested) == "\n".join(parts)


# 10: sentencepiece

def test_account_numbers_stand_by_their_check(spark):
    rows = [(1, "Invoice to DE89 3704 0044 0532 0130 00"), (2, "IBAN ES91 2100 0418 4502 0005 1332 BIC"),
            (3, "standing order DE89 3704 0044 0532 0130 01")]
    got = by_id(pii.detect(table(spark, rows)))
    assert got[1]["spans"] == "iban:11:38" and got[2]["spans"] == "iban:5:34"
    assert "iban" not in got[3]["spans"]


SENTENCE = "This is a sentence with quite a few words in it to be read. "


def framed(body):
    return (f"<html><body><nav><a href=x>home</a><a href=y>about</a></nav>{body}"
            "<footer>copyright</footer></body></html>")


@pytest.mark.parametrize("body,inside,outside", [
    (f"<main><div><p>LEAD {SENTENCE * 2}</p></div><article><p>{SENTENCE * 4}</p></article>"
     f"<div><p>END {SENTENCE * 2}</p></div></main>", ["LEAD", "END"], ["home"]),
    (f"<article><p>FIRST {SENTENCE * 12}</p></article><article><p>SECOND {SENTENCE * 6}</p></article>",
     ["FIRST", "SECOND"], ["copyright"]),
    *[(f"<article><p>{SENTENCE * 3}</p><section {label}><h2>Own</h2><p>INSIDE {SENTENCE * 3}</p>"
       f"</section><p>{SENTENCE * 3}</p></article>", ["INSIDE"], [])
      for label in ("id=discussion", "class=related-work", "class=notice-board", "class=legal",
                    "class=alert")],
    (f"<article><div class=header><h2>TITLE</h2><p>by ME</p></div><p>{SENTENCE * 3}</p>"
     f"<p>so <math><mi>EMC</mi></math> holds {SENTENCE}</p></article>", ["TITLE", "ME", "EMC"], []),
    (f"<article><p>{SENTENCE * 5}</p><div class=comments><p>COMM {SENTENCE * 3}</p></div></article>",
     [], ["COMM"])])
def test_main_text_keeps_all_content(body, inside, outside):
    text = pages.main_text(framed(body))
    assert all(w in text for w in inside) and not any(w in text for w in outside)


def test_main_text_of_deep_pages_takes_linear_time():
    import time

    start = time.process_time()
    assert pages.main_text("<div>word " * 20_000).count("word") > 19_900
    assert time.process_time() - start < 10


@pytest.fixture(scope="module")
def pieces():
    return unigram.Pieces.from_model(queries.tokenizer("piece_bpe_32k.model"))


def test_round_trip(docs, texts, pieces):
    got = by_id(unigram.decoded(unigram.encoded(docs, pieces), pieces))
    assert all(got[i]["text"] == t for i, t in texts)


def test_round_trip_of_odd_rows(spark, pieces):
    extra = ["  ", " a  b ", "▁x▁ ▁", "日本語 \x00\n\t🙂", "a" * 3000, "   lead", "\U0010ffff x", "é́"]
    rows = ODD + [(100 + k, t) for k, t in enumerate(extra)]
    out = unigram.decoded(unigram.encoded(table(spark, rows), pieces), pieces)
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == Counter(
        (i, t or "") for i, t in rows)
    assert unigram.encoded(table(spark, []), pieces).count() == 0


def best_score(data, table, unknown):
    best = [0.0] + [float("-inf")] * len(data)
    head = [k == len(data) or data[k] & 0xC0 != 0x80 for k in range(len(data) + 1)]
    for e in range(1, len(data) + 1):
        for s in range(e):
            if data[s:e] in table:
                best[e] = max(best[e], best[s] + table[data[s:e]])
            elif head[s] and head[e] and not any(head[s + 1:e]):
                best[e] = max(best[e], best[s] + unknown)
    return best[-1]


@pytest.mark.parametrize("seed", range(20))
def test_viterbi(seed):
    r = random.Random(seed)
    keys = {"▁"}
    while len(keys) < 12:
        k = "".join(r.choice("abé") for _ in range(r.randint(1, 4)))
        keys.add("▁" * r.randint(1, 2) + k * (r.random() < 0.8) if r.random() < 0.3 else k)
    vocabulary = [(b"", 0.0)] + [(f"<{i:02X}>".encode(), -9.0) for i in range(256)] + [
        (k.encode(), -5 * r.random()) for k in sorted(keys)]
    pieces = unigram.Pieces(vocabulary, list(range(1, 257)), {0})
    texts = ["".join(r.choice("aabbé zx") for _ in range(r.randint(1, 14))) for _ in range(20)]
    ids, at = unigram.encode(pa.array(texts, pa.large_string()), pieces)
    for t, a, b in zip(texts, at[:-1], at[1:]):
        score, spelled = 0.0, b""
        for i in ids[a:b]:
            if i > 256:
                score += vocabulary[i][1]
            else:
                spelled += bytes([i - 1])
        score += pieces.unknown * len(spelled.decode())
        want = best_score((" " + t).replace(" ", "▁").encode(), dict(vocabulary[257:]), pieces.unknown)
        assert abs(score - want) < 1e-9


# the pipeline

def test_pipeline(spark, docs):
    import corpus_pipeline

    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, now = now, stage(spark, now, FOLDER)
        assert now.columns == docs.columns, name
        now = spark.createDataFrame(now.collect(), docs.schema)
        assert 0 < now.count() <= before.count()
    rows = [(r["doc_id"], r["text"]) for r in now.collect()]
    check_packed(corpus_pipeline.run(spark, FOLDER).collect(), rows)


def test_pipeline_of_odd_rows(spark):
    import corpus_pipeline

    for start in (ODD, []):
        now = table(spark, start)
        for name, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, FOLDER)
            now.count()
