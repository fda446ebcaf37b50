"""Language, toxicity, substring and near dedup, BPE, the pipeline: brute force, held-out accuracy, odd rows."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from foliospark.llm import byte_bpe, language_id, mixing, order_minhash, shingles, substring_dedup, toxicity
from foliospark.llm.queries import QUERIES, bpe_files

SF = "/root/testdata/sf0.01"


# --- language


def test_language_against_plain_counting(spark):
    """Multinomial naive Bayes with dictionaries: n-grams of each text, one by one, and logarithms of counts."""
    rows = [r for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()]
    sums = defaultdict(lambda: defaultdict(int))
    grams = {}
    for r in rows:
        grams[r["doc_id"]] = [x for part in language_id.ngrams(r["text"] or "") for x in part.tolist()]
        if r["lang"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1:
            for g in grams[r["doc_id"]]:
                sums[r["lang"]][g] += 1
    total = {lang: sum(c.values()) for lang, c in sums.items()}
    prior = lambda lang, g: math.log((sums[lang].get(g, 0) + 0.5) / (total[lang] + 0.5 * language_id.BUCKETS))
    got = {r["doc_id"]: r for r in QUERIES["op3_language_id"](spark, SF).collect()}
    table = {lang: defaultdict(lambda lang=lang: None) for lang in sums}
    for r in rows:
        if not any(c.isalpha() for c in r["text"] or ""):
            assert got[r["doc_id"]]["lang_pred"] == "und" and got[r["doc_id"]]["score"] == 0.0
            continue
        logs = {}
        for lang in sums:
            known = table[lang]
            s = 0.0
            for g in grams[r["doc_id"]]:
                v = known[g]
                if v is None:
                    v = known[g] = prior(lang, g)
                s += v
            logs[lang] = s
        best = max(sorted(logs), key=logs.get)
        n = len(grams[r["doc_id"]])
        share = 1 / sum(math.exp((x - logs[best]) / n * 8) for x in logs.values())
        assert got[r["doc_id"]]["lang_pred"] == best and got[r["doc_id"]]["score"] == pytest.approx(share, abs=1e-5)


def test_language_ngrams_are_those_of_the_text():
    """Every run of one to three characters, with other characters than letters as one space, has its bucket."""
    text = "Ab1c  d\u00e9!"
    plain = " " + re.sub(r"[^a-z\u00e9]+", " ", text.lower()).rstrip() + " "
    got = np.concatenate(list(language_id.ngrams(text)))
    assert len(got) == sum(len(plain) - n + 1 for n in (1, 2, 3))
    again = np.concatenate(list(language_id.ngrams("ab c D\u00c9")))
    assert sorted(got.tolist()) == sorted(again.tolist())


def test_language_held_out(spark):
    got = QUERIES["op3_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 250 and sum(r["lang_pred"] == r["lang"] for r in got) / len(got) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_odd_rows(spark, odd_docs, no_docs):
    model = language_id.train(odd_docs, "text", "lang")
    assert model[0] == ["de", "en", "fr"]
    rows = language_id.predict(odd_docs, model, carry=(F.col("doc_id"), F.col("score").alias("old"))).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == odd_docs.count() and [by[i]["lang_pred"] for i in (3, 4, 5, 6, 8, 10)] == ["und", "und", "und", "de", "und", "fr"]
    assert by[3]["score"] == 0.0
    assert language_id.predict(no_docs, model, carry=(F.col("doc_id"),)).count() == 0
    none = language_id.train(no_docs, "text", "lang")
    assert none[0] == [] and {r["lang_pred"] for r in language_id.predict(odd_docs, none).collect()} == {"und"}


def test_language_of_many_languages(spark, monkeypatch):
    """A table that would be too large has fewer buckets and still tells languages apart."""
    texts = {f"l{k}": " ".join(chr(0x4E00 + 40 * k + (i * 7) % 30) * 3 for i in range(40)) for k in range(12)}
    df = spark.createDataFrame([(k, t) for k, t in texts.items()], "lang string, text string")
    monkeypatch.setattr(language_id, "MAX_CELLS", 12 * 600)
    langs, table = language_id.train(df, "text", "lang")
    assert table.shape == (12, 512) and {(r["lang"], r["lang_pred"]) for r in language_id.predict(df, (langs, table), carry=(F.col("lang"),)).collect()} == {(k, k) for k in texts}


def test_language_does_not_depend_on_slices():
    text = "Das ist ein langer Text, même avec des accents. " * 4000
    whole = np.bincount(np.concatenate(list(language_id.ngrams(text))), minlength=language_id.BUCKETS)
    assert whole.sum() > 3 * len(text) * 0.9
    assert list(language_id.ngrams("")) == []


# --- toxicity


def test_toxicity_against_dense_regression(spark):
    """The same model by plain counting and a dense logistic regression solved by Newton steps."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdeghilmnorstu") for _ in range(r.randrange(3, 7)))
    bad, plain = [word() for _ in range(6)], [word() for _ in range(60)]
    rows = [(i, " ".join(r.choice(bad) if i % 5 == 0 and r.random() < 0.3 or r.random() < 0.01 else r.choice(plain) for _ in range(30)), int(i % 5 == 0)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(docs, docs.select("doc_id", "toxic"), l2=1e-2, steps=5000)
    sets = [{x for part in toxicity.ngrams(t) for x in part.tolist()} for _, t, _ in rows]
    y = np.array([v for *_, v in rows], dtype=float)
    n1, n0 = int(y.sum()), int((1 - y).sum())
    c1, c0 = defaultdict(int), defaultdict(int)
    for s, v in zip(sets, y, strict=True):
        for b in s:
            (c1 if v else c0)[b] += 1
    ratio = {}
    for b in c1.keys() | c0.keys():
        a = math.log((c1[b] + 0.5) / (n1 + 1)) - math.log((c0[b] + 0.5) / (n0 + 1))
        if c1[b] >= 3 and abs(a) / math.sqrt(1 / (c1[b] + 0.5) + 1 / (c0[b] + 0.5)) >= 4.0:
            ratio[b] = a
    assert set(np.flatnonzero(model.slot >= 0).tolist()) == set(ratio) and len(ratio) > 20
    order = sorted(ratio)
    x = np.array([[ratio[b] if b in s else 0.0 for b in order] + [1.0] for s in sets])
    w, penalty = np.zeros(len(order) + 1), np.r_[np.full(len(order), 1e-2), 0.0]
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) / len(y) + np.diag(penalty + 1e-12), x.T @ (p - y) / len(y) + penalty * w)
    want = 1 / (1 + np.exp(-x @ w))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model, carry=(F.col("doc_id"),)).collect()}
    assert max(abs(got[i] - want[i]) for i in got) < 1e-3


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op5_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    hit = sum(r["predicted"] for r in got if r["toxic"] == 1) / sum(r["toxic"] == 1 for r in got)
    clean = sum(r["predicted"] for r in got if r["toxic"] == 0) / sum(r["toxic"] == 0 for r in got)
    assert hit > 0.9 and clean < 0.02 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)


def test_toxicity_odd_rows(spark, odd_docs, no_docs):
    texts = [(i, f"fine words {i} " + ("vile " if i % 4 == 0 else "kind ") * 2) for i in range(200)] + [(500, None), (501, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)] + [(None, 1), (5, None), (7, 0), (999, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    rows = {r["doc_id"]: r for r in toxicity.score(docs, model, carry=(F.col("doc_id"),)).collect()}
    assert len(rows) == 202 and all(rows[i]["predicted"] == int(i % 4 == 0) for i in range(200)) and rows[500]["score"] == rows[501]["score"]
    again = toxicity.train(docs.repartition(5), labels.repartition(3))
    assert np.allclose(again.weight, model.weight, rtol=0, atol=1e-9)
    assert toxicity.score(odd_docs, model, carry=(F.col("doc_id"), F.col("pos"))).count() == odd_docs.count()
    assert toxicity.score(no_docs, model).count() == 0
    blank = toxicity.train(docs, labels.where("toxic = 0"))
    assert {r["score"] for r in toxicity.score(docs, blank).collect()} == {0.0}


# --- substring dedup


def substring_model(rows, size=50):
    first, out = {}, []
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - size + 1):
            f = first.setdefault(tuple(w[s : s + size]), i)
            if f < i:
                gone[s : s + size] = [True] * size
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def passages(seed=4):
    r = random.Random(seed)
    word = lambda: r.choice("abcdefgh") + r.choice("xyz")
    shared = [[word() for _ in range(n)] for n in (50, 51, 49, 80, 200)] + [["la"] * 120]
    rows = []
    for i in range(150):
        w = [word() for _ in range(r.randrange(0, 120))]
        for _ in range(r.randrange(3)):
            p = r.choice(shared)
            at = r.randrange(len(w) + 1)
            a = r.randrange(max(1, len(p) - 49))
            w[at:at] = p[a : a + r.choice([49, 50, 60, 500])]
        rows.append((i * 3 + 1, " ".join(w)))
    return rows + [(2, rows[5][1]), (5000, None), (5001, ""), (5002, " \n")]


@pytest.mark.parametrize("hot", [1000, 0, 3])
def test_substring(spark, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    rows = passages()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in substring_dedup.dedup(df).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())
    assert got == substring_model(rows) and sum(r[2] for r in got) > 1000


def test_substring_against_brute_force_on_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in QUERIES["op4_substring_dedup"](spark, SF).collect())
    assert got == substring_model(rows) and sum(r[2] for r in got) > 10_000


def test_substring_odd_rows(spark, odd_docs, no_docs):
    rows = substring_dedup.dedup(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append((r["n_words"], r["n_removed"]))
    assert by[2] == [(1600, 1600)] * 2 and by[1] == [(1600, 0)] and by[9] == [(1603, 1600)] and by[None] == [(3, 0)]
    assert substring_dedup.dedup(no_docs).count() == 0


def test_automaton():
    r = random.Random(8)
    for _ in range(200):
        shard = [(i, [r.randrange(2) for _ in range(r.randrange(3, 14))]) for i in range(r.randrange(1, 6))]
        size = r.randrange(1, 5)
        where = {}
        for i, s in shard:
            for k in range(len(s) - size + 1):
                where.setdefault(tuple(s[k : k + size]), i)
        want = [[k for k in range(len(s) - size + 1) if where[tuple(s[k : k + size])] < i] for i, s in shard]
        assert substring_dedup.repeated_windows(shard, size) == want


def test_equal_windows_choose_equal_anchors():
    r = np.random.default_rng(1)
    h = r.integers(0, 5, 400).astype(np.uint64)
    g = shingles.grams(h, 8)
    got = substring_dedup.least_in_windows(g, 43)
    want = [max(range(s, s + 43), key=lambda i: (-int(g[i]), i)) for s in range(len(g) - 42)]
    assert got.tolist() == want


# --- near dedup


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_alignment():
    r = random.Random(2)
    for _ in range(3000):
        a = [r.randrange(4) for _ in range(r.randrange(15))]
        b = list(a)
        for _ in range(r.randrange(6)):
            b[r.randrange(len(b) + 1) :][:1] = []
            if b and r.random() < 0.4:
                b.pop(r.randrange(len(b)))
            else:
                b.insert(r.randrange(len(b) + 1), r.randrange(5))
        most, d = r.randrange(9), edits(a, b)
        got = order_minhash.banded_distance(np.array(a, dtype=np.int32), np.array(b, dtype=np.int32), most)
        assert got == d if d <= most else got > most


def test_sketch_keeps_order():
    h = shingles.WordHash().of([b"w%d" % i for i in range(400)])
    same = lambda x, y: (order_minhash.sketch(x) == order_minhash.sketch(y)).mean()
    near = h.copy()
    near[100] = 5
    swapped = np.concatenate([h[200:], h[:200]])
    assert same(h, near) > 0.7 and same(h, swapped) < 0.75 < 1.0 and same(h, h[::-1]) == 0
    assert len(order_minhash.sketch(h[:0])) == 0 and len(order_minhash.sketch(h[:3])) == order_minhash.SKETCHES


def test_near_against_brute_force(spark):
    r = random.Random(6)
    vocabulary = [f"word{i}" for i in range(3000)]
    rows, group = [], {}
    for g in range(40):
        base = [r.choice(vocabulary) for _ in range(r.randrange(60, 300))]
        for _ in range(r.choice([1, 1, 2, 3, 12])):
            w = list(base)
            for _ in range(int(len(w) * 0.04)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            i = len(rows) * 7 + 3
            rows.append((i, " ".join(w).capitalize() + r.choice([".", "!", ""])))
            group[i] = g
    passage = " ".join(vocabulary[:60])
    rows += [(10_000 + i, passage + " " + " ".join(r.choice(vocabulary) for _ in range(90))) for i in range(30)]  # one passage, else different
    got = {x["doc_id"]: x for x in order_minhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    first = {}
    for i, g in group.items():
        first.setdefault(g, i)
    wrong = [i for i, g in group.items() if got[i]["class_id"] != first[g]]
    assert not wrong and all(got[10_000 + i]["class_size"] == 1 for i in range(30))
    assert all(got[i]["kept"] == (i == first[g]) for i, g in group.items())


def test_near_recall_on_table(spark):
    """Each pair that brute force links is in one class, but for at most one in a hundred."""
    docs = {r["doc_id"]: order_minhash.text_words(r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: r["class_id"] for r in QUERIES["op10_near_dedup"](spark, SF).collect()}
    by, hashes = defaultdict(set), shingles.WordHash()
    for i, w in docs.items():
        for j in range(len(w) - 4):
            by[tuple(w[j : j + 5])].add(i)
    pairs = {(a, b) for s in by.values() for a in s for b in s if a < b}
    total = lost = 0
    for a, b in pairs:
        most = order_minhash.allowed(max(len(docs[a]), len(docs[b])), 0.8)
        if order_minhash.banded_distance(hashes.of(docs[a]), hashes.of(docs[b]), most) <= most:
            total += 1
            lost += got[a] != got[b]
    assert total > 50 and lost <= total // 100


def test_near_odd_rows(spark, odd_docs, no_docs):
    rows = order_minhash.near_dedup(odd_docs).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == odd_docs.count() and by[2]["class_id"] == 1 and by[9]["class_id"] == 1 and by[1]["class_size"] == 4
    assert by[None]["class_id"] is None and by[None]["kept"] and [by[i]["class_id"] for i in (3, 4, 5, 8)] == [3, 4, 5, 8]
    assert order_minhash.near_dedup(no_docs).count() == 0


def test_hot_buckets(spark, monkeypatch):
    monkeypatch.setattr(order_minhash, "HOT", 2)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(base[:i] + ["x"] + base[i + 1 :])) for i in range(60)]
    got = order_minhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["class_id"] for r in got.collect()} == {0}


def _changed(r: random.Random, words: list, share: float, keep: int = 0) -> list:
    """Words with that share of them, spread out behind the first ``keep``, replaced."""
    out = list(words)
    for i in r.sample(range(keep, len(out)), int(len(out) * share)):
        out[i] = f"new{r.randrange(10**9)}"
    return out


def _bucket_mates(texts: dict) -> dict:
    """Pairs of texts that share order sketches and align: number of shared sketches."""
    hashes, by, shared = shingles.WordHash(), defaultdict(list), defaultdict(int)
    vec = {i: hashes.of(order_minhash.text_words(t)) for i, t in texts.items()}
    for i, v in vec.items():
        for k in enumerate(order_minhash.sketch(v).tolist()):
            by[k].append(i)
    for ids in by.values():
        for a, b in itertools.combinations(sorted(ids), 2):
            shared[a, b] += 1
    near = lambda a, b: order_minhash.allowed(max(len(vec[a]), len(vec[b])), 0.8)
    return {(a, b): n for (a, b), n in shared.items() if order_minhash.banded_distance(vec[a], vec[b], near(a, b)) <= near(a, b)}


def test_crowded_buckets(spark):
    """Many distant copies of texts of which none has the least id: what shares a sketch and aligns is one class."""
    r = random.Random(11)
    texts = {}
    for g in range(3):
        base = [f"g{g}w{i}" for i in range(200)]
        texts |= {g * 1000 + i: " ".join(_changed(r, base, 0.13) if i != 70 else base) for i in range(140)}
    got = {x["doc_id"]: x["class_id"] for x in order_minhash.near_dedup(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    mates = _bucket_mates(texts)
    assert len(mates) > 300 and not [p for p in mates if got[p[0]] != got[p[1]]]


def test_one_shared_sketch_in_a_hot_bucket(spark, monkeypatch):
    """Pairs that share only the sketch of a passage that many unlike texts hold too, in a bucket above HOT."""
    monkeypatch.setattr(order_minhash, "HOT", 4)
    r = random.Random(12)
    passage = [f"p{i}" for i in range(40)]
    texts = {i: " ".join(passage + [f"u{i}w{k}" for k in range(110)]) for i in range(60)}
    for g in range(150):
        base = passage + [f"g{g}w{k}" for k in range(110)]
        texts |= {1000 + 2 * g: " ".join(base), 1001 + 2 * g: " ".join(_changed(r, base, 0.19, 40))}
    once = [p for p, n in _bucket_mates(texts).items() if n == 1]
    got = {x["doc_id"]: x["class_id"] for x in order_minhash.near_dedup(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert len(once) >= 5 and not [p for p in once if got[p[0]] != got[p[1]]]
    assert len({got[i] for i in range(60)}) == 60


def test_rows_of_a_crowded_bucket_are_linear(spark, monkeypatch):
    """Texts of one passage and the same words in other orders, which no bound tells apart: none is linked, but copies are, and pairs are not written."""
    written, write = [], order_minhash.materialise

    def counted(df):
        out = write(df)
        if out.columns == ["a", "b"]:
            written.append(out.count())
        return out

    monkeypatch.setattr(order_minhash, "materialise", counted)
    monkeypatch.setattr(order_minhash, "MANY", 8)
    r = random.Random(14)
    passage, words, texts = [f"p{i}" for i in range(60)], [f"w{i}" for i in range(40)], {}
    for i in range(0, 240, 2):
        base = passage + r.sample(words, len(words))
        texts |= {i: " ".join(base), i + 1: " ".join(_changed(r, base, 0.1, 60))} if i % 20 == 0 else {i: " ".join(base)}
    got = {x["doc_id"]: x["class_id"] for x in order_minhash.near_dedup(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i in texts}
    assert max(written) <= order_minhash.HUBS * len(texts), written


@pytest.mark.parametrize("spread", ["random", "even"])
def test_near_recall_by_band(spark, spread):
    """Lone pairs at each similarity down to 0.8, short and long: at most one in twenty of a band is lost."""
    r = random.Random(13)
    texts, band = {}, defaultdict(list)
    for at in (0.8, 0.82, 0.85, 0.88, 0.9):
        for g in range(60):
            base = [f"b{at}g{g}w{k}" for k in range(r.choice([20, 60, 200]))]
            e = order_minhash.allowed(len(base), at)
            places = r.sample(range(len(base)), e) if spread == "random" else [int((k + 0.5) * len(base) / e) for k in range(e)]
            i = len(texts)
            copy = [f"new{i}w{k}" if k in places else w for k, w in enumerate(base)]
            texts |= {i: " ".join(base), i + 1: " ".join(copy)}
            band[at].append(i)
    got = {x["doc_id"]: x["class_id"] for x in order_minhash.near_dedup(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    lost = {at: sum(got[i] != got[i + 1] for i in ids) for at, ids in band.items()}
    assert all(n <= 3 for n in lost.values()), lost


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, 2000 + i) for i in range(1, 50)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = dict(tuple(x) for x in shingles.components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {x: find(x) for x in list(parent) if find(x) != x}


def test_bloom_never_drops(spark):
    df, ids = spark.range(5000).withColumnRenamed("id", "i"), spark.range(0, 5000, 7)
    held = {r["i"] for r in shingles.may_hold(df, "i", ids).collect()}
    assert set(range(0, 5000, 7)) <= held and len(held) < 1200
    assert {r["i"] for r in shingles.without(df, "i", ids).collect()} == {i for i in range(5000) if i % 7}


# --- BPE


@pytest.fixture(scope="module")
def coder():
    import tiktoken

    path, pattern = bpe_files()
    ranks = byte_bpe.read_ranks(path)
    return byte_bpe.Encoder(ranks, pattern), tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_tiktoken(coder):
    own, other = coder
    r = random.Random(1)
    alphabets = ["ab", "the and ing", "الم ", "日本語中文 ", "\n\t \x1c\x85   x", "aA1!'s ’é́😀ﬁ", "".join(map(chr, range(32, 700)))]
    for _ in range(3000):
        text = "".join(r.choice(r.choice(alphabets)) for _ in range(r.choice([1, 5, 30, 300])))
        assert own.encode(text).tolist() == other.encode_ordinary(text)
    for text in ("", "a" * 20_000, " " * 5000 + "x", "word " * 300_000):
        assert own.encode(text).tolist() == other.encode_ordinary(text)


def test_bpe_query(spark, sf, coder):
    got = {r["doc_id"]: r for r in QUERIES["op9_byte_bpe"](spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = coder[1].encode_ordinary(r["text"])
        g = got[r["doc_id"]]
        assert g["n_tokens"] == len(ids) and g["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert g["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()


def test_bpe_odd_rows(spark, odd_docs, no_docs):
    path, pattern = bpe_files()
    docs = odd_docs.withColumn("ids", F.lit("old")).withColumn("decoded", F.lit("old"))
    out = byte_bpe.decode(byte_bpe.encode(docs, path, pattern), path, pattern).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in odd_docs.collect()}
    assert len(out) == odd_docs.count() and all(bytes(r["decoded"]).decode() == texts[r["doc_id"]] for r in out)
    assert {r["doc_id"] for r in out if not r["ids"]} == {3, 4}
    assert byte_bpe.encode(no_docs, path, pattern).count() == 0


# --- pipeline


def test_pipeline_against_brute_force(spark, sf, coder):
    """Every stage's decision, recomputed in Python from the stage before."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, steps = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        from foliospark.llm.common import materialise

        steps.append(materialise(stage(spark, steps[-1], sf)))
        if name != "bpe":
            assert steps[-1].columns == columns
    tables = [{r["doc_id"]: r for r in s.collect()} for s in steps]
    raw, spoken, single, apart, mixed, coded = tables
    assert set(raw) - set(spoken) == {i for i, r in raw.items() if not any(c.isalpha() for c in r["text"] or "")}
    last = {}
    for i in sorted(spoken):
        last[spoken[i]["text"]] = i
    assert set(single) == set(last.values())
    hashes, words = shingles.WordHash(), {i: order_minhash.text_words(r["text"]) for i, r in single.items()}
    vec = {i: hashes.of(w) for i, w in words.items()}
    root = {i: i for i in single}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(single)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            n, m = len(vec[a]), len(vec[b])
            most = order_minhash.allowed(max(n, m), 0.8)
            if min(n, m) and abs(n - m) <= most and len(set(words[a]) & set(words[b])) * 4 >= len(set(words[a])) and order_minhash.banded_distance(vec[a], vec[b], most) <= most:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert set(apart) == {i for i in ids if find(i) == i}
    taken = {r["doc_id"]: r["copies"] for r in mixing.mix(steps[3]).collect()}
    times = {r["doc_id"]: r["n"] for r in steps[4].groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert times == {i: n for i, n in taken.items() if n} and set(mixed) == set(times)
    assert steps[5].count() == sum(times.values())
    assert all(r["ids"] == coder[1].encode_ordinary(raw[i]["text"] or "") for i, r in coded.items())
    assert corpus_pipeline.run(spark, sf).count() == steps[5].count()


def test_pipeline_odd_rows(spark, odd_docs, no_docs, tmp_path):
    docs = odd_docs
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert name == "bpe" or docs.columns == list(corpus_pipeline.COLUMNS)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert docs.count() > 0
    empty = no_docs
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, str(tmp_path))
    assert empty.count() == 0
