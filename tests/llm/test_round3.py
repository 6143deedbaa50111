"""Runs, fill-in-middle and posting lists against brute force on small tables with the odd cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from trialwise.llm import fill_middle, near_vectors, posting_lists, queries, runs

WORD = re.compile(r"[^\x20\x09-\x0d]+")
KIND = "doc_id long, text string, lang string, source string"
PHRASE = "la la la di da di da di da di da di da di da di da di"
LONG = " ".join(f"w{i % 997}" for i in range(40_000))
TEXTS = [
    None, "", " \n\t ", "one", PHRASE, "a " * 11, "a " * 12, "a\x0ba\x0ca\ra\ta\na a a a a a a a", PHRASE.replace(" ", "\n") + "\n", "x y z " * 5 + "q " + "x y z " * 5, LONG, "é日本 ü " * 30, "<P> is here\nand there", "two\nlines\n", "\n\n\n", "no end\nof line",
    " ".join(["alpha beta"] * 9 + ["gamma"] + ["alpha beta"] * 9), "x" * 70_000, ("line of words here\n" * 9 + "other\n") * 4,
]
#: Names that operators use inside, as columns of the input.
CLASHES = ("k", "t", "h", "n", "r", "s", "f", "v", "q", "form", "output", "restored", "runs", "collapsed", "n_words", "list", "piece", "bin", "keys", "score", "rank", "main", "key")


def brute_runs(s, least=12):
    n, out = len(s), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and s[j] == s[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q):
                out.setdefault((i, j + q), q)
            i = max(i + 1, j)
    return sorted(((i, j, q) for (i, j), q in out.items()), key=lambda r: (r[0], r[2]))


def collapsed(w, found):
    gone = set().union(*[range(i + q, j) for i, j, q in found]) if found else set()
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("seed", range(4))
def test_runs_are_all_and_maximal(seed):
    rng = random.Random(seed)
    for _ in range(1500):
        s = [rng.randrange(rng.choice([1, 2, 3, 8])) for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(4) if s else 0):
            a = rng.randrange(len(s))
            s[a:a] = s[a : a + rng.randrange(1, 15)] * rng.randrange(1, 4)
        least = rng.choice([2, 5, 12])
        assert runs.runs(s, least) == brute_runs(s, least)
    word = [0, 1]
    while len(word) < 600:
        word = [c for x in word for c in ((0, 1) if x == 0 else (0,))]
    assert runs.runs(word, 4) == brute_runs(word, 4)
    # factors are longest earlier stretches, and cover the text
    s = [rng.randrange(3) for _ in range(300)]
    at = 0
    for start, size, earlier in runs.factors(s):
        assert start == at and (earlier < 0 or earlier < start and s[earlier : earlier + size] == s[start : start + size])
        assert start + size == len(s) or not any(s[e : e + size + 1] == s[start : start + size + 1] for e in range(start)) or earlier < 0
        at += size
    assert at == len(s)


@pytest.mark.parametrize("least", [2, 12])
def test_pieces_lose_no_run(spark, least):
    rng = random.Random(5)
    texts = [*TEXTS, *(" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(80))) for _ in range(200))]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in runs.find_runs(docs, least=least).collect()}
    for i, t in enumerate(texts):
        w = WORD.findall(t or "")
        if t is LONG:
            assert [(r["start"], r["length"], r["period"]) for r in got[i]["runs"]] == [(0, 40_000, 997)] and got[i]["collapsed"] == " ".join(w[:997])
            continue
        want = brute_runs(w, least)
        assert [(r["start"], r["start"] + r["length"], r["period"]) for r in got[i]["runs"]] == want, i
        assert got[i]["collapsed"] == collapsed(w, want) and got[i]["n_words"] == len(w)


def test_periodic_runs_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.QUERIES["op11_periodic_runs"](spark, sf).collect()
    assert len(got) == len(texts) and got[0].__fields__ == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    some = 0
    for r in got:
        w = WORD.findall(texts[r["doc_id"]] or "")
        n, h = len(w), zlib.crc32(str(r["doc_id"]).encode())
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found = brute_runs(w) if n < 5000 else runs.runs([hash(x) for x in w])
        best = min(((i - j, i, q) for i, j, q in found), default=None)
        want = (len(found), *((best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else [None] * 4), sha("".join(f"{i},{j - i},{q}\n" for i, j, q in found)), sha(collapsed(w, found)))
        assert tuple(r)[1:] == want
        some += len(found)
    assert some


def by_hand(key, text, unit=r"[^\n]*\n|[^\n]+", seed=7, rate=100, spm=50):
    u = re.findall(unit, text)
    h = [int(hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(u) + 1) for x in h[:2])
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(u), "plain", None, None, text
    return len(u), *(("spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else ("psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"))


@pytest.mark.parametrize("unit,pattern", [("line", r"[^\n]*\n|[^\n]+"), ("word", r"[^ \t-\r]+[ \t-\r]*|^[ \t-\r]+"), ("char", r"(?s).")])
@pytest.mark.parametrize("rate,spm", [(100, 50), (60, 0)])
def test_fill_in_middle(spark, unit, pattern, rate, spm):
    texts = [t for t in TEXTS for _ in range(4)] + ["<", "a<", ">b\n<", "S><", "<S\n>x", "P>"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    out = fill_middle.transform(docs, unit=unit, rate=rate, spm=spm)
    got = {r["doc_id"]: r for r in fill_middle.restore(out).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == by_hand(i, t or "", pattern, 7, rate, spm), (i, t)
        assert r["restored"] == (t or "")
    forms = {r["form"] for r in got.values()}
    assert forms == ({"plain", "psm", "spm"} if spm else {"plain", "psm"})


def test_marks_are_checked(spark):
    docs = spark.createDataFrame([(1, "a [s b"), (2, "é\nb"), (None, "x\ny")], "doc_id long, text string")
    back = fill_middle.restore(fill_middle.transform(docs, marks=("[p", "{s", "(m")), marks=("[p", "{s", "(m"))
    assert sorted(back.select("restored").collect()) == sorted(docs.select("text").collect())
    for marks in (("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("<<", "<S>", "<M>"), ("<P", "<P>", "<M>")):
        with pytest.raises(ValueError):
            fill_middle.transform(docs, marks=marks)
    with pytest.raises(ValueError):
        fill_middle.transform(docs, unit="page")
    nulls = spark.createDataFrame([(1, None, None), (2, "plain", "text")], "doc_id long, form string, output string")
    assert {r["doc_id"]: r["restored"] for r in fill_middle.restore(nulls).collect()} == {1: None, 2: "text"}


@pytest.mark.parametrize("operator", [lambda d: runs.find_runs(d), lambda d: fill_middle.transform(d), lambda d: fill_middle.restore(fill_middle.transform(d))], ids=["op11", "op12", "op12 back"])
def test_odd_rows_and_clashing_names(spark, operator):
    data = [(None, None, None, None), (None, "", "en", None), (None, PHRASE, None, "s"), (1, PHRASE, "en", "s"), (1, PHRASE, "en", "s"), (2, LONG, "de", "t"), (4, "\n" * 5000, "", ""), (5, "é日本\x00 \x0b\n" * 40, "en", "s")]
    plain = spark.createDataFrame(data, KIND)
    wide = spark.createDataFrame([(*r, *["clash"] * len(CLASHES)) for r in data], KIND + "".join(f", `{c}` string" for c in CLASHES))
    a, b = (sorted(repr(tuple(r)) for r in operator(x).collect()) for x in (plain, wide))
    assert a == b and len(a) == len(data)
    assert operator(wide.where("false")).count() == 0 and operator(plain.where("doc_id is null and text is null")).count() == 1


def brute_nearest(rows, wanted, k):
    """rows (key, vector): answers by all distances, each key once at its least."""
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q in {i for i, _ in good if wanted(i)}:
        best = {}
        for i, v in good:
            for j, w in good:
                if j == q and i != q and len(v) == len(w):
                    d = float(np.sqrt(((v - w) ** 2).sum()))
                    best[i] = min(d, best.get(i, np.inf))
        out[q] = sorted((d, i) for i, d in best.items())[:k]
    return out


def answers_of(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["score"], r["vec_id"]))
    return out


def test_nearest_of_odd_vectors(spark):
    rng = np.random.default_rng(2)
    spread = [(i, rng.standard_normal(6).round(1).tolist()) for i in range(300)]
    ties = [(400 + i, [float(i % 3), 1.0, 0.0]) for i in range(60)]
    odd = [(None, [1.0] * 6), (500, None), (501, []), (502, [0.0] * 6), (503, [float("nan")] * 6), (504, [None] * 6), (505, [float("inf"), 0.0, 0.0, 0.0, 0.0, 0.0]), (700, [1.0] * 9), (800, [2.0] * 4), (801, [2.0] * 4), (100, [5.0] * 6), (200, spread[200][1]), (0, [-0.0, 1.0, 1.0, 1.0, 1.0, 1.0])]
    data = [*spread, *ties, *odd]
    df = spark.createDataFrame([(k, v, *["clash"] * len(CLASHES)) for k, v in data], "vec_id long, embedding array<double>" + "".join(f", `{c}` string" for c in CLASHES))
    got = answers_of(posting_lists.nearest(df, F.col("vec_id") % 20 == 0, size=24))
    want = brute_nearest(data, lambda i: i % 20 == 0, 10)
    assert 700 not in got and got.pop(800) == [(0.0, 801)]
    want.pop(800)
    assert want.pop(700) == [] and got.keys() == want.keys()
    hit = sum(len(set(got[q]) & set(want[q])) for q in want)
    assert hit >= 0.95 * sum(map(len, want.values())) and all(len(got[q]) == len(want[q]) for q in want)
    none = df.where("false")
    assert posting_lists.nearest(none, F.lit(True)).count() == 0 and posting_lists.nearest(df, F.lit(False)).count() == 0


def test_nearest_in_a_crowd(spark):
    """A third are copies of one vector, a third near copies of another; the rest are spread. Lists stay small, and answers are those of all distances."""
    rng = np.random.default_rng(7)
    n, d = 3000, 16
    x = rng.standard_normal((n, d)).astype(np.float32)
    x[: n // 3] = x[0]
    x[n // 3 : 2 * n // 3] = x[n // 3] + 1e-3 * rng.standard_normal((n // 3, d))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(8)
    index = posting_lists.PostingIndex(df, size=48)
    assert max(s for s, _ in index.sizes.values()) < 600 and sum(m for _, m in index.sizes.values()) == len(np.unique(x, axis=0))
    got = answers_of(index.search(df.where("vec_id % 50 = 0")))
    y, hit = x.astype(float), 0
    for q, own in got.items():
        dist = np.sqrt(((y - y[q]) ** 2).sum(1))
        want = [(dist[i], i) for i in np.lexsort((np.arange(n), dist)) if i != q][:10]
        hit += len({i for _, i in own} & {i for _, i in want})
        assert len(own) == 10 and all(s == dist[i] for s, i in own)
    assert len(got) == 60 and hit >= 0.95 * 600 and index.recall >= 0.95


def test_all_lists_where_recall_stays_short(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((2000, 12))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(posting_lists, "SEARCHES", 1)
    monkeypatch.setattr(posting_lists, "WIDE", 2)
    monkeypatch.setattr(posting_lists, "ENOUGH", 1)
    index = posting_lists.PostingIndex(df, size=16)
    got = answers_of(index.search(df.where("vec_id % 100 = 0"), recall=1.0))
    assert index.recall == 1.0
    for q, own in got.items():
        dist = np.sqrt(((x - x[q]) ** 2).sum(1))
        assert [i for _, i in own] == [int(i) for i in np.argsort(dist) if i != q][:10]


def test_graph_finds_the_nearest_centroids():
    rng = np.random.default_rng(1)
    own = posting_lists.Centroids(rng.standard_normal((1500, 24)).astype(np.float32))
    q = rng.standard_normal((200, 24)).astype(np.float32)
    ids, far = own.nearest(q, 32)
    want = posting_lists._squares(q, own.x).argsort(1)[:, :10]
    assert own.graph is not None and np.mean([len(set(a[:10]) & set(b)) / 10 for a, b in zip(ids, want)]) > 0.95
    assert (np.diff(far, axis=1) >= 0).all() and all(len(set(r)) == 32 for r in ids)


def test_links_at_the_threshold_and_of_odd_lengths(spark):
    """Pairs just above the threshold are audited like any other; lengths that differ by 4,096 do not share a group."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((600, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    away = rng.standard_normal((600, 32))
    away -= (away * x).sum(1, keepdims=True) * x
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    pairs = 0.9505 * x + np.sqrt(1 - 0.9505**2) * away
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, pairs]))]
    odd = [(5000 + i, [1.0 + 0.01 * i, 1.0]) for i in range(3)] + [(6000 + i, [1.0] * 4097 + [1.0 + i]) for i in range(3)]
    frame = lambda data: spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumns({c: F.lit("clash") for c in ("unit", "dim", "n", "k", "id")})
    got = {r["vec_id"]: r for r in near_vectors.near_vectors(frame(rows)).collect()}
    assert all(got[i]["component_id"] == i and got[600 + i]["component_id"] == i and got[i]["n_links"] == 1 for i in range(600))
    assert got[0]["recall"] == 1.0 and got[0]["audited"] > 500
    got = {r["vec_id"]: r for r in near_vectors.near_vectors(frame(odd)).collect()}
    assert all(got[i]["component_id"] == i // 1000 * 1000 and got[i]["n_links"] == 2 for i, _ in odd)
