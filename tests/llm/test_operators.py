"""Training-data operators against brute force on small tables with the odd cases: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from trialwise.llm import bpe, clusters, common, jaccard, license_scan, line_dedup, mixing, near_vectors, quality, queries, sharding, token_counts, url_filter

WORD = re.compile(r"[^\x20\x09-\x0d]+")
BASE = "the quick brown fox jumps over the lazy dog while seven wizards quietly juggle bright copper kettles behind an old stone barn near the river"
TEXTS = [
    None, "", "one two", BASE, BASE, BASE.upper(), BASE + " indeed", "line one is here again now\n" * 5 + BASE,
    "it's we'RE\n\n  x\t 1234 #### $$$ 日本語 é", "a" * 3000, "Licensed under CC BY-NC 4.0.\nAll Rights, reserved cc by CC-BY", "Released under the MIT License.",
    "This work is licensed under the GNU General Public License, version 3.", " ".join(f"w{i}" for i in range(5000)), " ".join(f"w{i}" for i in range(4990)),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 4}" if i % 5 else None, "clash", 1) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, ids string, size int")


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("false")


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def coder():
    import tiktoken
    import public_tokenizers as P

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.encoder(*bpe.default_vocabulary()).vocabulary.ranks, special_tokens={})


def test_bpe(docs, nothing):
    tok, got = coder(), rows(bpe.digest(docs))
    for i, t in enumerate(TEXTS):
        ids = tok.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    back = rows(bpe.decode(bpe.encode(docs)))
    assert all(bytes(back[i]["decoded"]).decode() == (t or "") for i, t in enumerate(TEXTS))
    assert bpe.digest(nothing).count() == 0


def test_edited_counts():
    import random

    tok, c, rng = coder(), bpe.encoder(*bpe.default_vocabulary()), random.Random(3)
    text = (BASE + "  \n 'tis 12345 !!  ") * 40
    tree = token_counts.TokenTree.of_text(c, text, leaf=4)
    for _ in range(300):
        at, cut, new = rng.randrange(len(text) + 1), rng.randrange(12), "".join(rng.choice("ab 'sre\n 1!é") for _ in range(rng.randrange(8)))
        tree.edit(at, cut, new)
        text = text[:at] + new + text[at + cut :]
        assert tree.n_tokens == len(tok.encode_ordinary(text)) and tree.n_chars == len(text)
    assert tree.text() == text


def edited(text, edits):
    for at, remove, insert in edits:
        at = max(0, min(at, len(text)))
        text = text[:at] + insert + text[at + max(0, remove) :]
    return text


def test_edited_counts_query(docs, nothing):
    tok = coder()
    with_edits = docs.withColumn("edits", token_counts.standard_edits())
    got, todo = rows(token_counts.count_edited(with_edits)), rows(with_edits.select("doc_id", "edits"))
    for i, t in enumerate(TEXTS):
        after = edited(t or "", [tuple(e) for e in todo[i]["edits"]])
        r = got[i]
        assert (r["n_tokens_before"], r["n_tokens"], r["n_edits"], r["n_chars"]) == (len(tok.encode_ordinary(t or "")), len(tok.encode_ordinary(after)), 3, len(after))
    assert token_counts.count_edited(nothing.withColumn("edits", token_counts.standard_edits())).count() == 0


def test_kept_trees_take_a_second_batch_of_edits(spark, docs, tmp_path):
    import random

    rng, tok, kinds = random.Random(8), coder(), "doc_id long, edits array<struct<at:bigint,remove:bigint,insert:string>>"
    now = {i: t or "" for i, t in enumerate(TEXTS)}
    token_counts.build_trees(docs).write.parquet(f"{tmp_path}/0")
    for step in range(2):
        edits = {i: [(rng.randrange(len(t) + 3), rng.randrange(30), rng.choice(["", "x", "new words here ", "'s \n", "é" * 300])) for _ in range(3)] for i, t in now.items()}
        edits[0] = None
        trees = spark.read.parquet(f"{tmp_path}/{step}").join(spark.createDataFrame([*edits.items()], kinds), "doc_id")
        token_counts.edit_trees(trees).write.parquet(f"{tmp_path}/{step + 1}")
        got = rows(spark.read.parquet(f"{tmp_path}/{step + 1}"))
        for i, t in now.items():
            now[i] = edited(t, edits[i] or [])
            assert (got[i]["n_tokens"], got[i]["n_chars"], "".join(got[i]["runs"])) == (len(tok.encode_ordinary(now[i])), len(now[i]), now[i])
            assert sum(got[i]["tokens"]) == got[i]["n_tokens"] and got[i]["n_tokens_before"] == len(tok.encode_ordinary(t))
        # the long texts are not encoded again
        assert all(got[i]["n_encoded_chars"] < 4000 < got[i]["n_chars"] for i in (13, 14))
    assert token_counts.edit_trees(trees.where("false")).count() == 0


@pytest.mark.parametrize("alphabet", ["a", "ab", "etaoinshrdlu", "thequickéß日"])
def test_long_pieces(alphabet):
    import random

    rng, c = random.Random(4), bpe.encoder(*bpe.default_vocabulary())
    for n in (513, 1024, 1500, 7001):
        piece = "".join(rng.choice(alphabet) for _ in range(n)).encode()
        assert np.frombuffer(c.vocabulary.encode_pieces([piece])[0], np.int32).tolist() == coder()._core_bpe.encode_single_piece(piece)


def licence_words(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_licences(t):
    """Labels and score by trying every template at every place."""
    w, labels, score = licence_words(t), set(), 0.0
    for phrase, label in license_scan.BASE:
        p = phrase.split()
        if any(w[k : k + len(p)] == p for k in range(len(w))):
            labels.add(label)
            score = 1.0
    for label, notice, phrase in license_scan.TEMPLATES:
        words, need = notice.split(), phrase.split()
        at = next(i for i in range(len(words)) if words[i : i + len(need)] == need)
        indexed = [i for i, x in enumerate(words) if x not in license_scan.FUNCTION_WORDS or at <= i < at + len(need)]
        for k in range(-len(words), len(w)):
            same = [i for i in indexed if 0 <= k + i < len(w) and w[k + i] == words[i]]
            if {*range(at, at + len(need))} <= {*same} and len(same) >= license_scan.ALIGNED * len(indexed):
                labels.add(label)
                score = max(score, len(same) / len(indexed))
    return ",".join(sorted(labels)), score


def test_licence_labels_are_those_of_brute_force(spark):
    import random

    rng, notices = random.Random(11), [n for _, n, _ in license_scan.TEMPLATES]
    pool = sorted({w for n in notices for w in n.split()} | {"some", "other", "words"})
    texts = [None, "", *notices, *(" ".join(rng.choice(pool) for _ in range(rng.randrange(60))) for _ in range(60))]
    for _ in range(80):  # notices, some of them damaged, among words of theirs
        parts = []
        for n in rng.sample(notices, rng.randrange(1, 4)):
            words = n.split()
            for _ in range(rng.choice([0, 0, 1, 3])):
                words[rng.randrange(len(words))] = rng.choice(pool)
            parts += [rng.choice(["", ", ", "- "]).join(["", " ".join(words).title()]), " ".join(rng.choice(pool) for _ in range(rng.randrange(9)))]
        texts.append(" ".join(parts))
    got = rows(license_scan.scan(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")))
    for i, t in enumerate(texts):
        labels, score = brute_licences(t)
        assert got[i]["labels"] == labels and got[i]["score"] == pytest.approx(score), t
    again = spark.createDataFrame([(None, texts[2], 1), (7, texts[3], 2), (7, texts[2], 3)], "doc_id long, text string, hits int")
    assert sorted(r["labels"] for r in license_scan.scan(again).collect()) == sorted(brute_licences(texts[i])[0] for i in (2, 3, 2))


def test_rarest_licence_words_lead(spark):
    """Which words are rare decides where is looked, not what is found."""
    index, reach = license_scan._index(license_scan.TEMPLATES), max(len(n.split()) for _, n, _ in license_scan.TEMPLATES)
    words = {w for _, _, own, _ in index for w in own.values()}
    texts = ["version license general public binary forms hereby " * 20, *["source granted kind of apache"] * 3, *[n for _, n, _ in license_scan.TEMPLATES]]
    hits = [(i, [(w, k) for k, w in enumerate(t.split()) if w in words]) for i, t in enumerate(texts)]
    files = spark.createDataFrame(hits, "row long, hits array<struct<w:string,i:int>>")
    times = collections.Counter(w for _, h in hits for w, _ in h)
    looked = []
    for sign in (-1, 1):
        post = license_scan.postings(index, {w: sign * times[w] for w in words})
        assert all(r[0] == r[3][0][0] and len(r[3]) == 2 for r in post)
        got = license_scan.probes(files, sorted({r[0] for r in post}), reach).collect()
        assert len(got) == sum(times[w] for w in {r[0] for r in post})
        assert all(len(r["near"]) <= 2 * reach + 1 and r["near"].count((r["w"], 0)) == 1 for r in got)
        looked.append(len(got))
    assert looked[0] * 2 < looked[1]


@pytest.mark.parametrize("looked_up", [1, 8])
def test_licence_words_looked_up_do_not_change_what_is_found(spark, looked_up):
    df = spark.createDataFrame([(i, f"{n} {m}") for i, (n, m) in enumerate((a[1], b[1]) for a in license_scan.TEMPLATES for b in license_scan.TEMPLATES)], "doc_id long, text string")
    assert rows(license_scan.scan(df, looked_up=looked_up)) == rows(license_scan.scan(df))


def test_license_scan(docs, nothing):
    got = rows(license_scan.scan(docs))
    for i, t in enumerate(TEXTS):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        starts, labels = [], set()
        for phrase, label in license_scan.BASE:
            p = phrase.split()
            own = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            starts += own
            labels |= {label} if own else set()
        r = got[i]
        assert (r["n_words"], r["n_base"]) == (len(w), len(starts))
        assert (r["first_word"], r["last_word"]) == ((min(starts), max(starts)) if starts else (None, None))
        assert r["base_labels"] == ",".join(sorted(labels))
    assert got[10]["labels"] == "cc-by,cc-by-nc-4.0,reserved" and got[11]["labels"] == "mit" and got[12]["labels"] == "gpl,gpl-3.0"
    assert got[3]["labels"] == "" and got[3]["score"] == 0
    assert license_scan.scan(nothing).count() == 0


def test_jaccard(spark, docs, nothing):
    got = rows(jaccard.link_documents(docs))
    sets = {}
    for i, t in enumerate(TEXTS):
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in sets:
        for j in range(i):
            same = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * same >= 85 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    assert all(got[i]["n_shingles"] == len(sets[i]) and got[i]["component_id"] == find(i) for i in sets)
    assert jaccard.link_documents(nothing).count() == 0


@pytest.mark.parametrize("percent", [50, 60, 75, 80, 85, 90])
def test_linked_sets_share_a_key(percent):
    rng = np.random.default_rng(percent)
    for n in (1, 5, 9, 40, 300, 900, 2500):
        for _ in range(20):
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            d = (100 - percent) * len(a) // percent
            cut = rng.integers(0, d + 1)
            b = np.unique(np.concatenate([a[rng.permutation(len(a))[cut:]], rng.integers(0, 2**63, d - cut).astype(np.uint64)]))
            same = len(np.intersect1d(a, b))
            if 100 * same >= percent * (len(a) + len(b) - same) and len(a) + len(b) > 2 * same:
                assert set(jaccard.group_keys(a, percent)) & set(jaccard.group_keys(b, percent))


def test_count_trees_find_all_that_is_linked(monkeypatch):
    import pyarrow as pa

    rng, percent = np.random.default_rng(7), 80
    for full in (65535, 6):  # with the second, points do not fit
        monkeypatch.setattr(jaccard, "FULL", full)
        base = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in rng.integers(3, 400, 60)]
        sets = base + [np.unique(np.r_[b[rng.random(len(b)) > 0.1], rng.integers(0, 2**63, len(b) // 15).astype(np.uint64)]) for b in base]
        sets = [s for s in sets if len(s)]
        points, sizes = jaccard.read_marks(pa.array([jaccard.mark_of(s) for s in sets]))
        assert sizes.tolist() == list(map(len, sets))
        tree, linked = jaccard.CountTree(points, sizes), 0
        for i, s in enumerate(sets):
            found = set(tree.search(points[i], sizes[i], percent).tolist())
            for j, t in enumerate(sets):
                same = len(np.intersect1d(s, t))
                if 100 * same >= percent * (len(s) + len(t) - same):
                    assert j in found
                    linked += i != j
        assert linked > 20


def test_mixing(docs, nothing):
    out = mixing.mix(docs).collect()
    assert len(out) == len(TEXTS) and {r["doc_id"]: r["size"] for r in out} == {i: len(WORD.findall(t or "")) for i, t in enumerate(TEXTS)}
    total, sources = sum(r["size"] for r in out), {r["source"]: (r["source_size"], r["target"]) for r in out}
    assert all(t <= 2 * s + 1e-9 for s, t in sources.values())
    assert sum(t for _, t in sources.values()) == pytest.approx(1.5 * total)
    assert mixing.mix_documents(docs).columns == docs.columns
    assert mixing.mix(nothing).count() == 0


def reshared(sizes, weights=(5.0, 2.0, 1.0), budget=1.5, most=2.0):
    """Targets by stopping the sources that are above their cap and sharing the rest anew, again and again."""
    w = {s: weights[i % len(weights)] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    rest, open_, out = budget * sum(sizes.values()), set(sizes), {}
    while open_:
        share = rest / sum(w[s] for s in open_)
        above = {s for s in open_ if share * w[s] > most * sizes[s]}
        if not above:
            return out | {s: share * w[s] for s in open_}
        out |= {s: most * sizes[s] for s in above}
        rest, open_ = rest - sum(most * sizes[s] for s in above), open_ - above
    return out


def test_mixing_targets_and_what_is_taken(spark):
    rng = np.random.default_rng(14)
    for trial in range(4):
        names = ["b", "B", "é", "a", None, "zz", ""][: 3 + trial]
        data = [(i, " ".join(["w"] * int(rng.integers(0, 30))), names[int(len(names) * rng.random() ** 2)]) for i in range(3000)]
        out = mixing.mix(spark.createDataFrame(data, "doc_id long, text string, source string")).collect()
        sizes, taken = collections.Counter(), collections.Counter()
        for r in out:
            sizes[r["source"]] += r["size"]
            taken[r["source"]] += r["size"] * r["copies"]
        want = reshared(sizes)
        for r in out:
            assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]]) and r["copies"] <= 2
        assert all(abs(taken[s] - want[s]) < 0.1 * want[s] + 200 for s in sizes)
        again = mixing.mix(spark.createDataFrame(data[::-1], "doc_id long, text string, source string")).collect()
        assert {(r["doc_id"], r["copies"]) for r in again} == {(r["doc_id"], r["copies"]) for r in out}


def test_quality(docs, nothing):
    got = rows(quality.assess(docs))
    for i, t in enumerate(TEXTS):
        w = WORD.findall(t or "")
        c, cov, seen, dup = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7)), set(), set(), 0
        for k in range(len(w) - 7):
            if c[tuple(w[k : k + 8])] > 1:
                cov.update(range(k, k + 8))
        for line in (t or "").split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(cov))
        assert r["base_failed"] == (len(w) < 20 or 100 * len(cov) > 30 * len(w))
        assert not (r["base_failed"] and r["kept"])
    assert quality.assess(nothing).count() == 0


def test_sharding(docs, nothing):
    out = sharding.shard(docs, shards=3, slots=64).collect()
    for r in out:
        raw = (TEXTS[r["doc_id"]] or "").encode()
        assert r["size"] == len(raw) + 1 and r["text_crc32"] == zlib.crc32(raw)
    by = collections.defaultdict(list)
    for r in out:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert sharding.shard(nothing).count() == 0
    odd = spark_of(docs).createDataFrame([(None, f"t{i % 50}") for i in range(200)] + [(5, f"u{i}") for i in range(200)], "doc_id long, text string")
    placed = sharding.shard(odd, shards=4).collect()
    by = collections.Counter(r["shard"] for r in placed)
    assert len(placed) == 400 and len({(r["shard"], r["slot"]) for r in placed}) == 400 and max(by.values()) < 150


def spark_of(df):
    return df.sparkSession


def test_slot_maps_are_kept_and_edited(spark, tmp_path):
    rng, path = np.random.default_rng(2), f"{tmp_path}/map"
    texts = ["x" * int(n) for n in rng.integers(1, 400, 900)]
    some = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    maps = {}

    def load(v):
        maps[v] = {r["vslot"]: r["shard"] for r in sharding.load_map(spark, path, v).collect()}
        return maps[v]

    for step, shards in ((0, 8), (1, 8), (2, 9), (3, 5)):
        now = some.where(f"doc_id < {450 * (step + 1)}")
        out = sharding.shard(now, shards=shards, slots=256, map_path=path).collect()
        assert {r["version"] for r in out} == {step + 2}
        slots = collections.defaultdict(int)
        for r in out:
            slots[r["vslot"]] += r["size"]
        before, after = load(step + 1), load(step + 2)
        assert after.keys() == before.keys() == set(range(256)) and all(after[r["vslot"]] == r["shard"] for r in out)
        total, mean = collections.Counter({i: 0 for i in range(shards)}), sum(slots.values()) / shards
        held = collections.Counter()
        for v, s in after.items():
            total[s] += slots[v]
        for v, s in before.items():
            held[s] += slots[v]
        # loads near equal; a slot moves off a shard that was over its share or is no more, and off no other
        assert max(total.values()) - min(total.values()) <= max(slots.values()) and set(total) == set(range(shards))
        assert all(before[v] == s or before[v] >= shards or held[before[v]] > sharding.FILLED * mean for v, s in after.items())
    assert sharding.load_map(spark, f"{tmp_path}/none") is None
    assert maps[2] != maps[1] and sharding.load_map(spark, path).first()["version"] == 5


PAGES = [
    ("http://www.example.com/fr/1", ""), ("https://a.example.com/en/7?utm_source=x", None), ("http://www.example.com/en/7", ""), ("http://b.org/x", ""), (None, ""), ("no scheme", '<link rel=canonical href="http://n.net/es/1">'),
    ("http://N.NET/es/", ""), ("http://c.org/p", '<LINK HREF="http://z.net/fr/p" REL="shortlink CANONICAL">'), ("http://d.org/q", ""), ("http://e.org/a/b?x=1#t", "<link rel='canonical' href='../c'><META content=\"3; URL='//n.net/es/k?a=1&amp;b=2'\" http-equiv=Refresh>"),
    ("http://n.net/es/k?a=1&b=2", ""), ("http://f.org/1", '<meta property="og:url" content="/2">'), ("http://f.org/2#x", '<link rel="canonical" href="3">'), ("http://f.org/3", '<link rel="canonical" href="?p=2"><link rel="canonical" href="http://a.example.com/en/9">'),
    ("http://g.org/1", '<link rel="stylesheet" href="http://n.net/es/1"> http://n.net/es/1 <meta name="og:url" content="http://n.net/es/1">'), ("http://h.org", '<link rel="canonical" href="mailto:x@n.net/es/"><link rel="canonical" href="#top">'), ("http://www.example.com/fr/2", '<link rel="canonical" href="http://n.net/es/1">'),
    ("http://i.org", '<link rel="canonical" href="q">'), ("http://i.org/q", '<link rel="canonical" href="http://n.net/fr/1">'), ("http://d.org/q", "again"),
]


def test_url_filter(spark):
    pages = spark.createDataFrame([(i, u, h, 1, "c") for i, (u, h) in enumerate(PAGES)], "page_id long, url string, html string, host int, component string")
    redirects = spark.createDataFrame([("http://d.org/q", "http://n.net/es/k"), (None, "http://d.org/q"), ("http://b.org/x", "http://b.org/x#y")], "from_url string, to_url string")
    got = {i: (r["rule"], r["verdict"]) for i, r in rows(url_filter.filter_urls(pages, redirects), "page_id").items()}
    assert got[0] == ("com/", "allow") and got[1] == ("example.com/en/", "block") and got[2] == ("www.example.com/en/", "allow")
    assert {i for i, v in got.items() if v == (None, "block")} == {7, 8, 9, 11, 12, 13, 17, 18, 19}
    assert {i for i, v in got.items() if v == (None, "allow")} == {3, 4, 5, 14, 15} and got[6] == ("net/es/", "block") and got[16] == ("com/", "allow")
    assert url_filter.filter_urls(pages.where("false")).count() == 0


def test_url_filter_is_its_sql(spark, tmp_path):
    import duckdb

    pages = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(PAGES)], "page_id long, url string, html string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = con.sql(queries.ORACLE_SQL["op9_url_filters"]).fetchall()
    got = [tuple(r) for r in url_filter.op9(spark, str(tmp_path)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and sum(r[4] == "block" and r[3] is None for r in got) == 7


def edit_distance(a, b):
    p = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        q = [i]
        for j, d in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (c != d)))
        p = q
    return p[-1]


def test_edit_distance_and_probes():
    import random

    rng = random.Random(5)
    for _ in range(3000):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randrange(14))) for _ in "xy")
        for k in (1, 2, 3):
            assert line_dedup.within(a, b, k) == (edit_distance(a, b) <= k)
        if len(b) >= len(a) > 3 and edit_distance(a, b) <= 2:
            assert {(len(a), i, a[p : p + m]) for i, (p, m) in enumerate(line_dedup.segments(len(a), 2))} & set(line_dedup.probes(b, 2))


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_lines_keys_are_hashes_of_their_probes(edits):
    import random

    rng, seen = random.Random(edits), {}
    lines = ["".join(rng.choice("abé日\x00") for _ in range(rng.randrange(edits + 1, 40))) for _ in range(400)]
    keys, counts = line_dedup.lines_keys(lines, edits)
    for line, own in zip(lines, np.split(keys, np.cumsum(counts)[:-1])):
        want = set(line_dedup.probes(line, edits))
        assert len(own) == len(set(own.tolist())) == len(want)
        seen.update({p: seen.get(p, set(own.tolist())) & set(own.tolist()) for p in want})
    # equal probes of different lines have a hash in common
    assert all(seen.values())


def test_line_dedup(spark, docs, nothing):
    line = "this passage of several words repeats across documents é"
    extra = spark.createDataFrame([(100, f"first of all\n{line}", "c"), (101, f"{line[:-1]}e!\nsomething else entirely", "c"), (102, line, "c"), (102, line, "c"), (103, None, "c")], "doc_id long, text string, __lines string")
    out = {(r["doc_id"]): r for r in line_dedup.dedup_lines(extra, names=("a", "b", "c")).collect()}
    assert out[100]["text"] == f"first of all\n{line}" and out[101]["text"] == "something else entirely" and out[102]["text"] == "" and out[103]["text"] is None
    assert line_dedup.dedup_lines(docs).count() == len(TEXTS) and line_dedup.dedup_lines(nothing).count() == 0


def test_near_vectors(spark):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((60, 16))
    x = np.concatenate([base, base[:20] + 0.1 * rng.standard_normal((20, 16)), base[:5], 3 * base[5:8]])
    data = [(i, v.astype(float).tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0, None]), (904, [])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = rows(near_vectors.near_vectors(df), "vec_id")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    links = (u @ u.T >= 0.95).sum(1) - 1
    assert [got[i]["n_links"] for i in range(len(x))] == links.tolist()
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in range(900, 905))
    assert near_vectors.near_vectors(df.where("false")).count() == 0


def cone(n, pairs, dim=64, seed=4):
    """Unit vectors around one direction with cosines of about 0.84; the last ones are each near one of the first."""
    rng = np.random.default_rng(seed)

    def unit(x):
        return x / np.linalg.norm(x, axis=1)[:, None]

    axis = np.zeros(dim)
    axis[0] = 1
    x = unit(axis * 0.917 + 0.4 * unit(rng.standard_normal((n, dim))))
    return np.concatenate([x, unit(x[:pairs] + 0.25 * unit(rng.standard_normal((pairs, dim))))])


def test_near_vectors_of_odd_rows(spark):
    x = np.eye(4).tolist()
    data = [(1, x[0], 1), (1, x[0], 2), (None, x[0], 3), (None, x[1], 4), (5, [1.0, 0.0], 5), (6, [1.0, 0.01], 6), (7, x[2], 7), (7, x[3], 8), (8, [1e300, 0.0, 0.0, 0.0], 9), (9, [-1.0, -0.0, 0.0, 0.0], 10)]
    got = sorted((repr(r["vec_id"]), r["n_links"], repr(r["component_id"])) for r in near_vectors.near_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>, unit int")).collect())
    assert got == sorted([("1", 3, "1"), ("1", 3, "1"), ("None", 3, "1"), ("8", 3, "1"), ("None", 0, "None"), ("5", 1, "5"), ("6", 1, "5"), ("7", 0, "7"), ("7", 0, "7"), ("9", 0, "9")])


def test_near_vectors_reach_their_recall(spark):
    rng = np.random.default_rng(12)
    base = rng.standard_normal((9000, 32))
    near = base[:900] + 0.29 / 32**0.5 * np.linalg.norm(base[:900], axis=1)[:, None] * rng.standard_normal((900, 32))
    x = np.concatenate([base, near])
    u = x / np.linalg.norm(x, axis=1)[:, None]
    links = (u @ u.T >= 0.95).sum(1) - 1
    out = rows(near_vectors.near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")), "vec_id")
    got = np.array([out[i]["n_links"] for i in range(len(x))])
    assert links.sum() > 800 and (got <= links).all() and got.sum() >= 0.98 * links.sum() and out[0]["recall"] >= 0.99 and out[0]["audited"] > 100


def test_near_vectors_in_a_crowd(spark):
    x = cone(8000, 600)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = rows(near_vectors.near_vectors(df, rounds=2), "vec_id")
    assert [got[i]["n_links"] for i in range(len(x))] == ((x @ x.T >= 0.95).sum(1) - 1).tolist()


def test_near_vectors_of_two_tight_groups(spark, monkeypatch):
    rng = np.random.default_rng(6)
    turned = np.eye(64)[0] * 0.975 + np.eye(64)[1] * (1 - 0.975**2) ** 0.5
    x = np.concatenate([np.tile(np.eye(64)[0], (700, 1)), np.tile(turned, (700, 1))]) + 0.003 * rng.standard_normal((1400, 64))
    x = np.concatenate([x, rng.standard_normal((1500, 64))])
    # the search stands alone: an audit would tie the groups by itself
    monkeypatch.setattr(near_vectors, "_audit", lambda classes, *_: (1.0, 10**6, classes.where("false").select("id", "id").toDF("a", "b")))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = rows(near_vectors.near_vectors(df, audited=8), "vec_id")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    assert [got[i]["n_links"] for i in range(len(x))] == ((u @ u.T >= 0.95).sum(1) - 1).tolist()
    assert {got[i]["component_id"] for i in range(1400)} == {0}


def test_license_scan_of_several_notices(spark):
    notices = {label: notice for label, notice, _ in license_scan.TEMPLATES}
    bsd, gpl, apache = (notices[x] for x in ("bsd", "gpl-3.0", "apache-2.0"))
    texts = [f"{bsd} released under the mit license", f"{bsd} {gpl}", f"{license_scan.TEMPLATES[-1][1]} {apache}", " ".join(notices.values())]
    df = spark.createDataFrame([*enumerate(texts), *[(10 + i, "permission software licensed version released gnu mit apache general public license") for i in range(30)]], "doc_id long, text string")
    got = rows(license_scan.scan(df))
    assert [got[i]["labels"] for i in range(3)] == ["bsd,mit", "bsd,gpl,gpl-3.0", "apache-2.0,mit"]
    assert set(got[3]["labels"].split(",")) == {*notices, "cc-by", "gpl"} and got[10]["labels"] == "gpl"


def brute_mcd(x, starts, core=0.75):
    """Least log determinant that exact concentration steps reach from many random starts."""
    floors, best = np.array(list(quality.FLOORS.values())), np.inf
    rng, h = np.random.default_rng(0), int(np.ceil(core * len(x)))
    for _ in range(starts):
        own = rng.permutation(len(x))[: max(6, len(x) // 8)]
        for _ in range(30):
            c = np.cov(x[own].T, bias=True) * quality.consistency(core, 4)
            c[np.diag_indices(4)] = np.maximum(c[np.diag_indices(4)], floors**2)
            d = x - x[own].mean(0)
            own = np.argsort((d @ np.linalg.inv(c) * d).sum(1))[:h]
        best = min(best, np.linalg.slogdet(c)[1])
    return best


def test_least_determinant(spark):
    rng, names = np.random.default_rng(5), list(quality.FLOORS)
    groups = {1: rng.multivariate_normal(np.zeros(4), np.diag([1, 4, 2, 3.0]) + 0.8, 600), 2: np.concatenate([rng.standard_normal((420, 4)) * 2, rng.standard_normal((90, 4)) * 0.7 + 9])}
    groups[3] = np.concatenate([groups[1][:300] @ np.diag([1, -1, 1, 1]), np.full((60, 4), 12.0)])
    df = spark.createDataFrame([(g, *map(float, r)) for g, x in groups.items() for r in x], "g long, " + ", ".join(f"{n} double" for n in names))
    fits = quality.least_determinant(df, common.Scratch(spark, "test"), names)
    got = rows(fits, "g")
    far = quality._with_distance(df, fits, names).collect()
    for g, x in groups.items():
        assert got[g]["logdet"] <= brute_mcd(x, 20) + 0.1
        L = np.array([[got[g][f"l_{a}_{b}"] if j <= i else 0.0 for j, b in enumerate(names)] for i, a in enumerate(names)])
        d = x - np.array([got[g][f"mu_{a}"] for a in names])
        want = (d @ np.linalg.inv(L @ L.T) * d).sum(1)
        np.testing.assert_allclose(sorted(r["d2"] for r in far if r["g"] == g), sorted(want), rtol=1e-6)
    # the planted rows, far out on every axis, are outside, the others inside
    assert all((r["d2"] > quality.CUTOFF) == (min(r[n] for n in names) > 5) for r in far)
    assert quality.consistency(0.75, 4) == pytest.approx(1.487, abs=0.01) and quality.consistency(1, 4) == 1


def test_concentration_goes_on_until_it_settles(spark):
    """Two like clusters, so that the core moves from one to the other over many steps; whatever is taken, another step from it gains nothing."""
    rng, names = np.random.default_rng(17), list(quality.FLOORS)
    x = np.concatenate([rng.standard_normal((900, 4)) * 3, rng.standard_normal((700, 4)) * 2.5 + [7, 0, 7, 0]])
    df = spark.createDataFrame([(1, *map(float, r)) for r in x], "g long, " + ", ".join(f"{n} double" for n in names))
    tight = quality.least_determinant(df, common.Scratch(spark, "test"), names)
    far = quality._with_distance(df, tight, names)
    near = far.join(quality._levels(far, quality.CORE), ["g", "start"]).where(quality._bin(far["d2"]) <= F.col("edge"))
    after = quality._factor(near.groupBy("g", "start").agg(*quality._moments(names)), names, quality.consistency(quality.CORE, 4)).first()["logdet"]
    assert after >= tight.first()["logdet"] - quality.SETTLED


def test_quality_of_small_groups(spark):
    rng = np.random.default_rng(9)

    def words(mark, n=60):
        return " ".join("".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) + mark for _ in range(n))

    data = [(i, words(""), "en", "large") for i in range(300)] + [(300 + i, words("####"), "en", "junk") for i in range(10)]
    data += [(400 + i, words("####"), "eo", "rare") for i in range(3)] + [(500 + i, words(""), "eo", "good") for i in range(3)]
    got = rows(quality.assess(spark.createDataFrame(data, "doc_id long, text string, lang string, source string")))
    assert not any(r["base_failed"] for r in got.values())
    assert {i for i, r in got.items() if not r["kept"]} == {*range(300, 310), *range(400, 403)}


def test_line_dedup_of_short_and_unspaced_lines(spark):
    long = "吾輩は猫である名前はまだ無いどこで生れたかとんと見当がつかぬ"
    data = [(1, f"All rights reserved.\n\n{long}\nok"), (2, f"All rights reserved.\n\n{long[:-1]}う\nOk"), (3, "ok\n短い行\nnew"), (4, "短い行\n \n \n短い字")]
    out = rows(line_dedup.dedup_lines(spark.createDataFrame(data, "doc_id long, text string")))
    assert [out[i]["text"] for i in range(1, 5)] == [data[0][1], "\nOk", "短い行\nnew", " \n \n短い字"]


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [*rng.integers(0, 60, (35, 2)).tolist(), *[[i, i + 1] for i in range(60, 80)], *[[100, i] for i in range(101, 130)]]
    up = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in up:
        for a, b in edges:
            if a != b:
                up[a] = up[b] = min(up[a], up[b])
    df = spark.createDataFrame([*map(tuple, edges), (5, None), (None, None)], "a long, b long")
    got = common.connected_components(df, common.Scratch(spark, "test")).collect()
    assert sorted(map(tuple, got)) == sorted(up.items())


@pytest.mark.parametrize("most", [28, 0])
def test_joins_are_the_same_in_small_tiles_and_without_bitmaps(spark, docs, monkeypatch, most):
    monkeypatch.setattr(common.KeyFilter, "MOST_BITS", most)
    monkeypatch.setattr(clusters, "TILE", 4)
    monkeypatch.setattr(clusters, "SMALL", 2)
    rng = np.random.default_rng(1)
    words = [str(w) for w in rng.integers(0, 10**6, 80)]
    texts = []
    for i in range(60):  # one large group of near copies, some pairs
        own = list(words) if i < 30 else [f"{w}{i // 2}" for w in words]
        own[int(rng.integers(80))] = f"changed{i}"
        texts.append(" ".join(own) if i % 3 else "\n".join([" ".join(own[:40]), " ".join(own[40:])]))
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    sets = [{tuple(w[k : k + 4]) for k in range(len(w) - 3)} for w in map(str.split, texts)]
    up = list(range(60))
    for a, b in [(a, b) for a in range(60) for b in range(60) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])] * 8:
        up[a] = up[b] = min(up[a], up[b])
    got = rows(jaccard.link_documents(df))
    assert [got[i]["component_id"] for i in range(60)] == up
    lines = [(f"{i:03d}" if i < 40 else f"{i:03d}" * 3) + " the same line of some words with number é" for i in range(60)]
    out = rows(line_dedup.dedup_lines(spark.createDataFrame([*enumerate(lines)], "doc_id long, text string")))
    up = list(range(60))
    for a, b in [(a, b) for a in range(60) for b in range(a) if edit_distance(lines[a], lines[b]) <= 2] * 8:
        up[a] = up[b] = min(up[a], up[b])
    assert [out[i]["text"] == "" for i in range(60)] == [up[i] < i for i in range(60)]


def test_line_dedup_is_brute_force(spark):
    import random

    rng = random.Random(21)
    base = ["".join(rng.choice("abcd ") for _ in range(rng.randrange(18, 30))) for _ in range(12)]

    def line():
        x = rng.choice(base)
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            k = rng.randrange(len(x))
            x = x[:k] + rng.choice(["", "z", "yé"]) + x[k + rng.randrange(2) :]
        return rng.choice([x, x, x, "short", "", "  "])

    data = [(i // 2 if i % 5 else None, "\n".join(line() for _ in range(rng.randrange(1, 7)))) for i in range(50)]
    every = sorted({(k is not None, k or 0, common_hash(spark, t), t) for k, t in data})
    places = [(d, i, x) for d, (*_, t) in enumerate(every) for i, x in enumerate(t.split("\n"))]
    texts = sorted({x for *_, x in places if x.strip()})
    near = {(a, b) for a in texts for b in texts if a == b or len(a) >= 20 and len(b) >= 20 and edit_distance(a, b) <= 2}
    up = {x: x for x in texts}
    for a, b in sorted(near) * 6:
        up[a] = up[b] = min(up[a], up[b])
    seen, left = set(), collections.defaultdict(list)
    for d, _, x in places:
        if not x.strip() or up[x] not in seen:
            left[d].append(x)
            seen.add(up.get(x))
    want = collections.Counter()
    at = {(k if known else None, t): d for d, (known, k, _, t) in enumerate(every)}
    for k, t in data:
        want[k, "\n".join(left[at[k, t]])] += 1
    got = collections.Counter((r["doc_id"], r["text"]) for r in line_dedup.dedup_lines(spark.createDataFrame(data, "doc_id long, text string")).collect())
    assert got == want


def common_hash(spark, text):
    from pyspark.sql import functions as F

    return spark.range(1).select(F.xxhash64(F.lit(text)).alias("h")).first()["h"]


def test_queries_over_a_whole_table(spark):
    import duckdb

    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    con.sql("set timezone='UTC'")
    for name in ("documents", "pages", "embeddings"):
        con.sql(f"create view {name} as select * from '{sf}/{name}.parquet'")
    texts = dict(con.sql("select doc_id, text from documents").fetchall())
    n = {"op8_embedding_near_dedup": con.sql("select count(*) from embeddings").fetchall()[0][0], "op9_url_filters": con.sql("select count(*) from pages").fetchall()[0][0], "op13_posting_lists": con.sql("select 10 * count(*) from embeddings where vec_id % 100 = 0").fetchall()[0][0]}
    tok = coder()
    for name, query in queries.QUERIES.items():
        got = query(spark, sf).collect()
        assert len(got) == n.get(name, len(texts)), name
        if sql := queries.ORACLE_SQL.get(name):
            columns = got[0].__fields__
            order = con.sql(sql)
            want = sorted(repr(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in order.select(*columns).fetchall())
            assert sorted(repr(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in got) == want, name
        if name == "op1_token_counts":
            assert all(r["n_tokens_before"] == len(tok.encode_ordinary(texts[r["doc_id"]] or "")) for r in got)
        if name == "op2_byte_bpe":
            assert all(r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest() for r in got)
        if name == "op3_license_scan":
            assert all((r["labels"], pytest.approx(r["score"])) == brute_licences(texts[r["doc_id"]]) for r in got)
        if name == "op7_sharding":
            load = collections.Counter()
            for r in got:
                load[r["shard"]] += r["size"]
            assert len(load) == 16 and max(load.values()) - min(load.values()) <= max(r["size"] for r in got)


#: Names that operators use inside, as columns of the input.
CLASHES = ("k", "t", "h", "c", "w", "n", "e", "id", "row", "key", "keys", "runs", "tokens", "ids", "hits", "share", "size", "source_size", "target", "copies", "vslot", "shard", "slot", "version", "crc", "kept", "d2", "g", "start", "lines", "gone", "component_id", "__k", "__id", "edits_", "labels")


@pytest.mark.parametrize(
    "operator",
    [
        lambda d: token_counts.count_edited(d.withColumn("edits", token_counts.standard_edits())), bpe.digest, license_scan.scan, jaccard.link_documents, mixing.mix, mixing.mix_documents, quality.assess, sharding.shard, line_dedup.dedup_lines,
    ],
    ids=["op1", "op2", "op3", "op4", "op5", "op5 rows", "op6", "op7", "op10"],
)
def test_odd_rows_and_clashing_names(spark, operator):
    long = " ".join(f"word{i % 997}" for i in range(60_000))
    data = [(None, None, None, None), (None, "", "en", None), (None, BASE, None, "s"), (None, BASE, None, "s"), (1, BASE, "en", "s"), (1, BASE, "en", "s"), (1, BASE + " more", "en", None), (2, long, "de", "t"), (3, "x" * 60_000, "de", "t"), (4, "\n" * 5000, "", ""), (5, "é日本\x00 \x0b\n" * 40, "en", "s")]
    kind = "doc_id long, text string, lang string, source string"
    plain = spark.createDataFrame(data, kind)
    wide = spark.createDataFrame([(*r, *["clash"] * len(CLASHES)) for r in data], kind + "".join(f", `{c}` string" for c in CLASHES))
    own = operator(plain)
    names = [c for c in own.columns if c not in CLASHES] if own.columns[: len(plain.columns)] == plain.columns else own.columns
    a, b = (sorted(repr(tuple(r)) for r in x.select(*[x[c] for c in names]).collect()) for x in (own, operator(wide)))
    assert a == b and (len(a) == len(data) or operator is mixing.mix_documents)
    assert operator(wide.where("false")).count() == 0 and operator(plain.where("doc_id is null and text is null")).count() in (0, 1)
