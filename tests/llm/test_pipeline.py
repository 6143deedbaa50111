"""The pipeline's stages, each against brute force on the rows that the one before kept."""

import collections
import re

import corpus_pipeline
import pytest
from trialwise.llm import bpe, line_dedup, mixing, quality

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def story(seed, n=60):
    import random

    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def lines_of(text):
    return [x for x in (text or "").split("\n") if len(WORD.findall(x)) >= 5 and len(x) >= 20]


@pytest.fixture(scope="module")
def docs(spark):
    shared = story(900, 12)
    texts = [story(i) for i in range(12)]
    texts += [f"{story(100 + i)}\n{shared}" for i in range(3)]
    texts += [texts[0], texts[1] + " more", texts[2].upper(), "too short", "", None, "same again " * 40]
    rows = [(i, t, "en" if i % 3 else "de", f"s{i % 3}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[3], (4, story(77), "en", "s1", 5)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def steps(spark, docs, tmp_path_factory):
    """(name, rows in, rows out) of each stage."""
    out, now = [], docs
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(n))
        stage(spark, now, "").write.parquet(path)
        after = spark.read.parquet(path)
        out.append((now, after))
        now = after
    return out


def pairs(df):
    return collections.Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_columns(steps, docs):
    assert all(after.dtypes == docs.dtypes for _, after in steps[:-1])


def test_quality_stage(steps):
    before, after = pairs(steps[0][0]), pairs(steps[0][1])
    verdict = {r["doc_id"]: r["kept"] for r in quality.assess(steps[0][0]).collect()}
    assert all(after[k] in (0, n) for k, n in before.items()) and set(after) <= set(before)
    assert {i for i, t in before if len(WORD.findall(t or "")) < 20}.isdisjoint({i for i, _ in after})
    assert {i for i, _ in after} - {4} == {i for i, ok in verdict.items() if ok} - {4}


def test_line_stage(steps):
    before, after = steps[1]
    assert before.count() == after.count()
    # rows equal in key and text are one document
    left = [x for _, t in pairs(after) for x in lines_of(t)]
    every = {x for _, t in pairs(before) for x in lines_of(t)}
    # of lines that are within two edits one stays, and each that went is near one that stayed
    assert all(a == b or not line_dedup.within(a, b, 2) for i, a in enumerate(left) for b in left[:i])
    assert len(left) == len(set(left)) and all(any(line_dedup.within(x, y, 2) for y in left) for x in every)
    assert all(r["n_chars"] == len(r["text"] or "") for r in after.collect() if r["doc_id"] != 4)


def test_near_duplicate_stage(steps):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    before, after = pairs(steps[2][0]), pairs(steps[2][1])
    sets = {k: shingles(k[1]) for k in before}
    near = lambda a, b: bool(sets[a]) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    kept = {k for k in after if sets[k]}
    assert all(after[k] == 1 for k in kept) and not any(near(a, b) for a in kept for b in kept if a != b)
    # every row that went can be reached from one that stayed
    reached = set(kept)
    while more := {k for k in before if k not in reached and any(near(k, r) for r in reached)}:
        reached |= more
    assert reached >= {k for k in before if sets[k]}
    assert {k: n for k, n in before.items() if not sets[k]} == {k: n for k, n in after.items() if not sets[k]}


def test_mixing_stage(steps):
    before, after = steps[3]
    made = collections.Counter((r["doc_id"], r["text"]) for r in after.collect())
    sizes = collections.Counter()
    for r in before.collect():
        sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
    targets = {r["source"]: r["target"] / r["source_size"] if r["source_size"] else 0 for r in mixing.mix(before).collect()}
    for r in before.collect():
        assert made[r["doc_id"], r["text"]] in (int(targets[r["source"]]), int(targets[r["source"]]) + (targets[r["source"]] % 1 > 0))
    assert set(made) <= set(pairs(before)) and set(targets) == set(sizes)


def test_encoding_stage(steps):
    import public_tokenizers as P
    import tiktoken

    before, after = steps[4]
    coder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.encoder(*bpe.default_vocabulary()).vocabulary.ranks, special_tokens={})
    want = collections.Counter((r["doc_id"], r["source"], tuple(coder.encode_ordinary(r["text"] or ""))) for r in before.collect())
    assert want == collections.Counter((r["doc_id"], r["source"], tuple(r["ids"])) for r in after.collect())
    assert all(r["n_tokens"] == len(r["ids"]) for r in after.collect())


def test_nothing(spark, docs):
    now = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, "")
    assert now.count() == 0


def test_clashing_names(docs):
    """Columns named as the helper's own change nothing in which rows are picked."""
    clashing = docs
    for name in ("__key", "__hash", "picked_key", "Picked_Hash", "id", "h"):
        clashing = clashing.withColumn(name, docs["doc_id"] * 2)
    ids = corpus_pipeline.marked(docs).where("id.doc_id % 2 = 0").select("id")
    got = corpus_pipeline.picked(clashing, ids)
    assert got.columns == clashing.columns and pairs(got) == pairs(docs.where("doc_id % 2 = 0"))
    assert all(r["__key"] == r["picked_key"] == r["id"] == 2 * r["doc_id"] for r in got.collect())


def test_single_documents_are_not_shuffled(spark, docs, monkeypatch):
    """Of the near-duplicate stage, texts of documents that are alone in their component are in no join; beyond the bitmap's bound all are, with the same rows."""
    kept = corpus_pipeline.picked
    joined = []
    monkeypatch.setattr(corpus_pipeline, "picked", lambda some, ids: joined.append(some.count()) or kept(some, ids))
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert joined[0] < docs.count() and got.columns == docs.columns
    want = pairs(got)
    monkeypatch.setattr(corpus_pipeline, "parted", lambda some, ids: (None, some))
    assert pairs(corpus_pipeline.near_duplicates(spark, docs, "")) == want and joined[1] == docs.count()
