"""Deduplication operators against brute force, with the edge cases that their docstrings define."""

import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lucidgraph.llm import common, embedding_dedup, exact_dedup, jaccard_join, substring_dedup

WORDS = [a + b for a in "ba ko ri tu ne".split() for b in "la mo si dun".split()]


def corpus(seed=3, n=60):
    """Ids and texts: random ones, copies, near copies, shared passages, nulls, empty and short ones."""
    rng = random.Random(seed)
    some = lambda k: [rng.choice(WORDS) for _ in range(k)]
    passage = some(30)
    rows = [(1, None), (2, ""), (3, " \t "), (4, "Ba"), (5, "ba"), (6, "Ko ri"), (7, "a  b\n c"), (8, "a b c"), (9, "ünï 漢 🙂 x y z")]
    base = some(120)
    for i in range(10, 10 + n):
        kind = i % 6
        if kind == 0:
            words = some(rng.randrange(1, 200))
        elif kind == 1:
            words = base[:]
        elif kind == 2:
            words = base[:]
            words[rng.randrange(len(words))] = "edit"
        elif kind == 3:
            words = some(20) + passage + some(rng.randrange(5))
        elif kind == 4:
            words = base[: rng.randrange(100, 120)]
        else:
            words = some(rng.randrange(1, 14))
        rows.append((i, rng.choice([" ", "  ", "\n"]).join(words)))
    rows.append((200, " ".join(some(5000))))
    rows.append((None, "a b c"))
    rng.shuffle(rows)
    return rows


def frame(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    return df.selectExpr("*", "'x' as _id", "1 as n", "'y' as _text") if extra else df


def components(pairs, ids):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("limit", [None, 1])
def test_exact(spark, monkeypatch, limit):
    if limit:
        monkeypatch.setattr(common, "hot_limit", lambda n: limit)
    rows = corpus() + [(11, dict(corpus())[11])]
    got = exact_dedup.exact_duplicates(frame(spark, rows)).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    assert len(got) == len(rows)
    by_hash = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    for r in got:
        ids = by_hash[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == min([i for i in ids if i is not None], default=None)
    assert sum(r.kept for r in got) == len(groups)
    kept = exact_dedup.exact_dedup(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns and kept.count() == len(groups)


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set())


def row_components(rows, k, num):
    """Of each row the size of its set and the smallest id that its text reaches; rows, not ids, are linked."""
    sets = [shingles(t, k) if i is not None else set() for i, t in rows]
    pairs = [(a, b) for a in range(len(rows)) for b in range(a + 1, len(rows)) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    at = components(pairs, range(len(rows)))
    least = {}
    for r, root in at.items():
        least[root] = min(least.get(root, rows[r][0]), rows[r][0]) if rows[r][0] is not None else None
    return [(i, len(shingles(t, k)), least[at[r]]) for r, (i, t) in enumerate(rows)], at


def ordered(found):
    return sorted(map(tuple, found), key=repr)


@pytest.mark.parametrize("k,num,chunk", [(3, 90, 800), (5, 80, 4), (2, 60, 3)])
def test_jaccard(spark, monkeypatch, k, num, chunk):
    monkeypatch.setattr(jaccard_join, "CHUNK_DOCS", chunk)
    if chunk < 800:
        monkeypatch.setattr(jaccard_join, "hot_limit", lambda n: 4)
    rows = corpus()
    # ids that repeat: with other texts, with near copies, as whole rows, in other case
    texts = dict(rows)
    rows += [(11, texts[15]), (12, "lone words that nobody else has at all here"), (12, texts[11]), (17, texts[17].upper()), (200, texts[200]), (200, texts[200]), (3, texts[11])]
    want, at = row_components(rows, k, num)
    assert ordered(jaccard_join.ngram_components(frame(spark, rows, False), n=k, similar=(num, 100)).collect()) == ordered(want)
    assert any(c != i for i, _, c in want)
    if chunk == 3:
        return
    groups = {}
    for r, root in at.items():
        groups.setdefault(root, []).append(r)
    kept = jaccard_join.ngram_dedup(frame(spark, rows).withColumnsRenamed({"_text": "_gone", "n": "_key"}), n=k, similar=(num, 100))
    assert kept.columns == ["doc_id", "text", "_id", "_key", "_gone"]
    got = ordered((r.doc_id, r.text) for r in kept.collect())
    assert len(got) == len(groups) and set(got) <= set(rows)
    for members in groups.values():
        least = min((rows[r][0] for r in members if rows[r][0] is not None), default=None)
        assert sum((rows[r][0], rows[r][1]) in got for r in members) >= 1 and any((least, rows[r][1]) in got for r in members)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 400), st.integers(0, 60), st.integers(0, 60), st.sampled_from([(90, 100), (80, 100), (60, 100)]), st.randoms(use_true_random=False))
def test_similar_sets_share_a_block(n, more, fewer, similar, rng):
    import numpy as np

    order = np.array(rng.sample(range(1 << 40), n + more), np.uint64)
    a, b = order[min(fewer, n - 1) : n], np.sort(order)[:]
    a, b = np.sort(a), np.sort(b)
    same = len(np.intersect1d(a, b))
    starts = jaccard_join.size_ranges(similar)
    meet = set(jaccard_join.block_keys(a, similar, starts).tolist()) & set(jaccard_join.block_keys(b, similar, starts).tolist())
    if same * similar[1] >= similar[0] * (len(a) + len(b) - same):
        assert meet


@pytest.mark.parametrize("limit", [None, 1, 3])
def test_substrings(spark, monkeypatch, limit):
    if limit:
        monkeypatch.setattr(substring_dedup, "hot_limit", lambda n: limit)
        monkeypatch.setattr(substring_dedup, "WINDOWS_AT_ONCE", 50)
    rows = corpus()
    split = {i: (t or "").encode().split() for i, t in rows}
    first = {}
    for i, w in split.items():
        if i is not None:
            for a in range(len(w) - 12):
                key = tuple(w[a : a + 13])
                first[key] = min(first.get(key, i), i)
    want = {}
    for i, w in split.items():
        keep = [True] * len(w)
        for a in range(len(w) - 12):
            if i is not None and first[tuple(w[a : a + 13])] < i:
                keep[a : a + 13] = [False] * 13
        want[i] = b" ".join(x for x, k in zip(w, keep, strict=True) if k)
    docs = frame(spark, rows).selectExpr("*", "1 as _key", "2 as _ranges", "3 as _rid", "4 as _row")
    marked = substring_dedup.marked_documents(docs).selectExpr("_row.doc_id", "_ranges").collect()
    got = {r.doc_id: b" ".join(split[r.doc_id] if r._ranges is None else substring_dedup.kept_words(split[r.doc_id], r._ranges)) for r in marked}
    assert got == want and len(marked) == len(rows)
    cleaned = substring_dedup.substring_dedup(docs)
    assert cleaned.columns == docs.columns
    left = {r.doc_id: r.text for r in cleaned.collect()}
    for i, t in rows:
        if want[i] == b" ".join(split[i]):
            assert left[i] == t
        else:
            assert left.get(i, "").encode() == want[i]


def test_texts_travel_once_and_unsorted(spark, monkeypatch):
    docs = frame(spark, corpus())
    want = sorted(map(tuple, substring_dedup.substring_dedup(docs).collect()), key=repr)
    monkeypatch.setattr(substring_dedup.BitFilter, "mark", lambda self, rows, key: rows.withColumn("_maybe", key.isNotNull()))
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cleaned = substring_dedup.substring_dedup(docs)
        plan = cleaned._jdf.queryExecution().sparkPlan().toString()
        assert sorted(map(tuple, cleaned.collect()), key=repr) == want
        assert "text" not in substring_dedup.marked_documents(docs).schema["_row"].dataType.names
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
    assert plan.count("SortMergeJoin") == 0 and plan.count("ShuffledHashJoin") == 1


def test_workers_drop_what_others_cached():
    common.worker_cache("words", lambda: 1)
    batches = lambda b: iter([*b, dict(common._CACHE)])
    assert list(common.lean(batches, "words")([0])) == [0, {"words": 1}]
    assert list(common.lean(batches)([0])) == [0, {}]
    assert common.worker_cache("words", lambda: 2) == 2 and common.worker_cache("other", lambda: 3) == 3 and list(common._CACHE) == ["other"]
    common._CACHE.clear()


def test_windows_of_one_word_over_and_over():
    import numpy as np
    import pandas as pd

    rng = random.Random(2)
    words = [rng.choice([b"a", b"b"]) for _ in range(400)]
    ranks = substring_dedup.window_ranks(words, 13)
    spelled = [tuple(words[i : i + 13]) for i in range(388)]
    assert all((ranks[i] == ranks[j]) == (spelled[i] == spelled[j]) for i in range(388) for j in range(i))
    rows = pd.DataFrame({"_id": [4, 3, 4], "_key": [40, 30, 41], "mini": [7, 7, 7], "at": [5, 0, 9], "packed": [b" ".join([b"x"] * 300_000), b" ".join([b"x"] * 13), b" ".join([b"y"] * 13)], "end": [-1, -1, -1]})
    assert substring_dedup._judge(rows, 13).to_numpy().tolist() == [[4, 40, 5, 300_005]]
    assert np.unique(substring_dedup.window_ranks([b"x"] * 300_000, 13)).size == 1


def test_texts_are_hashed_together_not_one_by_one():
    import sys

    import pandas as pd

    rng = random.Random(4)
    known = ["".join(rng.choices("abcdefghijklmnop", k=rng.randrange(2, 10))) for _ in range(5000)]
    rows = pd.DataFrame({"_text": [" ".join(rng.choices(known, k=50)) for _ in range(1500)]})
    calls = []
    sys.setprofile(lambda frame, event, arg: calls.append(event) if event in ("call", "c_call") else None)
    try:
        found = list(substring_dedup._minimisers(iter([rows])))
    finally:
        sys.setprofile(None)
    assert sum(map(len, found)) >= len(rows)
    assert len(calls) < 20 * len(rows), len(calls) / len(rows)


def test_run_of_words():
    import numpy as np

    rng = random.Random(6)
    for _ in range(60):
        texts = [b"".join(rng.choice([b"", b" ", b"a", b"b\x1f", "é".encode(), b"w" * 70_000 if i == 9 else b"c"]) + rng.choice([b" ", b"\t\n", b"\x0b "]) for i in range(rng.randrange(40))) for _ in range(rng.randrange(5))]
        texts = [t.strip() if rng.random() < 0.5 else t for t in texts]
        split = [t.split() for t in texts]
        words = [w for part in split for w in part]
        run = substring_dedup.WordRun(texts)
        assert run.spelled(np.arange(len(words)), 1) == words and np.diff(run.bounds).tolist() == [len(w) for w in split]
        windows = [(i, a) for i, w in enumerate(split) for a in range(len(w) - 12)]
        assert [(run.text[a], a - run.bounds[run.text[a]]) for a in run.windows(13)] == windows
        spelled = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
        by_hash = dict(zip(run.hashes(3).tolist(), spelled, strict=True))
        assert [by_hash[h] for h in run.hashes(3).tolist()] == spelled and len(by_hash) == len(set(spelled))
        minis, first, size = substring_dedup.super_kmers(run)
        assert substring_dedup._each(first, size).tolist() == run.windows(13).tolist() and len(minis) == len(first)


@pytest.mark.parametrize("kind", [int, str])
def test_windows_are_told_by_their_words_not_by_hashes(monkeypatch, kind):
    import numpy as np
    import pandas as pd

    rng = random.Random(9)
    passage = [rng.choice(WORDS) for _ in range(40)]
    rows = []
    for i in range(200):
        a = rng.randrange(25)
        words = passage[a : a + rng.randrange(13, 30)] if i % 3 else [rng.choice(WORDS[:2]) for _ in range(rng.randrange(13, 25))]
        rows.append((kind(rng.randrange(10, 99)), i, 7, 100 * i, " ".join(words if len(words) > 12 else passage).encode(), -1))
    rows.append((kind(50), 500, 8, 3, b"alone", -1))
    rows.append((kind(51), 501, 9, 4, None, 17))
    least, want = {}, {(501, 4 + j) for j in range(13)}
    windows = [(i, key, at + a, tuple(w[a : a + 13])) for i, key, mini, at, p, _ in rows if mini == 7 for w in [p.split()] for a in range(len(w) - 12)]
    for i, _, _, w in windows:
        least[w] = min(least.get(w, i), i)
    for i, key, at, w in windows:
        want |= {(key, at + j) for j in range(13)} if least[w] < i else set()
    frame_ = pd.DataFrame(rows, columns=["_id", "_key", "mini", "at", "packed", "end"])
    for hashes in (substring_dedup.WordRun.hashes, lambda run, m: np.zeros(max(len(run.starts) - m + 1, 0), np.uint64)):
        monkeypatch.setattr(substring_dedup.WordRun, "hashes", hashes)
        got = substring_dedup._judge(frame_, 13)
        assert {(key, p) for key, first, end in got[["_key", "first", "end"]].itertuples(index=False, name=None) for p in range(first, end)} == want


def test_embeddings(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    base = rng.normal(size=(6, 16))
    rows = [(i, (base[i % 6] + rng.normal(size=16) * rng.choice([0.0, 0.05, 0.2, 0.6])).tolist(), i % 2) for i in range(240)]
    rows += [(300, [0.0] * 16, 1), (301, None, 1), (302, [float("nan")] * 16, 1), (303, [1.0] * 16, None), (304, [1.0, None] + [0.0] * 14, 1), (305, [], 0), (None, [1.0] * 16, 1), (306, [3.0], 0), (307, [5.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in embedding_dedup.embedding_links(df).collect()}
    assert len(got) == len(rows)
    good = {i: (np.array(v) / np.linalg.norm(v), lab) for i, v, lab in rows if i is not None and i < 300}
    linked = {(a, b) for a in good for b in good if a < b and good[a][1] == good[b][1] and good[a][0] @ good[b][0] >= 0.93}
    found = sum(r.n_links for i, r in got.items() if i is not None and i < 300) / 2
    assert found <= len(linked) and found >= 0.9 * len(linked) > 0
    want = components(linked | {(306, 307)}, [i for i in got if i is not None])
    assert sum(want[i] != r.component_id for i, r in got.items() if i is not None) <= 0.1 * len(rows)
    assert got[306].n_links == 1 and got[301].n_links == 0 and got[303].component_id == 303 and got[None].n_links == 0


def test_embeddings_across_borders(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(embedding_dedup, "LIST_SIZE", 6)
    rng = np.random.default_rng(8)
    # a hot cluster that varies in three of 32 dimensions, dealt to many lists
    v = np.concatenate([np.ones((1200, 1)), rng.normal(size=(1200, 3)) * 0.25, np.zeros((1200, 28))], axis=1) @ np.linalg.qr(rng.normal(size=(32, 32)))[0]
    got = {r.vec_id: r.n_links for r in embedding_dedup.embedding_links(spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int")).collect()}
    u = v / np.linalg.norm(v, axis=1)[:, None]
    want = (u @ u.T >= 0.93).sum(1) - 1
    assert want.sum() > 100_000 and [got[i] for i in range(len(v))] == want.tolist()


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.exact_duplicates(docs).count() == 0
    assert jaccard_join.ngram_components(docs).count() == 0
    assert substring_dedup.marked_documents(docs).count() == 0
    assert embedding_dedup.embedding_links(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
