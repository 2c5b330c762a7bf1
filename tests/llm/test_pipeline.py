"""The corpus pipeline, stage by stage against brute force and as a whole, with odd rows and clashing columns."""

import random
import re

import corpus_pipeline
import pytest

WORDS = [a + b for a in "ba ko ri tu ne".split() for b in "la mo si dun".split()]
#: Names that the operators use themselves.
EXTRA = "_pred _score _digest _key _ranges _row _gone _maybe _first _p0 _hot offset score n key id".split()


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def grams(text, k=5):
    w = [x.lower() for x in words_of(text)]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def rows_of(seed=5):
    rng = random.Random(seed)
    some = lambda k: " ".join(rng.choice(WORDS) for _ in range(k))
    base, passage = some(150), some(60)
    near = base.split()
    near[70] = "edit"
    rows = [(1, base), (2, base), (2, some(40)), (3, " ".join(near)), (4, base.replace(" ", "  ")), (5, None), (6, ""), (7, "123 !?"), (8, some(30) + " " + passage + " " + some(30)), (9, some(25) + " " + passage), (9, some(25) + " " + passage), (10, "one"), (None, some(20)), (11, passage), (12, some(6000))]
    return [(i, t, None if t and len(t) % 3 == 0 else "xx") for i, t in rows] + [(100 + i, some(rng.randint(1, 40)), "xx") for i in range(10)]


def frame(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    return docs.selectExpr("doc_id", "text", "lang", "'s' as source", "cast(length(text) as long) as n_chars", *[f"'{c}' as `{c}`" for c in EXTRA], "1 as `a.b`")


def test_stages(spark, tmp_path):
    docs = frame(spark, rows_of())
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        out = stage(spark, docs, str(tmp_path))
        path = f"{tmp_path}/{i}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        if name == "best_fit_packing":
            assert sorted({r.doc_id for r in docs.collect()}, key=repr) == sorted({i for i, _ in before}, key=repr) and docs.groupBy("sequence_id").agg({"length": "sum"}).filter("`sum(length)` > 4096").count() == 0
            break
        assert docs.columns == columns and docs.filter(" and ".join(f"`{c}` = '{c}'" for c in EXTRA) + " and source = 's' and `a.b` = 1").count() == docs.count()
        after = sorted(((r.doc_id, r.text) for r in docs.collect()), key=repr)
        if name == "language_id":
            want = [(i, t) for i, t in before if any(c.isalpha() for c in t or "")]
            assert docs.filter("lang is null").count() == 0
        elif name == "exact_dedup":
            groups = {}
            for i, t in before:
                groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), []).append((i is None, i, t))
            want = [(g[0][1], None) for g in map(sorted, groups.values())]
            after = [(i, None) for i, _ in after]
        elif name == "ngram_jaccard":
            want, left = [], sorted(before, key=lambda r: (r[0] is None, r))
            for r in left:  # the groups here are cliques
                if r[0] is None or not any(k[0] is not None and 100 * len(grams(k[1]) & grams(r[1])) >= 80 * len(grams(k[1]) | grams(r[1])) for k in want):
                    want.append(r)
            assert len(want) < len(before) and (3, dict(before).get(3)) not in want
        else:
            first = {}
            for i, t in before:
                for a in range(len(words_of(t)) - 12) if i is not None else ():
                    key = tuple(words_of(t)[a : a + 13])
                    first[key] = min(first.get(key, i), i)
            want = []
            for i, t in before:
                w = words_of(t)
                gone = {a + j for a in range(len(w) - 12) if i is not None and first[tuple(w[a : a + 13])] < i for j in range(13)}
                if not gone:
                    want.append((i, t))
                elif len(gone) < len(w):
                    want.append((i, " ".join(x for k, x in enumerate(w) if k not in gone)))
            assert docs.filter("n_chars <> length(text)").count() == 0
        assert sorted(after, key=repr) == sorted(want, key=repr), name


@pytest.mark.parametrize("kind", ["empty", "run"])
def test_whole(spark, tmp_path, kind):
    rows = rows_of() if kind == "run" else []
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert bool(found) == bool(rows) and {r.doc_id for r in found} <= {i for i, _, _ in rows}


def test_without_languages(spark):
    rows = [(1, "clean text", None), (2, "漢字", None), (3, None, None), (4, "123 !", None), (5, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(map(tuple, corpus_pipeline.identify_language(spark, docs, "").collect())) == rows[:2]
