"""Exact substring dedup by super-k-mer partitioning.

A window is K consecutive words. Its minimiser is the smallest hash of the M-word pieces in it; consecutive windows
that share one form a super-k-mer. Windows with equal words have the same minimiser, so a window can only repeat
where its minimiser does: a first pass counts minimisers, and super-k-mers of those seen once stay at home. The
others travel, each as one string of words, to the bucket of their minimiser, where their windows are sorted and
the smallest doc_id of each is found. Super-k-mers of minimisers that very many share are cut into single windows,
which are counted where they are and summed by key. Of windows that are very frequent themselves the smallest
doc_id is known by then, so they are judged at home; the others travel one by one, each to the bucket of its own
hash. A window that also starts in a document with a smaller doc_id marks its words; marked words are removed
when all windows have been judged. Only documents with marked words meet their marks in a shuffle; the others, told
by a filter, pass straight through. Texts are cut and hashed many at a time, as one run of words.

Defined cases: a null text has no words. A document with a null doc_id is kept whole and removes nothing. Rows that
repeat a doc_id don't remove each other's words. A text of fewer than K words is kept whole. Texts may be of any
length; one word over and over makes one long super-k-mer, whose windows are never all written out at once. An
empty table gives no rows. Other columns, whatever their names, are carried along untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lucidgraph.llm.common import BitFilter, bits_at, collected_bits, column, counted, discard, filter_bits, hot_limit, lean, small_batches, staged, table, text_udf, whole_groups, whole_row

#: Words in a window and in the pieces whose smallest hash is its minimiser.
K, M = 13, 5
#: Words kept with their hashes in each Python worker; super-k-mers in a bucket.
CACHE_WORDS, BUCKET = 400_000, 60_000
#: Documents, and windows, that a worker writes out at once.
DOCS_AT_ONCE, WINDOWS_AT_ONCE = 1000, 200_000
#: Bytes of texts, rows of a bucket and bytes of sums that a worker treats at once.
TEXT_AT_ONCE, ROWS_AT_ONCE, BYTES_AT_ONCE = 1 << 21, 10_000, 1 << 16
_ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * _ODD[1]
    x = (x ^ x >> np.uint64(29)) * _ODD[2]
    return x ^ x >> np.uint64(32)


_SPACE = 32
_BLANKS = bytes(_SPACE if 9 <= x <= 13 else x for x in range(256))
#: A number for each byte; powers of an odd number, and of its inverse, to the 64 bits that are kept.
_BYTES = _mixed(np.arange(1, 257, dtype=np.uint64) * _ODD[0])
_POWERS, _INVERSES = (np.cumprod(np.array([1] + [x] * (BYTES_AT_ONCE - 1), np.uint64)) for x in (int(_ODD[4]), pow(int(_ODD[4]), -1, 2**64)))
_FULL = pow(int(_ODD[4]), BYTES_AT_ONCE, 2**64)
_FULL_INVERSE = pow(_FULL, -1, 2**64)


class WordHashes(dict):
    """64-bit hashes of words, within a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_HASHES = WordHashes()


def piece_hashes(words: np.ndarray, m: int = M) -> np.ndarray:
    """A well mixed hash of each m consecutive words."""
    n = len(words) - m + 1
    out = np.zeros(n, np.uint64)
    for j in range(m):
        out = (out + words[j : j + n]) * _ODD[j % len(_ODD)]
        out ^= out >> np.uint64(31)
    out *= _ODD[1]
    return out ^ out >> np.uint64(29)


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have < width:
        step = min(have, width - have)
        a, have = np.minimum(a[: len(a) - step], a[step:]), have + step
    return a


class WordRun:
    """The words of many texts in one run of bytes, one space behind each word, and what hashes of consecutive words take.

    A hash is a polynomial over the bytes, so that of any words is a difference of two sums. Equal words have equal
    hashes; others may too.
    """

    def __init__(self, texts: list[bytes]):
        data = (b" ".join([*texts, b""]) or b" ").translate(_BLANKS)
        raw = np.frombuffer(data, np.uint8)
        inside = raw != _SPACE
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            edges = np.concatenate([[0], edges])
        starts, ends = edges[::2], edges[1::2]
        size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        #: Number of the first word of each text, and of all words.
        self.bounds = np.searchsorted(starts, np.concatenate([[0], np.cumsum(size)]))
        lengths = ends - starts
        if len(raw) != lengths.sum() + len(lengths):
            inside[1:] |= inside[:-1]
            raw = raw[inside]
            data = raw.tobytes()
            ends = np.cumsum(lengths + 1) - 1
            starts = ends - lengths
        self.data, self.starts, self.ends = data, starts, ends
        self.text = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(self.bounds))
        self._sums(raw)

    def _sums(self, raw: np.ndarray) -> None:
        """Sums before and after each word, and the inverse of the power of its first byte."""
        n = len(self.starts)
        self.before, self.after, self.inverse = np.empty(n, np.uint64), np.empty(n, np.uint64), np.empty(n, np.uint64)
        sums, power, inverse = np.zeros(BYTES_AT_ONCE + 1, np.uint64), 1, 1
        for lo in range(0, len(raw), BYTES_AT_ONCE):
            part = raw[lo : lo + BYTES_AT_ONCE]
            sums[0] = sums[-1]
            np.cumsum(_BYTES[part] * _POWERS[: len(part)] * np.uint64(power), out=sums[1 : len(part) + 1])
            sums[1 : len(part) + 1] += sums[0]
            s, e = (slice(*np.searchsorted(at, [lo, lo + len(part)])) for at in (self.starts, self.ends))
            self.before[s] = sums[self.starts[s] - lo]
            self.after[e] = sums[self.ends[e] - lo]
            self.inverse[s] = _INVERSES[self.starts[s] - lo] * np.uint64(inverse)
            power, inverse = power * _FULL % 2**64, inverse * _FULL_INVERSE % 2**64

    def hashes(self, m: int) -> np.ndarray:
        """A well mixed hash of each m consecutive words, also of different texts."""
        n = max(len(self.starts) - m + 1, 0)
        return _mixed((self.after[m - 1 : m - 1 + n] - self.before[:n]) * self.inverse[:n])

    def windows(self, k: int) -> np.ndarray:
        """First words of the windows of k words that lie in one text."""
        n = max(len(self.starts) - k + 1, 0)
        return np.flatnonzero(self.text[:n] == self.text[k - 1 : k - 1 + n])

    def spelled(self, first, width) -> list[bytes]:
        """The words from each first one on, width of them, with spaces between them."""
        return [self.data[a:b] for a, b in zip(self.starts[first].tolist(), self.ends[first + width - 1].tolist(), strict=True)]


def super_kmers(run: WordRun, k: int = K, m: int = M) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimiser, first window and number of windows of each super-k-mer."""
    at = run.windows(k)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    smallest = sliding_min(run.hashes(m), k - m + 1)[at]
    text = run.text[at]
    first = np.flatnonzero(np.concatenate([[True], (smallest[1:] != smallest[:-1]) | (text[1:] != text[:-1])]))
    return smallest[first], at[first], np.diff(np.append(first, len(at)))


def _words(text) -> list[bytes]:
    return text.encode().split() if isinstance(text, str) else []


def _runs(rows: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, WordRun]]:
    """rows with a _text in parts of DOCS_AT_ONCE at most, each of little more than TEXT_AT_ONCE bytes, or of one text."""
    begin, size, texts = 0, 0, []
    for i, text in enumerate(rows["_text"]):
        texts.append(text.encode())
        size += len(texts[-1])
        if size >= TEXT_AT_ONCE or len(texts) == DOCS_AT_ONCE or i == len(rows) - 1:
            run = WordRun(texts)
            begin, size, part, texts = i + 1, 0, rows.iloc[begin : i + 1], []
            yield part, run


@lean
def _minimisers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for _, run in _runs(b):
            yield pd.DataFrame({"mini": super_kmers(run)[0].view(np.int64)})


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are known; known: sorted."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _each(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All numbers from each first one on, size of them."""
    return np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)


def _parts(a: np.ndarray) -> Iterator[np.ndarray]:
    return (a[i : i + WINDOWS_AT_ONCE] for i in range(0, len(a), WINDOWS_AT_ONCE))


def _ranges(starts: np.ndarray, owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Words covered by windows that start there, in order, as ranges, each of one owner: begins and ends."""
    new = (starts[1:] > starts[:-1] + width) | (owner[1:] != owner[:-1])
    outer = np.ones(min(len(starts), 1), bool)
    return starts[np.concatenate([outer, new])], starts[np.concatenate([new, outer])] + width


def window_ranks(words: list[bytes], k: int) -> np.ndarray:
    """A number for each k consecutive words, equal where the words are: ranks of 1, 2, 4 ... words are paired and
    sorted, so that no window is written out."""
    known: dict[bytes, int] = {}
    rank = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    have = 1
    while have < k:
        step = min(have, k - have)
        pair = rank[: len(rank) - step] * (rank.max() + 1) + rank[step:]
        rank = np.unique(pair, return_inverse=True)[1]
        have += step
    return rank


def _equal_windows(run: WordRun, starts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the windows that start there in which equal ones are neighbours, and the first of each sort. What
    hashes say is compared word by word; should they deceive, ranks decide."""
    rank = run.hashes(k)[starts]
    order = np.argsort(rank)
    new = np.diff(rank[order], prepend=0) != 0
    new[0] = True
    again = np.flatnonzero(~new)
    if any(run.spelled(starts[order[part]], k) != run.spelled(starts[order[part - 1]], k) for part in _parts(again)):
        rank = window_ranks(run.data.split(), k)[starts]
        order = np.argsort(rank)
        new = np.diff(rank[order], prepend=-1) != 0
    return order, np.flatnonzero(new)


def _judge(rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """rows: whole minimiser groups of _id, _key, at, packed. Ranges of words that a smaller id has too.

    Rows with an end are ranges already.
    """
    ready = rows[rows["end"] >= 0][["_id", "_key", "at", "end"]].rename(columns={"at": "first"})
    rows = rows[rows["end"] < 0]
    minis = rows["mini"].to_numpy()
    again = minis[1:] == minis[:-1]
    rows = rows[np.append(again, False) | np.append(False, again)] if len(rows) else rows  # a minimiser alone came by chance of the filter
    if not len(rows):
        return ready
    ids = rows["_id"].to_numpy()
    # rows that are spelled alike are judged together: by the smallest id that each of their windows has anywhere
    code, spelled = pd.factorize(rows["packed"])
    order = np.argsort(code, kind="stable")
    least = np.minimum.reduceat(ids[order], np.flatnonzero(np.diff(code[order], prepend=-1)))
    run = WordRun(list(spelled))
    starts = run.windows(k)
    text = run.text[starts]
    order, first = _equal_windows(run, starts, k)
    least = np.minimum.reduceat(least[text[order]], first)
    least_of = np.empty(len(starts), least.dtype)
    least_of[order] = np.repeat(least, np.diff(np.append(first, len(order))))
    begin = np.flatnonzero(np.diff(text, prepend=-1))
    n = np.diff(np.append(begin, len(text)))
    whole = ids > np.maximum.reduceat(least_of, begin)[code]
    some = np.flatnonzero(~whole & (ids > np.minimum.reduceat(least_of, begin)[code]))
    if whole.any():
        full = rows.loc[whole, ["_id", "_key", "at"]].rename(columns={"at": "first"})
        full["end"] = full["first"] + n[code[whole]] + k - 1
        ready = pd.concat([full, ready], ignore_index=True) if len(ready) else full
    sizes = n[code[some]]
    owner = np.repeat(some, sizes)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    marked = ids[owner] > least_of[begin[code[owner]] + place]
    owner, place = owner[marked], place[marked]
    if not len(owner):
        return ready
    cut = np.append(True, (owner[1:] != owner[:-1]) | (place[1:] > place[:-1] + k))
    begin, end = np.flatnonzero(cut), np.append(np.flatnonzero(cut)[1:], len(owner)) - 1
    at = rows["at"].to_numpy()[owner[begin]]
    found = pd.DataFrame({"_id": ids[owner[begin]], "_key": rows["_key"].to_numpy()[owner[begin]], "first": at + place[begin], "end": at + place[end] + k})
    return pd.concat([found, ready], ignore_index=True) if len(ready) else found


def repeated_ranges(docs: DataFrame, k: int = K) -> DataFrame:
    """docs: _id, _key, _text. Rows _id, _key, first, end: ranges of words to remove; they may overlap."""
    spark = docs.sparkSession
    kind = docs.schema["_id"].dataType.simpleString()
    usable = docs.filter("_id is not null and _text is not null")
    counts = usable.select("_text").mapInPandas(_minimisers, "mini long").groupBy("mini").agg(F.count("*").alias("n"))
    repeated = staged(counts.filter("n > 1"), "minimisers")
    n, kinds = repeated.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    bits = filter_bits(kinds)
    shared = spark.sparkContext.broadcast(collected_bits(repeated.select(F.col("mini").bitwiseAND(bits - 1).alias("cell")), bits))
    hot = [r[0] for r in repeated.filter(F.col("n") > hot_limit(n)).select("mini").collect()]  # fewer than MAX_HOT
    shared_hot = spark.sparkContext.broadcast(np.sort(np.array(hot, dtype=np.int64)))

    @lean
    def count_windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Windows of hot minimisers: how many, and the smallest id, of those read together."""
        heavy, seen = shared_hot.value, {}
        for b in batches:
            for part, run in _runs(b):
                minis, first, size = super_kmers(run, k)
                hot = _among(minis.view(np.int64), heavy)
                docs = part["_id"].tolist()
                for at in _parts(_each(first[hot], size[hot])):
                    for i, window in zip(run.text[at].tolist(), map(xxhash.xxh3_128_digest, run.spelled(at, k)), strict=True):
                        had = seen.get(window)
                        seen[window] = (1, docs[i]) if had is None else (had[0] + 1, min(had[1], docs[i]))
                    if len(seen) > WINDOWS_AT_ONCE:
                        yield window_rows(seen, b)
                        seen.clear()
        if seen:
            yield window_rows(seen, b)

    def window_rows(seen: dict, b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"window": list(seen), "n": [c for c, _ in seen.values()], "least": pd.Series([i for _, i in seen.values()], dtype=b["_id"].dtype)})

    judged = {}
    if hot:
        windows = usable.select("_id", "_text").mapInPandas(count_windows, f"window binary, n long, least {kind}")
        windows = staged(windows.groupBy("window").agg(F.sum("n").alias("n"), F.min("least").alias("least")), "windows")
        limit = hot_limit(windows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
        judged = {bytes(r[0]): r[1] for r in windows.filter(F.col("n") > limit).select("window", "least").collect()}  # fewer than MAX_HOT
    shared_judged = spark.sparkContext.broadcast(judged)

    @lean
    def travel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, heavy, least = shared.value, shared_hot.value, shared_judged.value
        for b in batches:
            for part, run in _runs(b):
                minis, first, size = super_kmers(run, k)
                goes = bits_at(seen, (minis & np.uint64(bits - 1)).astype(np.int64))
                minis, first, size = minis[goes].view(np.int64), first[goes], size[goes]
                single = _among(minis, heavy)
                alone = _each(first[single], size[single])
                minis, first, size = minis[~single], first[~single], size[~single] + k - 1
                yield placed(part, run, first, {"mini": minis, "packed": run.spelled(first, size), "end": -1})
                docs = part["_id"].tolist()
                for at in _parts(alone):
                    windows, text = run.spelled(at, k), run.text[at]
                    digests = [xxhash.xxh3_128_digest(w) for w in windows]
                    judged = np.fromiter(map(least.__contains__, digests), bool, len(at))
                    moves = np.flatnonzero(~judged)
                    yield placed(part, run, at[moves], {"mini": [int.from_bytes(digests[i][:8], "little", signed=True) for i in moves], "packed": [windows[i] for i in moves], "end": -1})
                    marked = np.array([i for i in np.flatnonzero(judged).tolist() if least[digests[i]] < docs[text[i]]], np.int64)
                    first, end = _ranges(at[marked], text[marked], k)
                    yield placed(part, run, first, {"mini": part["_key"].to_numpy()[run.text[first]], "packed": None, "end": end - run.bounds[run.text[first]]})

    def placed(part: pd.DataFrame, run: WordRun, first: np.ndarray, more: dict) -> pd.DataFrame:
        text = run.text[first]
        out = pd.DataFrame({"_id": part["_id"].array[text], "_key": part["_key"].to_numpy()[text], "at": first - run.bounds[text]}).assign(**more)
        return out.astype({"mini": np.int64, "end": np.int64, "packed": object})[["_id", "_key", "mini", "at", "packed", "end"]]

    moved = usable.mapInPandas(travel, f"_id {kind}, _key long, mini long, at long, packed binary, end long")
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // BUCKET))

    @lean
    def bucket(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[pd.DataFrame] = []
        for b in whole_groups(batches, "mini"):
            waiting.append(b)
            if sum(map(len, waiting)) >= ROWS_AT_ONCE:
                yield _judge(pd.concat(waiting, ignore_index=True), k)
                waiting.clear()
        if waiting:
            yield _judge(pd.concat(waiting, ignore_index=True), k)

    return moved.repartition(buckets, "mini").sortWithinPartitions("mini").mapInPandas(bucket, f"_id {kind}, _key long, first long, end long")


def _marked(docs: DataFrame, id_col: str, text_col: str, k: int) -> tuple[DataFrame, DataFrame]:
    """docs as _row, which is without the text, with _text and _ranges: the ranges of words to remove, or null. Those
    that surely have none, and all others.

    The join builds a table of the ranges of each partition; texts are neither sorted nor held, and travel once.
    """
    small_batches(docs.sparkSession)
    keyed = docs.select(whole_row(docs, text_col).alias("_row"), column(id_col).alias("_id"), F.xxhash64(column(id_col), column(text_col)).alias("_key"), column(text_col).alias("_text"))
    found = repeated_ranges(keyed.select("_id", "_key", "_text"), k)
    ranges = found.groupBy("_id", "_key").agg(F.collect_list(F.struct("first", "end")).alias("_ranges")).withColumnsRenamed({"_id": "_rid", "_key": "_rkey"})
    ranges, n = counted(ranges, "ranges")
    marked = BitFilter(ranges.select(F.col("_rkey").alias("key")), n).mark(keyed, F.col("_key"))
    joined = marked.filter("_maybe").join(ranges.hint("shuffle_hash"), (F.col("_id") == F.col("_rid")) & (F.col("_key") == F.col("_rkey")), "left")
    rest = marked.filter("not _maybe").withColumn("_ranges", F.lit(None).cast(ranges.schema["_ranges"].dataType))
    return rest.select("_row", "_text", "_ranges"), joined.select("_row", "_text", "_ranges")


def marked_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """All docs as _row, _text and _ranges."""
    rest, joined = _marked(docs, id_col, text_col, k)
    return rest.unionByName(joined)


def kept_words(words: list[bytes], ranges) -> list[bytes]:
    keep = np.ones(len(words), bool)
    for r in ranges:
        keep[r["first"] : r["end"]] = False
    return [words[i] for i in np.flatnonzero(keep).tolist()]


def _left_text(text: pd.Series, ranges: pd.Series) -> pd.Series:
    return pd.Series([t if r is None else b" ".join(kept_words(_words(t), r)).decode() for t, r in zip(text, ranges, strict=True)], dtype=object)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """docs with what is left of each text. Texts without a removed word are untouched, the words of others are
    joined by one space; documents of which nothing is left are dropped."""
    rest, joined = _marked(docs, id_col, text_col, k)
    left = joined.select("_row", F.col("_ranges").isNull().alias("_whole"), text_udf(_left_text, "string")("_text", "_ranges").alias("_text"))
    whole = rest.select("_row", "_text").unionByName(left.filter("_whole or _text <> ''").select("_row", "_text"))
    return whole.select(*[F.col("_text").alias(c) if c == text_col else F.col("_row").getField(c).alias(c) for c in docs.columns])


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n, removed, kept = [], [], []
            for text, ranges in zip(b["text"], b["_ranges"], strict=True):
                words = _words(text)
                left = words if ranges is None else kept_words(words, ranges)
                n.append(len(words))
                removed.append(len(words) - len(left))
                kept.append(hashlib.sha256(b" ".join(left)).hexdigest())
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_words": n, "n_removed": removed, "kept_sha256": kept})

    marked = marked_documents(docs).select(F.col("_row.doc_id").alias("doc_id"), F.col("_text").alias("text"), "_ranges")
    return marked.mapInPandas(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


OP8_SQL = r"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS win FROM words, unnest(generate_series(1, len(w) - 12)) AS g(i)
), firsts AS (SELECT win, min(doc_id) AS least FROM windows GROUP BY win HAVING count(*) > 1),
dup AS (SELECT doc_id, i FROM windows JOIN firsts USING (win) WHERE least < doc_id),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM dup, unnest(generate_series(0, 12)) AS g(j)),
left_over AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n
  FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM words) ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM words LEFT JOIN left_over USING (doc_id)
"""
