"""Similarity join of documents on sets of word n-grams, by signature trees.

A document's set holds the hashes of its distinct n-grams. Sets that are equal form a class, found by digest first;
one row stands for each. Of a pair that reaches the threshold the first n-gram that both have, in the order of
rising frequency, lies so early in both that enough can follow it; so classes meet in the blocks of these n-grams,
one block for each range of sizes of the larger set. In a block a signature tree (nodes hold the OR of token bitmaps,
size ranges and how far bits fall short of sizes) is traversed against itself; node pairs whose largest possible
overlap is too small are pruned. What is left joins classes to candidate groups. Then each whole set travels once to
its group, where a second traversal decides pairs exactly and skips those already joined.

Only blocks of n-grams with different classes are formed, and of blocks of two only those whose sizes and places
allow the threshold. Very frequent n-grams come last in the order, so they
reach a prefix only in documents made of little else; blocks that are too large nonetheless join all their
classes to one candidate group. Large groups are cut into chunks: each is compared with itself and the first;
classes that aren't joined to the group's main part after that are compared with all chunks. No pair of
different parts goes unseen, no pair within a part is looked at twice, and no pairs are written out.

Defined cases: null texts and texts without words have an empty set, which links with nothing. Texts with fewer words
than n have one n-gram, the whole sequence. A row with a null id links with nothing. Equal rows link. Rows that repeat
an id count one by one, each by its own text; what a text is joined to doesn't depend on what else has its id. Texts
may be of any length. An empty table gives no rows. Other columns, whatever their names, take no part.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lucidgraph.llm.common import BitFilter, attach_groups, bit_cell, bits_at, collected_bits, column, discard, filter_bits, hot_limit, lean, small_batches, staged, table, whole_groups, whole_row
from lucidgraph.llm.components import connected_components
from lucidgraph.llm.substring_dedup import _HASHES, piece_hashes

#: Words in an n-gram, and the least similarity as a fraction.
N, SIMILAR = 3, (90, 100)
#: Frequent n-grams are those in more than one of FREQUENT n-gram occurrences; so there are fewer than FREQUENT.
FREQUENT = 1_000_000
#: Documents in a leaf and nodes in a node of a tree; bits of a token bitmap at least and at most.
LEAF, FANOUT, BITS = 16, 8, (64, 65536)
#: Documents and n-grams of a group that one task holds in a chunk.
CHUNK_DOCS, CHUNK_GRAMS = 400, 1_500_000
#: N-grams counted at once by a worker.
GRAMS_AT_ONCE = 1_000_000
_SPREAD = np.uint64(0xD6E8FEB86659FD93)


def gram_set(text, n: int) -> np.ndarray:
    """Sorted hashes of the distinct n-grams."""
    words = text.encode().lower().split() if isinstance(text, str) else []
    if not words:
        return np.zeros(0, np.uint64)
    hashes = _HASHES.of(words)
    if len(words) < n:
        return piece_hashes(hashes, len(words)) ^ np.uint64(len(words))
    return np.unique(piece_hashes(hashes, n))


def bitmap_width(size: int) -> int:
    return min(BITS[1], max(BITS[0], 1 << (size - 1).bit_length()))


def bitmap_of(grams: np.ndarray, width: int) -> int:
    bits = np.zeros(width, np.uint8)
    bits[(grams & np.uint64(width - 1)).astype(np.int64)] = 1
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def folded(bitmap: int, width: int, to: int) -> int:
    while width > to:
        width //= 2
        bitmap = (bitmap >> width) | (bitmap & ((1 << width) - 1))
    return bitmap


def prefix_length(size: int, similar: tuple[int, int]) -> int:
    num, den = similar
    return size - -(-size * num // den) + 1


def size_ranges(similar: tuple[int, int]) -> list[int]:
    """Where ranges of sizes start: a set's similar ones that are larger lie in its own range or the next."""
    num, den = similar
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, -(-out[-1] * den // num)))
    return out


def block_keys(ordered: np.ndarray, similar: tuple[int, int], starts: list[int]) -> np.ndarray:
    """Keys of the blocks that a set meets others in, given its n-grams in the common order.

    The first keys are for its own range of sizes, from place 0 on, the others for the next range, from place 0 on:
    there it is the smaller one, so less of it is needed.
    """
    num, den = similar
    n = len(ordered)
    k = bisect_right(starts, n) - 1
    least = -(-num * (n + starts[k + 1]) // (num + den))  # overlap with a set of the next range
    parts = [(k, ordered[: prefix_length(n, similar)]), (k + 1, ordered[: max(0, n - least + 1)])]
    mixed = [(grams ^ np.uint64((r * 0x9E3779B97F4A7C15) & (1 << 64) - 1)) * _SPREAD for r, grams in parts]
    keys = np.concatenate(mixed)
    return keys ^ keys >> np.uint64(32)


class SignatureTree:
    """A tree over documents given by sizes and bitmaps of one width; dual traversal finds pairs that may be similar."""

    def __init__(self, sizes: list[int], bitmaps: list[int], similar: tuple[int, int]):
        self.sizes, self.bitmaps = sizes, bitmaps
        self.num, self.den = similar
        order = sorted(range(len(sizes)), key=lambda i: (sizes[i], bitmaps[i]))
        # node: OR of bitmaps, least size, largest size, largest size minus bits, children, leaf?
        level = [self._node(order[i : i + LEAF], True) for i in range(0, len(order), LEAF)]
        while len(level) > 1:
            level = [self._node(level[i : i + FANOUT], False) for i in range(0, len(level), FANOUT)]
        self.root = level[0]

    def _node(self, children: list, leaf: bool) -> tuple:
        if leaf:
            parts = [(self.bitmaps[i], self.sizes[i], self.sizes[i], self.sizes[i] - self.bitmaps[i].bit_count()) for i in children]
        else:
            parts = [c[:4] for c in children]
        bits = 0
        for p in parts:
            bits |= p[0]
        return bits, min(p[1] for p in parts), max(p[2] for p in parts), max(p[3] for p in parts), children, leaf

    def _may(self, a: tuple, b: tuple) -> bool:
        if a[2] * self.den < b[1] * self.num or b[2] * self.den < a[1] * self.num:
            return False
        overlap = (a[0] & b[0]).bit_count() + min(a[3], b[3])
        return overlap * (self.num + self.den) >= self.num * (a[1] + b[1])

    def may_link(self, i: int, j: int) -> bool:
        """Whether the bitmaps of two documents allow the threshold."""
        m, n, x, y = self.sizes[i], self.sizes[j], self.bitmaps[i], self.bitmaps[j]
        if m * self.den < n * self.num or n * self.den < m * self.num:
            return False
        both = x & y
        overlap = min(m - x.bit_count(), n - y.bit_count()) + both.bit_count()
        return overlap * (self.num + self.den) >= self.num * (m + n)

    def pairs(self) -> Iterator[tuple[int, int]]:
        stack = [(self.root, self.root)]
        while stack:
            a, b = stack.pop()
            if a is not b and not self._may(a, b):
                continue
            if a[5] and b[5]:
                for x, i in enumerate(a[4]):
                    for j in a[4][x + 1 :] if a is b else b[4]:
                        yield (i, j)
            elif a is b:
                stack += [(a[4][x], c) for x in range(len(a[4])) for c in a[4][x:]]
            elif b[5] or not a[5] and len(a[4]) >= len(b[4]):
                stack += [(c, b) for c in a[4]]
            else:
                stack += [(a, c) for c in b[4]]


class Joined:
    """Union-find over places; the least place is the root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common elements of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def link_sets(sets: list[np.ndarray], similar: tuple[int, int], joined: Joined, wanted=None) -> None:
    """Joins all similar pairs of the sets exactly; wanted(i, j) may leave out pairs."""
    num, den = similar
    sizes = [len(s) for s in sets]
    width = bitmap_width(2 * max(sizes))
    tree = SignatureTree(sizes, [bitmap_of(s, width) for s in sets], similar)
    for i, j in tree.pairs():
        if (wanted is None or wanted(i, j)) and joined.find(i) != joined.find(j) and tree.may_link(i, j):
            same = overlap(sets[i], sets[j])
            if den * same >= num * (sizes[i] + sizes[j] - same):
                joined.join(i, j)


def _bounds(keys: np.ndarray) -> list[tuple[int, int]]:
    cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])).tolist()
    return list(zip(cut, [*cut[1:], len(keys)], strict=True))


def _sketches(docs: DataFrame, n: int, similar: tuple[int, int]) -> DataFrame:
    """id, key, n, digest, bitmap, keys, take of each row of docs (_id, _key, _text) that has a set; take of the keys
    are for the set's own range of sizes."""
    spark, kind = docs.sparkSession, docs.schema["_id"].dataType.simpleString()

    @lean
    def often(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """N-grams that occur in several documents read together; and, as n-gram null, all occurrences."""
        for b in batches:
            total, part, size = 0, [], 0
            for i, t in enumerate(b["_text"]):
                part.append(gram_set(t, n))
                size += len(part[-1])
                if size > GRAMS_AT_ONCE or i == len(b) - 1:
                    gram, seen = np.unique(np.concatenate(part), return_counts=True)
                    yield pd.DataFrame({"gram": pd.array(gram[seen > 2].view(np.int64), dtype="Int64"), "seen": seen[seen > 2]})
                    total, part, size = total + size, [], 0
            yield pd.DataFrame({"gram": pd.array([None], dtype="Int64"), "seen": [total]})

    seen = staged(docs.select("_text").mapInPandas(often, "gram long, seen long").groupBy("gram").agg(F.sum("seen").alias("seen")), "often")
    total = seen.filter("gram is null").agg(F.coalesce(F.sum("seen"), F.lit(0))).first()[0]
    frequent = seen.filter("gram is not null").filter(F.col("seen") > max(8, total // FREQUENT)).toArrow().to_pandas()  # fewer than FREQUENT
    discard(seen)
    grams = frequent["gram"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(grams)
    shared = spark.sparkContext.broadcast((grams[order], frequent["seen"].to_numpy(np.int64)[order]))
    starts = size_ranges(similar)

    @lean
    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, counts = shared.value
        for b in batches:
            rows = []
            for doc, key, t in zip(b["_id"], b["_key"], b["_text"], strict=True):
                s = gram_set(t, n)
                if not len(s):
                    continue
                ordered = s
                if len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    ordered = s[np.argsort(np.where(known[at] == s, counts[at], 0), kind="stable")]
                width = bitmap_width(len(s))
                keys = block_keys(ordered, similar, starts).view(np.int64)
                rows.append((doc, key, len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), bitmap_of(s, width).to_bytes(width // 8, "little"), keys, prefix_length(len(s), similar)))
            yield pd.DataFrame(rows, columns=["id", "key", "n", "digest", "bitmap", "keys", "take"]).astype({"id": b["_id"].dtype})

    return docs.mapInPandas(sketch, f"id {kind}, key long, n long, digest binary, bitmap binary, keys array<long>, take long")


def _join_block(own: list[int], others: list[int] | None, width: int, sizes, bitmaps, widths, similar, place, joined: Joined) -> None:
    """Joins the places of documents that may be similar: own with own, or own with others."""
    docs = own if others is None else own + others
    if len(docs) < 2:
        return
    tree = SignatureTree([sizes[i] for i in docs], [folded(bitmaps[i], widths[i], width) for i in docs], similar)
    for i, j in tree.pairs():
        if others is not None and (i < len(own)) == (j < len(own)):
            continue
        x, y = place[docs[i]], place[docs[j]]
        if joined.find(x) != joined.find(y) and tree.may_link(i, j):
            joined.join(x, y)


def _candidate_edges(reps: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """Edges a, b that join the numbers of all classes which may be similar. reps: cid, n, bitmap, keys, take."""
    spark = reps.sparkSession
    num, den = (F.lit(x).cast("long") for x in similar)
    mark = F.bit_xor(F.xxhash64("cid", F.lit(5))).alias("mark")
    tokens = reps.select("cid", "n", "take", F.posexplode("keys").alias("at", "token"))
    tokens = tokens.select("cid", "token", (F.shiftleft("n", 24) + F.least(F.when(F.col("at") < F.col("take"), F.col("at")).otherwise(F.col("at") - F.col("take")), F.lit((1 << 24) - 1))).alias("place"))
    blocks = tokens.groupBy("token").agg(F.count("*").alias("docs"), mark, F.min("place").alias("low"), F.max("place").alias("high"))
    # Two sets of sizes too different, or whose common n-gram comes too late, aren't similar by it; such blocks, mere
    # coincidences, would be most of all.
    size = {p: F.shiftright(p, 24) for p in ("low", "high")}
    after = [size[p] - F.col(p).bitwiseAND((1 << 24) - 1) for p in ("low", "high")]
    may = (size["low"] * den >= size["high"] * num) & (F.least(*after) * (num + den) >= num * (size["low"] + size["high"]))
    counted = staged(blocks.filter("docs > 1").filter((F.col("docs") > 2) | may), "tokens")
    # Of n-grams that the same classes share one is enough.
    blocks = staged(counted.groupBy("docs", "mark").agg(F.min("token").alias("token")), "blocks")
    discard(counted)
    n, kinds = blocks.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.count("*")).first()
    bits = filter_bits(kinds)
    big = blocks.filter(F.col("docs") > hot_limit(n)).select("token")  # fewer than MAX_HOT
    hubs_of = {r[0]: r[1] for r in tokens.join(F.broadcast(big), "token").groupBy("token").agg(F.min("cid")).collect()} if big.limit(1).count() else {}
    shared = spark.sparkContext.broadcast((collected_bits(blocks.select(bit_cell(F.col("token"), bits, 3).alias("cell")), bits), hubs_of))

    @lean
    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filter_, hubs = shared.value
        for b in batches:
            rows = []
            for doc, size, bitmap, keys, cells in zip(b["cid"], b["n"], b["bitmap"], b["keys"], b["cells"], strict=True):
                for token in np.asarray(keys)[bits_at(filter_, np.asarray(cells))].tolist():
                    rows.append((token, doc, size, None, hubs[token]) if token in hubs else (token, doc, size, bitmap, None))
            yield pd.DataFrame(rows, columns=["token", "cid", "n", "bitmap", "hub"]).astype({"token": np.int64, "cid": np.int64, "n": np.int64})

    @lean
    def block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in whole_groups(batches, "token"):
            ids, place = np.unique(b["cid"].to_numpy(), return_inverse=True)
            joined, place = Joined(len(ids)), place.tolist()
            sizes = b["n"].tolist()
            bitmaps = [int.from_bytes(x, "little") for x in b["bitmap"]]
            widths = [8 * len(x) for x in b["bitmap"]]
            for start, end in _bounds(b["token"].to_numpy()):
                by_width: dict[int, list[int]] = {}
                for i in range(start, end):
                    by_width.setdefault(widths[i], []).append(i)
                # Similar sizes have widths that are equal or near, and a pair is compared at the smaller.
                for w, own in by_width.items():
                    _join_block(own, None, w, sizes, bitmaps, widths, similar, place, joined)
                    for other in by_width:
                        if w < other <= 2 * w * similar[1] / similar[0]:
                            _join_block(own, by_width[other], w, sizes, bitmaps, widths, similar, place, joined)
            roots = np.array([joined.find(i) for i in range(len(ids))], dtype=np.int64)
            moved = roots != np.arange(len(ids))
            yield pd.DataFrame({"a": ids[moved], "b": ids[roots[moved]]})

    cells = F.transform("keys", lambda t: bit_cell(t, bits, 3)).alias("cells")
    dealt = reps.select("cid", "n", "bitmap", "keys", cells).mapInPandas(deal, "token long, cid long, n long, bitmap binary, hub long")
    if hubs_of:
        dealt = staged(dealt, "dealt")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = dealt.filter("bitmap is not null").drop("hub").repartition(max(parts, -(-n // 100_000)), "token").sortWithinPartitions("token").mapInPandas(block, "a long, b long")
    if hubs_of:
        found = found.unionByName(dealt.filter("hub is not null and cid <> hub").select(F.col("cid").alias("a"), F.col("hub").alias("b")))
    return found


def _verify(rows: DataFrame, similar: tuple[int, int], parts: int) -> DataFrame:
    """rows: key, cid, grams, label, stray. Edges of similar classes within a key; equal labels are joined already.
    Where a key has strays, only pairs with one are looked at."""

    @lean
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in whole_groups(batches, "key"):
            b = b.drop_duplicates(["key", "cid"])
            a_ids, b_ids = [], []
            ids, labels, stray = b["cid"].to_numpy(), b["label"].to_numpy(), b["stray"].to_numpy()
            for start, end in _bounds(b["key"].to_numpy()):
                if end - start < 2:
                    continue
                sets = [np.frombuffer(g, np.uint64) for g in b["grams"].iloc[start:end]]
                joined = Joined(end - start)
                first: dict = {}
                for i, label in enumerate(labels[start:end].tolist()):
                    joined.join(first.setdefault(label, i), i)
                odd = stray[start:end].tolist()
                link_sets(sets, similar, joined, (lambda i, j, odd=odd: odd[i] or odd[j]) if any(odd) else None)
                for i in range(end - start):
                    if (r := joined.find(i)) != i:
                        a_ids.append(ids[start + i])
                        b_ids.append(ids[start + r])
            yield pd.DataFrame({"a": np.array(a_ids, np.int64), "b": np.array(b_ids, np.int64)})

    return rows.repartition(parts, "key").sortWithinPartitions("key").mapInPandas(run, "a long, b long")


def _whole_sets(source: DataFrame, placed: DataFrame, n: int, n_placed: int) -> DataFrame:
    """placed with grams, the whole set of each class, read from one of its texts again; a filter tells which."""
    bits = filter_bits(n_placed)
    shared = source.sparkSession.sparkContext.broadcast(collected_bits(placed.select(bit_cell(F.col("key"), bits, 9).alias("cell")), bits))

    @lean
    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b[bits_at(shared.value, b["_cell"].to_numpy())]
            grams = [gram_set(t, n).tobytes() for t in b["_text"]]
            yield pd.DataFrame({"digest": [hashlib.blake2b(g, digest_size=16).digest() for g in grams], "grams": grams})

    read = source.select("_text", bit_cell(F.col("_key"), bits, 9).alias("_cell")).mapInPandas(sets, "digest binary, grams binary")
    # rows that repeat come as often; they meet after a partial aggregate
    return read.filter(F.length("grams") > 0).groupBy("digest").agg(F.first("grams").alias("grams")).join(placed, "digest").drop("digest")


def _linked(classes: DataFrame, source: DataFrame, n: int, similar: tuple[int, int]) -> DataFrame:
    """node, component: numbers of classes that are joined by links to one of a smaller number."""
    parts = int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = connected_components(_candidate_edges(classes, similar))  # node, component
    roots = groups.select(F.col("component").alias("cid"), F.col("component").alias("grp")).distinct()
    members = roots.unionByName(groups.select(F.col("node").alias("cid"), F.col("component").alias("grp")))
    members = staged(members.join(classes.select("cid", "n", "digest", F.col("first.key").alias("key")), "cid"), "members")
    n_members = members.count()
    weights = staged(members.groupBy("grp").agg(F.count("*").alias("size"), F.greatest(F.ceil(F.count("*") / CHUNK_DOCS), F.ceil(F.sum("n") / CHUNK_GRAMS)).cast("int").alias("chunks")), "weights")
    placed = staged(attach_groups(members, weights, "grp", "size", n_members).withColumn("chunk", F.pmod(F.xxhash64("cid", F.lit(1)), F.col("chunks").cast("long")).cast("int")), "placed")
    discard(members, weights)
    dealt = _whole_sets(source, placed.select("cid", "digest", "key", "grp", "chunks", "chunk"), n, n_members)
    large = placed.filter("chunks > 1").limit(1).count() > 0
    if large:
        dealt = staged(dealt, "sets")
    key = lambda *c: F.xxhash64("grp", *c).alias("key")
    tasks = F.when(F.col("chunk") == 0, F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array("chunk"))
    first = dealt.select("*", F.explode(tasks).alias("task")).select(key("task"), "cid", "grams", F.col("cid").alias("label"), F.lit(False).alias("stray"))
    edges = staged(_verify(first, similar, max(parts, -(-n_members // 5000))), "links")
    if large:
        now = connected_components(edges).withColumnRenamed("node", "cid")
        labelled = placed.filter("chunks > 1").join(now, "cid", "left").select("cid", "grp", "chunks", "chunk", F.coalesce("component", "cid").alias("label"))
        labelled = staged(labelled, "labelled")
        sizes = labelled.groupBy("grp", "label").agg(F.count("*").alias("size"))
        main = staged(sizes.groupBy("grp").agg(F.max_by("label", F.struct("size", "label")).alias("main"), F.sum("size").alias("size"), F.count("*").alias("labels")).filter("labels > 1"), "main")
        n_large = labelled.count()
        open_ = attach_groups(labelled, main, "grp", "size", n_large).withColumn("stray", F.col("label") != F.col("main"))
        strays = open_.filter("stray").groupBy("grp").agg(F.ceil(F.count("*") / CHUNK_DOCS).cast("int").alias("stray_chunks"), F.count("*").alias("_n"))
        open_ = staged(attach_groups(open_.drop("labels", "size", "main"), staged(strays, "strays"), "grp", "_n", n_large), "open")
        rows = open_.join(dealt.select("cid", "grams"), "cid").withColumn("stray_chunk", F.pmod(F.xxhash64("cid", F.lit(2)), F.col("stray_chunks").cast("long")).cast("int"))
        every = rows.withColumn("c", F.col("chunk")).withColumn("s", F.explode(F.sequence(F.lit(0), F.col("stray_chunks") - 1))).withColumn("stray", F.lit(False))
        odd = rows.filter("stray").withColumn("s", F.col("stray_chunk")).withColumn("c", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        # A stray may come twice to a task, as one of all and as a stray; the stray comes first.
        both = odd.unionByName(every).select(key("c", "s"), "cid", "grams", "label", "stray")
        both = both.groupBy("key", "cid").agg(F.first("grams").alias("grams"), F.first("label").alias("label"), F.max("stray").alias("stray"))
        edges = edges.unionByName(_verify(both, similar, max(parts, -(-n_large // 5000))))
    return connected_components(edges)


def _components(source: DataFrame, n: int, similar: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """source: _id, _key, _text, ids not null. Rows that have a set: id, key, n, digest; and of each class its digest,
    copies, component_id and the row that stays of its component: keep."""
    sketches = staged(_sketches(source, n, similar), "sketches")
    classes = sketches.groupBy("digest").agg(F.min(F.struct("id", "key")).alias("first"), F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("n", "bitmap", "keys", "take")])
    classes = staged(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    rows = staged(sketches.select("id", "key", "n", "digest"), "rows")
    discard(sketches)
    found = _linked(classes, source, n, similar).withColumnRenamed("node", "cid")
    joined = staged(classes.select("digest", "cid", "copies", "first").join(found, "cid", "left").withColumn("component", F.coalesce("component", "cid")), "joined")
    keep = staged(joined.groupBy("component").agg(F.min(F.struct("first.id", "digest", "first.key")).alias("keep"), F.count("*").alias("_classes")), "keep")
    summary = attach_groups(joined.select("digest", "copies", "component"), keep, "component", "_classes", joined.count())
    return rows, staged(summary.select("digest", "copies", F.col("keep.id").alias("component_id"), "keep"), "summary")


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_id, _key (of id and text), _text"""
    return docs.select(column(id_col).alias("_id"), F.xxhash64(column(id_col), column(text_col)).alias("_key"), column(text_col).alias("_text"))


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """One row a document: id, n_shingles, component_id."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    source = _source(docs, id_col, text_col)
    sketches, summary = _components(source.filter("_id is not null"), n, similar)
    out = attach_groups(sketches.select("id", "n", "digest"), summary.drop("keep"), "digest", "copies", sketches.count())
    linked = out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")

    empty = source.filter("_id is null or _text is null or not rlike(_text, '[^\\\\x20\\\\x09-\\\\x0D]')")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"_id": b["_id"], "n": [len(gram_set(t, n)) for t in b["_text"]]})

    rest = empty.select("_id", "_text").mapInPandas(count, f"_id {kind}, n long").select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.col("_id").alias("component_id"))
    return linked.unionByName(rest)


def ngram_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, similar: tuple[int, int] = (80, 100)) -> DataFrame:
    """One document of each component, with its columns: the one of the smallest id, and of several with that id the
    one of the smallest digest and key. Rows that can't be among those that go aren't shuffled."""
    small_batches(docs.sparkSession)
    sketches, summary = _components(_source(docs, id_col, text_col).filter("_id is not null"), n, similar)
    n_docs = sketches.count()
    judged = attach_groups(sketches.select("id", "key", "digest"), summary, "digest", "copies", n_docs)
    stays = (F.col("id") == F.col("keep.id")) & (F.col("key") == F.col("keep.key"))
    gone = staged(judged.filter(~stays).select("id", "key").distinct(), "gone")
    again = staged(sketches.groupBy("id", "key").agg(F.count("*").alias("rows")).filter("rows > 1").select("id", "key"), "again")
    n_again = again.count()
    whole = docs.select(whole_row(docs).alias("_row"), column(id_col).alias("_id"), F.xxhash64(column(id_col), column(text_col)).alias("_key"))
    marked = BitFilter(gone.select("key"), gone.count()).mark(whole, F.col("_key"))
    left = marked.filter("_maybe").drop("_maybe").join(gone, (F.col("_id") == F.col("id")) & (F.col("_key") == F.col("key")), "left_anti")
    kept = marked.filter("not _maybe").drop("_maybe").unionByName(left)
    if n_again:  # rows that are the same document twice
        marked = BitFilter(again.select("key"), n_again).mark(kept, F.col("_key"))
        twice = marked.filter("_maybe").drop("_maybe").join(again, (F.col("_id") == F.col("id")) & (F.col("_key") == F.col("key")), "left")
        once = twice.filter("key is not null").dropDuplicates(["id", "key"])
        kept = marked.filter("not _maybe").drop("_maybe").unionByName(twice.filter("key is null").drop("id", "key")).unionByName(once.drop("id", "key"))
    return kept.select("_row.*")


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(generate_series(1, len(w) - 2), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS s FROM words
), grams AS (SELECT doc_id, unnest(s) AS g FROM sets),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b WHERE 100 * n >= 90 * (len(x.s) + len(y.s) - n)
), reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
comp AS (SELECT a, min(b) AS least FROM reach GROUP BY a)
SELECT doc_id, len(s) AS n_shingles, least(doc_id, coalesce(least, doc_id)) AS component_id FROM sets LEFT JOIN comp ON doc_id = a
"""
