"""Near duplicates among embeddings by product quantisation.

A coarse quantiser, fitted on a bounded sample, deals unit vectors to inverted lists; what the list's centroid
leaves is coded by one of CODES codewords in each subspace. A vector looks for neighbours in its own list and in
each list whose border with its own is within half the distance that the threshold allows. The vectors of a pair
lie on both sides of their lists' border, so one of them at least is as near to it as that, and no pair is lost. In
a list, table-lookup distances from the
exact query to the coded members drop those that are farther than the threshold allows, given the length of what
the code leaves of the member, so that the codes lose no pair; the rest is decided by the exact cosine.

Equal vectors of a label are found by hash first and searched once. Members of a list are dealt into chunks of
CHUNK, so that no task holds a large group. Pairs are counted and joined where they are found, never written out.

Defined cases: rows whose id, label or vector is null, or whose vector is zero or holds a null or a non-finite
component, link with nothing. Vectors of different lengths are compared as if the shorter ended in zeros. Rows that
repeat an id count one by one, each by its own vector. Vectors may be of any length, the same
for a third of all rows or near each other in one list: equal ones are one class, and members and queries of a list
are both cut into chunks. An empty table gives no rows. Other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lucidgraph.llm.common import MAX_HOT, attach_groups, column, counted, small_batches, staged, table
from lucidgraph.llm.components import connected_components

THRESHOLD = 0.93
#: Vectors that the quantisers are fitted on at most; vectors a list should hold; lists at most; codewords a subspace.
SAMPLE, LIST_SIZE, MAX_LISTS, CODES, SUBSPACES = 20_000, 128, 4096, 64, 8
#: Members of a list, and queries, in one task.
CHUNK, QUERIES = 1024, 2048


def probe_margin(threshold: float) -> float:
    """How near a list's border must be for the list to be probed: half the distance of unit vectors at the threshold."""
    return float(np.sqrt(max(0.0, 2 - 2 * threshold))) / 2 + 1e-6


@dataclass
class Quantiser:
    """Coarse centroids and, for each subspace, codewords of residuals."""

    coarse: np.ndarray
    words: np.ndarray

    def places(self, x: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray]:
        """Own list of each vector, and which lists' borders are within the margin."""
        c = self.coarse
        d = (c * c).sum(1) - 2 * x @ c.T
        own = d.argmin(1)
        gap = np.sqrt(np.maximum((c * c).sum(1) + (c * c).sum(1)[own][:, None] - 2 * c[own] @ c.T, 0))
        near = d - d[np.arange(len(x)), own][:, None] <= 2 * margin * gap
        near[np.arange(len(x)), own] = True
        return own, near

    def encode(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and the length of what they leave."""
        parts = self._parts(x - self.coarse[own])
        codes = np.empty((len(x), len(self.words)), np.uint8)
        left = np.zeros(len(x))
        for s, words in enumerate(self.words):
            d = (words * words).sum(1) - 2 * parts[:, s] @ words.T
            codes[:, s] = d.argmin(1)
            left += ((parts[:, s] - words[codes[:, s]]) ** 2).sum(1)
        return codes, np.sqrt(left)

    def tables(self, queries: np.ndarray, list_id: int) -> np.ndarray:
        """Squared distances of each query's residual to each codeword: query, subspace, codeword."""
        parts = self._parts(queries - self.coarse[list_id])
        return ((parts[:, :, None, :] - self.words[None]) ** 2).sum(-1)

    def _parts(self, x: np.ndarray) -> np.ndarray:
        n, width = len(self.words), self.words.shape[2]
        out = np.zeros((len(x), n * width))
        out[:, : x.shape[1]] = x
        return out.reshape(len(x), n, width)


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = np.concatenate([((c * c).sum(1) - 2 * p @ c.T).argmin(1) for p in np.array_split(x, max(1, len(x) // 2048))])
        n = np.bincount(own, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c[n > 0] = total[n > 0] / n[n > 0][:, None]
    return c


def fit_quantiser(sample: np.ndarray, lists: int, subspaces: int = SUBSPACES, codes: int = CODES) -> Quantiser:
    rng = np.random.default_rng(7)
    coarse = _kmeans(sample, min(lists, len(sample)), 8, rng)
    own = np.concatenate([((coarse * coarse).sum(1) - 2 * p @ coarse.T).argmin(1) for p in np.array_split(sample, max(1, len(sample) // 2048))])
    width = -(-sample.shape[1] // subspaces)
    parts = np.zeros((len(sample), subspaces * width))
    parts[:, : sample.shape[1]] = sample - coarse[own]
    parts = parts.reshape(len(sample), subspaces, width)
    words = np.stack([_kmeans(parts[:, s], min(codes, len(sample)), 6, rng) for s in range(subspaces)])
    return Quantiser(coarse, words)


def _unit(raw: list[bytes], dim: int) -> np.ndarray:
    out = np.zeros((len(raw), dim))
    for i, r in enumerate(raw):
        v = np.frombuffer(r, "<f8")
        out[i, : len(v)] = v
    return out / np.linalg.norm(out, axis=1)[:, None]


def _checked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Vectors as bytes of doubles, scaled so that their squares stay finite; null where they link with nothing."""
    for b in batches:
        raw, digest = [], []
        for vec, label in zip(b["_vec"], b["_label"], strict=True):
            v = None if vec is None or label is None else np.array(vec, dtype=np.float64)
            if v is None or not len(v) or not np.isfinite(v).all() or not v.any():
                raw.append(None)
                digest.append(None)
                continue
            v = np.trim_zeros(v, "b") + 0.0  # no negative zeros
            raw.append((v / np.abs(v).max()).tobytes() if not 1e-100 < np.abs(v).max() < 1e100 else v.tobytes())
            digest.append(hashlib.blake2b(raw[-1] + str(label).encode(), digest_size=16).digest())
        yield pd.DataFrame({"_id": b["_id"], "_label": b["_label"], "raw": raw, "digest": digest})


def _compare(quantiser: Quantiser, dim: int, rows: pd.DataFrame, list_id: int, threshold: float) -> pd.DataFrame:
    """rows of one list and chunk: members (role 0) and queries (role 1). Links counted and joined: id, links, root."""
    members, queries = rows[rows["role"] == 0], rows[rows["role"] == 1]
    if not len(members) or not len(queries):
        return pd.DataFrame({"id": [], "links": [], "root": []})
    m_id, q_id = members["id"].to_numpy(), queries["id"].to_numpy()
    m_n, q_n = members["n"].to_numpy(), queries["n"].to_numpy()
    m_vec = _unit(members["raw"].tolist(), dim)
    codes, left = quantiser.encode(m_vec, np.full(len(m_vec), list_id))
    q_list = queries["own"].to_numpy()
    m_probes = [set(p) for p in members["probes"]]
    reach = np.sqrt(max(0.0, 2 - 2 * threshold)) + left + 1e-9
    ids, links, roots = [], [], []
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for at in range(0, len(queries), 256):
        part = slice(at, at + 256)
        q_vec = _unit(queries["raw"].iloc[part].tolist(), dim)
        tables = quantiser.tables(q_vec, list_id)
        near = np.zeros((len(q_vec), len(m_vec)))
        for s in range(codes.shape[1]):
            near += tables[:, s, codes[:, s]]
        qi, mi = np.nonzero(near <= reach**2)
        for cut in range(0, len(qi), 1 << 16):
            a, b = qi[cut : cut + (1 << 16)], mi[cut : cut + (1 << 16)]
            linked = np.einsum("ij,ij->i", q_vec[a], m_vec[b]) >= threshold
            a, b = a[linked] + at, b[linked]
            other = q_id[a] != m_id[b]
            a, b = a[other], b[other]
            same = q_list[a] == list_id
            # Of different lists both may look for the other: then the lower list's query counts.
            once = same | (q_list[a] < list_id) | np.array([q_list[x] not in m_probes[y] for x, y in zip(a, b, strict=True)], dtype=bool)
            a, b, same = a[once], b[once], same[once]
            if not len(a):
                continue
            got = np.bincount(a, weights=m_n[b])
            hit = np.flatnonzero(got)
            ids.append(q_id[hit])
            links.append(got[hit])
            got = np.bincount(b[~same], weights=q_n[a[~same]]) if (~same).any() else np.zeros(0)
            hit = np.flatnonzero(got)
            ids.append(m_id[hit])
            links.append(got[hit])
            for x, y in zip(q_id[a].tolist(), m_id[b].tolist(), strict=True):
                x, y = find(x), find(y)
                if x != y:
                    parent[max(x, y)] = min(x, y)
    if not ids:
        return pd.DataFrame({"id": [], "links": [], "root": []})
    ids, links = np.concatenate(ids), np.concatenate(links).astype(np.int64)
    return pd.DataFrame({"id": ids, "links": links, "root": [find(x) for x in ids.tolist()]})


def embedding_links(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """One row a vector: id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    small_batches(spark)
    kind, label_kind = (vectors.schema[c].dataType.simpleString() for c in (id_col, label_col))
    source = vectors.select(column(id_col).alias("_id"), column(vec_col).alias("_vec"), column(label_col).alias("_label"))
    checked = staged(source.mapInPandas(_checked, f"_id {kind}, _label {label_kind}, raw binary, digest binary"), "vectors")
    valid = checked.filter("digest is not null and _id is not null")
    classes = staged(valid.groupBy("digest").agg(F.min("_id").alias("first"), F.count("*").alias("n"), F.first("raw").alias("raw"), F.first("_label").alias("label")).withColumn("id", F.monotonically_increasing_id()), "classes")
    n_classes, n_rows = classes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    alone = checked.filter("digest is null or _id is null")
    single = lambda df: df.select(F.col("_id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id"), F.lit(True).alias("kept"))
    if not n_classes:
        return single(checked)
    dim = classes.agg(F.max(F.length("raw"))).first()[0] // 8
    chance = F.pmod(F.xxhash64("digest"), F.lit(1 << 30).cast("long")) / (1 << 30)
    sample = classes.filter(chance < SAMPLE / n_classes).select("raw").limit(2 * SAMPLE).toArrow().column("raw").to_pylist()
    if not sample:
        sample = [r["raw"] for r in classes.select("raw").limit(SAMPLE).collect()]
    lists = int(min(MAX_LISTS, max(16, n_classes // LIST_SIZE)))
    shared = spark.sparkContext.broadcast((fit_quantiser(_unit(sample, dim), lists), dim))
    margin = probe_margin(threshold)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        quantiser, dim = shared.value
        for b in batches:
            own, probes = [], []
            for at in range(0, len(b), 1024):
                o, near = quantiser.places(_unit(b["raw"].iloc[at : at + 1024].tolist(), dim), margin)
                own.append(o)
                probes += [np.flatnonzero(row).astype(np.int32) for row in near]
            yield b.drop(columns=["digest", "first"]).assign(own=np.concatenate(own).astype(np.int32), probes=probes)

    placed = staged(classes.mapInPandas(place, f"n long, raw binary, label {label_kind}, id long, own int, probes array<int>"), "placed")
    members = placed.select("*", F.col("own").alias("list"), F.lit(0).alias("role"))
    queries = placed.select("*", F.explode("probes").alias("list"), F.lit(1).alias("role")).withColumn("probes", F.lit(None).cast("array<int>"))
    # Of a list, each chunk of members meets each chunk of queries in a task of its own.
    sizes = placed.select("label", F.col("own").alias("list"), F.lit(1).alias("m"), F.lit(0).alias("q")).unionByName(placed.select("label", F.explode("probes").alias("list"), F.lit(0).alias("m"), F.lit(1).alias("q")))
    sizes = sizes.groupBy("label", "list").agg(F.ceil(F.sum("m") / CHUNK).cast("int").alias("chunks"), F.ceil(F.sum("q") / QUERIES).cast("int").alias("q_chunks"))
    sizes, n_lists = counted(sizes.filter("chunks > 1 or q_chunks > 1").withColumn("place", F.xxhash64("label", "list")).select("place", "chunks", "q_chunks"), "chunks")
    # Few lists are as large as that: at most as many as probes by QUERIES and rows by CHUNK.
    place_of = F.xxhash64("label", "list")
    large = F.broadcast(sizes) if n_lists < MAX_HOT else sizes
    cut = lambda df: df.withColumn("place", place_of).join(large, "place", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1))).withColumn("q_chunks", F.coalesce("q_chunks", F.lit(1))).drop("place")
    one = lambda chunks, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(chunks).cast("long")).cast("int")
    each = lambda chunks: F.explode(F.sequence(F.lit(0), F.col(chunks) - 1))
    members = cut(members).withColumn("chunk", one("chunks", 1)).withColumn("q_chunk", each("q_chunks"))
    queries = cut(queries).withColumn("q_chunk", one("q_chunks", 2)).withColumn("chunk", each("chunks"))
    dealt = members.unionByName(queries).drop("chunks", "q_chunks")

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        quantiser, dim = shared.value
        return _compare(quantiser, dim, rows, int(key[1]), threshold)

    found = staged(dealt.groupBy("label", "list", "chunk", "q_chunk").applyInPandas(compare, "id long, links long, root long"), "links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    parts = connected_components(found.filter("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    joined = classes.select("digest", "first", "id", "n").join(links, "id", "left").join(parts.withColumnRenamed("node", "id"), "id", "left")
    joined = staged(joined.select("digest", "first", "n", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component")), "joined")
    least = staged(joined.groupBy("component").agg(F.min("first").alias("component_id"), F.count("*").alias("_classes")), "least")
    summary = staged(attach_groups(joined, least, "component", "_classes", n_classes).select("digest", "n", "n_links", "component_id"), "summary")
    out = attach_groups(valid.select("_id", "digest"), summary, "digest", "n", n_rows)
    return out.select(F.col("_id").alias(id_col), "n_links", "component_id", (F.col("_id") == F.col("component_id")).alias("kept")).unionByName(single(alone))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(table(spark, sf_dir, "embeddings"))


OP3_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
comp AS (SELECT a, min(b) AS least FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, least(vec_id, coalesce(comp.least, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(comp.least, vec_id)) AS kept
FROM embeddings LEFT JOIN comp ON vec_id = comp.a LEFT JOIN n ON vec_id = n.a
"""
