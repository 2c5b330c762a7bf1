"""Language identification by prediction by partial matching (PPM).

Each language has a tree of byte contexts of up to ORDER bytes with the counts of the byte that follows. A context
codes a byte that it has seen by n / (N + D), N being its total and D its number of different bytes; otherwise it
escapes with D / (N + D) to the next shorter context, where the bytes already excluded don't count; the empty
context escapes to all 256 bytes alike. The statistics are frozen after training, so that a text's code length
under each language is a sum over its bytes; contexts and lengths are tabulated once, for each language those
contexts that it has seen. The language with the shortest code is predicted; the score is its posterior under equal
priors.

Training reads about TRAIN_DOCS documents of each language, chosen by a hash of the id; each is read as a whole, in
lower case, and so is each text that is scored.

Defined cases: a text that is null or has no letter is "und" with score 0, as is every text where nothing could be
learned. Rows without id, text or language aren't learned from. A null id is not held out. Of languages with codes of
equal length the first by name is predicted. Texts may be of any length: they are scored SEGMENT bytes at a time. Rows
that repeat are scored one by one; an empty table gives no rows. Other columns, whatever their names, are carried along
untouched, but for those whose names the results take.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lucidgraph.llm.common import column, lean, small_batches, table, text_udf, whole_row

#: Longest context in bytes; documents learned from for each language.
ORDER, TRAIN_DOCS = 3, 2500
#: A context of 1, 2 or 3 bytes is kept if a language has seen it so often.
LEAST_SEEN = (1, 6, 12)
#: Bytes scored at once.
SEGMENT = 1 << 19
_START = b"\n" * ORDER


def fold_of(id_col: str) -> Column:
    """Remainder by 5 of the CRC-32 of the id as text; fold 0 is held out."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5


def prepared(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass")


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _grams(data: bytes) -> np.ndarray:
    """Each byte with the three before it, as one number."""
    a = np.frombuffer(_START + data, dtype=np.uint8).astype(np.uint32)
    return a[:-3] << 24 | a[1:-2] << 16 | a[2:-1] << 8 | a[3:]


def count_grams(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """lang, gram, seen: over whole texts."""

    @lean
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lang, texts in b.groupby("lang", sort=False)["text"]:
                # a few texts at a time, so that memory is bounded by the longest
                found: dict[str, list[np.ndarray]] = {"gram": [], "seen": []}
                part, size = [], 0
                for i, t in enumerate(texts):
                    part.append(_grams(prepared(t)))
                    size += len(part[-1])
                    if size > 1 << 20 or i == len(texts) - 1:
                        gram, seen = np.unique(np.concatenate(part), return_counts=True)
                        found["gram"].append(gram)
                        found["seen"].append(seen)
                        part, size = [], 0
                yield pd.DataFrame({"lang": lang, "gram": np.concatenate(found["gram"]).astype(np.int64), "seen": np.concatenate(found["seen"]).astype(np.int64)})

    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInPandas(run, "lang string, gram long, seen long")
    return rows.groupBy("lang", "gram").agg(F.sum("seen").alias("seen"))


@dataclass
class PpmModel:
    """langs; symbol of each byte; context of three symbols; for each language the row of each context, and code length
    in bits by row * symbols + symbol. Contexts that a language hasn't seen have the row of the next shorter one."""

    langs: list[str]
    symbol: np.ndarray
    n_symbols: int
    context: np.ndarray
    rows: list[np.ndarray]
    lengths: list[np.ndarray]

    @property
    def bits(self) -> np.ndarray:
        """Code lengths in full, by context * symbols + symbol and language; large where there are many languages."""
        full = [lengths.reshape(-1, self.n_symbols)[rows].ravel() for rows, lengths in zip(self.rows, self.lengths, strict=True)]
        return np.stack(full, axis=1)

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Exact code length in bits of each text under each language."""
        out = np.zeros((len(texts), len(self.langs)))
        part, owner, size = [], [], 0
        for i, t in enumerate(texts):
            for start in range(0, len(t), SEGMENT):
                before = t[start - ORDER : start] if start else _START
                part.append(before + t[start : start + SEGMENT])
                owner.append(i)
                size += len(part[-1])
                if size >= SEGMENT:
                    self._add(part, owner, out)
                    part, owner, size = [], [], 0
        if part:
            self._add(part, owner, out)
        return out

    def _add(self, parts: list[bytes], owner: list[int], out: np.ndarray) -> None:
        s = self.symbol[np.frombuffer(b"".join(parts), dtype=np.uint8)]
        n = self.n_symbols
        context, byte = self.context[(s[:-3] * n + s[1:-2]) * n + s[2:-1]], s[3:]
        lengths = np.array([len(p) for p in parts])
        starts = np.cumsum(lengths) - lengths
        # bytes before a part's own belong to none: their sums go to places that are not read
        edges = np.empty(2 * len(parts), dtype=np.int64)
        edges[0::2], edges[1::2] = starts, starts + lengths - ORDER
        edges = np.minimum(edges, len(byte))
        for j, (rows, lengths) in enumerate(zip(self.rows, self.lengths, strict=True)):
            own = np.append(lengths[rows[context] * n + byte], np.float32(0))
            np.add.at(out[:, j], owner, np.add.reduceat(own, edges, dtype=np.float64)[0::2])


def fit_tables(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> PpmModel:
    """counts: for each language the four-byte grams (three of context) and how often each was seen."""
    langs = sorted(counts)
    used = np.zeros(256, dtype=bool)
    used[_START[0]] = True
    for gram, _ in counts.values():
        used[np.unique(gram & 255)] = True
    known = np.flatnonzero(used)
    n = len(known) + 1  # the last symbol is any other byte
    symbol = np.full(256, n - 1, dtype=np.int64)
    symbol[known] = np.arange(len(known))
    bytes_of = np.append(np.ones(n - 1), 256 - len(known))  # that a symbol stands for

    grams = {}
    for lang in langs:
        gram, seen = counts[lang]
        parts = [symbol[gram >> shift & 255] for shift in (24, 16, 8, 0)]
        grams[lang] = (parts, seen.astype(np.float64))

    def context_of(parts: list[np.ndarray], order: int) -> np.ndarray:
        out = np.zeros(len(parts[0]), dtype=np.int64)
        for p in parts[3 - order : 3]:
            out = out * n + p
        return out

    kept: list[np.ndarray] = [np.zeros(1, dtype=np.int64)]  # contexts of each order, in order
    for order in range(1, ORDER + 1):
        weight = np.zeros(n**order)
        for parts, seen in grams.values():
            own = np.bincount(context_of(parts, order), weights=seen, minlength=n**order)
            np.maximum(weight, np.where(own >= LEAST_SEEN[order - 1], own, 0), out=weight)
        found = np.flatnonzero(weight)
        if order > 1:  # a context stands only below its own shorter one
            found = found[np.isin(found % n ** (order - 1), kept[-1])]
        kept.append(found)

    first = np.cumsum([0] + [len(k) for k in kept])
    all_rows, all_lengths = [], []
    for lang in langs:
        parts, seen = grams[lang]
        rows, lengths, n_rows = np.zeros(first[-1], dtype=np.int64), [], 0
        below = np.full((1, n), 1 / 256)  # probabilities in the next shorter contexts that this language has seen
        shorter = np.zeros(1, dtype=np.int64)
        for order in range(ORDER + 1):
            contexts = kept[order]
            ctx = context_of(parts, order)
            place = np.searchsorted(contexts, ctx)
            ok = (place < len(contexts)) & (contexts[np.minimum(place, len(contexts) - 1)] == ctx) if len(contexts) else np.zeros(len(ctx), bool)
            mine, place = np.unique(place[ok], return_inverse=True)
            table_ = np.bincount(place * n + parts[3][ok], weights=seen[ok], minlength=len(mine) * n).reshape(len(mine), n)
            if order:
                # what has seen a context has seen its shorter one too
                low = below[np.searchsorted(shorter, contexts[mine] % n ** (order - 1))]
                rows[first[order] : first[order + 1]] = rows[first[order - 1] + np.searchsorted(kept[order - 1], contexts % n ** (order - 1))]
            else:
                low = below
            rows[first[order] + mine] = n_rows + np.arange(len(mine))
            n_rows += len(mine)
            total = table_.sum(axis=1, keepdims=True)
            kinds = (table_ > 0).sum(axis=1, keepdims=True)
            rest = np.where(table_ > 0, 0, low)
            left = np.maximum(rest @ bytes_of, 1e-12)[:, None] if order else np.maximum(1 - (kinds / 256), 1e-12)
            prob = np.where(table_ > 0, table_ / (total + kinds), rest / left * (kinds / (total + kinds)))
            lengths.append(-np.log2(np.maximum(prob, 1e-12)).astype(np.float32).ravel())
            below, shorter = prob, contexts[mine]
        all_rows.append(rows.astype(np.int32))
        all_lengths.append(np.concatenate(lengths))

    context = np.zeros(n**3, dtype=np.int64)
    whole = np.arange(n**3)
    for order in range(1, ORDER + 1):
        if len(kept[order]):
            ctx = whole % n**order
            place = np.minimum(np.searchsorted(kept[order], ctx), len(kept[order]) - 1)
            context = np.where(kept[order][place] == ctx, first[order] + place, context)
    return PpmModel(langs, symbol, n, context.astype(np.int32), all_rows, all_lengths)


def fit_language_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS) -> PpmModel | None:
    """Learns from the folds that are not held out; None where there is nothing to learn from."""
    small_batches(docs.sparkSession)
    named = docs.select(column(id_col).alias("id"), column(lang_col).alias("lang"), column(text_col).alias("text"))
    usable = named.filter((fold_of("id") != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = usable.groupBy("lang").agg(F.count("*").alias("size"))  # one row a language
    chance = F.pmod(F.xxhash64(F.col("id"), F.lit(77)), F.lit(1_000_000).cast("long")) / 1_000_000
    sample = usable.join(F.broadcast(sizes), "lang").filter(chance < F.lit(train_docs) / F.col("size"))
    got = count_grams(sample, "text", "lang").toArrow().to_pandas()
    counts = {lang: (part["gram"].to_numpy(), part["seen"].to_numpy()) for lang, part in got.groupby("lang")}
    return fit_tables(counts) if counts else None


def identify(model: PpmModel | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    langs, scores = ["und"] * len(texts), [0.0] * len(texts)
    fit = [i for i, t in enumerate(texts) if has_letter(t)] if model else []
    if fit:
        bits = model.code_lengths([prepared(texts[i]) for i in fit])
        best = bits.argmin(axis=1)
        odds = np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000)).sum(axis=1)
        for i, b, o in zip(fit, best, odds, strict=True):
            langs[i], scores[i] = model.langs[b], float(1 / o)
    return langs, scores


def predict_languages(docs: DataFrame, model: PpmModel | None, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score", keep_text: bool = True) -> DataFrame:
    """docs with two more columns, with or without the text."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def found(texts: pd.Series) -> pd.DataFrame:
        langs, scores = identify(shared.value, [t if isinstance(t, str) else None for t in texts])
        return pd.DataFrame({"lang": langs, "score": scores})

    kept = [c for c in docs.columns if c not in (pred_col, score_col) and (keep_text or c != text_col)]
    rows = docs.select(whole_row(docs.select(*map(column, kept))).alias("_row"), text_udf(found, "lang string, score double")(column(text_col)).alias("_found"))
    return rows.select(*[F.col("_row").getField(c).alias(c) for c in kept], F.col("_found.lang").alias(pred_col), F.col("_found.score").alias(score_col))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_language_model(docs)
    held = F.coalesce(fold_of("doc_id") == 0, F.lit(False)).alias("held_out")
    return predict_languages(docs.select("doc_id", held, "text"), model, keep_text=False)
