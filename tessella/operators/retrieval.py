"""Batch retrieval: BM25, parent and child, dense cosine, rank fusion, over many queries in one job."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.text import retrieval_tokens
from tessella.sources.tables import checkpointed

K1, B, RRF = 1.5, 0.75, 60
#: Units of a shard and queries of a block.
SHARD, QUERIES = 20_000, 50_000
_WORD = re.compile("[A-Za-z0-9]+")
#: The blanks stripped from segments.
_BLANKS = " \t\n\x0b\f\r\u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``d``, ``token``, ``tf`` and the length ``dl`` of every document with a token."""
    tokens = docs.select(F.col(key).alias("d"), retrieval_tokens(F.col(text)).alias("tokens")).where(F.size("tokens") > 0)
    return tokens.select("d", F.size("tokens").alias("dl"), F.explode("tokens").alias("token")).groupBy("d", "dl", "token").agg(F.count("*").alias("tf"))


def token_codes(text: str) -> np.ndarray:
    """The retrieval tokens of a text as whole numbers: bigrams packed exactly, words as negative 63-bit hashes."""
    words = [-1 - (xxhash.xxh64_intdigest(w.lower()) >> 1) for w in _WORD.findall(text)]
    segments = [x for x in (s.strip(_BLANKS) for s in _WORD.split(text)) if len(x) > 1]
    codes = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    grams = codes[:-1] << 21 | codes[1:]
    if len(segments) > 1:  # no bigram reaches over a word
        grams = np.delete(grams, np.cumsum([len(x) for x in segments])[:-1] - 1)
    return np.concatenate([np.array(words, np.int64), grams]) if words else grams


_UNIT = "dl int, tokens array<long>, tfs array<int>"


def _counted(texts: list[str]) -> dict[str, list]:
    """Length, distinct tokens and their frequencies of some texts."""
    out: dict[str, list] = {"dl": [], "tokens": [], "tfs": []}
    for t in texts:
        codes = token_codes(t)
        tokens, tfs = np.unique(codes, return_counts=True)
        out["dl"].append(len(codes))
        out["tokens"].append(tokens)
        out["tfs"].append(tfs.astype(np.int32))
    return out


def indexed(docs: DataFrame, key: str, text: str, split: Callable[[str], list[str]] | None = None) -> DataFrame:
    """``d``, ``dl``, ``tokens``, ``tfs`` of every document with a token, or of every piece that ``split`` makes of it.

    Tokens are counted where the text is read, so that what is stored and moved is a
    posting of each distinct token. Written once; all that follows reads this.
    """
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ds, texts = list(b["d"]), list(b["t"])
            if split:
                pairs = [(d, piece) for d, t in zip(ds, texts) for piece in split(t)]
                ds, texts = [d for d, _ in pairs], [p for _, p in pairs]
            out = pd.DataFrame({"d": pd.Series(ds, dtype=b["d"].dtype), **_counted(texts)})
            yield out[out.dl > 0]

    rows = docs.select(F.col(key).alias("d"), F.col(text).alias("t")).where(F.col("t").isNotNull())
    return checkpointed(rows.mapInPandas(run, f"d {kind}, {_UNIT}"))


class Cell:
    """Postings of one shard of units, searched by exact pruning with the greatest part each token can give."""

    def __init__(self, units: pd.DataFrame, wanted: np.ndarray, avgdl: float):
        self.ids, owner = np.unique(units.d.to_numpy(), return_inverse=True)
        order = np.argsort(owner, kind="stable")
        units, owner = units.iloc[order], owner[order]
        self.first = np.searchsorted(owner, np.arange(len(self.ids)))
        self.single = len(self.ids) == len(units)
        sizes = units.tokens.map(len).to_numpy()
        tokens, tfs, rows = np.concatenate(units.tokens.to_numpy()), np.concatenate(units.tfs.to_numpy()).astype(float), np.repeat(np.arange(len(units)), sizes)
        keep = np.isin(tokens, wanted)
        tokens, tfs, rows = tokens[keep], tfs[keep], rows[keep]
        by = np.argsort(tokens, kind="stable")
        self.rows = rows[by]
        dl = units.dl.to_numpy(float)[self.rows]
        self.parts = tfs[by] * (K1 + 1) / (tfs[by] + K1 * (1 - B + B * dl / avgdl))
        self.tokens, self.start = np.unique(tokens[by], return_index=True)
        self.stop = np.append(self.start[1:], len(tokens))
        self.most = np.maximum.reduceat(self.parts, self.start) if len(self.tokens) else np.array([])
        self.scores = np.zeros(len(units))

    def _owners(self, scores: np.ndarray) -> np.ndarray:
        return scores if self.single else np.maximum.reduceat(scores, self.first)

    def best(self, tokens: np.ndarray, idf: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best ids for a query, by score rounded to six digits, then id; an owner of several units stands where its best one does."""
        at = np.searchsorted(self.tokens, tokens)
        ok = at < len(self.tokens)
        ok[ok] = self.tokens[at[ok]] == tokens[ok]
        at, idf = at[ok], idf[ok]
        bound = idf * self.most[at]
        order = np.argsort(-bound, kind="stable")
        at, idf, bound = at[order], idf[order], bound[order]
        rest = np.append(np.cumsum(bound[::-1])[::-1], 0.0)
        s = self.scores
        s[:] = 0.0
        least, candidates = 0.0, None
        for i, (t, w) in enumerate(zip(at, idf)):
            if candidates is None and i and rest[i] < s.max():
                owners = self._owners(s)
                least = np.partition(owners, -k)[-k] if len(owners) >= k else 0.0
                if rest[i] < least - 1e-5:
                    # Units not met so far cannot come among the k best; of those met only some can.
                    candidates = np.flatnonzero(s + rest[i] >= least - 1e-5)
            a, b = self.start[t], self.stop[t]
            if candidates is None:
                s[self.rows[a:b]] += w * self.parts[a:b]
            else:
                own = self.rows[a:b]
                k_at = np.searchsorted(own, candidates)
                k_at[k_at == len(own)] = 0
                hit = own[k_at] == candidates
                s[candidates[hit]] += w * self.parts[a:b][k_at[hit]]
        if candidates is not None:
            kept = np.zeros_like(s)
            kept[candidates] = s[candidates]
            s = kept
        owners = np.round(self._owners(s), 6)
        met = np.flatnonzero(self._owners(s) > 0)
        if len(met) > k:
            edge = np.partition(owners[met], -k)[-k]
            met = met[owners[met] >= edge]
        met = met[np.lexsort((met, -owners[met]))][:k]
        return self.ids[met], owners[met]


def ranked(queries: DataFrame, units: DataFrame, query_key: str, query_text: str, k: int, scope: DataFrame | None = None) -> DataFrame:
    """``q``, ``d``, ``score``, ``rk``: the k best owners of ``units`` for every query by BM25.

    Units lie in shards of ``SHARD`` by owner, queries in blocks of ``QUERIES``; a cell of both
    gives k rows a query, so what is shuffled after scoring never grows with the matches.
    Statistics are of all units, also where ``scope`` (d) narrows what may come out.
    """
    q_kind, d_kind = dict(queries.dtypes)[query_key], dict(units.dtypes)["d"]

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [np.unique(token_codes(t)) for t in b["t"]]
            yield pd.DataFrame({"q": b["q"].repeat([len(x) for x in found]).to_numpy(), "token": np.concatenate(found) if found else []}).astype({"token": "int64"})

    rows = queries.select(F.col(query_key).alias("q"), F.col(query_text).alias("t")).where(F.col("t").isNotNull())
    asked = checkpointed(rows.mapInPandas(ask, f"q {q_kind}, token long").distinct())
    n, avgdl = units.agg(F.count("*"), F.avg("dl")).first()
    df = units.select(F.explode("tokens").alias("token")).join(asked.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("df"))
    idf = df.select("token", F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    if scope is not None:
        units = units.join(scope, "d", "left_semi")
    asked = checkpointed(asked.join(idf, "token").groupBy("q").agg(F.collect_list(F.struct("token", "idf")).alias("x")))
    shards, blocks = max(1, -(-n // SHARD)), max(1, -(-asked.count() // QUERIES))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    slot = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    a = asked.select("q", F.col("x.token").alias("ts"), F.col("x.idf").alias("ws"), slot("q", blocks).alias("block")).withColumn("shard", every(shards))
    u = units.select("d", "dl", "tokens", "tfs", slot("d", shards).alias("shard")).withColumn("block", every(blocks))

    def search(u: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
        qs, ds, scores = [], [], []
        if len(u) and len(a):
            cell = Cell(u, np.unique(np.concatenate(a.ts.to_numpy())), avgdl)
            for q, ts, ws in zip(a.q, a.ts, a.ws):
                found, score = cell.best(np.asarray(ts), np.asarray(ws), k)
                qs += [q] * len(found)
                ds.append(found)
                scores.append(score)
        return pd.DataFrame({"q": pd.Series(qs, dtype=a.q.dtype), "d": np.concatenate(ds) if ds else pd.Series([], dtype=u.d.dtype), "score": np.concatenate(scores) if scores else pd.Series([], dtype="float64")})

    found = u.groupBy("shard", "block").cogroup(a.groupBy("shard", "block")).applyInPandas(search, f"q {q_kind}, d {d_kind}, score double")
    return top_k(found, k)


def bm25(queries: DataFrame, docs: DataFrame, query_key: str, query_text: str, key: str, text: str, k: int, scope: DataFrame | None = None) -> DataFrame:
    """``q``, ``d``, ``score``, ``rk``: the k best documents of every query.

    Scores are rounded to six digits before ranking, equal ones ranked by ``d``. Documents
    without a common token do not come out; null texts match nothing.
    """
    return ranked(queries, indexed(docs, key, text), query_key, query_text, k, scope)


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """The k best of every query by score, then ``d``, with rank."""
    best = Window.partitionBy("q").orderBy(F.desc("score"), F.asc("d"))
    return scored.withColumn("rk", F.row_number().over(best)).where(F.col("rk") <= k)


#: What ends a sentence.
SENTENCE_ENDS = "。！？.!?；;\n"


def children(text: str, size: int = 240) -> list[str]:
    """Pieces of at most ``size`` characters; one is ended after its last sentence if that leaves half of it."""
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + size)
        if end < len(text):
            last = max(text.rfind(c, at, end) for c in SENTENCE_ENDS)
            if last + 1 - at >= size // 2:
                end = last + 1
        out.append(text[at:end])
        at = end
    return out


def parent_child(queries: DataFrame, docs: DataFrame, query_key: str, query_text: str, key: str, text: str, k: int) -> DataFrame:
    """BM25 over the children of documents; a document stands where its best child does."""
    return ranked(queries, indexed(docs, key, text, children), query_key, query_text, k)


def dense(queries: DataFrame, vectors: DataFrame, query_key: str, query_vector: str, key: str, vector: str, k: int, block: int = 4096) -> DataFrame:
    """Exact cosine top-k: every block of queries meets every block of vectors as matrices.

    A pair of blocks gives k rows a query, so what is shuffled is small against the pairs
    computed. Null, empty and zero vectors match nothing; vectors must be of one length.
    """
    kinds = dict(queries.dtypes)[query_key], dict(vectors.dtypes)[key]

    def blocks(df: DataFrame, id_: str, v: str, names: tuple[str, str, str]) -> DataFrame:
        usable = df.where(F.col(v).isNotNull() & (F.size(v) > 0)).select(F.col(id_).alias(names[0]), F.col(v).cast("array<double>").alias(names[1]))
        n = max(1, -(-df.count() // block))
        return usable.withColumn(names[2], F.pmod(F.xxhash64(names[0]), F.lit(n)).cast("int")), n

    q, nq = blocks(queries, query_key, query_vector, ("q", "qv", "qb"))
    d, nd = blocks(vectors, key, vector, ("d", "dv", "db"))
    q = q.withColumn("db", F.explode(F.sequence(F.lit(0), F.lit(nd - 1))))
    d = d.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"q": [], "d": [], "score": []})
        if a.empty or b.empty:
            return empty
        x, y = np.stack(a.qv.to_numpy()), np.stack(b.dv.to_numpy())
        nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
        s = np.round((x @ y.T) / np.where(nx, nx, np.nan)[:, None] / np.where(ny, ny, np.nan)[None, :], 6)
        ids = b.d.to_numpy()
        order = np.argsort(ids, kind="stable")
        s, ids = s[:, order], ids[order]
        best = np.argsort(-s, axis=1, kind="stable")[:, :k]
        rows = np.repeat(np.arange(len(a)), best.shape[1])
        out = pd.DataFrame({"q": a.q.to_numpy()[rows], "d": ids[best.ravel()], "score": s[rows, best.ravel()]})
        return out[~out.score.isna()]

    found = q.groupBy("qb", "db").cogroup(d.groupBy("qb", "db")).applyInPandas(meet, f"q {kinds[0]}, d {kinds[1]}, score double")
    return top_k(found, k)


def fuse(channels: list[tuple[DataFrame, float]], k: int, constant: int = RRF) -> DataFrame:
    """Reciprocal rank fusion of ranked channels (q, d, rk), each with a weight."""
    parts = [c.select("q", "d", (F.lit(w) / (F.lit(float(constant)) + F.col("rk"))).alias("part")) for c, w in channels]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return top_k(out.groupBy("q", "d").agg(F.round(F.sum("part"), 8).alias("score")), k)
