"""Language-model scoring by a Katz backoff bigram model over all training documents.

Counts are discounted by Good-Turing; what the seen successors of a context leave over goes to the unigram model by a
backoff weight that makes each context's probabilities sum to one:

    P(w | h) = d(r) r / (c(h) + 1)            r = c(h, w) > 0
             = weight(h) P(w)                 otherwise; weight(h) = (1 - sum of the seen) / (1 - sum of their P(w))
    P(w)     = d(c) c / N, and the mass left over for the class of unknown words
    P(w | h) = P(w)                           h unknown

(The 1 beside c(h) keeps mass for backoff where all successors are too frequent to be discounted.) A text's tokens are
its words and one end; the context of the first is the start.

Word rows never exist one by one. A task reads documents in slices of SLICE_CHARS characters; what moves is a packed
array for each slice and hash bucket: first the distinct words of the slice with their counts, which come back as dense
ids and corpus counts; then (context, word, document) of its tokens to the partition of their context, where bigram
counts, and the sums that the backoff weights need, are made. A context with more than 1/HOT of all tokens (there are
fewer than HOT of them) is dealt over all partitions by its words, and its sums are added up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm.bpe import slices
from kinfold.llm.common import documents, write_table
from kinfold.llm.ngram_join import mix

SLICE_CHARS, HOT, BUCKET_TOKENS = 16_000_000, 1000, 2_000_000
#: Documents of a slice beyond which it ends (many may be empty; a batch goes in whole): a document's place in it has 24 bits.
SLICE_DOCS = 1 << 22
#: Counts up to here are discounted; ids of the end and of the start; the id of unknown words.
K, END, START, UNKNOWN = 5, 0, 1, -1
_U = np.uint64


def pack(x: np.ndarray) -> bytes:
    """An array as a type code and compressed bytes, planes of bytes apart."""
    if x.dtype.kind in "iu" and len(x):
        low, high = int(x.min()), int(x.max())
        x = x.astype(next(t for t in ("<u1", "<u2", "<u4", "<i8") if t == "<i8" or (low >= 0 and high <= np.iinfo(t).max)))
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes() if len(x) else b""
    return x.dtype.str.encode().ljust(4) + zstandard.compress(planes, 3)


def unpack(data: bytes) -> np.ndarray:
    kind = np.dtype(bytes(data[:4]).decode().strip())
    planes = np.frombuffer(zstandard.decompress(bytes(data[4:])) if len(data) > 4 else b"", np.uint8)
    return np.ascontiguousarray(planes.reshape(kind.itemsize, -1).T).reshape(-1).view(kind) if len(planes) else np.empty(0, kind)


def _words(batches: Iterator[pd.DataFrame], most: int) -> Iterator[tuple[int, pd.DataFrame, np.ndarray]]:
    """(slice number, its documents with n_words, the hashes of their words in order); same rows, same slices."""
    number, held, hashes, chars = TaskContext.get().partitionId() << 20, [], [], 0
    for pdf in batches:
        texts = [t if isinstance(t, str) else "" for t in pdf["text"]]
        for part in slices(texts):
            split = [t.encode("utf-8", "replace").lower().split() for t in texts[part]]
            flat = np.array([w for s in split for w in s], dtype=object)
            hashes.append(pd.util.hash_array(flat, categorize=False) if len(flat) else np.empty(0, _U))
            held.append(pd.DataFrame({"doc_id": pdf["doc_id"].iloc[part], "train": pdf["train"].iloc[part], "n_words": [len(s) for s in split]}))
            chars += sum(map(len, texts[part]))
            if chars >= most or sum(map(len, held)) >= SLICE_DOCS:
                yield number, pd.concat(held, ignore_index=True), np.concatenate(hashes)
                number, held, hashes, chars = number + 1, [], [], 0
    if held:
        yield number, pd.concat(held, ignore_index=True), np.concatenate(hashes)


def _dictionaries(batches: Iterator[pd.DataFrame], buckets: int, most: int) -> Iterator[pd.DataFrame]:
    """The distinct words of each slice, with their counts in its training documents, by ranges of the hash."""
    for number, docs, h in _words(batches, most):
        words, at = np.unique(h, return_inverse=True)
        counts = np.bincount(at, weights=np.repeat(docs["train"].to_numpy(float), docs["n_words"]), minlength=len(words)).astype(np.int64)
        edges = np.searchsorted(((words >> _U(32)) * _U(buckets)) >> _U(32), np.arange(buckets + 1, dtype=np.uint64))
        rows = [(number, b, pack(np.diff(words[i:j], prepend=_U(0))), pack(counts[i:j])) for b, (i, j) in enumerate(zip(edges[:-1], edges[1:])) if j > i]
        yield pd.DataFrame(rows, columns=["slice", "bucket", "words", "counts"])


def _number(pdf: pd.DataFrame, buckets: int) -> pd.DataFrame:
    """Corpus counts and ids of one range of words: rows of slices, and one row (slice -1) with the table itself."""
    bucket = int(pdf["bucket"].iloc[0])
    lists = [np.cumsum(unpack(x).astype(_U)) for x in pdf["words"]]
    words, at = np.unique(np.concatenate(lists), return_inverse=True)
    total = np.bincount(at, weights=np.concatenate([unpack(x) for x in pdf["counts"]]), minlength=len(words)).astype(np.int64)
    known = np.flatnonzero(total > 0)
    order = known[np.lexsort((words[known], -total[known]))]
    ids = np.full(len(words), UNKNOWN, np.int64)
    ids[order] = np.arange(len(order)) * buckets + bucket + 2
    out, first = [], 0
    for number, w in zip(pdf["slice"], lists):
        mine = at[first : first + len(w)]
        out.append((number, bucket, pack(ids[mine] + 1), pack(total[mine]), 0, 0, [0] * (K + 1)))
        first += len(w)
    out.append((-1, bucket, pack(words[order]), pack(total[order]), int(total.sum()), len(order), np.bincount(np.minimum(total[order], K + 2), minlength=K + 3)[1 : K + 2].tolist()))
    return pd.DataFrame(out, columns=["slice", "bucket", "ids", "counts", "tokens", "types", "times"])


def discounts(times: list[int]) -> list[float]:
    """Good-Turing discount of counts 1..K from the numbers of types seen 1..K+1 times.

    Where the numbers as they are give no ratio between 0 and 1 (copies make even counts common), they are first smoothed
    by a line through log(number) over log(count), as in simple Good-Turing; 1 - 0.5/r if that line is too flat or has
    fewer than two points.
    """
    n = [0.0, *map(float, times)]
    if all(x > 0 for x in n[1:]):
        common = (K + 1) * n[K + 1] / n[1]
        d = [((r + 1) * n[r + 1] / (n[r] * r) - common) / (1 - common) if common < 1 else -1.0 for r in range(1, K + 1)]
        if all(0 < x < 1 for x in d):
            return d
    at = [r for r in range(1, K + 2) if n[r] > 0]
    if len(at) > 1:
        slope = float(np.polyfit(np.log(at), np.log([n[r] for r in at]), 1)[0])
        if slope < -1.05:
            return [(1 + 1 / r) ** (slope + 1) for r in range(1, K + 1)]
    return [1 - 0.5 / r for r in range(1, K + 1)]


@dataclass
class Unigrams:
    """N, V, counts of counts, and the unigram model's probability as a function of a count (0: all unknown words)."""

    tokens: int
    types: int
    ends: int
    times: list[int]
    d: np.ndarray = field(init=False)
    unknown: float = field(init=False)

    def __post_init__(self) -> None:
        self.d = np.array([1.0, *discounts(self.times)])
        lost = sum(r * n * (1 - x) for r, n, x in zip(range(1, K + 1), self.times, self.d[1:]))
        self.unknown = lost / self.tokens if lost > 0 else 1.0 / (self.tokens + 1)
        self.scale = 1.0 if lost > 0 else self.tokens / (self.tokens + 1)

    def p(self, counts: np.ndarray) -> np.ndarray:
        d = np.where(counts <= K, self.d[np.minimum(counts, K)], 1.0)
        return np.where(counts > 0, d * counts * (self.scale / self.tokens), self.unknown)


def _payload(batches: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    for number, docs, h in _words(batches, most):
        _, at = np.unique(h, return_inverse=True)
        ids = docs["doc_id"]
        yield pd.DataFrame([(number, pack(ids.fillna(0).to_numpy(np.int64)), pack(ids.isna().to_numpy(np.uint8)), pack(docs["train"].to_numpy(np.uint8)), pack(docs["n_words"].to_numpy(np.int64)), pack(at.astype(np.int64)))], columns=["slice", "doc_id", "null_id", "train", "n_words", "at"])


_TOKENS = "bucket bigint, slice bigint, kind string, a binary, b binary, c binary, d binary, e binary"


def _tokens(text: pd.DataFrame, words: pd.DataFrame, uni: Unigrams, buckets: int) -> pd.DataFrame:
    """Of one slice: what its documents need (kind doc), and its tokens by partition of their context (kind token)."""
    if not len(text):
        return pd.DataFrame([], columns=[x.split()[0] for x in _TOKENS.split(", ")])
    row = text.iloc[0]
    words = words.sort_values("bucket")
    ids = np.concatenate([unpack(x) for x in words["ids"]] or [np.empty(0)]).astype(np.int64) - 1
    counts = np.concatenate([unpack(x) for x in words["counts"]] or [np.empty(0)]).astype(np.int64)
    at, n = unpack(row["at"]).astype(np.int64), unpack(row["n_words"]).astype(np.int64)
    if len(at) and at.max() >= len(ids):
        raise RuntimeError("documents changed between two reads")
    ends = np.cumsum(n + 1) - 1
    first = ends - n
    inner = np.ones(int((n + 1).sum()), bool)
    inner[ends] = False
    w, cw = np.full(len(inner), END, np.int64), np.full(len(inner), uni.ends, np.int64)
    w[inner], cw[inner] = ids[at], counts[at]
    h, ch = np.roll(w, 1), np.roll(cw, 1)
    h[first], ch[first] = START, uni.ends
    train = unpack(row["train"]).astype(np.int64)
    doc = np.repeat(np.arange(len(n)), n + 1)
    alone = (ch == 0) * np.log10(uni.p(cw))
    sums = np.stack([np.add.reduceat(np.log10(cw + 0.5), first), np.add.reduceat(alone, first)])
    number = int(row["slice"])
    out = [(int(mix(np.array([number], _U))[0] % _U(buckets)), number, "doc", row["doc_id"], row["null_id"], pack(n + 1), pack(np.add.reduceat((cw > 0).astype(np.int64), first) * 2 + train), pack(sums.reshape(-1)))]
    use = np.flatnonzero(ch > 0)
    w, cw, h, ch, doc = w[use], cw[use], h[use], ch[use], doc[use]
    hot = ch * HOT > uni.tokens
    spread = mix(h.astype(_U) * _U(0x9E3779B97F4A7C15) + np.where(hot, w + 2, 0).astype(_U))
    part = (spread % _U(buckets)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    edges = np.searchsorted(part[order], np.arange(buckets + 1))
    for b, (i, j) in enumerate(zip(edges[:-1], edges[1:])):
        if i == j:
            continue
        o = order[i:j]
        both, inverse = np.unique(np.concatenate([h[o], w[o]]), return_inverse=True)
        c = np.zeros(len(both), np.int64)
        c[inverse] = np.concatenate([ch[o], cw[o]])
        hi, wi = inverse[: len(o)], inverse[len(o) :]
        s = np.argsort(hi * len(both) + wi, kind="stable")
        d = doc[o][s]
        out.append((b, number, "token", pack(np.diff(both + 1, prepend=0)), pack(c), pack(np.diff(hi[s], prepend=0)), pack(wi[s]), pack(d * 2 + train[d])))
    return pd.DataFrame(out, columns=[x.split()[0] for x in _TOKENS.split(", ")])


_COUNTED = "bucket bigint, times array<bigint>, docs binary, seen binary, times_of binary, context binary, context_stats binary, context_uni binary, missed_doc binary, missed_context binary, missed_p binary, pair_context binary, pair_word binary, pair_count binary, hot array<struct<h:bigint,stats:array<bigint>,uni:double>>"

_COLUMNS = ["bucket", "times", "docs", "seen", "times_of", "context", "context_stats", "context_uni", "missed_doc", "missed_context", "missed_p", "pair_context", "pair_word", "pair_count", "hot"]


def _count(pdf: pd.DataFrame, uni: Unigrams) -> pd.DataFrame:
    """Bigram counts of one partition of contexts. Of documents: the sum of log10(r / (c(h) + 1)) over tokens seen in
    training, how many of them were seen r = 1..K times, and their unseen tokens. Of contexts: the sums of the weights.
    pair_context, pair_word and pair_count are the bigram table itself (ids as in the table of unigrams)."""
    tokens = pdf[pdf["kind"] == "token"]
    if not len(tokens):
        return pd.DataFrame([], columns=_COLUMNS)
    parts = []
    for number, a, b, c, d, e in zip(tokens["slice"], tokens["a"], tokens["b"], tokens["c"], tokens["d"], tokens["e"]):
        both, counts = np.cumsum(unpack(a).astype(np.int64)) - 1, unpack(b).astype(np.int64)
        hi, wi, d = np.cumsum(unpack(c).astype(np.int64)), unpack(d).astype(np.int64), unpack(e).astype(np.int64)
        parts.append((both[hi], counts[hi], both[wi], counts[wi], (number << 24) + (d >> 1), d & 1))
    h, ch, w, cw, doc, train = (np.concatenate(x) for x in zip(*parts))
    del parts
    order = np.lexsort((w, h))
    h, ch, w, cw, doc, train = h[order], ch[order], w[order], cw[order], doc[order], train[order]
    new_h = np.append(True, h[1:] != h[:-1])
    new = new_h | np.append(True, w[1:] != w[:-1])
    pair, context = np.cumsum(new) - 1, np.cumsum(new_h) - 1
    r_of = np.add.reduceat(train, np.flatnonzero(new))  # by pair
    r = r_of[pair]
    seen = r > 0
    # Documents: seen tokens.
    docs, at = np.unique(doc, return_inverse=True)
    value = np.zeros(len(h))
    value[seen] = np.log10(r[seen] / (ch[seen] + 1.0))
    sums = np.bincount(at, weights=value, minlength=len(docs))
    small = seen & (r <= K)
    times_of = np.bincount(at[small] * K + r[small] - 1, minlength=len(docs) * K)
    # Contexts: stats of those with unseen tokens, or hot.
    heads = np.flatnonzero(new)
    ctx_of, p_of = context[heads], uni.p(cw[heads])
    size = int(context[-1]) + 1
    first_of = np.flatnonzero(new_h)
    is_hot = ch[first_of] * HOT > uni.tokens
    stats = np.zeros((size, K + 2), np.int64)
    for k in range(1, K + 1):
        stats[:, k - 1] = np.bincount(ctx_of[r_of == k], minlength=size)
    stats[:, K] = np.bincount(ctx_of[r_of > K], weights=r_of[r_of > K], minlength=size)
    stats[:, K + 1] = ch[first_of]
    known = np.bincount(ctx_of[r_of > 0], weights=p_of[r_of > 0], minlength=size)
    missed = np.flatnonzero(~seen)
    needed, missed_context = np.unique(context[missed], return_inverse=True)
    learnt = heads[r_of > 0]  # the bigram table of this partition, as it is stored
    grams = (pack(np.diff(h[learnt], prepend=0)), pack(w[learnt]), pack(r_of[r_of > 0]))
    hot = [{"h": int(h[first_of[x]]), "stats": stats[x].tolist(), "uni": float(known[x])} for x in np.flatnonzero(is_hot)]
    times = [int((r_of == k).sum()) for k in range(1, K + 2)]
    row = (int(pdf["bucket"].iloc[0]), times, pack(docs), pack(sums), pack(times_of), pack(np.where(is_hot[needed], h[first_of[needed]] + 1, 0)), pack(stats[needed].reshape(-1)), pack(known[needed]), pack(doc[missed]), pack(missed_context), pack(uni.p(cw[missed])), *grams, hot)
    return pd.DataFrame([row], columns=_COLUMNS)


def weights(stats: np.ndarray, uni: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Backoff weights from the numbers of successors seen 1..K times, the counts of the others, c(h), and sums of P(w)."""
    seen = (stats[:, :K] * (d * np.arange(1, K + 1))).sum(axis=1) + stats[:, K]
    return (1 - seen / (stats[:, K + 1] + 1.0)) / (1 - uni)


def _score(batches: Iterator[pd.DataFrame], d: np.ndarray, hot: dict[int, float]) -> Iterator[pd.DataFrame]:
    """For each slice of documents, packed parts of their scores from the rows of _count."""
    for pdf in batches:
        for x in pdf.itertuples():
            docs, score = unpack(x.docs).astype(np.int64), unpack(x.seen) + unpack(x.times_of).reshape(-1, K) @ np.log10(d)
            stats = unpack(x.context_stats).astype(np.float64).reshape(-1, K + 2)
            if len(stats):
                weight = weights(stats, unpack(x.context_uni), d)
                name = unpack(x.context).astype(np.int64)
                for i in np.flatnonzero(name):
                    weight[i] = hot[int(name[i]) - 1]
                at = np.searchsorted(docs, unpack(x.missed_doc).astype(np.int64))
                score += np.bincount(at, weights=np.log10(weight[unpack(x.missed_context).astype(np.int64)] * unpack(x.missed_p)), minlength=len(docs))
            edges = [0, *(np.flatnonzero(np.diff(docs >> 24)) + 1), len(docs)]
            rows = [(int(docs[i] >> 24), pack(docs[i:j] & 0xFFFFFF), pack(score[i:j])) for i, j in zip(edges[:-1], edges[1:]) if j > i]
            yield pd.DataFrame(rows, columns=["slice", "docs", "part"])


def _gather(pdf: pd.DataFrame) -> pd.DataFrame:
    """The documents of one slice, with all parts of their scores."""
    x = pdf[pdf["docs"].isna()].iloc[0]
    ids, null, n, known = unpack(x["a"]), unpack(x["b"]), unpack(x["c"]).astype(np.int64), unpack(x["d"]).astype(np.int64)
    logs, score = unpack(x["e"]).reshape(2, -1)
    score = score.copy()
    for docs, part in pdf.loc[pdf["docs"].notna(), ["docs", "part"]].itertuples(index=False):
        score[unpack(docs).astype(np.int64)] += unpack(part)
    ids = pd.array(ids.astype(np.int64), "Int64")
    ids[null > 0] = pd.NA
    return pd.DataFrame({"doc_id": ids, "train": known % 2 == 1, "n_tokens": n, "n_known": known // 2, "logs": logs, "score": score})


def score_katz(docs: DataFrame, train: str = "train", slice_chars: int = SLICE_CHARS, bucket_tokens: int = BUCKET_TOKENS) -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score, score for each row of docs (doc_id, text, and a boolean
    column that says which rows train the model).

    A null or empty text is one end token. Repeated rows are scored, and counted, each. No training rows: every token is
    unknown with probability 1 and base_score takes N = V = 0. Empty table: empty result. Texts of any length are scored
    whole; other columns are ignored. docs must give the same rows in the same order when read twice (a table does). Words
    are told apart by 64-bit hashes.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col(train), F.lit(False)).alias("train"))
    buckets = max(8, docs.rdd.getNumPartitions())  # as many as partitions: a bucket's words don't grow with the corpus
    totals = docs.agg(F.count("*").alias("n"), F.count(F.when(F.col("train"), 1)).alias("train")).first()

    dictionaries = docs.mapInPandas(lambda it: _dictionaries(it, buckets, slice_chars), "slice bigint, bucket bigint, words binary, counts binary")
    numbered = dictionaries.groupBy("bucket").applyInPandas(lambda pdf: _number(pdf, buckets), "slice bigint, bucket bigint, ids binary, counts binary, tokens bigint, types bigint, times array<bigint>")
    words = write_table(numbered, "unigrams")
    sums = words.filter("slice = -1").agg(F.sum("tokens").alias("n"), F.sum("types").alias("v"), *(F.sum(F.col("times")[k]).alias(f"t{k}") for k in range(K + 1))).first()
    ends = totals["train"]
    times = [(sums[f"t{k}"] or 0) + (1 if ends == k + 1 else 0) for k in range(K + 1)]
    uni = Unigrams((sums["n"] or 0) + ends, (sums["v"] or 0) + (1 if ends else 0), ends, times) if ends else None
    if uni is None:
        return _untrained(docs)
    every = max(1, int(uni.tokens * (totals["n"] / max(1, totals["train"]))))
    parts = max(8, -(-every // bucket_tokens))

    payload = docs.mapInPandas(lambda it: _payload(it, slice_chars), "slice bigint, doc_id binary, null_id binary, train binary, n_words binary, at binary")
    tokens = payload.groupBy("slice").cogroup(words.filter("slice >= 0").select("slice", "bucket", "ids", "counts").groupBy("slice")).applyInPandas(lambda a, b: _tokens(a, b, uni, parts), _TOKENS)
    return _finish(tokens, uni)


def _finish(tokens: DataFrame, uni: Unigrams) -> DataFrame:
    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        """One row of counts, and the documents' rows as they came."""
        names = [*_COLUMNS, "slice", "a", "b", "c", "d", "e"]
        both = [x for x in (_count(pdf, uni), pdf.loc[pdf["kind"] == "doc", ["slice", "a", "b", "c", "d", "e"]]) if len(x)]
        both = [x.reindex(columns=names).astype(object) for x in both]
        both = [x.where(x.notna(), None) for x in both]
        return pd.concat(both) if both else pd.DataFrame([], columns=names)

    schema = _COUNTED + ", slice bigint, a binary, b binary, c binary, d binary, e binary"
    counted = write_table(tokens.groupBy("bucket").applyInPandas(count, schema), "contexts")
    grams, texts = counted.filter("docs IS NOT NULL"), counted.filter("a IS NOT NULL")
    row = grams.agg(*(F.sum(F.col("times")[k]).alias(f"t{k}") for k in range(K + 1))).first()
    d = np.array(discounts([row[f"t{k}"] or 0 for k in range(K + 1)]))
    # Fewer than HOT contexts have more than 1/HOT of the tokens each.
    hot = grams.select(F.explode("hot").alias("x")).groupBy("x.h").agg(*(F.sum(F.col("x.stats")[k]).alias(f"s{k}") for k in range(K + 1)), F.max(F.col("x.stats")[K + 1]).alias(f"s{K + 1}"), F.sum("x.uni").alias("uni")).toPandas()
    table = {int(x): float(v) for x, v in zip(hot["h"], weights(hot[[f"s{k}" for k in range(K + 2)]].to_numpy(np.float64), hot["uni"].to_numpy(np.float64), d))} if len(hot) else {}
    scored = grams.mapInPandas(lambda it: _score(it, d, table), "slice bigint, docs binary, part binary")
    info = texts.select("slice", "a", "b", "c", "d", "e").unionByName(scored, allowMissingColumns=True)
    one = info.groupBy("slice").applyInPandas(_gather, "doc_id bigint, train boolean, n_tokens bigint, n_known bigint, logs double, score double")
    base = F.col("logs") - F.col("n_tokens") * F.log10(F.lit(uni.tokens + 0.5 * (uni.types + 1)))
    return one.select("doc_id", "train", "n_tokens", "n_known", F.lit(uni.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def _untrained(docs: DataFrame) -> DataFrame:
    from kinfold.llm.common import word_list

    n = (F.size(word_list(F.col("text"))) + 1).cast("long")
    return docs.select("doc_id", "train", n.alias("n_tokens"), F.lit(0).cast("long").alias("n_known"), F.lit(0).cast("long").alias("train_tokens"), F.lit(0.0).alias("base_score"), F.lit(0.0).alias("score"))


def op4_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every row of documents, learnt from the rows of the other folds; cases as in score_katz."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(True))
    docs = documents(spark, sf_dir).select("doc_id", "text", (~held).alias("train"))
    return score_katz(docs).select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
