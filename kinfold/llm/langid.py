"""Language identification by segmentation-marginalised unigrams.

Each language has probabilities of the pieces of one fixed public vocabulary. The probability of a word is the sum over
all its segmentations into pieces (forward algorithm); that of a text is the product over its words. Piece probabilities
are fitted by expectation maximisation on the words of a bounded, hash-chosen sample of labelled documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm.bpe import slices, vocabulary_path
from kinfold.llm.common import documents, write_table

WORDS = re.compile(r"[^\W\d_]+")
#: Longest piece of the vocabulary that is used, in characters.
LONGEST = 16
#: Longer runs of letters are summed with the last LONGEST values of the forward sum in hand, a block of letters at a time, so
#: memory has a bound, whatever the text. They take no part in fitting.
LONG_WORD = 1024
#: Most languages of a model, which is sent to every task: vocabulary x languages numbers.
MOST_LANGUAGES = 500


@dataclass
class Model:
    languages: list[str]
    logp: np.ndarray  # (pieces, languages), float32
    vocabulary: str


@lru_cache(2)
def pieces(vocabulary: str) -> tuple[dict[str, int], list[int]]:
    """Piece to id for normal pieces, and the id of the fallback piece of each byte."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
    normal = {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
    return normal, [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]


@lru_cache(2)
def beginnings(vocabulary: str) -> dict[str, int]:
    """Every beginning of a piece: its id if it is a piece itself, else -1."""
    ids = pieces(vocabulary)[0]
    out = {p[:k]: -1 for p in ids if len(p) <= LONGEST for k in range(1, len(p))}
    return out | {p: i for p, i in ids.items() if len(p) <= LONGEST}


class Lattice:
    """Forward (and backward) sums over the segmentations of words, for all languages at once."""

    def __init__(self, logp: np.ndarray, vocabulary: str):
        self.ids, self.bytes = pieces(vocabulary)
        self.begun = beginnings(vocabulary)
        self.size = len(logp)
        self.logp = logp.astype(np.float64)
        self.extra: dict[str, int] = {}  # characters without a piece: their bytes' pieces in a row
        self.rows = np.empty((0, logp.shape[1]))
        self.table = self._table()

    def _table(self) -> np.ndarray:
        """Log probabilities of all pieces, of characters without one, and of no piece (last)."""
        return np.vstack([self.logp, self.rows, np.full((1, self.logp.shape[1]), -np.inf)])

    def _edges(self, words: list[str]) -> np.ndarray:
        """(word, start, length - 1) to row of the table of log probabilities, -1 where no piece is."""
        n, get, extra, base = len(words[0]), self.begun.get, self.extra, self.size
        longest = min(LONGEST, n)
        out = np.full((len(words), n, longest), -1, np.int32)
        cells, values = [], []
        for w, word in enumerate(words):
            at = w * n * longest
            for i in range(n):
                e = get(word[i])
                if e is None or e < 0:
                    cells.append(at)
                    values.append(base + extra.setdefault(word[i], len(extra)))
                else:
                    cells.append(at)
                    values.append(e)
                if e is not None:
                    for k in range(2, min(longest, n - i) + 1):
                        e = get(word[i : i + k])
                        if e is None:
                            break
                        if e >= 0:
                            cells.append(at + k - 1)
                            values.append(e)
                at += longest
        out.reshape(-1)[cells] = values
        if len(extra) > len(self.rows):
            new = list(extra)[len(self.rows) :]
            self.rows = np.vstack([self.rows, *(self.logp[[self.bytes[b] for b in c.encode("utf-8", "replace")]].sum(axis=0)[None] for c in new)])
            self.table = self._table()
        return out

    def _weights(self, edges: np.ndarray) -> np.ndarray:
        return self.table[edges]

    def forward(self, words: list[str]) -> np.ndarray:
        """Log probability of each word (all of one length) in each language."""
        return self._forward(self._weights(self._edges(words)))[:, -1]

    def forward_long(self, word: str, block: int = 4096) -> np.ndarray:
        """Log probability of one word of any length in each language, as forward() has it."""
        langs = self.logp.shape[1]
        steps = np.arange(LONGEST)
        parts = np.full((LONGEST, LONGEST, langs), -np.inf)  # by end, modulo LONGEST, and length of the last piece
        now = np.zeros(langs)
        for first in range(0, len(word), block):
            some = word[first : first + block + LONGEST - 1]
            weight = self._weights(self._edges([some]))[0]
            for i in range(min(block, len(word) - first)):
                at = first + i
                if at:
                    now = self._sum(parts[at % LONGEST])
                    parts[at % LONGEST] = -np.inf
                n = weight.shape[1]
                parts[(at + 1 + steps[:n]) % LONGEST, steps[:n]] = now + weight[i]
        return self._sum(parts[len(word) % LONGEST])

    @staticmethod
    def _sum(parts: np.ndarray) -> np.ndarray:
        top = np.maximum(parts.max(axis=0), -1e300)
        return top + np.log(np.exp(parts - top).sum(axis=0))

    @staticmethod
    def _forward(weight: np.ndarray) -> np.ndarray:
        count, n, longest, langs = weight.shape
        a = np.full((count, n + 1, langs), -np.inf)
        a[:, 0] = 0.0
        for j in range(1, n + 1):
            parts = np.stack([a[:, j - k] + weight[:, j - k, k - 1] for k in range(1, min(longest, j) + 1)])
            top = np.maximum(parts.max(axis=0), -1e300)
            a[:, j] = top + np.log(np.exp(parts - top).sum(axis=0))
        return a

    def expected(self, words: list[str], counts: np.ndarray, lang: int, into: np.ndarray) -> None:
        """Add to `into` the expected uses of each piece in one language, words weighed by counts."""
        edges = self._edges(words)
        weight = self._weights(edges)[..., lang : lang + 1]
        count, n, longest, _ = weight.shape
        a, b = self._forward(weight)[..., 0], np.full((count, n + 1), -np.inf)
        b[:, n] = 0.0
        for i in range(n - 1, -1, -1):
            parts = np.stack([weight[:, i, k - 1, 0] + b[:, i + k] for k in range(1, min(longest, n - i) + 1)])
            top = np.maximum(parts.max(axis=0), -1e300)
            b[:, i] = top + np.log(np.exp(parts - top).sum(axis=0))
        total = a[:, n]
        letters = {v: c for c, v in self.extra.items()}
        for i in range(n):
            for k in range(1, min(longest, n - i) + 1):
                e = edges[:, i, k - 1]
                use = counts * np.exp(a[:, i] + weight[:, i, k - 1, 0] + b[:, i + k] - total)
                known = (e >= 0) & (e < self.size)
                np.add.at(into, e[known], use[known])
                for x in np.flatnonzero(e >= self.size):
                    for byte in letters[int(e[x]) - self.size].encode("utf-8", "replace"):
                        into[self.bytes[byte]] += use[x]


def by_length(words: list[str], most: int = 400_000) -> Iterator[list[int]]:
    """Positions of words of one length, in groups whose lattices have `most` cells at most (one long word may have more)."""
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    first = 0
    while first < len(order):
        n = len(words[order[first]])
        last, room = first, max(1, most // max(1, n * min(n, LONGEST)))
        while last < len(order) and last - first < room and len(words[order[last]]) == n:
            last += 1
        yield order[first:last]
        first = last


def marked(text: str) -> list[str]:
    """The words of a text in lower case, each with the mark that begins a word in the vocabulary."""
    return ["▁" + w for w in WORDS.findall(text.lower())]


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def _word_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for lang, texts in pdf.groupby("lang")["text"]:
            texts = texts.tolist()
            for part in slices(texts):
                counts = Counter(w for t in texts[part] for w in marked(t) if len(w) <= LONG_WORD)
                yield pd.DataFrame({"lang": lang, "word": list(counts), "n": list(counts.values())})


def fit_languages(docs: DataFrame, vocabulary: str | None = None, docs_per_language: int = 3000, rounds: int = 3, smooth: float = 0.02) -> Model:
    """Fit on rows with text and lang. Bounded sample: about docs_per_language documents of each language, those with the
    least hashes of doc_id. The model has vocabulary x languages numbers, whatever the size of the corpus; more than
    MOST_LANGUAGES values of lang are an error. No labelled row: a model without languages."""
    vocabulary = vocabulary or vocabulary_path("piece_bpe_32k.model")
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", "lang").filter("text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"lang has more than {MOST_LANGUAGES} values")
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((0, 0), np.float32), vocabulary)
    share = F.create_map(*(x for k in languages for x in (F.lit(k), F.lit(min(1.0, docs_per_language / sizes[k])))))
    sample = docs.filter(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))
    counts = write_table(sample.mapInPandas(_word_counts, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    size = max(max(pieces(vocabulary)[0].values()), max(pieces(vocabulary)[1])) + 1
    logp = np.full((size, len(languages)), -np.log(size))
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(logp.astype(np.float32))

        def step(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            lattice = Lattice(shared.value, vocabulary)
            sums = np.zeros((size, len(languages)))
            for pdf in batches:
                for lang, g in pdf.groupby("lang"):
                    words, n = g["word"].tolist(), g["n"].to_numpy(np.float64)
                    for at in by_length(words):
                        lattice.expected([words[i] for i in at], n[at], languages.index(lang), sums[:, languages.index(lang)])
            piece, lang = np.nonzero(sums)
            yield pd.DataFrame({"piece": piece, "lang": lang, "use": sums[piece, lang]})

        rows = counts.mapInPandas(step, "piece bigint, lang bigint, use double").groupBy("piece", "lang").agg(F.sum("use").alias("use")).toPandas()
        use = np.full((size, len(languages)), smooth)
        use[rows["piece"], rows["lang"]] += rows["use"]
        logp = np.log(use / use.sum(axis=0))
    return Model(languages, logp.astype(np.float32), vocabulary)


class Scorer:
    """Log likelihoods of texts; a bounded table keeps those of words."""

    def __init__(self, model: Model, memory: int = 600_000):
        self.lattice, self.memory = Lattice(model.logp, model.vocabulary), memory
        self.known: dict[str, int] = {}
        self.rows: np.ndarray = np.empty((0, len(model.languages)))

    def score(self, texts: list[str]) -> np.ndarray:
        split = [marked(t) for t in texts]
        if len(self.known) > self.memory:
            self.known, self.rows = {}, self.rows[:0]
        new = [w for w in set().union(*split) if w not in self.known]
        if new:
            new.sort(key=len)
            rows = np.empty((len(new), self.rows.shape[1]))
            short = sum(len(w) <= LONG_WORD for w in new)
            for at in by_length(new[:short]):
                rows[at] = self.lattice.forward([new[i] for i in at])
            for i in range(short, len(new)):
                rows[i] = self.lattice.forward_long(new[i])
            self.known.update(zip(new, range(len(self.rows), len(self.rows) + len(new))))
            self.rows = np.vstack([self.rows, rows])
        return np.stack([self.rows[list(map(self.known.__getitem__, s))].sum(axis=0) for s in split]) if split else self.rows[:0]


def identify_languages(docs: DataFrame, model: Model) -> DataFrame:
    """Add lang_pred and score (the predicted language's posterior under equal priors).

    `und` with score 0 if text is null, empty or has no letter, or if the model knows no language. A tie goes to the
    language that sorts first. Only the text is looked at; columns of the added names are replaced, any others pass. Rows,
    repeated ones too, are scored where they are read, whole texts of any length, without a shuffle. Empty table: empty result.
    """
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        scorer = Scorer(model) if model.languages else None
        for pdf in batches:
            texts = [t if isinstance(t, str) else "" for t in pdf["text"]]
            for part in slices(texts):
                some = [scorer is not None and has_letter(t) for t in texts[part]]
                pred, score = np.full(len(some), "und", object), np.zeros(len(some))
                at = np.flatnonzero(some)
                if len(at):
                    ll = scorer.score([texts[part][i] for i in at])
                    p = np.exp(ll - ll.max(axis=1, keepdims=True))
                    pred[at] = np.array(model.languages, object)[p.argmax(axis=1)]
                    score[at] = 1.0 / p.sum(axis=1)
                yield pdf.iloc[part].assign(lang_pred=pred, score=score)

    return docs.mapInPandas(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "lang_pred string, score double"]))


def in_fold(doc_id: str = "doc_id", folds: int = 3):
    """Whether a document is held out: crc32 of doc_id as text, modulo folds, is 1 (a null doc_id is held out)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == 1, F.lit(True))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every row of documents, learnt from the rows of the other folds; cases as in identify_languages."""
    docs = documents(spark, sf_dir)
    model = fit_languages(docs.filter(~in_fold()))
    return identify_languages(docs.select("doc_id", "text"), model).select("doc_id", in_fold().alias("held_out"), "lang_pred", "score")
