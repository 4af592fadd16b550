"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over the bytes cuts each text where the content says so, so copies and near copies are cut alike. A
chunk that several documents share is encoded once by a Python worker and then taken from a bounded table of chunks.
Where two chunks meet, the text around the join is encoded again, from the last place in the left chunk to the first
in the right one at which any encoding has a token edge; a chunk without such places joins the window as a whole, so
that the window grows until its edges agree exactly with both neighbours.
"""

from __future__ import annotations

import json
import re
from collections import OrderedDict
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm.common import documents

#: What one step of a worker holds at most, in characters of text (one text may be longer).
STEP_CHARS = 2_000_000
#: Chunks: 2**10 bytes on average after the least size, cut by force at the greatest.
MASK, LEAST, GREATEST = np.uint32((1 << 10) - 1), 256, 65_536


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def slices(texts: list[str], most: int = STEP_CHARS) -> Iterator[slice]:
    """Runs of texts of about `most` characters."""
    first = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= most:
            yield slice(first, i + 1)
            first, total = i + 1, 0
    if first < len(texts):
        yield slice(first, len(texts))


#: Fixed value: how a byte-level tokenizer with use_regex splits a text into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: tiktoken fails at about a million blanks in a row: any text with a run of twice this length, at least, runs on the library.
BLANKS = 100_000


def many_blanks(text: str) -> bool:
    """Whether a run of blanks covers a block of BLANKS characters (str.isspace knows every blank of the pattern)."""
    return len(text) >= BLANKS and any(text[i : i + BLANKS].isspace() for i in range(0, len(text) - BLANKS + 1, BLANKS))


class Encoder:
    """Ids as the tokenizers library gives them with add_special_tokens=False, without truncation and padding.

    A plain byte-level file whose merges stand in the order of their ids is the same model as a table of ranks: those
    run on tiktoken, which is five times as fast. Any other file runs on the library itself, and so does any text with a
    very long run of blanks.
    """

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, pre = file["model"], file.get("pre_tokenizer") or {}
        vocab, merges = model.get("vocab", {}), [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.get("merges", [])]
        ids = [vocab.get(a + b) for a, b in merges]
        plain = file.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        plain = plain and all(not model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        plain = plain and None not in ids and ids == sorted(set(ids)) and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in file["added_tokens"])
        if plain:
            import tiktoken

            table = Decoder(path).table
            ranks = {table[i]: i for i in vocab.values()}
            core = tiktoken.Encoding("file", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={t["content"]: t["id"] for t in file["added_tokens"]})
            self.one = lambda text: self.by_library(text) if many_blanks(text) else core.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()
        else:
            self.one = self.by_library

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(self.path)
        library.no_truncation()
        library.no_padding()
        return library

    def by_library(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        return [self.one(t) if t else b"" for t in texts]


class Decoder:
    """Ids to text by a table of the bytes of each token."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in keep]
        code = {chr(b): b for b in keep} | {chr(256 + k): b for k, b in enumerate(rest)}
        names = {i: t for t, i in file["model"]["vocab"].items()} | {t["id"]: t["content"] for t in file["added_tokens"]}
        self.table = [bytes(code[c] for c in names[i]) if all(c in code for c in names[i]) else names[i].encode() for i in range(max(names) + 1)]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process, kept from task to task."""
    return Encoder(path)


@lru_cache(2)
def decoder(path: str) -> Decoder:
    return Decoder(path)


_GEAR = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)


def cuts(data: bytes) -> list[int]:
    """Ends of the content-defined chunks of UTF-8 text, each at the edge of a character.

    The rolling hash of the 16 bytes up to each place is sum(gear[byte] << age), in five doubling steps for all places.
    """
    b = np.frombuffer(data, np.uint8)
    if len(b) <= LEAST:
        return [len(b)] if len(b) else []
    h = _GEAR[b]
    for k in (1, 2, 4, 8):
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    edge = np.append((b[1:] & 0xC0) != 0x80, True)
    places = np.flatnonzero(((h >> np.uint32(6)) & MASK == 0) & edge) + 1
    ends, last = [], 0
    for p in [*places.tolist(), len(b)]:
        while p - last > GREATEST:
            q = last + GREATEST
            while b[q] & 0xC0 == 0x80:
                q -= 1
            ends.append(q)
            last = q
        if p - last >= LEAST or p == len(b):
            if p > last:
                ends.append(p)
            last = p
    return ends


_EDGE = re.compile(r"(?<=[^\W_])[ \n]")


def edges(text: str) -> tuple[int, int] | None:
    """First and last place at which a blank or line end follows a letter or digit: every piece ends there, whatever is around."""
    first = _EDGE.search(text)
    if not first:
        return None
    at = len(text)
    while True:
        at = max(text.rfind(" ", 0, at), text.rfind("\n", 0, at))
        if at > 0 and text[at - 1].isalnum():
            return first.start(), at


class ChunkEncoder:
    """Encodes texts by chunks. A table of `memory` characters at most keeps what was encoded: the chunk's text before its
    first edge, the ids between its edges, and the text after the last."""

    def __init__(self, path: str, memory: int = 24_000_000):
        self.encoder, self.memory, self.size = encoder(path), memory, 0
        self.known: OrderedDict[bytes, tuple | None] = OrderedDict()
        self.encoded = self.reused = 0

    def _learn(self, chunks: list[bytes]) -> dict[bytes, tuple | None]:
        here: dict[bytes, tuple | None] = {}
        new = []
        for c in chunks:
            if c in self.known:
                self.reused += 1
                here[c] = self.known[c]
            elif c in here:
                self.reused += 1
            else:
                here[c] = None
                new.append(c)
        texts = [c.decode() for c in new]
        found = [edges(t) for t in texts]
        core = iter(self.encoder.encode([t[e[0] : e[1]] for t, e in zip(texts, found) if e]))
        for c, t, e in zip(new, texts, found):
            here[c] = (t[: e[0]], next(core), t[e[1] :]) if e else None
            self.known[c] = here[c]
            self.size += len(c)
        self.encoded += len(new)
        while self.size > self.memory:
            self.size -= len(self.known.popitem(last=False)[0])
        return here

    def encode(self, texts: list[str]) -> list[bytes]:
        split = []
        for t in texts:
            data, last, parts = t.encode(), 0, []
            for end in cuts(data):
                parts.append(data[last:end])
                last = end
            split.append(parts)
        known = self._learn([c for parts in split for c in parts])
        windows, plans = [], []
        for parts in split:
            plan, window = [], ""
            for c in parts:
                if known[c] is None:
                    window += c.decode()
                else:
                    head, core, tail = known[c]
                    windows.append(window + head)
                    plan.append(core)
                    window = tail
            windows.append(window)
            plans.append(plan)
        joined = iter(self.encoder.encode(windows))
        out = []
        for plan in plans:
            ids = []
            for core in plan:
                ids += [next(joined), core]
            out.append(b"".join([*ids, next(joined)]))
        return out


@lru_cache(2)
def chunk_encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


def encode_chunked(docs: DataFrame, path: str, decode: bool = False, text: str = "text") -> DataFrame:
    """Add token_ids (binary: little-endian unsigned 32-bit integers), n_tokens (bigint) and, if asked for, decoded (string).

    Null and empty texts have no tokens; repeated rows are encoded each; an empty table gives an empty result. Columns of
    these names are replaced, any others pass. Every row is encoded where it is read: no shuffle, and a text's length bounds
    what a worker holds.
    """
    added = "token_ids binary, n_tokens bigint" + ", decoded string" * decode
    docs = docs.drop("token_ids", "n_tokens", "decoded")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, dec = chunk_encoder(path), decoder(path)
        for pdf in batches:
            texts = [t if isinstance(t, str) else "" for t in pdf[text]]
            for part in slices(texts):
                ids = enc.encode(texts[part])
                out = pdf.iloc[part].assign(token_ids=ids, n_tokens=[len(x) // 4 for x in ids])
                yield out.assign(decoded=[dec.decode(x) for x in ids]) if decode else out

    return docs.mapInPandas(run, schema=", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), added]))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents encoded and decoded, as digests; cases as in encode_chunked."""
    out = encode_chunked(documents(spark, sf_dir).select("doc_id", "text"), vocabulary_path(), decode=True)
    return out.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
