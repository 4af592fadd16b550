"""Removal of passages that occur more than once, by super-k-mers.

A window is `width` consecutive words. Its minimiser is the shingle of four words in it that ranks first, and consecutive
windows that share a minimiser travel as one packed string (a super-k-mer) to the bucket of that minimiser. Equal windows
have equal minimisers, so a bucket can count its windows by sorting them, without regard to any other.

Shingles that a sample finds frequent rank last, so that a window meets the bucket of its rarest part: only windows made of
frequent shingles alone are left to those, and these windows go by shingles of sixteen words. Equal strings are counted in
the map tasks before they move. The sample decides where windows meet, never which ones are counted.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm.common import Tables, documents

#: Words of a shingle by which windows are dealt, and of those for windows of frequent shingles only.
SHORT, LONG = 4, 16
#: Windows of a super-k-mer at most: texts that repeat one word have runs without end.
RUN = 64
#: Bytes of text that a worker takes in at a time, of strings that a map task combines, and of windows that are sorted at once.
STEP_BYTES, TABLE_BYTES, SORT_BYTES = 1 << 20, 1 << 23, 1 << 25
#: Words of the sample for each partition; a shingle is frequent if it would be a tenth of a partition's super-k-mers.
SAMPLE_WORDS, SAMPLE_LEAST, FREQUENT_SHARE, FREQUENT_LEAST = 3600, 400_000, 150, 16

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
BLANK = np.isin(np.arange(256), (0x20, *range(0x09, 0x0E)))
#: Random numbers of bytes (0 for a blank) and of places in a word, from which words are hashed.
_BYTES, _PLACES = np.random.Generator(np.random.PCG64(11)).integers(0, 1 << 63, (2, 4096), np.uint64)
_BYTES = np.where(np.arange(4096) == 32, np.uint64(0), _BYTES)[:256]


def pieces(text: str | None) -> Iterator[bytes]:
    """The bytes of a text in parts of about STEP_BYTES that end at white space; a longer word stays whole."""
    data = (text or "").encode()
    at = 0
    while len(data) - at > STEP_BYTES:
        found = _SPACE.search(data, at + STEP_BYTES)
        end = found.end() if found else len(data)
        yield data[at:end]
        at = end
    yield data[at:] if at else data


def batches_of_pieces(texts: list, overlap: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (number of the text, number of the first word, bytes), each of about STEP_BYTES. A part of a long text begins
    with the last `overlap` words of the part before."""
    out, size = [], 0
    for i, text in enumerate(texts):
        first, tail = 0, b""
        for k, data in enumerate(pieces(text if isinstance(text, str) else None)):
            if k:  # bytes.split() knows exactly the blanks of the pattern
                words = before.split() if overlap else []
                tail = b" ".join(words[max(0, len(words) - overlap) :])
                first += max(0, len(words) - overlap) if overlap else len(before.split())
                data = tail + b" " + data
            out.append((i, first, data))
            before = data
            size += len(data)
            if size >= STEP_BYTES:
                yield out
                out, size = [], 0
    if out:
        yield out


def normalised(datas: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All words of all parts with one blank after each (but perhaps the last), where each begins and ends, and how many words
    each part has."""
    raw = np.frombuffer(b" ".join(datas), np.uint8)
    blank = BLANK[raw]
    after = np.append(False, ~blank[:-1])[: len(raw)]
    keep = ~blank | after
    begin = np.flatnonzero(~blank & ~after)
    norm = np.where(blank, np.uint8(32), raw)[keep]
    starts = (np.cumsum(keep) - 1)[begin]
    stops = np.append(starts[1:] - 1, len(norm) - int(len(norm) > 0 and norm[-1] == 32))[: len(starts)]
    edges = np.searchsorted(begin, np.cumsum([len(d) + 1 for d in datas]))
    return norm, starts, stops, np.diff(edges, prepend=0)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 63-bit number of each hash."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) >> np.uint64(1)


def shingle_ranks(norm: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of the shingles of SHORT and of LONG words that begin at each word, cyclically; callers mind the ends."""
    place = np.arange(len(norm)) - np.repeat(starts, np.diff(starts, append=len(norm)))
    h = np.add.reduceat(_BYTES[norm] * _PLACES[place % len(_PLACES)], starts) if len(starts) else np.empty(0, np.uint64)
    have, out = 1, []
    for size in (SHORT, LONG):
        while have < size:  # both are powers of two
            h = h * np.uint64(0x9E3779B97F4A7C15) + np.roll(_mixed(h), -have)
            have *= 2
        out.append(_mixed(h))
    return out[0], out[1]


def _sliding_min(x: np.ndarray, span: int) -> np.ndarray:
    have = 1
    while have < span:
        step = min(have, span - have)
        x = np.minimum(x[:-step], x[step:]) if len(x) > step else x[:0]
        have += step
    return x


def super_kmers(parts: list[tuple[int, int, bytes]], width: int, frequent: np.ndarray) -> pd.DataFrame:
    """text (its number), start (of the first window, in words), minimiser, packed (the words, joined by one blank) and again
    (the minimiser occurs twice in it) of each super-k-mer."""
    norm, begin, stop, sizes = normalised([data for _, _, data in parts])
    ends = np.cumsum(sizes)
    part = np.repeat(np.arange(len(parts)), sizes)
    n = len(begin)
    starts = np.flatnonzero(np.arange(n) + width <= ends[part]) if n else np.empty(0, np.int64)
    if not len(starts):
        return pd.DataFrame({"text": [], "start": [], "minimiser": [], "packed": [], "again": []})
    none = np.uint64(1 << 63)
    short, long = shingle_ranks(norm, begin)
    if len(frequent):
        short = np.where(frequent[np.minimum(np.searchsorted(frequent, short), len(frequent) - 1)] == short, none, short)
    low = _sliding_min(short, width - SHORT + 1)[starts]
    rare = low < none
    low = np.where(rare, low, _sliding_min(long, width - LONG + 1)[starts])
    new = np.ones(len(starts), bool)
    new[1:] = (np.diff(starts) != 1) | (np.diff(part[starts]) != 0) | (low[1:] != low[:-1]) | (rare[1:] != rare[:-1])
    at = np.flatnonzero(new)
    new |= (np.arange(len(starts)) - at[np.cumsum(new) - 1]) % RUN == 0
    a = np.flatnonzero(new)
    b = np.append(a[1:], len(starts)) - 1
    low, rare, first, last = low[a], rare[a], starts[a], starts[b]
    again = np.empty(len(a), bool)
    for these, rank, size in ((rare, short, SHORT), (~rare, long, LONG)):
        span = np.arange(width - size + 1)
        for some in np.array_split(np.flatnonzero(these), 1 + len(a) // 65_536):
            left = first[some] + (rank[first[some, None] + span] == low[some, None]).argmax(axis=1)
            right = last[some] + span[-1] - (rank[last[some, None] + span[::-1]] == low[some, None]).argmax(axis=1)
            again[some] = left != right
    joined = norm.tobytes()
    packed = [joined[x:y] for x, y in zip(begin[first].tolist(), stop[last + width - 1].tolist())]
    number, offset = np.array([i for i, _, _ in parts]), np.array([f for _, f, _ in parts]) - (ends - sizes)
    minimiser = np.where(rare, low.astype(np.int64), -1 - low.astype(np.int64))
    return pd.DataFrame({"text": number[part[first]], "start": first + offset[part[first]], "minimiser": minimiser, "packed": packed, "again": again})


def frequent_shingles(docs: DataFrame) -> np.ndarray:
    """Ranks, in order, of the shingles of SHORT words that a sample of texts, chosen by hash, finds frequent.

    The sample has some SAMPLE_WORDS words for each shuffle partition, so the result has FREQUENT_SHARE ranks for each at most,
    whatever the corpus.
    """
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = max(SAMPLE_LEAST, SAMPLE_WORDS * partitions)
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    share = min(1.0, 6.0 * wanted / max(1, size))
    sample = docs.filter(F.pmod(F.xxhash64(F.lit("sample"), "text"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for parts in batches_of_pieces(pdf["text"].tolist(), 0):
                norm, begin, _, sizes = normalised([data for _, _, data in parts])
                whole = np.arange(len(begin)) + SHORT <= np.repeat(np.cumsum(sizes), sizes)
                yield pd.DataFrame({"rank": shingle_ranks(norm, begin)[0][whole].astype(np.int64)})

    counts = sample.select("text").mapInPandas(count, "rank bigint").groupBy("rank").agg(F.count("*").alias("n"))
    least = max(FREQUENT_LEAST, int(min(size / 6.0, wanted)) // (FREQUENT_SHARE * partitions))
    found = counts.filter(F.col("n") >= least).toPandas()
    return np.sort(found["rank"].to_numpy(np.uint64))


def repeated_windows(group: list[tuple[bytes, int, bool]], width: int) -> Iterator[tuple[bytes, bytes]]:
    """(packed, bits) of those super-k-mers of one minimiser, (packed, number of occurrences, again), that hold a window
    found twice or more; bits: 1 for each such window, first window first. Windows are sorted, all or a share by checksum at
    a time."""
    if len(group) == 1 and not group[0][2]:
        packed, n, _ = group[0]
        if n > 1:
            yield packed, np.packbits(np.ones(packed.count(b" ") + 2 - width, bool)).tobytes()
        return
    cuts, total = [], 0
    for packed, _, _ in group:
        blanks = np.flatnonzero(np.frombuffer(packed, np.uint8) == 32)
        begin, stop = np.append(0, blanks + 1)[: len(blanks) + 2 - width], np.append(blanks, len(packed))[width - 1 :]
        cuts.append((begin.tolist(), stop.tolist()))
        total += int((stop - begin).sum()) + 100 * len(begin)
    flags = [bytearray(len(begin)) for begin, _ in cuts]
    passes = 1 + total // SORT_BYTES
    for p in range(passes):
        windows = []
        for k, (begin, stop) in enumerate(cuts):
            packed = group[k][0]
            found = ((packed[x:y], k, i) for i, (x, y) in enumerate(zip(begin, stop)))
            windows += found if passes == 1 else (w for w in found if zlib.crc32(w[0]) % passes == p)
        windows.sort()
        before = None
        for x in windows:
            if before is not None and x[0] == before[0]:
                flags[before[1]][before[2]] = flags[x[1]][x[2]] = 1
            elif group[x[1]][1] > 1:
                flags[x[1]][x[2]] = 1
            before = x
    for (packed, _, _), flag in zip(group, flags):
        if any(flag):
            yield packed, np.packbits(np.frombuffer(flag, np.uint8)).tobytes()


def _digest(packed: bytes) -> bytes:
    return blake2b(packed, digest_size=16).digest()


def _located(docs: DataFrame) -> DataFrame:
    """doc_id, text and the two numbers that stand for both: rows that agree in both are treated alike."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.withColumn("h", F.xxhash64("text")).withColumn("k", F.coalesce("doc_id", F.xxhash64(F.lit("none"), "text")))


def remove_repeats(docs: DataFrame, width: int = 35, tables: Tables | None = None) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, joined by one blank) of every row of docs (doc_id, text).

    A word goes if a window of `width` words around it has a word sequence that also starts anywhere else, in any document,
    this one included. Words are runs without white space (\\x20, \\x09-\\x0D), unchanged. Null and empty texts have none, and
    texts of fewer than `width` words keep all. Repeated rows are documents of their own, each a copy of the other, whether
    doc_id is null or not. Very long texts are taken in parts that overlap, so that no window is lost. Other columns are
    ignored. Empty table: empty result.

    Strings that hold repeated windows come back to their places by 16 bytes of BLAKE2b and the minimiser. They are a table,
    `windows`, that the result reads; a caller who gives `tables` can drop it when the result has been read.
    """
    if width < LONG:
        raise ValueError(f"windows have {LONG} words at least")
    spark = docs.sparkSession
    tables = tables or Tables(spark, "repeats")
    docs = _located(docs)
    frequent = spark.sparkContext.broadcast(frequent_shingles(docs))

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, size = Counter(), 0

        def rows() -> pd.DataFrame:
            return pd.DataFrame({"minimiser": [m for m, _, _ in table], "packed": [p for _, p, _ in table], "again": [x for _, _, x in table], "n": list(table.values())})

        for pdf in batches:
            for parts in batches_of_pieces(pdf["text"].tolist(), width - 1):
                found = super_kmers(parts, width, frequent.value)
                table.update(zip(found["minimiser"].tolist(), found["packed"].tolist(), found["again"].tolist()))
                size += sum(map(len, found["packed"]))
                if size >= TABLE_BYTES:
                    yield rows()
                    table, size = Counter(), 0
        yield rows()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[bytes, int, bool]] = []
        now = None

        def found() -> Iterator[tuple[int, bytes, bytes]]:
            if len(held) > 1 or held and (held[0][1] > 1 or held[0][2]):
                for packed, bits in repeated_windows(held, width):
                    yield now, _digest(packed), bits

        for pdf in batches:
            out = []
            for m, packed, again, n in zip(pdf["minimiser"].tolist(), pdf["packed"].tolist(), pdf["again"].tolist(), pdf["n"].tolist()):
                packed = bytes(packed)
                if m != now:
                    out += found()
                    now, held = m, []
                if held and held[-1][0] == packed:
                    held[-1] = (packed, held[-1][1] + n, again)
                else:
                    held.append((packed, n, again))
            yield pd.DataFrame(out, columns=["minimiser", "digest", "bits"])
        yield pd.DataFrame(list(found()), columns=["minimiser", "digest", "bits"])

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            k, h = pdf["k"].to_numpy(), pdf["h"].to_numpy()
            for parts in batches_of_pieces(pdf["text"].tolist(), width - 1):
                found = super_kmers(parts, width, frequent.value)
                text = found["text"].to_numpy(np.int64)
                yield pd.DataFrame({"minimiser": found["minimiser"], "digest": [_digest(p) for p in found["packed"]], "k": k[text], "h": h[text], "start": found["start"]})

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            kept = kept_words(pdf["text"].tolist(), pdf["marks"].tolist(), width)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].tolist(), **dict(zip(("n_words", "n_removed", "kept"), zip(*kept)))})

    strings = docs.select("text").mapInPandas(gather, "minimiser bigint, packed binary, again boolean, n bigint")
    dealt = strings.repartition("minimiser").sortWithinPartitions("minimiser", "packed")
    repeated = tables.write(dealt.mapInPandas(count, "minimiser bigint, digest binary, bits binary"), "windows")
    at = docs.select("text", "k", "h").mapInPandas(places, "minimiser bigint, digest binary, k bigint, h bigint, start bigint")
    mark = F.concat(F.unhex(F.lpad(F.hex("start"), 16, "0")), "bits")
    marks = at.join(repeated, ["minimiser", "digest"]).groupBy("k", "h").agg(F.collect_set(mark).alias("marks"))
    joined = docs.join(marks, ["k", "h"], "left").select(F.col("doc_id").cast("string").alias("doc_id"), "text", "marks")
    out = joined.mapInPandas(keep, "doc_id string, n_words bigint, n_removed bigint, kept string")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def _gone(marks: list[bytes] | None, width: int) -> np.ndarray | None:
    """Which words windows cover. A mark: 8 bytes of the first word's number (big-endian), then a bit for each window from
    there on, 1 for those that go."""
    if marks is None or not len(marks):
        return None
    starts = np.concatenate([int.from_bytes(m[:8], "big") + np.flatnonzero(np.unpackbits(np.frombuffer(m[8:], np.uint8))) for m in marks])
    step = np.zeros(int(starts.max()) + width + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + width, -1)
    return np.cumsum(step[:-1]) > 0


def kept_words(texts: list, marks: list, width: int) -> list[tuple[int, int, str]]:
    """Of each text, the number of words, of those that go, and the others joined by one blank."""
    gone = [_gone(m, width) for m in marks]
    out: list[list] = [[0, 0, []] for _ in texts]
    for parts in batches_of_pieces(texts, 0):
        norm, begin, _, sizes = normalised([data for _, _, data in parts])
        ends = np.cumsum(sizes)
        stay = np.ones(len(begin), bool)
        for (i, first, _), end, size in zip(parts, ends.tolist(), sizes.tolist()):
            if gone[i] is not None:
                here = gone[i][first : first + size]
                stay[end - size : end - size + len(here)] = ~here
        kept = np.repeat(stay, np.diff(begin, append=len(norm)))
        joined = norm[kept].tobytes()
        bytes_before = np.append(0, np.cumsum(kept))[np.append(begin, len(norm))]
        stays_before = np.append(0, np.cumsum(stay))
        for (i, _, _), end, size in zip(parts, ends.tolist(), sizes.tolist()):
            data = joined[bytes_before[end - size] : bytes_before[end]].rstrip(b" ")
            out[i][0] += size
            out[i][1] += size - int(stays_before[end] - stays_before[end - size])
            out[i][2] += [data] if data else []
    return [(n, m, b" ".join(kept).decode()) for n, m, kept in out]


def op11_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents without the passages of 35 words that occur twice; cases as in remove_repeats."""
    tables = Tables(spark, "repeats")
    out = remove_repeats(documents(spark, sf_dir), width=35, tables=tables)
    out = tables.write(out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")), "removed")
    tables.drop("windows")
    return out
