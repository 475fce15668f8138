"""Evaluation texts inside training text.

The n-grams of the held-out items, n consecutive words or a whole shorter item,
are hashed into a set that goes to every task. Tasks slide windows over their
documents' words, look the window hashes up, and compare the words of each hit.
A set that is too large to be sent is sent as a filter of fixed size; the windows
that pass it are joined with the n-grams by a shuffle and compared there. Either
way the documents are read once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.session import written

WORD = re.compile(r"[a-z0-9]+")
#: Words of items up to which the set itself is sent to the tasks: 24 bytes a word, so some 100 MB.
BROADCAST_WORDS = 4_000_000
#: Bits of the filter that is sent for a larger set: 32 MB.
FILTER_BITS = 28
_BASE = 0x9E3779B97F4A7C15


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def _word_hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word)


def _windows(values: np.ndarray, size: int) -> np.ndarray:
    """Hash of each window of ``size`` words, given the words' own."""
    count = len(values) - size + 1
    total = np.zeros(max(count, 0), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size if count > 0 else 0):
            total += values[k : k + count] * np.uint64(pow(_BASE, k, 1 << 64))
    return total


def _joined(texts: list[str | None], hash_of) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, a zero after each text, and where each text starts."""
    values: list[int] = []
    starts = np.zeros(len(texts) + 1, np.int64)
    for i, t in enumerate(texts):
        if t:
            values += map(hash_of, WORD.findall(t.lower()))
            values.append(0)  # a word of no item: windows don't reach over the end of a text
        starts[i + 1] = len(values)
    return np.array(values, np.uint64), starts


class NgramSet:
    """The n-grams of some items as flat arrays: the items' words one after the other, and by length (``n``, or that of a
    shorter item) the sorted hashes of the n-grams with their places."""

    def __init__(self, items: list[tuple[int, str]], n: int):
        self.n = n
        vocabulary: dict[str, int] = {}
        flat: list[int] = []
        begin, owner = [], []
        for item, text in items:
            ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text)]
            if ids:
                begin.append(len(flat))
                owner.append(item)
                flat += ids
        self.vocabulary = vocabulary
        self.value = np.zeros(len(vocabulary) + 1, np.uint64)
        self.value[1:] = np.fromiter(map(_word_hash, vocabulary), np.uint64, len(vocabulary))
        self.flat, begin = np.array(flat, np.int32), np.array(begin, np.int64)
        self.owner = np.array(owner, np.int64)
        self.begin = begin
        lengths = np.diff(np.append(begin, len(flat)))
        self.hashes, self.place, self.filter, self.shift = {}, {}, {}, {}
        for size in np.unique(np.minimum(lengths, n)).tolist():
            own = np.flatnonzero(lengths == size) if size < n else np.flatnonzero(lengths >= n)
            count = lengths[own] - size + 1
            place = np.repeat(begin[own] - np.cumsum(count) + count, count) + np.arange(count.sum())
            h = _windows(self.value[self.flat], size)[place]
            order = np.argsort(h, kind="stable")
            self.hashes[size], self.place[size] = h[order], place[order].astype(np.int32)
            bits = min(22, len(h).bit_length() + 4)
            self.shift[size], self.filter[size] = np.uint64(64 - bits), np.zeros(1 << bits, bool)
            self.filter[size][h >> self.shift[size]] = True

    def hits(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, list[int]]]:
        """(text's place, first word, size, items) for each window that is an n-gram of some items, its words compared."""
        look = self.vocabulary.get
        ids, starts = _joined(texts, lambda w: look(w, 0))
        ids = ids.astype(np.int32)
        values = self.value[ids]
        for size, known in self.hashes.items():
            h = _windows(values, size)
            at = np.flatnonzero(self.filter[size][h >> self.shift[size]])
            lo = np.searchsorted(known, h[at], "left")
            some = lo < len(known)
            some[some] = known[lo[some]] == h[at[some]]
            at, lo = at[some], lo[some]
            count = np.searchsorted(known, h[at], "right") - lo
            which = np.repeat(np.arange(len(at)), count)
            place = self.place[size][np.repeat(lo - np.cumsum(count) + count, count) + np.arange(len(which))].astype(np.int64)
            same = np.ones(len(which), bool)
            for k in range(size):
                same &= self.flat[place + k] == ids[at[which] + k]
            which, place = which[same], place[same]
            items = self.owner[np.searchsorted(self.begin, place, "right") - 1]
            text = np.searchsorted(starts, at, "right") - 1
            edges = np.flatnonzero(np.diff(which, prepend=-1, append=len(at)))
            for a, z in zip(edges[:-1].tolist(), edges[1:].tolist()):
                p = int(at[which[a]])
                t = int(text[which[a]])
                yield t, p - int(starts[t]), size, items[a:z].tolist()


def _scan(batches: Iterator[pa.RecordBatch], grams: NgramSet) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys, texts = b.column(0), b.column(1).to_pylist()
        found: dict[tuple[int, int], list[int]] = {}
        for text, first, size, items in grams.hits(texts):
            for item in set(items):
                span = found.setdefault((text, item), [first, first + size, 0])
                span[2] += 1
                span[0], span[1] = min(span[0], first), max(span[1], first + size)
        if found:
            at = list(found)
            spans = list(found.values())
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array([t for t, _ in at])), pa.array([i for _, i in at], pa.int64()), *(pa.array([s[k] for s in spans], pa.int64()) for k in range(3))],
                ["doc_id", "item_id", "first_word", "end_word", "n_windows"],
            )


def _items(items: DataFrame) -> DataFrame:
    rows = items.select(F.col("item_id").cast("bigint").alias("item_id"), "item_text")
    return rows.where("item_id is not null and item_text is not null").distinct()


def _sent(items: DataFrame, n: int) -> NgramSet | None:
    """The set of the items' n-grams, made on the driver where their words, counted first, are few enough to be sent."""
    words = items.select(F.sum(F.size(F.regexp_extract_all(F.lower("item_text"), F.lit("([a-z0-9]+)")))).alias("n")).first().n
    if (words or 0) > BROADCAST_WORDS:
        return None
    return NgramSet([(r.item_id, r.item_text) for r in items.toLocalIterator()], n)


# The way for sets that are too large to be sent.


def _ngrams(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """(size, h, words, item_id) of the n-grams of batches (item_id, item_text)."""
    for b in batches:
        out: list[tuple] = []
        for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            words = words_of(text)
            size = min(n, len(words))
            if size:
                h = _windows(np.array([_word_hash(w) for w in words], np.uint64), size)
                out += [(size, x, " ".join(words[i : i + size]), item) for i, x in enumerate(h.view(np.int64).tolist())]
        for a in range(0, len(out), 50_000):
            size, h, words, item = zip(*out[a : a + 50_000])
            yield pa.RecordBatch.from_arrays([pa.array(size, pa.int32()), pa.array(h, pa.int64()), pa.array(words), pa.array(item, pa.int64())], ["size", "h", "words", "item_id"])


def _partial_filters(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """(word of the filter, its bits) of batches (size, h)."""
    for b in batches:
        h = b.column(1).to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - bits)
        at, inverse = np.unique(h >> np.uint64(6), return_inverse=True)
        value = np.zeros(len(at), np.uint64)
        np.bitwise_or.at(value, inverse, np.uint64(1) << (h & np.uint64(63)))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(value.view(np.int64))], ["at", "bits"])


def _filter(grams: DataFrame, bits: int) -> np.ndarray:
    """The filter as an array of fixed size, whatever the number of n-grams; its words are merged before they are fetched."""
    part = grams.select("size", "h").mapInArrow(lambda b: _partial_filters(b, bits), "at bigint, bits bigint")
    merged = part.groupBy("at").agg(F.bit_or("bits").alias("bits"))
    out = np.zeros(max(1, 1 << (bits - 6)), np.uint64)
    for batch in merged.toArrow().to_batches():
        out[batch.column(0).to_numpy()] = batch.column(1).to_numpy().view(np.uint64)
    return out


def _candidates(batches: Iterator[pa.RecordBatch], known, bits: int, sizes: list[int]) -> Iterator[pa.RecordBatch]:
    """(doc, size, h, words, first) of the windows of batches (doc, text) that pass the filter."""
    known = known.value
    for b in batches:
        docs, texts = b.column(0), b.column(1).to_pylist()
        values, starts = _joined(texts, _word_hash)
        out: list[tuple] = []
        split: dict[int, list[str]] = {}
        for size in sizes:
            h = _windows(values, size)
            x = h >> np.uint64(64 - bits)
            at = np.flatnonzero(known[(x >> np.uint64(6)).astype(np.int64)] >> (x & np.uint64(63)) & np.uint64(1))
            text = np.searchsorted(starts, at, "right") - 1
            for p, t, x in zip((at - starts[text]).tolist(), text.tolist(), h[at].view(np.int64).tolist()):
                if t not in split:
                    split[t] = words_of(texts[t])
                if p + size <= len(split[t]):
                    out.append((t, size, x, " ".join(split[t][p : p + size]), p))
        for a in range(0, len(out), 50_000):
            t, size, x, words, first = zip(*out[a : a + 50_000])
            yield pa.RecordBatch.from_arrays(
                [docs.take(pa.array(t)), pa.array(size, pa.int32()), pa.array(x, pa.int64()), pa.array(words), pa.array(first, pa.int64())], ["doc", "size", "h", "words", "first"]
            )


def _joined_hits(rows: DataFrame, doc_type: str, items: DataFrame, n: int) -> DataFrame:
    """(doc, item_id, first, end) of the windows of ``rows`` (doc, text) that are n-grams of items, by a join on their hashes.
    What is joined are windows that pass the filter; each row is an n-gram of one item, its words compared as text."""
    spark: SparkSession = rows.sparkSession
    grams = written(items.mapInArrow(lambda b: _ngrams(b, n), "size int, h bigint, words string, item_id bigint").distinct())
    sizes = sorted(r.size for r in grams.select("size").distinct().collect())  # n numbers at most
    bits = FILTER_BITS
    known = spark.sparkContext.broadcast(_filter(grams, bits))
    windows = rows.mapInArrow(lambda b: _candidates(b, known, bits, sizes), f"doc {doc_type}, size int, h bigint, words string, first bigint")
    return windows.join(grams, ["size", "h", "words"]).select("doc", "item_id", "first", (F.col("first") + F.col("size")).alias("end"))


def leaked_passages(documents: DataFrame, items: DataFrame, n: int = 13) -> DataFrame:
    """Rows (doc_id, item_id, first_word, end_word, n_windows): the documents that share at least ``n`` consecutive
    words with an item, or, of an item of fewer than ``n`` words, hold all of it in a row.

    Words are the runs of a-z and 0-9 after lower-casing. first_word and end_word (exclusive, counted from 0) enclose the
    windows found, n_windows is their number. ``documents`` (doc_id, text), ``items`` (item_id, item_text). Defined
    results: null and empty texts and items without words match nothing; repeated documents come out once, with
    the widest figures among them; an item that occurs twice counts once, two texts of one item_id count as one item;
    empty tables give an empty result; other columns are ignored.

    The documents are read once and in place; only hits are shuffled. The set goes to the tasks up to
    BROADCAST_WORDS words of items; beyond that a filter of fixed size does, and the windows that pass it are joined.
    """
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("text is not null and doc_id is not null")
    schema = "doc_id bigint, item_id bigint, first_word bigint, end_word bigint, n_windows bigint"
    items = _items(items)
    grams = _sent(items, n)
    if grams is not None:
        sent = rows.sparkSession.sparkContext.broadcast(grams)
        found = rows.mapInArrow(lambda b: _scan(b, sent.value), schema)
    else:
        hits = _joined_hits(rows.select(F.col("doc_id").alias("doc"), "text"), "bigint", items, n)
        found = hits.groupBy(F.col("doc").alias("doc_id"), "item_id").agg(F.min("first").alias("first_word"), F.max("end").alias("end_word"), F.count_distinct("first").alias("n_windows"))
    return found.groupBy("doc_id", "item_id").agg(F.min("first_word").alias("first_word"), F.max("end_word").alias("end_word"), F.max("n_windows").alias("n_windows"))


def _without(text: str, own: set[tuple[int, int]]) -> tuple[str, int]:
    """A text without the words of the spans (first, end), and how many they are."""
    # lower() may change a text's length; positions are then those of the lowered text.
    low = text.lower()
    base = text if len(low) == len(text) else low
    words = list(WORD.finditer(low))
    gone = sorted({w for a, z in own for w in range(a, z)})
    out, at, k = [], 0, 0
    while k < len(gone):
        j = k
        while j + 1 < len(gone) and gone[j + 1] == gone[j] + 1:
            j += 1
        out.append(base[at : words[gone[k]].start()])
        at, k = words[gone[j]].end(), j + 1
    return "".join(out) + base[at:], len(gone)


def _cut(batches: Iterator[pa.RecordBatch], grams: NgramSet | None) -> Iterator[pa.RecordBatch]:
    """Batches (doc_id, text) or, without ``grams``, (doc_id, text, spans), the spans taken out of the texts."""
    for b in batches:
        texts = b.column(1).to_pylist()
        spans: dict[int, set[tuple[int, int]]] = {}
        if grams is None:
            spans = {i: {(x["first"], x["end"]) for x in own} for i, own in enumerate(b.column(2).to_pylist()) if own}
        else:
            for text, first, size, _ in grams.hits(texts):
                spans.setdefault(text, set()).add((first, first + size))
        removed = [0] * len(texts)
        for i, own in spans.items():
            texts[i], removed[i] = _without(texts[i], own)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(removed, pa.int64())], ["doc_id", "text", "n_words_removed"])


def without_passages(documents: DataFrame, items: DataFrame, n: int = 13) -> DataFrame:
    """Rows (doc_id, text, n_words_removed): every document, its leaked passages taken out of the text.

    Null texts stay null. A set that is sent is cut in the scan that finds it. Beyond BROADCAST_WORDS the spans of the
    joined hits are brought back to the documents by a SHA-256 of their text, which reads them a second time.
    """
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    schema = "doc_id bigint, text string, n_words_removed bigint"
    items = _items(items)
    grams = _sent(items, n)
    if grams is not None:
        sent = rows.sparkSession.sparkContext.broadcast(grams)
        return rows.mapInArrow(lambda b: _cut(b, sent.value), schema)
    keyed = rows.withColumn("doc", F.sha2("text", 256))
    hits = _joined_hits(keyed.where("text is not null").select("doc", "text"), "string", items, n)
    spans = written(hits.groupBy("doc").agg(F.collect_set(F.struct("first", "end")).alias("spans")))
    return keyed.join(spans, "doc", "left").select("doc_id", "text", "spans").mapInArrow(lambda b: _cut(b, None), schema)
