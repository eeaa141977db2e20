"""Passages of held-out test items inside a training corpus, through one FM-index per shard of it.

A shard is a run of documents of one partition with about ``shard_words`` words. Its words get ids of
their own, its documents are laid end to end with a separator, and an FM-index is built over them. All
phrases of ``words`` consecutive words of the test items are then searched backwards through the
wavelet matrix, their occurrences located by sampled suffix positions, and the occurrences of one item
in one document merged into spans. Shards are independent: nothing is shuffled but the test items.

Defined cases: words are maximal runs of letters and digits of the lower-cased text; null texts, null
ids and items under ``words`` words have no cases; a text longer than a shard is a shard of its own;
repeated documents each have their rows; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.fm_index import FMIndex

WORD = re.compile(r"[^\W_]+")
SPANS = "doc_id long, item_id long, first_word long, last_word long"
#: Items of a test set that are searched in one pass; a larger set takes more passes over the corpus.
ITEMS_PER_PASS = 20_000


def item_phrases(items: list[tuple[int, str]], words: int) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Vocabulary of the items, their distinct phrases as ids of it, and which items hold a phrase."""
    vocabulary: dict[str, int] = {}
    phrases: dict[tuple[int, ...], int] = {}
    owners: list[tuple[int, int]] = []
    for item, text in items:
        ids = [vocabulary.setdefault(w, len(vocabulary)) for w in WORD.findall(text.lower())]
        owners += {(phrases.setdefault(tuple(ids[i : i + words]), len(phrases)), item) for i in range(len(ids) - words + 1)}
    owner = np.array(sorted(owners), np.int64).reshape(-1, 2)
    return list(vocabulary), np.array(list(phrases), np.int64).reshape(-1, words), owner[:, 0], owner[:, 1]


def search_shard(ids: list[int], texts: list[list[str]], vocabulary: list[str], phrases: np.ndarray, owner_phrase: np.ndarray, owner_item: np.ndarray) -> np.ndarray:
    """Merged spans (doc, item, first word, last word) of one shard."""
    none = np.zeros((0, 4), np.int64)
    lengths = np.array([len(t) for t in texts], np.int64)
    flat = np.empty(int(lengths.sum()), object)
    at = 0
    for t in texts:
        flat[at : at + len(t)] = t
        at += len(t)
    codes, names = pd.factorize(flat)
    sigma = len(names) + 1
    starts = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
    symbols = np.zeros(len(flat) + len(texts), np.int64)
    symbols[np.arange(len(flat)) + np.repeat(np.arange(len(texts)), lengths)] = codes + 1
    known = pd.Index(names).get_indexer(vocabulary) + 1
    there = known[phrases]
    possible = np.flatnonzero((there > 0).all(axis=1))
    if not len(possible):
        return none
    index = FMIndex(symbols, sigma)
    low, high = index.search(there[possible])
    counts = high - low
    if not counts.sum():
        return none
    rows = np.repeat(low - np.concatenate([[0], np.cumsum(counts)])[:-1], counts) + np.arange(counts.sum())
    place = index.locate(rows)
    phrase = possible[np.repeat(np.arange(len(possible)), counts)]
    doc = np.searchsorted(starts, place, side="right") - 1
    word = place - starts[doc]
    left, right = np.searchsorted(owner_phrase, phrase, "left"), np.searchsorted(owner_phrase, phrase, "right")
    times = right - left
    pick = np.repeat(left - np.concatenate([[0], np.cumsum(times)])[:-1], times) + np.arange(times.sum())
    doc, word, item = np.repeat(doc, times), np.repeat(word, times), owner_item[pick]
    order = np.lexsort((word, item, doc))
    doc, word, item = doc[order], word[order], item[order]
    length = phrases.shape[1]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (word[1:] > word[:-1] + length)])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(new)]]) - 1
    return np.stack([np.asarray(ids, np.int64)[doc[first]], item[first], word[first], word[last] + length - 1], axis=1)


def leaked_spans(documents: DataFrame, items: DataFrame, words: int = 12, shard_words: int = 600_000) -> DataFrame:
    """Spans of ``documents`` (doc_id, text) that repeat at least ``words`` words of ``items`` (item_id, text)."""
    spark = documents.sparkSession
    wanted = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text")
    total = wanted.count()
    passes = max(1, -(-total // ITEMS_PER_PASS))
    out = None
    for number in range(passes):
        part = wanted if passes == 1 else wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == number)
        tables = spark.sparkContext.broadcast(item_phrases([(r[0], r[1]) for r in part.collect()], words))

        def search(batches: Iterator[pa.RecordBatch], tables=tables) -> Iterator[pa.RecordBatch]:
            vocabulary, phrases, owner_phrase, owner_item = tables.value
            ids: list[int] = []
            texts: list[list[str]] = []
            size = 0

            def flush() -> Iterator[pa.RecordBatch]:
                if ids and len(phrases):
                    spans = search_shard(ids, texts, vocabulary, phrases, owner_phrase, owner_item)
                    yield pa.RecordBatch.from_arrays([pa.array(spans[:, i]) for i in range(4)], names=["doc_id", "item_id", "first_word", "last_word"])

            for batch in batches:
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    found = WORD.findall(text.as_py().lower())
                    ids.append(doc)
                    texts.append(found)
                    size += len(found)
                    if size >= shard_words:
                        yield from flush()
                        ids, texts, size = [], [], 0
            yield from flush()

        rows = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text").mapInArrow(search, SPANS)
        out = rows if out is None else out.unionByName(rows)
    return out


def leaked_items(documents: DataFrame, items: DataFrame, words: int = 12) -> DataFrame:
    """The distinct (doc_id, item_id) of the spans."""
    return leaked_spans(documents, items, words).select("doc_id", "item_id").distinct()
