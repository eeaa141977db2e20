"""Near-duplicate texts by covering locality-sensitive hashing of their word sets.

Two sets of words with sizes a, b and Jaccard similarity of at least t differ in at most
r = (a + b)(1 - t)/(1 + t) words. Texts are put into size classes; the class has one radius r. Words
are hashed into ``p`` blocks, so that two texts within the radius differ in at most rho = floor(r / p)
words of some block. In every block each word gets a random vector m(w) of rho + 1 bits, and each of
the 2^(rho+1) - 1 non-zero masks v keeps the words with an odd number of common bits of m(w) and v. The
vectors of at most rho differing words span less than the whole space, so some mask is orthogonal to
all of them and keeps none: both texts keep the same words under it, and their signatures collide.
No pair within the radius can be missed, whatever the random bits.

A text is hashed in the class of its own size and in the classes a larger partner can lie in. The
signatures of a batch are packed per partition of the signature space: per text its set hash, its size
and a 128-bit parity sketch, whose Hamming distance never exceeds the number of differing words, then
its signatures. There are as many partitions as keep one under ``GROUP_BYTES``, by a count of all
signatures from the histogram of sizes. Texts with equal word sets are one set from the start, so a group
of copies, however large, is one entry. Signatures that a bounded sample of sets shows to be shared by
many times ``run_limit`` sets never enter a partition: they go to the second pass at once, as do runs
longer than ``run_limit`` that are found later. That pass compares pairs of bounded blocks. Candidate pairs are verified on the word sets. Words are compared by
32-bit hashes: two different words of one pair of texts are taken for one in about one of a million pairs.

Defined cases: null contents and contents with fewer than ``min_words`` distinct words take no part;
words are maximal runs of letters and digits of the lower-cased text; repeated ids count once; empty
tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.durable import cut

_CLASS_RATIO = 1.5
#: Bytes of one partition of the signature space, sets in the sample for hot signatures, and how often one
#: has to occur in the sample at least.
GROUP_BYTES, HOT_SAMPLE, HOT_LEAST = 64_000_000, 20_000, 8
_MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


@dataclass(frozen=True)
class SizeClass:
    low: int
    high: int  # exclusive
    radius: int
    blocks: int
    rho: int


def size_class(number: int, min_words: int, threshold: float, kept: float) -> SizeClass:
    low = int(np.ceil(min_words * _CLASS_RATIO**number))
    high = int(np.ceil(min_words * _CLASS_RATIO ** (number + 1)))
    radius = int((1 - threshold) / (1 + threshold) * 2 * (high - 1) + 1e-9)
    options = [(radius // (rho + 1) + 1, rho) for rho in (1, 2, 3, 4)]
    good = [o for o in options if low / (2 * o[0]) >= kept] or options[-1:]
    blocks, rho = min(good, key=lambda o: o[0] * (2 ** (o[1] + 1) - 1))
    return SizeClass(low, high, radius, blocks, rho)


def class_numbers(sizes: np.ndarray, min_words: int) -> np.ndarray:
    """The class of each size, by the same boundaries as ``size_class``."""
    top = max(int(sizes.max(initial=min_words)), min_words)
    bounds = [min_words]
    while bounds[-1] <= top:
        bounds.append(int(np.ceil(min_words * _CLASS_RATIO ** len(bounds))))
    return np.searchsorted(np.array(bounds), sizes, side="right") - 1


def class_signatures(words: np.ndarray, doc: np.ndarray, n_docs: int, number: int, c: SizeClass) -> np.ndarray:
    """Signatures [n_docs, blocks * masks] of the word hashes ``words`` of documents ``doc``."""
    with np.errstate(over="ignore"):
        h = mix(words + np.uint64(0x9E3779B97F4A7C15) * np.uint64(number + 1))
    block = ((h >> np.uint64(33)) % np.uint64(c.blocks)).astype(np.int64)
    vector = ((h >> np.uint64(8)) & np.uint64(2 ** (c.rho + 1) - 1)).astype(np.uint8)
    value = mix(h)
    cell = doc * c.blocks + block
    order = np.argsort(cell, kind="stable")
    cell, vector, value = cell[order], vector[order], value[order]
    first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
    masks = 2 ** (c.rho + 1) - 1
    out = np.zeros((masks, n_docs * c.blocks), np.uint64)
    for mask in range(1, masks + 1):
        odd = (np.bitwise_count(vector & np.uint8(mask)) & 1).astype(bool)
        if len(first):
            out[mask - 1, cell[first]] = np.add.reduceat(np.where(odd, value, np.uint64(0)), first)
    salt = mix(np.arange(masks * c.blocks, dtype=np.uint64) + np.uint64(1000003 * (number + 1))).reshape(masks, 1, c.blocks)
    with np.errstate(over="ignore"):
        mixed = mix(out.reshape(masks, n_docs, c.blocks) + salt)
    return mixed.transpose(1, 0, 2).reshape(n_docs, masks * c.blocks)


def batch_signatures(words: np.ndarray, sizes: np.ndarray, min_words: int, threshold: float, kept: float) -> tuple[np.ndarray, np.ndarray]:
    """(document, signature) of all documents of a batch."""
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    own = class_numbers(sizes, min_words)
    furthest = class_numbers((sizes / threshold + 1e-9).astype(np.int64), min_words)
    docs, signatures = [], []
    for number in range(int(own.min(initial=0)), int(furthest.max(initial=-1)) + 1):
        inside = np.flatnonzero((own <= number) & (number <= furthest))
        if not len(inside):
            continue
        lengths = sizes[inside]
        pick = np.repeat(starts[inside] - np.concatenate([[0], np.cumsum(lengths)])[:-1], lengths) + np.arange(lengths.sum())
        s = class_signatures(words[pick], np.repeat(np.arange(len(inside)), lengths), len(inside), number, size_class(number, min_words, threshold, kept))
        docs.append(np.repeat(inside, s.shape[1]))
        signatures.append(s.ravel())
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(docs), np.concatenate(signatures)


def parity_sketch(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Two 64-bit halves [n, 2]: the parity of the words that fall on each of 128 bits."""
    h = mix(words + np.uint64(77))
    first = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    bit = np.left_shift(np.uint64(1), h & np.uint64(63))
    upper = ((h >> np.uint64(6)) & np.uint64(1)).astype(bool)
    halves = [np.bitwise_xor.reduceat(np.where(upper == half, bit, np.uint64(0)), first) for half in (False, True)]
    return np.stack(halves, axis=1)


def close_pairs(a: np.ndarray, b: np.ndarray, sketch: np.ndarray, sizes: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of indices may reach the threshold, by sizes and by the Hamming distance of sketches."""
    na, nb = sizes[a], sizes[b]
    bound = ((na + nb) * (1 - threshold) / (1 + threshold) + 1e-9).astype(np.int64)
    distance = np.bitwise_count(sketch[a, 0] ^ sketch[b, 0]) + np.bitwise_count(sketch[a, 1] ^ sketch[b, 1])
    return (np.minimum(na, nb) >= threshold * np.maximum(na, nb) - 1e-9) & (distance <= bound)


def dense_pairs(left: np.ndarray, right: np.ndarray, sketch: np.ndarray, sizes: np.ndarray, threshold: float, rows: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """``close_pairs`` of all of ``left`` with all of ``right``, as tables of distances."""
    most = int((1 - threshold) / (1 + threshold) * (int(sizes[left].max()) + int(sizes[right].max())) + 1e-9)
    found_a, found_b = [], []
    second = sketch[right]
    for at in range(0, len(left), rows):
        first = sketch[left[at : at + rows]]
        distance = np.bitwise_count(first[:, None, 0] ^ second[None, :, 0])
        distance += np.bitwise_count(first[:, None, 1] ^ second[None, :, 1])
        i, j = np.nonzero(distance <= most)
        found_a.append(left[at + i])
        found_b.append(right[j])
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    good = close_pairs(a, b, sketch, sizes, threshold)
    return a[good], b[good]


def run_pairs(first: np.ndarray, length: np.ndarray, most: int = 4_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of positions inside runs, in slices of about ``most`` pairs."""
    row = np.repeat(first + length - 1, length) - (np.repeat(first - np.concatenate([[0], np.cumsum(length)])[:-1], length) + np.arange(length.sum()))
    at = np.repeat(first - np.concatenate([[0], np.cumsum(length)])[:-1], length) + np.arange(length.sum())  # each position has ``row`` later ones
    total = np.cumsum(row)
    begin = 0
    while begin < len(at):
        end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + most, side="right")))
        n = row[begin:end]
        left = np.repeat(at[begin:end], n)
        right = left + 1 + np.arange(n.sum()) - np.repeat(np.concatenate([[0], np.cumsum(n)])[:-1], n)
        yield left, right
        begin = end


def word_sets(rows: DataFrame, id_column: str, text_column: str, min_words: int) -> DataFrame:
    """(id, set_hash, words): sorted distinct 32-bit word hashes of texts with enough words."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text_column), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    hashed = F.array_sort(F.transform(words, lambda w: F.hash(w)))
    return (
        rows.where(F.length(text_column) >= 2 * min_words - 1)
        .select(F.col(id_column).cast("long").alias("id"), hashed.alias("words"))
        .where((F.size("words") >= min_words) & F.col("id").isNotNull())
        .select("id", F.xxhash64("words", F.size("words")).alias("set_hash"), "words")
    )


def signature_bytes(sizes: dict[int, int], min_words: int, threshold: float, kept: float) -> int:
    """Bytes of all packed signatures, if no two of a set share a partition. ``sizes``: sets per number of words."""
    total = 0
    for size, sets in sizes.items():
        own, furthest = (int(class_numbers(np.array([n]), min_words)[0]) for n in (size, int(size / threshold + 1e-9)))
        classes = [size_class(number, min_words, threshold, kept) for number in range(own, furthest + 1)]
        total += sets * 36 * sum(c.blocks * (2 ** (c.rho + 1) - 1) for c in classes)
    return total


def hot_signatures(sets: DataFrame, total: int, min_words: int, threshold: float, kept: float, run_limit: int) -> dict[int, int]:
    """Signatures that a sample of at most ``HOT_SAMPLE`` sets shows to have over 4 ``run_limit`` entries, and into how many blocks they go."""
    fraction = min(1.0, HOT_SAMPLE / max(total, 1))
    sample = sets.where(F.pmod(F.xxhash64("set_hash"), F.lit(1_000_000)) < int(fraction * 1_000_000)).select("words").limit(HOT_SAMPLE).toArrow().column("words").combine_chunks()
    least = max(HOT_LEAST, 4 * run_limit * fraction)
    if len(sample) < least:
        return {}
    counts: dict[int, int] = {}
    for at in range(0, len(sample), 1000):
        part = sample.slice(at, 1000)
        words, sizes = part.flatten().to_numpy().astype(np.uint32).astype(np.uint64), part.value_lengths().to_numpy().astype(np.int64)
        there, times = np.unique(batch_signatures(words, sizes, min_words, threshold, kept)[1], return_counts=True)
        # What is as frequent as asked for in all of the sample is so in some slice of it.
        often = times >= least * len(part) / len(sample) / 4
        for signature, n in zip(there[often].tolist(), times[often].tolist(), strict=True):
            counts[signature] = counts.get(signature, 0) + n
    return {signature: -(-int(n / fraction) // (run_limit // 2)) for signature, n in counts.items() if n >= least}


def candidate_sets(sets: DataFrame, min_words: int, threshold: float, kept: float, run_limit: int, parts: int | None = None) -> DataFrame:
    """Pairs (a, b) of set hashes that collide under a mask and pass the sketch; ``sets`` holds each set once."""
    spark = sets.sparkSession
    sizes = {r["n"]: r["count"] for r in sets.groupBy(F.size("words").alias("n")).count().collect()}
    parts = parts or max(spark.sparkContext.defaultParallelism, -(-signature_bytes(sizes, min_words, threshold, kept) // GROUP_BYTES))
    frequent = hot_signatures(sets, sum(sizes.values()), min_words, threshold, kept, run_limit)
    hot_keys = np.array(sorted(frequent), np.uint64)
    hot_blocks = np.array([frequent[k] for k in sorted(frequent)], np.int32)

    def hot_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            array = batch.column(1)
            words, sizes = array.flatten().to_numpy().astype(np.uint32).astype(np.uint64), array.value_lengths().to_numpy().astype(np.int64)
            if not len(sizes):
                continue
            doc, signature = batch_signatures(words, sizes, min_words, threshold, kept)
            at = np.minimum(np.searchsorted(hot_keys, signature), len(hot_keys) - 1)
            is_hot = hot_keys[at] == signature
            doc, at, sketch = doc[is_hot], at[is_hot], parity_sketch(words, sizes).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hot_keys[at].view(np.int64)), pa.array(batch.column(0).to_numpy()[doc]), pa.array(sketch[doc, 0].copy()), pa.array(sketch[doc, 1].copy()), pa.array(sizes[doc].astype(np.int32)), pa.array(hot_blocks[at])],
                names=["run", "a", "low_sketch", "high_sketch", "size", "blocks"],
            )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            array = batch.column(1)
            words, sizes = array.flatten().to_numpy().astype(np.uint32).astype(np.uint64), array.value_lengths().to_numpy().astype(np.int64)
            sketch = parity_sketch(words, sizes)
            hashes = batch.column(0).to_numpy()
            doc, signature = batch_signatures(words, sizes, min_words, threshold, kept)
            if len(hot_keys):
                cold = hot_keys[np.minimum(np.searchsorted(hot_keys, signature), len(hot_keys) - 1)] != signature
                doc, signature = doc[cold], signature[cold]
            part = (signature % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part * len(sizes) + doc, kind="stable")
            doc, part, key = doc[order], part[order], (signature[order] >> np.uint64(32)).astype(np.uint32)
            bounds = np.searchsorted(part, np.arange(parts + 1))
            numbers, blobs = [], []
            for p in np.flatnonzero(np.diff(bounds)).tolist():
                d, k = doc[bounds[p] : bounds[p + 1]], key[bounds[p] : bounds[p + 1]]
                there, counts = np.unique(d, return_counts=True)
                head = np.array([len(there), len(k)], np.uint32)
                numbers.append(p)
                blobs.append(b"".join(x.tobytes() for x in (head, hashes[there], sketch[there, 0], sketch[there, 1], sizes[there].astype(np.uint32), counts.astype(np.uint32), k)))
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "blob"])

    def unpack(blobs: list[bytes]) -> tuple[np.ndarray, ...]:
        columns: list[list[np.ndarray]] = [[], [], [], [], []]
        for blob in blobs:
            n, k = np.frombuffer(blob, np.uint32, 2)
            at = 8
            parts_of = []
            for kind, count in ((np.int64, n), (np.uint64, n), (np.uint64, n), (np.uint32, n), (np.uint32, n), (np.uint32, k)):
                parts_of.append(np.frombuffer(blob, kind, count, at))
                at += np.dtype(kind).itemsize * int(count)
            times = parts_of[4].astype(np.int64)
            for c in range(4):
                columns[c].append(np.repeat(parts_of[c], times))
            columns[4].append(parts_of[5])
        return tuple(np.concatenate(c) for c in columns)

    names = ["a", "b", "run", "low_sketch", "high_sketch", "size", "blocks"]
    schema = "a long, b long, run long, low_sketch long, high_sketch long, size int, blocks int"

    def collide_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task holds one partition of the signature space; were it given more, it would take them in turn."""
        blobs: dict[int, list[bytes]] = {}
        for batch in batches:
            for number, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                blobs.setdefault(number, []).append(blob)
        for number in sorted(blobs):
            yield from collide(number, blobs.pop(number)).to_batches()

    def collide(number: int, blobs: list[bytes]) -> pa.Table:
        hashes, low, high, sizes, keys = unpack(blobs)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        length = np.diff(np.concatenate([start, [len(keys)]]))
        many = length > 1
        start, length = start[many], length[many]
        hot, dense = length > run_limit, length > 24
        hashes, sizes = hashes[order], sizes[order].astype(np.int64)
        sketch = np.stack([low[order], high[order]], axis=1)
        pairs = [np.zeros((0, 2), np.int64)]

        def keep(x: np.ndarray, y: np.ndarray) -> None:
            x, y = hashes[x], hashes[y]
            pairs.append(np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0))

        for left, right in run_pairs(start[~dense], length[~dense]):
            good = close_pairs(left, right, sketch, sizes, threshold)
            keep(left[good], right[good])
        for s, n in zip(start[dense & ~hot].tolist(), length[dense & ~hot].tolist(), strict=True):
            at = np.arange(s, s + n)
            left, right = dense_pairs(at, at, sketch, sizes, threshold)
            keep(left[left < right], right[left < right])
        found = np.unique(np.concatenate(pairs), axis=0)
        found = found[found[:, 0] != found[:, 1]]
        rows = [pa.array(found[:, 0]), pa.array(found[:, 1]), *(pa.nulls(len(found), t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()))]
        out = [pa.Table.from_arrays(rows, names=names)]
        for s, n in zip(start[hot].tolist(), length[hot].tolist(), strict=True):
            part = slice(s, s + n)
            columns = [pa.array(hashes[part]), pa.nulls(n, pa.int64()), pa.array(np.full(n, number * 2**32 + int(keys[s]), np.int64)), pa.array(sketch[part, 0].copy().view(np.int64)), pa.array(sketch[part, 1].copy().view(np.int64)), pa.array(sizes[part].astype(np.int32)), pa.array(np.full(n, -(-n // (run_limit // 2)), np.int32))]
            out.append(pa.Table.from_arrays(columns, names=names))
        return pa.concat_tables(out)

    def compare(key: tuple, group: pa.Table) -> pa.Table:
        i, j = key[1].as_py(), key[2].as_py()
        own, hashes = group.column("own").to_numpy(), group.column("a").to_numpy()
        sketch = np.stack([group.column(c).to_numpy().view(np.uint64) for c in ("low_sketch", "high_sketch")], axis=1)
        sizes = group.column("size").to_numpy().astype(np.int64)
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        if not len(left) or not len(right):
            return pa.Table.from_arrays([pa.array([], pa.int64())] * 2, names=["a", "b"])
        x, y = dense_pairs(left, right, sketch, sizes, threshold)
        x, y = hashes[x], hashes[y]
        x, y = np.minimum(x, y)[x != y], np.maximum(x, y)[x != y]
        return pa.Table.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

    packed = sets.select("set_hash", "words").mapInArrow(pack, "part int, blob binary")
    collided = cut(packed.repartitionById(parts, "part").mapInArrow(collide_all, schema))
    columns = ["run", "a", "low_sketch", "high_sketch", "size", "blocks"]
    hot = collided.where(F.col("b").isNull()).select(columns)
    if frequent:
        hot = hot.unionByName(sets.select("set_hash", "words").mapInArrow(hot_rows, "run long, a long, low_sketch long, high_sketch long, size int, blocks int"))
    hot = hot.distinct()
    own = F.pmod(F.xxhash64("a"), F.col("blocks").cast("long")).cast("int")
    spread = hot.select("run", "a", "low_sketch", "high_sketch", "size", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "run", "a", "low_sketch", "high_sketch", "size", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")
    )
    slow = spread.groupBy("run", "i", "j").applyInArrow(compare, "a long, b long")
    return collided.where(F.col("b").isNotNull()).select("a", "b").unionByName(slow).distinct()


def similar_sets(rows: DataFrame, id_column: str = "id", text_column: str = "content", min_words: int = 20, threshold: float = 0.8, kept: float = 5.5, run_limit: int = 4000) -> tuple[DataFrame, DataFrame]:
    """Members (id, set_hash) and verified pairs (a, b, similarity) of different word sets."""
    base = cut(word_sets(rows, id_column, text_column, min_words))
    sets = base.groupBy("set_hash").agg(F.first("words").alias("words"))
    pairs = candidate_sets(sets, min_words, threshold, kept, run_limit)
    with_a = pairs.join(sets.select(F.col("set_hash").alias("a"), F.col("words").alias("words_a")), "a")
    both = with_a.join(sets.select(F.col("set_hash").alias("b"), F.col("words").alias("words_b")), "b")
    common = F.size(F.array_intersect("words_a", "words_b"))
    verified = both.select("a", "b", (common / (F.size("words_a") + F.size("words_b") - common)).alias("similarity")).where(F.col("similarity") >= threshold)
    return base.select("id", "set_hash").distinct(), verified


def similar_pairs(rows: DataFrame, **options) -> DataFrame:
    """All pairs of ids (a < b) whose sets reach the threshold, copies included."""
    members, verified = similar_sets(rows, **options)
    m = members.select(F.col("set_hash"), F.col("id"))
    equal = m.alias("x").join(m.alias("y"), (F.col("x.set_hash") == F.col("y.set_hash")) & (F.col("x.id") < F.col("y.id"))).select(F.col("x.id").alias("a_id"), F.col("y.id").alias("b_id"))
    one = verified.join(m.select(F.col("set_hash").alias("a"), F.col("id").alias("x")), "a").join(m.select(F.col("set_hash").alias("b"), F.col("id").alias("y")), "b")
    return equal.unionByName(one.select(F.least("x", "y").alias("a_id"), F.greatest("x", "y").alias("b_id")))
