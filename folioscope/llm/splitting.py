"""Cutting oversized texts at natural boundaries by pointer doubling.

Every place where a text may be cut is a node: headings, blank lines, lines, sentence ends, word ends
and, inside stretches without any of these, a lattice of hard cuts. A cut ``b`` lets the next piece
begin ``overlap`` characters before it, so the legal successors of ``b`` are the nodes up to
``b - overlap + limit``; the farthest node of the best kind in the upper half of that range is its
successor. All nodes of all texts of a batch form one successor table. Squaring the table while
following it from the beginnings marks all greedy cuts in a number of rounds that is the logarithm of
the number of pieces.

Defined cases: null texts and texts of at most ``limit`` characters yield no pieces; characters are
Unicode code points; pieces end within a word only where a word is longer than a piece; each piece
after the first starts exactly ``overlap`` characters before the end of the last one; repeated rows
each yield their pieces; extra columns pass through the caller's join only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds of boundaries, best first. The cut is made at the end of the match.
BOUNDARIES = (
    re.compile(r"\n+(?=#{1,6}\s)"),
    re.compile(r"\n[ \t]*\n\s*"),
    re.compile(r"\n"),
    re.compile(r"[.!?…][\"“”»')\]]*\s+"),
    re.compile(r"\s+"),
)


def cut_batch(texts: list[str], limit: int, overlap: int) -> list[list[int]]:
    """The cuts of each text: ends of its pieces, the last being its length."""
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be under half of limit")
    nodes, kinds, owner = [], [], []
    for number, text in enumerate(texts):
        kind_of: dict[int, int] = {}
        for kind, pattern in enumerate(BOUNDARIES):
            for m in pattern.finditer(text):
                kind_of.setdefault(m.end(), kind)
        kind_of.pop(0, None)
        kind_of[len(text)] = 0
        places = np.array(sorted(kind_of), np.int64)
        gaps = np.diff(np.concatenate([[0], places]))
        for i in np.flatnonzero(gaps > (limit - overlap) // 2):
            for hard in range(int(places[i] - gaps[i]) + (limit - overlap) // 2, int(places[i]), (limit - overlap) // 2):
                kind_of.setdefault(hard, len(BOUNDARIES))
        places = np.array([0, *sorted(kind_of)], np.int64)
        nodes.append(places)
        kinds.append(np.array([len(BOUNDARIES), *(kind_of[p] for p in places[1:].tolist())], np.int64))
        owner.append(np.full(len(places), number))
    if not nodes:
        return []
    lengths = np.array([len(t) for t in texts], np.int64)
    base = np.concatenate([[0], np.cumsum(lengths + 2 * limit)])[:-1]  # texts lie too far apart for a successor in another
    place, kind, owner = np.concatenate(nodes), np.concatenate(kinds), np.concatenate(owner)
    at = place + base[owner]
    start = np.where(place == 0, at, at - overlap)
    high, low = start + limit, np.maximum(start + limit // 2, at)
    end_of_text = base[owner] + lengths[owner]
    ids = np.arange(len(at))
    successor = np.full(len(at), -1, np.int64)
    ending = high >= end_of_text
    successor[ending] = np.searchsorted(at, end_of_text[ending])
    for best in range(len(BOUNDARIES) + 1):
        of_kind = ids[kind == best]
        if len(of_kind):
            pick = np.searchsorted(at[of_kind], high, side="right") - 1
            found = (successor < 0) & (pick >= 0)
            candidate = of_kind[np.maximum(pick, 0)]
            found &= at[candidate] > low
            successor[found] = candidate[found]
    rest = successor < 0  # nothing in the upper half: the farthest node after the cut at all
    pick = np.searchsorted(at, high, side="right") - 1
    successor[rest] = pick[rest]
    reached = np.flatnonzero(place == 0)
    table = successor
    while True:
        more = np.unique(np.concatenate([reached, table[reached]]))
        if len(more) == len(reached):
            break
        reached, table = more, table[table]
    cuts: list[list[int]] = [[] for _ in texts]
    for node in reached.tolist():
        if place[node] > 0:
            cuts[owner[node]].append(int(place[node]))
    return cuts


def split_oversized(rows: DataFrame, id_column: str = "id", text_column: str = "content", limit: int = 1500, overlap: int = 150) -> DataFrame:
    """Pieces (chunk_id, piece_idx, start_char, end_char, piece) of the texts over ``limit`` characters."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out: list[tuple] = []
            for chunk, text, cuts in zip(ids, texts, cut_batch(texts, limit, overlap), strict=True):
                begin = 0
                for number, end in enumerate(cuts):
                    out.append((chunk, number, begin, end, text[begin:end]))
                    begin = end - overlap
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), *(pa.array(c, pa.int32()) for c in columns[1:4]), pa.array(columns[4], pa.string())],
                names=["chunk_id", "piece_idx", "start_char", "end_char", "piece"],
            )

    long = rows.where(F.length(text_column) > limit).select(F.col(id_column).cast("long"), text_column)
    return long.mapInArrow(split, "chunk_id long, piece_idx int, start_char int, end_char int, piece string")
