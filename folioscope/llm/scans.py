"""Noise in text read from scanned pages: found per kind, and repaired into continuous paragraphs.

1. Layout. A chunk is taken for a page if its prose is set in lines of similar width that run on, and
   not in whole paragraphs. Lines that hold only a page number, words divided at a line end, and lines
   that may be running headers are read off the layout. A header repeats in its document or has the
   form of a title beside a name; repeats are counted over all chunks of a ``ref``.
2. Lexicon. Words are counted over all distinct texts, so copies of a page weigh as one. Words of pages are suspects of every word that is far
   more frequent. Both sides are mapped to shapes, which confusions don't change, and meet in a
   symmetric-delete index: each is entered under its shape and under each deletion of it.
3. Verification. A candidate counts if the weighted edit distance is under ``MOST_COST``; confusion
   pairs of scanners are cheap, other edits are not. A digit or apostrophe between the letters of a word
   of a page is a misread in itself. Where several candidates remain, counts of the bigram with the
   preceding word decide.

Defined cases: null contents have no cases and no repair; texts that are not pages come back as no row;
words under four letters are left alone, as too much is like them;
a hyphen before "und", "or" and the like is no division; repeated rows each have their rows; empty tables
give no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from folioscope.durable import cut

PAGE_NUMBER = re.compile(r"^[ \t\f]*(?:[-—–]\s*\d{1,4}\s*[-—–]|\[\s*\d{1,4}\s*\]|(?:S\.|Seite|Page|Pág\.|p\.|Bl\.)\s*\d{1,4}(?:\s+(?:von|of|de|sur)\s+\d{1,4})?|\d{1,4}|\d{1,4}\s?/\s?\d{1,4})[ \t]*$")
HYPHEN = re.compile(r"([^\W\d_]+)([-­¬‐])[ \t]*$")
_NOT_DIVIDED = {"und", "oder", "bzw", "sowie", "bis", "and", "or", "to", "y", "o", "e", "u", "et", "ou", "als", "noch"}
_MARKDOWN = re.compile(r"^\s*(?:[-*•+]\s|#{1,6}\s|\||\d{1,3}[.)]\s|```|>)")
_TREE = re.compile(r"[├└]─|│")
#: What scanners take for what, (read, meant, cost).
CONFUSIONS = (("c", "e", 0.2), ("v", "u", 0.2), ("9", "g", 0.2), ("5", "s", 0.2), ("1", "i", 0.2), ("1", "l", 0.2), ("0", "o", 0.2), ("li", "h", 0.2), ("rn", "m", 0.2), ("ii", "ü", 0.2), ("a'", "ä", 0.2), ("o'", "ö", 0.2), ("u'", "ü", 0.2), ("B", "ß", 0.2), ("8", "B", 0.2), ("cl", "d", 0.3), ("vv", "w", 0.3), ("6", "b", 0.3))
MOST_COST = 0.7
_PAIRED = tuple(c for c in CONFUSIONS if len(c[0]) == 2)
_INNER = re.compile(r"[^\W\d_][0158969]+[^\W\d_]|[^\W\d_]{2}[0159](?=$)|^[0158](?=[^\W\d_]{3})|[aouAOU]'[^\W\d_]{2}")
_TOKEN = re.compile(r"[^\W_]+(?:'[^\W_]+)*")


def fold(word: str) -> str:
    """Multi-character confusions made one character, single ones made the character that is meant."""
    out = word.replace("a'", "ä").replace("o'", "ö").replace("u'", "ü").lower()
    for read, meant, _ in _PAIRED:
        if "'" not in read:
            out = out.replace(read, meant)
    return out.translate(_FOLD)


_FOLD = str.maketrans({"c": "e", "v": "u", "9": "g", "5": "s", "1": "i", "l": "i", "0": "o", "8": "b", "6": "b", "ß": "b"})


def deletions(word: str) -> list[str]:
    return list({word, *(word[:i] + word[i + 1 :] for i in range(len(word)))})


def edit_cost(read: str, meant: str) -> float:
    """Weighted edit distance in which confusion pairs are cheap."""
    a, b = read, meant
    most = 9.0
    rows = [[most] * (len(b) + 1) for _ in range(len(a) + 1)]
    rows[0][0] = 0.0
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            here = rows[i][j]
            if here >= most:
                continue
            if i < len(a) and j < len(b):
                same = 0.0 if a[i] == b[j] else 0.3 if a[i].lower() == b[j].lower() else 1.0
                rows[i + 1][j + 1] = min(rows[i + 1][j + 1], here + same)
            if i < len(a):
                rows[i + 1][j] = min(rows[i + 1][j], here + 1.0)
            if j < len(b):
                rows[i][j + 1] = min(rows[i][j + 1], here + 1.0)
            for r, m, cost in CONFUSIONS:
                if a.startswith(r, i) and b.startswith(m, j):
                    x, y = i + len(r), j + len(m)
                    rows[x][y] = min(rows[x][y], here + cost)
    return rows[-1][-1]


def is_page(lines: list[str]) -> bool:
    """Prose in lines of similar width that run on."""
    prose = [x.rstrip() for x in lines if x.strip() and not PAGE_NUMBER.match(x)]
    if len(prose) < 3 or sum(bool(_MARKDOWN.match(x)) or bool(_TREE.search(x)) for x in prose) > 0.1 * len(prose):
        return False
    widths = [len(x) for x in prose[:-1]]
    widest = sorted(widths)[int(0.9 * (len(widths) - 1))]
    if not 25 <= widest <= 110 or max(widths) > 130:
        return False
    return sum(w >= 0.6 * widest for w in widths) >= 0.7 * len(widths)


def normal_line(line: str) -> str:
    return " ".join(fold(w) for w in _TOKEN.findall(line))


def _may_be_header(line: str) -> bool:
    s = line.strip("\f ").rstrip()
    return 8 <= len(s) <= 110 and not re.search(r"[.;:,!?\-­¬]$", re.sub(r"(?:e\.V|Co|Inc|S\.A)\.$", "", s)) and len(_TOKEN.findall(s)) >= 2 and not _MARKDOWN.match(s)


_TITLED = re.compile(r"^[^\W\d_][^.;:!?]*?\S(?:\s+[–—|·•/]\s+|\s{2,})[^\W\d_]\S+.*$")


class Page:
    """What the layout of one page shows. ``headers``: (line number, normalised line, has the form of a header)."""

    def __init__(self, text: str):
        self.lines = text.replace("\f", "\n\f").split("\n")
        self.page = is_page(self.lines)
        self.numbers: set[int] = set()
        self.headers: list[tuple[int, str, bool]] = []
        if not self.page:
            return
        filled = [i for i, x in enumerate(self.lines) if x.strip()]
        for i in filled:
            if PAGE_NUMBER.match(self.lines[i]):
                self.numbers.add(i)
        for i in filled:
            if i in self.numbers or not _may_be_header(self.lines[i]):
                continue
            edge_before = i == filled[0] or not self.lines[i - 1].strip() or self.lines[i].startswith("\f") or (i - 1) in self.numbers
            edge_after = i == filled[-1] or (i + 1) in self.numbers
            if edge_before or edge_after:
                shaped = bool(_TITLED.match(self.lines[i].strip("\f "))) and not re.search(r"\d{3}", self.lines[i])
                self.headers.append((i, normal_line(self.lines[i]), shaped))

    def body(self, headers: set[str]) -> tuple[list[tuple[str, str]], list[str]]:
        """Divided words (first part with its hyphen, second part) and the lines joined into paragraphs."""
        drop = {i for i, norm, shaped in self.headers if shaped or norm in headers} | self.numbers
        kept = [(i, self.lines[i].strip("\f ").rstrip()) for i in range(len(self.lines)) if i not in drop]
        divided: list[tuple[str, str]] = []
        paragraphs, current, blank = [], "", False
        for _, line in kept:
            if not line:
                blank = True
                continue
            if current:
                tail = max(0, len(current) - 64)
                m = HYPHEN.search(current, tail)
                first = re.match(r"[^\W\d_]+", line)
                if m and first and (m[2] != "-" or (first[0][0].islower() and first[0].lower() not in _NOT_DIVIDED)):
                    divided.append((m[1], first[0]))
                    current = current[: m.start(2)] + line
                elif m and m[2] == "-" and first:
                    current += line if first[0][0].isupper() else " " + line
                elif blank and re.search(r"[.!?][\"'”“)]*$", current):
                    paragraphs.append(current)
                    current = line
                else:
                    current += " " + line
            else:
                current = line
            blank = False
        if current:
            paragraphs.append(current)
        return divided, paragraphs


_PAGE_ROW = "id long, ref string, hyphen boolean, page_number boolean, header boolean, numbered boolean, headers array<string>, suspects array<struct<before:string,word:string>>"


def pages(chunks: DataFrame) -> DataFrame:
    """One row per chunk that is a page, with the evidence of its layout and its words."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("before", pa.string()), ("word", pa.string())]))
        for batch in batches:
            out: list[tuple] = []
            for chunk, ref, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                page = Page(text)
                if not page.page:
                    continue
                divided, paragraphs = page.body(set())
                words: set[tuple[str, str]] = set()
                before = ""
                inner = False
                for token in _TOKEN.findall(" ".join(paragraphs)):
                    if len(token) >= 4 and sum(ch.isalpha() for ch in token) >= 3:
                        words.add((before, token))
                        inner |= bool(_INNER.search(token)) and not re.search(r"\d{2}|^[dlDL]'", token)
                    before = token
                out.append((chunk, ref, bool(divided), bool(page.numbers), any(s for _, _, s in page.headers), inner, [n for _, n, _ in page.headers], [{"before": b, "word": w} for b, w in sorted(words)]))
            columns = list(zip(*out, strict=True)) if out else [[]] * 8
            kinds = [pa.int64(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_(), pa.bool_(), pa.list_(pa.string()), kind]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["id", "ref", "hyphen", "page_number", "header", "numbered", "headers", "suspects"])

    rows = chunks.where(F.col("content").contains("\n")).select(F.col("id").cast("long").alias("id"), "ref", "content")
    return rows.mapInArrow(look, _PAGE_ROW)


def distinct_texts(chunks: DataFrame) -> DataFrame:
    """(content) once per text, met by two independent hashes of it; copies are folded before the shuffle too."""
    keys = F.xxhash64("content").alias("h"), F.xxhash64(F.lit(1), "content").alias("g")
    return chunks.where(F.col("content").isNotNull()).select(*keys, "content").groupBy("h", "g").agg(F.first("content").alias("content")).select("content")


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, df) over all rows of ``texts``."""
    words = texts.select(F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"[\p{L}\p{N}]+(?:'[\p{L}\p{N}]+)*+"), F.lit(0)))).alias("word"))
    return words.where(F.length("word") >= 4).groupBy("word").agg(F.count(F.lit(1)).alias("df"))


def shape(column: str | Column) -> Column:
    """What a scanner may have seen: after marks are joined to their vowels, every character is mapped on
    its own, so that what is read and what is meant have one shape for every confusion pair. Words of
    different shapes differ by more than confusions.
    """
    out = F.lower(F.col(column) if isinstance(column, str) else column)
    for meant, seen in (("a'", "ä"), ("o'", "ö"), ("u'", "ü"), ("h", "li"), ("m", "rn"), ("ü", "ii"), ("d", "cl"), ("w", "vv")):
        out = F.replace(out, F.lit(meant), F.lit(seen))
    return F.translate(out, "eugsiloßb6", "cv95110888")


def _costs(read: pd.Series, meant: pd.Series) -> pd.Series:
    return pd.Series([edit_cost(a, b) for a, b in zip(read, meant, strict=True)], dtype="float64")


#: Not deterministic for the optimizer, which would else move it below the ``distinct`` and repeat it per key.
_cost_column = F.pandas_udf(_costs, DoubleType()).asNondeterministic()


def _index(words: DataFrame, deleted: Column) -> DataFrame:
    """The words under their shape and, where ``deleted`` says so, under each of its deletions."""
    at = F.transform(F.sequence(F.lit(1), F.length("shape")), lambda i: F.concat(F.substring(F.col("shape"), F.lit(1), i - 1), F.substring(F.col("shape"), i + 1, F.length("shape"))))
    keys = F.when(deleted, F.array_distinct(F.array_union(F.array("shape"), at))).otherwise(F.array("shape"))
    return words.withColumn("shape", shape("word")).withColumn("key", F.explode(keys))


def corrections(page_words: DataFrame, counts: DataFrame, common: int = 8, ratio: int = 8, firm_ratio: int = 40, rare: int = 3) -> DataFrame:
    """(word, candidate, cost, candidate_df) of words of pages; only verified candidates.

    A candidate is in ``ratio`` times as many texts as the word, in ``firm_ratio`` times as many where the
    word itself is in more than ``rare`` of them, so that frequent misreads of a large corpus are found
    too. A word with a digit or an apostrophe is misread for certain; it may differ by a plain edit besides.
    """
    certain = F.col("word").rlike(r"\p{L}[0-9']|[0-9']\p{L}")
    suspects = page_words.join(counts, "word", "left").select("word", F.coalesce("df", F.lit(0)).alias("df"), certain.alias("certain"))
    lexicon = counts.where((F.col("df") >= common) & F.col("word").rlike(r"^\p{L}+$"))
    times = F.when(F.col("s.df") > rare, F.lit(firm_ratio)).otherwise(F.lit(ratio))
    met = _index(suspects, F.col("certain")).alias("s").join(_index(lexicon, F.lit(True)).alias("l"), "key")
    alike = (F.col("s.shape") == F.col("l.shape")) & (F.col("key") == F.col("s.shape"))
    near = F.col("s.certain") & (F.col("s.shape") != F.col("l.shape")) & (F.length("s.word") >= 8)
    found = met.where((alike | near) & (F.col("s.word") != F.col("l.word"))).where(F.col("l.df") >= times * F.greatest(F.col("s.df"), F.lit(1)))
    distinct = found.select(F.col("s.word").alias("word"), F.col("l.word").alias("candidate"), F.col("l.df").alias("candidate_df"), F.col("s.certain").alias("certain")).distinct()
    costed = distinct.where(F.abs(F.length("word") - F.length("candidate")) <= 3).withColumn("cost", _cost_column("word", "candidate"))
    most = F.when(F.col("certain"), F.lit(MOST_COST + 0.6)).otherwise(F.lit(MOST_COST))
    return costed.where((F.col("cost") > 0.1) & (F.col("cost") < most)).select("word", "candidate", "cost", "candidate_df")


def evidence(chunks: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pages, repeated headers (ref, line), and corrections (word, candidate, ...)."""
    looked = cut(pages(chunks))
    lines = looked.select("ref", F.explode("headers").alias("line")).groupBy("ref", "line").agg(F.count(F.lit(1)).alias("n")).where("n >= 2 and line != ''").select("ref", "line")
    words = looked.select(F.explode("suspects.word").alias("word")).distinct()
    return looked, lines, corrections(words, cut(word_counts(texts)))


def noise(chunks: DataFrame) -> DataFrame:
    """(id, noise): one row per page and kind of noise it shows."""
    looked, lines, fixes = evidence(chunks, distinct_texts(chunks))
    repeated = looked.select("id", "ref", F.explode("headers").alias("line")).join(lines, ["ref", "line"], "left_semi").select("id")
    misread = looked.select("id", F.explode("suspects.word").alias("word")).join(fixes.select("word").distinct(), "word", "left_semi").select("id")
    kinds = [("hyphen", looked.where("hyphen").select("id")), ("page_number", looked.where("page_number").select("id")), ("header", looked.where("header").select("id").unionByName(repeated)), ("misread", looked.where("numbered").select("id").unionByName(misread))]
    out = None
    for name, rows in kinds:
        part = rows.select("id", F.lit(name).alias("noise"))
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def repaired(chunks: DataFrame) -> DataFrame:
    """(id, repaired): pages with noise as continuous paragraphs."""
    texts = distinct_texts(chunks)
    looked, lines, fixes = evidence(chunks, texts)
    uses = looked.select("id", F.explode("suspects").alias("s")).select("id", F.col("s.before").alias("before"), F.col("s.word").alias("word"))
    fixes = cut(fixes)
    several = fixes.groupBy("word").agg((F.count(F.lit(1)) > 1).alias("several"))
    options = cut(uses.join(fixes.join(several, "word"), "word"))
    # Bigram context, where there is a choice: in how many places of distinct texts a candidate follows the preceding word.
    needed = options.where("several").select(F.concat_ws(" ", "before", "candidate").alias("bigram")).distinct()
    tokens = texts.select(F.regexp_extract_all("content", F.lit(r"[\p{L}\p{N}]+(?:'[\p{L}\p{N}]+)*+"), F.lit(0)).alias("w")).where(F.size("w") > 1)
    bigrams = tokens.select(F.explode(F.zip_with(F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1), lambda a, b: F.concat_ws(" ", a, b))).alias("bigram"))
    counted = bigrams.join(needed, "bigram", "left_semi").groupBy("bigram").agg(F.count(F.lit(1)).alias("follows"))
    # A word is repaired alike on all of a page, by all places it stands in there.
    placed = options.withColumn("bigram", F.concat_ws(" ", "before", "candidate")).join(counted, "bigram", "left")
    scored = placed.groupBy("id", "word", "candidate").agg(F.min("cost").alias("cost"), F.max("candidate_df").alias("candidate_df"), F.sum(F.coalesce("follows", F.lit(0))).alias("follows"))
    score: Column = F.col("cost") * 4 - F.log1p("follows") - 0.2 * F.log1p("candidate_df")
    best = scored.groupBy("id", "word").agg(F.min_by("candidate", F.struct(score, F.col("candidate"))).alias("candidate"))
    maps = best.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("word", "candidate"))).alias("fixes"))
    heads = looked.select("id", "ref", F.explode("headers").alias("line")).join(lines, ["ref", "line"], "left_semi").groupBy("id").agg(F.collect_set("line").alias("lines"))
    rows = chunks.select(F.col("id").cast("long").alias("id"), "content").join(looked.select("id"), "id", "left_semi").join(maps, "id", "left").join(heads, "id", "left").select("id", "content", "fixes", "lines")

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, changes, headers in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                _, paragraphs = Page(text).body(set(headers or ()))
                better = dict(changes or ())
                out.append("\n\n".join(_TOKEN.sub(lambda m: better.get(m[0], m[0]), p) for p in paragraphs))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["id", "repaired"])

    return rows.mapInArrow(repair, "id long, repaired string")
