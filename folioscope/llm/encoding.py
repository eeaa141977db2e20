"""Text decoded with the wrong character encoding: found, and restored where it can be.

1. Twins. All words with a character outside ASCII are counted by form, over distinct texts, so that
   copies of a garbled text weigh as one. Forms that are equal once such
   characters are stripped are twins; of these the form in most texts is taken as clean. Aligning a
   rarer form with its clean twin, the ASCII characters being the anchors, pairs garbled with clean runs.
2. Transformations. A transformation is a chain of (encoded as, decoded as) steps over single-byte code
   pages and UTF-8. Every aligned pair votes for the chains that turn the clean run into the garbled one;
   chains with enough distinct words behind them are learned, together with the clean alphabet. A form
   that a learned chain maps back through letters with more words behind them is no evidence for the
   alphabet, nor solid, if the form it comes from occurs, or if only copies of few texts speak for it.
3. The rest. The learned chains are applied to all records: runs that a chain through UTF-8 maps back
   to the clean alphabet are garbled anywhere; for chains between single-byte pages, where every
   character maps to something, a word is garbled if its characters map back to letters and the word
   as it stands is not itself a clean form. The replacement character is always damage; words with it are
   restored from their clean twin.

Defined cases: null fields have no cases; empty tables give no rows; a corpus without twins learns no
chain and still reports replacement characters; repeated rows each count; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.durable import cut

#: Code pages that a text can have been taken for.
PAGES = ("cp1252", "latin-1", "cp850", "cp437", "mac_roman", "cp1251", "cp1250", "iso8859_15", "koi8_r")
#: Single-byte pages that the text can truly have been in.
TRUE_PAGES = ("cp1252", "latin-1", "mac_roman", "cp850")
_WORD = r"(?<![A-Za-z0-9])[A-Za-z0-9]*+[^\x00-\x7F](?:[A-Za-z0-9]|[^\x00-\x7F])*+"
_LOST = "�"


def _decode(data: bytes, page: str) -> str:
    """Decoding as readers do it in practice: bytes that a Windows page leaves free become C1 controls."""
    if page not in ("cp1252", "cp1250", "cp1251"):
        return data.decode(page)
    return "".join(bytes([b]).decode(page, "ignore") or chr(b) for b in data)


def chains() -> list[tuple[tuple[str, str], ...]]:
    """All transformations that are considered, shorter ones first."""
    single = [(("utf-8", page),) for page in PAGES] + [((true, page),) for true in TRUE_PAGES for page in PAGES if true != page and {true, page} != {"cp1252", "latin-1"} and not {true, page} <= {"cp1252", "latin-1", "iso8859_15", "cp1250"}]
    return single + [(("utf-8", first), ("utf-8", second)) for first in ("cp1252", "latin-1") for second in ("cp1252", "latin-1")]


def garble(text: str, chain: tuple[tuple[str, str], ...]) -> str | None:
    for true, page in chain:
        try:
            text = _decode(text.encode(true), page)
        except (UnicodeEncodeError, UnicodeDecodeError):
            return None
    return text


def aligned_runs(garbled: str, clean: str) -> list[tuple[str, str]]:
    """Pairs of runs outside ASCII between equal ASCII anchors; empty if the anchors differ."""
    split = re.compile(r"[\x00-\x7f]+")
    if split.findall(garbled) != split.findall(clean):
        return []
    return [(g, c) for g, c in zip(split.split(garbled), split.split(clean), strict=True) if g != c and g and c]


def field_rows(chunks: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    return chunks.select(F.col("id").cast("long").alias("id"), F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("text")) for f in fields])).alias("x")).select("id", "x.field_name", "x.text")


def word_forms(chunks: DataFrame, fields: tuple[str, ...] = ("content", "ref")) -> DataFrame:
    """(form, stripped, df, uses): words with characters outside ASCII, and how many distinct texts and fields hold them."""
    texts = field_rows(chunks, fields).where(F.col("text").rlike(r"[^\x00-\x7F]"))
    # Two independent hashes stand for a text; its words are fewer bytes than the text itself.
    held = texts.select(F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("g"), F.array_distinct(F.regexp_extract_all("text", F.lit(_WORD), F.lit(0))).alias("forms"))
    words = held.where(F.size("forms") > 0).groupBy("h", "g").agg(F.first("forms").alias("forms"), F.count(F.lit(1)).alias("copies")).select(F.explode("forms").alias("form"), "copies")
    counted = words.groupBy("form").agg(F.count(F.lit(1)).alias("df"), F.sum("copies").alias("uses"))
    return counted.select("form", "df", "uses", F.regexp_replace("form", r"[^\x00-\x7F]", "").alias("stripped"))


def back_tables(learned: list, alphabet: dict[str, int]) -> list[dict[str, str]]:
    """Per single-byte chain, garbled to clean letters; only where more words are behind the clean one."""
    tables = []
    for chain in learned:
        if chain[0][0] != "utf-8":
            table = {g: c for c, n in alphabet.items() if ord(c) > 127 and (g := garble(c, chain)) and g != c and len(g) == 1 and ord(g) > 127 and n > alphabet.get(g, 0)}
            if table:
                tables.append(table)
    return tables


def garbled_forms(forms: DataFrame, learned: list, alphabet: dict[str, int], few: int = 5) -> DataFrame:
    """(form): those that a learned single-byte chain maps back to a form that occurs, or, in fewer than ``few`` texts, to letters."""
    tables = back_tables(learned, alphabet)
    suspects = "".join(sorted({g for t in tables for g in t}))
    if not suspects:
        return forms.where(F.lit(False)).select("form")
    held = forms.where(F.col("form").rlike("[" + re.escape(suspects) + "]"))
    back = F.array(*[F.translate("form", "".join(t), "".join(t.values())) for t in tables])
    maps = held.select("form", "df", F.explode(F.array_distinct(back)).alias("back")).where((F.col("form") != F.col("back")) & F.col("back").rlike(r"^\p{L}{3,}$"))
    occurs = maps.join(forms.select(F.col("form").alias("back")), "back", "left_semi").select("form")
    return occurs.unionByName(maps.where(F.col("df") < few).select("form")).distinct()


def learn(forms: DataFrame, least_words: int = 8) -> tuple[list[tuple[tuple[str, str], ...]], dict[str, int], DataFrame]:
    """The learned chains, the clean alphabet with the number of words behind each character, and the garbled forms."""
    twins = forms.where(F.length("stripped") >= 2)
    clean = twins.groupBy("stripped").agg(F.max(F.struct("df", "uses", "form")).alias("best")).select("stripped", F.col("best.form").alias("clean"), F.col("best.df").alias("clean_df"), F.col("best.uses").alias("clean_uses")).where("clean_uses >= 3")
    pairs = twins.join(clean, "stripped").where((F.col("form") != F.col("clean")) & ((F.col("clean_df") >= 3 * F.col("df")) | (F.col("clean_uses") >= 3 * F.col("uses")))).select("form", "clean")
    possible = chains()

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[int, int] = {}
            for form, twin in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                runs = aligned_runs(form, twin)
                if runs and _LOST not in form:
                    for number, chain in enumerate(possible):
                        if all(garble(c, chain) == g for g, c in runs):
                            out[number] = out.get(number, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int32()), pa.array(list(out.values()), pa.int64())], names=["chain", "words"])

    votes = pairs.mapInArrow(vote, "chain int, words long").groupBy("chain").agg(F.sum("words").alias("words")).collect()
    found = [possible[r["chain"]] for r in sorted(votes, key=lambda r: r["chain"]) if r["words"] >= least_words]
    # Characters of forms that are the clean twin of something, or stand alone in many texts: at first of
    # all such forms, then without those that turn out to be garbled.
    garbled = cut(garbled_forms(forms, found, _alphabet(forms, clean)))
    return found, _alphabet(forms, clean.join(garbled, F.col("clean") == F.col("form"), "left_anti")), garbled


def _alphabet(forms: DataFrame, clean: DataFrame) -> dict[str, int]:
    solid = clean.where("clean_uses >= 5").select(F.explode(F.array_distinct(F.split(F.regexp_replace("clean", r"[\x00-\x7F]", ""), ""))).alias("c")).where("c != ''")
    signs = forms.where((F.length("stripped") <= 1) & (F.col("df") >= 5)).select(F.explode(F.array_distinct(F.split("form", ""))).alias("c")).where("c != ''")
    return {r["c"]: r["n"] for r in solid.unionByName(signs).groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect() if r["c"] != _LOST}


def solid_forms(forms: DataFrame, suspects: set[str], garbled: DataFrame, least: int = 10) -> DataFrame:
    """Forms that hold a suspect character, are not known as garbled and are the clean form of their twins."""
    held = forms.where(F.col("form").rlike("[" + re.escape("".join(sorted(suspects))) + "]")) if suspects else forms.where(F.lit(False))
    held = held.join(garbled, "form", "left_anti")
    best = forms.groupBy("stripped").agg(F.max("df").alias("best"))
    return held.where(F.col("df") >= least).join(best, "stripped").where(F.col("df") == F.col("best")).select("form")


class Restorer:
    """Finds and undoes the learned transformations in one text."""

    def __init__(self, learned: list, alphabet: dict[str, int]):
        self.multi: dict[str, str] = {}
        self.singles: list[dict[str, str]] = []
        # Characters that garbling through UTF-8 itself produces are no evidence of a clean alphabet.
        through = [c for c in learned if c[0][0] == "utf-8"]
        letters = [c for c in alphabet if ord(c) > 127]
        for chain in sorted(through, key=len):
            for c in letters:
                g = garble(c, chain)
                if g is not None and len(g) >= 2:
                    self.multi.setdefault(g, c)
        self.pattern = re.compile("|".join(sorted(map(re.escape, self.multi), key=lambda g: (-len(g), g)))) if self.multi else None
        for chain in learned:
            if chain[0][0] != "utf-8":
                table = {g: c for c in letters if (g := garble(c, chain)) and g != c and len(g) == 1 and ord(g) > 127}
                if table:
                    self.singles.append(table)
        self.words = re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9]*[^\x00-\x7f](?:[A-Za-z0-9]|[^\x00-\x7f])*")
        most = max(alphabet.values(), default=0)
        # Letters behind few words could be garbled themselves, as could those that begin garbled sequences.
        heads = {g[0] for g in self.multi}
        self.trusted = {c for c, n in alphabet.items() if c.isalpha() and n >= max(3, 0.002 * most)}
        self.evident = {c for c, n in alphabet.items() if c.isalpha() and n >= max(3, 0.005 * most)} - heads

    def single_table(self, text: str, solid: set[str]) -> dict[str, str] | None:
        """The single-byte transformation that explains most words of the text, if any does."""
        best, score = None, 0
        for table in self.singles:
            hits = 0
            for m in self.words.finditer(text):
                word = m[0]
                if len(word) < 3 or word.lower() in solid or not any(table.get(ch) in self.evident and ch not in self.trusted for ch in word):
                    continue
                changed = "".join(table.get(ch, ch) for ch in word)
                if changed.isalpha() and any(ch < "\x80" for ch in word) and all(ch in table or ch < "\x80" or ch in self.trusted for ch in word):
                    hits += 1
            if hits > score:
                best, score = table, hits
        return best

    def through_utf8(self, text: str) -> tuple[bool, str]:
        """Whether chains through UTF-8 or losses are there, and the text with the former undone."""
        bad, out = _LOST in text, text
        for _ in range(3):
            if self.pattern is None or not self.pattern.search(out):
                break
            bad = True
            out = self.pattern.sub(lambda m: self.multi[m[0]], out)
        return bad, out

    def between_pages(self, text: str, solid: set[str]) -> str | None:
        """The text with the single-byte transformation undone that explains it, if one does; ``solid`` words, in lower case, are clean."""
        table = self.single_table(text, solid)
        if table is None:
            return None
        return self.words.sub(lambda m: m[0] if m[0].lower() in solid else "".join(table.get(ch, ch) if ch not in self.trusted else ch for ch in m[0]), text)

    def __call__(self, text: str, solid: set[str] | frozenset[str] = frozenset()) -> tuple[bool, str]:
        """Whether some characters are garbled, and the text with those restored that can be."""
        bad, out = self.through_utf8(text)
        better = self.between_pages(out, set(solid))
        return bad or better is not None, out if better is None else better


def restored_fields(chunks: DataFrame, fields: tuple[str, ...] = ("content", "ref"), least_words: int = 8, forms: DataFrame | None = None) -> DataFrame:
    """(id, field_name, restored, complete): the garbled fields, restored as far as the learned chains go.

    ``complete`` is false where replacement characters are left.
    """
    forms = cut(word_forms(chunks, fields)) if forms is None else forms
    learned, alphabet, garbled = learn(forms, least_words)
    suspects = {g for chain in learned if chain[0][0] != "utf-8" for c in alphabet if (g := garble(c, chain)) and len(g) == 1 and ord(g) > 127}
    shared = chunks.sparkSession.sparkContext.broadcast((learned, alphabet, suspects))
    schema = "id long, field_name string, restored string, complete boolean"

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Garbled fields, and those that may be garbled between single-byte pages with the words this rests on."""
        *known, suspect = shared.value
        work = Restorer(*known)
        for batch in batches:
            out: list[tuple] = []
            for row, field, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                bad, better = work.through_utf8(text.as_py())
                open_ = work.single_table(better, set()) is not None
                if bad or open_:
                    asked = sorted({m[0].lower() for m in work.words.finditer(better) if not suspect.isdisjoint(m[0])}) if open_ else None
                    out.append((row, field, better, bad, asked))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["id", "field_name", "restored", "bad", "asked"])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = Restorer(*shared.value[:2])
        for batch in batches:
            out: list[tuple] = []
            for row, field, text, bad, solid in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                better = work.between_pages(text, set(solid or ()))
                if bad or better is not None:
                    better = text if better is None else better
                    out.append((row, field, better, _LOST not in better))
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.bool_()), strict=True)], names=["id", "field_name", "restored", "complete"])

    rows = field_rows(chunks, fields).where(F.col("text").rlike(r"[^\x00-\x7F]"))
    found = cut(rows.mapInArrow(look, "id long, field_name string, restored string, bad boolean, asked array<string>"))
    final = found.where("asked IS NULL").select("id", "field_name", "restored", (~F.contains("restored", F.lit(_LOST))).alias("complete"))
    if not suspects:
        return final
    # Words of the open fields meet the solid forms in the cluster, and the verdicts go back to their fields: no
    # vocabulary is collected, and no text but those of open fields is moved.
    held = found.where("asked IS NOT NULL").withColumn("h", F.xxhash64("restored"))
    asked = held.select("id", "field_name", "h", F.explode("asked").alias("form")).distinct()
    verdicts = asked.join(solid_forms(forms, suspects, garbled).select(F.lower("form").alias("form")), "form", "left_semi").groupBy("id", "field_name", "h").agg(F.collect_set("form").alias("solid"))
    decided = held.join(verdicts, ["id", "field_name", "h"], "left").select("id", "field_name", "restored", "bad", "solid").mapInArrow(decide, schema)
    return final.unionByName(decided)


def restored_with_twins(chunks: DataFrame, fields: tuple[str, ...] = ("content", "ref"), least_words: int = 8) -> DataFrame:
    """``restored_fields``, and words with replacement characters taken from their clean twins.

    A word is replaced if its letters outside ASCII are as many as its marks of loss and one clean form
    of the same rest is in at least ten times as many distinct texts as any other.
    """
    forms = cut(word_forms(chunks, fields))
    found = cut(restored_fields(chunks, fields, least_words, forms))
    word = rf"(?<![A-Za-z0-9])[A-Za-z0-9]*+{_LOST}(?:[A-Za-z0-9]|[^\x00-\x7F])*+"
    lost = found.where("NOT complete").select("id", "field_name", F.explode(F.array_distinct(F.regexp_extract_all("restored", F.lit(word), F.lit(0)))).alias("form"))
    shaped = lost.withColumn("stripped", F.regexp_replace("form", r"[^\x00-\x7F]", "")).withColumn("n", F.length("form"))
    clean = forms.where(~F.contains("form", F.lit(_LOST)) & F.col("form").rlike(r"^[\p{L}]+$") & (F.length("stripped") > 0)).select("stripped", F.length("form").alias("n"), F.col("form").alias("clean"), "df", "uses")
    ranked = clean.groupBy("stripped", "n").agg(F.max(F.struct("df", "uses", "clean")).alias("best"), F.sum("df").alias("all"))
    sure = ranked.where((F.col("best.uses") >= 3) & (F.col("best.df") >= 10 * (F.col("all") - F.col("best.df")))).select("stripped", "n", F.col("best.clean").alias("clean"))
    pairs = shaped.join(sure, ["stripped", "n"]).groupBy("id", "field_name").agg(F.map_from_entries(F.collect_list(F.struct("form", "clean"))).alias("twins"))
    joined = found.join(pairs, ["id", "field_name"], "left").select("id", "field_name", "restored", "twins")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile(word.replace("*+", "*"))
        for batch in batches:
            out = []
            for text, twins in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                known = dict(twins or ())
                out.append(pattern.sub(lambda m, known=known: known.get(m[0], m[0]), text) if known else text)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([_LOST not in t for t in out], pa.bool_())], names=["id", "field_name", "restored", "complete"])

    return joined.mapInArrow(apply, "id long, field_name string, restored string, complete boolean")
