"""Texts that were cut off, from the lengths of a source and the endings of its texts.

Every source has discrete length hazards: of all its texts at least as long as L, the share that is exactly
L long, in characters and, since some limits count bytes, in bytes of UTF-8. Window functions compare
each hazard with the mean hazard of the lengths around it; the exceedance gets a binomial tail
probability, and the Benjamini-Hochberg step controls the share of false limits over all lengths that
occur, by a histogram of their probabilities.
A limit in bytes can fall inside a character, so lengths up to 3 bytes beside a limit belong to it.

A text is cut off if its ending is incomplete. Endings that are incomplete anywhere: a word or sentence
without its end, an open table cell or front matter, a mark that a cut leaves. Endings that are whole:
sentences, tables, lists, code, links, dates and signatures. Between these lie endings that look whole
but for one sign, such as a list item that lacks what its neighbours have, a signature under no
closing line, or a sentence that ends with an ordinal: at a significant length they count as cut.

Defined cases: null and empty texts are not cut; sources are compared in lower case without blanks at
the ends, a null source is a source of its own; trailing white space of a text is ignored for its
ending, not for its length; repeated rows each count; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.durable import cut

CUT, UNSURE, WHOLE = "cut", "unsure", "whole"

_CLOSERS = "\"'”“»’›)]}*_"
_SENTENCE_END = re.compile(r"[.!?:;]+[" + re.escape(_CLOSERS) + r"]*$")
_MARK = re.compile(r"(\[\s*(?:\.{2,}|…)\s*\]|\(\s*(?:\.{2,}|…)\s*\)|…|(?<!\.)\.{3}|�+)$")
_ITEM = re.compile(r"^\s*(?:[-*•·+]|\d{1,3}[.)])\s+")
_DATE = re.compile(r"(?:\d{4}-\d{2}-\d{2}|\d{1,2}\.\s?\d{1,2}\.\s?\d{4}|\d{1,2}/\d{1,2}/\d{4}|(?:\d{1,2}\.?\s+)?[^\W\d_]{3,10}\s+\d{4})$")
_LINK = re.compile(r"(?:\[\[[^\[\]\n]+\]\]|\[[^\]\n]*\]\([^)\s]+\)|https?://\S+|\S+@\S+\.\w+)$")
_DATE_LABEL = re.compile(r"^(?:stand|updated|gez\.|as of|date|datum|fecha|mis à jour)\b", re.IGNORECASE)
_PROXY = re.compile(r"^(?:i\.\s?[AV]\.|p\.\s?p\.|ppa\.|gez\.)\s+\S", re.IGNORECASE)
#: Closing lines above a signature, in the four languages of the tables.
CLOSINGS = ("beste grüße", "mit freundlichen grüßen", "viele grüße", "herzliche grüße", "freundliche grüße", "liebe grüße", "kind regards", "best regards", "regards", "yours", "yours sincerely", "sincerely", "cordialement", "bien à vous", "un saludo", "saludos", "atentamente")
_ORDINAL = re.compile(r"(?:^|\s)\d{1,2}\.$")
_ABBREVIATION = re.compile(r"(?:\b(?:Nr|Str|Abs|Art|bzw|ca|Dr|Mag|Ing|Dipl|St|No|Bl|S|Co|z\. ?B|u\. ?a|d\. ?h|i\. ?A)\.)$")
_NAME = re.compile(r"^(?:\S+\.\s+)*[^\W\d_][^\W\d_'.-]*(?:[ -][^\W\d_][^\W\d_'.-]*){0,3}$")


def ending(text: str) -> str:
    """``cut``, ``unsure`` or ``whole``, from the text alone."""
    t = text.rstrip()
    if not t:
        return WHOLE
    if _MARK.search(t):
        return CUT
    lines = t.split("\n")
    last = lines[-1].strip()
    if t.startswith("---\n") and not re.search(r"\n---[ \t]*(?:\n|$)", t[3:]):
        return CUT  # front matter that was never closed
    if sum(line.lstrip().startswith("```") for line in lines) % 2:
        return CUT  # code that was never closed
    if last.startswith("```") or last == "---" or re.fullmatch(r"[-=*_]{3,}", last):
        return WHOLE
    if last.startswith("|"):
        if not last.endswith("|") or len(last) == 1:
            return CUT
        above = lines[-2].strip() if len(lines) > 1 else ""
        if above.startswith("|") and above.count("|") > last.count("|"):
            return CUT
        return UNSURE if len(lines) < 2 or not above.startswith("|") or re.fullmatch(r"[|:\- ]+", last) else WHOLE
    if _LINK.search(last):
        return WHOLE
    if "[[" in last and last.rfind("[[") > last.rfind("]]"):
        return CUT
    if _ITEM.match(last):
        if _DATE.search(last) or _SENTENCE_END.search(last):
            return UNSURE if _ORDINAL.search(last) else WHOLE
        siblings = [line.strip() for line in lines[max(0, len(lines) - 12) : -1] if _ITEM.match(line.strip())]
        ended = [bool(_DATE.search(s) or _LINK.search(s) or _SENTENCE_END.search(s)) for s in siblings]
        return CUT if ended and all(ended) else CUT if re.search(r"[,(–-]$|,\s*\S{0,12}$", last) else UNSURE
    if last.startswith("#"):
        return UNSURE
    above = next((line.strip() for line in reversed(lines[:-1]) if line.strip()), "")
    if _DATE_LABEL.match(last) and (_DATE.search(last) or len(last) < 12):
        return WHOLE if _DATE.search(last) else CUT
    if _PROXY.match(last) and len(last) <= 60:
        return WHOLE
    if above.lower().rstrip(",.!") in CLOSINGS and _NAME.match(last):
        return WHOLE
    if last.lower().rstrip(",.!") in CLOSINGS:
        return UNSURE
    if _SENTENCE_END.search(last):
        if _ORDINAL.search(last) or _ABBREVIATION.search(last) or last[-1] in ":;":
            return UNSURE
        return WHOLE
    if len(last) <= 30 and _DATE.fullmatch(last):
        return WHOLE
    if re.search(r"[.!?]\s*[" + re.escape(_CLOSERS) + r"–—-]+$", last):
        return WHOLE
    return CUT


def endings(documents: DataFrame) -> DataFrame:
    """(doc_id, source, chars, bytes, ending) of each text."""

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [ending(t.as_py()) for t in batch.column(4)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(found, pa.string())], names=["doc_id", "source", "chars", "bytes", "ending"])

    rows = documents.where(F.col("text").isNotNull()).select(
        F.col("doc_id").cast("long"), F.coalesce(F.lower(F.trim("source")), F.lit("")).alias("source"), F.length("text").alias("chars"), F.octet_length("text").alias("bytes"), "text"
    )
    return rows.mapInArrow(classify, "doc_id long, source string, chars int, bytes int, ending string")


def limits(lengths: DataFrame, window: int = 40, rate: float = 0.01) -> DataFrame:
    """(source, unit, length, n, at_risk, hazard, expected, p) of the lengths whose hazard is significant.

    ``lengths``: rows (source, unit, length). Counting comes first, so that windows run over distinct
    lengths of a source, not over its texts. A length is at most as many rows as texts are long.
    """
    counts = lengths.groupBy("source", "unit", "length").agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("source", "unit").orderBy(F.col("length"))
    risk = counts.withColumn("at_risk", F.sum("n").over(by.rowsBetween(0, Window.unboundedFollowing)))
    near = by.rangeBetween(-window, window)
    around = risk.withColumn("others", F.sum("n").over(near) - F.col("n"))
    tested = around.withColumn("expected", F.greatest(F.col("others") + 1, F.lit(1)) / (F.lit(2 * window) * F.greatest("at_risk", F.lit(1))))

    @F.pandas_udf("double")
    def tail(n: pd.Series, at_risk: pd.Series, p: pd.Series) -> pd.Series:
        def one(k: int, m: int, q: float) -> float:
            q = min(max(q, 1e-12), 0.5)
            term = math.exp(math.lgamma(m + 1) - math.lgamma(k + 1) - math.lgamma(m - k + 1) + k * math.log(q) + (m - k) * math.log1p(-q))
            total, i = term, k
            while i < m and term > total * 1e-12:
                term *= (m - i) / (i + 1) * q / (1 - q)
                i += 1
                total += term
            return min(1.0, total)

        return pd.Series([one(int(k), int(m), float(q)) for k, m, q in zip(n, at_risk, p, strict=True)], dtype="float64")

    # A length of one text: the chance of any there, in closed form.
    single = tested.where("n = 1").withColumn("p", 1 - F.exp(F.col("at_risk") * F.log1p(-F.least("expected", F.lit(0.5)))))
    scored = cut(single.unionByName(tested.where("n > 1").withColumn("p", tail("n", "at_risk", "expected"))))
    # Benjamini-Hochberg per unit: the largest bin of probabilities whose upper end is at most ``rate`` times
    # the share of tests up to it. A hundred bins for each power of ten, so the histogram is small.
    bin_ = F.ceil(100 * F.log10(F.greatest("p", F.lit(1e-300)))).cast("int")
    bins = scored.groupBy("unit", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("tests"))
    ordered = Window.partitionBy("unit").orderBy("bin")
    ranked = bins.withColumn("up_to", F.sum("tests").over(ordered)).withColumn("all", F.sum("tests").over(Window.partitionBy("unit")))
    passing = ranked.where(F.pow(F.lit(10.0), F.col("bin") / 100) <= rate * F.col("up_to") / F.col("all")).groupBy("unit").agg(F.max("bin").alias("top"))
    found = scored.withColumn("bin", bin_).join(F.broadcast(passing), "unit").where("bin <= top")
    return found.select("source", "unit", "length", "n", "at_risk", (F.col("n") / F.col("at_risk")).alias("hazard"), "expected", "p")


def truncated(documents: DataFrame) -> DataFrame:
    """(doc_id, source, cut, at_limit, ending): every text with the verdict, whether its length is a limit, and what its ending alone says."""
    seen = cut(endings(documents))
    units = seen.select("source", F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("length")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("length")))).alias("l")).select("source", "l.unit", "l.length")
    at = limits(units).select("source", "unit", "length").distinct()
    slack = F.when(F.col("unit") == "bytes", 3).otherwise(0)
    spread = at.select("source", "unit", F.explode(F.sequence(F.col("length") - slack, F.col("length") + slack)).alias("length")).distinct()
    hit = spread.groupBy("source").agg(F.collect_set(F.when(F.col("unit") == "chars", F.col("length"))).alias("char_limits"), F.collect_set(F.when(F.col("unit") == "bytes", F.col("length"))).alias("byte_limits"))
    joined = seen.join(hit, "source", "left")
    at_limit = F.coalesce(F.array_contains("char_limits", F.col("chars")) | F.array_contains("byte_limits", F.col("bytes")), F.lit(False))
    return joined.select("doc_id", "source", ((F.col("ending") == CUT) | ((F.col("ending") == UNSURE) & at_limit)).alias("cut"), at_limit.alias("at_limit"), "ending")


def rates(documents: DataFrame) -> DataFrame:
    """Cut texts per source: n_documents, n_cut, rate, and how many of them lie at a significant length."""
    return truncated(documents).groupBy("source").agg(
        F.count(F.lit(1)).alias("n_documents"), F.count_if("cut").alias("n_cut"), (F.count_if("cut") / F.count(F.lit(1))).alias("rate"), F.count_if(F.col("cut") & F.col("at_limit")).alias("n_cut_at_limit")
    )
