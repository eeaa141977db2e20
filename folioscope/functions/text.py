"""Column expressions over text: identities, slugs, similarity of labels, numbers."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions.constants import LABEL_STOPWORDS, NUMBER_PATTERN, URL_PATTERN, YEAR_PATTERN


def _c(column: str | Column) -> Column:
    return F.col(column) if isinstance(column, str) else column


def german(column: str | Column) -> Column:
    """Lower case with umlauts and sharp s written out."""
    out = F.lower(_c(column))
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def normalized_label(column: str | Column) -> Column:
    """The form of a label that its stable id is made of."""
    kept = F.regexp_replace(german(F.trim(_c(column))), r"[^\p{L}\p{N}_\s-]", "")
    return F.regexp_replace(F.regexp_replace(kept, r"[\s_]+", "-"), r"^-+|-+$", "")


def stable_entity_id(entity_type: str | Column, label: str | Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("::", _c(entity_type), normalized_label(label)), 256), 1, 12)


def relationship_id(source: str | Column, target: str | Column, relation: str | Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("::", _c(source), _c(target), _c(relation)), 256), 1, 16)


def slugify(column: str | Column) -> Column:
    """Kebab case of lower-cased text, umlauts written out."""
    return F.regexp_replace(F.regexp_replace(german(column), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def _accented() -> tuple[str, str]:
    """Letters that decompose into an ASCII letter and marks, and those letters."""
    found = [(chr(i), unicodedata.normalize("NFD", chr(i))) for i in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))]
    kept = [(a, b[0].lower()) for a, b in found if len(b) > 1 and b[0].isascii() and b[0].isalpha()]
    return "".join(a for a, _ in kept), "".join(b for _, b in kept)


def accentless_slug(column: str | Column) -> Column:
    """``slugify`` after accents are dropped from letters that have them."""
    plain = F.regexp_replace(F.translate(german(column), *_accented()), r"\p{M}", "")
    return F.regexp_replace(F.regexp_replace(plain, r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def safe_slug(slug: str | Column, most: int = 120) -> Column:
    """Slugs over ``most`` characters are cut and get 8 digits of their hash."""
    s = _c(slug)
    return F.when(F.length(s) <= most, s).otherwise(F.concat(F.regexp_replace(F.substring(s, 1, most - 10), "-+$", ""), F.lit("--"), F.substring(F.sha2(s, 256), 1, 8)))


def label_tokens(label: str | Column) -> Column:
    """Distinct informative tokens of a label: street and number words unified, function words dropped."""
    t = german(label)
    for pattern, to in ((r"strasse\b", "straße"), (r"str\.", "straße"), (r"\bnr\.", "nummer")):
        t = F.regexp_replace(t, pattern, to)
    words = F.regexp_extract_all(t, F.lit(r"[a-z0-9äöüß]+"), F.lit(0))
    return F.array_sort(F.array_distinct(F.filter(F.array_except(words, F.array(*map(F.lit, LABEL_STOPWORDS))), lambda w: F.length(w) > 1)))


def jaccard(a: str | Column, b: str | Column) -> Column:
    """Of token arrays; 0 if either is empty."""
    a, b = _c(a), _c(b)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def word_set(column: str | Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.trim(F.lower(_c(column))), r"\s+"), lambda w: w != ""))


def token_overlap(a: str | Column, b: str | Column) -> Column:
    """Percent of shared blank-separated tokens, cut to an integer."""
    x, y = word_set(a), word_set(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0)).otherwise(F.floor(100 * F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))).cast("int"))


def levenshtein_ratio(a: str | Column, b: str | Column) -> Column:
    """Percent of equal characters by edit distance, cut to an integer; 0 beyond 20 characters of difference."""
    a, b = _c(a), _c(b)
    longest = F.greatest(F.length(a), F.length(b))
    return (
        F.when(a == b, F.lit(100))
        .when((F.length(a) == 0) | (F.length(b) == 0) | (F.abs(F.length(a) - F.length(b)) > 20), F.lit(0))
        .otherwise(((F.lit(1.0) - F.levenshtein(a, b) / longest) * 100).cast("int"))
    )


def fuzzy_score(a: str | Column, b: str | Column) -> Column:
    return F.greatest(token_overlap(a, b), levenshtein_ratio(a, b))


def fuzzy_bound(a: str | Column, b: str | Column) -> Column:
    """An upper bound of ``fuzzy_score`` that needs no edit distance: tokens, or lengths alone."""
    a, b = _c(a), _c(b)
    by_length = (100 * F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b), F.lit(1))).cast("int")
    return F.greatest(token_overlap(a, b), F.when(F.abs(F.length(a) - F.length(b)) > 20, F.lit(0)).otherwise(by_length))


def address_numbers(column: str | Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(_c(column)), F.lit(r"\b(\d+[a-z]?)\b"), F.lit(1))))


def addresses_differ(a: str | Column, b: str | Column) -> Column:
    x, y = address_numbers(a), address_numbers(b)
    return (F.size(x) > 0) & (F.size(y) > 0) & (x != y)


def extracted_numbers(column: str | Column) -> Column:
    """Numbers as written, without those of links and without years; distinct, in order."""
    text = F.regexp_replace(F.regexp_replace(_c(column), URL_PATTERN, " "), YEAR_PATTERN, " ")
    found = F.transform(F.regexp_extract_all(text, F.lit(NUMBER_PATTERN), F.lit(0)), lambda n: F.trim(n, F.lit(" ,.")))
    return F.array_distinct(F.filter(found, lambda n: n != ""))


def ocr_decimal(column: str | Column) -> Column:
    """A blank before the last one or two digits of a number was a decimal comma."""
    return F.regexp_replace(_c(column), r"(\d) (?=\d{1,2}(?!\d))", "$1,")


def page_scope(column: str | Column) -> Column:
    """The scope in front of a ``scope/slug``."""
    return F.element_at(F.split(_c(column), "/"), 1)


def temporal_tag(valid_from: str | Column, valid_until: str | Column) -> Column:
    a, b = _c(valid_from), _c(valid_until)
    return (
        F.when(a.isNotNull() & b.isNotNull(), F.concat(F.lit("["), a, F.lit(" – "), b, F.lit("]")))
        .when(a.isNotNull(), F.concat(F.lit("[seit "), a, F.lit("]")))
        .when(b.isNotNull(), F.concat(F.lit("[bis "), b, F.lit("]")))
        .otherwise(F.lit(""))
    )


def iso_date(column: str | Column) -> Column:
    """The date in the first ten characters, quotes stripped; null if there is none."""
    return F.try_to_date(F.substring(F.regexp_replace(F.trim(_c(column)), "^['\"]+|['\"]+$", ""), 1, 10), "yyyy-MM-dd")


def any_contains(column: str | Column, markers: tuple[str, ...]) -> Column:
    return reduce(lambda x, y: x | y, [F.contains(F.lower(_c(column)), F.lit(m)) for m in markers])


def source_sentence(text: str | Column, label: str | Column, most: int = 200) -> Column:
    """The first sentence that names the label, else the beginning of the text; cut at a blank after 150 characters if it is too long."""
    t, name = _c(text), F.lower(_c(label))
    sentences = F.filter(F.split(t, r"(?<=[.!?])\s+"), lambda s: F.contains(F.lower(s), name))
    named = F.size(sentences) > 0
    blank = " \t\r\n"
    first = F.when(named, F.trim(F.get(sentences, F.lit(0)), F.lit(blank))).otherwise(t)
    head = F.substring(first, 1, most)
    last = F.lit(most) - F.locate(" ", F.reverse(head))  # characters before the last blank, ``most`` if there is none
    short = F.when((F.locate(" ", head) > 0) & (last > 150), F.substring(head, F.lit(1), last)).otherwise(head)
    cut = F.concat(F.rtrim(short, F.lit(blank)), F.lit("…"))
    return F.when(F.coalesce(name, F.lit("")) == "", F.substring(t, 1, most)).when(F.length(first) > most, cut).otherwise(F.trim(first, F.lit(blank)))
