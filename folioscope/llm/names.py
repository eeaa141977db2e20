"""Variant spellings of names of people and organisations, linked.

1. Labels become tokens: lower case, umlauts written out, titles dropped, legal forms set apart. Equal
   token lists are one label, so repeated labels of any number are one row of all that follows.
2. Tokens that differ by typing errors meet in a set-similarity join on their q-grams: each token is
   looked up only under its rarest grams, as many as its allowed edits can destroy plus one.
3. Labels meet on pairs of tokens, rarest first by the frequency of a token together with its
   misspellings. Every token of one label must have a partner in the other, so a label is looked up by its
   heaviest token with a form of its second one, and by each other token with a form of its heaviest. The
   first of the two is equal or misspelt; the form of the second names every relation that counts: equal or
   misspelt, the full name of a pet name, the beginning or end that a short form keeps, an initial, an
   acronym. A surname that a third of the labels share is thus never a key alone.
4. Pairs are verified by soft weighted token similarity. Tokens match if they are equal, misspelt, an
   abbreviation, an initial or a pet name of each other; rare tokens weigh more, and every token that
   names something must find a partner, so that relatives and sister companies stay apart.
5. Matches by initial, pet name or abbreviated given name count only if they point at one person.
   Components of the matches are the sets of variants.

Defined cases: null and empty labels and those without a word are linked with nothing; tokens with digits
must be equal; repeated rows of an id
count once; types only say which labels are looked at: a pair needs one label under PERSON or
ORGANIZATION; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.durable import cut
from folioscope.operators.components import connected_components

#: Titles and forms of address, as tokens after normalisation.
TITLES = {"dr", "prof", "mag", "dipl", "ing", "herr", "frau", "fa", "firma", "hr", "fr", "mr", "mrs", "ms", "mmag", "dkfm", "med", "jur", "phil", "bsc", "msc", "mba", "ddr", "di", "univ"}
#: Legal forms, longest first, and the code they stand for.
LEGAL = (
    ("gesellschaft mit beschraenkter haftung und co kommanditgesellschaft", "gmbh co kg"), ("gesellschaft mit beschraenkter haftung", "gmbh"), ("offene handelsgesellschaft", "ohg"), ("eingetragene genossenschaft", "eg"),
    ("eingetragener verein", "ev"), ("kommanditgesellschaft", "kg"), ("aktiengesellschaft", "ag"), ("g m b h und co k g", "gmbh co kg"), ("g m b h co k g", "gmbh co kg"), ("gmbh und co kg", "gmbh co kg"), ("gmbh co kg", "gmbh co kg"),
    ("gmbh u co kg", "gmbh co kg"), ("gmbh cokg", "gmbh co kg"), ("g m b h", "gmbh"), ("ges m b h", "gmbh"), ("gesmbh", "gmbh"), ("mbh", "gmbh"), ("o h g", "ohg"), ("gmbh", "gmbh"), ("ohg", "ohg"), ("e v", "ev"), ("ev", "ev"), ("e g", "eg"), ("eg", "eg"), ("k g", "kg"), ("kg", "kg"), ("a g", "ag"), ("ag", "ag"), ("ug", "ug"), ("gbr", "gbr"), ("se", "se"),
)
#: Given names and their pet names.
_PETS = {
    "albrecht": "abi albi brecht", "alexander": "alex lex lexi sascha xandi xandl", "anneliese": "anni anna annelie liese liesl", "barbara": "babsi baerbel wetti barbe", "bernhard": "bernd berni hardy", "brigitte": "biggi gitti gitte brigitta",
    "christoph": "chris stoffl stoffel christl", "clementine": "clemi menti tina tine", "cornelia": "conny nelly nele corni", "dietrich": "dieter didi dirk", "dominik": "domi nik nick", "dorothea": "doro thea dorli dora dorle",
    "eduard": "edi ede eddi", "eleonore": "nora lore ella nore elli", "elisabeth": "elli lisi liesl lisa sissi sisi betty else liesel", "ferdinand": "ferdl ferdi nandl", "franziska": "franzi fanni fanny ziska", "friedrich": "fritz friedl fredl fredi",
    "gabriele": "gabi gaby", "georg": "schorsch girgl schurl", "gerhard": "gerd", "gertraud": "gerti traudl traude trude gerdi", "hannelore": "hanni hanne lore loni hanna", "heinrich": "heini heinz hein", "hubertus": "hubsi hubert bertl bert",
    "johannes": "hannes hans hansi johann jo", "josef": "pepi sepp seppi beppo jupp joseph joe", "josefine": "fini josi peppi pepi josie", "karoline": "karo lina line", "katharina": "kathi kati kaethe rina", "konrad": "konni konny conny kurt",
    "leopold": "poldi poldl leo", "ludwig": "lutz wiggerl luggi lulu", "luise": "lulu isi lou luisl", "magdalena": "leni lena magda", "margarete": "gretl grete gretel gretchen greta", "maximilian": "max maxi maxl",
    "rosemarie": "rosl romy rosi", "roswitha": "rosi witha", "rudolf": "rudi rudl rolf", "sebastian": "basti wastl sebi", "siegfried": "siggi sigi", "stefanie": "steffi", "susanne": "susi sanne suse", "theodor": "theo", "theresia": "resi resl thesi",
    "thomas": "tom tommi thomi", "ulrich": "uli", "walburga": "burgi wally walli burga", "wilhelm": "willi willy helmi helm", "wolfgang": "wolfi wolf", "anton": "toni", "michael": "michi", "andreas": "andi", "matthias": "matthi hias",
}
PET_NAMES: dict[str, tuple[str, ...]] = {}
for _full, _short in _PETS.items():
    for _pet in _short.split():
        PET_NAMES[_pet] = (*PET_NAMES.get(_pet, ()), _full)
_DIGIT = re.compile("[0-9]")
LABEL = "label_key string, tokens array<string>, initials array<string>, legal string"


def plain(text: str) -> str:
    """Lower case, umlauts written out, other marks dropped, everything but letters and digits a blank."""
    t = unicodedata.normalize("NFC", text).casefold()
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss"), ("&", " und ")):
        t = t.replace(a, b)
    t = "".join(ch for ch in unicodedata.normalize("NFD", t) if not unicodedata.combining(ch))
    t = re.sub(r"(?<=[a-z]{3})\.(?=[a-z]{2})", "", t)  # an abbreviation inside a compound
    return re.sub(r"[^a-z0-9]+", " ", t).strip()


def parse_label(text: str) -> tuple[list[str], list[str], str]:
    """(tokens, initials, legal form). A legal form counts only where something else is left."""
    p = plain(text).replace(" und co", " co")
    legal = ""
    for form, code in LEGAL:
        m = re.search(rf"(?:^|\s){form}$", p)
        if m and m.start() > 0:
            p, legal = p[: m.start()].strip(), code
            break
    words = [w for w in p.split() if w not in TITLES] or p.split()
    tokens = [w for w in words if len(w) > 1 or w.isdigit()]
    return tokens, [w for w in words if len(w) == 1 and w.isalpha()], legal


def damerau(a: str, b: str, most: int) -> int:
    """Edit distance with transpositions of neighbours, or most + 1 if it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if before is not None and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return last[-1]


def allowed_edits(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return 0 if n < 4 else 1 if n < 10 else 2


def is_short_form(short: str, long: str) -> bool:
    """An abbreviation: same beginning and then letters of the long form in order, or the end of a compound."""
    if len(short) < 3 or len(short) >= len(long):
        return False
    if len(short) >= 6 and long.endswith(short):
        return True
    if long[:3] != short[:3]:
        return False
    rest = iter(long)
    return all(ch in rest for ch in short)


def is_acronym(short: str, long: str) -> bool:
    """Two or three letters of a long compound in order, the first one first."""
    if not 2 <= len(short) <= 3 or len(long) < 8 or short[0] != long[0]:
        return False
    rest = iter(long)
    return all(ch in rest for ch in short)


def are_apart(n: int, m: int) -> bool:
    """Whether two tokens in n and m labels are names of their own: a misspelling is far rarer than what it misspells."""
    return min(n, m) >= 10 and 8 * min(n, m) >= max(n, m)


def token_similarity(a: str, b: str, df: dict[str, int]) -> tuple[float, bool]:
    """(similarity, whether it is weak evidence). ``df``: in how many labels each token is."""
    if a == b:
        return 1.0, False
    if _DIGIT.search(a) or _DIGIT.search(b):
        return 0.0, False
    k = allowed_edits(a, b)
    d = damerau(a, b, k) if k and not are_apart(df.get(a, 0), df.get(b, 0)) else 9
    if d <= k:
        return 1.0 - 0.1 * d, False
    fa, fb = PET_NAMES.get(a, ()), PET_NAMES.get(b, ())
    if b in fa or a in fb or set(fa) & set(fb):
        return 0.85, True
    if any(damerau(x, full, 1) <= 1 for x, names in ((a, fb), (b, fa)) for full in names):
        return 0.8, True  # a misspelt given name against a pet name
    short, long = sorted((a, b), key=len)
    if is_short_form(short, long):
        return 0.85, len(short) < 5
    if len(short) >= 5 and any(is_short_form(short[:i] + short[i + 1 :], long) for i in range(3, len(short))) and long[:3] == short[:3]:
        return 0.75, True
    if is_acronym(short, long):
        return 0.7, True
    return 0.0, False


def compare(a: tuple, b: tuple, weight: dict[str, float], df: dict[str, int], threshold: float) -> tuple[float, bool]:
    """Soft weighted similarity of two labels (tokens, initials, legal), and whether it rests on weak evidence."""
    (ta, ia, la), (tb, ib, lb) = a, b
    if la and lb and la != lb:
        return 0.0, False
    used_a, used_b, weak = {}, {}, False
    for i, x in enumerate(ta):  # equal tokens first; the others are few
        j = next((j for j, y in enumerate(tb) if x == y and j not in used_b), None)
        if j is not None:
            used_a[i] = used_b[j] = 1.0
    pairs = sorted(((*token_similarity(x, y, df), i, j) for i, x in enumerate(ta) if i not in used_a for j, y in enumerate(tb) if j not in used_b), key=lambda p: -p[0])
    for s, w, i, j in pairs:
        if s > 0 and i not in used_a and j not in used_b:
            used_a[i] = used_b[j] = s
            weak |= w
    left_a, left_b = [t for i, t in enumerate(ta) if i not in used_a], [t for j, t in enumerate(tb) if j not in used_b]
    ia, ib = list(ia), list(ib)
    half = []
    for left, initials in ((left_a, ib), (left_b, ia)):
        for t in list(left):
            if t[0] in initials:
                initials.remove(t[0])
                left.remove(t)
                half.append(t)
                weak = True
    if left_a or left_b:
        return 0.0, False
    if ia and ib and not set(ia) & set(ib):
        return 0.0, False  # two different middle initials
    if not used_a:
        return 0.0, False
    gain = sum(s * (weight[ta[i]]) for i, s in used_a.items()) + sum(s * weight[tb[j]] for j, s in used_b.items()) + 0.6 * sum(weight[t] for t in half)
    total = sum(weight[t] for t in (*ta, *tb))
    score = gain / total if total else 0.0
    if la and not lb or lb and not la:
        score *= 0.98
    return (score, weak) if score >= threshold else (0.0, False)


def labels(entities: DataFrame) -> DataFrame:
    """(id, named, label_key, tokens, initials, legal) once per id."""
    once = entities.where(F.col("id").isNotNull() & F.col("label").isNotNull()).groupBy("id").agg(F.min("label").alias("label"), F.max(F.upper(F.trim("entity_type")).isin("PERSON", "ORGANIZATION").cast("int")).alias("named"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parse_label(t) for t in batch.column(1).to_pylist()]
            keys = [" ".join(sorted(t)) + "|" + " ".join(sorted(i)) + "|" + l for t, i, l in found]
            strings = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(keys, pa.string()), pa.array([t for t, _, _ in found], strings), pa.array([i for _, i, _ in found], strings), pa.array([l for _, _, l in found], pa.string())], names=["id", "named", "label_key", "tokens", "initials", "legal"])

    shaped = once.select("id", "label", F.coalesce("named", F.lit(0)).alias("named"))
    parsed = shaped.mapInArrow(parse, "id string, named int, " + LABEL)
    return parsed.where((F.size("tokens") > 0) & F.exists("tokens", lambda t: ~t.rlike("[0-9]")))


def misspelt_tokens(tokens: DataFrame, q: int = 3) -> DataFrame:
    """Pairs (a, b), both directions, of tokens within their allowed edits. ``tokens``: (token, df)."""
    padded = F.concat(F.lit("#"), "token", F.lit("#"))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - (q - 1)), lambda i: F.substring(padded, i, F.lit(q))))
    listed = tokens.where((F.length("token") >= 4) & ~F.col("token").rlike("[0-9]")).select("token", F.length("token").alias("n"), F.explode(grams).alias("gram"))
    frequency = listed.groupBy("gram").agg(F.count(F.lit(1)).alias("gram_df"))
    # An edit destroys q grams, a transposition q + 1; the prefix holds one more than all edits can destroy.
    destroyed = F.when(F.col("n") < 9, q + 1).otherwise(2 * (q + 1)) + 1
    prefix = (
        listed.join(frequency, "gram").groupBy("token", "n").agg(F.array_sort(F.collect_list(F.struct("gram_df", "gram"))).alias("g"))
        .select("token", "n", F.explode(F.slice(F.col("g.gram"), F.lit(1), destroyed)).alias("gram"))
    )
    a, b = prefix.alias("a"), prefix.alias("b")
    most = F.when(F.least(F.col("a.n"), F.col("b.n")) < 10, 2).otherwise(4)  # a transposition is two plain edits
    met = (
        a.join(b, (F.col("a.gram") == F.col("b.gram")) & (F.col("a.token") < F.col("b.token")) & (F.abs(F.col("a.n") - F.col("b.n")) <= 2))
        .where(F.levenshtein(F.col("a.token"), F.col("b.token"), 4).between(0, most))
        .select(F.col("a.token").alias("a"), F.col("b.token").alias("b")).distinct()
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [(x, y) for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if damerau(x, y, allowed_edits(x, y)) <= allowed_edits(x, y)]
            both = [*good, *((y, x) for x, y in good)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in both], pa.string()), pa.array([y for _, y in both], pa.string())], names=["a", "b"])

    return met.mapInArrow(verify, "a string, b string")


@lru_cache(maxsize=200_000)
def full_names(token: str) -> tuple[str, ...]:
    """The full given names that a token stands for: a pet name of them, one of them, or one misspelt by an edit."""
    near = (f for f in _PETS if abs(len(f) - len(token)) <= 1 and (f[:2] == token[:2] or f[-2:] == token[-2:]) and damerau(token, f, 1) <= 1)
    return tuple({*PET_NAMES.get(token, ()), *near})


def second_keys(token: str, spellings: list[str]) -> list[tuple[str, str]]:
    """(key a label is found under, key it looks for) of a token that is second in a pair; one for each relation to its partner."""
    both = [f"t:{s}" for s in (token, *spellings)]
    if not _DIGIT.search(token):
        both += [f"p:{f}" for f in full_names(token)]
        both += [f"s:{token[:3]}"] if len(token) >= 3 else []
        both += [f"e:{token[-6:]}"] if len(token) >= 6 else []
    out = [(k, k) for k in both]
    if not _DIGIT.search(token):
        out.append((f"I:{token[0]}", f"i:{token[0]}"))
        out += [(f"a:{token[0]}", f"A:{token[0]}")] if 2 <= len(token) <= 3 else []
        out += [(f"A:{token[0]}", f"a:{token[0]}")] if len(token) >= 8 else []
    return out


def pair_keys(tokens: list[str], spellings: list[list[str]], initials: list[str]) -> tuple[set[tuple[str, str]], set[tuple[str, str]]]:
    """(pairs a label is found under, pairs it looks for). ``tokens``: heaviest first; ``spellings``: the more frequent ones of each."""
    second = [second_keys(t, s) for t, s in zip(tokens, spellings, strict=True)]
    first = [(t, *s) for t, s in zip(tokens, spellings, strict=True)]
    found, sought = set(), set()
    for i, anchors in enumerate(first):
        others = [(j, f, g) for j, keys in enumerate(second) if j != i for f, g in keys]
        short = [(f"i:{x}", f"I:{x}") for x in initials] + [(f"i:{x}", f"i:{x}") for x in initials] + ([("alone", "alone")] if len(tokens) == 1 else [])
        partner = 1 if i == 0 else 0
        for a in anchors:
            found |= {(a, f) for _, f, _ in others} | {(a, f) for f, _ in short}
            sought |= {(a, g) for j, _, g in others if j == partner} | {(a, g) for _, g in short}
    return found, sought


def label_matches(distinct: DataFrame, threshold: float = 0.72) -> DataFrame:
    """(a, b, score, weak): verified pairs of label keys. ``distinct``: (label_key, tokens, initials, legal, named)."""
    return verified(*met_labels(distinct), threshold)


def met_labels(distinct: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of label keys that share a pair of tokens, and the labels with their tokens ranked."""
    tokens = distinct.select("label_key", F.explode(F.array_distinct("tokens")).alias("token"))
    frequency = cut(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")))
    misspelt = misspelt_tokens(frequency).join(frequency.select(F.col("token").alias("a"), F.col("df").alias("n")), "a").join(frequency.select(F.col("token").alias("b"), F.col("df").alias("m")), "b")
    few, many = F.least("n", "m"), F.greatest("n", "m")
    misspelt = cut(misspelt.where(~((few >= 10) & (8 * few >= many))))
    total = distinct.count()
    # The rarer of two spellings is also entered under the more frequent one, so that both meet there.
    soft = misspelt.groupBy("a").agg(F.sum("m").alias("more"), F.array_sort(F.collect_list(F.when(F.struct("m", "b") > F.struct("n", "a"), F.col("b")))).alias("spellings"))
    weights = frequency.join(soft, F.col("token") == F.col("a"), "left").select("token", "df", F.coalesce("spellings", F.array().cast("array<string>")).alias("spellings"), F.log((F.lit(total) + 1.0) / (F.col("df") + F.coalesce("more", F.lit(0)))).alias("weight")).withColumn("weight", F.greatest("weight", F.lit(0.2)))
    listed = tokens.join(weights, "token").groupBy("label_key").agg(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), F.col("token").alias("t"), F.col("df").alias("df"), "spellings"))).alias("ranked"))
    ready = cut(distinct.join(listed, "label_key"))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for label, named, ts, sp, initials in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                found, sought = pair_keys(ts, sp, initials)
                out += [(label, named, False, *k) for k in found]
                out += [(label, named, True, *k) for k in sought]
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.bool_(), pa.string(), pa.string()), strict=True)], names=["label_key", "named", "seeks", "first", "second"])

    entered = cut(ready.select("label_key", "named", "ranked.t", "ranked.spellings", "initials").mapInArrow(keys, "label_key string, named int, seeks boolean, first string, second string"))
    left = entered.where("seeks").select(F.col("label_key").alias("x"), F.col("named").alias("nx"), "first", "second")
    right = entered.where("NOT seeks").select(F.col("label_key").alias("y"), F.col("named").alias("ny"), "first", "second")
    met = left.join(right, ["first", "second"]).where((F.col("x") != F.col("y")) & (F.col("nx") + F.col("ny") > 0))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), ready


def verified(pairs: DataFrame, ready: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose soft weighted similarity reaches the threshold."""
    shape = F.struct("tokens", "initials", "legal", F.col("ranked.t").alias("t"), F.col("ranked.w").alias("w"), F.col("ranked.df").alias("df"))
    sides = pairs.join(ready.select(F.col("label_key").alias("a"), shape.alias("x")), "a").join(ready.select(F.col("label_key").alias("b"), shape.alias("y")), "b").select("a", "b", "x", "y")
    # Certain mismatches need no Python: other legal forms, a token too many, or two tokens that are
    # neither near in spelling nor pet names nor short forms of each other.
    rest_x, rest_y = F.array_except("x.tokens", "y.tokens"), F.array_except("y.tokens", "x.tokens")
    p, r = F.get(rest_x, F.lit(0)), F.get(rest_y, F.lit(0))
    pets = F.create_map(*[x for pet, full in PET_NAMES.items() for x in (F.lit(pet), F.array(*map(F.lit, full)))])
    full_p, full_r = F.coalesce(F.try_element_at(pets, p), F.array(p)), F.coalesce(F.try_element_at(pets, r), F.array(r))
    named = F.exists(full_p, lambda x: F.exists(full_r, lambda y: F.levenshtein(x, y) <= 4))
    acronym = (F.least(F.length(p), F.length(r)) <= 3) & (F.substring(p, 1, 1) == F.substring(r, 1, 1))
    unlike = (
        (F.size(rest_x) == 1) & (F.size(rest_y) == 1) & ~named & ~acronym & (F.levenshtein(p, r, 4) < 0)
        & (F.substring(p, 1, 3) != F.substring(r, 1, 3)) & ~F.endswith(p, r) & ~F.endswith(r, p)
    )
    no_initials = (F.size("x.initials") == 0) & (F.size("y.initials") == 0)
    clash = (F.col("x.legal") != "") & (F.col("y.legal") != "") & (F.col("x.legal") != F.col("y.legal"))
    sides = sides.where(~clash & ~(no_initials & (F.size("x.tokens") != F.size("y.tokens"))) & ~F.coalesce(unlike, F.lit(False)))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for a, b, x, y in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                weight = {t: -w for s in (x, y) for t, w in zip(s["t"], s["w"], strict=True)}
                df = {t: n for s in (x, y) for t, n in zip(s["t"], s["df"], strict=True)}
                score, weak = compare((x["tokens"], x["initials"], x["legal"]), (y["tokens"], y["initials"], y["legal"]), weight, df, threshold)
                if score:
                    out.append((a, b, score, weak))
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.float64(), pa.bool_()), strict=True)], names=["a", "b", "score", "weak"])

    return sides.mapInArrow(verify, "a string, b string, score double, weak boolean")


def variant_sets(entities: DataFrame, threshold: float = 0.72) -> DataFrame:
    """(id, component, named): the entities that share a set of variants with another label or id."""
    parsed = cut(labels(entities))
    distinct = parsed.groupBy("label_key").agg(F.first("tokens").alias("tokens"), F.first("initials").alias("initials"), F.first("legal").alias("legal"), F.max("named").alias("named"))
    matches = cut(label_matches(distinct, threshold))
    strong = matches.where(~F.col("weak")).select("a", "b")
    solid = connected_components(strong)
    weak = matches.where("weak").select("a", "b")
    both = weak.unionByName(weak.select(F.col("b").alias("a"), F.col("a").alias("b")))
    aim = both.join(solid.select(F.col("node").alias("b"), F.col("component").alias("aim")), "b", "left").withColumn("aim", F.coalesce("aim", "b"))
    own = aim.join(solid.select(F.col("node").alias("a"), F.col("component").alias("own")), "a", "left").withColumn("own", F.coalesce("own", "a"))
    # The side with less of a name decides (fewer tokens, then a pet name, then the shorter one): it has to
    # point at one set only. Sets that are short forms themselves are no aims as long as there is a fuller one.
    def fullness(column: str) -> Column:
        words = F.split(F.element_at(F.split(column, "\\|"), 1), " ")
        return F.struct(F.size(words), (~F.arrays_overlap(words, F.array(*map(F.lit, PET_NAMES)))).cast("int"), F.length(column))

    pointing = cut(own.where((fullness("a") <= fullness("b")) & (F.col("own") != F.col("aim"))).select("own", "aim").distinct())
    short = pointing.select(F.col("own").alias("aim"), F.lit(True).alias("is_short")).distinct()
    ranked = pointing.join(short, "aim", "left").groupBy("own").agg(F.collect_set(F.when(F.col("is_short").isNull(), F.col("aim"))).alias("full"), F.collect_set("aim").alias("all"))
    aims = ranked.select("own", F.when(F.size("full") > 0, F.col("full")).otherwise(F.col("all")).alias("aims"))
    single = aims.where(F.size("aims") == 1).select(F.col("own").alias("a"), F.element_at("aims", 1).alias("b"))
    linked = connected_components(strong.unionByName(single))
    return parsed.join(linked, F.col("label_key") == F.col("node"), "left").select("id", "named", F.coalesce("component", "label_key").alias("component"))


def variant_pairs(entities: DataFrame, threshold: float = 0.72) -> DataFrame:
    """All pairs (a < b) of ids within a set of variants that holds a person or an organisation."""
    sets = cut(variant_sets(entities, threshold))
    named = sets.where("named = 1").select("component").distinct()
    kept = sets.join(named, "component", "left_semi")
    x, y = kept.select("component", F.col("id").alias("a")), kept.select("component", F.col("id").alias("b"))
    return x.join(y, "component").where("a < b").select("a", "b").distinct()
