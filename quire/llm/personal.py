"""Personal data in free text: finding and replacing it (problem 3).

Bootstrapped contextual extraction. Numbers of unmistakable form and names after a title are the seeds. The words before a
mention are its pattern. Spark scores the graph of patterns and instances in turns: a pattern is as good as the
instances found with it, an instance as good as its patterns; so labels such as a new word for "tax number", or the line
after a closing formula, become patterns, and given names and family names a lexicon, that find the mentions no seed
covers. Addresses and e-mail have a form of their own and need no pattern.

The corpus is read twice, once for the graph (pre-aggregated edges) and once to extract. Patterns and lexicon are
vocabularies, not documents: entries need support, and their number is checked before they are sent out. A lexicon of names beyond
``MOST_NAMES`` stays a table: each text's own capitalised words are looked up in it by a join, and only what is found goes with the text.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import re
import unicodedata
from bisect import bisect_left
from dataclasses import replace

import pyarrow as pa
import regex

from pyspark.sql import DataFrame, functions as F, types as T

from quire.session import Scratch

#: Rounds of scoring; names sent out with the model at most (more stay a table); labels and patterns at most (more raises: raise the support).
ROUNDS, MOST_NAMES, MOST_PATTERNS = 3, 200_000, 1_000_000
#: The types of items.
TYPES = ("EMAIL", "PHONE", "ID_NUMBER", "STREET_ADDRESS", "PERSON_NAME")
#: Characters of a word that are looked at; no label, title or firm word is longer.
WORD = 64

_S = r"(?:[  ]|\n)"
_DOT = r"(?:\.|\s?[\[({](?:dot|punkt|point|punto)[\])}]\s?)"
_EMAIL = regex.compile(
    r"(?<![\w.+-])[\w](?:[\w.+-]*\w)?(?:" + _S + r"?@" + _S + r"?|\s?[\[({](?:at|ät|arroba)[\])}]\s?)\w[\w-]*(?:-\n\w[\w-]*)?(?:" + _DOT + r"\n?\w[\w-]*)+"
    r"|(?<![\w.+-])[\w][\w.+-]* at [\w-]+(?: dot [\w-]+)+", regex.IGNORECASE)

_MARK = re.compile(r"\w")
_AT = re.compile(r"@|[\[({](?:at|ät|arroba)[\])}]|(?<=\w) at (?=[\w-]+ dot )", re.IGNORECASE)
_N = r"(?:[  ]|\n)?"
_ID_SURE = re.compile(
    r"(?<![\w.,/+-])(?:\d{3}-\d{2}-\d{4}"
    r"|[A-Z]{2}" + _N + r"\d{2}" + _N + r"\d{2}" + _N + r"\d{2}" + _N + r"[A-D]"
    r"|[XYZ][- ]?\d{7}[- ]?[A-Z]|\d{8}[- ]?[A-Z]|\d{2}\.\d{3}\.\d{3}-?" + _N + r"[A-Z]"
    r"|\d{2}" + _N + r"\d{6}" + _N + r"[A-Z]" + _N + r"\d{3}"
    r"|[12]" + _N + r"\d{2}" + _N + r"\d{2}" + _N + r"\d{2}" + _N + r"\d{3}" + _N + r"\d{3}" + _N + r"\d{2})(?![\w/-]|[.,]\d)")
_ID_MAYBE = re.compile(r"(?<![\w.,/+-])\d{2}" + _N + r"\d{3}" + _N + r"\d{3}" + _N + r"\d{3}(?![\w/-]|[.,]\d| \d)")
_ACCOUNT = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?:[ \n]?[\dA-Z]{4})*[ \n]?[\dA-Z]{0,3}$")
_EXT = r"(?:,?\s?(?:ext\.?|x|Durchwahl|App\.?|poste|extensión|-Nebenstelle)\s?\d{1,5})?"
_SEP = r"(?:[  ]?[–./-][  ]?|[  ]|\n)?"
_PHONE_SURE = re.compile(r"(?<![\w.,+])(?:\(\+\d{2,3}\)|\(00\d{2}\)|\+\d{1,3}|00[1-9]\d)(?:" + _SEP + r"(?:\(0?\d{0,4}\)|\d{1,8})){2,7}" + _EXT + r"(?![\w/]|[.,]\d)")
_PHONE_MAYBE = re.compile(r"(?<![\w.,+/-])(?:\(0\d{1,5}\)|\(\d{3}\)|0\d{1,5}|[1-9]\d{2})(?:" + _SEP + r"\d{1,8}){1,6}" + _EXT + r"(?![\w/]|[.,]\d)")



def _class(*categories: str) -> str:
    """The ranges of all characters of the basic plane of these Unicode categories."""
    out, start, last = [], None, None
    for c in range(1 << 16):
        if unicodedata.category(chr(c)) in categories:
            start, last = (c if start is None else start), c
        elif start is not None:
            out.append(chr(start) if start == last else f"{chr(start)}-{chr(last)}")
            start = None
    return "".join(out)


_UPPER, _LOWER = _class("Lu"), _class("Ll")
_LETTER = _class("Lu", "Ll", "Lt", "Lm", "Lo")


def _lettered(pattern: str) -> re.Pattern:
    """Compiled by the faster standard module, which has no classes of letters."""
    for name, letters in ((r"\p{Lu}", _UPPER), (r"\p{Ll}", _LOWER), (r"\p{L}", _LETTER)):
        pattern = pattern.replace("[" + name, "[" + letters).replace("(?![" + name, "(?![" + letters).replace(name, "[" + letters + "]")
    return re.compile(pattern)


_DE_NO = r"\d{1,3}(?:[ ]?[a-h](?![\p{L}\d]))?(?:[ ]?[-–/][ ]?\d{1,3}(?:[ ]?[a-h](?![\p{L}\d]))?)?(?![\d.,]\d|\d)"
# Words for streets.
_STREET = _lettered(
    r"(?<![\p{L}\d])(?:"
    r"(?:\p{Lu}[\p{L}-]*(?:[¬‐­-][ ]?\n\p{Ll}+)?(?:straße|strasse|str\.|weg|gasse|ring|platz|allee|ufer|winkel|damm|steig|stieg|pfad|graben|chaussee|promenade|zeile)|\p{Lu}\p{L}+(?:er|s)?[ ](?:Straße|Weg|Gasse|Ring|Platz|Allee|Ufer|Damm|Str\.|Chaussee))" + _S + _DE_NO
    + r"|(?:Am|Im|An" + _S + r"de[rnm]|Hinter" + _S + r"de[rnm]|Unter" + _S + r"de[rnm]|Zum|Zur|Auf" + _S + r"de[rm]|Bei" + _S + r"de[rm]|In" + _S + r"de[rnm]|Vor" + _S + r"de[rm]|An|Auf|Beim|Vorm|Über)(?:" + _S + r"\p{Lu}[\p{L}-]+){1,3}" + _S + _DE_NO
    + r"|\d{1,3}(?:[ ](?:bis|ter|quater)|[ ]?[A-D](?=[, ]))?,?" + _S + r"(?:rue|allée|chemin|impasse|bd|boulevard|avenue|av\.|place|quai|route|cours|passage|square|sentier|ruelle)(?:" + _S + r"(?:de|du|des|la|le|les|l’|d’|à|au|aux|en|sur)(?![\p{L}])){0,3}(?:" + _S + r"?(?:[ld][’'])?(?:(?:Trois|Deux|Quatre|Sept|Dix|Vieux|Vieille|Vieil|Grande?s?|Petite?s?|Sainte?|Saints|Hautes?|Hauts?|Bas|Basse|Canal|Beau|Belle|Bon|Bonne|Nouveau|Nouvelle|Général|Maréchal|Docteur|Jean|Victor|Pont|Moulin|Clos|Champs?)" + _S + r"){0,2}\p{Lu}[\p{L}’-]*(?:[ ]\p{Lu}[\p{L}’-]*){0,2})"
    + r"|(?:(?:Flat|Unit|Apt|Suite)\.?[ ]\d+[A-Z]?,[ ])?\d{1,4}[A-Za-z]?(?:" + _S + r"\p{Lu}[\p{L}’']+){1,3}" + _S + r"(?:Street|St\.?|Lane|Ln\.?|Rise|Road|Rd\.?|Ave\.?|Avenue|Row|Drive|Dr\.?|Close|Court|Ct\.?|Way|Place|Square|Gardens|Terrace|Crescent|Hill|Walk|Mews|Boulevard|Blvd\.?|Green|Park|Parade)(?![\p{L}])(?:," + _S + r"(?:Apt|Unit|Flat|Suite|Apartment|Floor|\#)\.?" + _S + r"?\d+[A-Z]?(?![\p{L}\d]))?"
    + r"|(?:Calle|C/|Cl\.|Plaza|Pza\.?|Plza\.?|Avda\.?|Avenida|Av\.|Camino|Cno\.|Paseo|P\.º|Ronda|Carretera|Ctra\.|Travesía|Callejón|Glorieta)(?:" + _S + r"(?:de|del|la|las|los|el)(?![\p{L}])){0,3}(?:" + _S + r"\p{Lu}[\p{L}]+){1,3},?" + _S + r"(?:n\.?º[ ]?)?\d{1,3}(?:[ ]?(?:bis|[A-H](?![\p{L}])))?(?![\d.,]\d|\d)(?:," + _S + r"\d{1,2}\.?[ºª]?(?:" + _S + r"(?:[A-H](?![\p{L}])|izq\.?|dcha\.?|izda\.?))?(?=\W|$)(?<=[ºªA-H.]))?"
    + r")")

# Titles and forms of address, particles, words of firms.
_TITLES = frozenset("Herr Herrn Frau Hr. Fr. Mr. Mr Mrs. Mrs Ms. Ms Miss Sr. Sra. Srta. Don Doña Monsieur Madame Mme Mlle M. Dr. Dra. Prof. Señor Señora".split())
_PARTICLE = r"(?:von" + _S + r"der|von" + _S + r"dem|von|van" + _S + r"der|van|zu|zur|de" + _S + r"la|de" + _S + r"los|del|de|di|da|du|la|le|d’)"
_FIRM_WORDS = frozenset("""Stiftung & Söhne Hermanos Bros. Bros GmbH KG OHG AG Inc. Inc Ltd. Ltd LLC S.L. S.A. SARL SAS Co. Systems Handel Logistik Energie Foods Papier Textil
Optik Tooling Packaging Ceramics Servicios Transports Supplies Matériaux Werkstoffe Straße Street Ave. Ave Lane Road Rise branch site""".split())
_FIRM_PAIRS = frozenset(["et Fils", "und Söhne", "e. K.", "e. K", "e. V."])
_TOKEN = regex.compile(r"(?:\p{Lu}\.(?:-\p{Lu}\.)?(?=" + _S + r"\p{Lu})|\p{Lu}[\p{L}\p{M}’']*(?:[-‐¬­][ ]?\n\p{Ll}+)?(?:-\n?\p{Lu}[\p{L}\p{M}]*(?:[-‐¬­][ ]?\n\p{Ll}+)?)*)")
GLUED = 12  # no match of the next pattern is longer
_GLUE = regex.compile(r"(?:[ ]|[ ]?\n)(?:" + _PARTICLE + r"(?:[ ]|\n))?")
_COMMA = regex.compile(r",(?:[ ]|\n)")


@dataclass
class Model:
    """What was learned: labels of numbers with their score as (identity, phone), given names, family names, patterns of names. Where the names are too
    many, ``names`` holds them as a table (``name``, ``given``, ``family``)."""

    labels: dict[str, tuple[float, float]] = field(default_factory=dict)
    given: frozenset[str] = frozenset()
    family: frozenset[str] = frozenset()
    patterns: frozenset[str] = frozenset()
    single: frozenset[str] = frozenset()
    names: DataFrame | None = None


_WORD_BEFORE = re.compile(r"([^\W\d_][^\W\d_.’'/-]*(?:[.’'/-]+[^\W\d_]*)*)[\s:(]*(?:n\.?º|Nr\.|No\.|#)?[\s:(+]*$")
_DATE = re.compile(r"\d{1,2}[./-]\d{1,2}[./-]\d{2,4}|\d{4}[./-]\d{2}[./-]\d{2}")


def _word_before(text: str, at: int) -> tuple[str, int]:
    """The word before ``at`` (its last ``WORD`` characters), over any white space, and its start; ("", 0) if there is none."""
    k = at
    while k > 0 and text[k - 1].isspace():
        k -= 1
    end, least = k, max(0, k - WORD)
    while k > least and not text[k - 1].isspace():
        k -= 1
    return text[k:end], k


def _label(text: str, at: int) -> str:
    """The word before a number, which labels it."""
    if at > 0 and text[at - 1].isspace():
        second, k = _word_before(text, at)
        m = _WORD_BEFORE.search(_word_before(text, k)[0] + " " + second)
    else:  # the number begins inside a word
        k = at
        while k > max(0, at - WORD) and not text[k - 1].isspace():
            k -= 1
        m = _WORD_BEFORE.search(_word_before(text, k)[0] + " " + text[k:at])
    return m.group(1).lower().strip(".") if m else ""


class _Taken:
    """Ranges without overlap, by their starts."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def free(self, a: int, b: int) -> bool:
        k = bisect_left(self.starts, b)
        return k == 0 or self.ends[k - 1] <= a

    def add(self, a: int, b: int) -> None:
        k = bisect_left(self.starts, a)
        self.starts.insert(k, a)
        self.ends.insert(k, b)


def _numbers(text: str) -> Iterator[tuple[str, int, int, str]]:
    """(kind, start, end, label) of numbers: ID, PHONE for sure forms; id?, phone? where the form allows it."""
    taken = _Taken()
    for kind, pattern in (("ID", _ID_SURE), ("PHONE", _PHONE_SURE), ("id?", _ID_MAYBE), ("phone?", _PHONE_MAYBE)):
        for m in pattern.finditer(text):
            a, b = m.span()
            if kind in ("PHONE", "phone?"):
                s = m.group()
                digits = sum(map(str.isdigit, s.partition("ext")[0]))
                if not 8 <= digits <= 15 or _DATE.fullmatch(s):
                    continue
                if kind == "phone?" and s[0] in "123456789" and digits not in (9, 10):
                    continue
            if kind != "id?" and not taken.free(a, b):
                continue
            if _ACCOUNT.search(text, max(0, a - 48), a):
                continue  # inside an account number, which has 34 signs and some gaps at most
            if kind in ("ID", "PHONE"):
                taken.add(a, b)
            yield kind, a, b, _label(text, a)


def _titled(text: str, at: int) -> bool:
    """Whether the word right before ``at`` is a title or form of address."""
    return at > 0 and text[at - 1].isspace() and _word_before(text, at)[0] in _TITLES


_NEXT_WORDS = re.compile(r"[- \n]*(\S{1,%d})(?:\s+(\S{1,%d}))?" % (WORD, WORD))


def _firm_next(text: str, at: int) -> bool:
    """Whether what follows ``at`` marks the words before as a firm, a street or a town."""
    if at >= len(text) or text[at] not in " \n-S":
        return False
    m = _NEXT_WORDS.match(text, at)
    if not m:
        return False
    first = m[1].rstrip(",;:")
    return first in _FIRM_WORDS or first.startswith("Stiftung") or first.rstrip(".") in _FIRM_WORDS or (m[2] is not None and f"{first} {m[2].rstrip(',;')}" in _FIRM_PAIRS)


def _line_pattern(text: str, at: int) -> str:
    """What stands before a name: the last word on its line, or, at the start of a line, the last word of the line before."""
    k = at
    while k > 0 and text[k - 1] in " \u00a0":
        k -= 1
    if k == 0:
        return "^"
    last = text[k - 1]
    if last == "\n" or last == "\f":
        j = k - 1
        if j == 0 or last == "\f" or text[j - 1] == "\n":
            return "⏎⏎"
        word = _word_before(text, j)[0]
        return _hash(word) + "⏎" if word else "⏎⏎"
    word = _word_before(text, k)[0]
    return _hash(word) + "  " if at - k > 1 else _hash(word)


_DIGITS = str.maketrans("0123456789", "##########")


def _hash(word: str) -> str:
    return word.lower().translate(_DIGITS)


def _key(token: str) -> str:
    return (regex.sub(r"[¬‐\u00ad-][ ]?\n(?=\p{Ll})", "", token) if "\n" in token else token).lower()


def _evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of the graph: (kind, pattern, a, b). For numbers a is the digits, b the form; for names a, b are two tokens in a row."""
    for batch in batches:
        kinds, patterns, a, b = [], [], [], []
        for text in batch.column("text").to_pylist():
            if not text:
                continue
            for kind, s, e, label in _numbers(text):
                kinds.append("number"), patterns.append(label), a.append(re.sub(r"[\s.–/-]", "", text[s:e])), b.append(kind)
            tokens = [(m.start(), m.end(), m.group()) for m in _TOKEN.finditer(text)]
            for i, (s, e, t) in enumerate(tokens):
                if t.endswith("."):
                    continue
                titled = _titled(text, s)
                if i + 1 < len(tokens):
                    s2, e2, t2 = tokens[i + 1]
                    glue = text[e:s2]
                    if s2 - e <= GLUED and (_GLUE.fullmatch(glue) or regex.fullmatch(r" \p{Lu}\.[ \n]", glue)):
                        firm = _firm_next(text, e2) or _firm_next(text, e)
                        if t2.endswith(".") and i + 2 < len(tokens) and tokens[i + 2][0] - e2 == 1:
                            t2 = tokens[i + 2][2]
                        if not t2.endswith(".") and "\n" not in glue:
                            kinds.append("firm" if firm else "titled" if titled else "pair"), patterns.append("<title>" if titled else _line_pattern(text, s)), a.append(_key(t)), b.append(_key(t2))
                            continue
                    elif glue in (", ", ",\n"):
                        kinds.append("comma"), patterns.append(_line_pattern(text, s)), a.append(_key(t2)), b.append(_key(t))
                        continue
                if titled:
                    kinds.append("single"), patterns.append("<title>"), a.append(_key(t)), b.append("")
                else:
                    # Words elsewhere count against a token's being a name.
                    kinds.append("house" if _firm_next(text, e) else "word"), patterns.append(_line_pattern(text, s)), a.append(_key(t)), b.append("")
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (kinds, patterns, a, b)], names=["kind", "pattern", "a", "b"])


def learn(texts: DataFrame, support: int = 3) -> Model:
    """Score patterns and instances over all ``texts`` (column ``text``) and keep what has ``support`` and a good score."""
    scratch = Scratch(texts.sparkSession, "personal")
    edges = texts.select("text").mapInArrow(_evidence, "kind string, pattern string, a string, b string")
    edges = scratch.write(edges.groupBy("kind", "pattern", "a", "b").agg(F.count(F.lit(1)).alias("n")), "edges")

    # Numbers: instances are digit strings, patterns are labels.
    numbers = edges.filter("kind = 'number'").select("pattern", "a", "b", "n")
    sure_id, sure_phone = F.col("b") == "ID", F.col("b") == "PHONE"
    known = numbers.select("a", F.when(sure_id, 1.0).otherwise(0.0).alias("i"), F.when(sure_phone, 1.0).otherwise(0.0).alias("p")).groupBy("a").agg(F.max("i").alias("i"), F.max("p").alias("p"))
    labels = None
    for _ in range(ROUNDS):
        scored = numbers.join(known, on="a")
        labels = scored.groupBy("pattern").agg((F.sum(F.col("n") * F.col("i")) / F.sum("n")).alias("i"), (F.sum(F.col("n") * F.col("p")) / F.sum("n")).alias("p"), F.sum("n").alias("n"))
        labels = scratch.write(labels, "labels")
        side = labels.select("pattern", F.col("i").alias("pi"), F.col("p").alias("pp"))
        fresh = numbers.join(side, on="pattern").groupBy("a").agg(F.max(F.when(sure_id, 1.0).when(F.col("b") == "id?", F.when(F.col("pi") >= 0.15, 1.0).otherwise(0.0)).otherwise(0.0)).alias("i"), F.max(F.when(sure_phone, 1.0).when(F.col("b") == "phone?", F.when(F.col("pp") >= 0.15, 1.0).otherwise(0.0)).otherwise(0.0)).alias("p"))
        known = fresh

    # Names: instances are given names, patterns the words before them.
    pairs = edges.filter("kind in ('pair', 'titled', 'firm', 'comma')")
    all_words = edges.filter("kind <> 'number'").groupBy("a").agg(F.sum("n").alias("total"))
    pairs = pairs.join(all_words, on="a").withColumn("name_like", F.when(F.col("kind") == "firm", 0.0).otherwise(1.0))
    given = edges.filter("kind = 'titled'").groupBy("a").agg(F.sum("n").alias("n")).filter("n >= 2").select("a", F.lit(1.0).alias("g"))
    patterns = None
    for _ in range(ROUNDS):
        patterns = pairs.filter("kind <> 'firm'").join(given, on="a", how="left").groupBy("pattern").agg((F.sum(F.col("n") * F.coalesce("g", F.lit(0.0))) / F.sum("n")).alias("w"), F.sum("n").alias("n"))
        patterns = scratch.write(patterns, "patterns")
        given = pairs.join(patterns.select("pattern", "w"), on="pattern").groupBy("a").agg((F.sum(F.col("n") * F.col("w") * F.col("name_like")) / F.max("total")).alias("g"), F.sum(F.col("n") * F.col("w")).alias("mass"))
        given = scratch.write(given.filter((F.col("g") >= 0.25) & (F.col("mass") >= 1.5)).select("a", F.lit(1.0).alias("g")), "given")
    names = given.select("a")
    named = edges.filter("kind in ('pair', 'titled', 'comma')").join(names, on="a").groupBy(F.col("b").alias("f")).agg(F.sum("n").alias("hits"))
    titled = edges.filter("kind = 'single'").groupBy(F.col("a").alias("f")).agg(F.sum("n").alias("hits"))
    family = named.unionByName(titled).groupBy("f").agg(F.sum("hits").alias("hits")).join(all_words.select(F.col("a").alias("f"), "total"), on="f", how="left")
    family = family.filter((F.col("hits") >= 2) & (F.col("hits") >= 0.2 * F.coalesce("total", F.lit(0)))).join(names.withColumnRenamed("a", "f"), on="f", how="left_anti").select("f")

    # Patterns before a family name that stands alone: the word before it, whether it begins with a capital or not.
    lone = edges.filter("kind = 'pair'").select(F.col("a").alias("pattern"), F.col("b").alias("f"), "n").unionByName(edges.filter("kind = 'word'").select("pattern", F.col("a").alias("f"), "n"))
    lone = lone.join(names.select(F.col("a").alias("pattern")), on="pattern", how="left_anti").join(names.select(F.col("a").alias("f")), on="f", how="left_anti")
    lone = lone.join(family.withColumn("y", F.lit(1.0)), on="f", how="left").groupBy("pattern").agg((F.sum(F.col("n") * F.coalesce("y", F.lit(0.0))) / F.sum("n")).alias("w"), F.sum("n").alias("n"))
    lone = lone.filter((F.col("n") >= support) & (F.col("w") >= 0.5)).select("pattern")

    def take(df: DataFrame) -> list:
        rows = df.limit(MOST_PATTERNS + 1).collect()
        if len(rows) > MOST_PATTERNS:
            raise ValueError("there are more patterns than the model may have: raise the support")
        return rows

    lexicon = names.select(F.col("a").alias("name"), F.lit(True).alias("given")).unionByName(family.select(F.col("f").alias("name"), F.lit(False).alias("given")))
    lexicon = scratch.write(lexicon, "lexicon")
    many = lexicon.limit(MOST_NAMES + 1).count() > MOST_NAMES
    known = [] if many else lexicon.collect()  # at most MOST_NAMES
    return Model(
        {r["pattern"]: (r["i"], r["p"]) for r in take(labels.filter((F.col("n") >= support) & ((F.col("i") >= 0.05) | (F.col("p") >= 0.05))))},
        frozenset(r["name"] for r in known if r["given"]),
        frozenset(r["name"] for r in known if not r["given"]),
        frozenset(r[0] for r in take(patterns.filter((F.col("n") >= support) & (F.col("w") >= 0.6)).select("pattern"))),
        frozenset(r[0] for r in take(lone)),
        lexicon if many else None,
    )


def _names(text: str, model: Model) -> Iterator[tuple[int, int]]:
    tokens = [(m.start(), m.end(), m.group()) for m in _TOKEN.finditer(text)]
    i = 0
    while i < len(tokens):
        s, e, t = tokens[i]
        key = _key(t)
        initial = t.endswith(".") and text[max(0, s - 3) : s].lower() != "e. "
        is_given = key in model.given
        is_family = key in model.family or (not initial and "-" in key and any(p in model.family for p in _parts(key)))
        title = _titled(text, s)
        if not (is_given or is_family or initial or title) and not (i + 1 < len(tokens) and tokens[i + 1][0] - e == 2 and _key(tokens[i + 1][2]) in model.given):
            i += 1
            continue
        pattern = "<title>" if title else _line_pattern(text, s)
        # Family name, given name.
        if not is_given and not initial and i + 1 < len(tokens):
            s2, e2, t2 = tokens[i + 1]
            if _COMMA.fullmatch(text[e:s2]) and _key(t2) in model.given and (is_family or pattern in model.patterns or pattern.endswith("⏎")) and not (i + 2 < len(tokens) and _key(tokens[i + 2][2]) in model.family and tokens[i + 2][0] - e2 == 1):
                j = i + 1
                end = e2
                while j + 1 < len(tokens) and text[end : tokens[j + 1][0]] == " " and (regex.fullmatch(r"\p{Lu}\.?", tokens[j + 1][2]) or _key(tokens[j + 1][2]) in model.given) and tokens[j + 1][2].endswith("."):
                    j += 1
                    end = tokens[j][1]
                yield s, end
                i = j + 1
                continue
        j, end, surnames = i, e, int(is_family and not is_given)
        while j + 1 < len(tokens):
            s2, e2, t2 = tokens[j + 1]
            glue = text[end:s2]
            if len(glue) > GLUED or not _GLUE.fullmatch(glue):
                break
            k2 = _key(t2)
            fam = k2 in model.family or ("-" in k2 and any(p in model.family for p in _parts(k2)))
            giv = k2 in model.given
            if fam or giv and not surnames or t2.endswith(".") and not surnames:
                pass
            elif not surnames and (is_given or initial or title) and "\n" not in glue and len(t2) > 2 and not regex.search(r"\d", t2) and (is_given or title or pattern.endswith("⏎") or pattern in model.patterns):
                fam = True  # an unknown family name on the line of a known given name
            else:
                break
            if surnames >= 2 and fam:
                break
            if fam and surnames and "\n" in glue and j + 2 < len(tokens) and _COMMA.fullmatch(text[e2 : tokens[j + 2][0]]) and _key(tokens[j + 2][2]) in model.given:
                break  # the next line begins with another name
            surnames += int(fam)
            j, end = j + 1, e2
        firm = _firm_next(text, end)
        while firm and j > i and "\n" in text[tokens[j - 1][1] : tokens[j][0]]:
            # The name ended with the line; the next line is a firm.
            j -= 1
            end = tokens[j][1]
            firm = _firm_next(text, end) and text[end] != "\n"
        size = j - i + 1
        good = False
        if not firm:
            if title:
                good = is_given or is_family or size > 1 or _line_ok(text, s, end)
            elif size > 1 and (is_given or initial and surnames):
                good = True
            elif size == 1 and is_family and not is_given:
                good = pattern.rstrip("⏎ ") in model.single
            elif size > 1 and is_family:
                good = pattern in model.patterns
        if good and not (size == 1 and initial):
            yield s, end
            i = j + 1
        else:
            i += 1


def _parts(key: str) -> list[str]:
    return [p.strip("\n ") for p in key.split("-")]


def _line_ok(text: str, s: int, e: int) -> bool:
    """A single unknown word after a title counts as a name before a comma, colon, bracket or a verb in lower case."""
    return e - s > 3 and regex.match(r"[,:(]|\s?[\p{Ll}(]", text[e : e + 2]) is not None


def _local_part(text: str, at: int) -> int:
    """Where the part of an address before its sign begins."""
    k = at - 1 if at > 0 and text[at - 1].isspace() else at
    while k > 0 and (text[k - 1].isalnum() or text[k - 1] in "_.+-" or _MARK.match(text[k - 1])):
        k -= 1
    return k


def find_items(text: str, model: Model) -> list[tuple[str, int, int]]:
    """(type, start, end) of all personal data in ``text``, without overlaps, by place."""
    out: list[tuple[str, int, int]] = []
    taken = _Taken()

    def add(kind: str, a: int, b: int) -> None:
        if taken.free(a, b):
            taken.add(a, b)
            out.append((kind, a, b))

    for sign in _AT.finditer(text):
        m = _EMAIL.match(text, _local_part(text, sign.start()))
        if m and m.start() <= sign.start() < m.end():
            add("EMAIL", *m.span())
    for kind, a, b, label in _numbers(text):
        good = model.labels.get(label, (0.0, 0.0)) if label else (0.0, 0.0)
        if kind == "ID" and not regex.search(r"(?:konto|iban|account|cuenta|compte|vat|ust|iva|tva)", label):
            add("ID_NUMBER", a, b)
        elif kind == "PHONE":
            add("PHONE", a, b)
        elif kind == "id?" and good[0] >= 0.15 and good[0] > good[1]:
            add("ID_NUMBER", a, b)
        elif kind == "phone?" and good[1] >= 0.15 and good[1] > good[0]:
            add("PHONE", a, b)
    for m in _STREET.finditer(text):
        add("STREET_ADDRESS", *m.span())
    for a, b in _names(text, model):
        add("PERSON_NAME", a, b)
    return sorted(out, key=lambda x: x[1])


def _cell_start(text: str, at: int) -> int:
    """Start of the cell that holds ``at``: after a line break or a gap of two blanks."""
    k = at
    while k > 0 and text[k - 1] not in "\n\f" and not (text[k - 1] == " " and k > 1 and text[k - 2] == " "):
        k -= 1
    return k


def _tokens_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different capitalised words of each text, and their parts, by the text's hash."""
    for batch in batches:
        at, words = [], []
        for h, text in zip(batch.column("h").to_pylist(), batch.column("text").to_pylist()):
            keys = {_key(m.group()) for m in _TOKEN.finditer(text or "")}
            keys |= {p for k in keys if "-" in k for p in _parts(k)}
            at += [h] * len(keys)
            words += keys
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(words, pa.string())], names=["h", "name"])


def _with_names(texts: DataFrame, model: Model, keys: list[str]) -> DataFrame:
    """``keys``, ``text`` and the names of the model's table that occur in the text (``_given``, ``_family``); null where the model holds them itself."""
    src = texts.select(*keys, "text")
    none = F.lit(None).cast("array<string>")
    if model.names is None:
        return src.withColumns({"_given": none, "_family": none})
    src = src.withColumn("h", F.xxhash64("text"))
    found = src.select("h", "text").mapInArrow(_tokens_of, "h long, name string").distinct().join(model.names, on="name")
    found = found.groupBy(F.col("h").alias("_h")).agg(F.collect_list(F.when(F.col("given"), F.col("name"))).alias("_given"), F.collect_list(F.when(~F.col("given"), F.col("name"))).alias("_family"))  # the names of one text
    return src.join(found, on=src["h"] == found["_h"], how="left").drop("h", "_h")


def _each(batch: pa.RecordBatch, model: Model) -> Iterator[tuple[str | None, Model]]:
    """The texts of a batch, each with the model to read it by."""
    for t, given, family in zip(batch.column("text").to_pylist(), batch.column("_given").to_pylist(), batch.column("_family").to_pylist()):
        yield t, model if given is None else replace(model, given=frozenset(given), family=frozenset(family))


def find_personal(texts: DataFrame, model: Model, keys: list[str]) -> DataFrame:
    """``keys``, ``pii_type``, ``start_offset``, ``end_offset``, ``item`` and ``cell`` (start of the item's cell of its line) for each
    item in the column ``text``. Null and empty texts give none."""
    src = _with_names(texts, model, keys)
    made = [("pii_type", T.StringType()), ("start_offset", T.LongType()), ("end_offset", T.LongType()), ("item", T.StringType()), ("cell", T.LongType())]
    small = replace(model, names=None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, kind, a, b, item, cell = [], [], [], [], [], []
            for i, (t, known) in enumerate(_each(batch, small)):
                for k, s, e in find_items(t, known) if t else ():
                    at.append(i), kind.append(k), a.append(s), b.append(e), item.append(t[s:e]), cell.append(_cell_start(t, s))
            kept = batch.select(keys).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(kind, pa.string()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(item, pa.string()), pa.array(cell, pa.int64())], names=[*keys, *[n for n, _ in made]])

    return src.mapInArrow(run, T.StructType([*src.select(*keys).schema.fields, *[T.StructField(n, t) for n, t in made]]))


def _parts_of(text: str, s: int, e: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, start of its cell) of each cell's part of an item, which may run over line breaks and gaps."""
    at = s
    for gap in [*re.finditer(r"\s*[\n\f]\s*| {2,}", text[s:e]), None]:
        end = s + gap.start() if gap else e
        if end > at:
            yield at, end, _cell_start(text, at) if at == s else at
        at = s + gap.end() if gap else e


def redact(texts: DataFrame, model: Model, placeholders: Mapping[str, str], keys: list[str], parts: bool = False) -> DataFrame:
    """``keys`` and ``redacted``: the text with each item replaced by its type's placeholder, all else unchanged. Null stays null.

    With ``parts`` also ``parts``: the items' types, places and texts cell by cell, each with the start of its cell, for ``redact_cells``.
    """
    src = _with_names(texts, model, keys)
    small = replace(model, names=None)
    part = pa.struct([("pii_type", pa.string()), ("at", pa.int64()), ("cell", pa.int64()), ("item", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, found = [], []
            for t, known in _each(batch, small):
                cells = []
                if t:
                    pieces, at = [], 0
                    for kind, s, e in find_items(t, known):
                        pieces += [t[at:s], placeholders.get(kind, f"[{kind}]")]
                        at = e
                        if parts:
                            own = list(_parts_of(t, s, e))
                            # The capitalised word that begins the line after an address and its full stop is another cell's text.
                            if kind == "EMAIL" and len(own) > 1 and regex.fullmatch(r"\p{Lu}\p{L}*", t[own[-1][0] : e]):
                                own.pop()
                                a, b, c = own[-1]
                                own[-1] = a, b - t[a:b].endswith("."), c
                            cells += [{"pii_type": kind, "at": a - c, "cell": c, "item": t[a:b]} for a, b, c in own]
                    t = "".join([*pieces, t[at:]])
                out.append(t), found.append(cells)
            made = [pa.array(out, pa.string()), *([pa.array(found, pa.list_(part))] if parts else [])]
            yield pa.RecordBatch.from_arrays([*batch.select(keys).columns, *made], names=[*keys, "redacted", *(["parts"] if parts else [])])

    fields = [*src.select(*keys).schema.fields, T.StructField("redacted", T.StringType())]
    if parts:
        fields.append(T.StructField("parts", T.ArrayType(T.StructType([T.StructField("pii_type", T.StringType()), T.StructField("at", T.LongType()), T.StructField("cell", T.LongType()), T.StructField("item", T.StringType())]))))
    return src.mapInArrow(run, T.StructType(fields))


def redact_cells(boxes: DataFrame, redacted: DataFrame, placeholders: Mapping[str, str], key: str, cell: str, text: str) -> DataFrame:
    """``key``, ``cell`` and ``redacted`` of each box: the parts of its text's items that stand in it replaced by their placeholders."""
    found = redacted.select(key, F.explode("parts").alias("p")).select(key, F.col("p.cell").alias(cell), F.struct("p.at", "p.pii_type", "p.item").alias("p"))
    found = found.groupBy(key, cell).agg(F.array_sort(F.collect_set("p")).alias("ps"))  # the items of one cell
    names = F.create_map(*[F.lit(x) for kv in placeholders.items() for x in kv]) if placeholders else F.create_map().cast("map<string,string>")
    box = F.col(text)

    def piece(a, n=None):
        return F.substring(box, (a + 1).cast("int"), F.length(box) if n is None else n.cast("int"))

    def step(acc, p):
        mark = F.coalesce(F.element_at(names, p["pii_type"]), F.concat(F.lit("["), p["pii_type"], F.lit("]")))
        stands = (p["at"] >= acc["upto"]) & (piece(p["at"], F.length(p["item"])) == p["item"])
        return F.when(stands, F.struct(F.concat(acc["out"], piece(acc["upto"], p["at"] - acc["upto"]), mark).alias("out"), (p["at"] + F.length(p["item"])).cast("long").alias("upto"))).otherwise(acc)

    done = F.aggregate(F.coalesce("ps", F.array().cast("array<struct<at:bigint,pii_type:string,item:string>>")), F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("upto")), step, lambda acc: F.concat(acc["out"], piece(acc["upto"])))
    return boxes.join(found, on=[key, cell], how="left").select(key, cell, done.alias("redacted"))
