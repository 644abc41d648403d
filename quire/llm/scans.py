"""Repair of text from scanned pages (problem 4).

The lines of a page are labelled by a hidden Markov chain, from top to bottom: running header, page number, line that starts a paragraph (a break
before it), line that continues one, running footer, page number at the foot. Its observations are layout features: place from either
end, repetition of the same words on other pages, form of a page number and its agreement with the count of pages, and for
paragraphs the blank before a line, the fullness and end of the line above, how the line begins and whether it is a table's row. The chain
covers all lines of all pages. Its tables start from given ones and are fitted to the corpus by Viterbi training; the given
tables keep half of the weight, whatever the size of the corpus, so the states keep their meaning.

A text is read once, batch-wise: its lines' features, heads and tails of broken words and words go to one written table each; what
follows is narrow. Words broken at a line end and words with wrongly recognised characters, in lines that are not running ones, are judged
against the words of the whole corpus, counted in Spark: a rare word is misread if exchanging characters that scanners confuse
gives a much more frequent one. The count tables are joined, never collected.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex

from pyspark.sql import Column, DataFrame, functions as F

from quire.session import Scratch

#: A misread word's correct form is at least so many times as frequent, and occurs at least LEAST times.
RATIO, LEAST = 8, 4
#: Characters a word has at least to be told by its skeleton.
SKELETON = 6
#: Rounds of fitting the chain; given probabilities below this are not fitted.
ROUNDS, RARE = 2, 1e-3
#: Rows of a table that is broadcast; share of all words from which one counts as frequent, so there are at most 1/FREQUENT of these.
FEW, FREQUENT = 200_000, 1e-5

# Pairs that scanners confuse, as (seen, meant).
CONFUSED = [
    ("rn", "m"), ("m", "rn"), ("ii", "u"), ("u", "ii"), ("ri", "n"), ("n", "ri"), ("cl", "d"), ("d", "cl"), ("vv", "w"), ("w", "vv"), ("li", "h"), ("nn", "m"), ("in", "m"), ("n", "u"), ("u", "n"),
    ("c", "e"), ("e", "c"), ("b", "h"), ("h", "b"), ("f", "t"), ("t", "f"), ("l", "i"), ("i", "l"), ("ß", "b"), ("b", "ß"), ("é", "ê"),
    ("ii", "ü"), ("a", "ä"), ("o", "ö"), ("u", "ü"), ("e", "é"), ("a", "á"), ("o", "ó"), ("i", "í"), ("e", "è"), ("ss", "ß"), ("n", "ñ"), ("é", "e"), ("c", "ç"),
]
# Signs and digits that stand for letters inside a word.
SIGNS = {"@": "a", "|": "il", "0": "oó", "1": "li", "5": "s", "6": "béó", "8": "b", "9": "g", "4": "a", "3": "eé", "2": "z", "€": "e", "$": "s", "!": "il", "¢": "c", "(": "c", "£": "e", "7": "t"}
_BREAKS = "-‐‑¬­"
_JOINERS = frozenset("und oder bzw sowie als et ou y e o u and or to bis".split())
_SIGN_CLASS = regex.compile("[" + regex.escape("".join(SIGNS)) + "]")
_NUMBER = r"(?:[^\S\n\f]*\d[\dliO|]{0,3}|[^\S\n\f]+l\d{0,2})"
_PAGE = regex.compile(
    r"(?:\b(?:seite|blatt|sheet|page|página|pagina|feuille|hoja|folio)|\b(?:pág|pag|pg|p|s)\.)" + _NUMBER + r"(?:[^\S\n\f]*(?:von|of|sur|de|/)[^\S\n\f]*(?:\d[\dliO|]{0,3}|l\d{0,2}))?(?![\w.,-]\w)", regex.IGNORECASE)
_PAGE_ALONE = regex.compile(r"^\s*(?:[-–—]\s*\d{1,4}\s*[-–—]|[\[(]\s*\d{1,4}\s*[\])]|\d{1,4}(?:\s*[/|]\s*\d{1,4})?|[ivxlIVXL]{1,6})\s*$")
_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50}


def whole_text(text: Column, raw: Column) -> Column:
    """``text``, or where it is null the lines of all pages of the recognition response in order (``\\n`` between lines, ``\\f`` between pages)."""
    page = "array<struct<lines:array<struct<t:string>>>>"
    pages = F.coalesce(F.from_json(raw, f"struct<pages:{page}>")["pages"], F.from_json(raw, page))
    built = F.array_join(F.transform(pages, lambda p: F.array_join(F.transform(F.coalesce(p["lines"], F.array().cast("array<struct<t:string>>")), lambda l: F.coalesce(l["t"], F.lit(""))), "\n")), "\f")
    return F.coalesce(text, F.when(F.size(pages) > 0, built))


def _roman(s: str) -> int:
    total = 0
    values = [_ROMAN[c] for c in s.lower()]
    for a, b in zip(values, [*values[1:], 0]):
        total += -a if a < b else a
    return total


_CANON = [("| ", " "), (" |", " "), ("rn", "m"), ("ii", "u"), ("ri", "n"), ("vv", "w"), ("cl", "d")]
_CANON += [*zip("0@|1icb68f59q4j", "oalllehhhtsggal"), *((c, "") for c in " \t\r\xa0–—·-")]


def _canonical(text: str) -> list[str]:
    """The lines of ``text`` without page numbers, case, spacing and the differences scanners make: equal for repetitions of one header."""
    s = _PAGE.sub(" ", text).lower()
    for a, b in _CANON:
        s = s.replace(a, b)
    return s.replace("\f", "\n").split("\n")


# Forms of page numbers: none; keyword and number alone; framed by dashes or brackets, a pair or roman; a bare number; at the edge of a line after a word,
# or after a short abbreviation; inside a line.
_NONE, _ALONE, _FRAMED, _BARE, _EDGE, _SHORT, _INSIDE = range(7)


def _alone_value(line: str) -> tuple[int, int] | None:
    """(value, form) of a line that is nothing but a number."""
    if not _PAGE_ALONE.match(line):
        return None
    s = line.strip()
    digits = regex.findall(r"\d+", s)
    if digits:
        return int(digits[0]), _FRAMED if not s[0].isdigit() or len(digits) > 1 or line[:8].isspace() else _BARE
    return (_roman(s), _FRAMED) if s.lower() == s or s.upper() == s else None


def _page_value(line: str, m: regex.Match, start: int) -> tuple[int | None, int]:
    """(value, form) of a line with the page number ``m``, found in the text in which the line starts at ``start``."""
    a, b = m.start() - start, m.end() - start
    n = regex.search(r"\d+", m.group())
    value = int(n.group()) if n else None
    before, after = line[:a], line[b:]
    if not any(c.isalnum() for c in before + after):
        return value, _ALONE
    if (not after.strip() or not before.strip()) and len(line.strip()) < 90:
        return value, _EDGE if len(regex.match(r"[^\W\d_]+", m.group()).group()) > 1 else _SHORT
    return value, _INSIDE


#: The states of the chain: running line and page number at the top, line that starts a paragraph, line that continues one, running line and
#: page number at the foot.
HEAD, HEAD_NO, START, GOES_ON, FOOT, FOOT_NO = range(6)
_BODY = (START, GOES_ON)
#: The features of a line, with the number of their values: lines from the top and from the foot (6: further); pages that repeat it (0 none, 1 one of many,
#: then up to a third, up to two thirds, more); form of a page number, twice (without, with agreement); more than 90 characters; blank before; fullness of the
#: line above (0 none, up to half, up to 4/5, full); end of the line above (0 none, 1 sentence, 2 other); beginning (small letter, capital, digit or
#: bullet, other); gap of a table in it (1), in the line above (2), in both; more than three signs without the number.
FEATURES = {"top": 7, "foot": 7, "again": 5, "number": 14, "long": 2, "blank": 2, "above": 4, "end": 3, "begins": 4, "table": 4, "worded": 2}
_SHIFT = {name: sum((n - 1).bit_length() for n in list(FEATURES.values())[:k]) for k, name in enumerate(FEATURES)}
_MASK = {name: (1 << (n - 1).bit_length()) - 1 for name, n in FEATURES.items()}


def _given() -> dict[str, np.ndarray]:
    """The given tables, as probabilities: of each feature's values by state, of the first state, of the next state (the last column: the page's end)."""
    near, off = [0.45, 0.25, 0.14, 0.08, 0.05, 0.02, 0.01], [0.03] * 6 + [0.82]
    body_no = [0.975, 0.0006, 0.001, 0.012, 0.001, 0.002, 0.005, 0.0001, 0.0004, 0.0004, 0.001, 0.0004, 0.0004, 0.001]
    odds = [-9, 3, 1.5, -4.5, 0, -2, -5, -9, 7, 5.5, 3.5, 4, 2, -1]
    page_no = [p * math.exp(o) for p, o in zip(body_no, odds)]
    run_no = [p * (10 if k % 7 in (_EDGE, _SHORT) else 1) for k, p in enumerate(body_no)]
    tables = {
        "top": [near, near, off, off, off, off],
        "foot": [off, off, off, off, near, near],
        "again": [[1e-4, 0.04, 0.15, 0.2, 0.61], [0.8, 0.05, 0.05, 0.05, 0.05], *[[0.93, 0.03, 0.02, 0.01, 0.01]] * 2, [1e-4, 0.04, 0.15, 0.2, 0.61], [0.8, 0.05, 0.05, 0.05, 0.05]],
        "number": [run_no, page_no, body_no, body_no, run_no, page_no],
        "long": [[0.97, 0.03], [0.97, 0.03], [0.8, 0.2], [0.8, 0.2], [0.97, 0.03], [0.97, 0.03]],
        "blank": [[0.6, 0.4]] * 2 + [[0.4, 0.6], [0.98, 0.02]] + [[0.4, 0.6]] * 2,
        "above": [[0.5, 0.2, 0.15, 0.15]] * 2 + [[0.25, 0.4, 0.2, 0.15], [0.02, 0.05, 0.25, 0.68]] + [[0.1, 0.4, 0.25, 0.25]] * 2,
        "end": [[0.5, 0.2, 0.3]] * 2 + [[0.25, 0.45, 0.3], [0.02, 0.18, 0.8]] + [[0.1, 0.5, 0.4]] * 2,
        "begins": [[0.1, 0.6, 0.2, 0.1]] * 2 + [[0.05, 0.6, 0.3, 0.05], [0.55, 0.34, 0.08, 0.03]] + [[0.1, 0.6, 0.2, 0.1]] * 2,
        "table": [[0.45, 0.3, 0.15, 0.1], [0.6, 0.15, 0.15, 0.1], [0.5, 0.15, 0.15, 0.2], [0.93, 0.02, 0.015, 0.035], [0.45, 0.3, 0.15, 0.1], [0.6, 0.15, 0.15, 0.1]],
        "worded": [[0.05, 0.95], [0.7, 0.3], [0.05, 0.95], [0.05, 0.95], [0.05, 0.95], [0.7, 0.3]],
        "first": [[0.12, 0.05, 0.7, 0.11, 0.01, 0.01]],
        "next": [
            [0.2, 0.1, 0.54, 0.12, 0.01, 0.01, 0.02], [0.15, 0.01, 0.58, 0.2, 0.02, 0.02, 0.02], [0.003, 0.002, 0.32, 0.59, 0.03, 0.03, 0.025],
            [0.003, 0.002, 0.3, 0.61, 0.03, 0.03, 0.025], [0.001, 0.001, 0.005, 0.005, 0.3, 0.3, 0.388], [0.001, 0.001, 0.005, 0.005, 0.3, 0.02, 0.668],
        ],
    }
    return {k: np.array(v, float) / np.array(v, float).sum(1, keepdims=True) for k, v in tables.items()}


@dataclass
class Chain:
    """The tables of the chain as logarithms."""

    tables: dict[str, np.ndarray]

    @classmethod
    def given(cls) -> Chain:
        return cls({k: np.log(v) for k, v in _given().items()})

    @classmethod
    def fitted(cls, counts: np.ndarray) -> Chain:
        """From counts of what was decoded: half of each row of a table is the given one, half the corpus'. What is given as next to impossible stays so,
        lest a state take over the lines of another."""
        out, at = {}, 0
        for name, given in _given().items():
            seen = counts[at : at + given.size].reshape(given.shape)
            at += given.size
            total = seen.sum(1, keepdims=True)
            out[name] = np.log(np.where((total > 0) & (given >= RARE), (given + seen / np.maximum(total, 1)) / 2, given))
        return cls(out)

    def scores(self, obs: np.ndarray) -> np.ndarray:
        """The log-likelihoods of observations by state, as a last axis."""
        return sum(self.tables[f].T[(obs >> _SHIFT[f]) & _MASK[f]] for f in FEATURES)

    def paragraph_odds(self, obs: int) -> float:
        """Log-odds that the first line of a page starts a paragraph, by the features of paragraphs but the blank before."""
        return sum(float(t[START, v] - t[GOES_ON, v]) for f in ("above", "end", "begins", "table") for t, v in ((self.tables[f], (obs >> _SHIFT[f]) & _MASK[f]),))

    def decode(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """The most likely states of each page's lines; pages of like length are decoded side by side."""
        out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
        step, last = self.tables["next"][:, :6], self.tables["next"][:, 6]
        at = 0
        while at < len(order):
            upto = at + 1
            while upto < len(order) and (upto - at) * len(pages[order[upto]]) < 1 << 16:
                upto += 1
            chosen = order[at:upto]
            at = upto
            sizes = np.array([len(pages[k]) for k in chosen])
            obs = np.zeros((len(chosen), sizes[-1]), np.int64)
            for row, k in enumerate(chosen):
                obs[row, : sizes[row]] = pages[k]
            back = np.zeros((*obs.shape, 6), np.int8)
            value = self.tables["first"][0] + self.scores(obs[:, 0])
            for t in range(1, obs.shape[1]):
                ways = value[:, :, None] + step
                back[:, t] = ways.argmax(1)
                value = np.where((t < sizes)[:, None], ways.max(1) + self.scores(obs[:, t]), value)
            state = (value + last).argmax(1)
            path = np.zeros(obs.shape, np.int8)
            rows = np.arange(len(chosen))
            for t in range(obs.shape[1] - 1, -1, -1):
                path[:, t] = state
                state = np.where(t < sizes, back[rows, t, state], state) if t else state
            for row, k in enumerate(chosen):
                out[k] = path[row, : sizes[row]]
        return out


def _count(pages: list[np.ndarray], paths: list[np.ndarray], weights: list[int]) -> np.ndarray:
    """How often each value of each feature, each first and each next state was decoded, one flat vector."""
    given = _given()
    parts = {k: np.zeros(v.shape) for k, v in given.items()}
    if pages:
        obs, states = np.concatenate(pages), np.concatenate(paths)
        weight = np.repeat(np.array(weights, float), [len(p) for p in pages])
        for f in FEATURES:
            np.add.at(parts[f], (states, (obs >> _SHIFT[f]) & _MASK[f]), weight)
        for path, n in zip(paths, weights):
            if len(path):
                parts["first"][0, path[0]] += n
                np.add.at(parts["next"], (path[:-1], path[1:]), n)
                parts["next"][path[-1], 6] += n
    return np.concatenate([parts[k].ravel() for k in given])


_BULLETS = frozenset("-–—•*·▪(")


def _begins(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() or c in _BULLETS else 3


def _fullness(length: int, width: float) -> int:
    return 1 if length < 0.5 * width else 2 if length < 0.8 * width else 3


def _above(s: str, width: float) -> int:
    """The features that a line has from the one above it, ``s``, which is stripped."""
    return _fullness(len(s), width) << _SHIFT["above"] | (1 if s[-1] in ".!?:。！？" else 2) << _SHIFT["end"] | (2 if "  " in s else 0) << _SHIFT["table"]


def _ninth_tenth(sizes: list[int]) -> float:
    """The length that nine of ten of these, which are sorted, do not exceed."""
    return float(sizes[(len(sizes) - 1) * 9 // 10]) if sizes else 1.0


def _width(pages: list[list[str]]) -> float:
    """The length that nine of ten filled lines of a text do not exceed."""
    return _ninth_tenth(sorted(len(s) for p in pages for x in p if (s := x.strip())))


def observe(text: str, pages: list[list[str]]) -> list[np.ndarray]:
    """The observations of the filled lines of each page of a text."""
    bare = [[line.strip() for line in page] for page in pages]
    filled = [[i for i, s in enumerate(page) if s] for page in bare]
    sizes = sorted(len(page[i]) for page, rows in zip(bare, filled) for i in rows)
    width = _ninth_tenth(sizes)
    starts, first, at = [], [], 0
    for page in pages:
        first.append(len(starts))
        for line in page:
            starts.append(at)
            at += len(line) + 1
    number: dict[int, tuple[int | None, int]] = {}
    for m in _PAGE.finditer(text):
        no = bisect_right(starts, m.start()) - 1
        k = bisect_right(first, no) - 1
        number[no] = _page_value(pages[k][no - first[k]], m, starts[no])  # the last of a line counts
    several = len(pages) > 1
    canon = _canonical(text) if several else None
    seen: dict[str, int] = {}  # the page that has a line, -1 for several
    again: dict[tuple[str, int], int] = {}  # pages that have a line at a place, from the top or (negative) from the foot
    shift: dict[tuple[bool, int], set[int]] = {}
    for k, (page, rows) in enumerate(zip(bare, filled)):
        n = len(rows)
        for rank, i in enumerate(rows):
            no = first[k] + i
            if len(page[i]) < 14:
                alone = _alone_value(pages[k][i])
                if alone:
                    number[no] = alone
            if several:
                words = canon[no]
                if len(words) > 3:
                    if seen.setdefault(words, k) != k:
                        seen[words] = -1
                    for place in ((words, rank), (words, rank - n)):
                        again[place] = again.get(place, 0) + 1
            if no in number and number[no][0] is not None:
                for top in {rank * 2 < n, rank * 2 + 1 > n} if n > 8 else (True, False):
                    shift.setdefault((top, number[no][0] - k), set()).add(k)
    tops, feet, longs, begun, tables, worded, blanks = (_SHIFT[f] for f in ("top", "foot", "long", "begins", "table", "worded", "blank"))
    out = []
    for k, (page, rows) in enumerate(zip(bare, filled)):
        n = len(rows)
        obs = np.zeros(n, np.int64)
        last, above = -1, 0  # the line above and what it gives
        for rank, i in enumerate(rows):
            no, s = first[k] + i, page[i]
            o = min(rank, 6) << tops | min(n - 1 - rank, 6) << feet | (len(s) > 90) << longs | _begins(s[0]) << begun | ("  " in s) << tables
            o |= above | (i > last + 1) << blanks
            last, above = i, _above(s, width)
            words = canon[no] if several else s
            o |= (len(words) > 3) << worded
            if several and len(words) > 3 and seen[words] < 0:
                # A running line stands at about the same place of other pages, from the top or from the foot.
                from_top = sum(again.get((words, p), 0) for p in range(max(rank - 2, 0), rank + 3))
                from_foot = sum(again.get((words, p), 0) for p in range(rank - n - 2, min(rank - n + 3, 0)))
                others = max(from_top, from_foot) - 1
                if others > 0:
                    share = others / (len(pages) - 1)
                    o |= (1 if others == 1 and share < 0.5 else 2 if share < 0.34 else 3 if share < 0.67 else 4) << _SHIFT["again"]
            if no in number:
                value, form = number[no]
                top = rank * 2 < n
                agrees = value is not None and max(len(shift.get((side, value - k), ())) for side in ((True, False) if n <= 8 else (top,))) > 1
                if value is not None or form in (_ALONE, _FRAMED):
                    o |= (form + 7 * agrees) << _SHIFT["number"]
            obs[rank] = o
        out.append(obs)
    return out


def _mark_of(state: int, obs: int) -> str:
    """``H``, ``P``, ``HP`` or ``B`` by the state of a line and its observation."""
    if state in _BODY:
        return "B"
    form, again, worded = (obs >> _SHIFT["number"]) & _MASK["number"], (obs >> _SHIFT["again"]) & _MASK["again"], (obs >> _SHIFT["worded"]) & 1
    if state in (HEAD, FOOT):
        return "HP" if form % 7 in (_ALONE, _EDGE, _SHORT, _INSIDE) and worded else "H"
    return "HP" if again and worded else "P"


def label_pages(pages: list[list[str]], chain: Chain | None = None) -> list[list[str]]:
    """For each line of each page: ``H`` header or footer, ``P`` page number, ``HP`` both, ``B`` body, ``K`` break (blank)."""
    observed = observe("\f".join("\n".join(p) for p in pages), pages)
    out = []
    for page, obs, states in zip(pages, observed, (chain or Chain.given()).decode(observed)):
        marks = iter([_mark_of(int(s), int(o)) for s, o in zip(states, obs)])
        out.append([next(marks) if line and not line.isspace() else "K" for line in page])
    return out


_TAIL = regex.compile(r"[\p{L}\p{M}@|0-9'’-]*[\p{L}@|0-9](?=[" + _BREAKS + r"]$)")
_HEAD = regex.compile(r"\s*([\p{L}\p{M}@|0-9]+)")
_HAS_LETTER = regex.compile(r"\p{L}")


def _tail(line: str) -> str | None:
    """The part of a word, and the mark, in which ``line`` ends, if it may be broken there."""
    s = line.rstrip()
    if not s or s[-1] not in _BREAKS:
        return None
    m = _TAIL.search(s, max(0, len(s) - 200))  # no word is longer
    return m.group() + s[-1] if m and _HAS_LETTER.search(m.group()) else None


def _head(line: str) -> str | None:
    m = _HEAD.match(line)
    return m.group(1) if m and _HAS_LETTER.search(m.group(1)) else None


def _joins(tail: str, head: str) -> bool:
    """Whether ``head`` may continue the word broken in ``tail``."""
    return tail[-1] != "-" or not (head.lower() in _JOINERS or head[0].isupper() and not tail[:-1].isupper())


def broken_word(line: str, following: str) -> tuple[str, str, str] | None:
    """(left part, right part, mark) if ``line`` ends in a word broken by a mark that ``following`` continues; the mark "-" remains to be judged."""
    tail, head = _tail(line), _head(following)
    return (tail[:-1], head, tail[-1]) if tail and head and _joins(tail, head) else None


def _split(text: str) -> tuple[list[list[str]], list[int]]:
    pages = [p.split("\n") for p in text.split("\f")]
    first, n = [], 0
    for p in pages:
        first.append(n)
        n += len(p)
    return pages, first


_MAIL = re.compile(r"[\w.+-]+\s?(?:@|[(\[]at[)\]])\s?[\w-]+(?:(?:\.|\s?[(\[](?:dot|punkt)[)\]]\s?)[\w-]+)+|[\w+-]+[._][\w.+-]*@\s*$")
_MAIL_SIGN = re.compile(r"@|[(\[]at[)\]]")
_TOKENS = re.compile(r"[^\s.,;:?\[\])\"“”„«»…/·–—*=+_<>’']+")
_READ = "request_id long, obs array<array<int>>, lines array<int>, heads array<string>, tails array<string>, words array<array<string>>, vocabulary array<string>, counts array<long>"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text the observations of its pages, and of its filled lines their numbers, first words, broken last words and words; and a row for each
    batch with the words it has and on how many lines."""
    for batch in batches:
        cols: tuple[list, ...] = ([], [], [], [], [], [], [], [])
        lines_of: Counter[str] = Counter()
        for rid, text in zip(batch.column("request_id").to_pylist(), batch.column("text").to_pylist()):
            if not text:
                continue
            pages, first = _split(text)
            obs = observe(text, pages)
            filled = [(first[k] + i, line) for k, page in enumerate(pages) for i, line in enumerate(page) if line and not line.isspace()]
            tails = [_tail(line) for _, line in filled]
            heads = [_head(line) for _, line in filled] if any(tails) else []
            # Addresses of mail are no words.
            mail = _MAIL_SIGN.search(text) is not None
            words = [list(dict.fromkeys(_TOKENS.findall(_MAIL.sub(" ", line) if mail and _MAIL_SIGN.search(line) else line))) for _, line in filled]
            for w in words:
                lines_of.update(w)
            for c, v in zip(cols, (rid, obs, [n for n, _ in filled], heads, tails if heads else [], words, None, None)):
                c.append(v)
        for c, v in zip(cols, (None, None, None, None, None, None, list(lines_of), list(lines_of.values()))):
            c.append(v)
        kinds = (pa.int64(), pa.list_(pa.list_(pa.int32())), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.list_(pa.string())), pa.list_(pa.string()), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["request_id", "obs", "lines", "heads", "tails", "words", "vocabulary", "counts"])


def fit_chain(read: DataFrame, rounds: int = ROUNDS) -> Chain:
    """The chain fitted to all pages: decoded by the tables of the round before, counted, and counted up in Spark."""
    chain = Chain.given()
    pages = read.select(F.explode("obs").alias("page")).filter(F.size("page") > 0)

    for _ in range(rounds):
        now = chain

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                seqs = [np.array(p, np.int64) for p in batch.column("page").to_pylist()]
                n = _count(seqs, now.decode(seqs), [1] * len(seqs))
                total = n if total is None else total + n
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["n"])

        sums = pages.mapInArrow(count, "n array<double>").select(F.posexplode("n").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).collect()  # one row per cell of the tables
        if not sums:
            return chain
        chain = Chain.fitted(np.array([r["n"] for r in sorted(sums, key=lambda r: r["at"])]))
    return chain


def _labels(chain: Chain, starts: bool = False):
    """Running lines, broken words and, if asked for, starts of paragraphs of what was read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, no, kind, left, right, end = [], [], [], [], [], []

            def add(*row) -> None:
                for c, v in zip((ids, no, kind, left, right, end), row):
                    c.append(v)

            texts = batch.column("obs").to_pylist()
            pages = [np.array(p, np.int64) for t in texts for p in t]
            paths = iter(chain.decode(pages))
            observed = iter(pages)
            for rid, obs, lines, heads, tails in zip(batch.column("request_id").to_pylist(), texts, *[batch.column(c).to_pylist() for c in ("lines", "heads", "tails")]):
                body: list[int] = []
                at = 0
                for page in obs:
                    seq, path = next(observed), next(paths)
                    for k in range(len(page)):
                        mark = _mark_of(int(path[k]), int(seq[k]))
                        if mark == "B":
                            body.append(at)
                            if starts and path[k] == START:
                                add(rid, lines[at], "start", None, None, None)
                        else:
                            for c in mark:
                                add(rid, lines[at], "header" if c == "H" else "page_number", None, None, None)
                        at += 1
                if heads:
                    for a, b in zip(body, body[1:]):
                        if tails[a] and heads[b] and _joins(tails[a], heads[b]):
                            add(rid, lines[a], "hyphen" if tails[a][-1] != "-" else "hyphen?", tails[a][:-1], heads[b], lines[b])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(no, pa.int64()), pa.array(kind, pa.string()), pa.array(left, pa.string()), pa.array(right, pa.string()), pa.array(end, pa.int64())], names=["request_id", "line_no", "kind", "left", "right", "next_line"])

    return run


def variants(word: str) -> list[tuple[str, int]]:
    """The words that ``word`` may stand for by one confusion, or by its signs (up to four), lower case, with the place of the first exchanged character."""
    w = word.lower()
    out: dict[str, int] = {}
    signs = list(_SIGN_CLASS.finditer(w))
    if signs:
        if len(signs) > 4 or len(signs) * 2 > len(w):
            return []
        forms = [""]
        at = 0
        for m in signs:
            forms = [f + w[at : m.start()] + c for f in forms for c in SIGNS[m.group()]]
            at = m.end()
        for f in forms:
            out[f + w[at:]] = signs[0].start()
        return list(out.items())
    for seen, meant in CONFUSED:
        i = w.find(seen)
        while i >= 0:
            out.setdefault(w[:i] + meant + w[i + len(seen) :], i)
            i = w.find(seen, i + 1)
    return list(out.items())


# Letters and signs that look alike to a scanner, and the one that stands for all of them.
_ALIKE = [*_CANON[2:-len(" \t\r\xa0–—·-")], ("€", "e"), ("$", "s"), ("!", "l"), ("¢", "e"), ("(", "e"), ("£", "e"), ("7", "t"), ("ß", "h"), *zip("äöüéèêáóíñç", "aoueeeaolne"), ("u", "n")]


def _skeleton(w: Column) -> Column:
    """The word with all characters that look alike made one: equal for a word and its misread forms, however many confusions there are."""
    for a, b in _ALIKE:
        w = F.replace(w, F.lit(a), F.lit(b))
    return w


def _is_word(w: Column) -> Column:
    """Words of three letters and more; shorter ones only with a sign in them."""
    signed = w.rlike("[@|€$¢£]")
    return ((F.length(w) >= 3) | (F.length(w) == 2) & signed) & w.rlike(r"\p{L}") & ~w.rlike(r"^[\d\P{L}]+\p{L}?$|^\p{L}{1,3}-?\d{2,}$|\d\p{L}?\d\d")


def _judge(pages: DataFrame, scratch: Scratch, starts: bool = False) -> tuple[DataFrame, ...]:
    """The marks of the lines; broken words; of these the ones at a plain "-", with ``spelled`` where the corpus has them hyphenated; misread words
    with the meant ones (``form``: as most often written); misread broken words. All by request and line."""
    read = scratch.write(pages.mapInArrow(_read, _READ), "read")
    chain = fit_chain(read.select("obs"))
    marks = scratch.write(read.filter("vocabulary is null").drop("words", "vocabulary", "counts").mapInArrow(_labels(chain, starts), "request_id long, line_no long, kind string, left string, right string, next_line long"), "marks")

    by_line = read.select("request_id", F.explode(F.arrays_zip("lines", "words")).alias("x")).select("request_id", F.col("x.lines").cast("long").alias("line_no"), F.explode("x.words").alias("raw"))
    # Words are counted where they are read, and patterns are tried once per distinct one.
    counted = read.filter("vocabulary is not null").select(F.explode(F.arrays_zip("vocabulary", "counts")).alias("x")).select(F.col("x.vocabulary").alias("raw"), F.col("x.counts").alias("k"))
    forms = counted.groupBy("raw").agg(F.sum("k").alias("n")).withColumn("core", F.regexp_replace("raw", r"^[-‐¬\u00ad(!]+|[-‐¬\u00ad]+$", "")).withColumn("w", F.lower("core")).filter(_is_word(F.col("w")))
    forms = scratch.write(forms, "forms")
    # The words of the corpus; a word broken at a line end counts as its whole.
    counts = scratch.write(forms.groupBy("w").agg(F.sum("n").alias("n"), F.max_by("core", F.struct("n", "core")).alias("form")), "words")

    cut = marks.filter("kind in ('hyphen', 'hyphen?')").withColumn("joined", F.lower(F.concat("left", "right"))).withColumn("spelled", F.lower(F.concat("left", F.lit("-"), "right")))
    plain = cut.filter("kind = 'hyphen?'").select("request_id", "line_no", "joined", "spelled").distinct()
    for name, out in (("joined", "nj"), ("spelled", "ns")):
        side = counts.select(F.col("w").alias("_w"), F.col("n").alias(out))
        plain = plain.join(side, on=plain[name] == side["_w"], how="left").drop("_w")
    spelled = (F.coalesce("ns", F.lit(0)) > F.coalesce("nj", F.lit(0)))
    plain = plain.withColumn("spelled", spelled)

    # Distinct words only, so this is as small as the vocabulary.
    sound = counts.filter(F.col("n") >= LEAST)
    parts = cut.select(F.col("joined").alias("w")).distinct()
    rare = counts.select("w", "n").unionByName(parts.select("w", F.lit(1).cast("long").alias("n"))).groupBy("w").agg(F.max("n").alias("n"))

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(w, n, v, at) for w, n in zip(pdf["w"], pdf["n"]) for v, at in variants(w)]
            yield pd.DataFrame(rows, columns=["w", "n", "meant", "at"])

    guesses = rare.mapInPandas(spread, "w string, n long, meant string, at int")
    sound = sound.select(F.col("w").alias("_w"), F.col("n").alias("nm"), "form")
    signed = F.col("w").rlike("[" + "".join("\\" + c if not c.isalnum() else c for c in SIGNS) + "]")
    wrong = guesses.join(sound, on=guesses["meant"] == sound["_w"]).filter((F.col("nm") >= RATIO * F.col("n")) | (signed & (F.col("nm") > F.col("n"))))
    wrong = scratch.write(wrong.groupBy("w").agg(F.max_by(F.struct("at", "meant", "form"), F.struct("nm", "meant")).alias("x")).select("w", "x.*"), "wrong")
    # Words with several confusions meet theirs by their skeletons; only words that one confusion does not explain, and long enough to be told apart.
    left = rare.filter(F.length("w") >= SKELETON).join(sound, on=rare["w"] == sound["_w"], how="left_anti").join(wrong.select(F.col("w").alias("_w")), on=F.col("w") == F.col("_w"), how="left_anti")
    alike = left.select("w", "n", _skeleton(F.col("w")).alias("s")).join(sound.filter(F.length("_w") >= SKELETON - 1).select("_w", "nm", "form", _skeleton(F.col("_w")).alias("s")), on="s").filter((F.col("nm") >= RATIO * F.col("n")) & (F.col("w") != F.col("_w")))
    same = F.length(F.regexp_extract(F.concat("w", F.lit("\n"), "_w"), r"^(.*).*\n\1", 1))
    several = alike.groupBy("w").agg(F.max_by(F.struct(same.cast("int").alias("at"), F.col("_w").alias("meant"), "form"), F.struct("nm", "_w")).alias("x")).select("w", "x.*")
    wrong = scratch.write(wrong.unionByName(several), "wrong")
    small = wrong.limit(FEW + 1).count() <= FEW
    table = F.broadcast(wrong) if small else wrong
    raw = scratch.write(forms.join(table.select("w", "meant", "form"), on="w").select("raw", "n", "w", "meant", "form"), "raw")
    if raw.limit(FEW + 1).count() <= FEW:
        found = by_line.join(F.broadcast(raw), on="raw")
    else:
        # The occurrences of frequent words, of which there are at most 1 / FREQUENT, never meet in one task; of the rest no word is frequent.
        total = forms.agg(F.sum("n")).first()[0]  # one number
        common = forms.filter(F.col("n") >= FREQUENT * total).select("raw")
        often = raw.join(F.broadcast(common), on="raw", how="left_semi")
        seldom = by_line.join(F.broadcast(common), on="raw", how="left_anti").join(raw.join(F.broadcast(common), on="raw", how="left_anti"), on="raw")
        found = by_line.join(F.broadcast(often), on="raw").unionByName(seldom)

    # Halves of broken words are no words by themselves.
    halves = cut.select("request_id", F.col("line_no"), F.lower("left").alias("w")).unionByName(cut.select("request_id", F.col("next_line").alias("line_no"), F.lower("right").alias("w")))
    hits = found.select("request_id", "line_no", "w", "raw", "meant", "form").distinct()
    hits = hits.join(halves.distinct(), on=["request_id", "line_no", "w"], how="left_anti")
    across = cut.join(table.withColumnRenamed("w", "_w"), on=cut["joined"] == F.col("_w"))
    return marks, chain, cut, plain, hits, across


def _running(marks: DataFrame) -> DataFrame:
    return marks.filter("kind in ('header', 'page_number')").select("request_id", "line_no", F.col("kind").alias("noise")).distinct()


def find_noise(df: DataFrame, request: str = "request_id", text: str = "text", raw: str | None = "raw_ocr_response") -> DataFrame:
    """Noise of scanned pages: ``request_id``, ``line_no`` (parts between ``\\n`` or ``\\f``, from 0) and ``noise``: ``hyphen``,
    ``misread``, ``header``, ``page_number``; each once.

    A null text is replaced by the lines of the recognition response, where ``raw`` names its column; if both are null the row gives
    nothing, as do empty texts. Repeated rows count once in the result. Other columns are ignored.
    """
    scratch = Scratch(df.sparkSession, "scans")
    source = whole_text(F.col(f"`{text}`"), F.col(f"`{raw}`")) if raw else F.col(f"`{text}`")
    pages = df.select(F.col(f"`{request}`").cast("long").alias("request_id"), source.alias("text")).filter("text is not null")
    marks, _, cut, plain, hits, across = _judge(pages, scratch)
    running = _running(marks)
    hyphen = cut.filter("kind = 'hyphen'").select("request_id", "line_no").unionByName(plain.filter("not spelled").select("request_id", "line_no"))
    across = across.select("request_id", F.when(F.col("at") < F.length("left"), F.col("line_no")).otherwise(F.col("next_line")).alias("line_no"))
    misread = hits.select("request_id", "line_no").unionByName(across).distinct().join(running.select("request_id", "line_no").distinct(), on=["request_id", "line_no"], how="left_anti")
    return running.unionByName(hyphen.distinct().withColumn("noise", F.lit("hyphen"))).unionByName(misread.withColumn("noise", F.lit("misread")))


def respell(word: str, meant: str, form: str) -> str:
    """``word`` with the characters of ``meant`` (lower case) where they differ, in the case of the word; ``form`` where its first letter is unknown."""
    if len(word) > 1 and word.upper() == word and sum(c.isalpha() for c in word) > 1:
        return meant.upper()
    low = word.lower()
    if len(low) != len(word):
        return form
    a = 0
    while a < min(len(low), len(meant)) and low[a] == meant[a]:
        a += 1
    if a == 0:
        return form if not word[0].isalpha() else meant[:1].upper() + meant[1:] if word[0].isupper() else meant
    b = 0
    while b < min(len(low), len(meant)) - a and low[-1 - b] == meant[-1 - b]:
        b += 1
    return word[:a] + meant[a : len(meant) - b] + word[len(word) - b :]


_APART = frozenset(".,;:?[])\"“”„«»…/·–—*=+_<>’'")


def _corrected(line: str, raw: str, meant: str, form: str) -> str:
    """``line`` with the word ``raw``, wherever it stands alone, respelled; signs around it stay."""
    core = regex.sub(r"^[-‐¬\u00ad(!]+|[-‐¬\u00ad]+$", "", raw)
    new = raw.replace(core, respell(core, meant, form), 1)
    at = line.find(raw)
    while at >= 0:
        end = at + len(raw)
        if all(c.isspace() or c in _APART for c in line[max(at - 1, 0) : at] + line[end : end + 1]):
            line = line[:at] + new + line[end:]
            at = line.find(raw, at + len(new))
        else:
            at = line.find(raw, at + 1)
    return line


def tidy(text: str, known: list[dict] | None = None, chain: Chain | None = None) -> str:
    """Readable paragraphs of one text: running lines dropped, broken words joined, lines of a paragraph joined by a space.

    A paragraph ends where the chain starts another one; the first line of a page is judged against the last one before it that is no running line.
    ``known`` are the verdicts of the corpus (``kind``, ``line_no``, ``word``, ``meant``, ``form``): running lines, starts, misread words, hyphens
    to keep, and broken words that are misread as a whole. Without them the text is labelled by itself.
    """
    chain = chain or Chain.given()
    pages, first = _split(text)
    if known is None:
        known = []
        for k, (page, states) in enumerate(zip(pages, chain.decode(observe(text, pages)))):
            rows = [i for i, line in enumerate(page) if line and not line.isspace()]
            known += [{"kind": "start" if s == START else "running", "line_no": first[k] + i} for i, s in zip(rows, states) if s != GOES_ON]
    lines: dict[str, set[int]] = {}
    for x in known:
        lines.setdefault(x["kind"], set()).add(x["line_no"])
    dropped, kept, starts = (lines.get(k, set()) for k in ("running", "keep", "start"))
    whole = {(x["line_no"], x["word"]): x for x in known if x["kind"] == "across"}
    fixes: dict[int, list[dict]] = {}
    for x in known:
        if x["kind"] == "misread":
            fixes.setdefault(x["line_no"], []).append(x)
    width = _width(pages)
    out: list[list[str]] = []  # paragraphs, each in pieces
    above, last = "", -1
    for k, page in enumerate(pages):
        turned = k > 0  # no line of the page has been kept yet
        for i, line in enumerate(page):
            no = first[k] + i
            if no in dropped or not line or line.isspace():
                continue
            begins = no in starts
            if turned and above:
                s = line.strip()
                begins = chain.paragraph_odds(_above(above.strip(), width) | _begins(s[0]) << _SHIFT["begins"] | ("  " in s) << _SHIFT["table"]) > 0
            turned = False
            cut = broken_word(above, line) if above else None
            above = line
            for x in fixes.get(no, ()):
                line = _corrected(line, x["word"], x["meant"], x["form"])
            line = line.strip()
            if not out or begins and not cut:
                out.append([line])
            else:
                before = out[-1][-1].rstrip()
                cut = broken_word(before, line)  # as corrected
                if cut and cut[2] == "-" and last in kept:
                    out[-1] += [line]
                elif cut:
                    word = cut[0] + cut[1]
                    x = whole.get((last, word.lower()))
                    out[-1][-1] = before[: -1 - len(cut[0])]
                    out[-1] += [respell(word, x["meant"], x["form"]) if x else word, line[len(cut[1]) :]]
                else:
                    out[-1] += [" ", line]
            last = no
    return "\n\n".join("".join(p) for p in out)


def repair(df: DataFrame, request: str = "request_id", text: str = "text", raw: str | None = "raw_ocr_response") -> DataFrame:
    """``request_id`` and ``repaired``: each text as continuous paragraphs, misread words and hyphens set right by the words of the corpus.

    Null stays null, empty stays empty. The verdicts are those of ``find_noise``; they join the texts by request.
    """
    source = whole_text(F.col(f"`{text}`"), F.col(f"`{raw}`")) if raw else F.col(f"`{text}`")
    pages = df.select(F.col(f"`{request}`").cast("long").alias("request_id"), source.alias("text"))
    scratch = Scratch(df.sparkSession, "repair")
    marks, chain, _, plain, hits, across = _judge(pages.filter("text is not null"), scratch, starts=True)
    none = F.lit(None).cast("string")

    def verdicts(rows: DataFrame, kind: str, word=none, meant=none, form=none) -> DataFrame:
        return rows.select("request_id", F.struct(F.lit(kind).alias("kind"), F.col("line_no"), word.alias("word"), meant.alias("meant"), form.alias("form")).alias("v"))

    rows = verdicts(_running(marks), "running").unionByName(verdicts(marks.filter("kind = 'start'"), "start")).unionByName(verdicts(plain.filter("spelled"), "keep"))
    rows = rows.unionByName(verdicts(hits, "misread", F.col("raw"), F.col("meant"), F.col("form"))).unionByName(verdicts(across, "across", F.col("joined"), F.col("meant"), F.col("form")))
    known = rows.groupBy("request_id").agg(F.sort_array(F.collect_set("v")).alias("known"))  # the verdicts of one request
    judged = pages.join(known, on="request_id", how="left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [None if t is None else tidy(t, k or [], chain) for t, k in zip(batch.column("text").to_pylist(), batch.column("known").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("request_id"), pa.array(done, pa.string())], names=["request_id", "repaired"])

    return judged.mapInArrow(run, "request_id long, repaired string")
