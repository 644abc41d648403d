"""Sentence units across languages and scripts (problem 5).

A text is cut at form feeds and blank lines into blocks; inside a block, a semi-Markov dynamic programme chooses the whole
spans. Possible borders are end marks (with the closing quotes that follow them) and, in scripts
written without end marks, spaces. A span's score joins its closing word and end mark, the
opening word of what follows, its length and whether its quotations balance: every border is charged for the quotations it lies in, so
a border inside a quotation or after an abbreviation loses against the span that runs over it, however many there are.

The programme is exact over all spans of a block and linear in its borders: a span's length counts against it by a convex function of two
pieces, so the best start is the best of a window (a queue that keeps its maximum) or the best of all starts before it (one running maximum).

Opening words are learned from the corpus: ``fit_openers`` takes the share of the blocks that each word opens.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator, Mapping

import pyarrow as pa
import regex

from pyspark.sql import DataFrame, functions as F, types as T

from quire.session import Scratch

#: An opening word counts if it opens at least this share of all blocks; so at most 1/share words are sent to the executors.
LEAST_SHARE = 2e-5
#: Blocks added to the corpus' own in taking shares, so that those of a small corpus are not sure of themselves.
PRIOR_BLOCKS = 1000
#: What a border inside a quotation costs, by depth; a span's length beyond which its excess counts against it, and the excess that costs 1; the
#: length below which a span is hardly one, and what that costs.
QUOTED, LONG, EXCESS, SHORT, STUB = 12.0, 600, 300.0, 3, 3.0

# Abbreviations that do not end a sentence when a word follows.
_NEVER = frozenset("""
abb abs abschn abt al alin allg anh anl anm approx aprox art aufl av avda bd best.-nr bl bros bsp bspw bzgl bzw ca cap cf ch chap co depto dept dipl dir dna do doc
dr dra dres ed eds eff einschl env esp etw evtl ex excl exp ext fa fasc fig figs fol fr frl gem ges gest ggf hon hr hrn id incl ing inkl insb jg jr kap kfm
lic lit ll maj max mgr mind min mio mlle mm mme mr mrs ms mons mrd mt mtro mwst n no nos nr nro nro núm num op obj orig p pag pág párr pkt pl pos pp prof proj prov
ptas pto ref rel resp rev rgt s sec sect sen sess sog sr sra sres srta st ste str stv tab tel temp tfno tit tlf tom töchter u uds ud usf vers vgl vol vs z zz zzgl zt ziff
κ κα κος σελ αρ κεφ παρ τηλ δρ
श्री श्रीमती डॉ क्र सं पृ प्रो रु नं कु
""".split())
# Abbreviations that may stand at the end of a sentence.
_MAYBE = frozenset("a.m p.m p.a etc usw suiv ff f inc ltd corp s.l s.a u.s u.k e.v plc k.g sarl gmbh kg ag llc mill κ.λπ κ.ά κλπ d.c a.d ss sq seq uam".split())
# Months after which a day number with a full stop is a date.
_MONTHS = frozenset("januar jänner februar märz april mai juni juli august september oktober november dezember jan feb mär apr jun jul aug sep sept okt nov dez quartal jahrhundert halbjahr".split())
# Thai sentence particles and final words; words that continue a statement.
_THAI_FINAL = ("ครับ", "ค่ะ", "คะ", "นะ", "จ้ะ", "จ้า", "แล้ว", "ไหม", "มั้ย", "เลย", "ด้วย", "หรือยัง", "หรือไม่")
_THAI_OPEN = ("ว่า", "คือ", "และ", "หรือ", "แต่", "ที่", "ซึ่ง", "โดย", "ของ", "ภายใน", "จำนวน", "เลขที่", "ครบ", "กับ", "ถึง")
_THAI_GOES_ON = ("และ", "หรือ", "แต่", "ที่", "ซึ่ง", "โดย", "เพราะ", "ภายใน", "ไม่รวม", "รวมทั้ง", "จาก", "ของ", "บาท", "รายการ", "วัน", "เปอร์เซ็นต์", "ยังไม่", "พร้อม", "เพื่อ", "จึง", "ใน")

_OPEN = {"“": "”", "„": "“", "‚": "‘", "«": "»", "‹": "›", "「": "」", "『": "』", "《": "》", "〈": "〉"}
_QUOTES = regex.compile(r"[“”„‚‘«»‹›「」『』《》〈〉\"]")
_BLOCK = regex.compile(r"\f|\n[^\S\n\f]*(?=\n)[\s--\f]*", regex.V1)
_MARKS = regex.compile(r"(?:\.{2,}|…+|[.!?‼⁇⁈⁉]+)|[。！？．｡]+|[।॥؟۔։።፧។။།]+|(?<=[\p{Greek}»”])[;;](?=\s|[»”]|$)")
_UNSPACED = regex.compile(r"(?<=[฀-໿က-႟ក-៿\d)])[  \n]+(?=\S)|(?<=\S)[  \n]+(?=[฀-໿က-႟ក-៿])")
_UNSPACED_SCRIPT = regex.compile(r"[฀-໿က-႟ក-៿]")
_LEAD = regex.compile(r"[\s\"“”„‚‘«‹「『(\[¿¡*•–-]*")
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}][\p{L}\p{M}\p{N}’'-]*")
_LIST_NO = regex.compile(r"(?:\d{1,3}|[A-Za-z]|[ivxIVX]{1,5})(?:\.\d{1,3})*")
_WIDE = "。！？．｡"


def _roles(text: str) -> tuple[dict[int, int], dict[int, int]]:
    """Roles of the quotation marks that have a partner: position to +1 (opens) or -1 (closes); and the opening mark of each closing one.

    Marks used both ways are told apart by what is open. A mark without a partner has no role.
    """
    stack: list[tuple[str, int]] = []  # what would close it, where it opened
    partner: dict[int, int] = {}

    def close(c: str, i: int) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == c:
                partner[i] = stack[k][1]
                del stack[k:]
                return

    for m in _QUOTES.finditer(text):
        c, i = m.group(), m.start()
        if c == '"':
            if any(x == c for x, _ in stack):
                close(c, i)
            else:
                stack.append((c, i))
        elif stack and stack[-1][0] == c:
            partner[i] = stack.pop()[1]
        elif c in _OPEN:
            stack.append((_OPEN[c], i))
        else:
            close(c, i)
    return {i: 1 for i in partner.values()} | {i: -1 for i in partner}, partner


def _cased(word: str) -> str:
    """'u' starts like a sentence (capital first, or a capital inside as in brand names), 'l' in lower case, 'd' digit, 'n' no case."""
    c = word[:1]
    if c.isdigit():
        return "d"
    if c.isupper() or c.istitle():
        return "u"
    if c.islower():
        return "u" if len(word) > 1 and word[1].isupper() else "l"
    return "n"


_JOINED = regex.compile(r"\p{L}{3,}[.!?](\p{L}+)$")
_PLAIN = regex.compile(r"[\p{L}’'-]*\p{L}{2,}|.*[)\]»”“]|\d{3,}|.*[%€]")
_WIDE_NEXT = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]")
_ELIDED = regex.compile(r"^(?:l|d|qu|c|j|s|n)[’']")
_SHORTENED = regex.compile(r"(?:\p{L}{1,3}\.)+\p{L}{1,3}")
_STOPS = frozenset(" \t\n\r\x0b\x0c\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000“”„«»「」\"([。！？")


def _last_word(block: str, at: int) -> str:
    """The word that ends at ``at``, or its last 256 characters, by which all rules judge a longer one alike."""
    k, least = at, max(0, at - 256)
    while k > least and block[k - 1] not in _STOPS:
        k -= 1
    return block[k:at]


def _known(word: str, openers: Mapping[str, float]) -> float:
    """How much a word speaks for a beginning, 0 to 3, by the share of blocks it opens."""
    share = openers.get(word)
    return min(3.0, math.log1p(share / LEAST_SHARE) * 0.6) if share else 0.0


def _border(block: str, at: int, mark: str, nxt: int, openers: Mapping[str, float]) -> float | None:
    """Log-odds that a sentence ends at the end mark starting at ``at``, the next text starting at ``nxt``; None: impossible."""
    lead = _LEAD.match(block, nxt).end()
    m = _WORD.match(block, lead)
    following = m.group() if m else block[lead : lead + 1]
    case = _cased(following) if following else "n"
    opening = lead > nxt and any(c in "“„«‹「『¿¡\"" for c in block[nxt:lead])
    if mark[0] in _WIDE or mark[0] in "।॥؟۔։።፧។။།":
        return 6.0
    known = _known(following, openers)
    if mark[0] == "…" or mark.startswith(".."):
        return -6.0 if case in "ln" else 0.5 if opening else -1.0 + known
    word = _last_word(block, at)
    if "." in word or "!" in word or "?" in word:
        joined = _JOINED.search(word)
        word = joined[1] if joined else word
    spaced = nxt > at + len(mark) and any(c.isspace() for c in block[at + len(mark) : nxt])
    if not spaced and nxt < len(block):
        # A missing space: an ordinary word, the mark, and at once a capital.
        plain = _PLAIN.fullmatch(word) is not None or (mark[0] in "!?" and len(mark) >= 1)
        wide_next = following and _WIDE_NEXT.match(following)
        if wide_next and case == "n":
            return 3.0 if plain else None
        return 2.5 if case == "u" and plain and word.lower() not in _NEVER and word.lower() not in ("www", "http") and (word[:1].islower() or len(word) > 3) else None
    if mark[0] in "!?‼⁇⁈⁉;;":
        return -5.0 if case == "l" else 5.0
    if case == "l":
        return -6.0
    low = word.lower().lstrip("([¿¡'’")
    if "’" in low or "'" in low:
        low = _ELIDED.sub("", low)
    if low in _MAYBE:
        return -3.0 if case == "d" else 0.5 + known
    if low in _NEVER:
        return -5.0
    if len(low) == 1 and low.isalpha():
        before = block[max(0, at - 4) : at]
        return (0.5 if before.lower().endswith("e. k") or before.lower().endswith("e.k") else -4.5) + (known if known > 1.5 else 0)
    if low.isdigit():
        k = at - len(word)
        while k > 0 and block[k - 1] in " \t":
            k -= 1
        if _LIST_NO.fullmatch(low):
            if k == 0:
                return -8.0
            if block[k - 1] == "\n" and len(low) < 3 and case == "u":
                while k > 0 and block[k - 1].isspace():
                    k -= 1
                if k == 0 or block[k - 1] in ".!?:":
                    return -8.0
        if following.lower() in _MONTHS and len(low) < 3:
            return -8.0
        return (1.0 if len(low) > 2 else -1.0) + known + (1.0 if opening or len(low) > 2 else 0)
    if "." in low.strip(".") and _SHORTENED.fullmatch(low):
        return -2.0 + known
    if not low:
        return 3.0 if block[at - 1 : at] in set(")]”“»%") else -2.0
    return 4.5


def _thai(block: str, end: int, nxt: int) -> float:
    """Log-odds that a unit ends at a space in a script without end marks."""
    if block.endswith(_THAI_OPEN, 0, end) and not block.endswith(("แล้ว", "ครับ"), 0, end):
        return -5.0
    if not _UNSPACED_SCRIPT.match(block, end - 1, end):
        return -5.0
    if block.startswith(_THAI_GOES_ON, nxt):
        return -5.0
    if block.endswith(_THAI_FINAL, 0, end):
        return 4.0
    c = block[nxt]
    if c.isdigit() or c.isascii() and c.isalpha():
        return -4.0
    return -2.0


def _reported(block: str, roles: Mapping[int, int], opened: int, nxt: int) -> bool:
    """Whether the words after a quotation (which opened at ``opened``) report it: they go on in lower case, or, in a script without
    capitals, nothing before the quotation introduces it, or a quoting particle follows."""
    if roles.get(nxt) == 1:
        return False
    if _cased(block[nxt : nxt + 2]) == "l" or block[nxt] == "と":
        return True
    k = opened
    while k > 0 and block[k - 1].isspace():
        k -= 1
    return block[k - 1 : k] not in (":", "：", ",", "，", "、")


def _candidates(block: str, roles: Mapping[int, int], partner: Mapping[int, int], openers: Mapping[str, float]) -> list[tuple[int, int, float]]:
    """Possible borders: end of the sentence, start of the next, log-odds."""
    borders: list[tuple[int, int, float]] = []
    for m in _MARKS.finditer(block):
        end = m.end()
        opened = None  # where the quotation that ends with this mark began
        while True:  # closing quotes and brackets belong to the sentence
            k = end
            while k < len(block) and block[k] in " \u00a0\u202f":
                k += 1
            if k < len(block) and roles and roles.get(k) == -1 and (k == end or block[k] in "»›"):
                end, opened = k + 1, partner[k]
            elif end < len(block) and block[end] in ")]）］'’" and not block[end + 1 : end + 2].isalpha():
                end += 1
            else:
                break
        nxt = end
        while nxt < len(block) and block[nxt].isspace():
            nxt += 1
        if nxt >= len(block):
            break
        if block[end] in ",;:，；：、)]）":
            continue
        odds = _border(block, m.start(), m.group(), nxt, openers)
        if odds is None:
            continue
        if opened is not None:
            case = _cased(block[nxt : nxt + 2])
            if case in "ln" and _reported(block, roles, opened, nxt):
                odds = -12.0
            elif case == "u":
                odds = max(odds, 4.0)  # a capital after a finished quotation
        borders.append((end, nxt, odds))
    if _UNSPACED_SCRIPT.search(block):
        known = {e for e, _, _ in borders}
        for m in _UNSPACED.finditer(block):
            if m.start() not in known:
                borders.append((m.start(), m.end(), _thai(block, m.start(), m.end())))
        borders.sort()
    return borders


def _best_spans(starts: list[int], ends: list[int], values: list[float]) -> list[tuple[int, int]]:
    """The spans (start, end) that cover all and whose summed scores are highest; ``values`` are those of the borders at their ends.

    Exact over all spans: a span scores its end's value, less what its length costs. Starts up to ``LONG`` back cost nothing and are kept in a queue
    by falling score; of those further back one is best for every later end; those too near are tried one by one.
    """
    best, back = [0.0], [0]
    near = 0  # the first start that is not yet far enough for a whole sentence
    window: deque[int] = deque()
    far, far_score = -1, -math.inf
    for j, end in enumerate(ends):
        while near <= j and end - starts[near] >= SHORT:
            while window and best[window[-1]] < best[near]:
                window.pop()
            window.append(near)
            near += 1
        while window and end - starts[window[0]] > LONG:
            i = window.popleft()
            score = best[i] + starts[i] / EXCESS
            if score > far_score:
                far, far_score = i, score
        v, at = -math.inf, j
        if far >= 0:
            v, at = far_score + (LONG - end) / EXCESS, far
        if window and best[window[0]] > v:
            v, at = best[window[0]], window[0]
        for i in range(near, j + 1):
            if best[i] - STUB > v:
                v, at = best[i] - STUB, i
        best.append(v + values[j])
        back.append(at)
    out, j = [], len(ends)
    while j > 0:
        out.append((starts[back[j]], ends[j - 1]))
        j = back[j]
    return out[::-1]


def block_sentences(block: str, openers: Mapping[str, float]) -> list[tuple[int, int]]:
    """Sentence ranges of one block, by dynamic programming over its possible borders."""
    first, last = len(block) - len(block.lstrip()), len(block.rstrip())
    if first >= last:
        return []
    roles, partner = _roles(block) if _QUOTES.search(block) else ({}, {})
    borders = [b for b in _candidates(block, roles, partner, openers) if b[0] > first and b[1] < last]
    if not borders:
        return [(first, last)]
    values = [odds for _, _, odds in borders]
    if roles:
        marks, k, depth = sorted(roles), 0, 0
        for n, (end, _, odds) in enumerate(borders):
            while k < len(marks) and marks[k] < end:
                depth += roles[marks[k]]
                k += 1
            values[n] = odds - QUOTED * depth
    return _best_spans([first] + [b[1] for b in borders], [b[0] for b in borders] + [last], values + [0.0])


def sentences(text: str, openers: Mapping[str, float] | None = None) -> list[tuple[int, int]]:
    """Half-open code point ranges of the sentence units of ``text``, without surrounding white space."""
    out, at = [], 0
    for m in [*_BLOCK.finditer(text), None]:
        stop = m.start() if m else len(text)
        out += [(at + a, at + b) for a, b in block_sentences(text[at:stop], openers or {})]
        at = m.end() if m else stop
    return out


def fit_openers(df: DataFrame, text: str) -> dict[str, float]:
    """The opening words of the blocks of the corpus (list numbers are skipped), each with the share of blocks it opens.

    Each word's first block is not counted, lest a word speak for itself. Words of at least ``LEAST_SHARE`` are kept, at most 1 / ``LEAST_SHARE``.
    """
    blocks = df.select(F.explode(F.split(F.col(f"`{text}`"), r"\f|\n[ \t\r]*\n\s*")).alias("b"))
    word = F.regexp_extract("b", r"^[^\p{L}\p{N}]*(?:\d{1,3}\.\s+)?[^\p{L}\p{N}]*([\p{L}][\p{L}\p{M}\p{N}’'-]*)", 1)
    counts = Scratch(df.sparkSession, "openers").write(blocks.select(word.alias("w")).filter("w <> ''").groupBy("w").agg(F.count(F.lit(1)).alias("n")), "counts")
    total = (counts.agg(F.sum("n")).first()[0] or 0) + PRIOR_BLOCKS  # one number
    share = (F.col("n") - 1) / F.lit(float(total))
    return {r.w: r.s for r in counts.select("w", share.alias("s")).filter(F.col("s") >= LEAST_SHARE).collect()}  # at most 1 / LEAST_SHARE


def split_sentences(df: DataFrame, text: str, openers: Mapping[str, float] | None = None) -> DataFrame:
    """One row per sentence unit: the other columns of ``df``, then ``start_offset`` and ``end_offset`` (code points, half open).

    ``openers`` defaults to those fitted on ``df`` itself. Null and blank texts give no rows; repeated rows give repeated
    sentences. Input columns with the names of the result are dropped. Nothing is shuffled but the counts of opening words.
    """
    made = ["start_offset", "end_offset"]
    rest = [c for c in df.columns if c != text and c not in made]
    known = dict(openers) if openers is not None else fit_openers(df, text)
    src = df.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text}`").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, a, b = [], [], []
            for i, t in enumerate(batch.column("_text").to_pylist()):
                if t:
                    for start, end in sentences(t, known):
                        at.append(i), a.append(start), b.append(end)
            kept = batch.select(rest).take(pa.array(at, pa.int64())) if rest else None
            yield pa.RecordBatch.from_arrays([*(kept.columns if kept is not None else []), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=[*rest, *made])

    schema = T.StructType([*src.drop("_text").schema.fields, T.StructField("start_offset", T.LongType()), T.StructField("end_offset", T.LongType())])
    return src.mapInArrow(run, schema)
