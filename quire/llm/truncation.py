"""Texts cut off by field limits or in transfer (problem 9).

Two kinds of evidence are joined as log-odds:

* Length. Per source, the lengths (in code points and in UTF-8 bytes) follow a log-normal distribution that
  field limits censor from the right. Limits are lengths at which far more texts lie than the fit expects;
  the fit is made by maximum likelihood with the texts at each limit as observations censored there (EM on
  sufficient statistics, one row per source). A text near a limit then has a posterior of being censored; any other
  text has the source's base rate of transfers that broke off.
* Ending. The last line belongs to a class: a mark of omission, an abbreviation or half a date before the last full stop, a finished
  sentence, a total, a closing formula, a firm, a list of enclosures, a line that many texts share, or none of these. What a class says
  is not fixed: its share among cut and among complete texts is learned from the corpus by EM, in which the posteriors of the lengths
  tell the two apart. The given shares stand for ``PSEUDO`` texts of each kind.

Only narrow rows (lengths and the class of ending) are shuffled, pre-aggregated by source and length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd

from pyspark.sql import Column, DataFrame, functions as F

from quire.session import Scratch

#: A limit holds so many times the texts that the fit expects there (of which at least ``FLOOR`` of the source's texts), and with this evidence
#: (log-likelihood ratio); so a source has at most 1 / (TIMES * FLOOR) limits per unit.
TIMES, FLOOR, EVIDENCE = 8, 1e-4, 20.0
#: Texts this much below or above a limit count as lying at it (a mark of omission, whole words, whole characters).
BELOW, ABOVE = 32, 8
#: A last line is common, or widely so, if at least this share of all texts has it besides the one in question. Texts are added to the corpus' own, so that
#: a few do not make a line common in a small one. There are at most 1 / share common lines.
COMMON, WIDELY_COMMON = (1e-4, 15_000), (1e-3, 1_000)
#: Posteriors of lengths are held to this and its complement.
LEAST = 1e-6
#: Texts that the given shares of endings, and a source's rate before it is known, stand for; rounds of learning.
PSEUDO, PSEUDO_RATE, ROUNDS = 20.0, 20.0, 6

#: Given shares among cut texts up to this are not learned: such an ending finishes what it ends, so a text cut right there does not break off inside anything.
FINISHED = 1e-4

# The classes of endings with their given shares among cut and among complete texts.
ENDINGS = {
    "omission": (0.08, 0.0002), "widely common omission": (FINISHED, 0.01), "closing formula": (FINISHED, 0.03), "et cetera": (FINISHED, 0.01), "firm after closing formula": (FINISHED, 0.1), "common firm": (0.0005, 0.05), "firm": (0.01, 0.01),
    "legal form and full stop": (0.01, 0.0002), "abbreviation": (0.05, 0.0002), "number and full stop": (0.03, 0.0002), "sentence": (FINISHED, 0.5), "total, frame or edition": (FINISHED, 0.15), "common enclosure or signature": (0.0005, 0.06),
    "enclosure or signature": (0.01, 0.003), "widely common line": (0.0005, 0.05), "name after closing formula": (0.02, 0.002), "other": (0.788, 0.001),
}

_CUR = r"(?:EUR|Euro|euros|€|£|\$|USD|GBP|CHF)"
_AMOUNT = r"\d{1,3}(?:[.,'’ \u00a0\u202f\u2009]?\d{3})*[.,]\d{2}"
# Legal forms, closing formulas, abbreviations.
_FORM = r"(?:GmbH|KG|OHG|AG|SE|UG|e\. ?K\.|e\.K\.|Inc\.|S\.L\.|S\.A\.|SARL|SAS|SA|SL|Ltd\.|Ltd|LLC|PLC|B\.V\.|[-–]?Stiftung|e\. ?V\.)"
_CLOSING = r"(?i)^\s*(?:mit (?:freundlichen|besten) grüßen|freundliche grüße|viele grüße|beste grüße|hochachtungsvoll|yours (?:sincerely|faithfully|truly)|(?:kind|best|warm) regards|sincerely(?: yours)?|cordialement|(?:bien cordialement|salutations distinguées|sincères salutations)|atentamente|(?:un )?cordial(?:es)? saludos?|saludos(?: cordiales)?|le saluda atentamente|un saludo)[,.]?\s*$"
_ABBREVIATION = r"(?i)(?:^|[\s(\[’'])(?:nr|no|nos|abs|abschn|art|anl|al|dr|prof|mr|mrs|ms|mme|m|sr|sra|fa|ca|vgl|bzw|z|b|d|h|u|a|p|s|e|i|co|bros|pág|núm|env|aprox|str|st|tel|evtl|inkl|zzgl|ggf|sog|approx|incl|excl|fig|vs|ref|c|l|n)\.$"


def ending_class(lines: tuple[Column, Column], common: Column, widely: Column) -> Column:
    """The class of the ending, a key of ``ENDINGS``. ``lines``: the last line and the one before it."""
    last, before = lines
    omission = last.rlike(r"(?:…|\.{3}|[\[(](?:…|\.{3})[\])])$")
    stop = last.rlike(r"[.!?。！？।؟]['\"”’»“)\]]*$")
    after_closing = before.rlike(_CLOSING)
    firm = last.rlike(r"^[\p{Lu}\d][^,:;!?]{1,70}?[\s-]?" + _FORM + r"$") & (F.size(F.split(last, r"\s+")) <= 8)
    ends_in_form = last.rlike(r"(?:^|[\s-])" + _FORM + "$")
    number_stop = last.rlike(r"(?:(?:^|\s)\d{1,3}|(?:^|\s)\d{1,2}\.\d{1,2}|(?:^|\s)[A-Z]\d{3}|\d[.,]\d{3})\.$")
    total = last.rlike(r"^(?:\d+\s{2,}.*\S\s{2,}|\p{L}[\p{L}.’'-]*(?: [\p{L}.’'-]+){0,4}:?\s{1,}(?<=\s\s))(?:" + _CUR + r"\s?)?" + _AMOUNT + r"(?:[\s\u00a0\u202f]?" + _CUR + r")?$") & last.rlike(_CUR)
    framed = last.rlike(r"^[–—*=-]{1,3}\s.*\S\s[–—*=-]{1,3}$")
    signed = last.rlike(r"^(?:i\. ?A\.|i\. ?V\.|p\. ?o\.|p\. ?p\.|for the|on behalf of|im Auftrag|par ordre|por orden)\s")
    edition = last.rlike(r"(?i)^(?:stand|version|versión|as of|issued|édition|edición|état|revised|rev\.?|updated)\b.{0,30}\b\d{4}$")
    enclosed = last.rlike(r"(?i)^(?:anlagen?|beilagen?|enclosures?|encl\.?|pièces? jointes?|annexes?|anexos?|adjuntos?)\s?:")
    return (
        F.when(omission, F.when(widely, "widely common omission").otherwise("omission"))
        .when(last.rlike(_CLOSING), "closing formula")
        .when(stop & last.rlike(r"(?i)(?:^|\s)(?:etc|usw)\.$"), "et cetera")
        .when(ends_in_form & firm & after_closing, "firm after closing formula")
        .when(ends_in_form & firm, F.when(common, "common firm").otherwise("firm"))
        .when(ends_in_form & stop, "legal form and full stop")
        .when(stop & last.rlike(_ABBREVIATION), "abbreviation")
        .when(stop & number_stop, "number and full stop")
        .when(stop, "sentence")
        .when(total | framed | edition, "total, frame or edition")
        .when(signed | enclosed, F.when(common, "common enclosure or signature").otherwise("enclosure or signature"))
        .when(widely, "widely common line")
        .when(after_closing & last.rlike(r"^\p{Lu}[\p{L}.'’-]*(?: [\p{L}.'’-]+){1,3}$"), "name after closing formula")
        .otherwise("other")
    )


def _bounded(df: DataFrame, most: int = 100_000) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` rows; else left to a shuffled join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def censored_fit(n: float, s1: float, s2: float, held: list[tuple[float, float]]) -> tuple[float, float]:
    """Mean and deviation of the log lengths by maximum likelihood: ``n`` free texts with sums of logs and of their squares, and of (limit, texts) held."""
    m = s1 / n if n else 0.0
    v = max(s2 / n - m * m, 1e-4) if n else 1.0
    total = n + sum(c for _, c in held)
    for _ in range(100 if held and n > 1 else 0):
        sd = math.sqrt(v)
        e1, e2 = s1, s2
        for limit, c in held:
            z = (limit - m) / sd
            upper = 0.5 * math.erfc(z / math.sqrt(2))
            hazard = math.exp(-z * z / 2) / math.sqrt(2 * math.pi) / upper if upper > 1e-12 else z + 1 / max(z, 1)
            e1 += c * (m + sd * hazard)
            e2 += c * (m * m + v + sd * hazard * (limit + m))
        m2 = e1 / total
        v2 = max(e2 / total - m2 * m2, 1e-4)
        done = abs(m2 - m) + abs(v2 - v) < 1e-7
        m, v = m2, v2
        if done:
            break
    return m, math.sqrt(v)


def _fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        fits = [censored_fit(n, s1, s2, [(h["lim"], h["c"]) for h in held]) for n, s1, s2, held in zip(pdf["n"], pdf["s1"], pdf["s2"], pdf["held"])]
        yield pd.DataFrame({"source": pdf["source"], "unit": pdf["unit"], "mu": [f[0] for f in fits], "sigma": [f[1] for f in fits]})


def _expected(lo: Column, hi: Column) -> Column:
    """Share of a log-normal between two lengths, by the density in the middle."""
    mid = F.log(F.greatest((lo + hi) / 2, F.lit(1.0)))
    z = (mid - F.col("mu")) / F.col("sigma")
    return F.exp(-z * z / 2) / (F.col("sigma") * math.sqrt(2 * math.pi)) * (F.log(F.greatest(hi, F.lit(1.0)) + 0.5) - F.log(F.greatest(lo, F.lit(1.0)) - 0.5))


def _windows(limits: DataFrame) -> DataFrame:
    """Each limit with every length that lies at it (``at``): ``BELOW + ABOVE + 1`` rows, so that lengths are met by equality."""
    return limits.withColumn("at", F.explode(F.sequence(F.greatest(F.col("limit") - BELOW, F.lit(1)), F.col("limit") + ABOVE)))


def find_limits(lengths: DataFrame, scratch: Scratch) -> DataFrame:
    """Field limits from (``source``, ``unit``, ``length``, ``n`` texts): ``source``, ``unit``, ``limit``, ``censored`` (the posterior
    of a text at the limit). Fits twice: all texts, then those at a limit as censored there."""
    x = F.log("length")

    def on(left: DataFrame, right: DataFrame, *pairs: tuple[str, str]) -> list[Column]:
        return [left["source"].eqNullSafe(right["s"]), left["unit"] == right["u"], *[left[a] == right[b] for a, b in pairs]]

    def named(df: DataFrame) -> DataFrame:
        return _bounded(df.withColumnsRenamed({"source": "s", "unit": "u"}))

    def parameters(held: DataFrame) -> DataFrame:
        """One row per source and unit: its sums, those of each limit apart, and the fit."""
        by_limit = held.groupBy("source", "unit", "limit").agg(F.sum("n").cast("double").alias("n"), F.sum(F.col("n") * x).alias("s1"), F.sum(F.col("n") * x * x).alias("s2"))
        free = F.col("limit").isNull()
        sums = [F.sum(F.when(free, F.col(c)).otherwise(0.0)).alias(c) for c in ("n", "s1", "s2")]
        limits = F.collect_list(F.when(~free, F.struct(F.log("limit").alias("lim"), F.col("n").alias("c")))).alias("held")  # at most 1 / (TIMES * FLOOR)
        return by_limit.groupBy("source", "unit").agg(*sums, limits).mapInPandas(_fit, "source string, unit string, mu double, sigma double")

    lengths = lengths.filter("length > 0")
    first = parameters(lengths.withColumn("limit", F.lit(None).cast("int")))
    sized = named(scratch.write(lengths.groupBy("source", "unit").agg(F.sum("n").alias("texts")).join(first.withColumnsRenamed({"source": "s", "unit": "u"}), on=[F.col("source").eqNullSafe(F.col("s")), F.col("unit") == F.col("u")]).drop("s", "u"), "sized"))
    spikes = lengths.join(sized, on=on(lengths, sized)).drop("s", "u")
    expected = F.col("texts") * F.greatest(_expected(F.col("length"), F.col("length")), F.lit(FLOOR))
    spikes = spikes.withColumn("e", expected).filter((F.col("n") > TIMES * F.col("e")) & (F.col("n") * F.log(F.col("n") / F.col("e")) - F.col("n") + F.col("e") >= EVIDENCE))
    spikes = scratch.write(spikes.select("source", "unit", F.col("length").alias("limit"), "n"), "spikes")
    other = spikes.select(F.col("source").alias("s"), F.col("unit").alias("u"), F.col("limit").alias("l"), F.col("n").alias("m"))
    near = [*on(spikes, other), F.abs(spikes["limit"] - other["l"]) <= BELOW + ABOVE, (other["m"] > spikes["n"]) | ((other["m"] == spikes["n"]) & (other["l"] > spikes["limit"]))]
    limits = named(_windows(spikes.join(other, on=near, how="left_anti").select("source", "unit", "limit")))
    held = scratch.write(lengths.join(limits, on=on(lengths, limits, ("length", "at")), how="left").select("source", "unit", "length", "n", "limit"), "held")
    second = named(parameters(held))
    window = held.filter("limit is not null").groupBy("source", "unit", "limit").agg(F.sum("n").alias("seen"))
    window = window.join(second, on=on(window, second)).drop("s", "u")
    window = window.join(sized.drop("mu", "sigma"), on=on(window, sized)).drop("s", "u")
    free = F.col("texts") * _expected(F.col("limit") - BELOW, F.col("limit") + ABOVE) / F.col("seen")
    return window.select("source", "unit", "limit", F.least(F.greatest(1 - free, F.lit(LEAST)), F.lit(1 - LEAST)).alias("censored"))


_NAMES = list(ENDINGS)


def learn_endings(cells: DataFrame, rounds: int = ROUNDS) -> tuple[dict[str, float], DataFrame]:
    """Log-likelihood ratios of the classes of endings, and the base ``rate`` per ``source``, from (``source``, ``censored``, ``ending``, ``n``).

    EM: with the ratios of the round before each source settles its rate by itself, texts are shared out between cut and complete, and
    the shares of the classes are summed up in Spark. ``cells`` has one row per source, limit and class.
    """
    given = np.array(list(ENDINGS.values()))
    rows = cells.groupBy("source").agg(F.collect_list(F.struct("censored", "ending", "n")).alias("cells"))  # limits times classes

    def settle(found, ratios: np.ndarray, base: float) -> tuple[np.ndarray, float]:
        n = np.array([c["n"] for c in found], float)
        kind = np.array([_NAMES.index(c["ending"]) for c in found])
        at = np.array([c["censored"] if c["censored"] is not None else np.nan for c in found], float)
        free, rate, q = np.isnan(at), base, np.zeros(len(n))
        for _ in range(30):
            prior = np.clip(np.where(free, rate, np.fmax(at, rate)), LEAST, 1 - LEAST)
            q = 1 / (1 + np.exp(-(np.log(prior / (1 - prior)) + ratios[kind])))
            fresh = (float((n * q)[free].sum()) + PSEUDO_RATE * base) / (float(n[free].sum()) + PSEUDO_RATE)
            if abs(fresh - rate) < 1e-9:
                break
            rate = fresh
        sums = np.zeros((len(_NAMES), 2))
        np.add.at(sums, (kind, 0), n * q)
        np.add.at(sums, (kind, 1), n * (1 - q))
        return sums, rate

    ratios, base = np.log(given[:, 0] / given[:, 1]), 0.05
    for _ in range(rounds):

        def share(batches: Iterator[pd.DataFrame], r=ratios, b=base) -> Iterator[pd.DataFrame]:
            total = np.zeros((len(_NAMES), 2))
            for pdf in batches:
                for found in pdf["cells"]:
                    total += settle(found, r, b)[0]
            yield pd.DataFrame({"kind": range(len(_NAMES)), "cut": total[:, 0], "whole": total[:, 1]})

        sums = np.zeros((len(_NAMES), 2))
        for r in rows.mapInPandas(share, "kind int, cut double, whole double").groupBy("kind").agg(F.sum("cut").alias("cut"), F.sum("whole").alias("whole")).collect():  # one row per class
            sums[r["kind"]] = r["cut"], r["whole"]
        sums[given[:, 0] <= FINISHED, 0] = 0.0
        shares = (sums + PSEUDO * given) / (sums.sum(0) + PSEUDO)
        shares[:, 0] = np.where(given[:, 0] <= FINISHED, given[:, 0], shares[:, 0])
        ratios = np.log(shares[:, 0] / shares[:, 1])
        base = float((sums[:, 0].sum() + 0.05 * PSEUDO) / (sums.sum() + PSEUDO))

    def rates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"source": pdf["source"], "rate": [settle(found, ratios, base)[1] for found in pdf["cells"]]})

    return dict(zip(_NAMES, map(float, ratios))), rows.mapInPandas(rates, "source string, rate double")


def detect_truncated(df: DataFrame, keys: list[str], text: str = "text", source: str = "source") -> DataFrame:
    """One row per row of ``df``: ``keys``, ``source``, ``truncated`` (boolean), ``odds`` (log-odds), ``ending`` (the
    ending's part), ``kind`` (the ending's class), ``limit`` and ``unit`` of the field limit at which the text lies, if any.

    Null, empty and blank texts are never truncated (odds null). A null source is a source of its own. Repeated rows are judged
    alike. Other columns are ignored.
    """
    scratch = Scratch(df.sparkSession, "cut")
    t = F.col("_t")
    base = df.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{source}`").cast("string").alias("_src"), F.col(f"`{text}`").alias("_t"))
    clean = F.translate(F.regexp_replace(t, r"\s+\z", ""), "\f", "\n")
    last = F.trim(F.substring_index(clean, "\n", -1))
    tail = F.regexp_replace(F.substring(clean, 1, F.length(clean) - F.length(F.substring_index(clean, "\n", -1))), r"\s+\z", "")
    before = F.trim(F.substring_index(tail, "\n", -1))
    shape = F.xxhash64(F.regexp_replace(last, r"\d+(?:[.,/ \u00a0\u202f\u2009-]\d+)*", "#"))
    rows = base.select(*keys, "_src", F.length(t).alias("_chars"), F.octet_length(t).alias("_bytes"), last.alias("_last"), before.alias("_before"), F.when(last != "", shape).alias("_shape"))
    rows = scratch.write(rows, "endings")
    total = rows.count()
    (least, prior), (wide, wide_prior) = COMMON, WIDELY_COMMON
    often = rows.filter("_shape is not null").groupBy("_shape").agg((F.count(F.lit(1)) - 1).alias("_n")).filter(F.col("_n") >= least * (total + prior))
    often = F.broadcast(often.withColumnRenamed("_shape", "_o"))  # at most 1 / share of COMMON rows
    units = F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("_chars").alias("length")), F.struct(F.lit("bytes").alias("unit"), F.col("_bytes").alias("length"))))
    texts = rows.filter("_chars > 0").groupBy("_src", "_chars", "_bytes").agg(F.count(F.lit(1)).alias("n"))
    lengths = texts.select(F.col("_src").alias("source"), "n", units.alias("x")).select("source", "x.unit", "x.length", "n").groupBy("source", "unit", "length").agg(F.sum("n").alias("n"))
    limits = scratch.write(find_limits(scratch.write(lengths, "lengths"), scratch), "limits")
    widely = F.coalesce(F.col("_n") >= wide * (total + wide_prior), F.lit(False))
    scored = rows.join(often, on=rows["_shape"] == often["_o"], how="left").withColumn("kind", F.when(F.col("_last") != "", ending_class((F.col("_last"), F.col("_before")), F.col("_n").isNotNull(), widely))).drop("_n", "_o", "_last", "_before", "_shape")
    for unit in ("chars", "bytes"):
        own = _bounded(_windows(limits.filter(F.col("unit") == unit)).select(F.col("source").alias("s"), F.col("limit").alias(f"l_{unit}"), F.col("censored").alias(f"c_{unit}"), "at"))
        scored = scored.join(own, on=scored["_src"].eqNullSafe(own["s"]) & (scored[f"_{unit}"] == own["at"]), how="left").drop("s", "at")
    best = F.greatest("c_chars", "c_bytes")
    # A limit in code points shows in the bytes too, somewhat blurred; so bytes must be clearly the better explanation.
    by_bytes = F.coalesce("c_bytes", F.lit(0.0)) > F.coalesce("c_chars", F.lit(0.0)) + 0.01
    scored = scored.withColumn("censored", best).withColumn("limit", F.when(by_bytes, F.col("l_bytes")).otherwise(F.col("l_chars"))).withColumn("unit", F.when(by_bytes, "bytes").when(F.col("l_chars").isNotNull(), "chars")).drop("_chars", "_bytes", "c_chars", "c_bytes", "l_chars", "l_bytes")
    scored = scratch.write(scored, "scored")
    cells = scored.filter("kind is not null").groupBy(F.col("_src").alias("source"), "limit", "unit", "censored", F.col("kind").alias("ending")).agg(F.count(F.lit(1)).alias("n"))
    ratios, rate = learn_endings(scratch.write(cells, "cells"))
    rate = _bounded(scratch.write(rate, "rates").withColumnRenamed("source", "s"))
    joined = scored.join(rate, on=scored["_src"].eqNullSafe(rate["s"]), how="left").drop("s")
    p = F.least(F.greatest(F.coalesce("censored", F.lit(0.0)), F.coalesce("rate", F.lit(0.0)), F.lit(LEAST)), F.lit(1 - LEAST))
    ending = F.create_map(*[F.lit(x) for kv in ratios.items() for x in kv])[F.col("kind")]
    joined = joined.withColumn("ending", ending).withColumn("odds", F.log(p / (1 - p)) + F.col("ending"))
    return joined.select(*keys, F.col("_src").alias("source"), F.coalesce(F.col("odds") > 0, F.lit(False)).alias("truncated"), "odds", "ending", "kind", "limit", "unit")


def truncation_report(found: DataFrame) -> DataFrame:
    """How often each source truncates: ``source``, ``documents``, ``truncated``, ``share``, ``at_limit``."""
    return found.groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"), F.sum(F.col("truncated").cast("long")).alias("truncated"),
        F.avg(F.col("truncated").cast("double")).alias("share"), F.sum((F.col("truncated") & F.col("limit").isNotNull()).cast("long")).alias("at_limit"),
    )
