"""Texts cut by a field limit or a broken transfer (problem 10).

For each source the lengths of its distinct texts, in characters and in UTF-8 bytes, are
fitted by a log-normal distribution, right-censored at the source's candidate limits, by
maximum likelihood (EM). A limit is a length at which far more texts end than the fit
expects and many of these break off. For a text at a limit the censoring posterior - how
many texts at that length were cut, against how many would end there anyway - is combined
with the evidence of its ending; for a text elsewhere the source's rate of broken
transfers is. How much an ending says is fitted as well, from all texts, cut or whole being
what is not seen (EM). A copy of a cut text is cut wherever it stands.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.sources.tables import checkpointed

# How a whole text may end, by its last line.
SENTENCE_END = r"""(?:[。！？!?]|[A-Za-z0-9)\]%"”]\.)["”’』」）)]*$"""
CUT_MARK = r"(?:…|\.\.\.|�)$"
REMARK = r"^[（(][^（()）]*[)）]$"
LINK = r"(?:^|\s)[A-Za-z]+://\S+$"
DATE = r"^(?:\d{4}年\d{1,2}月\d{1,2}日|\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2} [A-Z][a-z]+ \d{4}|[A-Z][a-z]+ \d{1,2}, \d{4})$"
TOTAL = r"^(?:合计|合計|总计|總計|小计|小計|Total|Sum)[ :：\t]+\S*\s?\S*\d[\d,.]*\s?(?:[万萬亿億]?[元份]|%)?$"
ROW = r"^\S+(?: {2,}|\t+)[\d.,]+%?$|^\S+(?: {2,}|\t+)\S+$|^\|.*\|$"
CODE = r"^(?:SELECT|INSERT|UPDATE|DELETE|CREATE)\b.*(?:'[^']*'|;|\))$|\b(?:FROM|WHERE|VALUES|SET)\b.*(?:'[^']*'|;|\))$|[;{}]$"
FORMULA = r"^[A-Za-z]\w* = .*[\w)]$"
LIST = r"^(?:附件|附錄|附录|Annex(?:es)?|Attachments?)\s*[:：].*\d\s*[.．、]\s*\S+"
HEADING = r"^(?:第.{1,4}[章节節条條]|[一二三四五六七八九十百]+、|Chapter|Part|Section|#+)\s?\S*\s?\S+(?: \S+){0,5}$"
TITLE = r"^.{2,60}(?:简报|公告|说明|问答|报告|简報|簡報|說明|問答|報告|通知|办法|[Nn]otice|[Rr]eport|Q&A|[Mm]emo)$"
CLOSING = r"^(?:Regards|Kind regards|Best regards|Sincerely|Yours .*|此致|敬礼|敬禮|特此.*|谢谢|謝謝|Thank you),?\.?$"

KINDS = ("marked", "broken", "sentence", "structure")
#: Share of the kinds of ending among cut and among whole texts, before any text is seen, and the weight of these shares in texts: what the fit starts from.
CUT_SHARES, WHOLE_SHARES, WEIGHT = (0.25, 0.70, 0.03, 0.02), (0.00005, 0.001, 0.75, 0.25), 50.0
#: Bytes that a cut at a byte limit may leave unused, so as not to split a character.
SLACK = {"characters": 1, "bytes": 4}
#: A limit needs this share of broken endings and more texts than chance gives at one of all lengths with this probability.
BROKEN_SHARE, CHANCE = 0.3, 0.01
#: White space and other blanks at the ends of texts and lines.
BLANKS = " \t\f\v\u00a0\u1680\u2002\u2003\u2009\u3000\ufeff"


def _core(text: Column) -> Column:
    """The text without what a cut puts at its end: an ellipsis or a replacement character."""
    return F.regexp_replace(F.regexp_replace(text, r"�+\s*$", ""), r"(?:…|\.\.\.)\s*$", "")


def ending(text: Column) -> Column:
    """The kind of ending of a text that is not blank: marked, broken, sentence or structure."""
    whole = F.rtrim(text, F.lit(BLANKS + "\r\n"))
    last = F.substring_index(F.substring_index(whole, "\n", -1), "\r", -1)
    above = F.rtrim(F.left(whole, F.length(whole) - F.length(last)), F.lit(BLANKS + "\r\n"))
    before = F.trim(F.substring_index(F.substring_index(above, "\n", -1), "\r", -1), F.lit(BLANKS))
    last = F.trim(last, F.lit(BLANKS))
    short = F.length(last) <= 60
    structure = (
        last.rlike(REMARK) | last.rlike(LINK) | last.rlike(DATE) | last.rlike(TOTAL) | last.rlike(ROW) | last.rlike(CODE)
        | last.rlike(FORMULA) | last.rlike(LIST) | (short & last.rlike(HEADING)) | ((above == "") & last.rlike(TITLE)) | (short & before.rlike(CLOSING)) | last.rlike(CLOSING)
    )
    return (
        F.when(last.rlike(CUT_MARK) & ~last.rlike("……$"), "marked").when(last.rlike(SENTENCE_END), "sentence").when(structure, "structure").otherwise("broken")
    )


def fit_lognormal(lengths: np.ndarray, counts: np.ndarray, censored: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Mean and deviation of log length, ``censored`` lengths being lower bounds only (EM, to the maximum of the likelihood)."""
    x, w = np.log(lengths), counts.astype(float)
    mu, sigma = float(np.average(x, weights=w)), max(0.05, float(np.sqrt(np.average((x - np.average(x, weights=w)) ** 2, weights=w))))
    for _ in range(rounds if censored.any() else 0):
        z = (x[censored] - mu) / sigma
        tail = np.array([max(1e-12, 0.5 * math.erfc(v / math.sqrt(2))) for v in z])
        hazard = np.exp(-0.5 * z**2) / math.sqrt(2 * math.pi) / tail
        first, second = x.copy(), x**2
        first[censored] = mu + sigma * hazard
        second[censored] = mu**2 + sigma**2 + sigma * hazard * (x[censored] + mu)
        mu_new = float(np.average(first, weights=w))
        sigma_new = max(0.05, math.sqrt(max(1e-6, float(np.average(second, weights=w)) - mu_new**2)))
        done = abs(mu_new - mu) + abs(sigma_new - sigma) < 1e-6
        mu, sigma = mu_new, sigma_new
        if done:
            break
    return mu, sigma


def source_limits(hist: pd.DataFrame) -> pd.DataFrame:
    """Limits of one source and the odds of a cut at them, from its table of ``unit``, ``length``, ``kind``, ``n``.

    The row of unit ``anywhere`` gives the odds of a broken transfer away from all limits.
    """
    out = []
    atlimit = 0.0
    for unit, h in hist.groupby("unit"):
        table = h.pivot_table(index="length", columns="kind", values="n", aggfunc="sum", fill_value=0)
        lengths = table.index.to_numpy(float)
        total = table.sum(axis=1).to_numpy(float)
        bad = sum((table[k].to_numpy(float) for k in ("broken", "marked") if k in table), np.zeros(len(table)))
        lows = np.searchsorted(lengths, lengths - SLACK[unit] + 0.5)
        sums, bads = np.concatenate(([0], np.cumsum(total))), np.concatenate(([0], np.cumsum(bad)))
        ends = np.arange(1, len(lengths) + 1)
        in_window, bad_in_window = sums[ends] - sums[lows], bads[ends] - bads[lows]
        candidates = [i for i in np.argsort(-bad_in_window, kind="stable") if bad_in_window[i] > 0 and bad_in_window[i] >= BROKEN_SHARE * in_window[i] and in_window[i] > 1]
        mu, sigma = fit_lognormal(lengths, total, np.zeros(len(lengths), bool))
        # Windows that stand out of the first fit are taken as censored for the second, by which they are judged.
        for last in (False, True):
            chosen: list[tuple[int, float]] = []
            for i in candidates:
                density = math.exp(-0.5 * ((math.log(lengths[i]) - mu) / sigma) ** 2) / (lengths[i] * sigma * math.sqrt(2 * math.pi))
                expected = max(0.02, total.sum() * density * SLACK[unit])
                n = in_window[i]
                stands_out = n > expected and n * math.log(n / expected) - (n - expected) > math.log(len(lengths) / CHANCE)
                if stands_out and all(lengths[i] <= lengths[j] - SLACK[unit] or lengths[i] > lengths[j] + SLACK[unit] - 1 for j, _ in chosen):
                    chosen.append((i, expected))
            if not last:
                censored = np.zeros(len(lengths), bool)
                for i, _ in chosen:
                    censored[lows[i] : i + 1] = True
                mu, sigma = fit_lognormal(lengths, total, censored)
        for i, expected in chosen:
            odds = max(in_window[i] - expected, bad_in_window[i]) / expected
            out.append((unit, int(lengths[i]) - SLACK[unit], int(lengths[i]), math.log(odds)))
            atlimit = max(atlimit, bad_in_window[i])
    one = hist[hist.unit == "characters"]
    total, bad = one.n.sum(), one.n[one.kind.isin(["broken", "marked"])].sum()
    rate = (max(0.0, bad - atlimit) + 0.5) / (total + 20)
    out.append(("anywhere", 0, 0, math.log(rate / (1 - min(rate, 0.99)))))
    return pd.DataFrame(out, columns=["unit", "low", "high", "log_odds"])


def ending_evidence(table: list[tuple[float, str, int]], rounds: int = 50) -> dict[str, float]:
    """Log-likelihood ratios of the kinds of ending, cut against whole, from counts of texts by prior log odds and kind (EM).

    Every text is cut or whole; which it is, its prior odds and its ending say together.
    The shares of the kinds in both are those of greatest likelihood, ``WEIGHT`` texts of
    the first shares added. A sentence's end never speaks for a cut, nor a mark against one.
    """
    cut, whole = dict(zip(KINDS, CUT_SHARES)), dict(zip(KINDS, WHOLE_SHARES))
    first = dict(cut), dict(whole)
    for _ in range(rounds):
        n_cut, n_whole = ({k: WEIGHT * v for k, v in x.items()} for x in first)
        for odds, kind, n in table:
            z = odds + math.log(cut[kind] / whole[kind])
            p = 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))
            n_cut[kind] += n * p
            n_whole[kind] += n * (1 - p)
        cut, whole = ({k: v / sum(x.values()) for k, v in x.items()} for x in (n_cut, n_whole))
    found = {k: math.log(cut[k] / whole[k]) for k in KINDS}
    return {k: min(v, -1.0) if k in ("sentence", "structure") else max(v, 1.0) for k, v in found.items()}


def cut_texts(df: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """Every row's ``key``, ``source``, ``kind`` of ending, log odds ``score`` of a cut and ``cut``.

    Defined cases: null, empty and blank texts are not cut (kind ``blank``); a null source
    is a source of its own; copies count once in the fit and share the greatest score;
    repeated rows are kept; other columns are ignored. Lengths reach the fit as one
    table row for each source, length and kind, from partial sums.
    """
    t = F.col(text)
    blank = t.isNull() | ~t.rlike(r"[^\s　]")
    core = _core(t)
    rows = df.select(
        F.col(key).alias("k"), F.coalesce(F.col(source).cast("string"), F.lit("\0")).alias("s"), F.md5(t.cast("binary")).alias("h"),
        F.when(blank, "blank").otherwise(ending(t)).alias("kind"), F.length(core).alias("c"), F.octet_length(core).alias("b"),
    )
    rows = checkpointed(rows)  # a few short columns; the texts are read once
    distinct = rows.where("kind <> 'blank' and c > 0").groupBy("s", "h").agg(F.first("kind").alias("kind"), F.first("c").alias("c"), F.first("b").alias("b"))
    hist = distinct.select("s", "kind", F.explode(F.create_map(F.lit("characters"), "c", F.lit("bytes"), "b")).alias("unit", "length"))
    hist = hist.groupBy("s", "unit", "length", "kind").agg(F.count("*").alias("n"))

    def fit(h: pd.DataFrame) -> pd.DataFrame:
        return source_limits(h).assign(s=h.s.iloc[0])[["s", "unit", "low", "high", "log_odds"]]

    limits = hist.groupBy("s").applyInPandas(fit, "s string, unit string, low int, high int, log_odds double")
    limits = limits.groupBy("s").agg(F.collect_list(F.struct("unit", "low", "high", "log_odds")).alias("limits"))

    def odds(x: Column) -> Column:
        hit = (x.unit == "anywhere") | ((x.unit == "characters") & (F.col("c") > x.low) & (F.col("c") <= x.high)) | ((x.unit == "bytes") & (F.col("b") > x.low) & (F.col("b") <= x.high))
        return F.when(hit, x.log_odds)

    prior = F.array_max(F.transform("limits", odds))
    # Prior odds in quarters between -20 and 20: a table of at most 161 odds and four kinds, whatever the corpus.
    rounded = F.greatest(F.lit(-20.0), F.least(F.lit(20.0), F.round(prior * 4) / 4))
    seen = distinct.join(limits, "s").groupBy(rounded.alias("odds"), "kind").agg(F.count("*").alias("n")).collect()
    evidence = F.create_map(*[F.lit(v) for pair in ending_evidence([tuple(r) for r in seen]).items() for v in pair])
    scored = rows.join(limits, "s", "left").withColumn("own", F.when(F.col("kind") != "blank", prior + evidence[F.col("kind")]))
    best = scored.where("own is not null").groupBy("h").agg(F.max("own").alias("score"))
    scored = scored.join(best, "h", "left")
    return scored.select(
        F.col("k").alias(key), F.nullif("s", F.lit("\0")).alias(source), "kind", "score", (F.coalesce(F.col("score"), F.lit(-99.0)) > 0).alias("cut")
    )
