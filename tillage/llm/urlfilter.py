"""Operator 9: URL filters by host word segmentation and naive Bayes."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillage.llm.common import Scratch

#: The rules, as (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Words that mark a host as unwanted when they stand in its name, or a page when its text is full of them; they label what the model learns from.
UNWANTED = tuple("ads adult bets betting casino crack drugs escort gambling jackpot keygen loans nude payday pills pharma poker porn sex slots spam torrent viagra warez xxx".split())
#: Common words of web names, most common first, which the segmentation knows besides.
COMMON = tuple("www blog news the of and to in for on with home page index site web shop store online info about world life art music game games tech data book books house health food travel school city car cars sport sports media photo video mail forum wiki docs help support cloud code open green blue red new best top my your we it is at by from all one day time work land park river east west north south free farm win cheap credit bonus track".split())
BUCKETS = 1 << 18
#: Added to each count of each class.
SMOOTH = 0.1


def parts(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a url; both empty for null or without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does. A rule fits its host and all subdomains, and paths that start with its own."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def _costs() -> dict[str, float]:
    ranked = dict.fromkeys([*COMMON, *UNWANTED])
    total = sum(1 / (k + 10) for k in range(len(ranked)))
    return {w: -math.log(1 / (k + 10) / total) for k, w in enumerate(ranked)}


COSTS = _costs()
#: Costs of parts that are no known word: by letter (those under SHORT letters nearly as SHORT), by part, and for splitting a name that leaves such parts.
#: So a listed word of four letters or more wins inside unknown text; three letters (essex, roads) do so beside known words only.
LETTER, SHORT, UNKNOWN, SPLIT = math.log(26), 3, 2.1, 4.4
#: As many learned words go to the tasks at most: those that most hosts use.
VOCABULARY = 100_000
#: A page is about unwanted things if one of so many words of its text is an unwanted one.
DENSE = 100


class Words:
    """A unigram model of names: the listed words, and, with counts, as likely as all of them together, learned ones."""

    def __init__(self, counts: dict[str, int] | None = None):
        self.costs = COSTS
        if counts:
            total, chance = sum(counts.values()), {w: math.exp(-c) for w, c in COSTS.items()}
            self.costs = {w: -math.log((chance.get(w, 0.0) + counts.get(w, 0) / total) / 2) for w in chance | counts}
        self.longest = max(map(len, self.costs))
        self.segmented = lru_cache(1 << 16)(self._segmented)

    def _segmented(self, name: str) -> tuple[str, ...]:
        best, back = [0.0] + [math.inf] * len(name), [0] * (len(name) + 1)
        run, run_at = math.inf, 0  # the best begin of an unknown part of SHORT letters or more that ends here, less its letters' cost so far
        for end in range(1, len(name) + 1):
            begin = end - SHORT
            if begin >= 0 and best[begin] - LETTER * begin < run:
                run, run_at = best[begin] - LETTER * begin, begin
            best[end], back[end] = run + UNKNOWN + LETTER * end, run_at
            for begin in range(max(0, end - self.longest, end - len(name)), end):
                cost = self.costs.get(name[begin:end], math.inf)
                if end - begin < SHORT:
                    cost = min(cost, UNKNOWN + LETTER * SHORT - (SHORT - end + begin) / 2)
                if best[begin] + cost < best[end]:
                    best[end], back[end] = best[begin] + cost, begin
        if UNKNOWN + LETTER * len(name) - SPLIT < best[-1]:
            return (name,)
        words, end = [], len(name)
        while end:
            words.append(name[back[end] : end])
            end = back[end]
        return tuple(reversed(words))


LISTED = Words()


def segmented(name: str, words: Words = LISTED) -> tuple[str, ...]:
    """The most likely words of a name under the unigram model (Viterbi), digits apart; a span that is no known word costs by its letters.

    The time is linear in the name, whatever its length.
    """
    return tuple(w for run in re.findall(r"\d+|\D+", name) for w in (words.segmented(run) if not run.isdigit() else (run,)))


def page_text(pages: DataFrame) -> Column:
    """Lower-cased text of html; tags, comments, scripts and styles are taken out, to the end of the page where they aren't closed.

    An opener is never looked at twice, so the time is linear in the page.
    """
    html = F.col("html").cast("string") if "html" in pages.columns else F.lit("")
    return F.regexp_replace(F.lower(F.coalesce(html, F.lit(""))), r"(?s)<(script|style)\b.*?(?:</\1\s*+>|\z)|<!--.*?(?:-->|\z)|<(?=[a-z/!?])[^>]*+(?:>|\z)|&#?\w++;", " ")


def about_unwanted(text: Column) -> Column:
    """Whether a page's text is about what the unwanted words name: two of them at least, and one word in DENSE is one."""
    hits = F.regexp_extract_all(text, F.lit(rf"(?<![\p{{L}}\p{{N}}])({'|'.join(UNWANTED)})(?![\p{{L}}\p{{N}}])"), 1)
    return (F.size(F.array_distinct(hits)) >= 2) & (F.size(hits) * DENSE >= F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+")))


def said(pages: DataFrame) -> DataFrame:
    """(host, path, about, words) of each row with a host: whether its text is about unwanted things, and the distinct words that its page speaks for.

    Words are whole runs of letters and digits that are three or more of a-z, from the text of html (tags, scripts and styles taken out), paths
    and labels of hosts with hyphens. A host does not speak for its own labels, so that its name on its pages makes it no word.
    """
    host, path = parts(F.col("url"))
    split = pages.select(host.alias("host"), path.alias("path"), page_text(pages).alias("text")).where("host <> ''").withColumn("labels", F.split("host", r"\."))
    hyphens = F.filter("labels", lambda x: x.contains("-"))
    found = F.split(F.concat_ws(" ", "text", F.lower("path"), hyphens), r"[^\p{L}\p{N}]+")
    found = F.array_except(F.array_distinct(F.filter(found, lambda w: w.rlike("^[a-z]{3,63}$"))), "labels")
    return split.select("host", "path", about_unwanted(F.col("text")).cast("int").alias("about"), found.alias("words"))


def vocabulary(told: DataFrame, scratch: Scratch) -> dict[str, int]:
    """On how many hosts each word of told(host, words) stands, for the VOCABULARY most widespread words.

    Of words that tie at the bound all are left out, so the driver and the tasks get no more.
    """
    spread = told.select("host", F.explode("words").alias("word")).distinct().groupBy("word").agg(F.count("*").alias("n"))
    spread = scratch.save(spread, "words")
    room, least = VOCABULARY, None
    for r in sorted(spread.groupBy("n").agg(F.count("*").alias("words")).collect(), reverse=True):  # distinct counts: at most the root of twice their sum
        if r["words"] > room:
            break
        room, least = room - r["words"], r["n"]
    return {} if least is None else {r["word"]: r["n"] for r in spread.where(F.col("n") >= least).collect()}


def host_words(host: str, words: Words = LISTED) -> list[str]:
    """Segmented words of all labels of a host."""
    return [w for name in re.findall(r"[^\W_]+", host) for w in segmented(name, words)]


def features(host: str, path: str, words: Words = LISTED) -> list[str]:
    """Segmented words of the host's labels, marked h:, and path tokens, marked p:; digits as one token."""
    tokens = [f"h:{w}" for w in host_words(host, words)] + [f"p:{t}" for t in re.findall(r"[a-z0-9]+", path.lower())]
    return [t[:2] + "#" if t[2:].isdigit() else t for t in tokens]


def bucket(token: str) -> int:
    h = 2166136261
    for b in token.encode():
        h = ((h ^ b) * 16777619) & 0xFFFFFFFF
    return (h ^ h >> 15) % BUCKETS


def weak_label(tokens: list[str]) -> int:
    """1 if a segmented word of the host is an unwanted one, whatever its pages say."""
    return int(any(t[2:] in UNWANTED for t in tokens if t.startswith("h:")))


def learn(told: DataFrame, counts: Broadcast) -> np.ndarray | None:
    """Log odds by token bucket, and last the prior's: multinomial naive Bayes over the distinct urls of told(host, path, about).

    A url's class is to block if a page of it is about unwanted things (its text, not its url, says so) or if its host's name holds an
    unwanted word. counts holds what vocabulary() found. Token counts are gathered in BUCKETS fixed buckets, so what the driver gets
    has a bound. None for a table without hosts.
    """
    urls = told.groupBy("host", "path").agg(F.max("about").alias("about"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = np.zeros((2, BUCKETS), np.int64)
        docs, words = np.zeros(2, np.int64), Words(counts.value)
        for batch in batches:
            for h, p, about in zip(batch["host"], batch["path"], batch["about"]):
                tokens = features(h, p, words)
                y = max(int(about), weak_label(tokens))
                docs[y] += 1
                for t in tokens:
                    table[y, bucket(t)] += 1
        y, b = np.nonzero(table)
        yield pd.DataFrame({"y": np.concatenate([y, [0, 1]]), "b": np.concatenate([b, [-1, -1]]), "n": np.concatenate([table[y, b], docs])})

    rows = urls.mapInPandas(count, "y int, b int, n long").groupBy("y", "b").agg(F.sum("n").alias("n")).collect()  # 2 * BUCKETS + 2 rows at most
    table, docs = np.zeros((2, BUCKETS)), np.ones(2)
    for r in rows:
        if r["b"] < 0:
            docs[r["y"]] += r["n"]
        else:
            table[r["y"], r["b"]] += r["n"]
    if docs.sum() <= 2:
        return None
    table += np.where(table.sum(0) > 0, SMOOTH, 0)  # only buckets that occur share the smoothing
    total = table.sum(1, keepdims=True)
    odds = np.where(table[0] > 0, np.log(np.maximum(table, SMOOTH) / total)[::-1].T @ [1, -1], 0)
    return np.append(odds, np.log(docs[1] / docs[0]))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, log_odds, host_words for each row of pages(page_id, url, html).

    The longest fitting rule decides; else the classifier: host names are split into words by unigram Viterbi, the words being the
    listed ones and those of all pages, and multinomial naive Bayes over host words and path tokens blocks at log odds above 0. It
    learns from all pages (see learn); what it scores is the url alone.

    Defined cases: null urls and urls without :// have empty host and path, no rule, and are allowed; very long hosts and paths are
    used whole; null page_ids and repeated rows come out as they are; extra columns are ignored, and html may be missing; an empty table gives no rows.
    """
    scratch = Scratch(pages.sparkSession, "urlfilter")
    told = scratch.save(said(pages), "said")  # html is read once
    counts = pages.sparkSession.sparkContext.broadcast(vocabulary(told, scratch))
    odds = learn(told, counts)
    scratch.drop("words", "said")

    @F.pandas_udf("log_odds double, host_words string")
    def scored(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        words = Words(counts.value)

        def one(h: str, p: str) -> float | None:
            return float(odds[-1] + sum(odds[bucket(t)] for t in features(h, p, words))) if odds is not None and h else None

        for host, path in batches:
            of = [one(h, p) for h, p in zip(host, path)]
            yield pd.DataFrame({"log_odds": pd.array(of, "Float64"), "host_words": [" ".join(host_words(h, words)) for h in host]})

    host, path = parts(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    name, verdict = ruled(F.col("host"), F.col("path"), rules)
    out = split.withColumn("rule", name).withColumn("by_rule", verdict).withColumn("s", scored("host", "path"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(F.col("s.log_odds") > 0, "block").otherwise("allow")).alias("verdict"), "s.log_odds", "s.host_words")
