"""Operator 6: secret scans, planned by a trigram inverted index."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as _c
from re import _parser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


ROWS = "doc_id string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its pattern, letters in either case or not, and the least length of a group of its match (0: all of it)."""

    kind: str
    pattern: str
    either_case: bool = False
    group: int = 0
    least: int = 1


#: The base rules, as their contract lists them.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", False, 0, 16),
    Rule("hex", r"[0-9a-f]+", False, 0, 32),
)
#: Rules beside them; their spans are added. Where a run of letters begins a match, it begins at the run's begin, so that no run is read twice.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("bearer", r"bearer\x20+([A-Za-z0-9+/_.=-]+)", True, 1, 16),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", False, 0, 24),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", False, 0, 16),
    Rule("url_login", r"(?<![a-z])[a-z]+://[^\s/:@]+:[^\s/@]+@"),
)

#: A Boolean query: None (all documents), or a set of alternatives, each a set of trigrams that must all occur, lower-cased.
Query = frozenset[frozenset[str]] | None


#: A way through a regex: runs of known text, lower-cased, with unknown text between them.
Way = tuple[str, ...]
GAP: Way = ("", "")


def _ways(tree, most: int = 64) -> list[Way]:
    """All ways through a parsed regex; where there would be more than `most`, a gap stands for them."""
    ways: list[Way] = [("",)]
    for op, arg in tree:
        if op is _c.LITERAL:
            more = [(chr(arg).lower(),)]
        elif op is _c.IN and all(o is _c.LITERAL for o, _ in arg):
            more = [(chr(a).lower(),) for _, a in arg]
        elif op is _c.SUBPATTERN:
            more = _ways(arg[3], most)
        elif op is _c.BRANCH:
            more = [w for branch in arg[1] for w in _ways(branch, most)]
        elif op in (_c.MAX_REPEAT, _c.MIN_REPEAT):
            lo, hi, body = arg
            inner = _ways(body, most)
            more = [("",), *inner] if (lo, hi) == (0, 1) else [_then(w, GAP) for w in inner] if lo else [GAP]
        elif op in (_c.AT, _c.ASSERT_NOT):  # no text of their own
            continue
        else:
            more = [GAP]
        if len(ways) * len(more) > most:
            more = [GAP]
        ways = [_then(a, b) for a in ways for b in dict.fromkeys(more)]
    return ways


def _then(a: Way, b: Way) -> Way:
    return (*a[:-1], a[-1] + b[0], *b[1:])


def trigram_query(pattern: str) -> Query:
    """What trigrams any match must hold: an alternative for each way through the regex; None if some way has none.

    Trigrams are of lower-cased text, so they hold for either case.
    """
    ends = {frozenset(run[i : i + 3] for run in way for i in range(len(run) - 2)) for way in _ways(_parser.parse(pattern, re.ASCII))}
    if not all(ends):
        return None
    return frozenset(a for a in ends if not any(b < a for b in ends))


class Segment:
    """The inverted index of some texts, MOST at most: postings of every trigram of ASCII characters in their lower-cased forms.

    One sorted array of trigram << BITS | text; a trigram's postings are a stretch of it. Rules may come later, without another pass
    over the texts.
    """

    BITS, PIECE = 11, 1 << 22
    MOST = 1 << BITS

    def __init__(self, texts: list[str]):
        self.n = len(texts)
        found, part, size = [np.empty(0, np.uint32)], [], 0
        for i, text in enumerate(texts):
            low = text.lower().encode("utf-8", "replace")  # other letters may become ASCII ones: more candidates, none fewer
            for lo in range(0, len(low), self.PIECE):
                part.append((i, low[lo : lo + self.PIECE + 2]))
                size += len(part[-1][1])
                if size >= self.PIECE:
                    found.append(self._entries(part))
                    part, size = [], 0
        found.append(self._entries(part))
        self.entries = np.unique(np.concatenate(found))

    def _entries(self, part: list[tuple[int, bytes]]) -> np.ndarray:
        if not part:
            return np.empty(0, np.uint32)
        data = np.frombuffer(b"\xff".join(p for _, p in part) + b"\xff", np.uint8)
        owner = np.repeat(np.array([i for i, _ in part], np.uint32), [len(p) + 1 for _, p in part])[:-2]
        wide = data.astype(np.uint32)
        codes = (wide[:-2] << 14 | wide[1:-1] << 7 | wide[2:]) << self.BITS | owner
        return np.unique(codes[(data[:-2] | data[1:-1] | data[2:]) < 128])

    def postings(self, gram: str) -> np.ndarray:
        """The texts that hold a trigram, in order."""
        if not gram.isascii():
            return np.arange(self.n)  # not indexed
        a, b, c = gram.encode()
        code = (a << 14 | b << 7 | c) << self.BITS
        lo, hi = np.searchsorted(self.entries, np.uint32(code)), np.searchsorted(self.entries, np.uint32(code + self.MOST - 1), "right")
        return (self.entries[lo:hi] & np.uint32(self.MOST - 1)).astype(np.int64)

    def candidates(self, query: Query) -> list[int]:
        """The texts that meet a Boolean query: for some alternative, they hold all its trigrams."""
        if query is None:
            return list(range(self.n))
        found = np.zeros(self.n, bool)
        for grams in query:
            met = None
            for p in sorted((self.postings(g) for g in grams), key=len):
                met = p if met is None else np.intersect1d(met, p, assume_unique=True)
            found[met] = True
        return np.flatnonzero(found).tolist()


def _finder(rule: Rule) -> re.Pattern:
    # a run is as long as it can be, so a shorter match is dropped in the search itself where the pattern is one run
    pattern = f"[0-9a-f]{{{rule.least},}}" if rule.pattern == "[0-9a-f]+" else rule.pattern
    return re.compile(pattern, re.ASCII | (re.IGNORECASE if rule.either_case else 0))


def find_secrets(texts: list[str], rules: tuple[Rule, ...]) -> list[list[tuple[int, int, int]]]:
    """For each text the spans (start, end, index of rule) of all rules, leftmost and non-overlapping per rule, failing lengths dropped."""
    queries = [trigram_query(r.pattern) for r in rules]
    segment = Segment(texts)
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for k, (rule, query) in enumerate(zip(rules, queries)):
        search = _finder(rule)
        for i in segment.candidates(query):
            found[i] += [(m.start(), m.end(), k) for m in search.finditer(texts[i]) if m.end(rule.group) - m.start(rule.group) >= rule.least]
    return [sorted(f, key=lambda s: (s[0], s[2])) for f in found]


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, segment_rows: int = 512) -> DataFrame:
    """Secrets of each row of documents(doc_id, text): n_assign, n_access, n_hex, base_sha256, spans.

    Texts are indexed in segments of so many rows (Segment.MOST at most), without a shuffle: the postings of the trigrams that the
    rules' Boolean queries name are intersected, and the regex verifies each candidate's whole text; rules without mandatory trigrams scan all texts.
    A span is kind:start:end in code points, end exclusive, of the whole match; spans stand by start, then kind as listed,
    joined by commas; base_sha256 is over the base kinds' spans.

    Defined cases: null text: as empty; no secrets: empty spans, zero counts; null or repeated doc_ids and repeated rows come out
    as they are; extra columns are ignored; an empty table gives no rows.
    """
    if not 0 < segment_rows <= Segment.MOST:
        raise ValueError(f"segment_rows must be 1 to {Segment.MOST}")
    kinds, base = [r.kind for r in rules], {r.kind for r in BASE}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        join = lambda spans: ",".join(f"{kinds[k]}:{a}:{b}" for a, b, k in spans)
        for batch in batches:
            for lo in range(0, len(batch), segment_rows):
                part = batch.iloc[lo : lo + segment_rows]
                found = find_secrets([t or "" for t in part["text"].tolist()], rules)
                own = [[s for s in f if kinds[s[2]] in base] for f in found]
                out = {"doc_id": part["doc_id"]}
                out |= {f"n_{kind}": [sum(kinds[s[2]] == kind for s in f) for f in own] for kind in ("assign", "access", "hex")}
                yield pd.DataFrame(out | {"base_sha256": [hashlib.sha256(join(f).encode()).hexdigest() for f in own], "spans": [join(f) for f in found]})

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, ROWS).withColumn("doc_id", F.col("doc_id").cast("long"))
