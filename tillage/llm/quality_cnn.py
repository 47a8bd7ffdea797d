"""Operator 4: document quality by a byte-level convolutional network in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a chunk and what neighbours share; bytes under a filter, its step; channels of a byte, the last of which says "repeats".
CHUNK, SHARED, WIDTH, STEP, CHANNELS, LAGS = 512, 32, 16, 4, 8, 32
POSITIONS = (CHUNK - WIDTH) // STEP + 1
#: Chunks that are multiplied at once.
TILE = 64
#: Whole numbers up to this are exact in single precision; weights are rounded to 2 ** -FINEST or coarser.
EXACT, FINEST = 1 << 24, 12
SCORES = "doc_id string, held_out boolean, score double, predicted int"


@dataclass
class Net:
    embed: np.ndarray  # 256 x 7: learned channels of a byte
    filters: np.ndarray  # WIDTH * CHANNELS x F
    bias: np.ndarray  # F
    dense: np.ndarray  # 2 F: of the maxima over all chunks and of the mean of each chunk's maxima
    base: np.ndarray  # 1


def chunked(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping chunks that cover every byte of every text, padded with 0, and each text's first chunk, with the end."""
    rows, at = [], [0]
    for t in texts:
        b = np.frombuffer((t or "").encode("utf-8", "surrogatepass"), np.uint8)
        n = max(1, -(-(len(b) - SHARED) // (CHUNK - SHARED)))
        padded = np.zeros(n * (CHUNK - SHARED) + SHARED, np.uint8)
        padded[: len(b)] = b
        rows.append(np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[:: CHUNK - SHARED])
        at.append(at[-1] + n)
    return np.concatenate(rows), np.array(at)


def repeats(chunks: np.ndarray) -> np.ndarray:
    """1 where four bytes occur again at most LAGS bytes before, in the same chunk."""
    wide = chunks.astype(np.uint32)
    grams = wide[:, :-3] | wide[:, 1:-2] << 8 | wide[:, 2:-1] << 16 | wide[:, 3:] << 24
    hit = np.zeros(grams.shape, bool)
    for lag in range(3, LAGS + 1):
        hit[:, lag:] |= grams[:, lag:] == grams[:, :-lag]
    out = np.zeros(chunks.shape, np.float32)
    out[:, 3:] = hit & (grams != 0)
    return out


def windows(net: Net, chunks: np.ndarray) -> np.ndarray:
    """What stands under the filters: chunks x POSITIONS x WIDTH * CHANNELS."""
    x = np.empty((*chunks.shape, CHANNELS), np.float32)
    x[..., :-1] = net.embed[chunks]
    x[..., -1] = repeats(chunks)
    s = x.strides
    return np.lib.stride_tricks.as_strided(x, (len(x), POSITIONS, WIDTH * CHANNELS), (s[0], STEP * s[1], s[2]))


def pooled(net: Net, chunks: np.ndarray, keep: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Each chunk's maxima of all filters, and where they stand."""
    tops, where = [], []
    for lo in range(0, len(chunks), TILE):
        w = windows(net, chunks[lo : lo + TILE])
        y = (w.reshape(-1, WIDTH * CHANNELS) @ net.filters).reshape(len(w), POSITIONS, -1)
        tops.append(y.max(1))
        if keep:
            where.append(y.argmax(1))
    return np.maximum(np.concatenate(tops) + net.bias, 0), np.concatenate(where) if keep else None


def combined(tops: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Each text's maxima over all its chunks, and the means of its chunks' maxima."""
    return np.concatenate([np.maximum.reduceat(tops, at[:-1]), np.add.reduceat(tops, at[:-1]) / np.diff(at)[:, None]], 1)


def logits(net: Net, feat: np.ndarray) -> np.ndarray:
    """The last layer, added up row by row in double precision, so that it is the same in any batch."""
    return (feat.astype(np.float64) * net.dense.astype(np.float64)).sum(1) + float(net.base[0])


def scores(net: Net, texts: list[str | None]) -> np.ndarray:
    """One probability of label 1 for each whole text."""
    out = []
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and size < 1 << 20:
            size += len(texts[hi] or "") + 1
            hi += 1
        chunks, at = chunked(texts[lo:hi])
        z = logits(net, combined(pooled(net, chunks)[0], at))
        out.append(1 / (1 + np.exp(-np.clip(z, -40, 40))))
        lo = hi
    return np.concatenate(out) if out else np.empty(0)


def gradient(net: Net, texts: list[str], labels: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean weighted log loss, by each parameter.

    Only a chunk's strongest window of each filter gets a gradient, so going back costs little beside going forth.
    """
    f = len(net.bias)
    chunks, at = chunked(texts)
    tops, where = pooled(net, chunks, keep=True)
    doc = np.repeat(np.arange(len(texts)), np.diff(at))
    feat = combined(tops, at)
    p = 1 / (1 + np.exp(-np.clip(logits(net, feat), -30, 30)))
    dz = ((p - labels) * weight / len(texts)).astype(np.float32)
    grad = {"dense": feat.T @ dz, "base": dz.sum(keepdims=True)}
    dfeat = dz[:, None] * net.dense
    dtops = dfeat[doc, f:] / np.diff(at)[doc][:, None]
    dtops += np.where(tops == feat[doc, :f], dfeat[doc, :f], 0)
    dtops *= tops > 0
    grad["bias"] = dtops.sum(0)
    gfilters, gembed = np.zeros_like(net.filters), np.zeros_like(net.embed)
    w = windows(net, chunks)
    rows = np.arange(len(chunks))
    for j in range(f):
        live = rows[dtops[:, j] != 0]
        if not len(live):
            continue
        d = dtops[live, j]
        gfilters[:, j] = d @ w[live, where[live, j]]
        under = chunks[live[:, None], where[live, j][:, None] * STEP + np.arange(WIDTH)]
        back = d[:, None, None] * net.filters[:, j].reshape(WIDTH, CHANNELS)[None, :, :-1]
        np.add.at(gembed, under.ravel(), back.reshape(-1, CHANNELS - 1))
    return grad | {"filters": gfilters, "embed": gembed}


def new_net(filters: int, rng: np.random.Generator) -> Net:
    draw = lambda *shape: rng.standard_normal(shape)
    return Net((draw(256, CHANNELS - 1) * 0.5).astype(np.float32), (draw(WIDTH * CHANNELS, filters) / 8).astype(np.float32), np.zeros(filters, np.float32), np.zeros(2 * filters, np.float32), np.zeros(1, np.float32))


def train(texts: list[str], labels: np.ndarray, prior: float, filters: int = 32, steps: int = 240, batch: int = 32, rate: float = 0.004, seed: int = 5) -> Net:
    """Adam on the log loss for about so many steps, three rounds at least, classes weighted evenly; in the end the base moves by the log odds of prior, label 1's share of all labels."""
    rng = np.random.default_rng(seed)
    net = new_net(filters, rng)
    weight = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum())) * len(labels)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in vars(net).items()}
    step, epochs = 0, max(3, -(-steps * batch // len(texts)))
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for lo in range(0, len(texts), batch):
            part = order[lo : lo + batch]
            step += 1
            lr = rate * (1 - epoch / epochs)
            for k, g in gradient(net, [texts[i] for i in part], labels[part], weight[part]).items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                setattr(net, k, getattr(net, k) - (lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)).astype(np.float32))
    net.base = net.base + np.float32(np.log(prior / (1 - prior)))
    return rounded(net)


def rounded(net: Net) -> Net:
    """The net with weights so coarse that no sum under a filter is rounded in single precision.

    Such sums are the same in any order, so a text's score depends neither on its batch nor on how a machine multiplies matrices. Embedding
    and filters become multiples of 2 ** -bits, with as many bits as leave the largest possible sum, in units of 4 ** -bits, within EXACT.
    """
    for bits in range(FINEST, -1, -1):
        embed, filters = (np.round(x * np.float32(2**bits)) / np.float32(2**bits) for x in (net.embed, net.filters))
        widest = np.tile(np.append(np.abs(embed).max(0), 1).astype(np.float64), WIDTH)  # of what can stand under each place of a filter
        if (widest @ np.abs(filters)).max() * 4**bits <= EXACT:
            break
    return replace(net, embed=embed, filters=filters)


def held_out() -> F.Column:
    """crc32 of doc_id as text, modulo 3, is 1; a null doc_id is not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 2400, sample_bytes: int = 10_000_000, longest: int = 32_768, **train_args) -> Net | None:
    """Trains on a bounded sample of labelled rows that aren't held out; None if a class is missing.

    sample_rows: at most half of it of each class, by hash of doc_id; sample_bytes: characters in all; longest: characters of a text,
    longer ones are not trained on (all texts are scored whole). The label shares come from all labelled rows.
    """
    usable = labels.where("doc_id is not null and quality in (0, 1)").where(~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most")
    counts = {r["quality"]: r["count"] for r in usable.groupBy("quality").count().collect()}
    if len(counts) < 2:
        return None
    picked = [usable.where(F.col("quality") == q).select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows // 2) for q in (0, 1)]
    chosen = F.broadcast(picked[0].union(picked[1]))  # sample_rows rows at most
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.length("text") <= longest).join(chosen, "doc_id").orderBy(F.xxhash64("doc_id", "text")).limit(2 * sample_rows)
    total, texts, marks = 0, [], []
    for r in rows.toLocalIterator():
        total += len(r["text"])
        if total > sample_bytes:
            break
        texts.append(r["text"])
        marks.append(r["quality"])
    if len(set(marks)) < 2:
        return None
    return train(texts, np.array(marks, np.float32), counts[1] / (counts[0] + counts[1]), **train_args)


def quality_scores(docs: DataFrame, labels: DataFrame, net: Net | None = None, **fit_args) -> DataFrame:
    """doc_id, held_out, score (probability that labels.quality is 1) and predicted (score >= 0.5) for each row of documents.

    The score depends on the text alone. Defined cases: null and empty texts score as an empty text; a null doc_id is scored and
    not held out; doc_ids labelled both ways are not trained on; labels without both classes: every score is 0.5; repeated rows
    come out once each; extra columns are ignored; an empty table gives no rows.
    """
    net = net or fit(docs, labels, **fit_args)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            s = scores(net, part["text"].tolist()) if net is not None else np.full(len(part), 0.5)
            yield pd.DataFrame({"doc_id": part["doc_id"], "held_out": part["held_out"], "score": s, "predicted": (s >= 0.5).astype(np.int32)})

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", held_out().alias("held_out")).mapInPandas(run, SCORES).withColumn("doc_id", F.col("doc_id").cast("long"))


def accept(docs: DataFrame, labels: DataFrame, **fit_args) -> DataFrame:
    """The documents that the classifier predicts to be of quality 1, with all their columns."""
    net = fit(docs, labels, **fit_args)
    if net is None:
        return docs

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(scores(net, text.tolist()))

    return docs.where(score("text") >= 0.5)
