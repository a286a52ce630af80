"""Language of a text by a convolutional network over its bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnway.llm.common import column_bytes, own_columns, slices

#: Bytes of a window, of an embedding, and (filter width, number of filters).
WINDOW, DEPTH = 256, 6
FILTERS = ((2, 12), (3, 12), (4, 12))
#: Windows that go through the network together.
TOGETHER = 1024
_SEEN = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


def held_out(id_col: str) -> Column:
    """Rows that nothing is learned from: CRC-32 of the id as text leaves 1 modulo 3."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def windows(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(windows, text of each): all bytes of every text in windows of one length.

    The last window ends with the text, a text shorter than a window is filled up with 0.
    """
    sizes = np.diff(at)
    count = np.maximum(1, -(-sizes // WINDOW))
    owner = np.repeat(np.arange(len(sizes)), count)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    start = np.minimum(step * WINDOW, np.maximum(sizes[owner] - WINDOW, 0)) + at[owner]
    padded = np.concatenate([data, np.zeros(WINDOW, np.uint8)])
    cut = padded[start[:, None] + np.arange(WINDOW)]
    short = np.flatnonzero(sizes < WINDOW)
    if len(short):
        rows = np.flatnonzero(sizes[owner] < WINDOW)
        cut[rows] = np.where(np.arange(WINDOW) < sizes[owner[rows]][:, None], cut[rows], 0)
    return cut, owner


@dataclass
class Network:
    """Embedding, filters of several widths, their maximum over the window, softmax."""

    classes: list[str]
    weights: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, classes: list[str], seed: int) -> Network:
        rng = np.random.default_rng(seed)
        total = sum(n for _, n in FILTERS)
        weights = {"embed": rng.normal(0, 0.5, (256, DEPTH)), "out": rng.normal(0, 0.1, (total, len(classes))), "bias": np.zeros(len(classes))}
        for width, n in FILTERS:
            weights[f"filter{width}"] = rng.normal(0, (2 / (width * DEPTH)) ** 0.5, (width * DEPTH, n))
            weights[f"shift{width}"] = np.zeros(n)
        return cls(classes, {k: v.astype(np.float32) for k, v in weights.items()})

    def pooled(self, cut: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The filters' maxima over each window, and where they are."""
        w, maxima, places = self.weights, [], []
        inside = w["embed"][cut]
        for width, _ in FILTERS:
            count = WINDOW - width + 1
            stacked = np.concatenate([inside[:, k : k + count] for k in range(width)], axis=2)
            out = stacked.reshape(-1, width * DEPTH) @ w[f"filter{width}"]
            out = out.reshape(len(cut), count, -1)
            places.append(out.argmax(1) if self.learning else None)
            maxima.append(out.max(1) + w[f"shift{width}"])
        return np.maximum(np.concatenate(maxima, 1), 0), places

    learning = False

    def log_probabilities(self, cut: np.ndarray) -> np.ndarray:
        parts = []
        for i in range(0, len(cut), TOGETHER):
            scores = self.pooled(cut[i : i + TOGETHER])[0] @ self.weights["out"] + self.weights["bias"]
            scores -= scores.max(1, keepdims=True)
            parts.append(scores - np.log(np.exp(scores).sum(1, keepdims=True)))
        return np.concatenate(parts) if parts else np.zeros((0, len(self.classes)))

    def gradients(self, cut: np.ndarray, wanted: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        hidden, places = self.pooled(cut)
        scores = hidden @ w["out"] + w["bias"]
        chance = np.exp(scores - scores.max(1, keepdims=True))
        chance /= chance.sum(1, keepdims=True)
        chance[np.arange(len(cut)), wanted] -= 1
        chance /= len(cut)
        back = (chance @ w["out"].T) * (hidden > 0)
        out = {"out": hidden.T @ chance, "bias": chance.sum(0), "embed": np.zeros_like(w["embed"])}
        begin = 0
        for (width, n), place in zip(FILTERS, places, strict=True):
            own = back[:, begin : begin + n]
            begin += n
            # Only the place of the maximum passes the error on.
            bytes_there = cut[np.arange(len(cut))[:, None, None], place[:, :, None] + np.arange(width)]
            there = w["embed"][bytes_there].reshape(len(cut), n, width * DEPTH)
            out[f"filter{width}"] = np.einsum("bn,bnd->dn", own, there)
            out[f"shift{width}"] = own.sum(0)
            into = np.einsum("bn,dn->bnd", own, w[f"filter{width}"]).reshape(-1, DEPTH)
            np.add.at(out["embed"], bytes_there.reshape(-1), into)
        return out


def train(texts: list[bytes], langs: list[str], each: int = 3, rounds: int = 8, seed: int = 3) -> Network | None:
    """Fit by Adam on at most ``each`` windows of every text; None without texts."""
    if not texts:
        return None
    classes = sorted(set(langs))
    net = Network.fresh(classes, seed)
    net.learning = True
    rng = np.random.default_rng(seed)
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    cut, owner = windows(np.frombuffer(b"".join(texts), np.uint8), at)
    shuffled = rng.permutation(len(cut))
    order = shuffled[np.argsort(owner[shuffled], kind="stable")]
    place = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
    cut, owner = cut[order[place < each]], owner[order[place < each]]
    wanted = np.array([classes.index(x) for x in langs])[owner]
    # Rare languages are drawn as often as frequent ones.
    chance = 1 / np.bincount(wanted, minlength=len(classes))[wanted]
    chance /= chance.sum()
    first = {k: np.zeros_like(v) for k, v in net.weights.items()}
    second = {k: np.zeros_like(v) for k, v in net.weights.items()}
    steps = max(1, rounds * len(cut) // 64)
    for t in range(1, steps + 1):
        pick = rng.choice(len(cut), 64, p=chance)
        rate = 0.01 * (1 - t / (steps + 1))
        for k, g in net.gradients(cut[pick], wanted[pick]).items():
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.01 * (g * g - second[k])
            net.weights[k] -= (rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    net.learning = False
    return net


def sample(docs: DataFrame, most: int, languages: int) -> tuple[list[bytes], list[str]]:
    """At most ``most`` labelled texts of each of the ``languages`` most frequent languages.

    They are those with the least hashes of the id, found on ids alone; ``most * languages``
    bounds what is broadcast and what reaches the driver.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    common = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(languages)
    ids = labelled.select("doc_id", "lang").distinct().join(F.broadcast(common.select("lang")), "lang")
    least = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = ids.withColumn("k", F.row_number().over(least)).where(F.col("k") <= most).drop("k")
    rows = (
        docs.where(F.col("text").isNotNull())
        .join(F.broadcast(chosen), ["doc_id", "lang"])
        .groupBy("doc_id", "lang")
        .agg(F.min("text").alias("text"))
        .orderBy("lang", "doc_id")
        .collect()
    )
    return [r["text"].encode() for r in rows], [r["lang"] for r in rows]


def predict(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every whole text.

    All bytes of a text pass the network in windows of one length; the windows' mean log
    probabilities decide. ``und`` with score 0 if a text is null, has no letter or nothing was
    learned. Repeated rows are predicted each, a null id is kept, an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, most=1 << 19):
            text = part.column("text")
            data, at = column_bytes(text)
            names, scores = ["und"] * len(text), np.zeros(len(text))
            if net is not None:
                cut, owner = windows(data, at)
                sums = np.zeros((len(text), len(net.classes)))
                np.add.at(sums, owner, net.log_probabilities(cut))
                sums /= np.bincount(owner, minlength=len(text))[:, None]
                chance = np.exp(sums - sums.max(1, keepdims=True, initial=-np.inf))
                chance /= chance.sum(1, keepdims=True)
                best = chance.argmax(1)
                for i, value in enumerate(text):
                    if any(map(str.isalpha, value.as_py() or "")):
                        names[i], scores[i] = net.classes[best[i]], min(1.0, float(chance[i, best[i]]))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("held_out"), pa.array(names), pa.array(scores)], schema=_SEEN
            )

    own = own_columns(docs, id_col, text_col)
    return own.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id").alias("held_out"), "text").mapInArrow(
        run, "doc_id long, held_out boolean, lang_pred string, score double"
    )


def identify(
    docs: DataFrame, most: int = 600, languages: int = 100, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """Learn from the rows that are not held out and predict all rows."""
    known = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).alias("lang"))
    return predict(docs, train(*sample(known, most, languages)), id_col, text_col)
