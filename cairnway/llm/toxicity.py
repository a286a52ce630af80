"""Toxicity by a learned lexicon, its misspellings and the words around a match."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cairnway.llm.common import WORD, Cache, Pieces, mix, slices
from cairnway.llm.language import held_out
from cairnway.llm.ngram_join import shingles
from cairnway.session import cut

#: Words on each side of a match that may show it as quoted.
CONTEXT = 6
QUOTES = re.compile("[\"“”„«»‘‹›]")
#: Fixed words that report what others say.
REPORTING = frozenset(
    "said says wrote writes called quote quoted reported word term insult slur dit appelé mot insulte "
    "sagte nannte wort beleidigung dijo llamó palabra insulto".split()
)
FEATURES = 6
#: Parts of the sample; matches of each are found with the lexicon of the others.
FOLDS = 4


def allowed(term: str, stem: bool) -> int:
    """Edits at which a word still matches: none in short terms, more in longer ones."""
    if stem:
        return 1 if len(term) >= 7 else 0
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Matcher:
    """Levenshtein automata of all terms at once, over the trie of the terms.

    A state is the set of (trie node, edits so far) that the letters read can stand for: on
    each letter a node's child goes on as it is, another child costs a substitution, staying
    an insertion, and skipping to a child a deletion. The root is left by a term's first
    letter only; ``Finder`` adds the edits before it. States are made when first met; the
    empty state ends the search, as it does for most words after a few letters.

    ``costs`` gives for each term the edits already spent on it and those it still allows.
    """

    def __init__(self, terms: list[tuple[str, bool, float]], costs: list[tuple[int, int]] | None = None):
        self.children: list[dict[str, int]] = [{}]
        self.full: dict[int, dict[tuple[int, int], float]] = {}
        self.stem: dict[int, dict[tuple[int, int], float]] = {}
        self.reach = [0]
        for (term, stem, weight), (spent, edits) in zip(terms, costs or [(0, allowed(t[0], t[1])) for t in terms], strict=True):
            node = 0
            self.reach[0] = max(self.reach[0], edits)
            for letter in term:
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.reach.append(0)
                node = self.children[node][letter]
                self.reach[node] = max(self.reach[node], edits)
            ends = (self.stem if stem else self.full).setdefault(node, {})
            ends[spent, edits] = max(weight, ends.get((spent, edits), weight))
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[frozenset, int] = {}
        self.states: list[dict[int, int]] = []
        self.moves: list[dict[str, int]] = []
        self.ends: list[tuple] = []
        self.begin = self._state({0: 0})

    def _state(self, nodes: dict[int, int]) -> int:
        todo = list(nodes.items())
        while todo:  # skipped letters of the term
            node, edits = todo.pop()
            if node and nodes[node] == edits:
                for child in self.children[node].values():
                    if edits + 1 <= self.reach[child] and nodes.get(child, 99) > edits + 1:
                        nodes[child] = edits + 1
                        todo.append((child, edits + 1))
        key = frozenset(nodes.items())
        if key not in self.numbers:
            self.numbers[key] = len(self.states)
            self.states.append(nodes)
            self.moves.append({})
            self.ends.append(tuple(self._best(ends, nodes) for ends in (self.full, self.stem)))
        return self.numbers[key]

    @staticmethod
    def _best(ends: dict, nodes: dict[int, int]):
        found = [
            (edits + spent, -weight)
            for n, edits in nodes.items() if n in ends
            for (spent, most), weight in ends[n].items() if edits <= most
        ]
        return min(found) if found else None

    def _move(self, state: int, letter: str) -> int:
        after: dict[int, int] = {}

        def put(node: int, edits: int) -> None:
            if edits <= self.reach[node] and after.get(node, 99) > edits:
                after[node] = edits

        for node, edits in self.states[state].items():
            if not node:
                if letter in self.children[0]:
                    put(self.children[0][letter], edits)
                continue
            put(node, edits + 1)
            for own, child in self.children[node].items():
                put(child, edits + (own != letter))
        self.moves[state][letter] = made = self._state(after) if after else -1
        return made

    def find(self, word: str) -> tuple[int, float] | None:
        """(edits, weight) of the nearest term, of equal ones the weightiest."""
        if len(self.states) > 50_000:
            self.clear()
        state, best = self.begin, None
        for letter in word:
            moves = self.moves[state]
            state = moves[letter] if letter in moves else self._move(state, letter)
            if state < 0:
                break
            stem = self.ends[state][1]
            if stem is not None and (best is None or stem < best):
                best = stem
        else:
            full = self.ends[state][0]
            if full is not None and (best is None or full < best):
                best = full
        return None if best is None else (best[0], -best[1])


class Finder:
    """The nearest term by the whole edit distance, edits at the first letter included.

    Take the first letter that word and term share in a cheapest alignment, after i letters of
    the term and j of the word: what stands before it costs max(i, j) edits, and the rest is an
    alignment that keeps its first letter. So for each j there is a ``Matcher`` that reads the
    word without j letters, over the terms without i letters, with the edits that are left.
    """

    def __init__(self, terms: list[tuple[str, bool, float]]):
        self.matchers = []
        for j in range(1 + max((allowed(term, stem) for term, stem, _ in terms), default=0)):
            parts = [
                ((term[i:], stem, weight), (max(i, j), allowed(term, stem) - max(i, j)))
                for term, stem, weight in terms
                for i in range(allowed(term, stem) + 1) if j <= allowed(term, stem)
            ]
            self.matchers.append(Matcher([p[0] for p in parts], [p[1] for p in parts]))

    def find(self, word: str) -> tuple[int, float] | None:
        """(edits, weight) of the nearest term, of equal ones the weightiest."""
        best = None
        for j, matcher in enumerate(self.matchers):
            if best is not None and best[0] < j:
                break
            hit = matcher.find(word[j:])
            if hit is not None and (best is None or (hit[0], -hit[1]) < (best[0], -best[1])):
                best = hit
        return best


@dataclass
class Lexicon:
    terms: list[tuple[str, bool, float]]
    cache: Cache | None = field(default=None, repr=False)
    matcher: Finder | None = field(default=None, repr=False)

    def __getstate__(self):
        return {"terms": self.terms, "cache": None, "matcher": None}

    def pieces(self, pieces: list[str]) -> np.ndarray:
        """For each piece: weight of its exact and of its misspelled match, quote marks, reporting words."""
        if self.cache is None:
            self.cache, self.matcher = Cache(300_000), Finder(self.terms)
        return np.array(self.cache.all(pieces, self._looked_up), np.float32).reshape(-1, 4)

    def _looked_up(self, pieces: list[str]) -> list[tuple]:
        out = []
        for piece in pieces:
            exact = fuzzy = reports = 0.0
            for word in WORD.findall(piece.lower()):
                hit = self.matcher.find(word)
                if hit is not None:
                    if hit[0] == 0:
                        exact = max(exact, hit[1])
                    else:
                        fuzzy = max(fuzzy, hit[1])
                elif word in REPORTING:
                    reports = 1.0
            out.append((exact, fuzzy, float(len(QUOTES.findall(piece))), reports))
        return out

    def features(self, column: pa.Array) -> np.ndarray:
        """(texts, FEATURES): greatest and summed weight of exact and of misspelled matches in
        the text's own voice, summed weight of quoted ones, number of matches.

        A match is quoted as far as the words on both of its sides hold quote marks and its
        surroundings a reporting word."""
        cut_up = Pieces(column, all_white=True)
        seen = self.pieces(cut_up.unique)[cut_up.index]
        out = np.zeros((len(column), FEATURES))
        hits = np.flatnonzero((seen[:, 0] > 0) | (seen[:, 1] > 0))
        if not len(hits):
            return out
        owner = np.searchsorted(cut_up.ends, hits, "right")
        low = np.maximum(cut_up.starts[owner], hits - CONTEXT)
        high = np.minimum(cut_up.ends[owner], hits + CONTEXT + 1)
        sums = np.concatenate([np.zeros((1, 2)), np.cumsum(seen[:, 2:], axis=0, dtype=np.float64)])
        own = seen[hits, 2] > 0
        before = (sums[hits, 0] - sums[low, 0] > 0) | own
        after = (sums[high, 0] - sums[hits + 1, 0] > 0) | own
        reports = sums[high, 1] - sums[low, 1] > 0
        quoted = np.minimum(1.0, 0.6 * (before & after) + 0.4 * reports)
        for column_of, (first, second) in enumerate(((0, 1), (2, 3))):
            weight = seen[hits, column_of] * (1 - quoted)
            np.maximum.at(out[:, first], owner, weight)
            np.add.at(out[:, second], owner, weight)
        np.add.at(out[:, 4], owner, seen[hits, :2].max(1) * quoted)
        np.add.at(out[:, 5], owner, 1)
        return out


def shaped(features: np.ndarray) -> np.ndarray:
    """What the logistic model sees: sums grow slowly, and the number of matches stays out."""
    out = features[:, :5].copy()
    out[:, [1, 3, 4]] = np.log1p(out[:, [1, 3, 4]])
    return np.column_stack([out, np.ones(len(out))])


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(shaped(features) @ self.weights, -30, 30)))


def fit_evidence(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A logistic model in which no match can speak for a text: features that would are left out."""
    w, used = np.zeros(x.shape[1]), np.arange(x.shape[1])
    while True:
        own = fit_logistic(x[:, used], y)
        worst = int(np.argmin(own[:-1])) if len(used) > 1 else -1
        if worst < 0 or own[worst] >= 0:
            w[used] = own
            return w
        used = np.delete(used, worst)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton steps on the penalised likelihood."""
    w = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], ridge)
    keep[-1] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + keep * w
        bend = (x * (p * (1 - p))[:, None]).T @ x + np.diag(keep)
        move = np.linalg.solve(bend, slope)
        w -= move
        if np.abs(move).max() < 1e-6:
            break
    return w


def word_counts(sampled: DataFrame) -> DataFrame:
    """(fold, word, t, c): in how many toxic and clean texts of each fold a word stands."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[\\p{L}\\p{N}]+"), F.lit(0)))
    return (
        sampled.select("fold", "toxic", F.explode(words).alias("word"))
        .groupBy("fold", "word")
        .agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    )


def choose_terms(counts: DataFrame, texts: tuple[int, int], most: int) -> list[tuple[str, bool, float]]:
    """Words and word beginnings that mark toxic texts, at most ``most`` of each.

    The weight is the log odds of a toxic text. A word is taken when its likelihood ratio
    against chance is above what the most striking of all those words would reach by chance.
    A beginning must lead to four words that are more often toxic. It never takes the place of a
    word, nor of a longer beginning that allows more edits.
    """
    toxic, clean = max(texts[0], 1), max(texts[1], 1)
    share = toxic / (toxic + clean)
    bound = math.log(10 * max(1, counts.count()))

    def scored(df: DataFrame) -> DataFrame:
        n = F.col("t") + F.col("c")
        part = [F.when(F.col(k) > 0, F.col(k) * F.log(F.col(k) / (n * s))).otherwise(0.0) for k, s in (("t", share), ("c", 1 - share))]
        odds = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("c") + 0.5) / (clean + 1))
        return df.withColumns({"weight": odds, "sure": part[0] + part[1]}).where((F.col("sure") > bound) & (F.col("weight") > 1))

    words = scored(counts).orderBy(F.desc("sure"), "word").limit(most)
    sizes = F.explode(F.sequence(F.lit(4), F.least(F.length("word") - 1, F.lit(9))))
    begun = (
        counts.where("length(word) > 4")
        .select("word", "t", "c", sizes.alias("size"))
        .groupBy(F.substring("word", F.lit(1), F.col("size")).alias("word"))
        .agg(F.sum("t").alias("t"), F.sum("c").alias("c"), F.sum(F.when(F.col("t") > F.col("c"), 1).otherwise(0)).alias("kinds"))
        .where("kinds >= 4")
    )
    stems = scored(begun).where("weight > 2").orderBy(F.desc("sure"), "word").limit(most)
    out = [(r["word"], False, float(min(r["weight"], 6.0))) for r in words.collect()]
    held: dict[str, float] = {}
    for r in sorted(stems.collect(), key=lambda r: len(r["word"])):
        weight, edits = float(min(r["weight"], 6.0)), allowed(r["word"], True)
        before = (r["word"][:k] for k in range(4, len(r["word"])))
        known = max((held.get(b, 0.0) for b in before if allowed(b, True) >= edits), default=0.0)
        if weight > known + 0.5:
            held[r["word"]] = weight
            out.append((r["word"], True, weight))
    return out


#: Fixed values that make four orders of the same hashes.
_ORDERS = np.array([0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89], np.uint64)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The least five-word hash of each text in each of four orders, 0 without words.

    Texts agree in all four about as often as the fourth power of their similarity says, so
    copies and near copies do, and texts that share a phrase do not.
    """
    for part in slices(batches):
        _, grams, n = shingles(part.column("text"), 5)
        some = n > 0
        begin = (np.cumsum(n) - n)[some]
        least = np.zeros((len(_ORDERS), len(n)), np.uint64)
        if len(begin):
            for k, order in enumerate(_ORDERS):
                least[k, some] = np.minimum.reduceat(mix(grams ^ order), begin)
        yield pa.RecordBatch.from_arrays(
            [*(part.column(c) for c in ("doc_id", "toxic", "text")), *map(pa.array, least.view(np.int64))],
            names=["doc_id", "toxic", "text", *(f"s{k}" for k in range(len(_ORDERS)))],
        )


def _bounded(ids: DataFrame, sizes: dict[int, int], most: int) -> DataFrame:
    """The ``most`` ids of each label with the least hashes.

    Where there are many more, a share of the hashes is cut off first, wide enough to hold them,
    so that what is sorted is bounded by ``most`` too.
    """
    h = F.xxhash64("doc_id")
    limit = F.lit((1 << 63) - 1)
    for label, n in sizes.items():
        if n > 2 * most:
            limit = F.when(F.col("toxic") == label, F.lit(int(2 * most / n * (1 << 64)) - (1 << 63))).otherwise(limit)
    least = Window.partitionBy("toxic").orderBy(h, "doc_id")
    return ids.where(h <= limit).withColumn("k", F.row_number().over(least)).where(F.col("k") <= most).drop("k")


def _log_odds(toxic: float, clean: float) -> float:
    return math.log(toxic + 0.5) - math.log(clean + 0.5)


def learn(docs: DataFrame, labels: DataFrame, most: int = 12_000, terms: int = 1500) -> Model:
    """Fit on at most ``most`` labelled texts of each label and ``terms`` words and beginnings.

    A document with several labels counts by the highest. The sample, those with the least
    hashes of the id, is split in ``FOLDS``: matches of each fold are found with the lexicon of
    the others, so the logistic model sees words as new texts will show them, with a lexicon
    nearly as full as the final one, which comes from all. Bounds are parameters; all else is
    counted in Spark.

    The share of toxic texts is that of all labelled ids, before copies are put together, and a
    text without a match scores 0.5 at most. With one label only, or no term, all texts are such.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(
        F.when(F.max("toxic") >= 1, 1).otherwise(0).alias("toxic")
    ).where(~held_out("doc_id"))
    present = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    share = {r["toxic"]: r["n"] for r in present.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    prior = _log_odds(share.get(1, 0), share.get(0, 0)) if share else -4.0
    if len(share) < 2:
        return Model(Lexicon([]), np.append(np.zeros(5), min(prior, 0.0)))
    ids = _bounded(present, share, most)
    texts = docs.join(F.broadcast(ids), "doc_id").groupBy(F.col("doc_id").cast("long").alias("doc_id"), "toxic").agg(
        F.coalesce(F.min("text"), F.lit("")).alias("text")
    )
    # Of copies and near copies of one label, one text is learned from.
    marks = [f"s{k}" for k in range(len(_ORDERS))]
    sampled = cut(
        texts.mapInArrow(_signatures, "doc_id long, toxic int, text string, " + ", ".join(f"{m} long" for m in marks))
        .groupBy("toxic", *marks)
        .agg(F.min_by("text", "doc_id").alias("text"))
        .select("toxic", "text", F.pmod("s0", F.lit(FOLDS)).cast("int").alias("fold"))
    )
    sizes = {(r["fold"], r["toxic"]): r["n"] for r in sampled.groupBy("fold", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = cut(word_counts(sampled))

    def lexicon(left_out: int) -> Lexicon:
        parts = counts.where(F.col("fold") != left_out).groupBy("word").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
        held = tuple(sum(n for (fold, toxic), n in sizes.items() if fold != left_out and toxic == label) for label in (1, 0))
        return Lexicon(choose_terms(parts, held, terms))

    others = [lexicon(fold) for fold in range(FOLDS)]
    final = lexicon(-1)

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            folds = part.column("fold").to_numpy()
            found = np.zeros((len(folds), FEATURES))
            for fold in np.unique(folds):
                rows = np.flatnonzero(folds == fold)
                found[rows] = others[fold].features(part.column("text").take(pa.array(rows)))
            yield pa.RecordBatch.from_arrays(
                [part.column("toxic"), *[pa.array(found[:, k]) for k in range(FEATURES)]],
                names=["toxic", *[f"f{k}" for k in range(FEATURES)]],
            )

    schema = "toxic int, " + ", ".join(f"f{k} double" for k in range(FEATURES))
    rows = np.array([tuple(r) for r in sampled.select("toxic", "fold", "text").mapInArrow(seen, schema).collect()], float)
    weights = fit_evidence(shaped(rows[:, 1:]), rows[:, 0])
    # The sample's share of toxic texts gives way to that of all labelled ids.
    weights[-1] = min(weights[-1] + prior - _log_odds(rows[:, 0].sum(), (1 - rows[:, 0]).sum()), 0.0)
    return Model(final, weights)


def score(
    docs: DataFrame, model: Model, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", carry: bool = False
) -> DataFrame:
    """(doc_id, held_out, score, predicted, hits, quoted) of every whole text.

    With ``carry`` the whole row comes along as the struct ``row``, whatever its columns are.

    Null and empty texts have no matches and get the score of such texts, which stays below every
    threshold above 0.5. Repeated rows are scored each, a null id is kept, an empty table gives no
    rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = model.lexicon.features(part.column("text"))
            value = model.score(found)
            columns = [
                part.column("doc_id"), part.column("held_out"), pa.array(value),
                pa.array((value >= threshold).astype(np.int32)), pa.array(found[:, 5].astype(np.int64)), pa.array(found[:, 4]),
            ]
            if carry:
                columns.append(part.column("row"))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    text = F.col(text_col).cast("string").alias("text")
    own = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), text,
        *([F.struct("*").alias("row")] if carry else []),
    )
    schema = StructType.fromDDL("doc_id long, held_out boolean, score double, predicted int, hits long, quoted double")
    if carry:
        schema.add("row", own.schema["row"].dataType)
    names = schema.names
    return own.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, carry: bool = False) -> DataFrame:
    """Learn from ``labels`` (doc_id, toxic) of rows not held out and score all rows."""
    known = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return score(docs, learn(known, labels.select("doc_id", "toxic")), threshold, carry=carry)
