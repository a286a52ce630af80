"""Byte-pair encoding by one pass over the prefixes of each word, and decoding."""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from cairnway.llm.common import Cache, Pieces, column_bytes, own_columns, slices, span_index

#: How the vocabulary's texts are cut into words before merging (fixed by the vocabulary).
WORDS = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
_ENCODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
_DECODED = pa.schema(
    [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())]
)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: itself where it can be printed,
    else the next free one from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Bpe:
    """A vocabulary with merges, read from the text of a tokenizers JSON file."""

    def __init__(self, definition: str):
        spec = json.loads(definition)
        model, letters = spec["model"], byte_letters()
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.letters = {b: c for b, c in enumerate(letters)}
        values = {c: b for b, c in enumerate(letters)}
        self.rank: dict[int, int] = {}  # of the merge of two neighbours
        self.parts: dict[int, tuple[int, int, int]] = {}  # token: rank of its merge, left, right
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            a, b, made = self.ids[left], self.ids[right], self.ids[left + right]
            if made in self.parts:
                raise ValueError("a token that two merges make has no single last token")
            self.rank[a << 32 | b] = rank
            self.parts[made] = (rank, a, b)
        self.size = {i: len(t) for t, i in self.ids.items()}
        self.pairs: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for token, i in self.ids.items():
            if token not in self.special and self._reached(i):
                self.automaton.add_word(token, (i, len(token)))
        self.automaton.make_automaton()
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        top = 1 + max([*self.ids.values(), *self.special.values()])
        held = [b""] * top
        for token, i in self.ids.items():
            held[i] = bytes(values[c] for c in token) if all(c in values for c in token) else token.encode()
        for token, i in self.special.items():
            held[i] = token.encode()
        self.lengths = np.fromiter(map(len, held), np.int64, top)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(held), np.uint8)
        self.words, self.pieces = Cache(250_000), Cache(250_000)

    def _reached(self, token: int) -> bool:
        """Whether merging the token's own bytes ends in the token."""
        if token not in self.whole:
            made = self.parts.get(token)
            self.whole[token] = made is None or (
                self._reached(made[1]) and self._reached(made[2]) and self._apart(made[1], made[2], made[0])
            )
        return self.whole[token]

    def _apart(self, a: int, b: int, before: int) -> bool:
        """No merge across the border between two tokens comes first.

        The two pieces at the border are taken apart again, latest merge first. A merge
        across the border spoils the pair if it ranks below ``before``, the merge that used
        one of the pieces up; on equal rank the merge further left comes first.
        """
        while True:
            across = self.rank.get(a << 32 | b)
            if across is not None and across < before:
                return False
            left, right = self.parts.get(a), self.parts.get(b)
            if left is None and right is None:
                return True
            if right is None or (left is not None and left[0] > right[0]):
                before, a = left[0], left[2]
            else:
                before, b = right[0] + 1, right[1]

    def fits(self, a: int, b: int) -> bool:
        key = a << 32 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > 500_000:
                self.pairs.clear()
            known = self.pairs[key] = self._apart(a, b, 1 << 62)
        return known

    def word(self, text: str) -> bytes:
        """Ids of one word as 32-bit integers.

        The automaton names every token that ends at a place. Of these just one can be the
        last token of the prefix up to there: the one that fits the last token of the prefix
        before it. Following these back from the end gives the ids.
        """
        letters = self.letters
        spelled = "".join([letters[b] for b in text.encode("utf-8", "surrogatepass")])
        n = len(spelled)
        last = [-1] * (n + 1)
        for end, (token, size) in self.automaton.iter(spelled):
            end += 1
            if last[end] < 0:
                before = end - size
                if before == 0 or (last[before] >= 0 and self.fits(last[before], token)):
                    last[end] = token
        ids = []
        while n:
            token = last[n]
            ids.append(token)
            n -= self.size[token]
        return array("I", ids[::-1]).tobytes()

    def _words(self, words: list[str]) -> list[bytes]:
        return [self.word(w) for w in words]

    def _piece(self, piece: str) -> bytes:
        return b"".join(self.words.all(WORDS.findall(piece), self._words))

    def text(self, text: str) -> np.ndarray:
        """Ids of any text; special tokens in it stand for themselves."""
        out: list[bytes] = []
        for k, part in enumerate(self.split_special.split(text) if self.special else [text]):
            if k % 2:
                out.append(array("I", [self.special[part]]).tobytes())
            elif part:
                words = WORDS.findall(part)
                for i in range(0, len(words), 50_000):
                    out += self.words.all(words[i : i + 50_000], self._words)
        return np.frombuffer(b"".join(out), np.uint32)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a string array, and how many there are up to each text's end.

        A single space between other characters always begins a word, so texts are encoded
        piece by piece, each different piece once. Texts with other runs of white space
        across a space, or with special tokens, are encoded as a whole.
        """
        cut = Pieces(column)
        firsts = cut.index[cut.starts]
        kinds, where = np.unique(firsts, return_inverse=True)
        cut.index[cut.starts] = len(cut.unique) + where
        keys = [" " + u for u in cut.unique] + [cut.unique[k] for k in kinds]
        odd = [not u or u[0].isspace() or u[-1].isspace() for u in cut.unique]
        odd += [bool(u) and u[-1].isspace() for u in (cut.unique[k] for k in kinds)]
        bad = np.concatenate([[0], np.cumsum(np.array(odd, bool)[cut.index])])
        slow = bad[cut.ends] > bad[cut.starts]
        for token in self.special:
            slow |= np.array(pc.fill_null(pc.match_substring(column, token), False), bool)
        values = self.pieces.all(keys, lambda new: [self._piece(k) for k in new])
        ids, ends = cut.expand(values)
        if not slow.any():
            return ids, ends
        texts = [
            self.text(column[i].as_py()) if slow[i] else ids[ends[i - 1] if i else 0 : ends[i]]
            for i in range(len(column))
        ]
        return np.concatenate(texts), np.cumsum([len(t) for t in texts])

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """Texts of consecutive ids; bytes that are no UTF-8 become U+FFFD."""
        sizes = self.lengths[ids]
        data = self.data[span_index(self.starts[ids], sizes)].tobytes()
        stops = np.concatenate([[0], np.cumsum(sizes)])[ends]
        begins = np.concatenate([[0], stops[:-1]])
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(begins, stops, strict=True)]


_LOADED: dict[int, Bpe] = {}


def loaded(definition: str) -> Bpe:
    """One vocabulary per worker process; its caches live as long as the worker."""
    key = hash(definition)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Bpe(definition)
    return _LOADED[key]


def encode(docs: DataFrame, definition: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids): ids of every whole text as little-endian unsigned 32-bit integers.

    ``definition`` is the text of a tokenizers JSON file with a byte-level BPE model; it is
    broadcast (the file's size bounds it). Every row is encoded where it is read, without a
    shuffle. Null and empty texts have no ids; repeated rows are encoded each; an empty
    table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(definition)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(shared.value)
        for part in slices(batches):
            text = part.column("text")
            text = pc.fill_null(text, "") if text.null_count else text
            ids, ends = bpe.encode(text)
            counts = np.diff(ends, prepend=0)
            data = ids.astype("<u4")
            at = np.concatenate([[0], ends * 4]).astype(np.int32)
            binary = pa.Array.from_buffers(pa.binary(), len(text), [None, pa.py_buffer(at), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts), binary], schema=_ENCODED)

    own = own_columns(docs, id_col, text_col)
    return own.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, definition: str) -> DataFrame:
    """``encoded`` with the text of its ids in ``decoded``."""
    shared = encoded.sparkSession.sparkContext.broadcast(definition)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(shared.value)
        for part in slices(batches, "ids"):
            data, at = column_bytes(part.column("ids"))
            texts = bpe.decode(np.frombuffer(data, "<u4"), at[1:] // 4)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], schema=_DECODED)

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(
        run, "doc_id long, n_tokens long, ids binary, decoded string"
    )
