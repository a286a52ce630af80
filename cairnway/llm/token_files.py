"""Token ids in files of independent zstandard frames with a seek table at the end."""

from __future__ import annotations

import json
import os
import re
import struct
from array import array
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnway.llm.common import Cache, PieceIds, Pieces, own_columns, slices, span_index
from cairnway.llm.words import PATTERN, cut_words, plain
from cairnway.session import cut

#: Of the seekable zstandard format: magic numbers and the mark of a table with checksums.
SEEK_FRAME, SEEK_END, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
#: The skippable frame that holds which document stands where.
INDEX_FRAME = 0x184D2A5D
#: Bytes of text that are encoded at a time: much of it, so that most pieces come again.
ENCODE_BYTES = 8 << 20
#: A frame holds whole documents of about so many ids, or one longer document.
FRAME_IDS = 32_768
_MANIFEST = pa.schema([("part", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("n_ids", pa.int64())])
_READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])


class Writer:
    """Writes one file: frames, the index of documents, the seek table."""

    def __init__(self, out, wide: bool):
        self.out, self.kind = out, "<u4" if wide else "<u2"
        self.pack = zstandard.ZstdCompressor(level=3)
        self.table: list[tuple[int, int, int]] = []
        self.ids: list[int | None] = []
        self.sizes: list[int] = []
        self.held: list[np.ndarray] = []
        self.count = self.total = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if self.count and self.count + len(ids) > FRAME_IDS:
            self.flush()
        self.ids.append(doc_id)
        self.sizes.append(len(ids))
        self.held.append(ids.astype(self.kind))
        self.count += len(ids)
        self.total += len(ids)

    def flush(self) -> None:
        if self.count:
            raw = b"".join(x.tobytes() for x in self.held)
            done = self.pack.compress(raw)
            self.out.write(done)
            self.table.append((len(done), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.held, self.count = [], 0

    def close(self) -> None:
        self.flush()
        known = np.array([i is not None for i in self.ids], np.uint8)
        ids = np.array([i or 0 for i in self.ids], "<i8")
        body = struct.pack("<BQ", np.dtype(self.kind).itemsize, len(ids))
        body += known.tobytes() + ids.tobytes() + np.array(self.sizes, "<u4").tobytes()
        body = self.pack.compress(body)
        self.out.write(struct.pack("<II", INDEX_FRAME, len(body)) + body)
        self.table.append((len(body) + 8, 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF))
        entries = b"".join(struct.pack("<III", *x) for x in self.table)
        end = struct.pack("<IBI", len(self.table), CHECKSUMS, SEEK_END)
        self.out.write(struct.pack("<II", SEEK_FRAME, len(entries) + len(end)) + entries + end)


class Reader:
    """Opens one file; only frames of asked documents are read and decompressed."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        count, marks, magic = struct.unpack("<IBI", source.read_at(9, size - 9))
        if magic != SEEK_END or not marks & CHECKSUMS:
            raise ValueError("no seek table with checksums")
        table = source.read_at(12 * count, size - 9 - 12 * count)
        self.table = np.frombuffer(table, "<u4").reshape(count, 3).astype(np.int64)
        self.at = np.cumsum(self.table[:, 0]) - self.table[:, 0]
        magic, length = struct.unpack("<II", source.read_at(8, int(self.at[-1])))
        if magic != INDEX_FRAME:
            raise ValueError("no index of documents")
        body = zstandard.ZstdDecompressor().decompress(source.read_at(length, int(self.at[-1]) + 8))
        width, n = struct.unpack("<BQ", body[:9])
        self.kind = f"<u{width}"
        known = np.frombuffer(body, np.uint8, n, 9)
        ids = np.frombuffer(body, "<i8", n, 9 + n)
        self.doc_ids = [int(i) if k else None for i, k in zip(ids, known, strict=True)]
        self.sizes = np.frombuffer(body, "<u4", n, 9 + 9 * n).astype(np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        ends = np.cumsum(self.table[:-1, 1]) // width
        self.frame_of = np.searchsorted(ends, self.starts, "right")
        self.frame_start = ends - self.table[:-1, 1] // width

    def frame(self, k: int) -> np.ndarray:
        packed, size, check = self.table[k]
        raw = zstandard.ZstdDecompressor().decompress(self.source.read_at(int(packed), int(self.at[k])), int(size))
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} does not match its checksum")
        return np.frombuffer(raw, self.kind)

    def documents(self, wanted: set | None = None) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, ids before it in the file, ids) of all or of the asked documents."""
        now, frame = -1, np.zeros(0, self.kind)
        for i, doc_id in enumerate(self.doc_ids):
            if wanted is not None and doc_id not in wanted:
                continue
            start, size = int(self.starts[i]), int(self.sizes[i])
            if size and (k := int(self.frame_of[i])) != now:
                now, frame = k, self.frame(k)
            begin = start - int(self.frame_start[now]) if size else 0
            yield doc_id, start, frame[begin : begin + size]


class Encoder:
    """Ids of string arrays by the tokenizers library.

    With ``pieces``, for tokenizers that drop white space and never look across it, the
    different pieces between single spaces are encoded once each. Where the tokenizer lowers
    letters and keeps what its pattern finds, a piece of Latin letters is first cut by that
    pattern, so that the library meets each different word once. Where that pattern is the one
    ``words`` knows, whole Latin texts are cut at once.
    """

    def __init__(self, definition: str, pieces: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.wide = self.tokenizer.get_vocab_size(with_added_tokens=True) > 65_536
        self.pieces, self.cache, self.words = pieces, PieceIds(500_000), Cache(500_000)
        self.known = PieceIds(2_000_000)
        spec = json.loads(definition) if pieces else {}
        self.pattern = self._word_pattern(spec) if pieces else None
        self.closing = self._closing(spec["model"], self.tokenizer.get_vocab_size(with_added_tokens=True)) if self.pattern else None

    @staticmethod
    def _word_pattern(spec: dict):
        def parts(x, name):
            return (x or {}).get(name) or ([x] if x else [])

        lowers = any(n["type"] == "Lowercase" for n in parts(spec["normalizer"], "normalizers"))
        for step in parts(spec["pre_tokenizer"], "pretokenizers"):
            if lowers and step["type"] == "Split" and step["behavior"] == "Removed" and step["invert"]:
                return regex.compile(step["pattern"]["Regex"])
        return None

    @staticmethod
    def _closing(model: dict, size: int) -> np.ndarray | None:
        """Which ids end a word, where the model marks them."""
        suffix = model.get("end_of_word_suffix")
        if not suffix:
            return None
        ids = [i for token, i in model["vocab"].items() if token.endswith(suffix)]
        closing = np.zeros(max([size, *ids]) + 1, bool)
        closing[ids] = True
        return closing

    def library(self, texts: list[str]) -> list[bytes]:
        out = []
        for i in range(0, len(texts), 10_000):
            done = self.tokenizer.encode_batch_fast(texts[i : i + 10_000], add_special_tokens=False)
            out += [array("I", e.ids).tobytes() for e in done]
        return out

    def by_words(self, pieces: list[str]) -> list[bytes]:
        """Letters below U+0250 other than U+0130 have one lower case and stay as they are
        under normalisation; a piece with others, or with a special token, goes as it is.

        The pattern never looks across white space, so that it cuts all pieces in one call, with
        a mark between them that no piece holds."""
        plain = [(p.isascii() and p.isprintable() or bool(_LATIN.fullmatch(p))) and "<|" not in p for p in pieces]
        cut_up = self.pattern.findall(f" {_MARK} ".join(compress(pieces, plain)).lower())
        ids = self.words.all(cut_up, self._distinct)
        ends = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))
        inner = ends[[i for i, w in enumerate(cut_up) if w == _MARK]].tolist()
        pool = b"".join(ids)
        done = iter([pool[i:j] for i, j in zip([0, *inner], [*inner, len(pool)], strict=True)])
        if all(plain):
            return list(done)
        rest = iter(self.library([p for p, ok in zip(pieces, plain, strict=True) if not ok]))
        return [next(done if ok else rest) for ok in plain]

    def _distinct(self, words: list[str]) -> list[bytes]:
        known = dict.fromkeys(words)
        known.pop(_MARK, None)
        several = list(known)
        known = dict(zip(several, self._in_rows(several), strict=True))
        known[_MARK] = b""
        return [known[w] for w in words]

    def _in_rows(self, words: list[str]) -> list[bytes]:
        """Ids of words that the pattern leaves whole, many to a row; an id that closes a word
        parts them. A row where a word has no such id is encoded word by word."""
        if self.closing is None:
            return self.library(words)
        out = []
        rows = [words[i : i + 1000] for i in range(0, len(words), 1000)]
        for i in range(0, len(rows), 16):
            some = rows[i : i + 16]
            done = self.tokenizer.encode_batch_fast([" ".join(r) for r in some], add_special_tokens=False)
            for row, found in zip(some, done, strict=True):
                ids = np.array(found.ids, np.uint32)
                ends = (np.flatnonzero(self.closing[ids]) + 1) * 4
                if len(ends) != len(row) or ends[-1] != ids.nbytes:
                    out += self.library(row)
                    continue
                pool, ends = ids.tobytes(), ends.tolist()
                out += [pool[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        return out

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other, and their number up to each text's end."""
        if self.closing is None or self.pattern.pattern != PATTERN:
            return self.encode_pieces(column)
        column = pc.fill_null(column, "").cast(pa.string()) if column.null_count else column.cast(pa.string())
        ok = plain(column)
        words, ends = cut_words(column.filter(pa.array(ok)))
        held = words.dictionary_encode()
        first, size = self.known.find(held.dictionary, self._in_rows)
        index = held.indices.to_numpy(zero_copy_only=False)
        each = size[index]
        pool, ends = self.known.pool[span_index(first[index], each)], np.concatenate([[0], np.cumsum(each)])[ends]
        if ok.all():
            return pool, ends
        others, other_ends = self.encode_pieces(column.filter(pa.array(~ok)))
        begin, length = np.zeros(len(ok), np.int64), np.zeros(len(ok), np.int64)
        for rows, shift, stops in ((ok, 0, ends), (~ok, len(pool), other_ends)):
            length[rows] = np.diff(stops, prepend=0)
            begin[rows] = shift + stops - length[rows]
        return np.concatenate([pool, others])[span_index(begin, length)], np.cumsum(length)

    def encode_pieces(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.pieces:
            cut_up = Pieces(column)
            first, size = self.cache.find(cut_up.dictionary, self.by_words if self.pattern else self.library)
            return cut_up.spans(self.cache.pool, first, size)
        ids = self.library(pc.fill_null(column, "").to_pylist())
        return np.frombuffer(b"".join(ids), np.uint32), np.cumsum([len(x) // 4 for x in ids])


#: Between pieces; not among the characters below.
_MARK = "\0"
#: Printing characters and white space below U+0250.
_LATIN = re.compile("[\\t\\n\\r\x20-\x7e\xa0-\u012f\u0131-\u024f]*")
_LOADED: dict[tuple, Encoder] = {}


def loaded(definition: str, pieces: bool) -> Encoder:
    key = (hash(definition), pieces)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Encoder(definition, pieces)
    return _LOADED[key]


def write_token_files(
    docs: DataFrame,
    definition: str,
    folder: str,
    end_id: int | None = None,
    pieces: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Write the ids of every whole text in ascending doc_id order; (part, path, docs, n_ids, before).

    Range partitions by id become one file each, ``before`` is the number of ids in the files
    ahead of it. ``folder`` is a place that driver and executors share; pyarrow opens it. A
    file gets its name by one rename when it is whole, so a task that is run again only
    replaces it by the same content. ``definition`` (text of a tokenizers JSON file) is
    broadcast. ``end_id`` is appended to each document.

    A null id comes first, rows that repeat an id stand next to each other in the order of
    their texts, null and empty texts have no ids but the end id, an empty table no files.
    """
    shared = docs.sparkSession.sparkContext.broadcast(definition)
    tail = np.array([] if end_id is None else [end_id], np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, encoder = TaskContext.get(), loaded(shared.value, pieces)
        place, root = fs.FileSystem.from_uri(folder)
        final = f"{root}/part-{context.partitionId():06d}.zst"
        draft = f"{final}.{context.taskAttemptId()}.draft"
        writer = out = None
        for part in slices(batches, most=ENCODE_BYTES):
            if writer is None:
                place.create_dir(root, recursive=True)
                out = place.open_output_stream(draft)
                writer = Writer(out, encoder.wide)
            ids, ends = encoder.encode(part.column("text"))
            begin = 0
            for doc_id, end in zip(part.column("doc_id").to_pylist(), ends, strict=True):
                writer.add(doc_id, np.concatenate([ids[begin:end], tail]))
                begin = end
        if writer is not None:
            writer.close()
            out.close()
            place.move(draft, final)
            scheme = folder.partition("://")[0] + "://" if "://" in folder else ""
            yield pa.RecordBatch.from_arrays(
                [pa.array([context.partitionId()], pa.int32()), pa.array([scheme + final]),
                 pa.array([len(writer.ids)]), pa.array([writer.total])],
                schema=_MANIFEST,
            )

    own = own_columns(docs, id_col, text_col).selectExpr("cast(doc_id as long) doc_id", "text")
    ordered = own.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), "text"
    )
    written = cut(ordered.mapInArrow(run, "part int, path string, docs long, n_ids long"))
    # One row per file: the only place where the files are looked at together.
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return written.withColumn("before", F.coalesce(F.sum("n_ids").over(ahead), F.lit(0)))


def read_token_files(manifest: DataFrame, wanted: set | None = None) -> DataFrame:
    """(doc_id, start, ids) of all or of the asked documents from the files of a manifest.

    ``start`` counts the ids of all documents ahead, ``ids`` are little-endian unsigned 32-bit
    integers. Each file is read by one task, frame by frame; a frame that does not match its
    checksum fails the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before in zip(*(batch.column(c).to_pylist() for c in ("path", "before")), strict=True):
                place, name = fs.FileSystem.from_uri(path)
                with place.open_input_file(name) as source:
                    held, weight = [], 0
                    for doc_id, start, ids in Reader(source).documents(wanted):
                        held.append((doc_id, before + start, ids.astype("<u4").tobytes()))
                        weight += 4 * len(ids) + 64
                        if weight > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), _READ.types, strict=True)], schema=_READ)
                            held, weight = [], 0
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), _READ.types, strict=True)], schema=_READ)

    files = manifest.select("path", "before")
    return files.repartition(max(1, files.count()), "path").mapInArrow(run, "doc_id long, start long, ids binary")
