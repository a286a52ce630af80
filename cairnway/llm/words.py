"""Words of Latin texts cut by the classes of their bytes, many texts at a time."""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from cairnway.llm.common import column_bytes

#: The pattern that ``cut_words`` follows; a fixed value of the tokenizer file.
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Printing characters and white space below U+0250 with one small letter, below U+02B0.
PLAIN = "^[\\t\\n\\r\\x{20}-\\x{7e}\\x{a0}-\\x{12f}\\x{131}-\\x{239}\\x{23b}-\\x{23d}\\x{23f}-\\x{24f}]*$"
SPACE, LETTER, NUMBER, OTHER = range(4)


def _kind(code: int) -> int:
    letter = chr(code)
    if letter.isspace():
        return SPACE
    return {"L": LETTER, "N": NUMBER}.get(unicodedata.category(letter)[0], OTHER)


_KINDS = np.array([_kind(code) for code in range(0x2B0)], np.uint8)
_BYTES = np.concatenate([_KINDS[:128], np.zeros(128, np.uint8)])
_ONE = np.isin(np.arange(256), list(b"stmd"))


def plain(texts: pa.Array) -> np.ndarray:
    """Which texts hold only the characters above and nothing like a special token."""
    ok = pc.and_not(pc.match_substring_regex(texts, PLAIN), pc.match_substring(texts, "<|"))
    return ok.to_numpy(zero_copy_only=False)


def cut_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(all words of the texts in small letters, the number of words up to each text's end).

    For plain texts without nulls. A word starts where the class of a character differs from
    the one before, at every number, and at every text. An apostrophe that begins a run and one
    of the seven endings after it are one word.
    """
    data, at = column_bytes(pc.utf8_lower(texts))
    n = len(data)
    kinds = _BYTES[data]
    lead = np.flatnonzero(data >= 0xC0)
    kinds[lead] = kinds[lead + 1] = _KINDS[((data[lead] & 0x1F).astype(np.int64) << 6) | (data[lead + 1] & 0x3F)]
    starts = np.ones(n, bool)
    starts[1:] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == NUMBER)
    first = np.zeros(n + 3, bool)
    first[at] = True
    starts |= first[:n]
    starts &= (kinds != SPACE) & ((data & 0xC0) != 0x80)
    mark = np.flatnonzero(starts & (data == 0x27))
    if len(mark):
        ahead = np.concatenate([data, np.zeros(2, np.uint8)])
        a, b = ahead[mark + 1], ahead[mark + 2]
        two = ~first[mark + 1] & ~first[mark + 2] & (((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108))
        ends = np.where(two, mark + 3, mark + 2)[two | (_ONE[a] & ~first[mark + 1])]
        starts[mark[two | (_ONE[a] & ~first[mark + 1])] + 1] = False
        ends = ends[ends < n]
        starts[ends[kinds[ends] == LETTER]] = True
    kept = kinds != SPACE
    before = np.zeros(n + 1, np.int32)
    np.cumsum(kept, out=before[1:], dtype=np.int32)
    begin = np.flatnonzero(starts)
    offsets = np.append(before[begin], before[-1])
    words = pa.StringArray.from_buffers(len(begin), pa.py_buffer(offsets), pa.py_buffer(data[kept]))
    return words, np.searchsorted(begin, at[1:])
