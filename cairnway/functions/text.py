"""Name folding and tokens as built-in column functions."""

from __future__ import annotations

import functools
import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairnway import lexicon as lx


@functools.lru_cache(maxsize=None)
def _marked_letters() -> tuple[str, str]:
    """Letters whose compatibility decomposition is one plain letter, and that letter.

    Built from the character database: Latin blocks with marks and the full-width forms.
    """
    marked, plain = [], []
    spans = [(0x00AA, 0x0250), (0x1E00, 0x1F00), (0xFF01, 0xFF5F)]
    for code in (c for low, high in spans for c in range(low, high)):
        base = "".join(
            ch for ch in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(ch)
        ).lower()
        if len(base) == 1 and base.isascii() and base.isalnum():
            marked.append(chr(code))
            plain.append(base)
    return "".join(marked), "".join(plain)


# Letters that spread to other letters and have no decomposition. Fixed values.
_SPREAD = {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "ł": "l", "đ": "d", "þ": "th", "ð": "d"}


@functools.lru_cache(maxsize=None)
def _fold_sql() -> str:
    marked, plain = _marked_letters()
    out = f"translate(lower({{}}), '{marked}', '{plain}')"
    for letter, replacement in _SPREAD.items():
        out = f"replace({out}, '{letter}', '{replacement}')"
    return rf"regexp_replace({out}, r'\p{{{{M}}}}+', '')"


def _key_sql() -> str:
    folded = _fold_sql().replace("{}", "coalesce({}, '')", 1)
    return rf"trim(regexp_replace(replace({folded}, '&', ' and '), r'[^\p{{{{L}}}}\p{{{{N}}}}_]+', ' '))"


def fold_sql(value: str) -> str:
    """SQL for lower case Latin text without marks; spacing is kept."""
    return _fold_sql().format(value)


def key_sql(value: str) -> str:
    """SQL for the comparison form of a name: folded, ``&`` spelled out, words one space apart.

    Latin letters lose their marks; other scripts stay in their own script. Plain ASCII, by far
    the most common case, takes a shorter way to the same result. It is kept as text so that
    one call builds the whole expression.
    """
    plain = rf"trim(regexp_replace(replace(lower({value}), '&', ' and '), r'[^a-z0-9_]+', ' '))"
    return (
        rf"CASE WHEN {value} IS NULL OR {value} = '' THEN '' "
        rf"WHEN {value} RLIKE r'[^\x00-\x7F]' THEN {_key_sql().format(value)} ELSE {plain} END"
    )


def squeeze(value: str) -> Column:
    return F.expr(squeeze_sql(value))


def squeeze_sql(value: str) -> str:
    return rf"trim(regexp_replace({fold_sql(value)}, r'\s+', ' '))"


def name_key(column: str) -> Column:
    return F.expr(key_sql(column))


def quoted(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def listed(values: list[str]) -> Column:
    return F.expr(f"array({quoted(values)})")


def among(column: str, values: list[str]) -> Column:
    return F.expr(f"{column} IN ({quoted(values)})")


def tokens(key: Column, min_length: int = 2) -> Column:
    """Distinct words of a comparison key, at least ``min_length`` letters long."""
    return F.array_distinct(F.filter(F.split(key, " "), lambda t: F.length(t) >= min_length))


def significant(token_array: Column) -> Column:
    return F.array_except(
        token_array, listed(lx.GENERIC_TRAIL_WORDS + lx.SEARCH_STOPWORDS)
    )


def phonetic_key(key: Column) -> Column:
    out = F.replace(key, F.lit(" "), F.lit(""))
    out = F.regexp_replace(out, r"([a-z])\1+", "$1")
    for sound, letter in (("ee", "i"), ("ie", "i"), ("aa", "a"), ("oo", "u"), ("ch", "c")):
        out = F.replace(out, F.lit(sound), F.lit(letter))
    return out


def ascii_words(column: str) -> Column:
    return F.regexp_extract_all(squeeze(column), F.lit(r"([a-z0-9]+)"), F.lit(1))


def search_variants(column: str) -> Column:
    """Up to four spellings to search for, most specific first."""
    all_words = ascii_words(column)
    dropped = listed(lx.GENERIC_TRAIL_WORDS + lx.SEARCH_STOPWORDS)
    strong = F.filter(all_words, lambda w: ~F.array_contains(dropped, w) & (F.length(w) >= 3))
    some = F.size(strong) >= 1
    options = F.array(
        F.array_join(all_words, " "),
        F.when(some, F.array_join(strong, " ")),
        F.when(some, F.get(strong, F.lit(0))),
        F.when(F.size(strong) >= 2, F.array_join(F.slice(strong, 1, 2), " ")),
    )
    return F.array_distinct(F.filter(F.array_compact(options), lambda v: F.length(v) > 0))


def names_a_place(tokens_column: str) -> Column:
    """Does the token set hold a word that identifies a place?

    Decided in order: a destination word says yes, a facility word says no, an explicit route
    word next to a real word says yes, a road-like word says no, else any word that is neither
    generic nor one letter longer than a generic word it holds.
    """
    bare_facility = [w for w in lx.FACILITY_WORDS if w not in set(lx.GENERIC_WAY_NAMES)]
    generic = sorted(set(lx.FACILITY_WORDS) | set(lx.GENERIC_WAY_NAMES))
    known = f"t IN ({quoted(generic)})"
    road = f"t RLIKE '^({'|'.join(lx.ROAD_WORD_PREFIXES)})'"
    near = []
    for length in sorted({len(w) for w in generic}):
        group = "|".join(w for w in generic if len(w) == length)
        near.append(f"(length(t) = {length + 1} AND t RLIKE '^({group})|({group})$')")
    a = tokens_column
    return F.expr(
        f"""CASE WHEN arrays_overlap({a}, array({quoted(lx.DESTINATION_NAME_WORDS)})) THEN true
        WHEN arrays_overlap({a}, array({quoted(bare_facility)})) THEN false
        WHEN arrays_overlap({a}, array({quoted(lx.EXPLICIT_ROUTE_WORDS)}))
          AND exists({a}, t -> length(t) >= 4 AND NOT {known} AND NOT {road}) THEN true
        WHEN exists({a}, t -> {road}) THEN false
        ELSE exists({a}, t -> length(t) >= 3 AND NOT {known} AND NOT ({' OR '.join(near)})) END"""
    )


_NUMBER = re.compile(r"%(?:\.(\d)f|[ds])")


def filled(pattern: str, *values: Column) -> Column:
    """``pattern`` with its values in place; decimals are rounded as printf rounds them.

    ``format_string`` rounds the shortest digits of a double half up (12.25 gives 12.3, 0.15 gives 0.2);
    ``format_number`` with a pattern rounds the double itself, half to even (12.2, 0.1).
    """
    if not values:
        return F.lit(pattern)
    shown = [
        v if digits == "" else F.call_function("format_number", v, F.lit("0." + "0" * int(digits) if int(digits) else "0"))
        for v, digits in zip(values, _NUMBER.findall(pattern), strict=True)
    ]
    return F.format_string(re.sub(r"%\.\df", "%s", pattern), *shown)
