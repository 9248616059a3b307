"""Text cleaning as Column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from html.entities import html5
from zlib import crc32

from pyspark.sql import Column
from pyspark.sql import functions as F

from wordloom.functions import patterns as P

Cleaner = Callable[[Column], Column]

# The entities of `all_entities=False`.  "&amp;" comes last, so that the text it uncovers is not decoded again.
COMMON_ENTITIES = (
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&apos;", "'"),
    ("&#39;", "'"),
    ("&nbsp;", "\u00a0"),
    ("&copy;", "©"),
    ("&middot;", "·"),
    ("&amp;", "&"),
)
# Named references are looked up in so many small maps; a lookup in a map reads it from the start.
_NAME_MAPS = 64
_NAME = r"^[^\t\n\f <&#;]{1,32};?"
_DECIMAL, _HEX = "^#0*([0-9]*);?", "^#[xX]0*([0-9a-fA-F]*);?"
_UNKNOWN = "\ufffd"


def decode_common_entities(c: Column) -> Column:
    """Decode the usual entities with plain replacements."""
    return reduce(lambda acc, e: F.replace(acc, F.lit(e[0]), F.lit(e[1])), COMMON_ENTITIES, c)


def _code_point(n: Column) -> Column:
    """The text of a numeric reference: as in the standard, 128 to 159 stand for a byte of code page 1252."""
    bytes_ = [bytes([k]).decode("cp1252", "ignore") or chr(k) for k in range(0x80, 0xA0)]
    low = lambda shift: F.shiftright(n, shift).bitwiseAND(F.lit(0x3F)) + F.lit(0x80)
    # The bytes of UTF-8 as one number.
    two = (F.shiftright(n, 6) + F.lit(0xC0)) * 0x100 + low(0)
    three = (F.shiftright(n, 12) + F.lit(0xE0)) * 0x10000 + low(6) * 0x100 + low(0)
    four = (F.shiftright(n, 18) + F.lit(0xF0)) * 0x1000000 + low(12) * 0x10000 + low(6) * 0x100 + low(0)
    number = F.when(n < 0x80, n).when(n < 0x800, two).when(n < 0x10000, three).otherwise(four)
    control = n.between(0x1, 0x8) | (n == 0xB) | n.between(0xE, 0x1F) | (n == 0x7F)
    no_character = n.between(0xFDD0, 0xFDEF) | (n.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
    return (
        F.when((n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), _UNKNOWN)
        .when(n.between(0x80, 0x9F), F.get(F.lit(bytes_), (n - 0x80).cast("int")))
        .when(control | no_character, "")
        .otherwise(F.decode(F.unhex(F.hex(number)), "UTF-8"))
    )


def _numeric_reference(p: Column, pattern: str, base: int, longest: int) -> Column:
    digits = F.regexp_extract(p, pattern, 1)
    number = F.conv(digits, base, 10).cast("long")
    text = F.when(digits == "", _UNKNOWN).when(F.length(digits) > longest, _UNKNOWN).otherwise(_code_point(number))
    return F.concat(text, F.substr(p, F.length(F.regexp_extract(p, pattern, 0)) + 1))


def _named_reference(p: Column) -> Column:
    """The longest name counts: all of it up to the semicolon, or else the longest old name without one."""
    maps = [[] for _ in range(_NAME_MAPS)]
    for name, text in html5.items():
        maps[crc32(name.encode()) % _NAME_MAPS].append(f"{name}\x02{text}")
    # Folded to one literal by the optimizer.
    tables = F.array(*(F.str_to_map(F.lit("\x01".join(m)), F.lit("\x01"), F.lit("\x02")) for m in maps))
    old = sorted((name for name in html5 if not name.endswith(";")), key=lambda name: (-len(name), name))
    start = f"^({'|'.join(old)})"
    find = lambda name: F.get(tables, F.pmod(F.crc32(name.cast("binary")), F.lit(_NAME_MAPS)).cast("int"))[name]
    rest = lambda name: F.substr(p, F.length(name) + 1)
    name, short = F.regexp_extract(p, _NAME, 0), F.regexp_extract(p, start, 1)
    whole = F.concat(find(name), rest(name))
    part = F.when(short != "", F.concat(find(short), rest(short)))
    return F.coalesce(whole, part, F.concat(F.lit("&"), p))


def _after_ampersand(p: Column) -> Column:
    """What follows an ampersand, up to the next one, with the reference that it may start with."""
    return (
        F.when(p.rlike("^#[0-9]"), _numeric_reference(p, _DECIMAL, 10, 7))
        .when(p.rlike("^#[xX][0-9a-fA-F]"), _numeric_reference(p, _HEX, 16, 6))
        .otherwise(_named_reference(p))
    )


def unescape_html(c: Column, all_entities: bool = True) -> Column:
    """Decode HTML5 character references, all in the JVM.

    A reference holds no second ampersand, so the text is split at them and each part decoded on its own.
    """
    if not all_entities:
        return decode_common_entities(c)
    parts = F.split(c, "&", -1)
    decoded = F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), _after_ampersand), "")
    return F.when(F.contains(c, F.lit("&")), F.concat(F.get(parts, 0), decoded)).otherwise(c)


def unescape_html_each(sentences: Column) -> Column:
    """C1 on an array of sentences."""
    return F.transform(sentences, lambda s: unescape_html(s))


def remove_html_tags(c: Column) -> Column:
    """A tag becomes a space; the text inside the element stays."""
    return F.regexp_replace(c, P.HTML_TAG, " ")


def remove_urls(c: Column) -> Column:
    """http(s) addresses, then www addresses, then other words with `.com` inside."""
    for pattern in (P.URL_HTTP, P.URL_WWW, P.URL_DOT_COM):
        c = F.regexp_replace(c, pattern, " ")
    return c


def remove_currency(c: Column) -> Column:
    """C4: from a currency or hash sign to the last word character of the run."""
    return F.regexp_replace(c, P.CURRENCY, " ")


def remove_numeric(c: Column) -> Column:
    """Runs of digits, hyphens, slashes and full stops, unless a `%` follows."""
    return F.regexp_replace(c, P.NUMERIC, " $1")


def remove_symbols(c: Column) -> Column:
    """Trade mark signs and `@`."""
    return F.translate(c, P.SYMBOLS, "")


def remove_quotes(c: Column) -> Column:
    """Quotes that touch a word, behind it first and then in front of it."""
    c = F.regexp_replace(c, P.QUOTE_AFTER_WORD, "$1 ")
    return F.regexp_replace(c, P.QUOTE_BEFORE_WORD, " $1")


def split_ampersand(c: Column) -> Column:
    """`salt&` becomes `salt &`; `m&m` stays."""
    return F.regexp_replace(c, P.AMPERSAND_AFTER_WORD, "$1 &$2")


def collapse_whitespace(c: Column) -> Column:
    """A run of white space that ends in a space becomes one space."""
    return F.regexp_replace(c, P.SPACE_RUN, " ")


def remove_bad_words(c: Column) -> Column:
    """Drop words with an underscore and words of punctuation only."""
    keep = lambda w: (F.instr(w, "_") == 0) & ~w.rlike(P.ONLY_PUNCTUATION)
    return F.array_join(F.filter(F.split(c, " ", -1), keep), " ")


# The chain after entity decoding.  The order matters.
CLEANERS: tuple[Cleaner, ...] = (
    remove_html_tags,
    remove_urls,
    remove_currency,
    remove_numeric,
    remove_symbols,
    remove_quotes,
    split_ampersand,
    collapse_whitespace,
    remove_bad_words,
)


def clean_decoded(c: Column, cleaners: Sequence[Cleaner] = CLEANERS) -> Column:
    """The cleaners in order, then lower case.  Pure JVM, usable in a lambda."""
    return F.lower(reduce(lambda acc, f: f(acc), cleaners, c))


def clean_text(
    c: Column, cleaners: Sequence[Cleaner] = CLEANERS, all_entities: bool = True
) -> Column:
    """C12 for one text column."""
    return clean_decoded(unescape_html(c, all_entities), cleaners)


def clean_sentences(sentences: Column, cleaners: Sequence[Cleaner] = CLEANERS) -> Column:
    """F3 + C12 for an array of sentences: empty ones are dropped before cleaning."""
    filled = F.filter(sentences, lambda s: s.isNotNull() & (s != ""))
    return F.transform(unescape_html_each(filled), lambda s: clean_decoded(s, cleaners))
