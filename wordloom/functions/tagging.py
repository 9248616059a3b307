"""Part-of-speech tags (M2): a lexicon of closed classes and suffix rules as Column
expressions, or any tagger of the user that works on the words of one sentence."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.functions.sql import case, lit, one_of

# Closed word classes by Penn tag.
LEXICON: dict[str, Sequence[str]] = {
    "DT": "a an the this these those each every some any no another all both either neither".split(),
    "IN": "of in on at by for from with without into onto over under above below between among "
    "through during before after until against about across behind beside beyond near off out "
    "up down per than as if because while although though unless since whether that".split(),
    "TO": ["to"],
    "CC": "and or but nor yet plus &".split(),
    "MD": "can could may might must shall should will would".split(),
    "PRP": "i you he she it we they me him her us them myself yourself himself herself itself "
    "ourselves themselves".split(),
    "PRP$": "my your his its our their".split(),
    "WDT": ["which", "whatever"],
    "WP": ["who", "whom", "what"],
    "WRB": ["when", "where", "why", "how"],
    "EX": ["there"],
    "VBZ": ["is", "has", "does"],
    "VBP": ["are", "am", "have", "do"],
    "VBD": ["was", "were", "had", "did"],
    "VB": ["be"],
    "VBN": ["been"],
    "RB": "not very too so then now here again only just also almost well often".split(),
}
# Tags of word endings; the first that fits counts.
SUFFIXES: tuple[tuple[str, str], ...] = (
    ("ing", "VBG"), ("ed", "VBD"), ("ly", "RB"), ("est", "JJS"),
    ("ous", "JJ"), ("ful", "JJ"), ("ive", "JJ"), ("able", "JJ"), ("ible", "JJ"), ("al", "JJ"),
    ("ic", "JJ"), ("less", "JJ"), ("ish", "JJ"), ("ary", "JJ"),
    ("ss", "NN"), ("us", "NN"), ("is", "NN"), ("s", "NNS"),
)
# Tags of marks that stand alone.
MARKS = {",": ",", ":": ":", ";": ":", "(": "(", ")": ")", ".": ".", "!": ".", "?": "."}


def tag_sql(
    t: str,
    lexicon: Mapping[str, Sequence[str]] = LEXICON,
    suffixes: Sequence[tuple[str, str]] = SUFFIXES,
    default: str = "NN",
) -> str:
    """Tag of one token as SQL text: marks, numbers, lexicon, suffix, default, in this order.

    One cheap test in front of each group of rules lets most words pass it at once.
    """
    marks = [(f"{t} = {lit(mark)}", lit(name)) for mark, name in MARKS.items()]
    number = (f"{t} RLIKE {lit(r'\p{N}')}", "'CD'")
    symbol = (f"{t} RLIKE {lit(r'\A[^\p{L}\p{N}]+\z')}", "'SYM'")
    special = case([*marks, number, symbol], "NULL")
    listed = case([(one_of(t, words), lit(name)) for name, words in lexicon.items()], "NULL")
    every = {w: None for words in lexicon.values() for w in words}

    by_last: dict[str, list[tuple[str, str]]] = {}
    for suffix, name in suffixes:
        fits = f"endswith({t}, {lit(suffix)}) AND length({t}) > {len(suffix) + 1}"
        by_last.setdefault(suffix[-1], []).append((fits, lit(name)))
    endings = [(f"endswith({t}, {lit(x)})", case(rules, lit(default))) for x, rules in by_last.items()]

    special = case([(f"NOT {t} RLIKE {lit(r'\A\p{L}+\z')}", special)], "NULL")
    listed = case([(one_of(t, every), listed)], "NULL")
    return case([(f"{t} IS NOT NULL", f"coalesce({special}, {listed}, {case(endings, lit(default))})")], "NULL")


def tag_word(t: str, **rules) -> Column:
    """Tag of one token, given as SQL text, such as the name of a column."""
    return F.expr(tag_sql(t, **rules))


def sentence_tagger(tag: Callable[[list[str]], list[str]]) -> Callable[[Column], Column]:
    """Make a Column function from a Python tagger (one sentence in, its tags out).

    Takes all sentences of a section, `array<array<string>>`.  Sentences stay whole and
    travel in Arrow batches.
    """

    @F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
    def tags(sections: pd.Series) -> pd.Series:
        return sections.map(
            lambda sentences: [list(tag(list(tokens))) for tokens in sentences],
            na_action="ignore",
        )

    return tags
