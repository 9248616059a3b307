"""Tokenising and the token tests (T1, F4a-F4g)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from wordloom.functions import patterns as P
from wordloom.functions.sql import lit, one_of

# Penn tags of the word classes that are kept.
KEPT_TAGS = (
    "NN", "NNS", "NNP", "NNPS",
    "JJ", "JJR", "JJS",
    "RB", "RBR", "RBS",
    "VB", "VBD", "VBG", "VBN", "VBP", "VBZ",
    "FW",
)


def tokenize(c: Column) -> Column:
    """Words and single punctuation marks; a final full stop is its own token.

    The stop stays on the word when it follows `.x`, as in `U.S.`.
    """
    pieces = F.regexp_extract_all(c, F.lit(P.TOKEN), F.lit(0))
    ends = lambda t: t.rlike(P.FINAL_STOP) & ~t.rlike(P.ABBREVIATION_STOP)
    split = F.transform(
        pieces,
        lambda t: F.when(
            ends(t), F.array(F.substring(t, F.lit(1), F.length(t) - 1), F.lit("."))
        ).otherwise(F.array(t)),
    )
    return F.filter(F.flatten(split), lambda t: t != "")


def plain_sql(t: str) -> str:
    """F4b-F4d: not numeric, not white space, not punctuation.

    Punctuation is a piece of the ASCII punctuation string, so `()` is, `&&` is not.
    """
    return f"NOT {t} RLIKE {lit(f'{P.ONLY_NUMERIC}|{P.ONLY_SPACE}')} AND instr({lit(P.PUNCTUATION)}, {t}) = 0"


def keep_sql(t: str, tag: str, stop_words: Sequence[str]) -> str:
    """every test a token must pass, as SQL text.

    F4a: an open word class, or a percentage.  F4e: `stop_words` is compared as given.
    F4f: two characters at least.  F4g: no `=`.
    """
    kept = f"({one_of(tag, KEPT_TAGS)} OR endswith({t}, '%')) AND length({t}) > 1"
    return f"{kept} AND NOT contains({t}, '=') AND NOT {one_of(t, stop_words)} AND {plain_sql(t)}"


def keep_token(t: str, tag: str, stop_words: Sequence[str]) -> Column:
    """F4 for columns that are given as SQL text."""
    return F.expr(keep_sql(t, tag, stop_words))
