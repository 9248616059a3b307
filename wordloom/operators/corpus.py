"""Row filters and the document shape.

A document is one row: `doc_id` and, for each section, an array of sentences.  Tokenised,
a sentence is an array of `struct<token, pos>` with a NULL for each rejected token, so that
neighbours stay neighbours.  All steps from the scan to the flat token list are narrow:
they change a row in place and need no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.functions.clean import CLEANERS, Cleaner, clean_sentences
from wordloom.functions.stem import stem_each, stem_words
from wordloom.functions.tagging import tag_sql
from wordloom.functions.tokens import keep_sql, tokenize
from wordloom.functions.wordlists import STOP_WORDS
from wordloom.operators.lookup import each_distinct, match_elements
from wordloom.runtime import BROADCAST_ROWS, fits, most_frequent

SECTIONS = ("ingredients", "instructions")


def drop_by_source(df: DataFrame, text: str = "cookbooks.com", column: str = "link") -> DataFrame:
    """drop rows whose source contains `text`; a row without a source stays."""
    return df.where(~F.coalesce(F.col(column).contains(text), F.lit(False)))


def exclude_ids(df: DataFrame, excluded: DataFrame, key: str = "doc_id") -> DataFrame:
    """drop rows whose id is listed.  A list of checked size is broadcast; a longer
    one is joined by shuffle."""
    ids = excluded.select(key).distinct()
    return df.join(F.broadcast(ids) if fits(ids, BROADCAST_ROWS) else ids, key, "left_anti")


def decode_json_sections(df: DataFrame, sections: Sequence[str] = SECTIONS, strict: bool = True) -> DataFrame:
    """JSON text to `array<string>`.  Strict mode fails on bad JSON; otherwise the
    section is NULL and the row can be told apart."""
    mode = {"mode": "FAILFAST" if strict else "PERMISSIVE"}
    return df.withColumns({s: F.from_json(F.col(s), "array<string>", mode) for s in sections})


def clean_documents(
    df: DataFrame, sections: Sequence[str] = SECTIONS, cleaners: Sequence[Cleaner] = CLEANERS
) -> DataFrame:
    """F3 + C12 on every sentence of every section."""
    return df.withColumns({s: clean_sentences(F.col(s), cleaners) for s in sections})


def split_tokens(df: DataFrame, sections: Sequence[str] = SECTIONS) -> DataFrame:
    """T1 + F5: sentences become arrays of tokens; sentences without any token vanish."""
    split = lambda c: F.filter(F.transform(c, tokenize), lambda t: F.size(t) > 0)
    return df.withColumns({s: split(F.col(s)) for s in sections})


def filter_tokens(
    df: DataFrame,
    sections: Sequence[str] = SECTIONS,
    stop_words: Sequence[str] = (),
    tagger: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """M2 + F4: tag whole sentences, then put NULL in the place of rejected tokens.

    `tagger` maps all sentences of a section to their tags; by default the tags come from
    lexicon and suffix rules.
    """
    keep = f"CASE WHEN {keep_sql('x.token', 'x.pos', stop_words)} THEN x END"
    if tagger is None:
        # A tag depends on the word only, so distinct words are enough.
        tagged = "transform({}, t -> named_struct('token', t, 'pos', {}))"
        rule = lambda words: F.expr(f"transform({tagged.format(words, tag_sql('t'))}, x -> {keep})")
        return each_distinct(df, sections, rule, "struct<token:string,pos:string>")
    df = df.withColumns({f"_{s}_tags": tagger(F.col(s)) for s in sections})
    tagged = "zip_with(s, tags, (t, p) -> named_struct('token', t, 'pos', p))"
    filtered = {s: f"zip_with({s}, _{s}_tags, (s, tags) -> transform({tagged}, x -> {keep}))" for s in sections}
    df = df.withColumns({s: F.expr(text) for s, text in filtered.items()})
    return df.drop(*[f"_{s}_tags" for s in sections])


def section_stream(section: Column) -> Column:
    """All tokens of a section in one array, with a NULL between two sentences.

    The NULL keeps word pairs inside a sentence, just as a rejected token does.
    """
    gap = F.array(F.lit(None).cast("struct<token:string,pos:string>"))
    return F.flatten(F.transform(section, lambda s: F.concat(s, gap)))


def token_streams(df: DataFrame, sections: Sequence[str] = SECTIONS) -> DataFrame:
    return df.withColumns({s: section_stream(F.col(s)) for s in sections})


def explode_words(df: DataFrame, words: Column, name: str) -> DataFrame:
    """One row for each element of an array of words.

    `explode` lets the optimizer put a test of the array in front, which would work out
    the array once more for each test; the outer form with a test behind it does not.
    """
    return df.select(F.explode_outer(words).alias(name)).where(F.col(name).isNotNull())


def kept_words(df: DataFrame, sections: Sequence[str] = SECTIONS) -> DataFrame:
    """The kept tokens of all streams, one row each, in a column `token`."""
    return explode_words(df, F.array_compact(words_of(sections)), "token")


def stem_streams(
    df: DataFrame,
    sections: Sequence[str] = SECTIONS,
    stems: DataFrame | None = None,
    cache: bool = False,
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """F4h: replace each kept token by its stem.

    `stems` is a table `(token, stem)`.  A table made by the user counts in full: up to
    `max_rows` words are looked up in place, a larger one is joined.  With `cache` the table comes
    from `stem_vocabulary`, and its most frequent words are enough, since the expression gives the
    others the same stems.  Words that are not in the table are stemmed by expression.
    """
    known = None
    if stems is not None:
        known = most_frequent(stems, max_rows) if cache else stems
        known = known.select(F.col("token").alias("key"), F.col("stem").alias("value"))
    if known is None or cache or fits(known, max_rows):
        return each_distinct(df, sections, stem_each, known=known, inside="token")
    words = {s: f"transform({s}, x -> x.token)" for s in sections}
    # One lookup for all sections; each takes its part of the answer.
    empty = "CAST(array() AS array<string>)"
    every = ", ".join(f"coalesce({words[s]}, {empty})" for s in sections)
    df = match_elements(df, F.expr(f"concat({every})"), known, "_found", max_rows)
    before, stemmed = "1", {}
    for s in sections:
        size = f"greatest(size({s}), 0)"
        part = f"CASE WHEN {s} IS NOT NULL THEN slice(_found, {before}, {size}) END"
        df = df.withColumn(f"_{s}_found", F.expr(part))
        before += f" + {size}"
    df = df.drop("_found")
    for s in sections:
        missing = f"zip_with({words[s]}, _{s}_found, (w, f) -> CASE WHEN f IS NULL THEN w END)"
        any_missing = F.expr(f"exists({missing}, w -> w IS NOT NULL)")
        filled = F.zip_with(f"_{s}_found", stem_each(missing), lambda f, m: F.coalesce(f, m))
        stemmed[s] = F.when(any_missing, filled).otherwise(F.col(f"_{s}_found"))

    def put(x: Column, stem: Column) -> Column:
        return F.when(x.isNotNull(), F.struct(stem.alias("token"), x["pos"].alias("pos")))

    df = df.withColumns({s: F.zip_with(F.col(s), stemmed[s], put) for s in sections})
    return df.drop(*[f"_{s}_found" for s in sections])


def tokenize_documents(
    df: DataFrame,
    sections: Sequence[str] = SECTIONS,
    stop_words: Sequence[str] | None = None,
    tagger: Callable[[Column], Column] | None = None,
    stems: DataFrame | None = None,
) -> DataFrame:
    """A1: cleaned documents to token streams, one `array<struct<token, pos>>` per section.

    The default stop words are stemmed before they are compared with the unstemmed tokens;
    pass a list to compare with that list instead (F4e).
    """
    if stop_words is None:
        stop_words = stem_words(df.sparkSession, STOP_WORDS)
    df = filter_tokens(split_tokens(df, sections), sections, stop_words, tagger)
    return stem_streams(token_streams(df, sections), sections, stems)


def flatten_documents(df: DataFrame, sections: Sequence[str] = SECTIONS) -> DataFrame:
    """A2 + F6: `(doc_id, tokens)`, sections in order, without placeholders."""
    return df.select("doc_id", F.array_compact(words_of(sections)).alias("tokens"))


def words_of(sections: Sequence[str]) -> Column:
    """The tokens of all streams in one array, with their placeholders; a NULL section has none."""
    none = F.array().cast("array<string>")
    return F.concat(*[F.coalesce(F.transform(F.col(s), lambda x: x["token"]), none) for s in sections])


