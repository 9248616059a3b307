"""Quality rules with a ledger of failure bits.

Every rule is evaluated once per document.  The ledger keeps the measurements and one bit for each
rule that fails; a policy is a named, versioned set of bits with the number of failures it
tolerates, so a change of policy reads the ledger and not the texts.  Ablations come from bitwise
aggregation over the ledger: how many documents a rule fails, fails alone, and what the policy would
keep without it.

Everything is DataFrame functions, on arrays inside the row: nothing is shuffled for the ledger.

Words are `[^\\x20\\x09-\\x0D]+`.  A null text has no words.  Texts without words fail `few_words`; the
shares of such a text are 0.  Repeated rows are separate documents.  An empty table gives an empty
ledger.  Columns of the input are kept, except those with the names of the ledger.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.scratch import Scratch
from llm.textops import apart

SPACES = "\t\n\x0b\x0c\r "
SYMBOLS = "#*$%&|<>"

#: The rules, in the order of their bits: name and the condition to fail, over the measurements.
RULES = (
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("same_word_runs", "10 * n_same_as_last > 3 * n_words"),
    ("shouting", "2 * n_upper_words > n_words"),
    ("exclamation", "10 * n_exclamations > 3 * n_words"),
    ("duplicate_lines", "n_lines >= 4 and 2 * n_dup_lines > n_lines"),
    ("word_length", "word_chars < 2 * n_words or word_chars > 15 * n_words"),
)
BITS = {name: 1 << k for k, (name, _) in enumerate(RULES)}
BASE = BITS["few_words"] | BITS["repeated_words"]

MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_same_as_last", "n_upper_words",
    "n_exclamations",
)
LEDGER = (*MEASURES, "failed_bits")


@dataclass(frozen=True)
class Policy:
    """A document is rejected if more than `tolerated` of the rules in `mask` fail."""

    name: str
    version: int
    mask: int
    tolerated: int = 0


STRICT = Policy("strict", 1, (1 << len(RULES)) - 1)
#: The second version forgives one failure.
STRICT_2 = Policy("strict", 2, STRICT.mask, 1)
BASE_ONLY = Policy("base", 1, BASE)


def _repeats(words: Column, n: Column) -> Column:
    """Words in 3-word windows that occur twice or more in the text, the first one included.

    Windows are 64-bit hashes.  Texts whose windows all differ, most of them, end after one pass; in
    the others the windows are sorted with their places, and equal neighbours give the places.
    """
    at = F.sequence(F.lit(1), (n - 2).cast("int"))
    return F.transform(at, lambda i: F.xxhash64(F.get(words, i - 1), F.get(words, i), F.get(words, i + 1)))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with the measurements."""
    plain = F.coalesce(F.col(text), F.lit(""))
    spaced = F.translate(plain, SPACES, " " * len(SPACES))
    words = F.filter(F.split(spaced, " "), lambda w: w != "")
    length = lambda c: F.char_length(c).cast("long")
    without = lambda chars: length(plain) - length(F.translate(plain, chars, ""))
    keep = [c for c in docs.columns if c.lower() not in LEDGER]
    own = apart(keep)  # columns of this function, whatever the input's are called
    out = docs.select(
        *keep,
        words.alias(f"{own}words"),
        (length(plain) - without(SPACES)).alias("word_chars"),
        without(SYMBOLS).alias("n_symbols"),
        without("!").alias("n_exclamations"),
        F.filter(F.split(plain, "\n"), lambda x: F.translate(x, SPACES, "") != "").alias(f"{own}lines"),
    )
    word = F.col(f"{own}words")
    out = out.withColumns(
        {
            "n_words": F.size(f"{own}words").cast("long"),
            "n_lines": F.size(f"{own}lines").cast("long"),
            "n_dup_lines": (F.size(f"{own}lines") - F.size(F.array_distinct(f"{own}lines"))).cast("long"),
            "n_same_as_last": F.size(F.filter(word, lambda w, i: (i > 0) & (w == F.get(word, i - 1)))).cast("long"),
            # All letters in upper case: it changes in lower case only.
            "n_upper_words": F.size(F.filter(word, lambda w: (F.upper(w) == w) & (F.lower(w) != w) & (F.char_length(w) > 2))).cast("long"),
            f"{own}windows": F.when(F.size(f"{own}words") >= 3, _repeats(word, F.size(f"{own}words"))),
        }
    )
    windows = F.col(f"{own}windows")
    out = out.withColumn(f"{own}repeated", F.size(F.array_distinct(windows)) < F.size(windows))
    pairs = F.when(F.col(f"{own}repeated"), F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    out = out.withColumn(f"{own}pairs", pairs).drop(f"{own}windows", f"{own}words", f"{own}lines", f"{own}repeated")
    pair = F.col(f"{own}pairs")
    again = F.filter(
        pair, lambda p, k: (p["h"] == F.get(pair, k + 1)["h"]) | ((k > 0) & (p["h"] == F.get(pair, F.greatest(k - 1, F.lit(0)))["h"]))
    )
    out = out.withColumn(f"{own}places", F.sort_array(F.transform(again, lambda p: p["i"]))).drop(f"{own}pairs")
    place = F.col(f"{own}places")
    covered = F.aggregate(
        F.transform(place, lambda p, k: F.least(F.coalesce(F.get(place, k + 1) - p, F.lit(3)), F.lit(3))), F.lit(0), lambda a, x: a + x
    )
    out = out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    return out.select(*keep, *MEASURES)


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with the measurements and `failed_bits`, one bit for each rule that fails."""
    out = measured(docs, text)
    bits = F.lit(0).cast("long")
    for name, fails in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(fails), F.lit(BITS[name])).otherwise(F.lit(0)))
    # Never true, but not known to be: so filters on the bits stay above the measurements instead of
    # working them out a second time, nested in each other.
    bits = bits.bitwiseOR(F.when(F.monotonically_increasing_id() < 0, F.lit(1)).otherwise(F.lit(0)))
    return out.withColumn("failed_bits", bits)


def stored(docs: DataFrame, keep: Sequence[str], text: str = "text") -> DataFrame:
    """The ledger of `docs` with the columns `keep`, written once and read from there.

    Policies and ablations over it read numbers and bits; the texts are not read again.  The files are
    deleted when the session ends.
    """
    return Scratch(docs.sparkSession, "rules").save(ledger(docs, text).select(*keep, *LEDGER), "ledger")


def passes(policy: Policy) -> Column:
    """True for the rows of a ledger that the policy keeps."""
    return F.bit_count(F.col("failed_bits").bitwiseAND(F.lit(policy.mask))) <= policy.tolerated


def ablations(book: DataFrame, policy: Policy = STRICT) -> DataFrame:
    """`(policy, version, rule, fails, fails_alone, kept, kept_without)`, one row for each rule of the policy."""
    rows = [(name, BITS[name]) for name, _ in RULES if policy.mask & BITS[name]]
    counts = []
    bits = F.col("failed_bits").bitwiseAND(F.lit(policy.mask))
    keeps = lambda b: F.bit_count(b) <= policy.tolerated
    counts.append(F.count_if(keeps(bits)).alias("kept"))
    for name, bit in rows:
        counts.append(F.count_if(bits.bitwiseAND(F.lit(bit)) != 0).alias(f"{name}_fails"))
        counts.append(F.count_if(bits == F.lit(bit)).alias(f"{name}_alone"))
        counts.append(F.count_if(keeps(bits.bitwiseAND(F.lit(policy.mask & ~bit)))).alias(f"{name}_without"))
    sums = book.agg(*counts)
    lines = [
        F.struct(
            F.lit(name).alias("rule"), F.col(f"{name}_fails").alias("fails"), F.col(f"{name}_alone").alias("fails_alone"),
            F.col("kept"), F.col(f"{name}_without").alias("kept_without"),
        )
        for name, _ in rows
    ]
    return sums.select(F.inline(F.array(*lines))).select(F.lit(policy.name).alias("policy"), F.lit(policy.version).alias("version"), "*")
