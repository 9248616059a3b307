"""DuckDB statements that give the same rows as the registered queries.

They are put together from small pieces of text, one piece per operator, and written row by
row (one row per token, per pair or per vector element), not as array expressions.
"""

from __future__ import annotations

from math import lcm

from wordloom.functions import patterns as P
from wordloom.functions import stem as S
from wordloom.functions import tagging, tokens, wordlists

SCALE10 = lcm(*range(1, 11))


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def qs(words) -> str:
    return ", ".join(q(w) for w in words)


def sub(expr: str, pattern: str, to: str) -> str:
    return f"regexp_replace({expr}, {q(pattern)}, {q(to)}, 'g')"


# --- cleaning -----------------------------------------------------------------------------


def unescape(e: str) -> str:
    for entity, text in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        e = f"replace({e}, {q(entity)}, {q(text)})"
    return e


def html_tags(e: str) -> str:
    return sub(e, P.HTML_TAG, " ")


def urls(e: str) -> str:
    return sub(sub(sub(e, P.URL_HTTP, " "), P.URL_WWW, " "), P.URL_DOT_COM, " ")


def currency(e: str) -> str:
    return sub(e, P.CURRENCY, " ")


def numeric(e: str) -> str:
    return sub(e, P.NUMERIC, r" \1")


def symbols(e: str) -> str:
    return f"translate({e}, {q(P.SYMBOLS)}, '')"


def quotes(e: str) -> str:
    return sub(sub(e, P.QUOTE_AFTER_WORD, r"\1 "), P.QUOTE_BEFORE_WORD, r" \1")


def ampersand(e: str) -> str:
    return sub(e, P.AMPERSAND_AFTER_WORD, r"\1 &\2")


def whitespace(e: str) -> str:
    return sub(e, P.SPACE_RUN, " ")


def bad_words(e: str) -> str:
    bad = f"contains(w, '_') OR regexp_matches(w, {q(P.ONLY_PUNCTUATION)})"
    return f"array_to_string(list_filter(string_split({e}, ' '), lambda w: NOT ({bad})), ' ')"


def clean(e: str) -> str:
    steps = (unescape, html_tags, urls, currency, numeric, symbols, quotes, ampersand, whitespace, bad_words)
    for f in steps:
        e = f(e)
    return f"lower({e})"


# --- tokens -------------------------------------------------------------------------------


def token_list(e: str) -> str:
    ends = f"regexp_matches(t, {q(P.FINAL_STOP)}) AND NOT regexp_matches(t, {q(P.ABBREVIATION_STOP)})"
    parts = f"CASE WHEN {ends} THEN [t[:-2], '.'] ELSE [t] END"
    found = f"regexp_extract_all({e}, {q('(' + P.TOKEN + ')')})"
    return f"list_filter(flatten(list_transform({found}, lambda t: {parts})), lambda t: t <> '')"


def tag(t: str) -> str:
    whens = [f"WHEN {t} = {q(m)} THEN {q(name)}" for m, name in tagging.MARKS.items()]
    whens.append(f"WHEN regexp_matches({t}, '\\p{{N}}') THEN 'CD'")
    whens.append(f"WHEN regexp_matches({t}, '\\A[^\\p{{L}}\\p{{N}}]+\\z') THEN 'SYM'")
    whens += [f"WHEN {t} IN ({qs(ws)}) THEN {q(name)}" for name, ws in tagging.LEXICON.items()]
    whens += [
        f"WHEN ends_with({t}, {q(x)}) AND length({t}) > {len(x) + 1} THEN {q(name)}"
        for x, name in tagging.SUFFIXES
    ]
    return f"CASE {' '.join(whens)} ELSE 'NN' END"


def plain(t: str) -> str:
    return (
        f"NOT regexp_matches({t}, {q(P.ONLY_NUMERIC)}) AND NOT regexp_matches({t}, {q(P.ONLY_SPACE)}) "
        f"AND NOT contains({q(P.PUNCTUATION)}, {t})"
    )


def kept(t: str, pos: str) -> str:
    return (
        f"({pos} IN ({qs(tokens.KEPT_TAGS)}) OR ends_with({t}, '%')) AND length({t}) > 1 "
        f"AND NOT contains({t}, '=') AND {plain(t)}"
    )


# --- stems --------------------------------------------------------------------------------


def _in_region(w: str, suffix: str, region: str) -> str:
    return f"length({w}) - {len(suffix)} >= {region}"


def _cut(n: int, end: str = "") -> str:
    return f"substring(w, 1, length(w) - {n}) || {q(end)}"


def _rules(rules, region, second=()):
    out = []
    for suffix, end in rules:
        ok = _in_region("w", suffix, "p2" if suffix in second else region)
        if suffix in S.BEFORE:
            ok += f" AND regexp_matches(w, {q(S.BEFORE[suffix])})"
        out.append(f"WHEN ends_with(w, {q(suffix)}) THEN CASE WHEN {ok} THEN {_cut(len(suffix), end)} ELSE w END")
    return f"CASE {' '.join(out)} ELSE w END"


def stems(words: str) -> str:
    """CTEs that end in `stems(token, stem)` for the table `words(token)`."""
    fixed = " ".join(f"WHEN lower(token) = {q(w)} THEN {q(x)}" for w, x in S.EXCEPTIONS.items())
    marked = sub("translate(lower(token), '’‘‛', '''''''')", r"\A'", "")
    marked = sub(sub(marked, r"\Ay", "Y"), f"({S.VOWEL})y", r"\1Y")
    vowel_before = lambda n: f"regexp_matches(substring(w, 1, length(w) - {n}), {q(S.VOWEL)})"
    verb = []
    for x in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
        if x.startswith("eed"):
            done = f"CASE WHEN {_in_region('w', x, 'p1')} THEN {_cut(len(x), 'ee')} ELSE w END"
        else:
            done = f"CASE WHEN {vowel_before(len(x))} THEN {_cut(len(x), '|')} ELSE w END"
        verb.append(f"WHEN ends_with(w, {q(x)}) THEN {done}")
    base = "substring(w, 1, length(w) - 1)"
    steps = [
        # possessive
        sub("w", r"('s'|'s|')\z", ""),
        # plural
        f"""CASE WHEN ends_with(w, 'sses') THEN {_cut(2)}
            WHEN ends_with(w, 'ied') OR ends_with(w, 'ies')
                THEN CASE WHEN length(w) > 4 THEN {_cut(2)} ELSE {_cut(1)} END
            WHEN ends_with(w, 'us') OR ends_with(w, 'ss') THEN w
            WHEN ends_with(w, 's') AND {vowel_before(2)} THEN {_cut(1)} ELSE w END""",
        f"CASE {' '.join(verb)} ELSE w END",
        f"""CASE WHEN NOT ends_with(w, '|') THEN w
            WHEN regexp_matches({base}, '(?:at|bl|iz)\\z') THEN {base} || 'e'
            WHEN regexp_matches({base}, {q(S.DOUBLE_END)}) THEN substring(w, 1, length(w) - 2)
            WHEN p1 >= length({base}) AND regexp_matches({base}, {q(S.SHORT_WORD)}) THEN {base} || 'e'
            ELSE {base} END""",
        f"CASE WHEN regexp_matches(w, {q('.' + S.OTHER + '[yY]' + chr(92) + 'z')}) THEN {_cut(1, 'i')} ELSE w END",
        _rules(S.STEP2, "p1"),
        _rules(S.STEP3, "p1", ("ative",)),
        _rules([(x, "") for x in S.STEP4], "p2"),
        f"""CASE WHEN ends_with(w, 'll') AND {_in_region('w', 'l', 'p2')} THEN {_cut(1)}
            WHEN ends_with(w, 'e') AND ({_in_region('w', 'e', 'p2')} OR ({_in_region('w', 'e', 'p1')}
                AND length(w) >= 4 AND NOT regexp_matches(w, {q(S.SHORT_END + 'e' + chr(92) + 'z')})))
            THEN {_cut(1)} ELSE w END""",
    ]
    n1 = f"length(regexp_extract(w, {q(S.R1_START)}))"
    n2 = f"length(regexp_extract(substring(w, p1 + 1), {q(S.R2_START)}))"
    ctes = [
        f"st_words AS (SELECT DISTINCT token FROM {words} WHERE token IS NOT NULL)",
        f"st_a AS (SELECT token, CASE {fixed} WHEN length(token) <= 2 THEN lower(token) END AS fixed, "
        f"{marked} AS w FROM st_words)",
        f"st_b AS (SELECT *, CASE WHEN {n1} > 0 THEN {n1} ELSE 1000000 END AS p1 FROM st_a)",
        f"st_0 AS (SELECT *, CASE WHEN {n2} > 0 THEN p1 + {n2} ELSE 1000000 END AS p2 FROM st_b)",
    ]
    for k, step in enumerate(steps):
        ctes.append(f"st_{k + 1} AS MATERIALIZED (SELECT token, fixed, p1, p2, {step} AS w FROM st_{k})")
    ctes.append(
        f"stems AS (SELECT token, coalesce(fixed, replace(w, 'Y', 'y')) AS stem FROM st_{len(steps)})"
    )
    return ",\n".join(ctes)


# --- corpora ------------------------------------------------------------------------------

# One row per sentence: (doc_id, section, sent, sentence)
DOCUMENT_SENTENCES = """
    SELECT doc_id, 'body' AS section, unnest(string_split(text, chr(10))) AS sentence,
           generate_subscripts(string_split(text, chr(10)), 1) AS sent FROM documents"""
TURN_SENTENCES = """
    SELECT conv_id || ':' || turn AS doc_id,
           CASE WHEN role = 'user' THEN 'ingredients' ELSE 'instructions' END AS section,
           unnest(string_split(text, chr(10))) AS sentence,
           generate_subscripts(string_split(text, chr(10)), 1) AS sent FROM conversations"""


def words(sentences: str) -> str:
    """CTEs that end in `tok(doc_id, section, sent, pos, word, tag)`."""
    return f"""sentences AS ({sentences}),
cleaned AS (SELECT doc_id, section, sent, {clean('sentence')} AS s FROM sentences WHERE sentence <> ''),
lists AS (SELECT doc_id, section, sent, {token_list('s')} AS ws FROM cleaned),
long AS (SELECT doc_id, section, sent, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM lists),
tok AS MATERIALIZED (SELECT *, {tag('word')} AS tag FROM long)"""


def streams(sentences: str) -> str:
    """CTEs that end in `stream(doc_id, section, sent, pos, token, tag)`, NULL where rejected."""
    lists = [*wordlists.STOP_WORDS, *wordlists.UNITS, *wordlists.TOOLS]
    return f"""{words(sentences)},
listed AS (SELECT unnest([{qs(lists)}]) AS token),
all_words AS (SELECT word AS token FROM tok UNION SELECT token FROM listed),
{stems('all_words')},
stop AS (SELECT stem FROM stems WHERE token IN ({qs(wordlists.STOP_WORDS)})),
units_tools AS (SELECT stem FROM stems WHERE token IN ({qs([*wordlists.UNITS, *wordlists.TOOLS])})),
stream AS MATERIALIZED (
    SELECT doc_id, section, sent, pos, CASE WHEN ok THEN stem END AS token, CASE WHEN ok THEN tag END AS tag
    FROM (SELECT tok.*, stems.stem, ({kept('word', 'tag')}) AND stop.stem IS NULL AS ok
          FROM tok JOIN stems ON stems.token = tok.word
          LEFT JOIN (SELECT DISTINCT stem FROM stop) stop ON stop.stem = tok.word))"""


def bigrams(section: str, least: str) -> str:
    """CTEs that end in `model(w1, w2, freq)`."""
    return f"""pairs AS (
    SELECT token AS w1, tag AS p1, lead(token) OVER s AS w2, lead(tag) OVER s AS p2 FROM stream
    WHERE section = {q(section)} WINDOW s AS (PARTITION BY doc_id, section, sent ORDER BY pos)),
candidates AS (
    SELECT w1, w2 FROM pairs WHERE w1 <> w2 AND left(p1, 1) IN ('N', 'J') AND left(p2, 1) = 'N'
    AND w1 NOT IN (SELECT stem FROM units_tools) AND w2 NOT IN (SELECT stem FROM units_tools)),
counts AS (SELECT w1, w2, count(*) AS freq FROM candidates GROUP BY ALL),
model AS MATERIALIZED (SELECT w1, w2, freq FROM counts WHERE freq >= {least})"""


SHARE = "(SELECT floor(count(*) * CAST({} AS DOUBLE)) FROM candidates)"

JOINED = """marked AS (
    SELECT t.*, lead(t.token) OVER s AS following,
           CASE WHEN m.w1 IS NOT NULL THEN 1 ELSE 0 END AS hit
    FROM (SELECT *, lead(token) OVER (PARTITION BY doc_id, section, sent ORDER BY pos) AS nx FROM stream) t
    LEFT JOIN model m ON m.w1 = t.token AND m.w2 = t.nx
    WINDOW s AS (PARTITION BY doc_id, section, sent ORDER BY pos)),
runs AS (SELECT *, sum(1 - hit) OVER (PARTITION BY doc_id, section, sent ORDER BY pos) AS run FROM marked),
placed AS (
    SELECT *, hit = 1 AND row_number() OVER (PARTITION BY doc_id, section, sent, run, hit ORDER BY pos) % 2 = 1
           AS starts FROM runs),
joined AS (
    SELECT doc_id, section, sent, pos, CASE WHEN starts THEN token || '_' || following ELSE token END AS token
    FROM (SELECT *, lag(starts) OVER (PARTITION BY doc_id, section, sent ORDER BY pos) AS taken FROM placed)
    WHERE token IS NOT NULL AND NOT coalesce(taken, false))"""

LINE = "string_agg(token, ' ' ORDER BY section, sent, pos)"

# (doc_id, pos, word) of the plain tokens of the whole text
TEXT_WORDS = f"""text_lists AS (SELECT doc_id, {token_list(clean('text'))} AS ws FROM documents),
text_words AS MATERIALIZED (
    SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM text_lists)"""
VOCAB = TEXT_WORDS + """,
vocab AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY cnt DESC, word) - 1 AS word_id, word, cnt
    FROM (SELECT word, count(*) AS cnt FROM text_words GROUP BY word) WHERE cnt >= 15),
ids AS MATERIALIZED (
    SELECT doc_id, word_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS place
    FROM text_words JOIN vocab USING (word))"""


def cooccurrence(window: int, weighted: bool, symmetric: bool) -> str:
    """CTEs that end in `pairs(wi, wj, x)`, one row per distance joined by its place."""
    scale = lcm(*range(1, window + 1)) if weighted else 1
    near = f"""near AS (
    SELECT b.word_id AS target, a.word_id AS context, d.d AS d
    FROM ids a CROSS JOIN (SELECT unnest(range(1, {window + 1})) AS d) d
    JOIN ids b ON b.doc_id = a.doc_id AND b.place = a.place + d.d)"""
    weight = f"{scale} // d" if weighted else "1"
    both = "SELECT context AS target, target AS context, d FROM near" if symmetric else None
    source = f"(SELECT target, context, d FROM near UNION ALL {both})" if both else "near"
    return f"""{VOCAB},
{near},
pairs AS MATERIALIZED (
    SELECT CAST(target AS INTEGER) AS wi, CAST(context AS INTEGER) AS wj,
           CAST(sum({weight}) AS DOUBLE) / {float(scale)} AS x
    FROM {source} GROUP BY ALL)"""


def als_sweeps(sweeps: int, ridge: float) -> str:
    """CTEs after `pairs`, and a SELECT of the parameters: weighted regressions on one value and a constant, in turns."""
    weighted = "terms AS MATERIALIZED (SELECT wi, wj, ln(x) AS y, least(1.0, pow(x / 100, 0.75)) AS f FROM pairs)"
    steps = [weighted, "c0 AS (SELECT word_id, ((word_id * 37) % 101 - 50) / 100.0::DOUBLE AS v, 0.0::DOUBLE AS b FROM vocab)"]
    for n in range(1, sweeps + 1):
        for own, fixed, key, other in ((f"w{n}", f"c{n - 1}", "wi", "wj"), (f"c{n}", f"w{n}", "wj", "wi")):
            steps.append(f"""{own} AS MATERIALIZED (
    SELECT word_id, (p * t - q * s) / (r * t - s * s) AS v, (r * q - s * p) / (r * t - s * s) AS b
    FROM (SELECT {key} AS word_id, sum(f * v * v) + {ridge} AS r, sum(f * v) AS s, sum(f) + {ridge} AS t,
                 sum(f * v * (y - b)) AS p, sum(f * (y - b)) AS q
          FROM terms JOIN {fixed} ON {fixed}.word_id = {other} GROUP BY {key}))""")
    return ",\n".join(steps) + f"""
    SELECT word_id, round(w.v, 6) AS value, round(w.b, 6) AS bias, round(c.v, 6) AS context_value, round(c.b, 6) AS context_bias
    FROM w{sweeps} w FULL JOIN c{sweeps} c USING (word_id)"""


# --- ontology -----------------------------------------------------------------------------

NODES = """nodes AS (
    SELECT 'world' AS id, 'food material' AS label
    UNION ALL SELECT 'r' || r_regionkey, r_name || ' food product' FROM region
    UNION ALL SELECT 'n' || n_nationkey, n_name FROM nation
    UNION ALL SELECT 's' || s_suppkey, s_name FROM supplier
    UNION ALL SELECT 'c' || c_custkey, c_name FROM customer),
edges AS (
    SELECT 'r' || r_regionkey AS child, 'world' AS parent FROM region
    UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation
    UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier
    UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer)"""


def paths(pruned=()) -> str:
    keep = f"label NOT IN ({qs(pruned)})" if pruned else "true"
    return f"""WITH RECURSIVE {NODES},
walk AS (
    SELECT id, label AS path FROM nodes WHERE label = 'food material' AND {keep}
    UNION ALL
    SELECT n.id, w.path || '>' || n.label FROM walk w JOIN edges e ON e.parent = w.id
    JOIN nodes n ON n.id = e.child WHERE {keep.replace('label', 'n.label')}),
leaves AS (SELECT id AS leaf_id, path FROM walk WHERE id NOT IN (SELECT parent FROM edges))"""
