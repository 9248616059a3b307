"""Golden cases of cleaning, tokenising, tagging and stemming."""

import html
import random
import shutil
from html.entities import html5

import pytest
from pyspark.sql import functions as F

from checks import queries as Q
from wordloom.functions import clean as C
from wordloom.functions.stem import stem, stem_each, stem_vocabulary, stem_words
from wordloom.functions.tagging import sentence_tagger, tag_word
from wordloom.functions.tokens import keep_token, tokenize
from wordloom.functions.wordlists import STOP_WORDS, TOOLS, UNITS


def apply(spark, function, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.x for r in df.select("i", function(F.col("t")).alias("x")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "function, text, expected",
    [
        (C.remove_html_tags, "a<b>c</b>d <p class='x'>e", "a c d  e"),
        (C.remove_urls, "see http://a.b/c and www.x.org or shop.com/y end.com", "see   and   or  end.com"),
        (C.remove_currency, "£12.25 and $100, #tag-", "and , -"),
        (C.remove_numeric, "1 215 0.2 1-2 12.5% all-purpose", "        12.5% all purpose"),
        (C.remove_symbols, "Brand™ ® @home", "Brand  home"),
        (C.remove_quotes, "don't 'quoted' \"x\" ' '", "don t  quoted   x  ' '"),
        (C.split_ampersand, "salt& m&m R& x&", "salt & m&m R& x &"),
        (C.collapse_whitespace, "a  b\t c\td", "a b c\td"),
        (C.remove_bad_words, "a_b ok !! () x,  y", "ok x, y"),
    ],
)
def test_cleaners(spark, function, text, expected):
    got = apply(spark, function, [text])[0]
    if function in (C.remove_currency, C.remove_numeric):
        assert got.split() == expected.split()
    else:
        assert got == expected


def test_unescape_all_entities(spark):
    texts = [
        "plain", "a &amp; b", "&amp;lt;b&gt;", "&frac12; cup", "&#189; &#xBD; &notit; &lt", "m&m & x", None,
        "&nbsp;|&eacute;", "&amp;amp;", "AT&T &copy",
    ]
    got = apply(spark, C.unescape_html, texts)
    assert got == [t if t is None else html.unescape(t) for t in texts]
    arrays = spark.createDataFrame([(texts,), (None,), ([],)], "a array<string>")
    got = [r.x for r in arrays.select(C.unescape_html_each(F.col("a")).alias("x")).collect()]
    assert got == [[t if t is None else html.unescape(t) for t in texts], None, []]


def test_unescape_every_name_and_number(spark):
    """Equal to the standard library for all names, with and without semicolon, and no Python in the plan."""
    pick = random.Random(1)
    texts = [t for n in html5 for t in (f"a &{n} b", f"&{n}x", f"&{n.rstrip(';')}", f"&{n};;&{n}")]
    edges = [0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFDCF, 0xFDD0, 0xFDEF, 0xFDF0, 0xFFFD, 0xFFFE, 0xFFFF, 0x10000, 0x1FFFE, 0x10FFFD, 0x10FFFF, 0x110000]
    for n in [*range(0x180), *edges, 9_999_999, 10**8, 10**30]:
        texts += [f"x&#{n};y", f"&#{n}", f"&#x{n:x};", f"&#X{n:X}z", f"&#000{n};", f"&#x0000{n:x}"]
    texts += ["", "&", "&&", "& amp;", "&#;", "&#x;", "&#xg;", "&;", "&ampamp;", "&\tamp;", "&" + "a" * 40 + ";", "&amp" * 3, "&#٣;", "&lt&gt&#60&#x3c"]
    parts = ["&", "#", "x", "1", "9", ";", "amp", "not", "in", "lt", "é", " ", "a"]
    texts += ["".join(pick.choice(parts) for _ in range(pick.randrange(14))) for _ in range(2000)]
    df = spark.createDataFrame([(t,) for t in texts], "s string").select("s", C.unescape_html(F.col("s")).alias("x"))
    assert [(r.s, r.x) for r in df.collect() if r.x != html.unescape(r.s)] == []
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_clean_text(spark):
    text = "&lt;b&gt;Mix&lt;/b&gt; 1-2 cups all-purpose flour & 12.5% cream; don't use www.x.com/y £3.50!! a_b"
    assert apply(spark, C.clean_text, [text, None, ""]) == [
        "mix cups all purpose flour 12.5% cream; don t use",
        None,
        "",
    ]


def test_clean_sentences_drops_empty_before_cleaning(spark):
    df = spark.createDataFrame([(["A!", "", None, "12"],)], "s array<string>")
    assert df.select(C.clean_sentences(F.col("s")).alias("x")).first().x == ["a!", ""]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("2 cups (500 ml) milk", "2 cups ( 500 ml ) milk"),
        ("1-2 mashed bananas: as ripe as possible", "1-2 mashed bananas : as ripe as possible"),
        ("1.5 kg bananas, mashed", "1.5 kg bananas , mashed"),
        ("Freshly grated Parmesan cheese, for garnish.", "Freshly grated Parmesan cheese , for garnish ."),
        ("2 onions, finely chopped*", "2 onions , finely chopped *"),
        ("beef and/or chicken", "beef and / or chicken"),
        ("the U.S. way", "the U.S. way"),
        ("wait... . a b\x1cc", "wait.. . . a b c"),
    ],
)
def test_tokenize(spark, text, expected):
    assert apply(spark, tokenize, [text])[0] == expected.split(" ")


STEMS = """consigned consign;consignment consign;consistency consist;consolatory consolatori;
console consol;consolingly consol;conspicuously conspicu;conspirators conspir;constables constabl;
constancy constanc;knackeries knackeri;knavish knavish;kneeling kneel;knightly knight;knitted knit;
knives knive;knocker knocker;because becaus;very veri;only onli;any ani;once onc;being be;having have;
ours our;generate generat;generous generous;communication communic;arsenal arsenal;hopping hop;hoping hope;
fluently fluentli;sensational sensat;happily happili;apples appl;sugar sugar;agreed agre;feed feed;flies fli;
dies die;ties tie;cry cri;by by;say say;using use;luxuriating luxuri;rational ration;radically radic;
controlling control;skies sky;dying die;news news;innings inning;proceeded proceed;gas gas;gaps gap;
kiwis kiwi;yellow yellow;youth youth;boyish boyish;tomatoes tomato;cookies cooki;sliced slice;mixture mixtur;
bleed bleed;singing sing;decisiveness decis;formative format;goodness good;adjustment adjust;adoption adopt;
rate rate;cease ceas;roll roll;o'clock o'clock;cook's cook;'tis tis;YES yes;x x""".replace("\n", "")


def test_stem(spark):
    pairs = [p.split(" ") for p in STEMS.split(";")]
    df = spark.createDataFrame(pairs, "w string, e string")
    wrong = df.select("w", "e", stem("w").alias("got")).where("got IS DISTINCT FROM e").collect()
    assert wrong == []
    row = spark.createDataFrame([([w for w, _ in pairs] + [None],)], "ws array<string>")
    assert row.select(stem_each("ws").alias("x")).first().x == [e for _, e in pairs] + [None]
    counted = stem_vocabulary(df.union(df).select(F.col("w").alias("token")))
    assert {r.token: (r.cnt, r.stem) for r in counted.collect()} == {w: (2, e) for w, e in pairs}


def test_word_lists(spark):
    assert (len(STOP_WORDS), len(UNITS), len(TOOLS)) == (130, 199, 54)
    stems = stem_words(spark, ["cup", "cups", "leaves"])
    assert stems == ["cup", "leav"]


def test_tags_and_keep(spark):
    words = {
        "the": "DT", "of": "IN", "sugar": "NN", "onions": "NNS", "baking": "VBG", "chopped": "VBD",
        "finely": "RB", "delicious": "JJ", ",": ",", "(": "(", "12": "CD", "&&": "SYM", "12.5%": "CD",
        "glass": "NN", "bed": "NN", "is": "VBZ",
    }
    df = spark.createDataFrame(list(words.items()), "t string, tag string")
    got = df.select("t", "tag", tag_word("t").alias("got")).collect()
    assert [(r.t, r.got) for r in got] == [(r.t, r.tag) for r in got]
    kept = df.where(keep_token("t", "tag", ["glass"])).collect()
    assert {r.t for r in kept} == {
        "sugar", "onions", "baking", "chopped", "finely", "delicious", "12.5%", "bed", "is",
    }
    edge = spark.createDataFrame([("½",), ("()",), ("a=b",), ("n",), ("　x",), ("ok",)], "t string")
    assert [r.t for r in edge.where(keep_token("t", "'NN'", [])).collect()] == ["　x", "ok"]


def test_user_tagger(spark):
    df = spark.createDataFrame([([["a", "b"], ["c"]],), (None,)], "s array<array<string>>")
    upper = sentence_tagger(lambda tokens: [f"{t}{len(tokens)}" for t in tokens])
    got = [r.x for r in df.select(upper(F.col("s")).alias("x")).collect()]
    assert got == [[["a2", "b2"], ["c1"]], None]


def test_stem_dictionary_reads_its_documents_once(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"red wine w{k} " + " ".join(f"{k}x{i}" for i in range(9))) for k in range(30)], "doc_id long, text string")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    got = Q.QUERIES["stem_dictionary"](spark, str(tmp_path))
    shutil.rmtree(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.tokens.split()[:2] for r in got.collect()} == {k: ["der", "eniw"] for k in range(30)}
