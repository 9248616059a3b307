"""Character classes shared by the text functions.

The classes spell out Unicode white space and word characters, because the shorthand
classes of the JVM engine are ASCII only.  None of the patterns built from them uses a
look-around, so any RE2-style engine gives the same result.
"""

SPACE_CHARS = r"\s\x0b\x1c-\x1f\x85\p{Z}"
SPACE = f"[{SPACE_CHARS}]"
NONSPACE = f"[^{SPACE_CHARS}]"
WORD = r"[\p{L}\p{N}_]"

# Fixed value: the ASCII punctuation characters, in code order.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
ONLY_PUNCTUATION = r"\A[!-/:-@\[-`{-~]*\z"
# Letters with a numeric value, as `str.isnumeric` tells them (CJK numerals); they are in no number category.
NUMERAL_LETTERS = "".join(
    c for r in ((0x3400, 0xA000), (0xF900, 0xFB00), (0x20000, 0x2FA20)) for c in map(chr, range(*r)) if c.isnumeric()
)
ONLY_NUMERIC = rf"\A[\p{{N}}{NUMERAL_LETTERS}]+\z"
ONLY_SPACE = rf"\A{SPACE}+\z"

HTML_TAG = "<[^>]+>"
URL_HTTP = f"https?://{NONSPACE}+"
URL_WWW = rf"www\.{NONSPACE}+"
URL_DOT_COM = rf"{SPACE}{NONSPACE}+\.com{NONSPACE}+"
CURRENCY = f"[#£$]{NONSPACE}*{WORD}"
NUMERIC = r"[0-9\-./]+([^%0-9\-./]|\z)"
SYMBOLS = "™®@"
QUOTE_AFTER_WORD = f"({WORD})[\"']"
QUOTE_BEFORE_WORD = f"[\"']({WORD})"
AMPERSAND_AFTER_WORD = r"([a-z])&([^a-z]|\z)"
SPACE_RUN = f"{SPACE}+ "

SPLIT_MARKS = r"()\[\]{},/:;?!*~"
TOKEN = rf"[{SPLIT_MARKS}]|[^{SPLIT_MARKS}{SPACE_CHARS}]+"
FINAL_STOP = r"\.\z"
ABBREVIATION_STOP = rf"\.{WORD}\.\z"
