"""Text cleaning: a conservative pipeline, an aggressive one, and the pieces of both.

Character classes are written out, so that letters of every script count as
word characters, as in the reference semantics; all but markup parsing, accent
removal and stemming are native column expressions.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .stopwords import STOP_WORDS

# Pieces of patterns that Java and RE2 read alike.
SPACE = r"\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\p{Z}"
WORD = r"\p{L}\p{N}_"
URL = r"http[s]?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\(\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+"
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]

# Contractions, expanded in this order.
CONTRACTIONS = {
    "ain't": "is not",
    "aren't": "are not",
    "can't": "cannot",
    "couldn't": "could not",
    "didn't": "did not",
    "doesn't": "does not",
    "don't": "do not",
    "hadn't": "had not",
    "hasn't": "has not",
    "haven't": "have not",
    "he'd": "he would",
    "he'll": "he will",
    "he's": "he is",
    "i'd": "i would",
    "i'll": "i will",
    "i'm": "i am",
    "i've": "i have",
    "isn't": "is not",
    "it's": "it is",
    "let's": "let us",
    "shouldn't": "should not",
    "that's": "that is",
    "there's": "there is",
    "they'd": "they would",
    "they'll": "they will",
    "they're": "they are",
    "they've": "they have",
    "wasn't": "was not",
    "we'd": "we would",
    "we're": "we are",
    "we've": "we have",
    "weren't": "were not",
    "what's": "what is",
    "where's": "where is",
    "who's": "who is",
    "won't": "will not",
    "wouldn't": "would not",
    "you'd": "you would",
    "you'll": "you will",
    "you're": "you are",
    "you've": "you have",
}
STOP_LISTS = {"en": "english", "es": "spanish", "fr": "french", "it": "italian", "pt": "portuguese", "ru": "russian", "tr": "turkish"}


def _sub(c: Column, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(by))


def collapse_spaces(c: Column) -> Column:
    """Runs of any white space to one space, none at the ends."""
    return F.trim(_sub(c, f"[{SPACE}]+", " "))


def strip_urls(c: Column) -> Column:
    return _sub(c, URL)


def strip_markup(c: Column) -> Column:
    """Markup and its usual entities by pattern: scripts and styles with their contents, other tags alone."""
    c = _sub(c, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>")
    c = _sub(c, r"<[^>]*>")
    for entity, by in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(by))
    return c


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs) -> None:
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag: str) -> None:
        self.hidden -= tag in ("script", "style") and self.hidden > 0

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.out.append(data)


def markup_text(html: str) -> str:
    """The text of a piece of HTML, entities read, scripts and styles left out."""
    if "<" not in html and "&" not in html:
        return html
    p = _Text()
    p.feed(html)
    p.close()
    return "".join(p.out)


@F.pandas_udf(StringType())
def parsed_markup(s: pd.Series) -> pd.Series:
    return s.map(markup_text, na_action="ignore")


@F.pandas_udf(StringType())
def without_accents(s: pd.Series) -> pd.Series:
    strip = lambda t: t if t.isascii() else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
    return s.map(strip, na_action="ignore")


def keep_plain_marks(c: Column) -> Column:
    """Everything but word characters, white space and . , ! ? - becomes a space."""
    return _sub(c, f"[^{WORD}{SPACE}.,!?-]", " ")


def collapse_marks(c: Column) -> Column:
    """Runs of one of . , ! ? to a single one."""
    return _sub(c, r"([.,!?])\1+", "$1")


def close_up_marks(c: Column) -> Column:
    """No space before . , ! ?"""
    return _sub(c, f"[{SPACE}]+([.,!?])", "$1")


def clean_text(c: Column) -> Column:
    """The conservative pipeline: addresses, markup, odd characters, spaces, repeated marks, spaces before marks. Null gives the empty text."""
    c = keep_plain_marks(strip_markup(strip_urls(F.coalesce(c, F.lit("")))))
    return F.trim(close_up_marks(collapse_marks(collapse_spaces(c))))


_CONTRACTED = re.compile(r"\b(" + "|".join(map(re.escape, CONTRACTIONS)) + r")\b", re.IGNORECASE)


@F.pandas_udf(StringType())
def expand_contractions(s: pd.Series) -> pd.Series:
    """English contractions written out; one pass, as no expansion holds another contraction."""
    return s.map(lambda t: _CONTRACTED.sub(lambda m: CONTRACTIONS[m.group().lower()], t) if "'" in t else t, na_action="ignore")


def keep_language_letters(c: Column, lang: Column) -> Column:
    """Characters that are no letters of the language go: own sets for Turkish and Russian, word characters for the others."""
    return (
        F.when(lang == "tr", _sub(c, f"[^a-zA-ZçğıöşüÇĞİÖŞÜ{SPACE}]"))
        .when(lang == "ru", _sub(c, f"[^а-яА-Я{SPACE}]"))
        .otherwise(_sub(c, f"[^{WORD}{SPACE}]"))
    )


def strip_contacts(c: Column) -> Column:
    """Addresses, e-mails, mentions, hashtags and digits go, in this order."""
    not_space = f"[^{SPACE}]+"
    c = _sub(c, f"http{not_space}|www{not_space}")
    c = _sub(c, f"{not_space}@{not_space}")
    c = _sub(c, f"@[{WORD}]+")
    c = _sub(c, f"#[{WORD}]+")
    return _sub(c, r"\p{Nd}+")


def tokens(c: Column) -> Column:
    """Words between white space; the empty array for a blank text."""
    return F.filter(F.split(c, f"[{SPACE}]+"), lambda w: w != "")


def stop_words(spark=None) -> dict[str, list[str]]:
    """Spark's stop words of the seven languages, from the lists of this package; no session is needed."""
    return {x: STOP_WORDS[n] for x, n in STOP_LISTS.items()}


def without_stop_words(words: Column, lang: Column, lists: dict[str, Iterable[str]]) -> Column:
    out = words
    for x, stop in lists.items():
        array = F.array(*[F.lit(w) for w in sorted(set(stop))])
        out = F.when(lang == x, F.filter(words, lambda w: ~F.array_contains(array, w))).otherwise(out)
    return out


def longer_than(words: Column, n: int = 2) -> Column:
    """Words of more than `n` characters: the bound itself does not suffice."""
    return F.filter(words, lambda w: F.length(w) > n)


def preprocess(c: Column, lang: Column, *, contractions: bool = True, accents: bool = False, stop: dict | None = None, stem: bool = False, least: int = 2) -> Column:
    """The aggressive pipeline; each option switches one step. Null gives the empty text."""
    c = F.trim(F.lower(F.coalesce(c, F.lit(""))))
    c = F.when(c.contains("<") & c.contains(">"), strip_markup(c)).otherwise(c)
    c = strip_contacts(c)
    if contractions:
        c = F.when(lang == "en", expand_contractions(c)).otherwise(c)
    if accents:
        c = without_accents(c)
    words = tokens(keep_language_letters(c, lang))
    if stop:
        words = without_stop_words(words, lang, stop)
    words = longer_than(words, least)
    if stem:
        from .stemming import stemmed

        words = stemmed(words, lang)
    return F.trim(F.array_join(words, " "))


def preview(c: Column, n: int = 100, mark: str = "...") -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(mark))).otherwise(c)


def is_ascii(c: Column) -> Column:
    return c.rlike(r"^[\x00-\x7F]*$")


def has_word(c: Column) -> Column:
    return F.coalesce(c.rlike(f"[{WORD}]"), F.lit(False))


def word_ids(words: Column, size: int = 250_000, first: int = 4) -> Column:
    """An id for each word by its hash, from `first` on: stands in where no tokenizer is at hand."""
    return F.transform(words, lambda w: (F.pmod(F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long"), F.lit(size)) + first).cast("int"))


def sequence(ids: Column, length: int, start: int = 0, end: int = 2, pad: int = 1) -> Column:
    """Fixed-length input of a model: `input_ids` (start, ids cut to fit, end, padding), `attention_mask`, and how many ids were `cut`; null counts as no ids."""
    ids = F.coalesce(ids, F.array().cast("array<int>"))
    kept = F.slice(ids, 1, length - 2)
    n = F.size(kept) + 2
    whole = F.concat(F.array(F.lit(start)), kept, F.array(F.lit(end)), F.array_repeat(F.lit(pad), F.lit(length) - n))
    mask = F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(length) - n))
    return F.struct(whole.alias("input_ids"), mask.alias("attention_mask"), (F.size(ids) + 2 - n).alias("cut"))
