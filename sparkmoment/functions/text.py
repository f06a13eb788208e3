"""Text folding and tokenising on string columns."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, functions as F, types as T


@lru_cache(maxsize=1)
def fold_table() -> tuple[str, str]:
    """Accented small Latin letters and the letters they stand on, for ``translate``; made from the Unicode tables."""
    src, dst = "đ", "d"
    for cp in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        ch = chr(cp)
        plain = unicodedata.normalize("NFD", ch)[0]
        if ch == ch.lower() and plain != ch and plain.isascii():
            src, dst = src + ch, dst + plain
    return src, dst


def fold(c: Column) -> Column:
    """Lower case without accents, đ as d; free combining marks are dropped."""
    src, dst = fold_table()
    return F.translate(F.regexp_replace(F.lower(c), r"\p{Mn}", ""), src, dst)


FOLD_SQL = "translate(regexp_replace(lower({0}), '\\p{{Mn}}', '', 'g'), '%s', '%s')" % fold_table()


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Composed form. The only step here that Spark has no expression for; Arrow batches, one call per column."""
    return s.str.normalize("NFC")


def tokens(c: Column) -> Column:
    """Lower-case words of letters, digits and _; accents are kept. Null gives an empty array."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


TOKENS_SQL = "list_filter(string_split_regex(regexp_replace(lower(coalesce({0}, '')), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+'), lambda w: w <> '')"


# Spellings of speech recognition and the form that stands for them, as whole words of folded text.
LONDON = ("luan don", "luan dom", "london")
SPEECH_FORMS = {"oong": "ung", "aang": "ang", "eeng": "eng", "gi": "di", "gh": "g", "kh": "k", "ngh": "ng", "nh": "n", "ph": "f", "th": "t", "ch": "c"}


def speech_tokens(c: Column) -> Column:
    """Folded words of a transcript, in which each spelling of SPEECH_FORMS and LONDON has one form. Null gives an empty array."""
    plain = F.trim(F.regexp_replace(fold(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))
    plain = F.regexp_replace(plain, r"\bluan +do[mn]\b", "london")
    forms = F.create_map(*(F.lit(x) for pair in SPEECH_FORMS.items() for x in pair))
    words = F.filter(F.split(plain, " "), lambda w: w != "")
    return F.transform(words, lambda w: F.coalesce(F.element_at(forms, w), w))


def speech_words(text: str) -> list[str]:
    """As ``speech_tokens`` for a query's text."""
    src, dst = fold_table()
    low = "".join(c for c in unicodedata.normalize("NFC", text).lower() if unicodedata.category(c) != "Mn").translate(str.maketrans(src, dst))
    plain = re.sub(r"\bluan +do[mn]\b", "london", re.sub("[^a-z0-9]+", " ", low))
    return [SPEECH_FORMS.get(w, w) for w in plain.split()]


_FORMS_SQL = "CASE w " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in SPEECH_FORMS.items()) + " ELSE w END"
SPEECH_SQL = "list_transform(list_filter(string_split(regexp_replace(trim(regexp_replace(" + FOLD_SQL.replace("{0}", "coalesce({0}, '')") + ", '[^a-z0-9]+', ' ', 'g')), '\\bluan +do[mn]\\b', 'london', 'g'), ' '), lambda w: w <> ''), lambda w: " + _FORMS_SQL + ")"


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalize_answer(c: Column) -> Column:
    """Lower case, single blanks, no punctuation or blanks at the ends; accents are kept."""
    return F.regexp_replace(squeeze(F.lower(c)), r"^[\s\p{P}]+|[\s\p{P}]+$", "")


NORMALIZE_SQL = "regexp_replace(trim(regexp_replace(lower({0}), '\\s+', ' ', 'g')), '^[\\s\\p{{P}}]+|[\\s\\p{{P}}]+$', '', 'g')"


def has_word(text_tokens: Column, word: str) -> Column:
    return F.array_contains(text_tokens, word)


def format_timestamp(seconds: Column) -> Column:
    """HH:MM:SS.mmm; negative and null times are zero, milliseconds are rounded half-even and carried."""
    ms = F.bround(F.greatest(F.coalesce(seconds, F.lit(0.0)), F.lit(0.0)) * 1000).cast("bigint")
    part = lambda div, mod: (F.floor(ms / div) % mod).cast("int")
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3_600_000).cast("int"), part(60_000, 60), part(1000, 60), (ms % 1000).cast("int"))
