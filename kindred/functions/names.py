"""Scalar functions over names: normalisation, Latin spelling, scripts, garbage, dates. All native, but for Unicode normal forms."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from kindred.functions import values as V

_SPACE = r"(?U)\s+"


def _normal_form(form: str):
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: "" if x is None else x if x.isascii() else unicodedata.normalize(form, x))

    return pandas_udf(run, T.StringType())


#: Spark has no Unicode normal forms; ASCII texts pass through.
nfkd, nfkc = _normal_form("NFKD"), _normal_form("NFKC")


def text(c: Column | str) -> Column:
    """Null as the empty string."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def safe_text(c: Column | str) -> Column:
    """Null as empty, trimmed, lower case."""
    return F.lower(trimmed(text(c)))


def safe_lower(c: Column | str) -> Column:
    return F.lower(text(c))


def collapse_spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, _SPACE, " "))


def remove_punctuation(c: Column) -> Column:
    """Whatever is no letter, number, underscore or white space becomes a space; combining marks too."""
    return F.regexp_replace(c, r"(?U)[^\p{L}\p{N}_\s]", " ")


def remove_digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\p{Nd}+", " ")


def normalize_unicode(c: Column | str, form: str = "NFKD") -> Column:
    return (nfkd if form == "NFKD" else nfkc)(text(c))


def normalize_text(c: Column | str, keep_digits: bool = False, mode: str = "compat") -> Column:
    """Decompose, lower-case, drop punctuation and digits, collapse spaces. ``mode='clean'`` drops combining marks without splitting the word there."""
    if keep_digits:  # the exploratory order: lower-case first, digits stay
        return collapse_spaces(remove_punctuation(nfkd(F.lower(text(c)))))
    plain = nfkd(text(c))
    if mode == "clean":
        plain = F.regexp_replace(plain, r"\p{M}+", "")
    return collapse_spaces(remove_digits(remove_punctuation(F.lower(plain))))


def tokens(c: Column | str) -> Column:
    """White-space tokens; none for null or blank."""
    return F.filter(F.split(text(c), _SPACE), lambda x: x != "")


def drop_tokens(c: Column | str, words: list[str]) -> Column:
    return F.array_join(F.filter(tokens(c), lambda x: ~x.isin(words)), " ")


def remove_legal_forms(c: Column | str) -> Column:
    return drop_tokens(c, V.LEGAL_FORMS_NORMALISATION)


def latin_spelling(c: Column) -> Column:
    """The table's spelling of each character: one ``translate`` for single letters and deletions, one ``replace`` for each longer spelling."""
    single = {k: v for k, v in V.LATIN.items() if len(v) == 1}
    gone = "".join(k for k, v in V.LATIN.items() if not v)
    c = F.translate(c, "".join(single) + gone, "".join(single.values()))
    for k, v in V.LATIN.items():
        if len(v) > 1:
            c = F.replace(c, F.lit(k), F.lit(v))
    return c


def transliterate(c: Column | str) -> Column:
    """Compose, spell in Latin, lower-case, drop apostrophes, collapse spaces. The table is looked up before lower-casing."""
    return collapse_spaces(F.translate(F.lower(latin_spelling(nfkc(text(c)))), "`'’", ""))


def detect_script(c: Column | str) -> Column:
    c = text(c)
    flags = {"cyrillic": r"[А-Яа-яЁё]", "latin": r"[A-Za-z]", "armenian": r"[԰-֏]", "georgian": r"[Ⴀ-ჿ]"}
    found = F.filter(F.array(*(F.when(c.rlike(p), F.lit(k)) for k, p in flags.items())), lambda x: x.isNotNull())
    return F.when(F.size(found) == 0, "unknown").when(F.size(found) > 1, "mixed").otherwise(F.get(found, F.lit(0)))


def detect_alphabet(c: Column | str) -> Column:
    """First match wins."""
    c = text(c)
    return F.when(c.rlike(r"[԰-֏]"), "Armenian").when(c.rlike(r"[Ѐ-ӿ]"), "Cyrillic").when(c.rlike(r"[A-Za-z]"), "Latin").otherwise("Other")


def is_garbage(c: Column | str) -> Column:
    """1 for null, blank or a garbage pattern, else 0."""
    low = safe_text(c)
    return ((low == "") | low.rlike("(?U)" + "|".join(V.GARBAGE_PATTERNS))).cast("int")


def normalize_quotes(c: Column | str) -> Column:
    return F.translate(text(c), V.APOSTROPHES_AND_QUOTES, "'" * len(V.APOSTROPHES_AND_QUOTES))


def normalize_dashes(c: Column | str) -> Column:
    return F.translate(text(c), V.DASHES, "-" * len(V.DASHES))


def normalize_separators(c: Column | str) -> Column:
    return F.regexp_replace(text(c), r"[|/\\_]+", " ")


def normalize_punctuation_soft(c: Column | str) -> Column:
    return F.translate(text(c), ".,;:()[]{}", " " * 10)


def name_profile(c: Column | str) -> dict[str, Column]:
    """Flags of the exploratory profile: all capitals, digits, special characters, initials."""
    c = text(c)
    return {
        "is_upper": (F.upper(c) == c) & (F.lower(c) != c),
        "has_digits": c.rlike(r"\d"),
        "has_special": c.rlike(r"(?U)[^\w\s]"),
        "has_initials": c.rlike(r"(?U)\b\p{L}\.\s*\p{L}\."),
    }


def mentions(c: Column | str, form: str) -> Column:
    """Whether a legal form, read as a pattern, is found anywhere, in any case."""
    return F.coalesce((F.col(c) if isinstance(c, str) else c).rlike(f"(?iu){form}"), F.lit(False))


_DATES = ["yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "dd.MM.yyyy", "yyyy/MM/dd"]


def parse_date(c: Column | str) -> Column:
    """The first format that fits, else null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(*(F.try_to_timestamp(c, F.lit(f)) for f in _DATES))


def parse_snapshot(c: Column | str, country: Column | str = "country") -> Column:
    """``parse_date``, and Unix seconds for rows of Tajikistan that it can't read."""
    c, country = (F.col(x) if isinstance(x, str) else x for x in (c, country))
    return F.coalesce(parse_date(c), F.when(country == "tjk", F.timestamp_seconds(c.try_cast("double"))))


def days_between(first: Column, last: Column) -> Column:
    """Whole days from first to last."""
    return F.floor((F.unix_micros(last.cast("timestamp")) - F.unix_micros(first.cast("timestamp"))) / 86_400_000_000)
