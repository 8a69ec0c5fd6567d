"""Text normalisation as Column expressions.

The primary view keeps all scripts: NFKC, casefold, letters, marks and numbers only, one space between
tokens. Only the first two steps have no built-in counterpart; they run as one Arrow function, and
ASCII texts skip it.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

# Expansions of legal forms in names, by country.
LEGAL_FORMS = {
    "US": {"corp": "corporation", "inc": "incorporated", "corp.": "corporation", "llc": "limited liability company", "llp": "limited liability partnership", "co": "company", "ltd": "limited", "pvt": "private", "mfg": "manufacturing", "ent": "enterprises", "dba": "doing business as"},
    "India": {"pvt": "private", "ltd": "limited", "mfg": "manufacturing", "ent": "enterprises", "co": "company", "dba": "doing business as"},
    "France": {"sarl": "societe responsabilite limitee", "sas": "societe actions simplifiee", "sasu": "societe actions simplifiee unipersonnelle", "sa": "societe anonyme", "eurl": "entreprise unipersonnelle", "ets": "etablissements", "ste": "societe"},
    "__default__": {"pvt": "private", "ltd": "limited", "co": "company", "corp": "corporation", "inc": "incorporated", "dba": "doing business as"},
}
# Expansions of street and unit words in addresses, by country.
STREET_WORDS = {
    "US": {"rd": "road", "st": "street", "ave": "avenue", "blvd": "boulevard", "ste": "suite", "apt": "apartment", "dr": "drive", "hwy": "highway", "bldg": "building"},
    "India": {"rd": "road", "st": "street", "nagar": "nagar", "marg": "marg", "bldg": "building"},
    "France": {"rue": "rue", "bd": "boulevard", "av": "avenue", "pl": "place", "imp": "impasse", "cedex": "cedex", "ste": "suite"},
    "__default__": {"rd": "road", "st": "street", "ave": "avenue", "bldg": "building"},
}
# Phrases that a name's core does not end in.
LEGAL_SUFFIXES = ("corporation", "incorporated", "private", "limited", "company", "limited liability company", "limited liability partnership", "societe", "societe responsabilite limitee", "societe actions simplifiee", "societe anonyme", "entreprise unipersonnelle", "etablissements", "gmbh")
# Patterns of the primary view (a polite form before a name, a trade-name mark, dotted initials) and of units.
POLITE = r"^(m\s*/\s*s|m\s*\.\s*s)\.?\s+"
TRADE_MARK = r"(?<![\p{L}\p{N}_])d\s*/\s*b\s*/\s*a(?![\p{L}\p{N}_])"
INITIAL = r"(?<![\p{L}\p{N}_])([a-z])\.(?=[a-z](?![\p{L}\p{N}_])|\s|[a-z]\.|$)"
UNIT = r"(?i)(?<![\p{L}\p{Nd}_])(?:suite|ste|apt|unit|floor|fl|bldg|building)\s+([A-Za-z0-9\-/]+)"
# What counts as a missing field.
MISSING = ("", "nan", "none", "null", "-", "n/a", "na")


@F.pandas_udf(T.StringType())
def _folded(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).casefold())


@F.pandas_udf(T.StringType())
def _latin(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)).encode("ascii", "ignore").decode())


def _ascii(x: Column) -> Column:
    return ~x.rlike(r"[^\x00-\x7F]")


def fold(x: Column) -> Column:
    """NFKC and casefold."""
    return F.when(_ascii(x), F.lower(x)).otherwise(_folded(x))


def collapse(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def keep_letters(x: Column) -> Column:
    """Letters, marks, numbers and spaces; an ampersand is a word, all else a space."""
    return F.regexp_replace(F.replace(x, F.lit("&"), F.lit(" and ")), r"[^\p{L}\p{M}\p{N} ]", " ")


def unicode_view(x: Column) -> Column:
    """The primary view of a text."""
    y = F.replace(fold(F.coalesce(x, F.lit(""))), F.lit("&"), F.lit(" and "))
    y = F.regexp_replace(y, POLITE, "")
    y = F.regexp_replace(y, TRADE_MARK, "dba")
    y = F.regexp_replace(y, INITIAL, "$1")
    return collapse(keep_letters(y))


def latin_view(x: Column) -> Column:
    """The accent-folded view; empty where nothing is Latin."""
    y = F.coalesce(x, F.lit(""))
    return unicode_view(F.when(_ascii(y), y).otherwise(_latin(y)))


def _table(words: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(v) for pair in words.items() for v in pair])


def expand(x: Column, words: Mapping[str, str]) -> Column:
    """Each token by its entry; entries may have several words."""
    table = _table(words)
    return F.array_join(F.transform(F.split(x, " "), lambda t: F.coalesce(table[t], t)), " ")


def expand_by_country(x: Column, country: Column, tables: Mapping[str, Mapping[str, str]]) -> Column:
    out = expand(x, tables["__default__"])
    for name in (n for n in tables if n != "__default__"):
        out = F.when(country == name, expand(x, tables[name])).otherwise(out)
    return out


def name_view(x: Column, country: Column, latin: bool = False) -> Column:
    return expand_by_country(latin_view(x) if latin else unicode_view(x), country, LEGAL_FORMS)


def address_view(x: Column, country: Column, latin: bool = False) -> Column:
    return expand_by_country(latin_view(x) if latin else unicode_view(x), country, STREET_WORDS)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def name_core(x: Column) -> Column:
    """A normalised name without the legal phrases it ends in, the longest first; may be empty.

    Only the legal words at the end are looked at, from the end on: time is linear in the name.
    """
    words = sorted({w for p in LEGAL_SUFFIXES for w in p.split(" ")})
    longest = max(p.count(" ") + 1 for p in LEGAL_SUFFIXES)
    by_length = {n: [p for p in LEGAL_SUFFIXES if p.count(" ") + 1 == n] for n in range(longest, 0, -1)}

    def drop(t: Column, end: Column) -> Column:
        """Where the name ends once the phrase before ``end`` has gone."""
        out = end
        for n in range(1, longest + 1):
            if by_length[n]:
                ending = F.concat_ws(" ", *[F.get(t, end - n + i) for i in range(n)])
                out = F.when((end >= n) & ending.isin(by_length[n]), end - n).otherwise(out)
        return out

    def core(t: Column) -> Column:
        other = F.array_max(F.transform(t, lambda w, i: F.when(w.isin(words), -1).otherwise(i)))
        tail = F.size(t) - 1 - other
        steps = F.when(tail > 0, F.sequence(F.lit(1), tail)).otherwise(F.array().cast("array<int>"))
        end = F.aggregate(steps, F.size(t), lambda end, _: drop(t, end))
        return F.array_join(F.slice(t, F.lit(1), end), " ")

    return F.when(x == "", "").otherwise(let(F.split(x, " "), core))


def is_missing(x: Column, words: tuple[str, ...] = MISSING) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(x, F.lit("")), r"^\s+|\s+$", "")).isin(*words)


def is_blank(x: Column) -> Column:
    return F.length(F.trim(F.coalesce(x, F.lit("")))) == 0


def scripts(x: Column) -> Column:
    return F.struct(x.rlike(r"\p{IsLatin}").alias("has_latin"), x.rlike(r"[\p{L}&&[^\p{IsLatin}]]").alias("has_nonlatin"), x.rlike(r"\p{M}").alias("has_mark"))


def postal_codes(x: Column) -> Column:
    """Runs of five or six digits, in order."""
    return F.regexp_extract_all(x, F.lit(r"(?<!\p{Nd})(\p{Nd}{5,6})(?!\p{Nd})"), F.lit(1))


def house_numbers(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(r"(?<![\p{L}\p{Nd}_])(\p{Nd}{1,6}[A-Za-z]?)(?![\p{L}\p{Nd}_])"), F.lit(1))


def unit_numbers(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(UNIT), F.lit(1))


def numbers(address: Column) -> Column:
    postal = postal_codes(address)
    return F.struct(postal.alias("postal_candidates"), (F.size(postal) == 1).alias("pin_confident"), house_numbers(address).alias("house_tokens"), unit_numbers(address).alias("unit_tokens"), address.alias("raw"))


def country_key(country: Column) -> Column:
    """The country as it is written, trimmed; ``__default__`` if there is none. Countries without tables have the default ones."""
    y = F.trim(F.coalesce(country, F.lit("")))
    return F.when(y == "", "__default__").otherwise(y)


def normalized(name: Column, address: Column, country: Column) -> Column:
    """All views of a record in one struct."""
    n, a, c = F.coalesce(name, F.lit("")), F.coalesce(address, F.lit("")), country_key(country)
    nv, av = name_view(n, c), address_view(a, c)
    nl, al = name_view(n, c, latin=True), address_view(a, c, latin=True)
    return F.struct(
        n.alias("name_raw"), a.alias("address_raw"), F.coalesce(country, F.lit("")).alias("country_raw"), c.alias("country_key"),
        nv.alias("name"), av.alias("address"), nl.alias("name_latin"), al.alias("address_latin"),
        name_core(nv).alias("name_core"), F.replace(nv, F.lit(" "), F.lit("")).alias("name_compact"),
        F.struct(is_missing(n).alias("name_missing"), is_missing(a).alias("address_missing")).alias("field_missing"),
        F.struct((is_blank(nv) & ~is_missing(n)).alias("unicode_empty"), (is_blank(nl) & ~is_blank(nv)).alias("latin_empty")).alias("normalization_loss"),
        F.struct(scripts(n).alias("name"), scripts(a).alias("address")).alias("script"), numbers(a).alias("numbers"),
    )


def normalized_once(rows: DataFrame, key: str, name: str = "name", address: str = "address", country: str = "country") -> DataFrame:
    """``key`` and rec, all views of a record: one row an id, to be written or joined by it. Of repeated ids the smallest record stays."""
    parts = F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in (name, address, country)])
    one = rows.groupBy(key).agg(F.min(parts).alias("_r"))
    return one.select(key, normalized(F.col("_r").getField(name), F.col("_r").getField(address), F.col("_r").getField(country)).alias("rec"))


def search_ascii(x: Column, words: Mapping[str, str] | None = None) -> Column:
    """The search view: Latin only, web suffixes and trailing numbers gone, digits read as letters within words."""
    y = F.lower(_latin(F.coalesce(x, F.lit(""))))
    y = F.regexp_replace(y, r"\.(com|org|net|co|in|biz|info)\b", "")
    y = F.regexp_replace(y, r"\s*-\s*\d+\s*$", "")
    y = F.regexp_replace(F.regexp_replace(y, r"(?<=[a-z])1(?=[a-z])", "l"), r"(?<=[a-z])0(?=[a-z])", "o")
    y = collapse(F.regexp_replace(y, r"[^a-z0-9 ]", " "))
    return expand(y, words) if words else y


def loose_view(x: Column, words: Mapping[str, str] | None = None) -> Column:
    """Casefolded words of any script, marks dropped with the punctuation, each by its entry in one merged table."""
    merged = {k: v for table in (LEGAL_FORMS, STREET_WORDS) for c in ("US", "India", "France") for k, v in table[c].items()}
    y = collapse(F.regexp_replace(fold(F.coalesce(x, F.lit(""))), r"[^\p{L}\p{Nd}_\s]", " "))
    return expand(y, words or merged)


def plain_ascii_view(x: Column, words: Mapping[str, str] | None = None) -> Column:
    """Accent-folded lower-case ASCII words, each by its entry in a small table."""
    y = collapse(F.regexp_replace(F.lower(_latin(F.coalesce(x, F.lit("")))), r"[^a-z0-9\s]", " "))
    return expand(y, words or LEGAL_FORMS["__default__"])


def first_postal(x: Column) -> Column:
    return F.regexp_extract(F.coalesce(x, F.lit("")), r"(?<!\p{Nd})(\p{Nd}{5,6})(?!\p{Nd})", 1)


def suffix_match(a: Column, b: Column, suffixes: tuple[str, ...] = LEGAL_SUFFIXES) -> Column:
    """1 if both or neither name ends in a legal word; 0 if either is empty."""
    ends = lambda x: F.element_at(F.split(x, " "), -1).isin(*suffixes)
    return F.when((a == "") | (b == ""), 0).otherwise((ends(a) == ends(b)).cast("int"))


# The digit of each consonant; a dot drops the letter.
_SOUNDS = ("abcdefghijklmnopqrstuvwxyz", ".123.12..22455.12623.1.2.2")


def soundex(x: Column) -> Column:
    """First letter and three digits; runs collapse after the vowels are dropped. Empty without letters."""
    letters = F.regexp_replace(F.lower(x), r"[^a-z]", "")
    digits = F.replace(F.translate(F.substring(letters, 2, 1_000_000), *_SOUNDS), F.lit("."), F.lit(""))
    code = F.concat(F.upper(F.substring(letters, 1, 1)), F.regexp_replace(digits, r"(\d)\1+", "$1"))
    return F.when(letters == "", "").otherwise(F.substring(F.rpad(code, 4, "0"), 1, 4))


def channel_text(name: Column, address: Column, mode: str) -> Column:
    if mode == "name_only":
        return name
    if mode == "address_only":
        return address
    if mode == "joint":
        return F.trim(F.concat_ws(" ", name, name, address))
    raise ValueError(f"unknown channel {mode!r}")


def search_text(name: Column, address: Column, country: Column) -> Column:
    """What blocking searches by country: the name twice, and of the address in the US only the first five tokens."""
    short = F.array_join(F.slice(F.split(address, " "), 1, 5), " ")
    return F.trim(F.concat_ws(" ", name, name, F.when(country == "US", short).otherwise(address)))


def pair_text(name: Column, address: Column, country: Column | None = None) -> Column:
    return F.concat_ws(" [SEP] ", name, address) if country is None else F.concat_ws(" | ", F.trim(name), F.trim(address), F.trim(country))
