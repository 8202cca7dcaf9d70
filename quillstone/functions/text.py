"""Text functions as Column expressions; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed: a word is letters and digits, with one inner apostrophe at most.
WORD = r"[\p{L}\p{N}]+(?:'[\p{L}\p{N}]+)?"
#: Fixed: the characters that white-space splitting separates at.
BLANK = r"[\s\x1c-\x1f\x85\p{Z}]+"


def normalized_words(text: Column) -> Column:
    """Lower-cased words of a text."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def casefolded(text: Column) -> Column:
    """Full Unicode case folding: lower case, then what folds further (``ß`` to ``ss``, a final sigma, ligatures).

    The foldings are those of Python's ``str.casefold``.  Characters that become
    several are rare, so they are replaced only in texts that hold one.
    """
    further = {c: c.casefold() for c in map(chr, range(0x110000)) if not "\ud800" <= c <= "\udfff" and c == c.lower() != c.casefold()}
    single = {c: f for c, f in further.items() if len(f) == 1}
    several = {c: f for c, f in further.items() if len(f) > 1}
    low = F.translate(F.lower(text), "".join(single), "".join(single.values()))
    replaced = low
    for c, f in several.items():
        replaced = F.replace(replaced, F.lit(c), F.lit(f))
    return F.when(low.rlike(f"[{''.join(several)}]"), replaced).otherwise(low)


def folded_words(text: Column) -> Column:
    """Case-folded runs of letters, digits and underscores."""
    return F.regexp_extract_all(casefolded(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def raw_words(text: Column) -> Column:
    """What stands between white space."""
    return F.filter(F.split(text, BLANK, -1), lambda w: w != "")


def ngrams(words: Column, n: int) -> Column:
    """All runs of n words, joined by one space; none if there are fewer words."""
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def hash32(text: Column) -> Column:
    """The first eight hex digits of the MD5 digest, as a number: the same in any engine."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint")


def mean_length(words: Column) -> Column:
    """Mean characters of a word; 0 if there is none."""
    total = F.aggregate(words, F.lit(0), lambda s, w: s + F.char_length(w))
    return F.when(F.size(words) > 0, total / F.size(words)).otherwise(F.lit(0.0))


def share(part: Column, whole: Column) -> Column:
    return part / F.greatest(whole, F.lit(1))


def non_ascii_share(text: Column) -> Column:
    return share(F.char_length(F.regexp_replace(text, r"[\x00-\x7F]", "")), F.char_length(text))


def starts_share(items: Column, pattern: str) -> Column:
    return share(F.size(F.filter(items, lambda w: w.rlike(pattern))), F.size(items))


def lines(text: Column) -> Column:
    """Lines that are not blank."""
    return F.filter(F.split(text, "\n", -1), lambda x: F.regexp_replace(x, BLANK, "") != "")


def contains_phrase(words: Column, phrase: Column) -> Column:
    """Whether the phrase's words stand in a row; an empty phrase never does."""
    pad = lambda w: F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" "))
    return (F.size(phrase) > 0) & F.contains(pad(words), pad(phrase))


def last_number(text: Column) -> Column:
    """The last number of a text, commas dropped; null if there is none."""
    found = F.regexp_extract_all(F.replace(text, F.lit(","), F.lit("")), F.lit(r"-?\d+\.?\d*"), F.lit(0))
    return F.try_element_at(found, F.lit(-1)).cast("double")


def slug(text: Column) -> Column:
    """Lower case, runs of anything but letters and digits as one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
