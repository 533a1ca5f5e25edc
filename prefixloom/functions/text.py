"""Text normalisers, tokenisers and hashes as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as the loose normaliser understands it
# (Unicode White_Space plus the four ASCII separators 0x1c-0x1f).
WHITESPACE = r"(?U)[\s\x1c-\x1f]+"
# Fixed value: a run of letters/digits, or one other non-blank character.
WORD_OR_MARK = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_strict(c: Column | str) -> Column:
    """Lower-case ASCII letters and digits, everything else one space; null is ''."""
    low = F.lower(F.coalesce(col(c), F.lit("")))
    return F.trim(F.regexp_replace(low, "[^a-z0-9]+", " "))


def normalize_loose(c: Column | str) -> Column:
    """Lower case with whitespace runs collapsed; null is ''."""
    low = F.lower(F.coalesce(col(c), F.lit("")))
    return F.trim(F.regexp_replace(low, WHITESPACE, " "))


def clean_query(c: Column | str) -> Column:
    """Loose normalisation, then only a-z, 0-9, space and hyphen are kept."""
    return F.trim(F.regexp_replace(normalize_loose(c), r"[^a-z0-9 \-]", ""))


def tokenize(c: Column | str) -> Column:
    """Blank-separated tokens; '' gives an empty array."""
    return F.filter(F.split(col(c), " "), lambda t: t != "")


def tokenize_words(c: Column | str) -> Column:
    """Lower-cased words and single punctuation marks."""
    return F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit(WORD_OR_MARK), F.lit(0))


def char_trigrams(c: Column | str) -> Column:
    """Distinct trigrams of the text without blanks; texts under 3 chars are one gram.

    The lookahead yields every overlapping window in one pass, so long texts
    stay linear (indexing each window with substring would be quadratic).
    """
    text = F.replace(col(c), F.lit(" "), F.lit(""))
    windows = F.regexp_extract_all(text, F.lit("(?s)(?=(.{3}))"), F.lit(1))
    return F.when(F.length(text) < 3, F.array(text)).otherwise(F.array_distinct(windows))


def gram_codes(grams: Column) -> Column:
    """Grams of strictly normalised text as integers, one per distinct gram.

    Such text is ASCII, so three characters fill three bytes; integer sets are
    smaller to shuffle and much faster to intersect than strings.
    """
    return F.transform(
        grams,
        lambda g: F.ascii(g) * 65536 + F.ascii(F.substring(g, 2, 1)) * 256 + F.ascii(F.substring(g, 3, 1)),
    )


def block_key(c: Column | str) -> Column:
    """First three characters of the lower-cased text."""
    return F.substring(F.lower(col(c)), 1, 3)


def hash_text(*cols: Column | str, seed: int = 0) -> Column:
    """Hash of the columns that does not depend on partitioning, as hex text."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[col(c).cast("string") for c in cols]))


def stable_hash(*cols: Column | str, seed: int = 0) -> Column:
    """The first 60 bits of ``hash_text`` as a number; used for samples and splits."""
    return F.conv(F.substring(hash_text(*cols, seed=seed), 1, 15), 16, 10).cast("bigint")


def leading_edges(c: Column | str, max_len: int) -> Column:
    """Leading substrings of length 1..max_len; '' gives an empty array."""
    text = col(c)
    top = F.least(F.length(text), F.lit(max_len))
    return F.when(
        F.length(text) > 0,
        F.transform(F.sequence(F.lit(1), top), lambda i: F.substring(text, F.lit(1), i)),
    ).otherwise(F.array().cast("array<string>"))


LOW32 = 0xFFFFFFFF


def _with(x: Column, then: Callable[[Column], Column]) -> Column:
    """then(x), where x is computed once however often ``then`` names it."""
    return F.element_at(F.transform(F.array(x), then), 1)


def _times(x: Column, factor: int) -> Column:
    """The low 32 bits of x * factor, x below 2^32; the halves of x keep the products within 63 bits."""
    def product(v: Column) -> Column:
        low = v.bitwiseAND(F.lit(0xFFFF)) * F.lit(factor)
        high = F.shiftleft((F.shiftright(v, 16) * F.lit(factor)).bitwiseAND(F.lit(0xFFFF)), 16)
        return (low + high).bitwiseAND(F.lit(LOW32))

    return _with(x, product)


def _rotated(x: Column, by: int) -> Column:
    return _with(x, lambda v: F.shiftleft(v, by).bitwiseAND(F.lit(LOW32)).bitwiseOR(F.shiftright(v, 32 - by)))


def _mixed(block: Column) -> Column:
    # fixed values: multipliers and rotation of MurmurHash3 (public domain)
    return _times(_rotated(_times(block, 0xCC9E2D51), 15), 0x1B873593)


def murmur3(c: Column | str, seed: int = 0) -> Column:
    """MurmurHash3 x86 32 of the text's UTF-8 bytes, as the signed number (bigint) that feature hashers use.

    Spark's own ``hash`` treats the last one to three bytes in another way. Null gives null.
    """
    def number(eight: Column) -> Column:
        """Four bytes in hex, least first."""
        return F.conv(F.concat(*[F.substring(eight, i, 2) for i in (7, 5, 3, 1)]), 16, 10).cast("bigint")

    def step(h: Column, eight: Column) -> Column:
        h = _rotated(h.bitwiseXOR(_mixed(number(eight))), 13)
        return (h * 5 + F.lit(0xE6546B64)).bitwiseAND(F.lit(LOW32))

    def shifted(h: Column, by: int) -> Column:
        return _with(h, lambda v: v.bitwiseXOR(F.shiftright(v, by)))

    def of(digits: Column) -> Column:
        n = F.length(digits)
        h = F.aggregate(F.regexp_extract_all(digits, F.lit("(.{8})")), F.lit(seed).cast("bigint"), step)
        rest = F.rpad(F.substring(digits, n - n % 8 + 1, F.lit(8)), 8, "0")
        h = h.bitwiseXOR(_mixed(number(rest))).bitwiseXOR(F.shiftright(n, 1).cast("bigint"))
        # fixed values: the final mix
        h = _times(shifted(h, 16), 0x85EBCA6B)
        h = shifted(_times(shifted(h, 13), 0xC2B2AE35), 16)
        return _with(h, lambda v: F.when(v >= 1 << 31, v - (1 << 32)).otherwise(v))

    return _with(F.hex(F.encode(col(c), "UTF-8")), of)
