"""Tokens, hashes and vectors of text as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: FNV-1a of 32 bits.
FNV_START, FNV_PRIME, MASK = 2166136261, 16777619, 4294967295
#: BM25 with a fixed mean length.
K1, B, MEAN_LENGTH = 1.4, 0.75, 80.0
#: Words that are no tokens.
STOP_WORDS = (
    "은", "는", "이", "가", "을", "를", "의", "에", "와", "과", "도", "로", "으로", "에서", "하다", "있는", "없는", "해주세요", "해줘", "보여줘", "알려줘", "주세요",
    "the", "a", "of", "and", "to", "in",
)


def grams(word: Column, n: int) -> Column:
    """Runs of ``n`` characters; none if the word is shorter."""
    last = F.length(word) - n + 1
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(word, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def tokens(text: Column, least: int = 2) -> Column:
    """Distinct lower-case words of letters and digits, in order, without short and stop words.

    A word with two Hangul syllables in a row also gives its runs of two and of three characters. Only texts with such
    words pay for looking at each word.
    """
    plain = F.array_except(F.regexp_extract_all(F.lower(text), F.lit(rf"[\p{{L}}\p{{N}}]{{{least},}}"), 0), F.array(*map(F.lit, STOP_WORDS)))
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), 0)
    none = F.array().cast("array<string>")
    own = lambda w: F.when((F.length(w) >= least) & ~w.isin(*STOP_WORDS), F.array(w)).otherwise(none)
    parts = lambda w: F.when(w.rlike("[가-힣]{2}"), F.concat(grams(w, 2), grams(w, 3))).otherwise(none)
    return F.when(text.rlike("[가-힣]{2}"), F.array_distinct(F.flatten(F.transform(words, lambda w: F.concat(own(w), parts(w)))))).otherwise(plain)


def term_frequency(listed: Column, token: str) -> Column:
    """How often a list of tokens holds ``token``."""
    return F.size(listed) - F.size(F.array_remove(listed, token))


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a of the characters' codes (those of one UTF-16 unit)."""
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(FNV_START).cast("long"), lambda h, c: (h.bitwiseXOR(c) * FNV_PRIME).bitwiseAND(MASK))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 if a vector is all zeros."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def length_weight(length: Column) -> Column:
    """What a document's length leaves of a matching token; falls as it grows."""
    return (K1 + 1) / (1 + K1 * (1 - B + B * length / MEAN_LENGTH))


def bm25_term(idf: Column, length: Column) -> Column:
    """Share of one matching token; tokens are distinct, so its frequency is 1."""
    return idf * length_weight(length)


def unit(a: Column) -> Column:
    """The vector with length 1; zeros stay zeros."""
    norm = F.sqrt(dot(a, a))
    return F.transform(a, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(0.0))


def _char(code: Column) -> Column:
    return F.decode(F.unhex(F.hex(code.cast("long"))), "UTF-16BE")


def jamo_parts(text: Column) -> Column:
    """Each character of a text: a Hangul syllable as its two or three jamo, others as they are."""

    def apart(c: Column) -> Column:
        at = F.ascii(c) - 0xAC00
        last = F.when(at % 28 > 0, _char(0x11A7 + at % 28)).otherwise("")
        return F.when(at.between(0, 0xD7A3 - 0xAC00), F.concat(_char(0x1100 + F.floor(at / 588)), _char(0x1161 + F.floor(at % 588 / 28)), last)).otherwise(c)

    return F.transform(F.split(text, ""), apart)


def jamo(text: Column) -> Column:
    """Hangul syllables as their two or three jamo; other characters as they are."""
    return F.array_join(jamo_parts(text), "")


def jamo_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(jamo(a), jamo(b))


def hash_embed(listed: Column, dim: int = 64) -> Column:
    """Tokens as a vector of length 1: each adds its sign at its hash and half of it at a second one; none give zeros."""
    zero = F.array_repeat(F.lit(0.0), dim)

    def places(t: Column) -> Column:
        h = fnv1a(t)
        return F.struct((h % dim).alias("at"), F.when(h % 2 == 0, 1.0).otherwise(-1.0).alias("sign"), (fnv1a(F.concat(t, F.lit("#"))) % dim).alias("also"))

    def add(sums: Column, p: Column) -> Column:
        return F.transform(sums, lambda v, i: v + F.when(i == p["at"], p["sign"]).otherwise(0.0) + F.when(i == p["also"], p["sign"] / 2).otherwise(0.0))

    sums = F.aggregate(F.transform(listed, places), zero, add)
    return F.aggregate(F.array(sums), zero, lambda _, s: F.transform(s, lambda v: F.coalesce(v / F.nullif(F.sqrt(dot(s, s)), F.lit(0.0)), F.lit(0.0))))
