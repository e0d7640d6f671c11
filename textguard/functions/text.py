"""Column expressions over text. All run in the JVM, but for the hashes of shingles."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from textguard.functions.kernels import run_hashes

# The code points that Python's str.strip() removes.
WHITESPACE_CODE_POINTS = [
    0x0009, 0x000A, 0x000B, 0x000C, 0x000D,
    0x001C, 0x001D, 0x001E, 0x001F, 0x0020,
    0x0085, 0x00A0, 0x1680,
    0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006, 0x2007, 0x2008, 0x2009, 0x200A,
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
]
WHITESPACE = "".join(map(chr, WHITESPACE_CODE_POINTS))

# Python's \w on str: letters, numbers and the underscore of every script.
WORD = r"[\p{L}\p{N}_]+"

# Label names of the verdict and of the judges.
ATTACK = "attack"
BENIGN = "benign"


def strip(text: Column) -> Column:
    """Unicode whitespace strip (plain ``trim`` removes only U+0020)."""
    return F.btrim(text, F.lit(WHITESPACE))


def words(text: Column) -> Column:
    """Lower-cased words in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def word_runs(text: Column, k: int = 5) -> Column:
    """All runs of k consecutive words, repeats included; all words as one run if there are fewer.

    One look-ahead scan over the space-joined words: at each word start it captures k words, or at
    the very start a text of fewer words up to its end.
    """
    joined = F.array_join(words(text), " ")
    run = (
        rf"(?<![^ ])(?=([^ ]++(?: [^ ]++){{{k - 1}}}"
        rf"|\A[^ ]*+(?: [^ ]++){{0,{max(k - 2, 0)}}}\z))[^ ]*+"
    )
    return F.regexp_extract_all(joined, F.lit(run), F.lit(1))


def shingles(text: Column, k: int = 5) -> Column:
    """Distinct k-word shingles of the lower-cased text.

    Fewer than k words give one shingle of all words, ``''`` when there is none.
    """
    return F.array_distinct(word_runs(text, k))


def hash60(text: Column) -> Column:
    """First 60 bits of the MD5 digest, as a non-negative BIGINT."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def shingle_hashes(text: Column, k: int = 5) -> Column:
    """Sorted distinct 60-bit hashes (``hash60``) of the shingles."""

    @F.arrow_udf("array<bigint>")
    def hashes(joined: pa.Array) -> pa.Array:
        return run_hashes(joined, k)

    return hashes(F.array_join(words(text), " "))


def text_key(text: Column) -> Column:
    """A 32-byte stand-in for a text of any length in shuffles."""
    return F.unhex(F.sha2(text, 256))


def order_key(key: Column, seed: int | str) -> Column:
    """Reproducible random order: 32 hex digits, uniform over rows for unique keys."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def unit_hash(key: Column, salt: str) -> Column:
    """Uniform number in [0, 1) from a key."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{salt}:"), key.cast("string"))), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / F.lit(4294967296.0)


def preview(text: Column, n: int) -> Column:
    """First n code points."""
    return F.left(text, F.lit(n))


def encode_label(name: Column) -> Column:
    """attack → 1, benign → 0, anything else → null."""
    return F.when(name == ATTACK, F.lit(1)).when(name == BENIGN, F.lit(0))


def decode_label(label: Column) -> Column:
    """1 → attack, any other label → benign."""
    return F.when(label == 1, F.lit(ATTACK)).otherwise(F.lit(BENIGN))
