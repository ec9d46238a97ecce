"""Likeness of 64-bit hashes and of vectors, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 64
# Where the likeness of embeddings starts, and what a shared genre adds.
EMBEDDING_FLOOR, SAME_GENRE = 0.55, 0.12


def hash_from_hex(text: Column) -> Column:
    """16 hexadecimal digits as a signed long; null for anything else."""
    return F.when(text.rlike("^[0-9a-fA-F]{1,16}$"), F.conv(text, 16, -10).cast("long"))


def hamming(a: Column, b: Column) -> Column:
    """Bits in which two hashes differ; 64 if one is missing."""
    return F.coalesce(F.bit_count(a.bitwiseXOR(b)).cast("long"), F.lit(HASH_BITS).cast("long"))


def hamming_hex(a: Column, b: Column) -> Column:
    """The same for texts; 64 for empty, unequally long or foreign ones."""
    return F.when(F.length(a) == F.length(b), hamming(hash_from_hex(a), hash_from_hex(b))).otherwise(F.lit(HASH_BITS).cast("long"))


def sign_code(vector: Column, bits: int = HASH_BITS) -> Column:
    """The signs of a vector's first dimensions as the bits of a long."""
    terms = [F.when(vector[i] > 0, F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")) for i in range(bits)]
    out = terms[0]
    for t in terms[1:]:
        out = out.bitwiseOR(t)
    return out


def hash_likeness(a: Column, b: Column) -> Column:
    return F.bround(1 - hamming(a, b) / F.lit(float(HASH_BITS)), 4)


def visual_likeness(a: Column, b: Column, same_genre: Column) -> Column:
    return F.bround(F.least(F.lit(1.0), hash_likeness(a, b) + F.when(same_genre, SAME_GENRE).otherwise(0.0)), 4)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is empty or zero or the lengths differ."""
    value = F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), F.coalesce(value, F.lit(0.0))).otherwise(F.lit(0.0))


def embedding_likeness(cos: Column, same_genre: Column) -> Column:
    """Cosines from EMBEDDING_FLOOR to 1 as 0 to 1, a shared genre's addition, at most 1, 4 places."""
    base = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (cos - EMBEDDING_FLOOR) / (1 - EMBEDDING_FLOOR)))
    return F.bround(F.least(F.lit(1.0), base + F.when(same_genre, SAME_GENRE).otherwise(0.0)), 4)
