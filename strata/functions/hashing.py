"""Term hashing as column expressions.

* ``murmur3``: MurmurHash3_x86_32, seed 42, with the legacy tail rule (each tail byte mixed
  as its own block).  Spark's built-in ``hash`` is exactly that function, with the same
  per-type rules (null -> seed, booleans/ints as 4 bytes, longs as 8, strings as UTF-8).
  One documented difference: ``hash`` maps -0.0 to the hash of 0.0.
* ``native``: the JVM ``String.hashCode`` (h = 31*h + c over UTF-16 code units, 32-bit wrap),
  computed with an array fold; integral values hash to themselves as 32-bit ints.

* ``standard``: MurmurHash3_x86_32 as published (the same but for strings whose UTF-8 length is
  no multiple of four), as Spark ML's own hashing transform has it.

Feature index = non-negative modulo of the signed 32-bit hash.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions._util import as_col, let

# Hash seed and default number of features of the hashing term-frequency transform.
MURMUR3_SEED = 42
DEFAULT_NUM_FEATURES = 1 << 20

_TWO_32 = 1 << 32
_TWO_31 = 1 << 31


def hash_murmur3(c) -> Column:
    """Signed 32-bit MurmurHash3_x86_32 (seed 42, legacy tail) of any supported scalar."""
    return F.hash(as_col(c))


def _utf16_units(s: Column) -> Column:
    """array<int> of UTF-16 code units of a string (surrogate pairs for code points > 0xFFFF)."""
    cps = F.transform(F.split(s, ""), lambda ch: F.ascii(ch).cast("long"))
    cps = F.filter(cps, lambda cp: cp >= 0)
    units = F.transform(
        cps,
        lambda cp: F.when(cp <= 0xFFFF, F.array(cp)).otherwise(
            F.array(
                F.lit(0xD800) + F.shiftright(cp - 0x10000, 10),
                F.lit(0xDC00) + F.pmod(cp - 0x10000, F.lit(0x400)),
            )
        ),
    )
    return F.flatten(units)


def hash_native(c, dtype: T.DataType | None = None) -> Column:
    """Signed 32-bit JVM hash code. Strings by default; pass ``dtype`` for integral input."""
    col = as_col(c)
    if dtype is not None and isinstance(dtype, (T.IntegerType, T.ShortType, T.ByteType)):
        return col.cast("int")
    if dtype is not None and isinstance(dtype, T.LongType):
        # Long.hashCode = (int)(v ^ (v >>> 32)); a value that fits an int hashes to itself.
        folded = F.pmod(col.bitwiseXOR(F.shiftrightunsigned(col, 32)), F.lit(_TWO_32))
        signed = let(folded, lambda f: F.when(f >= _TWO_31, f - _TWO_32).otherwise(f))
        return F.when(col.between(-_TWO_31, _TWO_31 - 1), col).otherwise(signed).cast("int")
    if dtype is not None and not isinstance(dtype, T.StringType):
        raise TypeError(f"native hash supports string and integral input, not {dtype.simpleString()}")
    unsigned = F.aggregate(
        _utf16_units(col),
        F.lit(0).cast("long"),
        lambda acc, u: F.pmod(acc * 31 + u, F.lit(_TWO_32)),
    )
    signed = let(unsigned, lambda u: F.when(u >= _TWO_31, u - _TWO_32).otherwise(u))
    return F.when(col.isNull(), F.lit(0)).otherwise(signed).cast("int")


def hash_standard(c) -> Column:
    """Signed 32-bit MurmurHash3_x86_32 (seed 42) of a string as published, which treats the bytes after
    the last whole block as one; null hashes to the seed.  Spark SQL has no such function, so it
    is an Arrow one."""
    from strata.functions import counting

    def hashed(batch: pa.Array) -> pa.Array:
        h = pa.array(counting.murmur3_standard(batch.fill_null("")), pa.int32())
        return pc.if_else(batch.is_null(), pa.scalar(MURMUR3_SEED, pa.int32()), h)

    hashed.__annotations__ = {"batch": pa.Array, "return": pa.Array}
    return F.arrow_udf(hashed, "int")(as_col(c))


def non_negative_mod(h: Column, n: int) -> Column:
    return F.pmod(h.cast("long"), F.lit(int(n))).cast("int")


def hash_index(c, num_features: int = DEFAULT_NUM_FEATURES, algo: str = "murmur3") -> Column:
    """Feature index of a term: non-negative ``hash mod num_features``."""
    if num_features <= 0:
        raise ValueError("num_features must be positive")
    if algo == "murmur3":
        h = hash_murmur3(c)
    elif algo == "native":
        h = hash_native(c)
    elif algo == "standard":
        h = hash_standard(c)
    else:
        raise ValueError(f"unknown hash algorithm {algo!r}; use 'murmur3', 'native' or 'standard'")
    return non_negative_mod(h, num_features)


def uniform(seed: int, *cols) -> Column:
    """A number of [0, 1) drawn from ``seed`` and the columns' text: 52 bits of an MD5, so a row keeps
    its draw on any partitioning, after a lost task, and in any SQL that has MD5."""
    drawn = F.md5(F.concat_ws(":", F.lit(str(int(seed))), *[as_col(c).cast("string") for c in cols]).cast("binary"))
    return F.conv(F.substring(drawn, 1, 13), 16, 10).cast("double") / float(1 << 52)
