"""Embeddings as ``.npy`` blobs: decoding and encoding of binary columns.

Both ways are native expressions over the hexadecimal form of the bytes: no Python
worker opens a blob.  Numbers are put together from sign, exponent and fraction, which
is exact for every value, subnormal numbers and infinities included.

Read: versions 1 to 3, real numbers of 4 or 8 bytes in either byte order, any shape (its
numbers in the order stored).  Anything else, a blob cut short or longer than its shape
says, NULL and no blob at all give NULL.  Written: version 1, one dimension, ``<f4``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._col import as_col, let

# Fixed values of the format.
MAGIC = "934E554D5059"
DESCR = r"'descr'\s*:\s*'([<>=])f([48])'"
SHAPE = r"'shape'\s*:\s*\(([0-9, ]*)\)"
ALIGN = 64


def _hex_number(digits: Column) -> Column:
    """Up to eight hexadecimal digits as a long."""
    return F.conv(digits, 16, 10).cast("long")


def _little(digits: Column) -> Column:
    """The digits with their bytes in reverse order."""
    return F.array_join(F.reverse(F.regexp_extract_all(digits, F.lit("(..)"), F.lit(1))), "")


def _value(sign: Column, exponent: Column, fraction: Column, bits: int, top: int, bias: int) -> Column:
    """A number of IEEE 754 with ``bits`` bits of fraction and the greatest exponent ``top``."""
    size = (F.when(exponent == top, F.when(fraction == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan"))))
            .when(exponent == 0, fraction * F.pow(F.lit(2.0), F.lit(1.0 - bias - bits)))
            .otherwise((fraction + 2 ** bits) * F.pow(F.lit(2.0), exponent - (bias + bits))))
    return F.when(sign == 1, -size).otherwise(size)


def _single(digits: Column) -> Column:
    return let(_hex_number(digits), lambda b: _value(F.shiftright(b, 31), F.shiftright(b, 23).bitwiseAND(F.lit(0xFF)), b.bitwiseAND(F.lit(0x7FFFFF)), 23, 255, 127))


def _double(digits: Column) -> Column:
    halves = F.struct(_hex_number(F.substring(digits, 1, 8)).alias("hi"), _hex_number(F.substring(digits, 9, 8)).alias("lo"))
    return let(halves, lambda b: _value(F.shiftright(b["hi"], 31), F.shiftright(b["hi"], 20).bitwiseAND(F.lit(0x7FF)),
                                        b["hi"].bitwiseAND(F.lit(0xFFFFF)) * F.lit(2 ** 32) + b["lo"], 52, 2047, 1023))


def npy_to_array(blob) -> Column:
    """``array<double>`` of a ``.npy`` blob."""
    def numbers(x):
        digits = F.regexp_extract_all(x["data"], F.lit("(.{16})"), F.lit(1))
        singles = F.regexp_extract_all(x["data"], F.lit("(.{8})"), F.lit(1))
        ordered = lambda d: F.when(x["order"] == ">", d).otherwise(_little(d))
        dims = F.transform(F.regexp_extract_all(x["shape"], F.lit("([0-9]+)"), F.lit(1)), lambda s: s.try_cast("long"))
        count = F.aggregate(dims, F.lit(1).cast("long"), lambda a, d: a * d)
        out = F.when(x["size"] == "4", F.transform(singles, lambda d: let(ordered(d), _single))).otherwise(
            F.transform(digits, lambda d: let(ordered(d), _double)))
        return F.when((x["size"] != "") & x["shaped"] & (F.length(x["data"]) == count * 2 * x["size"].try_cast("int")), out)

    def header(h):
        # the header's length: two bytes in version 1, four in later ones
        wide = F.when(F.substring(h, 13, 2) == "01", 4).otherwise(8)
        length = F.when(F.substring(h, 13, 2) == "01", _hex_number(_little(F.substring(h, 17, 4)))).otherwise(_hex_number(_little(F.substring(h, 17, 8))))
        return let(F.struct((wide + 17).alias("at"), F.least(length, F.lit(2 ** 20)).cast("int").alias("n")), lambda p: let(
            F.struct(F.decode(F.unhex(F.substring(h, p["at"], p["n"] * 2)), "ISO-8859-1").alias("text"), F.substring(h, p["at"] + p["n"] * 2, F.length(h)).alias("data")),
            lambda t: let(F.struct(F.regexp_extract(t["text"], DESCR, 1).alias("order"), F.regexp_extract(t["text"], DESCR, 2).alias("size"),
                                   F.regexp_extract(t["text"], SHAPE, 1).alias("shape"), t["text"].rlike(SHAPE).alias("shaped"), t["data"].alias("data")), numbers)))
    return let(F.hex(as_col(blob)), lambda h: F.when(h.startswith(MAGIC) & (F.length(h) >= 24), header(h)))


def _single_digits(x: Column) -> Column:
    """The eight digits of a number, little end first."""
    def bits(v):
        size = F.abs(v)
        guess = F.floor(F.log2(size)).cast("int")
        two = lambda e: F.pow(F.lit(2.0), e)
        exponent = F.greatest(F.when(two(guess) > size, guess - 1).when(two(guess + 1) <= size, guess + 1).otherwise(guess), F.lit(-126))
        normal = let(exponent, lambda e: F.when(size < two(F.lit(-126)), (size * two(F.lit(149))).cast("long")).otherwise(
            (e + 127).cast("long") * F.lit(2 ** 23) + (size * two(23 - e)).cast("long") - F.lit(2 ** 23)))
        magnitude = (F.when(F.isnan(v), F.lit(0x7FC00000)).when(size == float("inf"), F.lit(0x7F800000)).when(size == 0, F.lit(0)).otherwise(normal))
        negative = ~F.isnan(v) & v.cast("string").startswith("-")
        return _little(F.lpad(F.hex(magnitude.cast("long") + F.when(negative, F.lit(2 ** 31)).otherwise(F.lit(0))), 8, "0"))
    return let(F.coalesce(x.cast("float").cast("double"), F.lit(float("nan"))), bits)


def array_to_npy(values) -> Column:
    """A ``.npy`` blob of an array of numbers, as ``<f4``; NULL elements become NaN."""
    def build(a):
        text = F.concat(F.lit("{'descr': '<f4', 'fortran_order': False, 'shape': ("), F.size(a).cast("string"), F.lit(",), }"))
        padded = let(text, lambda t: F.rpad(t, F.ceil((F.length(t) + 11) / ALIGN).cast("int") * ALIGN - 11, " "))
        return let(padded, lambda t: F.unhex(F.concat(F.lit(MAGIC + "0100"), _little(F.lpad(F.hex((F.length(t) + 1).cast("long")), 4, "0")),
                                                      F.hex(F.encode(t, "ISO-8859-1")), F.lit("0A"), F.array_join(F.transform(a, _single_digits), ""))))
    return let(as_col(values), lambda a: F.when(a.isNotNull(), build(a)))
