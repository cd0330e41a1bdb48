"""Vector expressions: literals, dimension rules, sign codes and distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.functions.binding import bind

WORD_BITS = 64
LITERAL_DECIMALS = 7


def vector_to_literal(vec: Column) -> Column:
    """``[v1,v2,...]`` with seven decimals.

    Java's formatter rounds exact ties up and the text form rounds them to even. An
    exact tie at the eighth decimal is an odd multiple of 1/256, nothing else.
    """

    def number(x: Column) -> Column:
        x = x.cast("double")
        tie = F.pmod(x * 256, F.lit(2.0)) == 1.0
        even = F.bround(x.cast("decimal(38,8)"), LITERAL_DECIMALS)
        return F.when(tie, F.format_string("%.7f", even.cast("double"))).otherwise(F.format_string("%.7f", x))

    return F.concat(F.lit("["), F.array_join(F.transform(vec, number), ","), F.lit("]"))


def literal_to_vector(text: Column, dims: int | None = None) -> Column:
    """Parse a vector literal; raises on a bad number or a wrong number of values."""
    body = F.btrim(text, F.lit("[] "))
    vec = F.transform(F.split(body, ","), lambda s: F.trim(s).cast("float"))
    return vec if dims is None else require_dims(vec, dims)


def rounded_vector(vec: Column) -> Column:
    """The values a vector has after a trip through its literal."""
    return F.transform(vec, lambda x: F.bround(x.cast("double"), LITERAL_DECIMALS).cast("float"))


def _too_long(vec: Column, dims: int) -> Column:
    text = F.format_string(f"embedding has %d dims, more than the {dims}-dim column", F.size(vec))
    return F.raise_error(text).cast("array<float>")


def pad_vector(vec: Column, dims: int) -> Column:
    """Pad with zeros on the right; a longer vector is an error."""
    vec = vec.cast("array<float>")
    padded = F.concat(vec, F.array_repeat(F.lit(0.0).cast("float"), F.lit(dims) - F.size(vec)))
    return F.when(F.size(vec) > dims, _too_long(vec, dims)).otherwise(padded)


def fit_vector(vec: Column, dims: int) -> Column:
    """Pad a short vector with zeros, cut a long one."""
    vec = vec.cast("array<float>")
    return F.slice(F.concat(vec, F.array_repeat(F.lit(0.0).cast("float"), dims)), 1, dims)


def require_dims(vec: Column, dims: int) -> Column:
    """The vector itself if it has ``dims`` values, else an error."""
    text = F.format_string(f"embedding has %d dims, expected {dims}", F.size(vec))
    return F.when(vec.isNull() | (F.size(vec) == dims), vec).otherwise(F.raise_error(text).cast("array<float>"))


def split_by_dims(df: DataFrame, vec_col: str, dims: int) -> tuple[DataFrame, DataFrame]:
    """(rows whose vector has ``dims`` values, the other rows with an ``error`` column)."""
    size = F.size(F.col(vec_col))
    good = F.coalesce(size == dims, F.lit(False))
    error = F.when(F.col(vec_col).isNull(), F.lit("embedding is missing")).otherwise(
        F.format_string(f"embedding has %d dims, expected {dims}", size)
    )
    return df.where(good), df.where(~good).withColumn("error", error)


def code_words(vec: Column, dims: int) -> list[Column]:
    """Sign bits of a vector, 64 to a word, first value in the highest bit; 1 iff value > 0."""

    def word(start: int) -> Column:
        part = vec if dims <= WORD_BITS else F.slice(vec, start + 1, WORD_BITS)
        bit = lambda x: F.when(x > 0, F.lit(1)).otherwise(F.lit(0)).cast("bigint")
        return F.aggregate(part, F.lit(0).cast("bigint"), lambda acc, x: F.shiftleft(acc, 1).bitwiseOR(bit(x)))

    return [word(start) for start in range(0, dims, WORD_BITS)]


def code_bits(words: list[Column], dims: int) -> Column:
    """Code words as a text of zeros and ones, in the order of the vector."""
    last = dims - WORD_BITS * (len(words) - 1)
    widths = [WORD_BITS] * (len(words) - 1) + [last]
    return F.concat(*[F.lpad(F.bin(w), width, "0") for w, width in zip(words, widths)])


def query_words(query: list[float]) -> list[int]:
    """Code words of a vector known on the driver, equal to those of ``code_words``."""
    words = []
    for start in range(0, len(query), WORD_BITS):
        word = 0
        for value in query[start : start + WORD_BITS]:
            word = word << 1 | (value > 0)
        words.append(word - (1 << WORD_BITS) if word >> (WORD_BITS - 1) else word)
    return words


def hamming(words: list[Column], other: list[Column]) -> Column:
    """Number of differing bits of two codes; plain arithmetic, so it stays in generated code."""
    total = F.bit_count(words[0].bitwiseXOR(other[0]))
    for a, b in zip(words[1:], other[1:]):
        total = total + F.bit_count(a.bitwiseXOR(b))
    return total


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine in double precision; the cosine is kept in [-1, 1]; a zero vector gives NaN."""
    zero = F.lit(0.0)
    double = lambda x: x.cast("double")
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: double(x) * double(y)), zero, lambda s, x: s + x)
    square = lambda v: F.aggregate(v, zero, lambda s, x: s + double(x) * double(x))
    norms = F.sqrt(square(a) * square(b))

    def distance(cosine: Column) -> Column:
        inside = F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0))
        undefined = cosine.isNull() | F.isnan(cosine)  # the quotient is NULL for a zero norm
        return F.when(undefined, F.lit(float("nan"))).otherwise(1.0 - inside)

    unequal = F.raise_error(F.format_string("different vector dimensions %d and %d", F.size(a), F.size(b))).cast("double")
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(F.size(a) != F.size(b), unequal).otherwise(
        bind(F.try_divide(dot, norms), distance)
    )


def vector_literal_column(query: list[float]) -> Column:
    """A driver-side vector as an array literal."""
    return F.lit([float(x) for x in query]).cast("array<double>")
