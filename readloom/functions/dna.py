"""Barcode extraction and sequence arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from readloom.config import MAX_BARCODE, Extraction

# Evidence weights of Phred qualities 0 to 40 (character codes 33 to 73); 42 beyond.
WEIGHTS = (
    0, 0, 0, 0, 2, 4, 5, 6, 8, 9, 10, 11, 12, 13, 14, 16, 17, 18, 19, 20, 21,
    22, 23, 24, 25, 26, 27, 28, 29, 30, 31, 32, 34, 35, 36, 37, 38, 39, 40, 41, 42,
)
# log10 of a class's probability per unit of evidence for it and against it.
LOG_RIGHT, LOG_WRONG = -0.004575749, -0.1


def let(value: Column, f) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), 0)


def mismatches(text: Column, pos: Column, pattern: str, limit: int) -> Column:
    """Positions at which ``pattern`` differs from ``text`` laid at the 0-based ``pos``, or null if more than ``limit``.

    Both are in upper case. Cut into limit+1 pieces, the pattern has one that fits exactly, which is
    tried before counting.
    """
    n, parts = len(pattern), min(limit + 1, len(pattern))
    cuts = [n * i // parts for i in range(parts + 1)]
    fits = lambda i, j: F.substring(text, pos + i + 1, F.lit(j - i)) == pattern[i:j]
    some = fits(*cuts[:2])
    for i, j in zip(cuts[1:], cuts[2:]):
        some = some | fits(i, j)
    piece = F.substring(text, pos + 1, F.lit(n))
    cost = lambda t: sum(
        ((F.substring(t, i + 1, 1) != pattern[i]).cast("int") for i in range(1, n)), (F.substring(t, 1, 1) != pattern[0]).cast("int")
    )
    return F.when(some, let(piece, cost)) if limit < n else let(piece, cost)


def best_hit(text: Column, low: Column, high: Column, pattern: str, limit: int) -> Column:
    """0-based leftmost place of fewest mismatches in ``text[low:high]``, at most ``limit``; null if none.

    ``text`` is in upper case, the pattern in either case. ``high`` bounds the end of the hit. An
    empty pattern is found at ``low``.
    """
    if not pattern:
        return low

    def search(span: Column) -> Column:
        places = F.when(span["hi"] >= span["lo"], F.sequence(span["lo"], span["hi"]))
        scored = F.transform(places, lambda p: F.struct(mismatches(text, p, pattern.upper(), limit).alias("m"), p.alias("p")))
        return F.array_min(F.filter(scored, lambda x: x["m"] <= limit))["p"]

    last = F.least(high, F.length(text)) - len(pattern)
    return let(F.struct(F.greatest(low, F.lit(0)).alias("lo"), last.alias("hi")), search)


def barcode_of(seq: Column, how: Extraction) -> Column:
    """The barcode of a read as it is spelt, null where extraction fails. Null reads have none."""
    if how.fixed:
        end = how.start + how.length
        return F.when(F.length(seq) >= end, F.substring(seq, how.start + 1, how.length))
    c = how.context
    if not c.prefix and not c.starts:
        return F.lit(None).cast("string")
    return let(F.upper(seq), lambda text: let(_context_start(text, how), lambda begin: let(_context_size(text, begin, how), lambda size: _cut(seq, begin, size))))


def partial_barcode(seq: Column, start: int, length: int) -> Column:
    """As much of the barcode at a fixed place as the read holds, as the older paired sorter took it."""
    return F.substring(seq, start + 1, length)


def _cut(text: Column, begin: Column, size: Column) -> Column:
    return F.when((begin + size <= F.length(text)) & (size <= MAX_BARCODE), F.substring(text, begin + 1, size))


def _context_start(text: Column, how: Extraction) -> Column:
    c = how.context
    if not c.prefix:
        return F.lit(0)
    n = F.length(text)
    reach = F.least(n, F.lit(len(c.prefix) + how.max_context_mismatches + 1)) if c.starts else n
    at = best_hit(text, F.lit(0), reach, c.prefix, how.max_context_mismatches)
    # a better hit further on rejects an anchored read even if its start would do
    return (let(at, lambda x: F.when(x == 0, x)) if c.starts else at) + len(c.prefix)


def _context_size(text: Column, begin: Column, how: Extraction) -> Column:
    c, indels, n = how.context, how.max_indels, F.length(text)
    if c.suffix:
        expected = begin + c.length
        at = best_hit(text, F.greatest(expected - indels, begin), expected + indels + len(c.suffix), c.suffix, how.max_context_mismatches)
        fits = lambda x: (x - begin >= 1) & (F.abs(x - begin - c.length) <= indels)
        ends = lambda x: fits(x) & (x + len(c.suffix) == n) if c.ends else fits(x)
        return let(at, lambda x: F.when(ends(x), x - begin))
    if c.ends:
        return F.when(F.abs(n - begin - c.length) <= indels, n - begin)
    return F.lit(c.length)


def unknown_bases(barcode: Column) -> Column:
    """How many N a barcode has; null if it has a character other than A, C, G, T, N in either case."""
    up = F.upper(barcode)
    return F.when(barcode.rlike(r"\A[ACGTNacgtn]*\z"), F.length(up) - F.length(F.replace(up, F.lit("N"), F.lit(""))))


def hamming(a: Column, b: Column) -> Column:
    """Substitutions between texts of equal length; null if the lengths differ."""
    differ = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int"))
    return F.when(F.length(a) == F.length(b), F.aggregate(differ, F.lit(0), lambda s, x: s + x))


def packed(barcode: Column) -> Column:
    """A barcode of at most 64 bases A, C, G, T as three numbers of two bits a base."""
    digits = F.translate(barcode, "ACGT", "0123")
    part = lambda k: F.coalesce(F.conv(F.substring(digits, 31 * k + 1, 31), 4, 10).cast("bigint"), F.lit(0).cast("bigint"))
    return F.struct(*[part(k).alias(f"w{k}") for k in range(3)])


def packed_hamming(a: Column, b: Column) -> Column:
    """Substitutions between two packed barcodes of one length."""
    low = F.lit(0x1555555555555555)  # the lower bit of each base
    differ = lambda x: F.bit_count((x.bitwiseOR(F.shiftright(x, 1))).bitwiseAND(low))
    return sum((differ(a[f"w{k}"].bitwiseXOR(b[f"w{k}"])) for k in (1, 2)), differ(a["w0"].bitwiseXOR(b["w0"])))


def without(text: Column, count: int) -> Column:
    """Distinct texts left after deleting ``count`` characters in all ways; empty if the text is too short."""
    out = F.array(text)
    for _ in range(count):
        out = F.array_distinct(
            F.flatten(
                F.transform(
                    out,
                    lambda t: F.when(
                        F.length(t) >= 1,
                        F.transform(
                            F.sequence(F.lit(1), F.length(t)),
                            lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t))),
                        ),
                    ).otherwise(F.array().cast("array<string>")),
                )
            )
        )
    return out


def quality_stats(qual: Column) -> tuple[Column, Column]:
    """Least and whole mean of code minus 33, each at least 0; 0 and 0 for an empty text."""
    q = F.transform(F.split(qual, ""), lambda c: F.greatest(F.ascii(c) - 33, F.lit(0)))
    empty = F.length(qual) == 0
    total = F.aggregate(q, F.lit(0).cast("bigint"), lambda s, x: s + x)
    return (
        F.when(empty, 0).otherwise(F.array_min(q)).cast("int"),
        F.when(empty, 0).otherwise(F.floor(total / F.length(qual))).cast("int"),
    )


def tag_id(header: Column) -> Column:
    """The number after the first ``;UBID=`` of a header; null where there is none."""
    found = F.regexp_extract(header, r";UBID=([0-9]+)", 1)
    first = F.locate(";UBID=", header)
    return F.when((first > 0) & (F.substring(header, first + 6, F.lit(1)).rlike("[0-9]")), found.try_cast("bigint"))


def true_barcode(header: Column) -> Column:
    """What follows the first ``barcode=`` up to white space, at most 64 characters; null if missing or empty."""
    at = F.locate("barcode=", header)
    rest = F.substring(header, at + 8, F.length(header))
    value = F.substring(F.regexp_extract(rest, r"\A([^ \t\r\n]*)", 1), 1, MAX_BARCODE)
    return F.when((at > 0) & (F.length(value) > 0), value)
