"""Integers, marks and command words in BINARY columns, by column expressions. Places count bytes from 0."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Command words of a map event, and the kinds of text that they carry.
MESSAGE, CHOICES, COMMENT, DEBUG, STRING_TEST, SET_STRING, PICTURE, DATABASE = 101, 102, 103, 106, 112, 122, 150, 250
#: By kind, the hint of its texts; kinds without one are left out. Texts of the first hint come first.
HINTS = {
    "logic": "protected", "title": "protected", "set-string": "unknown", "other": "unknown", "db": "unknown", "version": "unknown",
    "message": "display", "choice": "display", "picture-text": "display",
}
HINT_ORDER = ("protected", "unknown", "display")
#: Where a file of a kind has the letter that marks UTF-8.
UTF8_MARK = {"map": 16, "game": 9}
UTF8_MARK_ELSE = 6


def _byte(data: Column, at: Column) -> Column:
    return F.conv(F.hex(F.substring(data, at + 1, F.lit(1))), 16, 10).cast("bigint")


def unsigned(data: Column, at: Column | int, width: int = 4) -> Column:
    """The little-endian integer of so many bytes (7 at most); null where the data ends before it, or the place is negative."""
    at = F.lit(at) if isinstance(at, int) else at
    value = reduce(lambda a, b: a + b, [F.shiftleft(_byte(data, at + i), 8 * i) for i in range(width)])
    return F.when((at >= 0) & (at + width <= F.octet_length(data)), value)


def signed(data: Column, at: Column | int, width: int = 4) -> Column:
    """The same in two's complement, of eight bytes at most."""
    value = unsigned(data, at, width)
    if width == 8:  # the highest byte has brought the sign along
        return value
    return F.when(value >= 1 << (8 * width - 1), value - (1 << 8 * width)).otherwise(value)


def integers(data: Column, at: Column | int, count: Column, width: int = 4) -> Column:
    """An array of `count` integers that follow each other, as many of them as the data holds whole."""
    at = F.lit(at) if isinstance(at, int) else at
    places = F.when(count > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), count.cast("bigint") - 1), lambda i: at + i * width)).otherwise(F.array().cast("array<bigint>"))
    return F.filter(F.transform(places, lambda p: signed(data, p, width)), lambda v: v.isNotNull())


def packed(value: Column, width: int = 4) -> Column:
    """An integer as little-endian bytes."""
    digits = [F.lpad(F.hex(F.shiftright(value.cast("bigint"), 8 * i).bitwiseAND(F.lit(255).cast("bigint"))), 2, "0") for i in range(width)]
    return F.unhex(F.concat(*digits))


def bits(value: Column, low: int, count: int) -> Column:
    """`count` bits of an integer from bit `low` on."""
    return F.shiftright(value, low).bitwiseAND(F.lit((1 << count) - 1).cast("bigint"))


def command_kind(command: Column, arguments: Column, index: Column) -> Column:
    """What the text number `index` of a command is; null for comments. A picture's first text is shown if bits 4 to 6 of its first argument are 2."""
    first = F.coalesce(index == 0, F.lit(False))
    shown = F.coalesce(bits(F.get(arguments, F.lit(0)).cast("bigint"), 4, 3) == 2, F.lit(False))
    return (
        F.when(command == MESSAGE, "message")
        .when(command == CHOICES, "choice")
        .when((command == PICTURE) & shown & first, "picture-text")
        .when((command == SET_STRING) & first, "set-string")
        .when(command.isin(STRING_TEST, DATABASE), "logic")
        .when(command.isin(COMMENT, DEBUG), F.lit(None).cast("string"))
        .otherwise("other")
    )


def hint_of(kind: Column) -> Column:
    """The hint of a kind, null for kinds that are not told."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in HINTS.items() for x in pair]), kind)


def hinted(spans: DataFrame, kind_col: str = "kind", order_col: str = "seq") -> DataFrame:
    """spans with their hint, those without one left out, in the order of HINT_ORDER and then of order_col."""
    rank = F.array_position(F.array(*map(F.lit, HINT_ORDER)), F.col("hint"))
    return spans.withColumn("hint", hint_of(F.col(kind_col))).where("hint IS NOT NULL").orderBy(rank, order_col)


def at_or(values: Column, index: Column, default: int = -1) -> Column:
    """The value of an array at a place from 0, or a default behind its end."""
    return F.coalesce(F.get(values, index), F.lit(default))


def field_kind(types: Column, field: Column) -> Column:
    """`db` for a field of a database row whose type is 0; null for others and for fields without a type."""
    return F.when(at_or(types, field) == 0, "db")


def marked_utf8(data: Column, kind: Column) -> Column:
    """Whether a file of a kind (map, game or any other) has the letter U where UTF-8 is marked."""
    at = reduce(lambda rest, k: F.when(kind == k, UTF8_MARK[k]).otherwise(rest), UTF8_MARK, F.lit(UTF8_MARK_ELSE))
    return F.coalesce(F.substring(data, at + 1, F.lit(1)) == F.lit(b"U"), F.lit(False))


def padding(size: Column, to: int) -> Column:
    """Bytes that are missing to a multiple of `to`."""
    return F.pmod(-size, F.lit(to))


def aligned(size: Column, to: int) -> Column:
    """The next multiple of `to`."""
    return size + padding(size, to)
