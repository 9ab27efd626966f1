"""First-occurrence key lookup on raw JSON text.

Scalars are cut from the text instead of being decoded, so ``1.10`` stays ``1.10`` and a truncated
frame still yields its leading keys. A quoted value with a backslash counts as missing. All loops
over repeated groups are possessive, so a frame with 10 000 levels matches without backtracking.
Brackets nested up to ``_NESTING`` levels are matched by one pattern; whatever that does not match is
read by a fold over its brackets, which has no limit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedlake.functions.binding import let

WS = r"[ \n\r\t]*+"
_STRING = r'"[^"\\]*+"'
_NESTING = 6


def _balanced(opening: str, closing: str, depth: int = _NESTING) -> str:
    plain = rf'[^"{opening}{closing}]*+'
    pattern = rf"{opening}{plain}(?:{_STRING}{plain})*+{closing}"
    for _ in range(depth - 1):
        pattern = rf"{opening}{plain}(?:(?:{_STRING}|{pattern}){plain})*+{closing}"
    return pattern


_ARRAY = _balanced(r"\[", r"\]")
_OBJECT = _balanced(r"\{", r"\}")


def _value(text: Column, key: str, body: str) -> Column:
    return F.regexp_extract(text, f'"{key}"{WS}:{WS}({body})?', 1)


def _present(token: Column) -> Column:
    # Evaluates its argument once. A CASE would run the regex again in its branch, and so does nullif inside a lambda
    # function or a branch, where the optimizer cannot name the value: nested lookups then double at every level.
    return F.get(F.array_remove(F.array(token), F.lit("")), F.lit(0))


def _unquote(token: Column) -> Column:
    return F.btrim(token, F.lit('"'))


def json_string(text: Column, key: str) -> Column:
    """Quoted value of the first ``key``; NULL when missing or not a plain string."""
    return _unquote(_present(_value(text, key, _STRING)))


def json_raw(text: Column, key: str) -> Column:
    """Quoted or bare scalar of the first ``key``, text kept as written; NULL when missing."""
    return _unquote(_present(_value(text, key, _STRING + r'|[^",}\] \n\r\t][^,}\] \n\r\t]*+')))


def balanced_pieces(text: Column, opening: str, closing: str) -> Column:
    """Outermost bracketed pieces of a text, by counting depth; brackets inside strings do not count.

    A piece that is never closed is left out. Adjacent bytes between brackets stay one token, so the fold
    takes a step per bracket and string.
    """
    token = rf'{_STRING}|[^"\{opening}\{closing}]++|[\{opening}\{closing}"]'
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("piece"), F.array().cast("array<string>").alias("done"))

    def step(state: Column, part: Column) -> Column:
        opens, closes, inside = part == opening, part == closing, state["depth"] > 0
        # A lone quote starts a string that cannot be read: nothing after it counts.
        depth = state["depth"] + F.when(part == '"', -(1 << 30)).when(opens, 1).when(closes & inside, -1).otherwise(0)
        piece = F.when(inside | opens, F.concat(state["piece"], part)).otherwise("")
        ended = closes & inside & (depth == 0)
        return F.struct(
            depth.alias("depth"),
            F.when(ended, "").otherwise(piece).alias("piece"),
            F.when(ended, F.concat(state["done"], F.array(piece))).otherwise(state["done"]).alias("done"),
        )

    tokens = F.regexp_extract_all(text, F.lit(f"({token})"), F.lit(1))
    return F.aggregate(tokens, start, step, lambda state: state["done"])


def json_array(text: Column, key: str) -> Column:
    """Bracketed array text of the first ``key``; NULL when missing or unbalanced."""
    rest = F.regexp_extract(text, rf'(?s)"{key}"{WS}:{WS}(\[.*+)?', 1)
    # Reached only where the pattern finds nothing although an array begins.
    deep = F.when(rest != "", F.get(balanced_pieces(rest, "[", "]"), F.lit(0)))
    return F.coalesce(_present(_value(text, key, _ARRAY)), deep)


def json_long_strict(token: Column) -> Column:
    """All-digits integer; NULL on sign, other bytes or overflow."""
    value = F.when(token.rlike("^[0-9]+$"), token.try_cast("bigint"))
    return F.when(value != 9223372036854775807, value)


def json_long_prefix(token: Column) -> Column:
    """Leading digits as an integer: none gives 0, overflow gives the int64 maximum."""
    digits = F.regexp_extract(token, "^([0-9]*)", 1)
    value = F.coalesce(digits.try_cast("bigint"), F.lit(9223372036854775807))
    return F.when(digits == "", F.lit(0).cast("bigint")).otherwise(value)


def quoted_strings(array_text: Column) -> Column:
    """Every quoted string of an array text."""
    return F.regexp_extract_all(array_text, F.lit(r'"([^"\\]*+)"'), F.lit(1))


def quoted_groups(array_text: Column, size: int, build: Callable[..., Column]) -> Column:
    """``build(s1, .., s_size)`` over consecutive runs of ``size`` quoted strings of an array text.

    One split at the quotes: odd pieces are the strings. NULL when a run is incomplete.
    """

    def over(parts: Column) -> Column:
        count = F.floor((F.size(parts) - 1) / (2 * size)).cast("int")
        one = lambda k: build(*[F.get(parts, k * (2 * size) + 2 * i + 1) for i in range(size)])
        items = F.transform(F.slice(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), F.lit(1), count), one)
        return F.when((F.size(parts) - 1) % (2 * size) == 0, items)

    return let(F.split(array_text, '"'), over)


def first_object_named(array_text: Column, name: str) -> Column:
    """First object of an array text whose ``name`` field equals ``name``; NULL when absent."""

    def found(text: Column) -> Column:
        flat = F.regexp_extract_all(text, F.lit(f"({_OBJECT})"), F.lit(1))
        # With fewer opening brackets than the pattern has levels it cannot be too shallow.
        shallow = F.length(text) - F.length(F.replace(text, F.lit("{"), F.lit(""))) <= _NESTING
        objects = F.when(shallow, flat).otherwise(balanced_pieces(text, "{", "}"))
        return F.get(F.filter(objects, lambda o: json_string(o, "name") == F.lit(name)), F.lit(0))

    return let(array_text, found)
