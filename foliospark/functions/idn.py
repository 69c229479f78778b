"""Host names of other scripts in ASCII: the Bootstring algorithm of RFC 3492 as column expressions.

Labels are lower-cased; composing characters is left to the caller.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The parameters of RFC 3492, section 5.
BASE, T_MIN, T_MAX, SKEW, DAMP, INITIAL_BIAS, INITIAL_N = 36, 1, 26, 38, 700, 72, 128
#: Digits of the largest number that a label of 63 characters can need, and divisions that bring it below the limit.
_DIGITS, _DIVISIONS = 9, 8


def _div(a: Column, b: Column | int) -> Column:
    return F.floor(a / b).cast("long")


def _digit(d: Column) -> Column:
    """a to z, then 0 to 9."""
    return F.chr(F.when(d < 26, d + 97).otherwise(d + 22))


def _number(delta: Column, bias: Column) -> Column:
    """A number in variable length, least digit first."""
    start = F.struct(delta.alias("q"), F.lit("").alias("out"), F.lit(False).alias("done"))

    def step(s: Column, k: Column) -> Column:
        t = F.greatest(F.lit(T_MIN), F.least(F.lit(T_MAX), k * BASE - bias))
        last = s["q"] < t
        more = t + F.pmod(s["q"] - t, BASE - t)
        out = F.when(s["done"], s["out"]).otherwise(F.concat(s["out"], _digit(F.when(last, s["q"]).otherwise(more))))
        left = F.when(s["done"] | last, s["q"]).otherwise(_div(s["q"] - t, BASE - t))
        return F.struct(left.alias("q"), out.alias("out"), (s["done"] | last).alias("done"))

    return F.aggregate(F.sequence(F.lit(1).cast("long"), F.lit(_DIGITS).cast("long")), start, step, lambda s: s["out"])


def _adapted(delta: Column, points: Column, first: Column) -> Column:
    """The bias after a number."""
    scaled = F.when(first, _div(delta, DAMP)).otherwise(_div(delta, 2))
    scaled = scaled + _div(scaled, points)
    start = F.struct(scaled.alias("d"), F.lit(0).cast("long").alias("k"))
    limit = (BASE - T_MIN) * T_MAX // 2

    def step(s: Column, _: Column) -> Column:
        over = s["d"] > limit
        return F.struct(
            F.when(over, _div(s["d"], BASE - T_MIN)).otherwise(s["d"]).alias("d"), F.when(over, s["k"] + BASE).otherwise(s["k"]).alias("k")
        )

    end = lambda s: s["k"] + _div((BASE - T_MIN + 1) * s["d"], s["d"] + SKEW)
    return F.aggregate(F.sequence(F.lit(1), F.lit(_DIVISIONS)), start, step, end)


def punycode(label: Column) -> Column:
    """A label's encoded form, without a prefix."""
    chars = F.regexp_extract_all(label, F.lit("(?s)."), F.lit(0))
    # code points from UTF-32, as ascii() stops at 16 bits
    codes = F.transform(chars, lambda c: F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("long"))
    return F.get(F.transform(F.array(codes), _encoded), 0)


def _encoded(codes: Column) -> Column:
    plain = F.filter(codes, lambda c: c < INITIAL_N)
    long = lambda v: F.lit(v).cast("long")
    head = F.array_join(F.transform(plain, lambda c: F.chr(c)), "")
    head = F.when(F.size(plain) > 0, F.concat(head, F.lit("-"))).otherwise(head)
    n_plain = F.size(plain).cast("long")
    start = F.struct(long(INITIAL_N).alias("n"), long(0).alias("delta"), long(INITIAL_BIAS).alias("bias"), n_plain.alias("done"), head.alias("out"))

    def point(s: Column, m: Column) -> Column:
        """All places of the code point m, from left to right."""
        begun = F.struct(
            (s["delta"] + (m - s["n"]) * (s["done"] + 1)).alias("delta"), s["bias"].alias("bias"), s["done"].alias("done"), s["out"].alias("out")
        )

        def place(x: Column, c: Column) -> Column:
            hit = c == m
            return F.struct(
                F.when(hit, long(0)).otherwise(x["delta"] + F.when(c < m, 1).otherwise(0)).alias("delta"),
                F.when(hit, _adapted(x["delta"], x["done"] + 1, x["done"] == n_plain)).otherwise(x["bias"]).alias("bias"),
                (x["done"] + F.when(hit, 1).otherwise(0)).alias("done"),
                F.when(hit, F.concat(x["out"], _number(x["delta"], x["bias"]))).otherwise(x["out"]).alias("out"),
            )

        end = lambda x: F.struct((m + 1).alias("n"), (x["delta"] + 1).alias("delta"), x["bias"].alias("bias"), x["done"].alias("done"), x["out"].alias("out"))
        return F.aggregate(codes, begun, place, end)

    others = F.sort_array(F.array_distinct(F.filter(codes, lambda c: c >= INITIAL_N)))
    return F.aggregate(others, start, point, lambda s: s["out"])


def ascii_host(host: Column) -> Column:
    """A host whose labels of other scripts are encoded behind ``xn--``; one in ASCII stays as it is."""
    dots = F.regexp_replace(host, "[。．｡]", ".")
    label = lambda x: F.when(x.rlike(r"[^\x00-\x7f]"), F.concat(F.lit("xn--"), punycode(F.lower(x)))).otherwise(x)
    return F.when(host.rlike(r"[^\x00-\x7f]"), F.array_join(F.transform(F.split(dots, r"\.", -1), label), ".")).otherwise(host)
