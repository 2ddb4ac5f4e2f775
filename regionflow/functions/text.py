"""Text expressions: names, numbers as text, colours."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The display palette of the model tables, in order.
PALETTE = [
    "#1f77b4", "#ff7f0e", "#2ca02c", "#d62728", "#9467bd",
    "#8c564b", "#e377c2", "#7f7f7f", "#bcbd22", "#17becf",
    "#aec7e8", "#ffbb78", "#98df8a", "#ff9896", "#c5b0d5",
    "#c49c94", "#f7b6d2", "#c7c7c7", "#dbdb8d", "#9edae5",
]


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _product_side(x: Column, y: Column, target: Column) -> Column:
    """Sign of the exact x * y - target for doubles whose product is close to the target.

    The product's rounding error is recovered from the split halves of the factors.
    """
    def halves(v: Column) -> tuple[Column, Column]:
        scaled = v * 134217729.0
        high = scaled - (scaled - v)
        return high, v - high
    (xh, xl), (yh, yl) = halves(x), halves(y)
    product = x * y
    error = ((xh * yh - product) + xh * yl + xl * yh) + xl * yl
    return F.signum((product - target) + error)


def _rounded_tie(down: Column, side: Column) -> Column:
    """``down`` or one more for a value whose decimal text ends in a five: by the side of the tie
    on which the binary value lies, half to even exactly on it."""
    return down + F.when((side > 0) | ((side == 0) & (down % 2 == 1)), 1).otherwise(0)


def general_format(value: Column, digits: int) -> Column:
    """Shortest ``%.<digits>g`` text as C and Python print it; NULL stays NULL.

    Spark's ``%g`` pads zeros and rounds the decimal text of a number, not its binary value, so
    ties are decided here by exact arithmetic (for magnitudes of 1e-16 to 1e27) and mantissa and
    exponent are laid out by the C rules.
    """
    powers = F.array(*[F.lit(10.0 ** k) for k in range(23)])

    def parts(text: Column) -> tuple[Column, Column]:
        figures = F.regexp_replace(F.substring_index(text, "e", 1), r"[.]", "").cast("bigint")
        return figures, F.substring_index(text, "e", -1).cast("int")

    def rounded(a: Column) -> Column:
        """Struct m (``digits`` figures) and e (decimal exponent) of a positive number."""
        longer = F.format_string(f"%.{digits}e", a)
        t, e = parts(longer)
        m, f = parts(F.format_string(f"%.{digits - 1}e", a))
        plain = F.struct(m.alias("m"), f.alias("e"))

        def settle(n: Column) -> Column:
            j = digits - n["e"]
            t_ = n["t"].cast("double")
            power = F.get(powers, F.abs(j))
            side = F.when(j >= 0, _product_side(n["a"], power, t_)).otherwise(
                -_product_side(t_, power, n["a"]))
            raised = _rounded_tie(F.floor(n["t"] / 10), F.coalesce(side, F.lit(1.0)))
            full = raised == 10 ** digits
            return F.struct(F.when(full, raised / 10).otherwise(raised).cast("bigint").alias("m"),
                            (n["e"] + F.when(full, 1).otherwise(0)).alias("e"))
        tie = (t % 10 == 5) & (longer.cast("double") == a)
        return F.when(tie, _let(F.struct(a.alias("a"), t.alias("t"), e.alias("e")), settle)).otherwise(plain)

    def laid_out(n: Column) -> Column:
        figures, exponent = n["m"].cast("string"), n["e"]
        kept = F.regexp_replace(figures, r"0+$", "")

        def point_after(whole: Column, fraction: Column) -> Column:
            return F.when(F.length(fraction) > 0, F.concat(whole, F.lit("."), fraction)).otherwise(whole)

        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), kept)
        large = point_after(F.substring(figures, F.lit(1), exponent + 1),
                            F.substring(kept, exponent + 2, F.lit(digits)))
        power = F.concat(point_after(F.substring(figures, 1, 1), F.substring(kept, 2, digits)),
                         F.lit("e"), F.when(exponent < 0, "-").otherwise("+"),
                         F.lpad(F.abs(exponent).cast("string"), 2, "0"))
        return (F.when((exponent < -4) | (exponent >= digits), power)
                .when(exponent < 0, small).otherwise(large))

    def text(v: Column) -> Column:
        body = _let(rounded(F.abs(v)), laid_out)
        return (F.when(v.isNull(), F.lit(None).cast("string"))
                .when(F.isnan(v), "nan")
                .when(F.abs(v) == float("inf"), F.when(v < 0, "-inf").otherwise("inf"))
                .when(v == 0, "0")
                .otherwise(F.concat(F.when(v < 0, "-").otherwise(""), body)))

    return _let(value.cast("double"), text)


def two_places(value: Column) -> Column:
    """The value rounded to two decimals by its exact binary value, half to even."""
    def rounded(v: Column) -> Column:
        a = F.abs(v)
        text = F.format_string("%.3f", a)
        t = F.regexp_replace(text, r"[.]", "").try_cast("bigint")
        tie = (t % 10 == 5) & (text.cast("double") == a)
        side = _product_side(a, F.lit(1000.0), t.cast("double"))
        return F.when(tie, F.signum(v) * _rounded_tie(F.floor(t / 10), side) / 100.0).otherwise(F.round(v, 2))
    return _let(value.cast("double"), rounded)


def capitalised(text: Column) -> Column:
    """First letter upper case, all others lower case."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(text.substr(F.lit(2), F.length(text))))


def colour_of(name: Column) -> Column:
    """Palette colour by md5 of the name up to its first ``_D``.

    The digest is taken modulo the palette size digit by digit: every power of 16 above the
    first is 16 modulo 20, so the leading 31 digits count 16 times their digit sum.
    """
    digest = F.md5(F.regexp_replace(name, r"(?s)_D.*$", ""))
    digits = F.transform(F.split(digest, ""), lambda d: F.conv(d, 16, 10).cast("int"))
    leading = F.aggregate(F.slice(digits, 1, 31), F.lit(0), lambda acc, d: acc + d)
    index = F.pmod(leading * 16 + F.element_at(digits, 32), F.lit(len(PALETTE)))
    return F.element_at(F.array(*[F.lit(c) for c in PALETTE]), index + 1)


# Region suffixes of process and commodity names: <base>_D<in>_D<out> or <base>_D<region>.
_TWO_REGIONS = r"(?s)^(.*)_D([0-9]+)_D([0-9]+)$"
_ONE_REGION = r"(?s)^(.*)_D([0-9]+)$"


def base_name(name: Column) -> Column:
    return (F.when(name.rlike(_TWO_REGIONS), F.regexp_extract(name, _TWO_REGIONS, 1))
            .when(name.rlike(_ONE_REGION), F.regexp_extract(name, _ONE_REGION, 1))
            .otherwise(name))


def name_regions(name: Column) -> Column:
    """``ARRAY<BIGINT>``: empty for a global name, one region, or [in, out] for a pipe."""
    def number(pattern: str, group: int) -> Column:
        return F.regexp_extract(name, pattern, group).try_cast("bigint")
    return (F.when(name.rlike(_TWO_REGIONS), F.array(number(_TWO_REGIONS, 2), number(_TWO_REGIONS, 3)))
            .when(name.rlike(_ONE_REGION), F.array(number(_ONE_REGION, 2)))
            .otherwise(F.array().cast("array<bigint>")))


def region_name(name: Column, *regions: Column) -> Column:
    """``<name>_D<region>`` for each region."""
    pieces = [name]
    for region in regions:
        pieces += [F.lit("_D"), region.cast("string")]
    return F.concat(*pieces)
