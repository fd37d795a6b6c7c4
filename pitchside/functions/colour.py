"""Club colour resolution as column expressions.

hex <-> rgb, WCAG luminance and contrast, HSL achromatic test, the bounded
40-step move away from the ground (a ladder of colours, searched by halving), and
the rule chain that names which rule won.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchside.functions.feed import normalize_hex

# Fixed values that must equal the reference's.
GROUND_LIGHT = "f4f2ed"
GROUND_DARK = "14161a"
MIN_CONTRAST = 3.0
ACHROMATIC_SATURATION = 0.15
ADJUST_STEPS = 40
DARKEN_FACTOR = 0.95
LIGHTEN_SHARE = 0.08
FALLBACK_ON_LIGHT = "14161a"
FALLBACK_ON_DARK = "e9e6df"


def _py_lum(hexstr: str) -> float:
    def ch(v: int) -> float:
        s = v / 255
        return s / 12.92 if s <= 0.03928 else ((s + 0.055) / 1.055) ** 2.4
    r, g, b = (int(hexstr[i:i + 2], 16) for i in (0, 2, 4))
    return 0.2126 * ch(r) + 0.7152 * ch(g) + 0.0722 * ch(b)


def rgb_of(h: Column) -> Column:
    """six clean hex digits -> struct(r, g, b) as doubles; null stays null."""
    part = lambda i: F.conv(F.substring(h, i, 2), 16, 10).cast("double")
    return F.when(h.isNotNull(), F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b")))


def to_hex(rgb: Column) -> Column:
    """clamp + half-up round each channel, two lowercase hex digits each."""
    def c(x: Column) -> Column:
        v = F.greatest(F.lit(0), F.least(F.lit(255), F.floor(x + 0.5)))
        return F.lpad(F.lower(F.hex(v)), 2, "0")
    return F.concat(c(rgb["r"]), c(rgb["g"]), c(rgb["b"]))


def luminance(rgb: Column) -> Column:
    """WCAG relative luminance."""
    def ch(v: Column) -> Column:
        s = v / 255.0
        return F.when(s <= 0.03928, s / 12.92).otherwise(F.pow((s + 0.055) / 1.055, 2.4))
    return 0.2126 * ch(rgb["r"]) + 0.7152 * ch(rgb["g"]) + 0.0722 * ch(rgb["b"])


def contrast_lum(la: Column, lb: Column) -> Column:
    return (F.greatest(la, lb) + 0.05) / (F.least(la, lb) + 0.05)


def is_achromatic(rgb: Column) -> Column:
    """HSL saturation below 0.15."""
    mx = F.greatest(rgb["r"], rgb["g"], rgb["b"]) / 255.0
    mn = F.least(rgb["r"], rgb["g"], rgb["b"]) / 255.0
    light = (mx + mn) / 2
    sat = (F.when(mx == mn, F.lit(0.0))
           .when(light > 0.5, (mx - mn) / (2 - mx - mn))
           .otherwise((mx - mn) / (mx + mn)))
    return sat < ACHROMATIC_SATURATION


def _pick(hex_: Column, source: Column, ratio: Column) -> Column:
    return F.struct(hex_.alias("hex"), source.alias("source"), ratio.alias("contrast"))


def _ladder(base: Column, ground_lum: float) -> Column:
    """the colour after 0 to 40 steps away from the ground, one after another."""
    def moved(c: Column) -> Column:
        if ground_lum > 0.5:
            out = F.struct(*((F.lit(DARKEN_FACTOR) * c[x]).alias(x) for x in "rgb"))
        else:
            out = F.struct(*((c[x] + (F.lit(255.0) - c[x]) * LIGHTEN_SHARE).alias(x) for x in "rgb"))
        return out.cast("struct<r:double,g:double,b:double>")
    rungs = F.sequence(F.lit(1), F.lit(ADJUST_STEPS))
    return F.aggregate(rungs, F.array(base), lambda acc, _: F.array_append(acc, moved(F.element_at(acc, -1))))


def _first_fit(ladder: Column, ground_lum: float) -> Column:
    """The first rung that fits the ground, or the last one. Whether a rung fits
    can only change once along the ladder (a colour on the far side of the ground
    is too close to it to fit), so halving finds it in six looks."""
    def halve(b: Column, _i: Column) -> Column:
        mid = F.floor((b["lo"] + b["hi"]) / 2).cast("int")
        fits = contrast_lum(luminance(F.get(ladder, mid)), F.lit(ground_lum)) >= MIN_CONTRAST
        return F.struct(F.when(fits, b["lo"]).otherwise(mid).alias("lo"), F.when(fits, mid).otherwise(b["hi"]).alias("hi"))
    looks = F.sequence(F.lit(1), F.lit(ADJUST_STEPS.bit_length()))
    # below the ladder's foot nothing fits; its top is taken whether it fits or not
    ends = F.struct(F.lit(-1).alias("lo"), F.lit(ADJUST_STEPS).alias("hi"))
    return F.get(ladder, F.aggregate(looks, ends, halve)["hi"])


def resolve_colours(df: DataFrame, primary: str, secondary: str, ground_hex: str, out: str) -> DataFrame:
    """F6 over a DataFrame: adds struct column ``out`` (hex, source, contrast).

    The ground is a constant, so its luminance is computed once in Python;
    the rules are staged over a few projections so that the ladder of 40 steps
    is made once per row and not inlined into every branch that reads it.
    """
    gl = _py_lum(ground_hex)
    lg = F.lit(gl)
    fallback = FALLBACK_ON_LIGHT if gl > 0.5 else FALLBACK_ON_DARK
    fl = _py_lum(fallback)
    fallback_ratio = (max(fl, gl) + 0.05) / (min(fl, gl) + 0.05)
    keep = df.columns
    t = df.select("*", normalize_hex(F.col(primary)).alias("_ph"), normalize_hex(F.col(secondary)).alias("_sh"))
    t = t.select(*keep, rgb_of(F.col("_ph")).alias("_p"), rgb_of(F.col("_sh")).alias("_s"))
    p, s = F.col("_p"), F.col("_s")
    p_achro = F.when(p.isNull(), F.lit(True)).otherwise(is_achromatic(p))
    t = t.select(*keep, "_p", "_s",
                 contrast_lum(luminance(p), lg).alias("_p_con"),
                 contrast_lum(luminance(s), lg).alias("_s_con"),
                 (p_achro & s.isNotNull()).alias("_use_s"))
    base = F.when(F.col("_use_s"), s).otherwise(p)
    fits = (F.col("_p_con") >= MIN_CONTRAST) | (F.col("_use_s") & (F.col("_s_con") >= MIN_CONTRAST))
    # the steps are taken only for a colour that does not fit the ground yet
    steps = F.when(base.isNotNull() & ~F.coalesce(fits, F.lit(False)), _ladder(base, gl))
    t = t.select("*", base.alias("_base"), steps.alias("_steps"))
    t = t.select("*", F.when(F.col("_steps").isNull(), F.col("_base")).otherwise(_first_fit(F.col("_steps"), gl)).alias("_adj"))
    adj = F.col("_adj")
    rule = (F.when(p.isNotNull() & (F.col("_p_con") >= MIN_CONTRAST),
                   _pick(to_hex(p), F.lit("primary"), F.col("_p_con")))
            .when(F.col("_use_s") & (F.col("_s_con") >= MIN_CONTRAST),
                  _pick(to_hex(s), F.lit("secondary"), F.col("_s_con")))
            # no base colour at all (the aggregate's result type is not
            # nullable, so test the inputs, not the adjusted value)
            .when(p.isNull() & ~F.col("_use_s"), _pick(F.lit(fallback), F.lit("fallback"), F.lit(fallback_ratio)))
            .otherwise(_pick(to_hex(adj), F.when(F.col("_use_s"), F.lit("adjusted-secondary"))
                             .otherwise(F.lit("adjusted-primary")), contrast_lum(luminance(adj), lg))))
    return t.select(*keep, rule.alias(out))


def club_colour_pair(df: DataFrame, primary: str = "primary_color", secondary: str = "secondary_color") -> DataFrame:
    """struct columns ``light`` and ``dark`` and the '#'-prefixed colours
    ``css_light`` and ``css_dark`` for the two grounds."""
    for label, ground in (("light", GROUND_LIGHT), ("dark", GROUND_DARK)):
        df = resolve_colours(df, primary, secondary, ground, label)
        df = df.withColumn(f"css_{label}", F.concat(F.lit("#"), F.col(f"{label}.hex")))
    return df
