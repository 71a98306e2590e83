"""Colour science as column expressions (D65, sRGB); NULL in, NULL out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# sRGB to XYZ matrix, D65 white.
MATRIX = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
WHITE = (0.95047, 1.0, 1.08883)
SCORING_DIMS = ("L_lab", "a_lab", "b_lab", "C_lab", "H_lab_deg", "depth", "warmth", "sat_eff", "sat_hsl", "light_hsl", "Y_rel", "colorfulness")


def parse_rgb(text: Column) -> tuple[Column, Column, Column]:
    """r, g, b of "r,g,b"; malformed or outside 0..255: all NULL."""
    form = r"^\s*(\d{1,3})\s*,\s*(\d{1,3})\s*,\s*(\d{1,3})\s*$"
    parts = [F.regexp_extract(text, form, k).try_cast("int") for k in (1, 2, 3)]
    ok = parts[0].between(0, 255) & parts[1].between(0, 255) & parts[2].between(0, 255)
    return tuple(F.when(ok, p) for p in parts)


def norm_hex(text: Column) -> Column:
    """Lower-case "#rrggbb" of a hex colour with or without "#"; NULL otherwise."""
    bare = F.lower(F.regexp_replace(F.trim(text), "^#", ""))
    return F.when(bare.rlike("^[0-9a-f]{6}$"), F.concat(F.lit("#"), bare))


def hex_rgb01(hexed: Column) -> tuple[Column, Column, Column]:
    """Red, green and blue in 0..1 of "#rrggbb"."""
    return tuple(F.conv(F.substring(hexed, at, 2), 16, 10).cast("double") / 255 for at in (2, 4, 6))


def rgb_hex(r: Column, g: Column, b: Column) -> Column:
    """Upper-case "#RRGGBB"."""
    return F.when(r.isNotNull() & g.isNotNull() & b.isNotNull(), F.format_string("#%02X%02X%02X", r.cast("int"), g.cast("int"), b.cast("int")))


def linear(c: Column) -> Column:
    """Linear light of an sRGB channel in 0..1."""
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def xyz(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """XYZ of linear channels."""
    return tuple(r * m[0] + g * m[1] + b * m[2] for m in MATRIX)


def _f(t: Column) -> Column:
    return F.when(t > 216 / 24389, F.cbrt(t)).otherwise(t * (841 / 108) + 4 / 29)


def lab(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """L, a, b of XYZ."""
    fx, fy, fz = _f(x / WHITE[0]), _f(y / WHITE[1]), _f(z / WHITE[2])
    return fy * 116 - 16, (fx - fy) * 500, (fy - fz) * 200


def hex_lab(hexed: Column) -> tuple[Column, Column, Column]:
    return lab(*xyz(*map(linear, hex_rgb01(hexed))))


def chroma(a: Column, b: Column) -> Column:
    return F.hypot(a, b)


def hue_deg(a: Column, b: Column) -> Column:
    """Hue in 0..360; a and b are cut to 10 digits, so that greys have hue 0."""
    return F.pmod(F.degrees(F.atan2(F.round(b, 10), F.round(a, 10))), F.lit(360.0))


def hsl(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue (degrees), saturation and lightness of channels in 0..1; of equal largest channels the last one sets the hue; greys have hue and saturation 0."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d, light = top - low, (top + low) / 2
    turn = F.when(b == top, F.try_divide(r - g, d) + 4).when(g == top, F.try_divide(b - r, d) + 2).otherwise(F.try_divide(g - b, d))
    hue = F.when(d == 0, 0.0).otherwise(F.pmod(turn * 60, F.lit(360.0)))
    return hue, F.when(d == 0, 0.0).otherwise(F.try_divide(d, 1 - F.abs(light * 2 - 1))), light


def hsv_hue(r: Column, g: Column, b: Column) -> Column:
    """HSV hue in degrees; of equal largest channels the first one sets it; greys have hue 0."""
    top = F.greatest(r, g, b)
    d = top - F.least(r, g, b)
    turn = F.when(r == top, F.try_divide(g - b, d)).when(g == top, F.try_divide(b - r, d) + 2).otherwise(F.try_divide(r - g, d) + 4)
    return F.when(d == 0, 0.0).otherwise(F.pmod(turn * 60, F.lit(360.0)))


def colorfulness(r: Column, g: Column, b: Column) -> Column:
    rg, yb = r - g, (r + g) / 2 - b
    return F.sqrt(rg * rg + yb * yb) * 0.3


def delta_e76(L1, a1, b1, L2, a2, b2) -> Column:
    return F.sqrt((L1 - L2) * (L1 - L2) + (a1 - a2) * (a1 - a2) + (b1 - b2) * (b1 - b2))


def circ_diff(h: Column, h0: Column) -> Column:
    """Signed circular difference in -180..180."""
    return F.pmod(h - h0 + 180, F.lit(360.0)) - 180


def circ_dist(h: Column, h0: Column) -> Column:
    return F.abs(circ_diff(h, h0))


def hue_band(chroma_: Column) -> Column:
    """Half width in degrees of the hue band around an anchor of this chroma."""
    return F.least(F.greatest(chroma_ * 0.2 + 18, F.lit(18.0)), F.lit(36.0))


def enrich(items: DataFrame, rgb: str = "chip_rgb") -> DataFrame:
    """items with r, g, b, chip_hex and 13 colour features, in three projections; rows without a colour keep NULLs."""
    r, g, b = parse_rgb(F.col(rgb))
    out = items.withColumns({"r": r, "g": g, "b": b})
    c01 = [F.col(c) / 255 for c in "rgb"]
    hue, sat, light = hsl(*c01)
    x, y, z = xyz(*map(linear, c01))
    out = out.withColumns({"chip_hex": F.lower(rgb_hex(*map(F.col, "rgb"))), "hue_hsl_deg": hue, "sat_hsl": sat, "light_hsl": light, "colorfulness": colorfulness(*c01), "_x": x, "Y_rel": y, "_z": z})
    L, a_, b_ = lab(F.col("_x"), F.col("Y_rel"), F.col("_z"))
    out = out.withColumns({"L_lab": L, "a_lab": a_, "b_lab": b_}).drop("_x", "_z")
    out = out.withColumns({"C_lab": chroma(F.col("a_lab"), F.col("b_lab")), "H_lab_deg": hue_deg(F.col("a_lab"), F.col("b_lab")), "depth": 100 - F.col("L_lab"), "warmth": F.col("b_lab") - F.col("a_lab") * 0.5})
    return out.withColumn("sat_eff", F.col("C_lab") / F.greatest("L_lab", F.lit(1e-6)))


def with_delta_e00(df: DataFrame, one: tuple[str, str, str], two: tuple[str, str, str], out: str) -> DataFrame:
    """df with the CIEDE2000 difference of two Lab triples of columns.

    The steps are projections of their own, so that no part is computed twice. The result passes an explode
    of one element, which no later predicate is pushed through; it would copy the whole formula.
    """
    (L1, a1, b1), (L2, a2, b2) = ([F.col(c) for c in t] for t in (one, two))
    p25 = 25.0**7
    keep = df.columns
    c = F.col
    steps = [
        {"_g": (F.hypot(a1, b1) + F.hypot(a2, b2)) / 2},
        {"_g": (1 - F.sqrt(F.pow("_g", F.lit(7.0)) / (F.pow("_g", F.lit(7.0)) + p25 + 1e-12))) / 2 + 1},
        {"_x1": c("_g") * a1, "_x2": c("_g") * a2},
        {"_c1": F.hypot("_x1", b1), "_c2": F.hypot("_x2", b2), "_h1": F.pmod(F.degrees(F.atan2(b1, c("_x1"))), F.lit(360.0)), "_h2": F.pmod(F.degrees(F.atan2(b2, c("_x2"))), F.lit(360.0))},
        {"_dh": c("_h1") - c("_h2"), "_cb": (c("_c1") + c("_c2")) / 2},
        {"_hb": F.pmod((c("_h1") + c("_h2") + F.when(F.abs("_dh") > 180, 360.0).otherwise(0.0)) / 2, F.lit(360.0)), "_dh": F.when(c("_dh") > 180, c("_dh") - 360).when(c("_dh") < -180, c("_dh") + 360).otherwise(c("_dh"))},
        {
            "_t": 1 - F.cos(F.radians(c("_hb") - 30)) * 0.17 + F.cos(F.radians(c("_hb") * 2)) * 0.24 + F.cos(F.radians(c("_hb") * 3 + 6)) * 0.32 - F.cos(F.radians(c("_hb") * 4 - 63)) * 0.20,
            "_l": F.pow((L1 + L2) / 2 - 50, F.lit(2.0)),
            "_rt": -F.sin(F.radians(F.exp(-F.pow((c("_hb") - 275) / 25, F.lit(2.0))) * 60)) * 2 * F.sqrt(F.pow("_cb", F.lit(7.0)) / (F.pow("_cb", F.lit(7.0)) + p25 + 1e-12)),
        },
        {
            "_l": (L1 - L2) / (1 + c("_l") * 0.015 / F.sqrt(c("_l") + 20)),
            "_c": (c("_c1") - c("_c2")) / (1 + c("_cb") * 0.045),
            "_h": F.sqrt(c("_c1") * c("_c2")) * 2 * F.sin(F.radians(c("_dh") / 2)) / (1 + c("_cb") * c("_t") * 0.015),
        },
        {out: F.sqrt(c("_l") * c("_l") + c("_c") * c("_c") + c("_h") * c("_h") + c("_rt") * c("_c") * c("_h"))},
    ]
    for step in steps:
        df = df.withColumns(step)
    return df.select(*[k for k in keep if k != out], F.explode(F.array(out)).alias(out))
