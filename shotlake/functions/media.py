"""Media header fields: rates, colour, mastering display, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: colour names to ISO/IEC 23091-2 numbers; siting and subsampling codes
PRIMARIES = {"bt709": 1, "bt470m": 4, "bt470bg": 5, "smpte170m": 6, "smpte240m": 7, "film": 8, "bt2020": 9,
             "smpte428": 10, "smpte431": 11, "smpte432": 12, "ebu3213": 22, "jedec-p22": 22}
TRANSFER = {"bt709": 1, "gamma22": 4, "gamma28": 5, "smpte170m": 6, "smpte240m": 7, "linear": 8, "log100": 9,
            "log316": 10, "iec61966-2-4": 11, "bt1361e": 12, "iec61966-2-1": 13, "bt2020-10": 14, "bt2020-12": 15,
            "smpte2084": 16, "smpte428": 17, "arib-std-b67": 18}
MATRIX = {"gbr": 0, "bt709": 1, "fcc": 4, "bt470bg": 5, "smpte170m": 6, "smpte240m": 7, "ycgco": 8, "bt2020nc": 9,
          "bt2020c": 10, "smpte2085": 11, "chroma-derived-nc": 12, "chroma-derived-c": 13, "ictcp": 14}
RANGE = {"tv": 1, "pc": 2}
SITING = {"left": (1, 2), "center": (2, 2), "topleft": (1, 1), "top": (2, 1)}
SUBSAMPLING = {"420": (1, 1), "422": (1, 0), "444": (0, 0)}


def lookup(table: dict, key: Column) -> Column:
    """Value of a small fixed table, NULL for anything not in it."""
    return F.try_element_at(F.create_map(*[F.lit(v) for kv in table.items() for v in kv]), F.coalesce(key, F.lit("")))


def frame_rate(*rationals: Column) -> Column:
    """First positive rate among texts such as "24000/1001", six decimals; 0 without one."""
    def rate(text: Column) -> Column:
        parts = F.split(text, "/")
        num = F.try_element_at(parts, F.lit(1)).try_cast("double")
        den = F.try_element_at(parts, F.lit(2)).try_cast("double")
        value = F.when(F.size(parts) == 2, num / F.when(den == 0, 1.0).otherwise(den))
        return F.when(value > 0, F.bround(value, 6))

    return F.coalesce(*[rate(r) for r in rationals], F.lit(0.0))


def mastering_display(text: Column) -> Column:
    """struct of chromaticities and luminances from G(..)B(..)R(..)WP(..)L(max,min);
    NULL when it does not parse. Each number is a rational, an integer in 1/50000
    (or 1/10000 cd/m2), or already real."""
    n = r"([\d./]+)"
    pattern = rf"^G\({n},{n}\)B\({n},{n}\)R\({n},{n}\)WP\({n},{n}\)L\({n},{n}\)"
    trimmed = F.trim(text)

    def number(i: int, scale: float, limit: float) -> Column:
        token = F.regexp_extract(trimmed, pattern, i)
        num = F.substring_index(token, "/", 1).try_cast("double")
        den = F.substr(token, F.locate("/", token) + 1).try_cast("double")
        value = token.try_cast("double")
        real = F.when(value > limit, value / scale).otherwise(value)
        return F.when(token.contains("/"), F.try_divide(num, den)).otherwise(real)

    names = ["green_x", "green_y", "blue_x", "blue_y", "red_x", "red_y", "white_x", "white_y"]
    parts = [number(i, 50000.0, 1.0).alias(name) for i, name in enumerate(names, 1)]
    parts += [number(9, 10000.0, 10000.0).alias("max_luminance"), number(10, 10000.0, 0.5).alias("min_luminance")]
    whole = trimmed.rlike(pattern)
    complete = F.lit(True)
    for p in parts:
        complete = complete & p.isNotNull()
    return F.when(whole & complete, F.struct(*parts))


def colour_codes(pix_fmt: Column, primaries: Column, transfer: Column, matrix: Column, range_: Column,
                 location: Column) -> Column:
    """struct of numeric colour fields for a decoded frame; unspecified ones are NULL."""
    layout = F.regexp_extract(F.coalesce(pix_fmt, F.lit("")), r"^yuvj?(420|422|444)p(\d+)?", 1)
    bits = F.regexp_extract(F.coalesce(pix_fmt, F.lit("")), r"^yuvj?(420|422|444)p(\d+)?", 2)
    return F.struct(
        lookup(RANGE, range_).alias("range"), lookup(PRIMARIES, primaries).alias("primaries"),
        lookup(TRANSFER, transfer).alias("transfer"), lookup(MATRIX, matrix).alias("matrix"),
        F.when(layout != "", F.coalesce(bits.try_cast("int"), F.lit(8))).alias("bits"),
        lookup({k: v[0] for k, v in SUBSAMPLING.items()}, layout).alias("subsample_h"),
        lookup({k: v[1] for k, v in SUBSAMPLING.items()}, layout).alias("subsample_v"),
        lookup({k: v[0] for k, v in SITING.items()}, location).alias("siting_h"),
        lookup({k: v[1] for k, v in SITING.items()}, location).alias("siting_v"))


def general(x: Column) -> Column:
    """A number in general form: six significant digits, trailing zeros cut."""
    digits = (F.when(x >= 1000, F.format_string("%.2f", x)).when(x >= 100, F.format_string("%.3f", x))
              .when(x >= 10, F.format_string("%.4f", x)).otherwise(F.format_string("%.5f", x)))
    return F.regexp_replace(F.regexp_replace(digits, "0+$", ""), r"\.$", "")


def display_label(codec: Column, width: Column, height: Column, fps: Column, transfer: Column, dovi: Column,
                  profile: Column, hdr: Column) -> Column:
    """One line saying what a file is; what is not known is left out."""
    return F.concat_ws(
        " ", F.when(F.coalesce(codec, F.lit("")) == "", "?").otherwise(codec),
        F.when((width > 0) & (height > 0), F.format_string("%dx%d", width, height)),
        F.when(fps > 0, F.concat(general(fps), F.lit("fps"))),
        F.when(transfer != "", F.concat(F.lit("trc="), transfer)),
        F.when(dovi, F.format_string("DV-P%d", profile)).when(hdr, "HDR"))
