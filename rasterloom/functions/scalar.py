"""Column functions: colour, byte and text algebra.  All take and return Columns."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(c: Column) -> Column:
    """Rounds half away from zero, to an int."""
    return F.round(c).cast("int")


def to_byte(c: Column) -> Column:
    return F.least(F.lit(255), F.greatest(F.lit(0), half_up(c)))


def pack_rgb(r: Column, g: Column, b: Column) -> Column:
    return F.shiftleft(r.cast("int"), 16).bitwiseOR(F.shiftleft(g.cast("int"), 8)).bitwiseOR(b.cast("int"))


def unpack_rgb(rgb: Column) -> tuple[Column, Column, Column]:
    return F.shiftright(rgb, 16).bitwiseAND(255), F.shiftright(rgb, 8).bitwiseAND(255), rgb.bitwiseAND(255)


#: Label and channel weights of the gray conversions; fixed values.
GRAY_WEIGHTS = [("Red", 1.0, 0.0, 0.0), ("Green", 0.0, 1.0, 0.0), ("Blue", 0.0, 0.0, 1.0), ("(R+G+B)/3", 1 / 3, 1 / 3, 1 / 3), ("0.299R+0.587G+0.114B", 0.299, 0.587, 0.114)]


def weighted_gray(r: Column, g: Column, b: Column, wr: float, wg: float, wb: float) -> Column:
    return r * F.lit(wr) + g * F.lit(wg) + b * F.lit(wb)


#: Where the six linear pieces of the visible spectrum begin and end, in nm; fixed values.
SPECTRUM = (380, 440, 490, 510, 580, 645, 780)
DIM_BELOW, DIM_ABOVE = 420, 700


def wavelength_to_rgb(nm: Column) -> tuple[Column, Column, Column]:
    """(r, g, b) of a wavelength, 0..255; null outside 380..780."""
    a, b, c, d, e, f, z = SPECTRUM
    lit = lambda x: F.lit(float(x))
    falls = lambda lo, hi: (lit(hi) - nm) / lit(hi - lo)
    rises = lambda lo, hi: (nm - lit(lo)) / lit(hi - lo)
    red = F.when(nm < b, falls(a, b)).when(nm < d, 0.0).when(nm < e, rises(d, e)).otherwise(1.0)
    green = F.when(nm < b, 0.0).when(nm < c, rises(b, c)).when(nm < e, 1.0).when(nm < f, falls(e, f)).otherwise(0.0)
    blue = F.when(nm < c, 1.0).when(nm < d, falls(c, d)).otherwise(0.0)
    power = F.when(nm > DIM_ABOVE, 0.3 + 0.7 * falls(DIM_ABOVE, z)).when(nm < DIM_BELOW, 0.3 + 0.7 * rises(a, DIM_BELOW)).otherwise(1.0)
    seen = nm.between(a, z)
    return tuple(F.when(seen, half_up(x * power * 255)) for x in (red, green, blue))


def celsius_to_fahrenheit(s: Column) -> Column:
    """Text in, text out; says so where there is no number."""
    number = s.try_cast("double")
    return F.when(s == "", "Enter a number").when(number.isNull(), "Not a number").otherwise(F.format_string("%.2f", 32 + 1.8 * number))


def quantize_hex4(v: Column) -> Column:
    """One hex digit of a channel."""
    return F.lower(F.hex(F.least(F.lit(15), F.greatest(F.lit(0), half_up(v / 16))).cast("long")))


def aspect_height(width: Column, ratio: Column) -> Column:
    return half_up(width / ratio)


def sanitized(name: Column) -> Column:
    """Brackets, backslash, space, tab and quotes become underscores."""
    return F.regexp_replace(name, r"""[\]\[\\ \t"']""", "_")


def clean_person(s: Column) -> Column:
    """A name without leading count, e-mail in angle brackets, bracketed remarks and stray brackets."""
    s = F.regexp_replace(s, r"^\s*[0-9]+\s+", "")
    s = F.regexp_replace(s, r"\s*<[^>]*>", "")
    s = F.regexp_replace(s, r"\([^)]*\)", "")
    return F.trim(F.regexp_replace(s, r"[()]", ""))


#: Extension to kind of a catalogued file; fixed values.
FILE_KINDS = {".jar": "archive", ".class": "plugin", ".py": "Jython script", ".rb": "JRuby script", ".js": "Javascript", ".bsh": "BeanShell script", ".clj": "Clojure script", ".ijm": "macro", ".txt": "macro", ".groovy": "Groovy script"}


def file_kind(name: Column, ext: Column) -> Column:
    """The kind, or null: scripts need an underscore in the name, none may have a dollar sign."""
    kinds = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in FILE_KINDS.items()))
    kind = kinds[ext]
    return F.when(name.contains("$"), None).when((ext == ".jar") | name.contains("_"), kind)


def menu_path(folder: Column) -> Column:
    path = F.replace(folder, F.lit("/"), F.lit(">"))
    path = F.when(folder == "", F.lit("Plugins")).otherwise(F.concat(F.lit("Plugins>"), path))
    return F.regexp_replace(path, "^Plugins>Scripts>", "")


def menu_label(name: Column) -> Column:
    return F.replace(F.regexp_replace(name, r"\.[A-Za-z]+$", ""), F.lit("_"), F.lit(" "))


def version_stamp(path: Column) -> tuple[Column, Column]:
    """(name, time) of a path that ends in a 14-digit stamp; nulls elsewhere."""
    pattern = "^(.*)-([0-9]{14})$"
    fits = path.rlike(pattern)
    return F.when(fits, F.regexp_extract(path, pattern, 1)), F.when(fits, F.to_timestamp(F.regexp_extract(path, pattern, 2), "yyyyMMddHHmmss"))
