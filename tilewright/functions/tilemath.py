"""Integer tile arithmetic, paths and schedules as columns. Integers are BIGINT."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Name, channels, bytes for each channel, alpha.
PIXEL_FORMATS = (
    ("gray8", 1, 1, False),
    ("gray16", 1, 2, False),
    ("rgb8", 3, 1, False),
    ("rgba8", 4, 1, True),
    ("rgb16", 3, 2, False),
    ("rgba16", 4, 2, True),
)


def long(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("long")


def idiv(a, b) -> Column:
    return F.call_function("div", long(a), long(b))


def ceil_div(a, b) -> Column:
    return idiv(long(a) + long(b) - 1, b)


def power2(k) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), k.cast("int") if isinstance(k, Column) else F.lit(k))


def ceil_half(x, times) -> Column:
    """x halved `times` times, rounded up each time."""
    return ceil_div(x, power2(times))


def ceil_log2(x) -> Column:
    """Least k with 2^k >= x, by the bits of x - 1; 0 for x <= 1."""
    x = long(x)
    return F.when(x <= 1, 0).otherwise(F.length(F.bin(x - 1))).cast("long")


def by_format(name: Column, values: dict) -> Column:
    out = None
    for k, v in values.items():
        out = F.when(name == k, F.lit(v)) if out is None else out.when(name == k, F.lit(v))
    return out


def channels(name: Column) -> Column:
    return by_format(name, {n: c for n, c, _, _ in PIXEL_FORMATS})


def bytes_per_channel(name: Column) -> Column:
    return by_format(name, {n: b for n, _, b, _ in PIXEL_FORMATS})


def bytes_per_pixel(name: Column) -> Column:
    return by_format(name, {n: c * b for n, c, b, _ in PIXEL_FORMATS})


def has_alpha(name: Column) -> Column:
    return by_format(name, {n: a for n, _, _, a in PIXEL_FORMATS})


def with_alpha(name: Column) -> Column:
    return F.when(bytes_per_channel(name) == 2, "rgba16").when(bytes_per_channel(name) == 1, "rgba8")


def without_alpha(name: Column) -> Column:
    return F.when(name == "rgba8", "rgb8").when(name == "rgba16", "rgb16").otherwise(name)


def normalised_colour(kind: Column) -> Column:
    """Decoder colour type -> pixel format; others raise."""
    known = {"l8": "gray8", "l16": "gray16", "rgb8": "rgb8", "rgba8": "rgba8", "rgb16": "rgb16", "rgba16": "rgba16", "la8": "rgba8", "la16": "rgba16"}
    found = by_format(F.lower(kind), known)
    return F.when(kind.isNull() | found.isNotNull(), found).otherwise(F.raise_error(F.concat(F.lit("unsupported colour type: "), kind)))


def tile_path(layout: Column, level: Column, col: Column, row: Column, extension: Column) -> Column:
    s = lambda c: c.cast("string")
    deep = F.concat(s(level), F.lit("/"), s(col), F.lit("_"), s(row))
    a, b = F.when(layout == "google", row).otherwise(col), F.when(layout == "google", col).otherwise(row)
    flat = F.concat_ws("/", s(level), s(a), s(b))
    return F.concat(F.when(layout == "deep_zoom", deep).otherwise(flat), F.lit("."), extension)


def parse_tile_path(layout: Column, path: Column) -> Column:
    """STRUCT level, col, row; null for what is no tile path. Google's row and column are told apart by the layout.
    One expression is matched for a path; what fits it is cut at its only separators."""
    deep, swap = layout == "deep_zoom", layout == "google"
    fits = F.when(deep, path.rlike(r"^[0-9]+/[0-9]+_[0-9]+\.[A-Za-z0-9]+$")).when(~deep, path.rlike(r"^[0-9]+/[0-9]+/[0-9]+\.[A-Za-z0-9]+$"))
    bare = F.substring_index(path, ".", 1)
    last = F.substring_index(bare, "/", -1)
    first = F.when(deep, F.substring_index(last, "_", 1)).otherwise(F.substring_index(F.substring_index(bare, "/", 2), "/", -1))
    a, b = first.try_cast("long"), F.substring_index(last, "_", -1).try_cast("long")
    coord = F.struct(F.substring_index(bare, "/", 1).try_cast("long").alias("level"), F.when(swap, b).otherwise(a).alias("col"), F.when(swap, a).otherwise(b).alias("row"))
    return F.when(fits, coord)


def object_key(prefix: Column, image: Column, layout: Column, path: Column) -> Column:
    """Key of a tile in an object store; path from tile_path."""
    base = F.concat(image, F.when(layout == "deep_zoom", "_files/").otherwise("/"), path)
    trimmed = F.trim(F.coalesce(prefix, F.lit("")), F.lit("/"))
    return F.when(trimmed == "", base).otherwise(F.concat(trimmed, F.lit("/"), base))


def archive_stem(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(name.rlike(r"\.(tar\.gz|tgz)$"), F.regexp_replace(name, r"\.(tar\.gz|tgz)$", "")).otherwise(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""))


def archive_entries(stem: Column, path: Column) -> Column:
    """The two names of a tile in an archive."""
    return F.array(F.concat(stem, F.lit("_files/"), path), F.concat(stem, F.lit("/"), path))


def shared_path(digest: Column, path: Column) -> Column:
    extension = F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)
    return F.concat(F.lit("_shared/blank_"), digest, F.lit("."), F.when(extension == "", "bin").otherwise(extension))


def backoff_ms(attempt: Column, initial_ms: float = 50.0, multiplier: float = 2.0, most_ms: float = 5000.0) -> Column:
    """Wait before retry number `attempt`, from 0."""
    return F.least(F.lit(float(initial_ms)) * F.pow(F.lit(float(multiplier)), attempt), F.lit(float(most_ms)))


def dzi(extension: Column, overlap: Column, tile_size: Column, width: Column, height: Column) -> Column:
    s = lambda c: c.cast("string")
    return F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<Image xmlns="http://schemas.microsoft.com/deepzoom/2008"\n  Format="'), extension,
        F.lit('"\n  Overlap="'), s(overlap), F.lit('"\n  TileSize="'), s(tile_size), F.lit('">\n  <Size Width="'), s(width),
        F.lit('" Height="'), s(height), F.lit('"/>\n</Image>'),
    )


# -- pages ----------------------------------------------------------------------------------------


def page_rotation(rotate: Column) -> Column:
    """Degrees from 0 to 270; others raise."""
    r = F.pmod(rotate.cast("long"), F.lit(360).cast("long"))
    return F.when(r.isNull() | (r % 90 == 0), r).otherwise(F.raise_error(F.concat(F.lit("unsupported rotation: "), rotate.cast("string"))))


def rendered_size(points: Column, dpi: Column) -> Column:
    """Pixels of a page side, truncated in single precision."""
    return (points.cast("float") * (dpi.cast("float") / F.lit(72.0).cast("float"))).cast("float").cast("long")


def budgeted_dpi(width_pt: Column, height_pt: Column, max_dpi: Column, max_pixels: Column) -> Column:
    """STRUCT dpi, capped."""
    pixels = (width_pt * max_dpi / 72.0).cast("long") * (height_pt * max_dpi / 72.0).cast("long")
    fit = F.greatest(F.lit(1).cast("long"), F.floor(F.sqrt(max_pixels / (width_pt * height_pt)) * 72.0).cast("long"))
    over = pixels > max_pixels
    return F.struct(F.when(over, fit).otherwise(max_dpi.cast("long")).alias("dpi"), over.alias("capped"))


def strip_dpi(width_pt: Column, dpi_hint: Column, min_dpi: Column, strip_height: Column, budget: Column) -> Column:
    """DPI at which a strip of RGBA pixels fits the budget: the hint, else scaled down in proportion and, if
    rounding still exceeds, by one more; null below min_dpi."""
    cost = lambda dpi: rendered_size(width_pt, dpi) * strip_height * 4
    scaled = F.greatest(F.lit(1).cast("long"), F.floor(dpi_hint * (budget / cost(dpi_hint))).cast("long"))
    less = F.greatest(F.lit(1).cast("long"), scaled - 1)
    enough = F.when(cost(scaled) <= budget, scaled).when((cost(less) <= budget) & (less >= min_dpi), less)
    return F.when(cost(dpi_hint) <= budget, dpi_hint.cast("long")).when(scaled >= min_dpi, enough)


def strip_matrix(rotation: Column, scale: Column, width_pt: Column, height_pt: Column, y_offset: Column) -> Column:
    """The six numbers that map page points to a strip's pixels; width and height as displayed."""
    zero, w, h = F.lit(0.0), scale * width_pt, scale * height_pt
    up = -y_offset.cast("double")
    return (
        F.when(rotation == 0, F.array(scale, zero, zero, -scale, zero, h + up))
        .when(rotation == 90, F.array(zero, scale, scale, zero, zero, up))
        .when(rotation == 180, F.array(-scale, zero, zero, scale, w, up))
        .when(rotation == 270, F.array(zero, -scale, -scale, zero, w, h + up))
    )


def cmyk_to_rgb(c: Column, m: Column, y: Column, k: Column) -> Column:
    """Channels 0-255 -> STRUCT r, g, b; single precision, truncated."""
    # division is in double precision; each step is rounded to single
    part = lambda x: F.lit(1.0).cast("float") - (x.cast("float") / F.lit(255.0).cast("float")).cast("float")
    byte = lambda x: (part(x) * part(k) * F.lit(255.0).cast("float")).cast("int")
    return F.struct(byte(c).alias("r"), byte(m).alias("g"), byte(y).alias("b"))
