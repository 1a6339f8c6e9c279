"""Pixel algebra: indexes, masks, scaling and augmentation over long pixel tables and chips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbora.operators.ranks import percentiles

# Band order and the stored channel statistics (R, G, B, NIR, height).
BANDS = {"RGB": (1, 2, 3), "RGBI": (1, 2, 3, 4), "RGBIH": (1, 2, 3, 4, 5)}
CHANNEL_MEAN = (0.3603, 0.3813, 0.3470, 0.6094, 0.1883)
CHANNEL_STD = (0.1393, 0.1402, 0.1255, 0.1900, 0.0853)


def ndvi(nir: Column, red: Column, eps: float = 1e-6) -> Column:
    return (nir - red) / (nir + red + eps)


def canopy_masks(ndvi_: Column, height: Column, ndvi_min: float = 0.2, height_min: float = 2.0) -> dict[str, Column]:
    """``veg``, ``tall`` and ``canopy``; an unknown value is outside the mask."""
    veg, tall = F.coalesce(ndvi_ >= ndvi_min, F.lit(False)), F.coalesce(height >= height_min, F.lit(False))
    return {"veg": veg, "tall": tall, "canopy": veg & tall}


def height_mask(height: Column, least: float) -> Column:
    """``> 0`` for a threshold of 0 or less, else ``>= threshold``."""
    return F.coalesce(height > 0 if least <= 0 else height >= least, F.lit(False))


def encode_mask(mask: Column, encoding: str = "01") -> Column:
    if encoding not in ("01", "0255"):
        raise ValueError(f"unknown mask encoding {encoding!r}")
    return F.when(mask, 1 if encoding == "01" else 255).otherwise(0)


def height_to_u8(h: Column, low: Column, high: Column) -> Column:
    """Truncated to 0..255 over [low, high]; a flat tile is 0, an unknown height stays null."""
    scaled = F.least(F.greatest(F.floor(255 * (h - low) / F.nullif(high - low, F.lit(0.0))), F.lit(0)), F.lit(255))
    return F.when(h.isNotNull(), F.coalesce(scaled, F.lit(0))).cast("int")


def u8_to_height(v: Column, low: Column, high: Column) -> Column:
    return F.when(F.abs(high - low) < 1e-12, F.when(v.isNotNull(), 0.0)).otherwise(v / 255.0 * (high - low) + low)


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def select_bands(pixels: DataFrame, bands: list[int] | int) -> DataFrame:
    """The first n bands, or the given ones in that order, numbered anew from 1."""
    wanted = list(range(1, bands + 1)) if isinstance(bands, int) else list(bands)
    if not 3 <= len(wanted) <= 5 or not all(1 <= b <= 5 for b in wanted):
        raise ValueError(f"3 to 5 bands out of 1 to 5 are needed, not {wanted}")
    place = F.create_map(*[F.lit(v) for i, b in enumerate(wanted, 1) for v in (b, i)])
    return pixels.where(F.col("band").isin(wanted)).withColumn("band", place[F.col("band")])


def scale_to_unit(pixels: DataFrame, dtype: str, keys: list[str]) -> DataFrame:
    """``value`` to 0..1 by the raster's type; floats by the largest value of the image (above 300: 16 bits; above 2: 8 bits)."""
    v = F.col("value").cast("double")
    if dtype in ("uint8", "uint16"):
        scaled = v / (255.0 if dtype == "uint8" else 65535.0)
    else:
        # Summed up in each task first: an image's pixels need not meet.
        pixels = pixels.join(pixels.groupBy(*keys).agg(F.max(v).alias("_most")), keys)
        most = F.col("_most")
        scaled = F.when(most > 300, v / 65535.0).when(most > 2, v / 255.0).otherwise(v)
    return pixels.withColumn("value", F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0))).drop("_most")


def standardize(pixels: DataFrame, n: int = 5) -> DataFrame:
    """(value - mean) / std of the band, for the first ``n`` bands."""
    mean = F.array(*map(F.lit, CHANNEL_MEAN[:n]))
    std = F.array(*map(F.lit, CHANNEL_STD[:n]))
    return pixels.where(F.col("band") <= n).withColumn("value", (F.col("value") - F.get(mean, F.col("band") - 1)) / F.get(std, F.col("band") - 1))


def percentile_stretch(pixels: DataFrame, keys: list[str], low: float = 0.02, high: float = 0.98, checkpoint=None) -> DataFrame:
    """Stretch each image and band to 0..1 between two exact percentiles; where they meet, between least and greatest."""
    v = F.col("value").cast("double")
    stats = percentiles(pixels, keys, [low, high], checkpoint=checkpoint).withColumnsRenamed({"low": "_min", "high": "_max", "p0": "_p0", "p1": "_p1"})
    flat = F.col("_p1") <= F.col("_p0")
    a, b = F.when(flat, F.col("_min")).otherwise(F.col("_p0")), F.when(flat, F.col("_max")).otherwise(F.col("_p1"))
    stretched = F.when(b > a, F.least(F.greatest((v - a) / F.nullif(b - a, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return pixels.join(stats, keys, "left").withColumn("value", stretched).drop("_p0", "_p1", "_min", "_max")


def draw(keys: list[str], seed: int, salt: str = "") -> Column:
    """A number in [0, 1) from the row's key: the same in every run and for every partitioning."""
    return F.expr(f"cast(conv(substr(md5(concat_ws('|', {', '.join(keys)}, {seed}, '{salt}')), 1, 8), 16, 10) as double)") / 4294967296.0


def flip_boxes(boxes: DataFrame, width: float, keys: list[str], p: float = 0.5, seed: int = 0) -> DataFrame:
    """Mirror the boxes of an image at its vertical middle with probability ``p`` (one draw for each key)."""
    flip = draw(keys, seed) < p
    return boxes.withColumn("flipped", flip).withColumns({"x1": F.when(flip, width - F.col("x2")).otherwise(F.col("x1")), "x2": F.when(flip, width - F.col("x1")).otherwise(F.col("x2"))})


def augment_geometry(pixels: DataFrame, size: int, key: str, seed: int = 0, crop: float = 0.8) -> DataFrame:
    """Crop with bilinear resize (p 0.5), flips (p 0.5 each) and a turn by 0 to 3 quarters (p 0.5) of square chips, as pixel index algebra."""
    inner = max(1, int(size * crop))
    u = lambda salt: draw([key], seed, salt)
    cropped = u("crop") < 0.5
    top, left = F.floor(u("top") * (size - inner + 1)), F.floor(u("left") * (size - inner + 1))
    grid = F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    chips = pixels.select(key).distinct().withColumn("row", grid).withColumn("col", grid)
    r, c = F.col("row"), F.col("col")
    turn = F.when(u("turn") < 0.5, F.floor(u("angle") * 4)).otherwise(0)
    r1 = F.when(turn == 1, c).when(turn == 2, size - 1 - r).when(turn == 3, size - 1 - c).otherwise(r)
    c1 = F.when(turn == 1, size - 1 - r).when(turn == 2, size - 1 - c).when(turn == 3, r).otherwise(c)
    r2 = F.when(u("v") < 0.5, size - 1 - r1).otherwise(r1)
    c2 = F.when(u("h") < 0.5, size - 1 - c1).otherwise(c1)
    # Centres of pixels map to the cropped window; a target pixel is a mean of up to four source pixels.
    inside = lambda x: F.least(F.greatest((x + 0.5) * inner / size - 0.5, F.lit(0.0)), F.lit(inner - 1.0))
    y, x = F.when(cropped, inside(r2)).otherwise(r2.cast("double")), F.when(cropped, inside(c2)).otherwise(c2.cast("double"))
    edge = F.when(cropped, inner - 1).otherwise(size - 1)
    chips = chips.select(key, "row", "col", y.alias("_y"), x.alias("_x"), edge.alias("_e"), F.when(cropped, top).otherwise(0).alias("_t"), F.when(cropped, left).otherwise(0).alias("_l"))
    corner = lambda dy, dx: F.struct(
        (F.col("_t") + F.least(F.floor("_y") + dy, F.col("_e"))).cast("int").alias("r"), (F.col("_l") + F.least(F.floor("_x") + dx, F.col("_e"))).cast("int").alias("c"),
        (F.abs(1 - dy - (F.col("_y") - F.floor("_y"))) * F.abs(1 - dx - (F.col("_x") - F.floor("_x")))).alias("w"))
    chips = chips.select(key, "row", "col", F.explode(F.array(*[corner(dy, dx) for dy in (0, 1) for dx in (0, 1)])).alias("_p"))
    chips = chips.select(key, "row", "col", F.col("_p.r").alias("_r"), F.col("_p.c").alias("_c"), F.col("_p.w").alias("_w")).where("_w > 0")
    source = pixels.select(key, "band", F.col("row").alias("_r"), F.col("col").alias("_c"), "value")
    return chips.join(source, [key, "_r", "_c"]).groupBy(key, "band", "row", "col").agg(F.sum(F.col("value") * F.col("_w")).alias("value"))


def _clamped(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def _normal(place: list[str], seed: int, salt: str = "") -> Column:
    """A standard normal number from hashes of the pixel's place (Box and Muller), so runs repeat."""
    return F.sqrt(-2 * F.log(1 - draw(place, seed, f"{salt}a"))) * F.cos(2 * 3.141592653589793 * draw(place, seed, f"{salt}b"))


def _with_draws(pixels: DataFrame, key: str, seed: int, salts: tuple[str, ...]) -> DataFrame:
    """The pixels with a column of each draw of their image and of the pixel's normal number, so that steps can use them again."""
    drawn = pixels.select(key).distinct().withColumns({f"_{s}": draw([key], seed, s) for s in salts})
    return pixels.join(drawn, key).withColumn("_z", _normal([key, "band", "row", "col"], seed))


def augment_light(pixels: DataFrame, key: str, seed: int = 0, brightness: float = 0.2, noise: float = 0.05, height_noise: float = 0.02, p: float = 0.5, height_p: float = 0.3) -> DataFrame:
    """Brightness and then noise of bands 1 to 4, each with its own draw of ``p``; noise on band 5 with ``height_p``; each step ends within 0..1."""
    rows = _with_draws(pixels, key, seed, ("light", "gain", "noise", "height"))
    colour, v, u, z = F.col("band") <= 4, F.col("value"), lambda salt: F.col(f"_{salt}"), F.col("_z")
    rows = rows.withColumn("value", F.when(colour & (u("light") < p), _clamped(v * (1 - brightness + 2 * brightness * u("gain")))).otherwise(v))
    noisy = F.when(colour & (u("noise") < p), _clamped(v + noise * z)).when((F.col("band") == 5) & (u("height") < height_p), _clamped(v + height_noise * z))
    return rows.withColumn("value", noisy.otherwise(v)).select(*pixels.columns)


# Probabilities and ranges of the detector's augmentation.
DETECTOR = {"nir_gain": (0.6, 0.85, 0.30), "nir_noise": (0.3, 0.01, 0.02), "nir_drop": 0.03, "h_scale": (0.6, 0.95, 0.10), "h_shift": 0.10, "h_noise": (0.25, 0.01), "h_drop": 0.03}


def augment_detector(pixels: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """Gain, noise and drop-out of band 4; scale with shift, noise and drop-out of band 5. Each has its own draw (``DETECTOR``) and ends within 0..1."""
    d, v, u, z = DETECTOR, F.col("value"), lambda salt: F.col(f"_{salt}"), F.col("_z")
    rows = _with_draws(pixels, key, seed, ("nir", "nir_gain", "nir_noise", "nir_std", "nir_drop", "h", "h_scale", "h_shift", "h_noise", "h_drop"))
    nir, high = F.col("band") == 4, F.col("band") == 5
    between = lambda salt, low, wide: low + wide * u(salt)
    scaled = F.when(nir & (u("nir") < d["nir_gain"][0]), _clamped(v * between("nir_gain", *d["nir_gain"][1:])))
    scaled = scaled.when(high & (u("h") < d["h_scale"][0]), _clamped(v * between("h_scale", *d["h_scale"][1:]) + d["h_shift"] * (u("h_shift") - 0.5)))
    noisy = F.when(nir & (u("nir_noise") < d["nir_noise"][0]), _clamped(v + between("nir_std", *d["nir_noise"][1:]) * z)).when(high & (u("h_noise") < d["h_noise"][0]), _clamped(v + d["h_noise"][1] * z))
    rows = rows.withColumn("value", scaled.otherwise(v)).withColumn("value", noisy.otherwise(v))
    dropped = nir & (u("nir_drop") < d["nir_drop"]) | high & (u("h_drop") < d["h_drop"])
    return rows.withColumn("value", F.when(dropped, 0.0).otherwise(v)).select(*pixels.columns)
