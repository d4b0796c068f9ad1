"""Scalar functions as Column expressions: colour, angles, paths, text rules, hashes."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-6


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(c, F.lit(float(high))), F.lit(float(low)))


# ---- colour

def srgb_to_linear(c: Column) -> Column:
    """A gamma-coded channel in 0..1 to linear light."""
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def linear_to_srgb_byte(c: Column) -> Column:
    """A linear channel to a gamma-coded byte; ties round to even."""
    v = clamp(c, 0, 1)
    coded = F.when(v <= 0.0031308, v * 12.92).otherwise(1.055 * F.pow(v, F.lit(1 / 2.4)) - 0.055)
    return F.bround(clamp(coded, 0, 1) * 255, 0).cast("int")


def luminance(r: Column, g: Column, b: Column) -> Column:
    return 0.2126 * r + 0.7152 * g + 0.0722 * b


def opponent_hue(r: Column, g: Column, b: Column) -> tuple[Column, Column]:
    """(hue in radians, chroma) on the red-green/blue opponent axes."""
    x, y = r - 0.5 * (g + b), (math.sqrt(3) / 2) * (g - b)
    return F.atan2(y, x), F.hypot(x, y)


def sector_hue(r: Column, g: Column, b: Column) -> tuple[Column, Column]:
    """(hue in degrees, chroma = max - min) by hexagon sector; hue 0 where there is no chroma."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    chroma = top - low
    safe = F.greatest(chroma, F.lit(EPSILON))
    sector = F.when(top == r, (g - b) / safe).when(top == g, (b - r) / safe + 2).otherwise((r - g) / safe + 4)
    return F.when(chroma <= EPSILON, 0.0).otherwise(F.pmod(sector * 60, F.lit(360.0))), chroma


# ---- angles and numbers

def wrap_degrees(c: Column) -> Column:
    return F.pmod(c, F.lit(360.0))


def signed_angle(value: Column, reference: Column) -> Column:
    """value - reference in [-180, 180)."""
    return F.pmod(value - reference + 180.0, F.lit(360.0)) - 180.0


def uncertainty(logit: Column) -> Column:
    """1 at the decision boundary, 0 far from it."""
    x = clamp(logit, -20, 20)
    return 1 - 2 * F.abs(1 / (1 + F.exp(-x)) - 0.5)


def half_up(c: Column, digits: int = 4) -> Column:
    """Rounds ties towards plus infinity."""
    return F.floor(c * 10**digits + 0.5) / 10**digits


def next_step(step: Column, least: Column) -> Column:
    """Half the step, or 0 below the least step."""
    return F.when(step / 2 < least, 0.0).otherwise(step / 2)


# ---- paths and names

def safe_relative_path(p: Column) -> Column:
    """Whether a path is relative, without scheme, backslash, parent parts, home or trailing slash."""
    bad = F.contains(p, F.lit("\\")) | F.contains(p, F.lit("://")) | p.startswith("/") | p.startswith("~") | p.endswith("/") | (p == "") | F.array_contains(F.split(p, "/"), "..")
    return F.coalesce(~bad, F.lit(False))


def asset_uri_reason(uri: Column, private: Sequence[str] = ("raw", "private-references", "source")) -> Column:
    """Why an asset's address is not allowed, null where it is."""
    return (
        F.when(uri.isNull() | (uri == ""), "empty")
        .when(uri.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), "scheme")
        .when(uri.startswith("//"), "remote")
        .when(F.contains(uri, F.lit("\\")), "backslash")
        .when(uri.startswith("/") | uri.startswith("~"), "absolute")
        .when(F.array_contains(F.split(uri, "/"), ".."), "parent")
        .when(F.arrays_overlap(F.split(F.lower(uri), "/"), F.array(*[F.lit(x) for x in private])), "private")
    )


def safe_extension(uri: Column) -> Column:
    """The lower-case extension where it is 1 to 8 letters or digits, else .bin."""
    ext = F.lower(F.regexp_extract(F.coalesce(uri, F.lit("")), r"(\.[A-Za-z0-9]{1,8})$", 1))
    return F.when(ext == "", ".bin").otherwise(ext)


def asset_name(channel: Column, digest: Column, uri: Column) -> Column:
    return F.concat(channel, F.lit("-"), F.substring(digest, 1, 16), safe_extension(uri))


def is_slug(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[a-z0-9][a-z0-9._-]{1,95}$"), F.lit(False))


def clean_hashes(c: Column) -> Column:
    """Trimmed, lower-cased, without empty ones."""
    return F.filter(F.transform(c, lambda x: F.lower(F.trim(x))), lambda x: x != "")


def marked_note(notes: Column, marker: str) -> Column:
    """What follows the marker up to a line's end or semicolon, trimmed and lower-cased; null where there is none."""
    got = F.lower(F.trim(F.regexp_extract(F.coalesce(notes, F.lit("")), rf"{marker}([^\n;]*)", 1)))
    return F.when(got != "", got)


def canonical_digest(*fields: Column) -> Column:
    """SHA-256 of compact JSON with the given fields, which the caller names in alphabetical order; nulls are left out."""
    return F.sha2(F.to_json(F.struct(*fields)), 256)


def words_in(text: Column, words: Sequence[str]) -> Column:
    """The words that text has as whole words, in the order given."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.filter(F.array(*[F.when(low.rlike(rf"\b{w}\b"), F.lit(w)) for w in words]), lambda x: x.isNotNull())
