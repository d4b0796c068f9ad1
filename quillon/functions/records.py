"""Fields of records as Column expressions: quads, prompts, ids, labels, paths, times, parameters of profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.operators.gates import reasons


def parse_quad(text: Column) -> Column:
    """Four [x, y] points from JSON, a list or an object's `corners`; null where it is anything else or not finite."""
    inner = F.coalesce(F.get_json_object(text, "$.corners"), text)
    quad = F.from_json(inner, "array<array<double>>")
    fine = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return F.when((F.size(quad) == 4) & F.forall(quad, lambda p: (F.size(p) == 2) & F.forall(p, fine)), quad)


def side_lengths(quad: Column) -> tuple[Column, Column]:
    """(mean of the upper and lower side, mean of the left and right one) of an ordered quad."""
    side = lambda a, b: F.hypot(quad[b][0] - quad[a][0], quad[b][1] - quad[a][1])
    return (side(0, 1) + side(3, 2)) / 2, (side(0, 3) + side(1, 2)) / 2


def prompt_reasons(points: Column, has_box: Column, has_mask: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A region prompt needs points, a box or a mask, and a box needs an area."""
    return reasons([(~(points > 0) & ~has_box & ~has_mask, "no input"), (has_box & ~((x1 > x0) & (y1 > y0)), "empty box")])


def observation_reasons(form: Column, frames: Column) -> Column:
    """Frame ids (an array) are unique; a still has one frame, a sequence two at least."""
    n = F.size(frames)
    return reasons([(F.size(F.array_distinct(frames)) != n, "frame ids repeat"), ((form == "still") & (n != 1), "a still has one frame"), ((form == "sequence") & (n < 2), "a sequence has two frames")])


def profile_id_matches(report: Column, card: Column) -> Column:
    """The report's id is the card's, or begins with it and a hyphen; letters in either case, blanks match nothing."""
    a, b = F.lower(F.coalesce(report, F.lit(""))), F.lower(F.coalesce(card, F.lit("")))
    return (F.trim(a) != "") & (F.trim(b) != "") & ((a == b) | F.startswith(a, F.concat(b, F.lit("-"))))


def safe_frame_id(value: Column) -> Column:
    low = F.lower(value)
    return F.when(low.rlike(r"^[a-z0-9][a-z0-9._-]{1,95}\z"), low)


def relative_inside(root: Column, target: Column) -> Column:
    """The path of target below root (both normal and absolute); null where it is not below."""
    base = F.concat(F.rtrim(root, F.lit("/")), F.lit("/"))
    rest = F.substr(target, F.length(base) + 1)
    return F.when(F.startswith(target, base) & (rest != ""), rest)


def angle_label(pose: Column, notes: Column) -> Column:
    """The pose's label, else what follows ANGLE: in the notes up to the line's end or a semicolon; null without either."""
    own = F.lower(F.trim(F.coalesce(pose, F.lit(""))))
    marked = F.lower(F.trim(F.regexp_extract(F.coalesce(notes, F.lit("")), r"ANGLE:([^\n;]*)", 1)))
    return F.when(own != "", F.concat(F.lit("pose:"), own)).when(marked != "", F.concat(F.lit("note:"), marked))


def utc_time(text: Column) -> Column:
    """An ISO time as a timestamp, in UTC where it names no zone (under a session in UTC); null where it is none."""
    return F.try_to_timestamp(text)


def json_object(text: Column) -> Column:
    """The fields of a JSON object as a map of texts; an absent text has none; null where it is not an object."""
    return F.when(text.isNull(), F.from_json(F.lit("{}"), "map<string,string>")).when(F.trim(text).startswith("{"), F.from_json(text, "map<string,string>"))


def registration_accepted(status: Column) -> Column:
    return F.coalesce(status == "accepted", F.lit(False))


def coupling_broken(least: Column, most: Column) -> Column:
    """Both bounds are numbers and out of order."""
    return F.coalesce(least > most, F.lit(False))


def parameter(profile: Column, name: str) -> Column:
    """A number of a JSON document by its dotted path."""
    return F.get_json_object(profile, f"$.{name}").try_cast("double")


def cache_key(profile: Column, names: Sequence[str]) -> Column:
    """SHA-256 of the named parameters as compact JSON in order of name, whole numbers without a point; null where one is missing."""
    said = lambda v: F.when(v == F.floor(v), v.cast("long").cast("string")).otherwise(v.cast("string"))
    fields = [F.concat(F.lit(f'"{n}":'), said(parameter(profile, n))) for n in sorted(names)]
    return F.sha2(F.concat(F.lit("{"), *[x for k, f in enumerate(fields) for x in ((F.lit(","), f) if k else (f,))], F.lit("}")), 256)
