"""Fields of frame and transcript records read from what producers write."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

from .text import fold, nfc


def keywords(c: Column) -> Column:
    """Keywords of a JSON document's ``keywords`` list as strings without blank ones; anything else gives none."""
    got = F.from_json(F.get_json_object(c, "$.keywords"), "array<string>")
    return F.coalesce(F.filter(got, lambda k: k.isNotNull() & (F.trim(k) != "")), F.array().cast("array<string>"))


def expected_frames(c: Column) -> Column:
    """Frame numbers a JSON document lists: the first of ``frame_indices``, ``keyframe_indices`` and ``frames`` it has, as
    numbers or as objects with ``frame_id`` or ``index``; null without any."""

    def one(name: str) -> Column:
        raw = F.get_json_object(c, f"$.{name}")
        plain = F.from_json(raw, "array<string>")
        number = lambda x: F.coalesce(x.try_cast("bigint"), F.get_json_object(x, "$.frame_id").try_cast("bigint"), F.get_json_object(x, "$.index").try_cast("bigint"))
        return F.filter(F.transform(plain, number), lambda x: x.isNotNull())

    return F.coalesce(*(one(n) for n in ("frame_indices", "keyframe_indices", "frames")))


def labels_of(c: Column) -> Column:
    """Labels of a JSON list; unreadable or null text gives none."""
    return F.coalesce(F.filter(F.from_json(c, "array<string>"), lambda x: x.isNotNull()), F.array().cast("array<string>"))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def frame_number(path: Column) -> Column:
    """Last run of digits in a file's name without its ending, else 0."""
    found = F.regexp_extract_all(stem(path), F.lit(r"(\d+)"), F.lit(1))
    return F.coalesce(F.get(found, F.size(found) - 1).try_cast("bigint"), F.lit(0).cast("bigint"))


def label_in_part(labels: Column, subject: str) -> Column:
    """Whether a word of three letters or more of the subject lies within a label; letter case and accents don't matter."""
    blob = fold(F.array_join(F.coalesce(labels, F.array().cast("array<string>")), " "))
    out = F.lit(False)
    for w in subject.split():
        if len(w) >= 3:
            out = out | F.contains(blob, fold(F.lit(w)))
    return F.coalesce(out, F.lit(False))


def facet_weight(facet: Column, entities: list[str]) -> Column:
    """1.4 for a facet that is one of the entity words, 1.2 for a phrase or more than 12 letters, else 1.0."""
    return F.when(F.lower(F.trim(facet)).isin([e.lower() for e in entities]), 1.4).when(F.contains(F.trim(facet), F.lit(" ")) | (F.length(F.trim(facet)) > 12), 1.2).otherwise(1.0)


def file_hash(path: Column, size: Column, modified: Column, length: int = 16) -> Column:
    """SHA-1 prefix of a file's path, size and time of change."""
    return F.substring(F.sha1(F.concat_ws("|", path, size.cast("string"), modified.cast("string"))), 1, length)


def content_hash(content: Column, length: int = 16) -> Column:
    """SHA-256 prefix of a file's content."""
    return F.substring(F.sha2(content, 256), 1, length)


def corrected(c: Column, corrections: Mapping[str, str]) -> Column:
    """Composed text with single blanks, and each wrong spelling replaced wherever it stands; a capital stays a capital."""
    out = F.trim(F.regexp_replace(nfc(c), r"\s+", " "))
    for wrong, right in corrections.items():
        for a, b in ((wrong.lower(), right.lower()), (wrong[:1].upper() + wrong[1:].lower(), right[:1].upper() + right[1:]), (wrong.upper(), right.upper())):
            out = F.replace(out, F.lit(a), F.lit(b))
    return out


def clean_segments(segments: Column) -> Column:
    """Segments with single blanks; blank texts, null, NaN, negative and inverted times are left out."""
    squeezed = F.transform(segments, lambda s: F.struct(F.trim(F.regexp_replace(s["text"], r"[\s\p{Z}]+", " ")).alias("text"), s["start"].alias("start"), s["end"].alias("end"), s["frame"].alias("frame")))
    fine = lambda s: F.coalesce((s["text"] != "") & ~F.isnan(s["start"]) & ~F.isnan(s["end"]) & (s["start"] >= 0) & (s["start"] <= s["end"]), F.lit(False))
    return F.coalesce(F.filter(squeezed, fine), F.filter(segments, lambda s: F.lit(False)))
