"""Names, tags and transcript words as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path, r"\\", "/"), "/"), -1)


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def class_from_filename(path: Column) -> Column:
    """Class label carried by a clip's file name.

    ``a__b.wav`` is class a. Otherwise the first part of the name decides how many of the parts
    belong to the label; any other name is its own class.
    """
    name = basename(path)
    parts = F.split(stem(name), "_")
    n = F.size(parts)
    def joined(start, drop):
        return F.array_join(F.slice(parts, F.lit(start), F.greatest(F.lit(0), n - drop)), "_")
    head = F.element_at(parts, 1)
    inner = joined(2, 2)
    return (F.when(F.contains(name, F.lit("__")), F.element_at(F.split(name, "__"), 1))
            .when(head == "esc50", F.when(inner == "", "esc50").otherwise(inner))
            .when(head == "us8k", F.concat(F.lit("us8k_"), F.element_at(parts, -1)))
            .when(head == "proc", F.concat(F.lit("proc_"), inner))
            .when(head == "babble", joined(1, 2))
            .otherwise(stem(name)))


def class_full_label(path: Column) -> Column:
    """As :func:`class_from_filename`, but ``us8k_NNNNN_a_b`` keeps the whole label a_b."""
    name = stem(basename(path))
    whole = F.regexp_extract(name, r"^us8k_[^_]*_(.+)$", 1)
    return F.when(whole != "", whole).otherwise(class_from_filename(path))


def tag(*parts: Column) -> Column:
    return F.concat_ws("|", *parts)


def tag_part(col: Column, i: int) -> Column:
    return F.element_at(F.split(col, r"\|"), i)


def group_tag(prefix: str, classes: Column) -> Column:
    """``prefix|class|class|class`` with at most three classes."""
    return F.concat_ws("|", F.lit(prefix), F.slice(classes, 1, 3))


def kind_of_tag(col: Column) -> Column:
    """``pos`` for positives, else the first two parts of the tag."""
    return F.when(col.startswith("pos|"), F.lit("pos")).otherwise(
        F.array_join(F.slice(F.split(col, r"\|"), 1, 2), "|"))


def any_contains(words: Column, piece: str) -> Column:
    return F.exists(words, lambda w: F.contains(w, F.lit(piece)))


def any_of(words: Column, wanted: list[str]) -> Column:
    return F.arrays_overlap(words, F.array(*[F.lit(w) for w in wanted]))


def source_of_name(name: Column, rules: list[tuple[str, list[str]]], default: str) -> Column:
    """First rule with a piece that the name contains; later rules override earlier ones."""
    out = F.lit(default)
    for label, pieces in rules:
        cond = F.lit(False)
        for p in pieces:
            cond = cond | F.contains(name, F.lit(p))
        out = F.when(cond, F.lit(label)).otherwise(out)
    return out
