"""Closed intervals [start, end] on sequences of a length, and matches of two such, as integer expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def length(start: Column, end: Column) -> Column:
    return end + 1 - start


def flip(start: Column, end: Column, size: Column) -> tuple[Column, Column]:
    """The same bases counted from the other end."""
    return size - 1 - end, size - 1 - start


def intersects(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    return (start_a <= end_b) & (start_b <= end_a)


def is_left_extreme(start: Column) -> Column:
    return start == 0


def is_right_extreme(end: Column, size: Column) -> Column:
    return end + 1 == size


def is_extreme(start: Column, end: Column, size: Column) -> Column:
    return is_left_extreme(start) | is_right_extreme(end, size)


def is_contained(start: Column, end: Column, size: Column) -> Column:
    """Whether the interval is the whole sequence."""
    return is_left_extreme(start) & is_right_extreme(end, size)


def complement(start: Column, end: Column, size: Column) -> tuple[Column, Column]:
    """The bases that an extreme interval leaves over; (0, -1) if it is the whole sequence."""
    return (
        F.when(is_contained(start, end, size), F.lit(0)).when(is_left_extreme(start), end + 1).otherwise(F.lit(0)),
        F.when(is_contained(start, end, size), F.lit(-1)).when(is_left_extreme(start), size - 1).otherwise(start - 1),
    )


def stretch(start: Column, end: Column, size: Column, by: Column) -> tuple[Column, Column, Column]:
    """An interval whose sequence, and the interval with it, has grown by so many bases at the right."""
    return start, end + by, size + by


def translate_1_to_0(position: Column, start0: Column, end0: Column, start1: Column, end1: Column, is_rc: Column) -> Column:
    """Position in sequence 0 of a position in sequence 1 under a match of both intervals."""
    return F.when(is_rc, end0 - (position - start1)).otherwise(start0 + (position - start1))


def contained_side(s0: Column, e0: Column, l0: Column, s1: Column, e1: Column, l1: Column, id0: Column, id1: Column) -> Column:
    """0 or 1: which sequence lies within the other (of two equal ones, that with the greater id); -1 for neither."""
    a, b = is_contained(s0, e0, l0), is_contained(s1, e1, l1)
    return F.when(a & b, F.when(id0 < id1, 1).otherwise(0)).when(a, 0).when(b, 1).otherwise(-1)
