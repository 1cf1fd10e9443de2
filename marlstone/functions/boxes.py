"""Bounding boxes: conversion between their formats.

Formats: ``ltwh`` (left, top, width, height), ``ltrb`` (left, top, right, bottom), ``ccwh`` (centre x, centre y, width,
height); in pixels or as fractions of the image.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FORMATS = ("ltwh", "ltrb", "ccwh")


def _to_ltwh(b: list[Column], kind: str) -> list[Column]:
    x, y, p, q = b
    return [x, y, p, q] if kind == "ltwh" else [x, y, p - x, q - y] if kind == "ltrb" else [x - p / 2, y - q / 2, p, q]


def _from_ltwh(b: list[Column], kind: str) -> list[Column]:
    x, y, w, h = b
    return [x, y, w, h] if kind == "ltwh" else [x, y, x + w, y + h] if kind == "ltrb" else [x + w / 2, y + h / 2, w, h]


def convert(boxes: Column, source: str, target: str, width: Column | None = None, height: Column | None = None, to_fractions: bool | None = None) -> Column:
    """An array of boxes in another format; with ``to_fractions`` true or false also from pixels to fractions of ``width``
    and ``height``, or back."""
    for k in (source, target):
        if k not in FORMATS:
            raise ValueError(f"unknown box format {k!r}")

    def one(b: Column) -> Column:
        parts = _from_ltwh(_to_ltwh([F.get(b, F.lit(i)).cast("double") for i in range(4)], source), target)
        if to_fractions is not None:
            size = [width, height, width, height]
            parts = [p / s if to_fractions else p * s for p, s in zip(parts, size)]
        return F.array(*parts)

    return F.transform(boxes, one)
