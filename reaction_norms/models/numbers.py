"""Random numbers as a function of (seed, draw, place), as columns and inside tasks.

Numbers come from a digest of that triple, not from a generator with a state: any task, any number
of partitions and any engine with MD5 gives the same ones. A digest holds two uniform
numbers of 52 bits; Box-Muller turns them into two independent normal ones.
"""

from __future__ import annotations

import hashlib
import sys
from types import ModuleType

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hexadecimal digits of a uniform number.
DIGITS = 13
ONE = float(16**DIGITS)


def literal(values) -> Column:
    """A constant array of doubles (or of rows of doubles), as one expression."""
    if np.ndim(values) == 2:
        return F.expr("array(" + ",".join("array(" + ",".join(f"{float(x)!r}D" for x in row) + ")" for row in values) + ")")
    return F.expr("array(" + ",".join(f"{float(x)!r}D" for x in values) + ")")


def digest(seed: int, draw: Column, place: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), draw.cast("string"), place.cast("string")))


def uniform(digest: Column, which: int) -> Column:
    """The first (0) or second (1) uniform number of a digest, strictly between 0 and 1."""
    return (F.conv(F.substring(digest, 1 + DIGITS * which, DIGITS), 16, 10).cast("double") + 0.5) / ONE


def normals(seed: int, draw: Column, first: Column, count: int) -> Column:
    """``count`` standard normal numbers from the places ``first`` and on, two for each place."""

    def two(place: Column) -> Column:
        h = digest(seed, draw, first + place)
        radius, angle = F.sqrt(-2 * F.log(uniform(h, 0))), 2 * F.pi() * uniform(h, 1)
        return F.array(radius * F.cos(angle), radius * F.sin(angle))

    pairs = F.transform(F.sequence(F.lit(0), F.lit((count + 1) // 2 - 1)), two)
    return F.slice(F.flatten(pairs), 1, count)


def uniforms_of(seed: int, draws: np.ndarray, places: range) -> np.ndarray:
    """The uniform numbers of every draw and place: (draws, places, 2)."""
    raw = b"".join(hashlib.md5(f"{seed}:{d}:{p}".encode()).digest() for d in draws.tolist() for p in places)
    words = np.frombuffer(raw, ">u8").astype(np.uint64).reshape(len(draws), len(places), 2)
    first = words[..., 0] >> np.uint64(12)
    second = ((words[..., 0] & np.uint64(0xFFF)) << np.uint64(40)) | (words[..., 1] >> np.uint64(24))
    return (np.stack([first, second], axis=-1).astype(np.float64) + 0.5) / ONE


def normals_of(uniforms: np.ndarray, count: int) -> np.ndarray:
    """``count`` standard normal numbers of every draw, from its uniform numbers."""
    radius, angle = np.sqrt(-2 * np.log(uniforms[..., 0])), 2 * np.pi * uniforms[..., 1]
    return np.stack([radius * np.cos(angle), radius * np.sin(angle)], axis=-1).reshape(len(uniforms), -1)[:, :count]


def remembered(key: tuple, make, most: int = 32):
    """A value that a worker process keeps from batch to batch and task to task, ``most`` of them.

    Task code is shipped by value, so its own globals begin anew with every task.
    """
    kept = vars(sys.modules.setdefault("_model_process_cache", ModuleType("_model_process_cache"))).setdefault("kept", {})
    if key not in kept:
        while len(kept) >= most:
            kept.pop(next(iter(kept)))
        kept[key] = make()
    return kept[key]
