"""Token ids and training labels as array columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

IGNORED = -100


def truncate_ids(ids: Column, max_length: int) -> Column:
    return F.slice(ids, 1, max_length)


def mask_labels(ids: Column, marker: Sequence[int], pad_id: int | None) -> Column:
    """Labels that train only on what follows the last marker.

    Everything up to one token past the last occurrence of ``marker`` is ignored; without a marker
    the whole row is. Pad tokens are ignored wherever they stand.
    """
    if not marker:
        raise ValueError("the marker needs at least one token id")
    width = len(marker)
    wanted = F.array(*[F.lit(int(m)) for m in marker])
    # At least one position is probed: sequence(1, 0) would count down.
    positions = F.sequence(F.lit(1), F.greatest(F.size(ids) - F.lit(width - 1), F.lit(1)))
    last = F.array_max(
        F.filter(positions, lambda p: (F.get(ids, p - 1) == marker[0]) & (F.slice(ids, p, width) == wanted))
    )

    def labels(masked: Column) -> Column:
        def label(value: Column, index: Column) -> Column:
            ignored = index < masked
            if pad_id is not None:
                ignored = ignored | (value == F.lit(int(pad_id)))
            return F.when(ignored, F.lit(IGNORED)).otherwise(value)

        return F.transform(ids, label)

    return let(F.coalesce(last + F.lit(width), F.size(ids)), labels)


def pad_ids(ids: Column, width: Column, pad_id: int, side: str = "right") -> Column:
    missing = F.array_repeat(F.lit(int(pad_id)), F.greatest(width - F.size(ids), F.lit(0)))
    return F.concat(ids, missing) if side == "right" else F.concat(missing, ids)


def attention_mask(ids: Column, width: Column, side: str = "right") -> Column:
    ones = F.array_repeat(F.lit(1), F.size(ids))
    zeros = F.array_repeat(F.lit(0), F.greatest(width - F.size(ids), F.lit(0)))
    return F.concat(ones, zeros) if side == "right" else F.concat(zeros, ones)
