"""All logins of a period merged at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from venuedir.operators import merge


@dataclass(frozen=True)
class Annotations:
    favorites: DataFrame
    notes: DataFrame
    user_tags: DataFrame


def merge_logins(before: Annotations, logins: DataFrame) -> Annotations:
    """Annotations after the logins. Every part is computed from the state before them."""
    return Annotations(
        favorites=merge.merge_favorites(before.favorites, logins),
        notes=merge.merge_notes(before.notes, logins),
        user_tags=merge.merge_tags(before.user_tags, before.favorites, logins),
    )
