"""Who an annotation belongs to."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

USER = "user"
DEVICE = "device"


@dataclass(frozen=True)
class Owner:
    """One composite owner key instead of a user column and a nullable device column."""

    kind: str
    id: str

    @classmethod
    def of(cls, user_id: int | str | None = None, device_id: str = "") -> Owner | None:
        """The user wins over the device; None when there is no identity."""
        if user_id is not None:
            return cls(USER, str(user_id))
        return cls(DEVICE, device_id) if device_id else None

    @classmethod
    def required(cls, user_id: int | str | None = None, device_id: str = "") -> Owner:
        owner = cls.of(user_id, device_id)
        if owner is None:
            raise ValueError("a device or a user is required")
        return owner

    def owns(self) -> Column:
        """Two plain equalities, which reach the Parquet scan."""
        return (F.col("owner_kind") == self.kind) & (F.col("owner_id") == self.id)


def rows_of(annotations: DataFrame, owner: Owner) -> DataFrame:
    return annotations.where(owner.owns())
