"""Stable identities, splits and ranks: all chance comes from SHA-256 of salted keys."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SplitConfig:
    """Shares of the splits; what train and val leave is test."""

    train: float = 0.8
    val: float = 0.1
    salt: str = "strandmill"

    def __post_init__(self):
        if not (self.train > 0 and self.val >= 0 and self.train + self.val < 1):
            raise ValueError("train > 0, val >= 0 and train + val < 1 are needed")


def text(key) -> Column:
    return (key if isinstance(key, Column) else F.col(key)).cast("string")


def short_id(value, prefix: str = "", length: int = 16) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(text(value), 256), 1, length))


def rank_key(salt: str, *parts) -> Column:
    """A digest to order rows by, without chance and without the order of input."""
    return F.sha2(F.concat_ws(":", F.lit(salt), *[text(p) for p in parts]), 256)


def unit(salt: str, key) -> Column:
    """A number from 0 to below 1: the first 64 bits of the digest."""
    return F.conv(F.substring(rank_key(salt, key), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(2.0**64)


def split_of(key, config: SplitConfig = SplitConfig()) -> Column:
    u = unit(config.salt, key)
    return F.when(u < config.train, "train").when(u < config.train + config.val, "val").otherwise("test")


class Sql:
    @staticmethod
    def rank_key(salt: str, *parts: str) -> str:
        return f"sha256({' || '.join([repr(salt), *[chr(39) + ':' + chr(39) + f' || ({p})::VARCHAR' for p in parts]])})"

    @staticmethod
    def unit(salt: str, key: str) -> str:
        return f"(('0x' || substr({Sql.rank_key(salt, key)}, 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0)"

    @staticmethod
    def split_of(key: str, config: SplitConfig = SplitConfig()) -> str:
        u = Sql.unit(config.salt, key)
        return f"(CASE WHEN {u} < {config.train!r} THEN 'train' WHEN {u} < {config.train + config.val!r} THEN 'val' ELSE 'test' END)"
