"""Keys: normal form, keyed tags and what is routed by them. Built-in functions only.

A key is at most ``k`` bytes and padded with zeros on the right, so ``a`` and ``a\\0`` are one key. Null
and longer keys are refused (``checked``), never merged or cut.

Tags are 64-bit patterns in a bigint. ``aes_tag`` is the first eight bytes, little end first, of the
AES-128 CBC-MAC (zero start, zero padding); ``sha_tag`` has the first 60 bits of SHA-256, which other
engines compute as well.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY_BYTES = 16
ROUTING_MASK, LEAF_ONE = 0x7FFFFFFF, 1 << 31
SIGN = -(1 << 63)


def new_key() -> bytes:
    return secrets.token_bytes(16)


def binary(key: Column) -> Column:
    return key.cast("binary")


def checked(df: DataFrame, key: str, k: int = KEY_BYTES) -> DataFrame:
    """``df``; the job fails on the first null key and on the first one of more than ``k`` bytes."""
    b = binary(F.col(key))
    wrong = F.when(b.isNull(), F.raise_error(F.lit("null key"))).when(F.octet_length(b) > k, F.raise_error(F.lit(f"key of more than {k} bytes")))
    return df.withColumn(key, F.coalesce(wrong.cast("binary"), b))


def pad(key: str, k: int = KEY_BYTES) -> Column:
    """The normal form of the column named ``key``: cut to ``k`` bytes, zeros to the right."""
    return F.expr(f"rpad(substring(cast({key} as binary), 1, {k}), {k}, x'00')")


def _little_end(eight: Column) -> Column:
    h = F.hex(eight)
    turned = F.concat(*(F.substring(h, i, 2) for i in range(15, 0, -2)))
    return F.conv(turned, 16, -10).cast("bigint")


def aes_tag(key: str, secret: bytes, longest: int = KEY_BYTES) -> Column:
    """The tag of the binary column ``key`` of at most ``longest`` bytes (not padded beforehand)."""
    blocks = max(1, -(-longest // 16))
    own = F.expr(f"cast(greatest(1, ceil(octet_length({key}) / 16.0)) as int)") if blocks > 1 else F.lit(1)
    padded = F.expr(f"rpad({key}, cast(greatest(1, ceil(octet_length({key}) / 16.0)) as int) * 16, x'00')")
    if blocks == 1:
        mac = F.substring(F.aes_encrypt(padded, F.lit(secret), F.lit("ECB"), F.lit("PKCS")), 1, 8)
    else:
        made = F.aes_encrypt(padded, F.lit(secret), F.lit("CBC"), F.lit("DEFAULT"), F.lit(b"\x00" * 16))
        mac = F.substring(made, 1 + 16 * own, F.lit(8))
    return _little_end(mac)


def sha_tag(text: Column) -> Column:
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 15), 16, 10).cast("bigint")


def is_real(tag: Column) -> Column:
    return tag != 0


def routing_bits(tag: Column) -> Column:
    return tag.bitwiseAND(F.lit(ROUTING_MASK))


def leaf(tag: Column, height: int) -> Column:
    """The leaf's number in heap order: from 2^height to 2^(height + 1) - 1."""
    return F.shiftright(routing_bits(tag).bitwiseOR(F.lit(LEAF_ONE)), 31 - height)


def shard(tag: Column, shards: int) -> Column:
    if shards < 1 or shards & (shards - 1):
        raise ValueError("the number of shards must be a power of two")
    return F.shiftrightunsigned(tag, 32).bitwiseAND(F.lit(shards - 1)).cast("int")


def subtree(tag: Column, cut: int) -> Column:
    return F.shiftright(routing_bits(tag), 31 - cut).cast("int")


def node_at_depth(leaf_node: Column, height: int, depth: int) -> Column:
    """The node of a leaf's path at ``depth``."""
    return F.shiftright(leaf_node, height - depth)


def node_depth(node: int) -> int:
    return node.bit_length() - 1


def is_leaf(node: int, height: int) -> bool:
    return node_depth(node) == height


def with_leaf(tag: int, leaf_node: int, height: int) -> int:
    """``tag`` with the routing bits that lead to ``leaf_node``; makes test data."""
    low = (leaf_node - (1 << height)) << (31 - height)
    mask = ((1 << height) - 1) << (31 - height)
    return tag & ~mask | low


def unsigned_order(tag: Column) -> Column:
    """What to sort by for the order of the unsigned 64-bit patterns."""
    return tag.bitwiseXOR(F.lit(SIGN))


def eviction_leaves(height: int, start: int, count: int) -> list[int]:
    """``count`` leaves from the ``start``-th on, in the order of bit-reversed numbers."""
    n = 1 << height
    return [n | int(format(i % n, f"0{height}b")[::-1], 2) for i in range(start, start + count)]


def prepared(df: DataFrame, key: str, shards: int, secret: bytes | None = None, k: int = KEY_BYTES) -> DataFrame:
    """``df`` with tag and shard of each (checked) key; by SHA-256 where there's no secret."""
    tag = aes_tag(key, secret, k) if secret else sha_tag(F.col(key))
    return df.withColumn("tag", tag).withColumn("shard", shard(F.col("tag"), shards))
