"""Content identities: text hashes, canonical-JSON hashes, seeds and cache keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def identity(**facts: Column) -> Column:
    """Hash of facts in a canonical form: JSON with sorted names."""
    return F.sha2(F.to_json(F.struct(*[c.alias(k) for k, c in sorted(facts.items())]), {"ignoreNullFields": "false"}), 256)


def attempt_seed(base: Column, unit: Column, attempt: Column) -> Column:
    """(base + the first four bytes of a hash of unit and attempt) modulo 2**32."""
    head = F.conv(F.left(F.sha2(F.concat_ws(":", unit.cast("string"), attempt.cast("string")), 256), F.lit(8)), 16, 10).cast("bigint")
    return F.pmod(base.cast("bigint") + head, F.lit(1 << 32))


def cache_key(*parts: Column) -> Column:
    return F.concat_ws("|", *parts)


def padded_to(codes: Column, bucket: int = 25) -> Column:
    """An array padded to a multiple of bucket with its last element; empty stays empty."""
    short = F.pmod(-F.size(codes), F.lit(bucket))
    return F.when(F.size(codes) > 0, F.concat(codes, F.array_repeat(F.element_at(codes, -1), short))).otherwise(codes)
