"""Portable, deterministic column expressions.

Everything here is a composition of Spark built-ins, so it stays inside
whole-stage codegen.  The md5-based expressions have a word-for-word
equivalent in DuckDB, which is what the SQL oracle relies on.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _s(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def hex_cut(fraction: float) -> str:
    """Four hex digits h such that ``substr(md5(x), 1, 4) < h`` holds for ``fraction`` of keys."""
    if not 0.0 <= fraction <= 1.0:
        raise ValueError("fraction must be in [0, 1]")
    return format(min(int(round(fraction * 65536)), 65535), "04x") if fraction < 1 else "g"


def in_hash_sample(user, item, fraction: float, salt: str = "") -> Column:
    """True for a reproducible ``fraction`` of (user, item) keys.

    Unlike ``randomSplit`` the outcome depends only on the key, never on the
    partitioning or the order of the input.
    """
    key = F.concat(F.lit(salt), _s(user), F.lit(":"), _s(item))
    return F.substring(F.md5(key), 1, 4) < F.lit(hex_cut(fraction))


def hash_order_key(*cols, seed: int = 0) -> Column:
    """Seeded pseudo-random but reproducible sort key (hex string)."""
    parts = [F.lit(str(seed))]
    for c in cols:
        parts += [F.lit(":"), _s(c)]
    return F.md5(F.concat(*parts))


def user_digest(user, chunk: int, seed: int) -> Column:
    """md5 of (seed, user, chunk): 32 hex digits = 32 independent random signs."""
    return F.md5(F.concat(F.lit(f"{seed}:"), _s(user), F.lit(f":{chunk}")))


def digest_sign(digest, table: int) -> Column:
    """+1 if hex digit ``table % 32`` of ``digest`` is below '8', else -1."""
    d = F.col(digest) if isinstance(digest, str) else digest
    return F.when(F.substring(d, table % 32 + 1, 1) < F.lit("8"), F.lit(1)).otherwise(F.lit(-1))


def distance_to_cosine(distance) -> Column:
    """Cosine of two unit vectors from their Euclidean distance: 1 - d^2 / 2."""
    d = F.col(distance) if isinstance(distance, str) else distance
    return F.lit(1.0) - d * d / F.lit(2.0)


def rank_confidence(rank) -> Column:
    """Display confidence of the n-th recommendation (1-based): max(95 - 5 (n-1), 75)."""
    r = F.col(rank) if isinstance(rank, str) else rank
    return F.greatest(F.lit(95) - F.lit(5) * (r - F.lit(1)), F.lit(75)).cast("int")
