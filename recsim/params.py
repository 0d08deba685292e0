"""Run parameters (one immutable record instead of a command line)."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Params:
    # Defaults of the pipeline (fixed values, kept equal to the original tool).
    bucket_length: float = 2.0      # MLlib LSH bucket width
    num_hash_tables: int = 3        # LSH tables (OR-amplification)
    threshold: float = 1.0          # max Euclidean distance between unit vectors
    top_k: int = 20                 # neighbours kept per item
    default_rating: float = 3.0     # fallback prediction
    min_ratings: int = 5            # item support floor (>=)
    test_fraction: float = 0.1      # hold-out share
    seed: int = 126784              # split / LSH seed
    similar_k: int = 5              # result size of the similar-item query
    user_top_n: int = 5             # titles per user recommendation list
    search_limit: int = 20          # title search result cap

    # Our own additions.
    bits_per_band: int = 1          # AND-amplification of the relational LSH
    bucket_items: int = 64          # items of an average bucket of the multi-probe LSH
    probes: int = 2                 # further buckets that it looks into per band
    min_neighbors: int = 1          # rated neighbours needed for a user recommendation
    item_block: int = 8192          # items per sub-block of the blocked Gram product
    side_rows: int = 1_000_000      # rating rows per block side and user stripe

    @property
    def min_cosine(self) -> float:
        """Distance < t between unit vectors  <=>  cosine > 1 - t^2 / 2."""
        return 1.0 - self.threshold * self.threshold / 2.0

    def with_(self, **kw) -> "Params":
        return replace(self, **kw)
