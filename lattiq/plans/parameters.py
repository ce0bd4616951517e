"""Sizing rules and search parameters derived from the statistics of an index."""

from __future__ import annotations

import math
from collections.abc import Mapping

# Fixed values that decide results: probes by result size, threshold steps, and the limits of t'.
PROBES = ((20, 2), (100, 4), (math.inf, 6))
THRESHOLD, THRESHOLD_STEP = 0.5, 0.05
T_PRIME_RANGE = (5_000, 200_000)
MANY_PARTITIONS, LONG_QUERY, LONG_QUERY_PROBES = 65_536, 48, 12


def sample_size(n_docs: int) -> int:
    """Documents sampled for training."""
    return min(1 + int(16 * math.sqrt(120 * n_docs)), n_docs)


def partitions_for(n_tokens: float) -> int:
    """Centroids for an (estimated) number of token vectors: a power of two near 16 times its root."""
    return 1 << max(0, math.floor(math.log2(16 * math.sqrt(max(n_tokens, 1)))))


def power_of_two(n: int) -> int:
    """The greatest power of two that is not above n."""
    return 1 << (n.bit_length() - 1) if n > 0 else 0


def search_parameters(meta: Mapping[str, float] | None, top_k: int, query_tokens: int) -> tuple[int, int, float, int, int] | None:
    """``(bound, nprobe, threshold, max_candidates, t_prime)`` suggested for an index; None without metadata."""
    if meta is None:
        return None
    n, parts = int(meta["num_embeddings"]), int(meta["num_partitions"])
    per_cell = n / max(1, parts)
    probes = next(p for limit, p in PROBES if top_k <= limit) + int(math.log10(max(per_cell, 1.0)))
    probes = max(2, min(probes, min(32, parts)))
    if parts >= MANY_PARTITIONS and query_tokens >= LONG_QUERY:
        probes = max(probes, LONG_QUERY_PROBES)
    threshold = THRESHOLD
    for crowded, wide in ((1_000, 50), (2_500, 200)):
        if per_cell > crowded or top_k >= wide:
            threshold -= THRESHOLD_STEP
    expected = int(per_cell * probes * max(1, query_tokens))
    candidates = min(max(expected, 50 * top_k), n) // 2
    look = int(per_cell * probes * max(1, query_tokens // 2))
    doclen = meta["avg_doclen"]
    if doclen > 0 and per_cell < 256:
        look = int(look * max(0.35, min(120.0 / doclen, 1.0)))
    look = min(max(T_PRIME_RANGE[0], min(look, T_PRIME_RANGE[1])), n)
    return max(8 * probes, int(0.05 * parts)), probes, threshold, candidates, look


def default_t_prime(n_embeddings: int, n_centroids: int, k: int) -> int:
    """t' where a caller gives none to the low-level search."""
    if n_centroids <= MANY_PARTITIONS:
        return max(1_000, int(math.sqrt(8.0 * n_embeddings) / 1_000) * 1_000)
    return 100_000 if k > 100 else 50_000


def device_ratios(devices: list[str], shardable: int) -> dict[str, float]:
    """Shares of an index by device.  Spark places executors itself: all of it goes to ``cpu`` where listed,
    otherwise every device gets an equal share."""
    if not devices:
        return {}
    if shardable and "cpu" in devices:
        return {"cpu": 1.0}
    return dict.fromkeys(devices, 1.0 / len(devices))
