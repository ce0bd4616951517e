import pytest

from lattiq.plans import parameters as p
from lattiq.operators import maintain

GOLDEN = [
    ((12800, 1024, 128, 10, 30), (51, 3, 0.5, 562, 5000)),
    ((500, 256, 5, 10, 4), (16, 2, 0.5, 250, 500)),
    ((30000, 2048, 300, 10, 30), (102, 3, 0.5, 659, 5000)),
    ((5_000_000, 32768, 100, 100, 32), (1638, 6, 0.45, 14648, 14648)),
    ((200_000_000, 65536, 120, 200, 64), (3276, 12, 0.4, 1171875, 200000)),
]


@pytest.mark.parametrize("given,want", GOLDEN)
def test_search_parameters(given, want):
    n, parts, doclen, k, t = given
    got = p.search_parameters({"num_embeddings": n, "num_partitions": parts, "avg_doclen": doclen}, k, t)
    assert got == pytest.approx(want)


def test_sizes():
    assert [p.partitions_for(n) for n in (500, 2000, 12800, 30000, 10**6)] == [256, 512, 1024, 2048, 8192]
    assert [p.sample_size(n) for n in (100, 50000, 382545)] == [100, 39192, 108406]
    assert p.search_parameters(None, 10, 4) is None
    assert [p.power_of_two(n) for n in (0, 1, 5, 8, 1000)] == [0, 1, 4, 8, 512]
    assert p.default_t_prime(10, 256, 10) == 1000 and p.default_t_prime(10**9, 1 << 17, 200) == 100_000


def test_device_map():
    assert p.device_ratios(["cpu"], 5) == {"cpu": 1.0}
    assert p.device_ratios(["a", "b"], 5) == {"a": 0.5, "b": 0.5}


def test_growth_and_blend():
    assert maintain.growth(49, 1000) == 0
    assert maintain.growth(50, 1000) == 1
    assert maintain.growth(256 * 7, 1000) == 4
    assert maintain.growth(10**6, 20) == 2
    assert maintain.blended(1.0, 3, 2.0, 1) == 1.25
    est = maintain.memory_estimate(1000, 16, 64, 4)
    assert est["total"] == sum(v for k, v in est.items() if k != "total")
