import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from lattiq.functions import codec


def test_golden_bytes():
    assert codec.pack(np.array([[1, 8, 15, 3]], np.uint8), 4).tolist() == [[129, 252]]
    assert codec.pack(np.array([[1, 2, 3, 0]], np.uint8), 2).tolist() == [[156]]


@given(st.sampled_from([2, 4]), st.integers(1, 16), st.integers(0, 2**32 - 1))
def test_round_trip(nbits, groups, seed):
    codes = np.random.default_rng(seed).integers(0, 1 << nbits, (3, groups * 8)).astype(np.uint8)
    packed = codec.pack(codes, nbits)
    assert packed.shape[1] == groups * nbits
    assert (codec.unpack(packed, nbits) == codes).all()


def test_bucketize_is_strict():
    cut = np.array([-1.0, 0.0, 1.0])
    assert codec.bucketize(np.array([-2, -1, -0.5, 0, 0.5, 1, 2]), cut).tolist() == [0, 0, 1, 1, 2, 2, 3]


def test_layout_is_checked():
    for dim, nbits in ((64, 3), (63, 4), (0, 2)):
        with pytest.raises(ValueError):
            codec.check_layout(dim, nbits)


def test_byte_lookup_matches_unpack():
    w = np.linspace(-1, 1, 16)
    packed = np.arange(256, dtype=np.uint8)[:, None]
    assert np.allclose(codec.byte_lookup(w, 4)[packed[:, 0]], w[codec.unpack(packed, 4)])
