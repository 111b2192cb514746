import pytest
from hypothesis import given
from hypothesis import strategies as st

from kindred.functions.hashing import Bands, drawn_coefficients, next_prime, steady_coefficients

GOLDEN = {
    (21, 0.3): (10, 523, 2, 5), (21, 0.6): (10, 523, 3, 3), (21, 0.75): (10, 523, 4, 2), (82, 0.4): (41, 587, 3, 13), (82, 0.7): (41, 587, 6, 6),
    (200, 0.5): (100, 701, 5, 20), (200, 0.75): (100, 701, 9, 11), (1000, 0.65): (500, 1511, 9, 55), (1000, 0.75): (500, 1511, 13, 38),
}


@pytest.mark.parametrize("key", GOLDEN)
def test_golden_shapes(key):
    x = Bands.of(*key)
    assert (x.s, x.p, x.r, x.b) == GOLDEN[key]


def test_small_vocabularies():
    assert Bands.of(0, 0.5).sizes() == [] and Bands.of(1, 0.5).sizes() == []
    assert Bands.of(2, 0.5).sizes() == [1]
    assert Bands.of(5, 0.5).s == 2  # half to even


@given(st.integers(2, 3000), st.sampled_from([0.3, 0.5, 0.75]))
def test_all_rows_are_used(V, t):
    x = Bands.of(V, t)
    assert sum(x.sizes()) == x.s and (not x.sizes() or max(x.sizes()) - min(x.sizes()) <= 1)


def test_primes_and_coefficients():
    assert next_prime(573) == 577 and next_prime(1) == 2
    assert steady_coefficients(1) == [(104730, 32452844)]
    assert drawn_coefficients(5, 1) == drawn_coefficients(5, 1) != drawn_coefficients(5, 2)
