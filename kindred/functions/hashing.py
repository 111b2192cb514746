"""Numbers that shape MinHash signatures and their bands; all small and known on the driver."""

from __future__ import annotations

import random
from dataclasses import dataclass


def next_prime(n: int) -> int:
    """The smallest prime above n."""
    n += 1
    while n < 2 or any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


@dataclass(frozen=True)
class Bands:
    """Shape of a signature for V words: s rows in b bands of about r rows, hashed modulo p."""

    V: int
    s: int
    p: int
    r: int
    b: int

    @staticmethod
    def of(V: int, t: float) -> Bands:
        """For similarity threshold t: r is the first for which (r/s)**(1/r) is nearest to t.

        Half of V is rounded to even. One row is one band; without words there is none.
        """
        s = round(0.5 * V)
        r = min(range(1, s), key=lambda r: abs((r / s) ** (1 / r) - t), default=min(s, 1))
        return Bands(V, s, next_prime(V + 500), r, s // r if r else 0)

    def sizes(self) -> list[int]:
        """Rows of each band: all s are used, the first bands hold one more."""
        if not self.b:
            return []
        least, more = divmod(self.s, self.b)
        return [least + 1] * more + [least] * (self.b - more)


def steady_coefficients(s: int) -> list[tuple[int, int]]:
    """(a, b) of each hash, by rule: the same in every engine."""
    return [((j * 7919) % 99999999 + 104730, (j * 15485863 + 32452843) % 99999999 + 1) for j in range(s)]


def drawn_coefficients(s: int, seed: int) -> list[tuple[int, int]]:
    """(a, b) of each hash, drawn from 1 to 99,999,999; of each pair b first."""
    rng = random.Random(seed)
    return [(a, b) for b, a in ((rng.randrange(1, 100_000_000), rng.randrange(1, 100_000_000)) for _ in range(s))]
