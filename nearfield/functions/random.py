"""SplitMix64, the generator behind every random choice of the indexes."""

from __future__ import annotations

import math

_MASK = (1 << 64) - 1


class SplitMix64:
    # The increment and the two multipliers of the generator.
    GAMMA, MIX1, MIX2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB

    def __init__(self, seed: int):
        self.state = seed & _MASK

    def next_u64(self) -> int:
        self.state = z = (self.state + self.GAMMA) & _MASK
        z = ((z ^ (z >> 30)) * self.MIX1) & _MASK
        z = ((z ^ (z >> 27)) * self.MIX2) & _MASK
        return z ^ (z >> 31)

    def next_f64(self) -> float:
        return (self.next_u64() >> 11) * 2.0**-53

    def next_below(self, n: int) -> int:
        return self.next_u64() % n

    def distinct_below(self, n: int, count: int) -> list[int]:
        """``count`` different numbers under n, in the order drawn."""
        if count > n:
            raise ValueError(f"{count} different numbers under {n}")
        seen: dict[int, None] = {}
        while len(seen) < count:
            seen.setdefault(self.next_below(n))
        return list(seen)

    def level(self, m: int) -> int:
        """Layer of a graph node: geometric with ratio 1/m."""
        return int(math.floor(-math.log(max(self.next_f64(), 2.0**-53)) / math.log(m)))
