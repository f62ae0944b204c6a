"""Packing against a scan over all open sequences."""

import random

import pytest

from tessella.llm import packing


def scan(lengths, capacity):
    """Cheapest open sequence with room for each piece, by looking at all of them."""
    placed, pieces, sequences = [], [], 0
    for document, n in enumerate(lengths):
        for k in range(n // capacity):
            placed.append((document, k * capacity, capacity, sequences, 0))
            sequences += 1
        if n % capacity:
            pieces.append((n % capacity, document, n // capacity * capacity))
    rest = sum(p[0] for p in pieces)
    sizes = [capacity] * (rest // capacity) + [1 << b for b in range(capacity.bit_length(), -1, -1) if rest % capacity >> b & 1]
    used, cost = [0] * len(sizes), [0.0] * len(sizes)
    for length, document, start in sorted(pieces, key=lambda p: (-p[0], p[1])):
        while length:
            open_ = [k for k in range(len(sizes)) if used[k] < sizes[k]]
            k = min([k for k in open_ if sizes[k] - used[k] >= length] or open_, key=lambda k: (cost[k], k))
            taken = min(length, sizes[k] - used[k])
            placed.append((document, start, taken, sequences + k, used[k]))
            used[k] += taken
            cost[k] += packing.attention_cost(taken, 1.0, 1 / 512)
            length, start = length - taken, start + taken
    return placed


@pytest.mark.parametrize("capacity", [1024, 100, 1])
def test_pieces_go_to_the_cheapest_sequence_with_room(capacity):
    rng = random.Random(8)
    for n in (0, 1, 40, 1500):
        lengths = [min(int(rng.lognormvariate(5, 1)), 5000) + 1 for _ in range(n)] if capacity > 1 else [rng.randint(1, 3) for _ in range(n // 10)]
        assert packing.pack_round(lengths, capacity) == scan(lengths, capacity)
