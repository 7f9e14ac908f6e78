"""Bit predictors over hashed contexts, mixed in the logistic domain.

A symbol is coded by the bits of its Huffman path. For every bit, each context has a predictor: the
counts of ones and zeros in a hashed slot of (context, node of the code tree), given as the
logarithm of the odds. A set of weights, chosen by the depth of the node (the gate), adds them up,
and the mixed log odds go through a map of what such odds were worth (the adaptive probability
map). Weights and map are fitted on all counted bits, each bit's own count taken out: tasks add the bits
up in cells of like log odds (``Cells``), of which there are at most 16**4 a gate for four contexts, and
the fit takes a context's log odds at the mean of their level. The weights are then refined within each sequence, in steps of a
fixed number of bits, from the bits before.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np

GATES, STEP, RATE = 16, 512, 1.0
SCALE, LIMIT = 16.0, 7.9
LEVELS = 16  # of log odds in each context of a cell
MAP = 129  # points of the probability map, from -8 to 8 log odds
_A, _B, _C = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)


class Code:
    """Huffman paths of symbols 0 to n-1: ``node`` and ``bit`` flat, by ``start`` and ``length``."""

    def __init__(self, counts: Sequence[int]):
        heap = [(max(1, int(c)), i, (i, None, None)) for i, c in enumerate(counts)]
        heapq.heapify(heap)
        fresh = len(heap)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            heapq.heappush(heap, (a[0] + b[0], fresh, (None, a[2], b[2])))
            fresh += 1
        paths: list[list[tuple[int, int]]] = [[] for _ in counts]
        todo, nodes = [(heap[0][2], [])], 0
        while todo:
            (symbol, zero, one), path = todo.pop()
            if symbol is not None:
                paths[symbol] = path
                continue
            todo += [(zero, [*path, (nodes, 0)]), (one, [*path, (nodes, 1)])]
            nodes += 1
        self.length = np.array([len(p) for p in paths], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.node = np.array([n for p in paths for n, _ in p], np.uint32)
        self.bit = np.array([b for p in paths for _, b in p], np.int8)
        self.gate = np.array([min(i, GATES - 1) for p in paths for i in range(len(p))], np.int64)
        self.hashed = self.node * _C
        self.sign = 1 - 2 * self.bit.astype(np.float32)

    def expand(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(position of the symbol, node, bit, gate) of every bit of a sequence of symbols."""
        at, flat = self.places(symbols)
        return at, self.node[flat], self.bit[flat], self.gate[flat]

    def places(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position of the symbol, place in the flat paths) of every bit."""
        n = self.length[symbols]
        at = np.repeat(np.arange(len(symbols), dtype=np.int32), n)
        flat = np.repeat(self.start[symbols] - (np.cumsum(n) - n), n)
        flat += np.arange(len(at))
        return at, flat


def slots(context: np.ndarray, at: np.ndarray, node: np.ndarray, bits: int) -> np.ndarray:
    """Slot of (context, node) among ``2**bits``. ``context``: uint32 by symbol."""
    return _slots((context * _A)[at], node * _C, bits)


def _slots(x: np.ndarray, hashed: np.ndarray, bits: int) -> np.ndarray:
    x += hashed
    x ^= x >> np.uint32(15)
    x *= _B
    x >>= np.uint32(32 - bits)
    return x.astype(np.intp)


def slots_by_context(code: Code, contexts: Sequence[np.ndarray], at: np.ndarray, flat: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """``slots`` of the bits at ``places``, for one context after another; a context that is the same for all
    symbols is hashed once a place of the paths."""
    hashed = code.hashed[flat]
    for c in contexts:
        if len(c) and (c == c[0]).all():
            yield _slots(np.repeat(c[:1] * _A, len(code.node)), code.hashed, bits)[flat]
        else:
            yield _slots((c * _A)[at], hashed, bits)


def odds(ones: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    return np.clip(np.log((ones + 0.4) / (zeros + 0.4)), -LIMIT, LIMIT).astype(np.float32)


class Mixer:
    """A code, tables of log odds (int8, one for each context), weights and probability map."""

    def __init__(self, code: Code, counts: np.ndarray, bits: int):
        """``counts``: contexts x slots x (zeros, ones)."""
        self.code, self.bits, k = code, bits, len(counts)
        self.tables = np.rint(odds(counts[..., 1].astype(np.float64), counts[..., 0].astype(np.float64)) * SCALE).astype(np.int8)
        self.weights = np.full((GATES, k), 1.0 / k, np.float32)
        self.map = np.tile(np.linspace(-8, 8, MAP, dtype=np.float32), (GATES, 1))

    def inputs(self, contexts: Sequence[np.ndarray], at: np.ndarray, flat: np.ndarray) -> np.ndarray:
        """Log odds, contexts x bits, times ``SCALE``."""
        x = np.empty((len(self.tables), len(at)), np.float32)
        for own, table, slot in zip(x, self.tables, slots_by_context(self.code, contexts, at, flat, self.bits), strict=True):
            own[:] = table[slot]
        return x

    def mapped(self, z: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """The mean of the mixed log odds and of what the map makes of them."""
        near = np.rint(np.clip(z, -8, 8) * np.float32((MAP - 1) / 16)).astype(np.intp)
        near += gate * MAP + (MAP - 1) // 2
        return (z + self.map.ravel()[near]) * np.float32(0.5)

    def fit(self, cells: np.ndarray, n: np.ndarray, means: np.ndarray, rounds: int = 60) -> None:
        """Weights by gradient steps, then the map, from added up ``Cells`` (``n`` bits each) and ``levels``' means."""
        cell, at = np.unique(cells >> 1, return_inverse=True)
        n, ones = np.bincount(at, n), np.bincount(at, n * (cells & 1))
        gate, x = cell // LEVELS ** len(means), np.stack([m[cell // LEVELS ** (len(means) - 1 - k) % LEVELS] for k, m in enumerate(means)])
        here = np.maximum(np.bincount(gate, n, GATES), 1)
        for _ in range(rounds):
            error = ones - n / (1 + np.exp(-(x * self.weights[gate].T).sum(0)))
            for k in range(len(x)):
                power = np.bincount(gate, n * x[k] * x[k], GATES) / here + 0.1
                self.weights[:, k] += (np.bincount(gate, error * x[k], GATES) / here / power).astype(np.float32)
        z = (x * self.weights[gate].T).sum(0)
        near = np.clip(np.rint((z + 8) * (MAP - 1) / 16), 0, MAP - 1).astype(np.int64)
        hits, all_ = (np.bincount(gate * MAP + near, w, GATES * MAP).reshape(GATES, MAP) for w in (ones, n))
        centre = 1 / (1 + np.exp(-np.linspace(-8, 8, MAP)))
        p = (hits + 20 * centre) / (all_ + 20)
        self.map = np.log(p / (1 - p)).astype(np.float32)

    def log2(self, symbols: np.ndarray, contexts: Sequence[np.ndarray], ends: np.ndarray, refine: bool = True) -> np.ndarray:
        """log2 of the probability of each sequence; ``ends``: where each ends among ``symbols``. With
        ``refine``, each sequence starts from the fitted weights and moves its own copy."""
        at, flat = self.code.places(symbols)
        bit_ends = np.concatenate([[0], np.cumsum(self.code.length[symbols])])[ends]
        begins = np.concatenate([[0], bit_ends[:-1]])
        out, weights = np.zeros(len(ends)), np.ascontiguousarray(self.weights.T) / np.float32(SCALE)
        if not refine:
            x, gate = self.inputs(contexts, at, flat), self.code.gate[flat]
            loss = softplus(self.code.sign[flat] * self.mapped(mixed(x, weights, gate), gate))
            return -np.bincount(np.repeat(np.arange(len(ends)), bit_ends - begins), loss, len(ends)) / np.log(2)
        steps = []  # (sequences with such a step, bits of each)
        for step in range(int(-(-(bit_ends - begins).max(initial=0) // STEP))):
            lanes = np.flatnonzero(begins + step * STEP < bit_ends)
            steps.append((lanes, np.minimum(bit_ends[lanes] - begins[lanes] - step * STEP, STEP)))
        if not steps:
            return out
        # all bits by step, then by sequence, so that a step's bits are a slice
        n = np.concatenate([n for _, n in steps])
        first = np.concatenate([begins[lanes] + i * STEP for i, (lanes, _) in enumerate(steps)])
        order = np.repeat(first - (np.cumsum(n) - n), n)
        order += np.arange(len(order))
        at, flat = at[order], flat[order]
        xs, gates, flips = self.inputs(contexts, at, flat), self.code.gate[flat], self.code.sign[flat]
        own, end = np.tile(weights, len(ends)), 0  # context x (sequence, gate)
        for i, (lanes, n) in enumerate(steps):
            begin, end = end, end + int(n.sum())
            x, g, flip = xs[:, begin:end], gates[begin:end], flips[begin:end]
            key = np.repeat(lanes * GATES, n)
            key += g
            z = np.clip(mixed(x, own, key), -30, 30)
            out[lanes] -= np.add.reduceat(softplus(flip * self.mapped(z, g)), np.cumsum(n) - n, dtype=np.float64)
            if i + 1 < len(steps):  # some have another step
                error = -flip / (1 + np.exp(-flip * z))  # bit less its probability
                rate = RATE / SCALE**2 / (np.bincount(key, minlength=own.shape[1]) + 32.0)
                for w, values in zip(own, x, strict=True):
                    w += rate * np.bincount(key, values * error, len(w))
        return out / np.log(2)


def mixed(x: np.ndarray, weights: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The sum of the contexts' log odds (contexts x bits) by the weights of each bit's key (contexts x keys)."""
    z = x[0] * weights[0][key]
    for values, w in zip(x[1:], weights[1:], strict=True):
        z += values * w[key]
    return z


def softplus(z: np.ndarray) -> np.ndarray:
    return np.log(1 + np.exp(z))


def levels(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ``counts`` (contexts x slots x (zeros, ones)): the level of the log odds that a bit finds in a slot without its
    own count (contexts x (2 * slot + bit)), and the mean log odds of each context's levels over all counted bits."""
    out, means = np.zeros((len(counts), counts.shape[1], 2), np.uint8), np.zeros((len(counts), LEVELS))
    for k, own in enumerate(counts):
        total = np.zeros((2, LEVELS))
        for bit in (0, 1):
            x = odds(np.maximum(own[:, 1] - bit, 0), np.maximum(own[:, 0] - (1 - bit), 0)).astype(np.float64)
            out[k, :, bit] = np.minimum((x + LIMIT) * (LEVELS / (2 * LIMIT)), LEVELS - 1)
            total += [np.bincount(out[k, :, bit], w, LEVELS) for w in (own[:, bit], own[:, bit] * x)]
        means[k] = total[1] / np.maximum(total[0], 1)
    return out.reshape(len(counts), -1), means


class Cells:
    """How many bits of the counted text are in each cell: the gate, the ``levels`` of its contexts and the bit."""

    def __init__(self, code: Code, table: np.ndarray, bits: int):
        self.code, self.table, self.bits = code, table, bits
        self.n = np.zeros(GATES * LEVELS ** len(table) * 2, np.int64)

    def add(self, symbols: np.ndarray, contexts: Sequence[np.ndarray], times: np.ndarray | None = None) -> None:
        """``times``: how often each symbol stands in its contexts, once if not given."""
        at, flat = self.code.places(symbols)
        bit, cell = self.code.bit[flat], self.code.gate.astype(np.int32)[flat]
        for own, slot in zip(self.table, slots_by_context(self.code, contexts, at, flat, self.bits), strict=True):
            slot *= 2
            slot += bit
            cell *= LEVELS
            cell += own[slot]
        self.n += weighed(cell * 2 + bit, at, times, len(self.n))


def weighed(where: np.ndarray, at: np.ndarray, times: np.ndarray | None, size: int) -> np.ndarray:
    """How many bits are at each place; exact, as sums below 2**53 are in doubles."""
    return np.bincount(where, None if times is None else times[at], size).astype(np.int64)
