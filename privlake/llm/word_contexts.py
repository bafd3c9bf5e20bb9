"""Bit predictors for running words, in hashed contexts of the 0, 1, 2 and 3 words before; used by ``lm_scoring``.

A word that training texts have twice or more has a code of bits, short for frequent words; all others share one
code, that of ``other``.  Each bit is a decision.  For every order a table, hashed by the words before and the bits so
far, counts ones and zeros over all training texts; a decision's inputs are the states of its counts in the four
tables.  A mixer, learnt online from a histogram of decisions of all training texts, weighs the predictors by a
gate, and each cell's own counts refine it.  The result is a cost for each cell, so that scoring looks up states.

Tables have two to four slots a training token, at most 2 ** 22 for an order (memory of a worker); beyond that contexts share slots, and the
mixer learns how far to trust them.  In a training text, a decision is read without itself.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame

ORDERS, MOST, CHUNK, BLOCK = 3, 22, 1 << 16, 1 << 16
STATES = (32, 29, 29, 11)
CELLS = 32 * 29 * 29 * 11
#: Steps of the log odds without a context, either side of 0.
_STEPS = (0.12, 0.25, 0.4, 0.55, 0.7, 0.9, 1.1, 1.4, 1.8, 2.3, 2.9, 3.6, 4.5, 5.5, 7.0)
START, _C1, _C2 = 0x51ED270B, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def table_bits(tokens: int) -> list[int]:
    """log2 of the slots of each order's table."""
    k = min(MOST, max(12, int(tokens).bit_length() + 1))
    return [min(k, 19), k, k, k]


class Code:
    """Prefix code of the words with ``counts`` of 2 and more; ``symbol`` maps a head number (any other: ``other``) to it."""

    def __init__(self, counts, tokens: int):
        import numpy as np

        c = np.asarray(counts, dtype=np.int64)
        own = np.flatnonzero(c >= 2)
        f = np.append(c[own], max(tokens - int(c[own].sum()), 1)).astype(float)
        length = np.ceil(np.log2(f.sum() / f)).astype(np.int64)
        order = np.argsort(length, kind="stable")
        share = 0.5 ** length[order]  # dyadic, so sums are exact
        before = np.cumsum(share) - share
        self.length, self.code = length, np.zeros(len(f), dtype=np.int64)
        self.code[order] = (before / share).astype(np.int64)
        self.other = len(own)
        self.symbol = np.full(len(c) + 1, self.other, dtype=np.int32)
        self.symbol[own] = np.arange(len(own))

    def of(self, codes):
        import numpy as np

        last = len(self.symbol) - 1
        return self.symbol[np.where((codes >= 0) & (codes < last), codes, last)]


def _mixed(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


def hashes(before) -> list:
    """Hash of the context of each order; ``before[k]`` holds the word codes k + 1 back, -1 where the text starts."""
    import numpy as np

    h, out = np.full(len(before[0]), START, dtype=np.uint64), []
    out.append(h)
    for b in before:
        h = _mixed((h ^ (b.astype(np.uint64) + np.uint64(1))) * np.uint64(_C1))
        out.append(h)
    return out


def before_in(codes, lengths) -> list:
    """Codes 1, 2 and 3 words back in documents of ``lengths`` words."""
    import numpy as np

    place = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out = []
    for k in range(1, ORDERS + 1):
        b = np.full(len(codes), -1, dtype=np.int64)
        b[k:] = codes[:-k]
        b[place < k] = -1
        out.append(b)
    return out


def _slots(h, node, bits):
    import numpy as np

    return _places(h, node * np.uint64(_C1), bits)


def _places(h, spread, bits):
    """Slots at nodes given as ``node * _C1``, which all orders share."""
    import numpy as np

    x = h ^ spread
    x *= np.uint64(_C2)
    x >>= np.uint64(64 - bits)
    return x.view(np.int64)


def _levels(code: Code, symbol, hs, bits) -> Iterator[tuple]:
    """(places, bit, slots by order) of every level of the code; places are ordered by falling length of code."""
    import numpy as np

    length = code.length[symbol].astype(np.int8)
    order = np.argsort(-length, kind="stable")
    length, word = length[order].astype(np.int64), code.code[symbol[order]]
    hs = [h[order] for h in hs]
    for i in range(int(length.max(initial=0))):
        m = int(np.searchsorted(-length, -i, side="left"))
        rest = length[:m] - i
        spread = ((word[:m] >> rest) | (1 << i)).view(np.uint64) * np.uint64(_C1)
        bit = (word[:m] >> (rest - 1)) & 1
        yield order[:m], bit, [_places(h[:m], spread, b) for h, b in zip(hs, bits, strict=True)]


def count(tables, code: Code, symbol, hs, bits) -> None:
    """Add all decisions to ``tables``: zeros in the high half of a slot, ones in the low."""
    import numpy as np

    for a in range(0, len(symbol), BLOCK):
        for _, bit, slots in _levels(code, symbol[a : a + BLOCK], [h[a : a + BLOCK] for h in hs], bits):
            value = np.where(bit == 1, np.uint64(1), np.uint64(1 << 32))
            for t, s in zip(tables, slots, strict=True):
                np.add.at(t, s, value)


def count_alone(table, code: Code, counts, bits: int) -> None:
    """Add to ``table`` of order 0, which has no context, the decisions of symbols that were met ``counts`` times."""
    import numpy as np

    symbol = np.flatnonzero(counts)
    h = np.full(len(symbol), START, dtype=np.uint64)
    for at, bit, (slots,) in _levels(code, symbol, [h], [bits]):
        n = counts[symbol[at]].astype(np.uint64)
        np.add.at(table, slots, np.where(bit == 1, n, n << np.uint64(32)))


def states(order: int, ones, zeros):
    """The state of counts, below ``STATES[order]``: unseen, one side only by its count, or both by their ratio."""
    import numpy as np

    st = np.log((ones + np.float32(0.4)) / (zeros + np.float32(0.4)))
    if order == 0:
        return np.searchsorted([*(-x for x in reversed(_STEPS)), 0.0, *_STEPS], st).astype(np.uint8)
    steps, ratios = ((1, 2, 4, 9, 29), 16) if order < 3 else ((1, 3), 4)
    one = np.searchsorted(steps, np.maximum(ones, zeros)).astype(np.uint8)
    sides = len(steps) + 1
    both = np.clip((st + 4) * (ratios / 8), 0, ratios - 1).astype(np.uint8)
    out = np.where(zeros == 0, 1 + one, np.where(ones == 0, 1 + sides + one, 1 + 2 * sides + both))
    return np.where(ones + zeros == 0, 0, out).astype(np.uint8)


def state_pair(order: int, ones, zeros) -> tuple:
    """The states of all slots: as they are, and (at 2 * slot + bit) without one decision of that bit."""
    import numpy as np

    less = np.empty((len(ones), 2), dtype=np.uint8)
    less[:, 0], less[:, 1] = states(order, ones, np.maximum(zeros - 1, 0)), states(order, np.maximum(ones - 1, 0), zeros)
    return states(order, ones, zeros), less.ravel()


def state_tables(tables) -> list[tuple]:
    """``state_pair`` of each order's ones and zeros."""
    return [state_pair(order, ones, zeros) for order, (ones, zeros) in enumerate(tables)]


def unpacked(table):
    """Ones and zeros of a table that ``count`` filled."""
    import numpy as np

    return table & np.uint64(0xFFFFFFFF), table >> np.uint64(32)


def _cells(found: list[tuple], slots, bit, left_out: bool):
    import numpy as np

    cell = np.zeros(len(bit), dtype=np.int32)
    for k, ((whole, less), s) in enumerate(zip(found, slots, strict=True)):
        cell *= np.int32(STATES[k])
        cell += less[2 * s + bit] if left_out else whole[s]
    return cell


def observe(histogram, found, code: Code, symbol, hs, bits) -> None:
    """Add 2 * cell + bit of all decisions, of texts that the tables don't hold."""
    import numpy as np

    for a in range(0, len(symbol), BLOCK):
        at = [2 * _cells(found, slots, bit, False) + bit for _, bit, slots in _levels(code, symbol[a : a + BLOCK], [h[a : a + BLOCK] for h in hs], bits)]
        if at:
            histogram += np.bincount(np.concatenate(at), minlength=len(histogram))


def costs_of(histogram):
    """log10 of the probability of each decision (2 * cell + bit): predictors by parts of the cell, mixed and refined."""
    import numpy as np

    from privlake.llm.lm_scoring import Mixer, _squash

    n = np.asarray(histogram, dtype=float).reshape(CELLS, 2)
    axes = np.array(np.unravel_index(np.arange(CELLS), STATES))
    x = []
    for part in ((0,), (1,), (2,), (3,), (0, 1), (1, 2), (2, 3)):
        key = np.ravel_multi_index(axes[list(part)], [STATES[k] for k in part])
        one, all_ = np.bincount(key, n[:, 1]), np.bincount(key, n.sum(1))
        x.append(np.log((one + 0.4) / (all_ - one + 0.4))[key])
    x = np.clip(np.array([*x, np.full(CELLS, 0.3)]), -12, 12)
    sure = lambda s: np.where(s == 0, 0, np.where(s <= 12, 1 + (s - 1) % 6 // 2, 4))
    gate = sure(axes[1]) * 5 + sure(axes[2])
    seen = np.flatnonzero(n.sum(1) > 0)
    m = Mixer(len(x), 25)
    both, twice, bit = np.concatenate([x[:, seen]] * 2, axis=1), np.tile(gate[seen], 2), np.repeat([0, 1], len(seen))
    weight = np.concatenate([n[seen, 0], n[seen, 1]])
    for _ in range(100):
        m.learn(both, twice, bit, weight, block=max(len(bit), 1))
    z = _squash(m.mix(x, gate))
    p = np.clip((n[:, 1] + 8 * z) / (n.sum(1) + 8), 1e-6, 1 - 1e-6)
    return np.log10(np.column_stack([1 - p, p])).ravel()


def costs(found, table, code: Code, symbol, hs, bits, left_out: bool):
    """log10 of the probability of each place's symbol; ``left_out``: without the place itself."""
    import numpy as np

    out = np.zeros(len(symbol))
    for a in range(0, len(symbol), BLOCK):
        own = out[a : a + BLOCK]
        for at, bit, slots in _levels(code, symbol[a : a + BLOCK], [h[a : a + BLOCK] for h in hs], bits):
            own[at] += table[2 * _cells(found, slots, bit, left_out) + bit]
    return out


# --- over documents ---


_SUMS = "kind int, chunk int, n int, width int, data binary"


def packed(both) -> tuple[int, bytes]:
    """Bytes of a count, and both rows of counts compressed by byte, low ones first: most counts are small."""
    import numpy as np
    import pyarrow as pa

    most = int(both.max(initial=0))
    width = next(w for w in (1, 2, 4, 8) if most < 1 << 8 * w)
    data = both.astype(f"<u{width}").reshape(-1, 1).view(np.uint8)
    return width, pa.compress(np.ascontiguousarray(data.T).tobytes(), codec="zstd", asbytes=True)


def counts_of(data: bytes, n: int, width: int):
    """The two rows of ``n`` counts that ``packed`` made ``data`` of."""
    import numpy as np
    import pyarrow as pa

    planes = np.frombuffer(pa.decompress(data, 2 * n * width, codec="zstd"), dtype=np.uint8).reshape(width, 2 * n)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").reshape(2, n).astype(np.uint64)


def summed(docs: DataFrame, coded, bits, code, found=None, before: DataFrame | None = None) -> DataFrame:
    """(kind, chunk, n, width, data, whole, less): the tables' states over ``docs`` (text), and over those whose sums are
    ``before``, by order and chunk of slots; ``data`` has the sums, left out where there is ``before``.  Where ``found`` has the
    states of other documents' tables, the histogram of these documents' decisions is kind -1.

    ``coded`` turns a batch's texts into word codes and the number of words of each; ``code`` and ``found`` are
    broadcast.  A task sends its tables once, compressed; sums are added up as they arrive, and made states there.
    """
    last = before is not None

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        tables, histogram, alone = [np.zeros(1 << b, dtype=np.uint64) for b in bits], np.zeros(2 * CELLS, dtype=np.int64), np.zeros(code.value.other + 1, dtype=np.int64)
        for batch in batches:
            for codes, lengths in coded(batch.column(0)):
                symbol, hs = code.value.of(codes), hashes(before_in(codes, lengths))
                if found is not None:
                    observe(histogram, received(found)[0], code.value, symbol, hs, bits)
                alone += np.bincount(symbol, minlength=len(alone))
                count(tables[1:], code.value, symbol, hs[1:], bits[1:])
        if not alone.any():
            return
        count_alone(tables[0], code.value, alone, bits[0])
        kinds = [*enumerate(tables), *([] if found is None else [(-1, histogram.astype(np.uint64))])]
        for kind, values in kinds:
            for chunk, a in enumerate(range(0, len(values), CHUNK)):
                part = values[a : a + CHUNK]
                if part.any():
                    width, data = packed(np.stack(unpacked(part)))
                    yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.int32()) for x in (kind, chunk, len(part), width)), pa.array([data], pa.binary())], ["kind", "chunk", "n", "width", "data"])

    def total(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        sums: dict = {}
        for batch in batches:
            for row in batch.to_pylist():
                key, part = (row["kind"], row["chunk"]), counts_of(row["data"], row["n"], row["width"])
                sums[key] = sums[key] + part if key in sums else part
        for (kind, chunk), both in sums.items():
            whole, less = (None, None) if kind < 0 else (x.tobytes() for x in state_pair(kind, *both.astype(np.float32)))
            width, data = (0, None) if last and kind >= 0 else packed(both)
            columns = [*(pa.array([x], pa.int32()) for x in (kind, chunk, both.shape[1], width)), *(pa.array([x], pa.binary()) for x in (data, whole, less))]
            yield pa.RecordBatch.from_arrays(columns, ["kind", "chunk", "n", "width", "data", "whole", "less"])

    partial = docs.mapInArrow(run, _SUMS)
    if last:
        partial = partial.unionByName(before.select("kind", "chunk", "n", "width", "data"))
    return partial.repartition(24, "kind", "chunk").mapInArrow(total, f"{_SUMS}, whole binary, less binary")


def gathered(sums: DataFrame, bits) -> list[tuple]:
    """``state_tables`` of the sums, made states where they were summed: of fixed size, three bytes a slot."""
    import numpy as np

    nothing = [state_pair(order, *np.zeros((2, 1), dtype=np.float32)) for order in range(len(bits))]
    out = [(np.repeat(whole, 1 << b), np.tile(less, 1 << b)) for b, (whole, less) in zip(bits, nothing, strict=True)]
    for r in sums.where("kind >= 0").select("kind", "chunk", "whole", "less").toLocalIterator():
        a = r.chunk * CHUNK
        for k, (to, x) in enumerate(zip(out[r.kind], (r.whole, r.less), strict=True), 1):
            to[k * a : k * a + len(x)] = np.frombuffer(x, dtype=np.uint8)
    return out


def sent(found) -> list[tuple]:
    """States of all orders, compressed: a broadcast lies on the disk of the driver and of each executor."""
    import pyarrow as pa

    return [tuple((len(x), pa.compress(x.tobytes(), codec="zstd", asbytes=True)) for x in pair) for pair in found]


def received(broadcast) -> tuple:
    """The broadcast's value, its first part, which ``sent`` made, as states again: once in a worker."""
    import numpy as np
    import pyarrow as pa

    first, *rest = broadcast.value
    if not hasattr(broadcast, "_states"):
        broadcast._states = [tuple(np.frombuffer(pa.decompress(x, n, codec="zstd"), dtype=np.uint8) for n, x in pair) for pair in first]
    return broadcast._states, *rest


def learnt_costs(sums: DataFrame):
    """``costs_of`` the histogram among ``sums``, which is of fixed size; learnt in a task, as the driver has little memory."""

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        histogram = np.zeros(2 * CELLS)
        for batch in batches:
            for row in batch.to_pylist():
                ones, zeros = counts_of(row["data"], row["n"], row["width"]).astype(float)
                a = row["chunk"] * CHUNK
                histogram[a : a + row["n"]] = ones + zeros * 2.0**32
        yield pa.RecordBatch.from_arrays([pa.array([costs_of(histogram).tobytes()], pa.binary())], ["costs"])

    import numpy as np

    return np.frombuffer(sums.where("kind < 0").select("chunk", "n", "width", "data").coalesce(1).mapInArrow(run, "costs binary").first()[0])
