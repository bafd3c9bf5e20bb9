"""N-gram Jaccard join: size-aware, heavy and light.

Documents are sets of hashed 5-word shingles; equal sets are one vertex (its id
hashes the set).  Candidates come from an exact filter: in one global order, two
sets with enough overlap share some of their first elements.

- *Small sets* enumerate the pairs (2-subsets) of a slightly longer prefix; a
  shared subset is a candidate.  *Large sets* put their prefix into inverted
  lists, which are scanned: the number of lists two sets share must reach what
  the filter promises for their sizes.  The boundary is the size up to which the
  subsets cost less than the scan, from the corpus's own list lengths.
- The order puts *heavy* shingles last, the most frequent at the very end (a
  bounded dictionary of those frequent within an input partition), so shared
  passages enter a prefix only where they make up most of a set.
- A heavy shingle's list, or any list beyond ``LIST_PAIRS`` sets, isn't turned
  into pairs: its members are tied to one pivot.  Within a pivot's group, what
  links to the pivot is one component already; only the others are compared with
  the members, through a prefix filter in the group's own order of frequency, and
  nothing but links leaves the worker.
- Candidates' components are resolved in blocks of about ``BLOCK_ELEMENTS``:
  each edge belongs to the block of its second set, so a component of any size
  is dealt to as many tasks as it needs.  Members of a split group that don't link
  to their pivot are compared with the group's other blocks in a second step.

Texts are shingled once; the sets are kept in the shared folder.  Every link is
verified on the whole sets.  Shingles and sets are told apart by 64-bit hashes
(k sets have k * k / 2^65 expected pairs with one hash).  The driver holds the
heavy dictionary and a bitmap of candidate sets, both bounded; a full bitmap only
ships more sets than needed.

Edge cases: null or empty text is an empty set, linked with nothing; fewer than
five words are one shingle; repeated rows and copies share a vertex; a null
doc_id keeps its row, and its component is the least id there is in it.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

from privlake.llm.common import batches_of, drop_kept, shared_dir, stored, table
from privlake.llm.components import components

N = 5
SIMILARITY = (75, 100)
#: A shingle is reported by a partition that has it in so many sets, and heavy if the reports add up to HEAVY_TOTAL.
HEAVY_LOCAL, HEAVY_TOTAL, HEAVY_ENTRIES = 2, 8, 200_000
#: A list of k sets makes k (k - 1) / 2 pairs or k - 1 ties.
LIST_PAIRS = 48
#: A pair is told once by each part that has a list of both: few large parts repeat it less.
PART_POSTINGS = 1_500_000
#: Bits of the bitmap of candidate sets, by their number and at most.
BITS_A_SET, MOST_BITS = 32, 1 << 28
#: Elements of a block of a component, and of a block that members beside their pivot are compared with.
BLOCK_ELEMENTS, GROUP_ELEMENTS = 2_000_000, 4_000_000
DOCS_A_BLOB = 2000
#: Pairs of lists that are written out at a time, before those whose sizes don't fit go.
PAIRS_AT_ONCE = 1_000_000
BATCH_ROWS = 2000

# --- sets ---

_STATE: dict = {}


def _powers(n: int):
    """Powers of an odd number modulo 2^64 and of its inverse, at least n of them."""
    import numpy as np

    have = _STATE.get("powers")
    if have is None or len(have[0]) < n:
        size, r = max(1 << 16, 2 * n), 0x9E3779B97F4A7C15
        with np.errstate(over="ignore"):
            both = tuple(np.cumprod(np.append(np.ones(1, dtype=np.uint64), np.full(size - 1, x, dtype=np.uint64)), dtype=np.uint64) for x in (r, pow(r, -1, 1 << 64)))
        _STATE["powers"] = have = both
        rng = np.random.default_rng(20240229)
        _STATE["bytes"] = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        space = np.zeros(256, dtype=bool)
        space[[9, 10, 11, 12, 13, 32]] = True
        _STATE["space"] = space
    return have


def _mixed(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, n: int = N):
    """The sorted distinct 64-bit hashes of the text's shingles."""
    import numpy as np

    data = np.frombuffer((text or "").encode().lower(), dtype=np.uint8)
    if not len(data):
        return np.zeros(0, dtype=np.uint64)
    power, inverse = _powers(len(data) + 1)
    inside = ~_STATE["space"][data]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]])))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_STATE["bytes"][data] * power[: len(data)], dtype=np.uint64)])
    words = _mixed((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    k = min(n, len(words))
    h = words[: len(words) - k + 1]
    for i in range(1, k):
        h = _mixed(h) + words[i : len(words) - k + 1 + i]
    return np.unique(_mixed(h + np.uint64(k)))


def set_id(s) -> int:
    """A 64-bit id of a set, from a digest of its elements."""
    import hashlib

    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def _shingled(docs: DataFrame) -> DataFrame:
    """(doc_id, sid, n, shingles) of all rows; ``shingles`` once a partition for each set, null for its copies there."""

    def run(batches):
        import pyarrow as pa

        drop_kept()
        seen: set[int] = set()
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                sid, size, data = [], [], []
                for text in part.column(1):
                    s = shingles(text.as_py())
                    i = set_id(s) if len(s) else None
                    sid.append(i)
                    size.append(len(s))
                    data.append(s.tobytes() if i is not None and i not in seen else None)
                    if i is not None:
                        seen.add(i)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sid, pa.int64()), pa.array(size, pa.int64()), pa.array(data, pa.binary())], ["doc_id", "sid", "n", "shingles"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.mapInArrow(run, f"doc_id {kind}, sid long, n long, shingles binary")


def _each(batches) -> Iterator[tuple[int, object]]:
    """(sid, set) of the rows of (sid, shingles)."""
    import numpy as np

    drop_kept()
    for batch in batches:
        for sid, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            yield sid, np.frombuffer(data.as_py(), dtype=np.uint64)


def prefix(n: int, k: int, similarity: tuple[int, int]) -> int:
    """Elements of a set of size n of which any linked set shares at least k (in its own prefix)."""
    a, b = similarity
    return min(n, n - -(-a * n // b) + k)


# --- heavy shingles and the boundary ---


def _frequent(sets: DataFrame, similarity) -> DataFrame:
    """Shingles frequent within a partition, among the sets' prefixes by hash: (h, c, pivot); and, with h null, sums of
    prefix elements and of squares of list lengths, for the boundary."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        found, owner, seen, size = [], [], set(), 0

        def flush():
            h, s = np.concatenate(found), np.concatenate(owner)
            order = np.argsort(h, kind="stable")
            h, s = h[order], s[order]
            at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            c = np.diff(np.append(at, len(h)))
            low = np.minimum.reduceat(s, at)
            keep = c >= HEAVY_LOCAL
            light = c[~keep].astype(float)
            columns = [
                pa.array([*h[at][keep].view(np.int64).tolist(), None], pa.int64()), pa.array([*c[keep].tolist(), int(len(h))], pa.int64()),
                pa.array([*low[keep].tolist(), 0], pa.int64()), pa.array([0.0] * int(keep.sum()) + [float((light * light).sum())]),
            ]
            return pa.RecordBatch.from_arrays(columns, ["h", "c", "pivot", "squares"])

        for sid, s in _each(batches):
            if sid in seen:
                continue
            seen.add(sid)
            found.append(s[: prefix(len(s), 1, similarity)])
            owner.append(np.full(len(found[-1]), sid, dtype=np.int64))
            size += len(found[-1])
            if size > 2_000_000:
                yield flush()
                found, owner, size = [], [], 0
        if found:
            yield flush()

    d = sets.mapInArrow(run, "h long, c long, pivot long, squares double")
    return d.groupBy("h").agg(F.sum("c").alias("c"), F.min("pivot").alias("pivot"), F.sum("squares").alias("squares"))


def boundary(postings: int, squares: float, similarity) -> int:
    """The largest size (up to 64) at which a set's 2-subsets cost no more than scanning its prefix's lists.

    A posting costs 1, and each other set found in its list 1; the mean list met by a posting is squares / postings.
    """
    met, best = 1.0 + squares / max(1, postings), 0
    for n in range(1, 65):
        p = prefix(n, 2, similarity)
        if p * (p - 1) / 2 <= prefix(n, 1, similarity) * met:
            best = n
    return best


# --- candidates ---


def _postings(sets: DataFrame, heavy, small: int, parts: int, similarity) -> DataFrame:
    """(part, blob): packed postings of a batch of sets for one part of the key space.

    A blob: u32 sets, postings, ties; set ids i64, sizes i32, heavy elements in the prefix i32; keys u64; sets'
    indices u32; kinds u8 (1: a subset key); ties: pivot i64, set's index u32.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        known, pivots, ranks = heavy.value
        a, b = similarity
        seen: set[int] = set()
        sids, sizes, tied, keys, index, kinds, tie_p, tie_i = ([] for _ in range(8))

        def flush():
            k, i, t = (np.concatenate(x) if x else np.zeros(0, dtype=d) for x, d in ((keys, np.uint64), (index, np.uint32), (kinds, np.uint8)))
            tp, ti = np.array(tie_p, dtype=np.int64), np.array(tie_i, dtype=np.uint32)
            part = (k >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
            tpart = (tp.view(np.uint64) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
            order = np.argsort(part, kind="stable")
            k, i, t, part = k[order], i[order], t[order], part[order]
            torder = np.argsort(tpart, kind="stable")
            tp, ti, tpart = tp[torder], ti[torder], tpart[torder]
            table_ = [np.array(x, dtype=d) for x, d in ((sids, np.int64), (sizes, np.int32), (tied, np.int32))]
            rows: tuple[list, list] = ([], [])
            for p in np.union1d(part, tpart).tolist():
                s = slice(np.searchsorted(part, p), np.searchsorted(part, p, "right"))
                u = slice(np.searchsorted(tpart, p), np.searchsorted(tpart, p, "right"))
                used, at = np.unique(np.concatenate([i[s], ti[u]]), return_inverse=True)
                at = at.astype(np.uint32)
                m = s.stop - s.start
                head = np.array([len(used), m, u.stop - u.start], dtype=np.uint32)
                rows[0].append(int(p))
                rows[1].append(b"".join(x.tobytes() for x in (head, *(c[used] for c in table_), k[s], at[:m], t[s], tp[u], at[m:])))
            for x in (sids, sizes, tied, keys, index, kinds, tie_p, tie_i):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.binary())], ["part", "blob"])

        for sid, s in _each(batches):
            n = len(s)
            if sid in seen:
                continue  # a copy within this partition
            seen.add(sid)
            at = np.searchsorted(known, s)
            hit = known[np.minimum(at, max(0, len(known) - 1))] == s if len(known) else np.zeros(n, dtype=bool)
            last = s[hit]
            last = last[np.argsort(ranks[at[hit]], kind="stable")] if len(last) > 1 else last
            ranked, p1 = np.concatenate([s[~hit], last]), prefix(n, 1, similarity)
            light = n - int(hit.sum())
            me = len(sids)
            sids.append(sid)
            sizes.append(n)
            tied.append(max(0, p1 - light))
            ties: set[int] = set()
            pivot_of = lambda x: int(pivots[np.searchsorted(known, x)])
            if n <= small and n > 1:
                first = ranked[: prefix(n, 2, similarity)]
                x, y = np.triu_indices(len(first), 1)
                both = x >= light  # of two heavy elements: tied to the first one's pivot
                ties |= {pivot_of(first[j]) for j in set(x[both].tolist())}
                if (~both).any():
                    keys.append(_mixed(first[x[~both]] * np.uint64(3) + _mixed(first[y[~both]])))
                    index.append(np.full(len(keys[-1]), me, dtype=np.uint32))
                    kinds.append(np.ones(len(keys[-1]), dtype=np.uint8))
            if b * n > a * small:  # large, or small enough to be a large one's partner
                first = ranked[:p1]
                ties |= {pivot_of(x) for x in first[light:]}
                if light:
                    keys.append(first[:light])
                    index.append(np.full(len(keys[-1]), me, dtype=np.uint32))
                    kinds.append(np.zeros(len(keys[-1]), dtype=np.uint8))
            for p in ties:
                tie_p.append(p)
                tie_i.append(me)
            if len(sids) >= DOCS_A_BLOB:
                yield flush()
        if sids:
            yield flush()

    return sets.mapInArrow(run, "part int, blob binary")


def _packed_pairs(index, kinds, begin, count, size, similarity):
    """2 * (x * sets + y) + (1 if by a subset) of each pair of sets in a list of at most LIST_PAIRS whose sizes fit, one
    number for each list that has it."""
    import numpy as np

    a, b = similarity
    pairs, found = (count >= 2) & (count <= LIST_PAIRS), [np.zeros(0, dtype=np.int64)]
    for k in np.unique(count[pairs]).tolist():
        first = begin[pairs & (count == k)]
        i, j = np.triu_indices(k, 1)
        step = max(1, PAIRS_AT_ONCE // len(i))
        for at in range(0, len(first), step):
            part = first[at : at + step]
            rows = index[part[:, None] + np.arange(k)]
            x, y, subset = rows[:, i].ravel().astype(np.int64), rows[:, j].ravel(), np.repeat(kinds[part] == 1, len(i))
            fits = (b * size[x] >= a * size[y]) & (b * size[y] >= a * size[x])
            found.append((x[fits] * len(size) + y[fits]) * 2 + subset[fits])
    return np.concatenate(found)


def _edges(postings: DataFrame, similarity) -> DataFrame:
    """Rows (a, b, na, nb, slack, c, tie): pairs of sets with the lists they share; ties (a the pivot, c 0); and, with
    a = b, the number c of a set's lists that became ties."""

    def run(key, group):
        import numpy as np
        import pyarrow as pa

        drop_kept()
        sid, size, tied, keys, index, kinds, tp, ti = ([] for _ in range(8))
        base = 0
        for blob in group.column("blob"):
            data = blob.as_buffer()  # not a copy
            m, n, t = np.frombuffer(data, dtype=np.uint32, count=3).tolist()
            at = 12
            for to, kind, count, shift in ((sid, "<i8", m, 0), (size, "<i4", m, 0), (tied, "<i4", m, 0), (keys, "<u8", n, 0), (index, "<u4", n, base), (kinds, "u1", n, 0), (tp, "<i8", t, 0), (ti, "<u4", t, base)):
                x = np.frombuffer(data, dtype=kind, count=count, offset=at)
                at += x.nbytes
                to.append(x + np.uint32(shift) if kind == "<u4" else x)
            base += m
        sid, size, tied, keys, index, kinds, tp, ti = map(np.concatenate, (sid, size, tied, keys, index, kinds, tp, ti))
        # copies from several partitions become one
        sid, first, at = np.unique(sid, return_index=True, return_inverse=True)
        at = at.astype(np.int32)
        size, tied, index, ti = size[first].astype(np.int64), tied[first].astype(np.int64), at[index], at[ti]
        order = np.lexsort((index, kinds, keys))
        keys, kinds, index = keys[order], kinds[order], index[order]
        new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (kinds[1:] != kinds[:-1])])
        once = new | np.concatenate([[True], index[1:] != index[:-1]])
        keys, kinds, index, new = keys[once], kinds[once], index[once], new[once]
        begin = np.flatnonzero(new)
        count = np.diff(np.append(begin, len(index)))
        out = []
        if len(packed := _packed_pairs(index, kinds, begin, count, size, similarity)):
            packed.sort()
            at = np.flatnonzero(np.concatenate([[True], packed[1:] >> 1 != packed[:-1] >> 1]))
            c = np.add.reduceat(np.where(packed & 1, 1 << 20, 1), at)  # a shared subset is a candidate by itself
            pair = packed[at] >> 1
            x, y = pair // len(sid), pair % len(sid)
            out.append((sid[x], sid[y], size[x], size[y], np.minimum(tied[x], tied[y]), c, np.zeros(len(x), dtype=bool)))
        del packed
        big = count > LIST_PAIRS
        member = index[np.repeat(big, count)]
        pivot = np.concatenate([tp, np.repeat(sid[index[begin[big]]], count[big])])
        lists = np.bincount(member, minlength=len(sid))
        member = np.concatenate([ti, member])
        ties = np.unique(np.column_stack([pivot, sid[member], size[member]]), axis=0) if len(member) else np.zeros((0, 3), dtype=np.int64)
        zero = np.zeros(len(ties), dtype=np.int64)
        out.append((ties[:, 0], ties[:, 1], zero, ties[:, 2], zero, zero, np.ones(len(ties), dtype=bool)))
        own = np.flatnonzero(lists)
        zero = np.zeros(len(own), dtype=np.int64)
        out.append((sid[own], sid[own], zero, zero, zero, lists[own], np.zeros(len(own), dtype=bool)))
        names = ["a", "b", "na", "nb", "slack", "c", "tie"]
        return pa.table({n: np.concatenate(v) for n, v in zip(names, zip(*out, strict=True), strict=True)})

    d = postings.groupBy("part").applyInArrow(run, "a long, b long, na long, nb long, slack long, c long, tie boolean")
    return d.groupBy("a", "b", "tie").agg(F.max("na").alias("na"), F.max("nb").alias("nb"), F.max("slack").alias("slack"), F.sum("c").alias("c"))


def _candidates(edges: DataFrame, similarity) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) that share enough lists, and ties (a the pivot, b)."""
    a, b = similarity
    lists = edges.where("a = b AND NOT tie").select(F.col("a").alias("x"), F.col("c").alias("lists"))
    d = edges.where("a <> b AND NOT tie")
    for side in ("a", "b"):
        d = d.join(lists.select(F.col("x").alias(side), F.col("lists").alias(f"l{side}")), side, "left")
    overlap = F.ceil(a * (F.col("na") + F.col("nb")) / (a + b))
    shared = lambda n: F.floor(n - F.ceil(a * n / b) + 1) - (n - overlap)
    need = F.least(shared(F.col("na")), shared(F.col("nb"))) - F.col("slack") - F.least(F.coalesce("la", F.lit(0)), F.coalesce("lb", F.lit(0)))
    return d.where(F.col("c") >= F.greatest(F.lit(1), need)).select("a", "b"), edges.where("tie AND a <> b").select("a", "b")


# --- verification ---


def linked(x, y, similarity) -> bool:
    import numpy as np

    a, b = similarity
    if b * min(len(x), len(y)) < a * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return b * both >= a * (len(x) + len(y) - both)


class _Forest:
    def __init__(self, n: int):
        self.up, self.size = list(range(n)), [1] * n

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            if self.size[i] < self.size[j]:
                i, j = j, i
            self.up[j] = i
            self.size[i] += self.size[j]


class _Lists:
    """Inverted lists of some sets in memory, to find what a set links to among them.

    A linked set shares one of the rarest elements (by these lists), as many as the prefix filter asks for.  And what
    two sets share, neither has to itself: sets with too many elements of their own for the overlap that their sizes
    ask for are left out, such as short texts around one common passage.  What is left is verified.
    """

    def __init__(self, sets: list):
        import numpy as np

        self.sets, self.sizes = sets, np.array([len(x) for x in sets])
        data, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(data, kind="stable")
        self.data, self.owner = data[order], owner[order]
        new = np.concatenate([[True], self.data[1:] != self.data[:-1]])
        alone = new & np.concatenate([new[1:], [True]])
        self.shared = np.bincount(self.owner[~alone], minlength=len(sets))

    def linked_to(self, s, similarity, inside: bool = True) -> list[int]:
        """Indices of the sets that ``s`` links to; ``inside`` says that ``s`` is one of them, which may be left out."""
        import numpy as np

        a, b = similarity
        lo, hi = np.searchsorted(self.data, s), np.searchsorted(self.data, s, "right")
        n = hi - lo
        asked = a * (self.sizes + len(s))
        fits = (b * len(s) >= a * self.sizes) & (b * self.sizes >= a * len(s)) & ((a + b) * np.count_nonzero(n > inside) >= asked)
        if inside:
            fits &= (a + b) * self.shared >= asked
        if not fits.any():
            return []
        rare = np.argsort(n, kind="stable")[: prefix(len(s), 1, similarity)]
        found = np.unique(self._owners(lo[rare], n[rare]))
        found = found[fits[found]]
        if len(found) <= 32:
            return [j for j in found.tolist() if linked(s, self.sets[j], similarity)]
        both = np.zeros(len(self.sets), dtype=np.int64)
        step = max(1, 4_000_000 // max(1, int(n.max())))
        for k in range(0, len(s), step):
            both += np.bincount(self._owners(lo[k : k + step], n[k : k + step]), minlength=len(self.sets))
        return np.flatnonzero(fits & (b * both >= a * (self.sizes + len(s) - both))).tolist()

    def _owners(self, lo, n):
        import numpy as np

        return self.owner[np.repeat(lo, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)]


def resolve(sets: list, pairs: list[tuple[int, int]], groups: list[tuple[int, list[int]]], similarity) -> tuple[list[int], list[tuple[int, int]]]:
    """Roots (indices) of the link components, and the members (group, member) that stay apart from their pivot.

    ``pairs`` are tested one by one; of each of ``groups`` (pivot, members) all members are compared with the pivot,
    and those that don't link to it with all other members.
    """
    f = _Forest(len(sets))
    for i, j in pairs:
        if f.root(i) != f.root(j) and linked(sets[i], sets[j], similarity):
            f.join(i, j)
    apart: list[tuple[int, int]] = []
    for g, (pivot, members) in enumerate(groups):
        for j in members:
            if f.root(j) != f.root(pivot) and linked(sets[pivot], sets[j], similarity):
                f.join(pivot, j)
        rest = [j for j in members if f.root(j) != f.root(pivot)]
        if rest:
            every = [pivot, *members]
            lists = _Lists([sets[i] for i in every])
            for j in rest:
                for k in lists.linked_to(sets[j], similarity):
                    f.join(j, every[k])
            apart += [(g, j) for j in rest if f.root(j) != f.root(pivot)]
    return [f.root(i) for i in range(len(sets))], apart


def _resolved(sets: DataFrame, pairs: DataFrame, ties: DataFrame, similarity, path: str, block_elements: int, group_elements: int) -> DataFrame:
    """Links (u, v) from ``sets`` (sid, n, shingles, comp), ``pairs`` and ``ties`` (a, b; a the pivot)."""
    # components of more than a block: one for each ``block_elements`` of all sets at most
    large = sets.groupBy("comp").agg(F.sum("n").alias("n")).where(F.col("n") > block_elements)
    large = F.broadcast(stored(large.select("comp", F.ceil(F.col("n") / block_elements).cast("int").alias("salts")), f"{path}/large"))
    salt = F.coalesce(F.pmod(F.xxhash64("sid"), F.col("salts")).cast("int"), F.lit(0))
    where = sets.select("sid", "comp").join(large, "comp", "left").select("sid", "comp", salt.alias("salt"))
    edges = pairs.select("a", "b", F.lit(False).alias("tie")).unionByName(ties.select("a", "b", F.lit(True).alias("tie")))
    edges = stored(edges.join(where.toDF("b", "of", "part"), "b").select("of", "part", "a", "b", "tie"), f"{path}/edges_of_blocks")
    # a set is where its component is, or, if that is split, in each block that has an edge of it
    whole = sets.join(large, "comp", "left_anti").select("comp", F.lit(0).alias("salt"), "sid", "shingles")
    need = edges.join(large.withColumnRenamed("comp", "of"), "of", "left_semi").select("of", "part", F.explode(F.array("a", "b")).alias("sid")).distinct()
    split = need.join(sets.join(large, "comp", "left_semi").select("sid", "shingles"), "sid").select(F.col("of").alias("comp"), F.col("part").alias("salt"), "sid", "shingles")
    block = whole.unionByName(split)

    def run(left, right):
        import numpy as np
        import pyarrow as pa

        sid = left.column("sid").to_pylist()
        place = {s: i for i, s in enumerate(sid)}
        data = [np.frombuffer(x.as_py(), dtype=np.uint64) for x in left.column("shingles")]
        two: list[tuple[int, int]] = []
        groups: dict[int, list[int]] = {}
        for a, b, tie in zip(*(right.column(c).to_pylist() for c in ("a", "b", "tie")), strict=True):
            if tie:
                groups.setdefault(place[a], []).append(place[b])
            else:
                two.append((place[a], place[b]))
        listed = list(groups.items())
        roots, apart = resolve(data, two, listed, similarity)
        rows = [(sid[i], sid[r], False) for i, r in enumerate(roots) if i != r] + [(sid[listed[g][0]], sid[j], True) for g, j in apart]
        return pa.table({"u": pa.array([r[0] for r in rows], pa.int64()), "v": pa.array([r[1] for r in rows], pa.int64()), "apart": pa.array([r[2] for r in rows], pa.bool_())})

    found = stored(block.groupBy("comp", "salt").cogroup(edges.groupBy("of", "part")).applyInArrow(run, "u long, v long, apart boolean"), f"{path}/resolved")
    links = found.where("NOT apart").select("u", "v")
    # in groups that are split over blocks
    rest = found.where("apart").select(F.col("u").alias("a"), F.col("v").alias("b")).distinct()
    spread = edges.where("tie").groupBy("a").agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x < y").select("a")
    rest = stored(rest.join(spread, "a", "left_semi"), f"{path}/rest")
    return links if rest.isEmpty() else links.unionByName(_across(sets, ties, rest, similarity, group_elements))


def _across(sets: DataFrame, ties: DataFrame, rest: DataFrame, similarity, group_elements: int) -> DataFrame:
    """Links (u, v) between ``rest`` (a, b: members that don't link to their pivot a) and all members of their groups, in
    blocks of ``group_elements``; ``rest`` is dealt to each block of its group."""
    one = sets.select("sid", "n", "shingles")
    asked = rest.select("a").distinct()
    members = ties.join(asked, "a", "left_semi").select("a", "b").unionByName(asked.select("a", F.col("a").alias("b"))).distinct()
    members = members.join(one, F.col("b") == F.col("sid")).select("a", "sid", "n", "shingles")
    weight = members.groupBy("a").agg(F.ceil(F.sum("n") / group_elements).cast("int").alias("salts"))
    block = members.join(weight, "a").select("a", F.pmod(F.xxhash64("sid", F.lit(1)), F.col("salts")).cast("int").alias("salt"), "sid", "shingles")
    ask = rest.join(weight, "a").join(one, F.col("b") == F.col("sid"))
    ask = ask.select(F.col("a").alias("p"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("part"), "sid", "shingles")

    def compare(left, right):
        import numpy as np
        import pyarrow as pa

        sid = left.column("sid").to_pylist()
        lists = _Lists([np.frombuffer(x.as_py(), dtype=np.uint64) for x in left.column("shingles")]) if sid else None
        u, v = [], []
        for i, x in zip(right.column("sid").to_pylist(), right.column("shingles"), strict=True):
            other = [sid[j] for j in lists.linked_to(np.frombuffer(x.as_py(), dtype=np.uint64), similarity, inside=False)] if sid else []
            v += [j for j in other if j != i]
            u += [i] * (len(v) - len(u))
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return block.groupBy("a", "salt").cogroup(ask.groupBy("p", "part")).applyInArrow(compare, "u long, v long")


def _bitmap(ids: DataFrame) -> tuple[int, bytes]:
    """A bitmap (bits, bytes) with the ids' remainders set; its size follows their number up to MOST_BITS."""
    import numpy as np

    bits = 1 << min(MOST_BITS.bit_length() - 1, max(16, (BITS_A_SET * ids.count()).bit_length()))
    word = F.shiftright(F.pmod(F.col("sid"), F.lit(bits)), 6)
    words = ids.select(word.alias("w"), F.expr(f"shiftleft(1L, cast(pmod(sid, {bits}) & 63 as int))").alias("x"))
    out = np.zeros(bits // 64, dtype=np.int64)
    for w, x in words.groupBy("w").agg(F.expr("bit_or(x)")).toLocalIterator():
        out[w] = x
    return bits, out.tobytes()


def _wanted(sets: DataFrame, wanted) -> DataFrame:
    """The rows of ``sets`` (sid, shingles) that are in the bitmap."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        bits, data = wanted.value
        bitmap = np.frombuffer(data, dtype=np.uint8)
        for batch in batches:
            at = batch.column(0).to_numpy() % bits
            yield batch.filter(pa.array((bitmap[at >> 3] >> (at & 7) & 1).astype(bool)))

    return sets.mapInArrow(run, "sid long, shingles binary")


def near_duplicates(docs: DataFrame, similarity: tuple[int, int] = SIMILARITY, block_elements: int = BLOCK_ELEMENTS, group_elements: int = GROUP_ELEMENTS) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (doc_id, text)."""
    with batches_of(docs.sparkSession, BATCH_ROWS):  # rows of whole sets
        return _near_duplicates(docs, similarity, block_elements, group_elements)


def _near_duplicates(docs: DataFrame, similarity: tuple[int, int], block_elements: int, group_elements: int) -> DataFrame:
    import numpy as np

    spark, path = docs.sparkSession, shared_dir(docs.sparkSession)
    rows = stored(_shingled(docs.select("doc_id", "text")), f"{path}/rows")
    sets = rows.where("shingles IS NOT NULL").select("sid", "shingles")
    counted = stored(_frequent(sets, similarity), f"{path}/frequent")
    total = counted.where("h IS NULL").select("c", "squares").first()
    postings, squares = (total.c, total.squares) if total else (0, 0.0)
    top = counted.where(F.col("h").isNotNull() & (F.col("c") >= HEAVY_TOTAL)).orderBy(F.desc("c"), "h").limit(HEAVY_ENTRIES).select("h", "pivot").toPandas()
    known = top["h"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(known)
    heavy = spark.sparkContext.broadcast((known[order], top["pivot"].to_numpy(dtype=np.int64)[order], np.arange(len(known), 0, -1, dtype=np.int32)[order]))
    small = boundary(postings, squares, similarity)
    parts = max(1, -(-postings // PART_POSTINGS))
    edges = stored(_edges(_postings(sets, heavy, small, parts, similarity), similarity), f"{path}/edges")
    pairs, ties = (stored(x, f"{path}/{n}") for x, n in zip(_candidates(edges, similarity), ("pairs", "ties"), strict=True))
    every = pairs.unionByName(ties)
    wanted = spark.sparkContext.broadcast(_bitmap(every.select(F.explode(F.array("a", "b")).alias("sid")).distinct()))
    comp = components(every.toDF("u", "v"), f"{path}/candidates").toDF("sid", "comp")
    # a set is a row for each partition that has it; one is enough
    chosen = _wanted(sets, wanted).groupBy("sid").agg(F.first("shingles").alias("shingles")).join(comp, "sid")
    chosen = stored(chosen.select("sid", F.floor(F.length("shingles") / 8).alias("n"), "shingles", "comp"), f"{path}/chosen")
    links = _resolved(chosen, pairs, ties, similarity, path, block_elements, group_elements)
    root = components(links, f"{path}/links").toDF("sid", "root")

    own = rows.select("doc_id", "sid", "n")
    full = own.where("n > 0").join(root, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    least = full.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    full = full.join(least, "root").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return full.unionByName(own.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def keep_first(docs: DataFrame, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the least of their component (null ids stay), with their columns; of
    repeated rows with one id and text one stays."""
    found = near_duplicates(docs, similarity).where("doc_id = component_id").select("doc_id").distinct()
    named = docs.where("doc_id IS NOT NULL").join(found, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"])
    return named.unionByName(docs.where("doc_id IS NULL"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
