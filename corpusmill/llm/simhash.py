"""SimHash near-duplicates: a binary trie joined with itself under an error budget of differing bits.

Free style. The steps:

1. fingerprints(): one narrow Arrow pass; the table of (id, fingerprint) is written once.
2. Equal fingerprints collapse: one row a fingerprint with its smallest id (partial aggregation first, so
   copies don't travel). Only distinct fingerprints are joined.
3. links(): the 64 bits are cut into budget + g blocks. Two fingerprints within the budget agree on at least
   g of them, so one trie is built for each choice of g blocks, with their bits on top; the tries' subtrees
   below the chosen blocks' values are the units of work. g grows with the table, so that subtrees keep their size. In each, node
   pairs are traversed together from the root, differing bits accumulate, and a pair is pruned as soon as they exceed the budget.
   Nothing is capped: a subtree with more fingerprints than a fixed number is split by a hash into parts, and each pair of parts
   is one unit. A task reads its units in order, ROWS rows at a time, so that its memory doesn't grow with its partition. What
   these units return are star edges of their own components, not all their pairs: at most one a fingerprint.
4. components(): large-star and small-star rounds (Kiveris et al., 2014) over these edges, each written
   to the shared folder; nothing is collected but a count and a checksum a round.
5. Joins carry the component's smallest id back to fingerprints and then to rows. Both sides of each join are
   plain scans, so adaptive execution can split a hot key.

representatives() asks for similar texts instead of near fingerprints: Jaccard similarity of five-word shingles. One fingerprint
of a whole text can't tell 0.8 (texts that similar differ in about ten of 64 bits), so each text gets PRINTS fingerprints, each the
SimHash of the SAMPLE shingles that come first under one hash order: texts of similarity J agree on one with probability about
J^SAMPLE, and miss all with (1 - J^SAMPLE)^PRINTS, 0.008 at 0.8. All of them go through the trie join above together; what it
links is a bucket of candidates, and every link is an exact check of the shingle sets. In a bucket, texts are checked against
leaders (the smallest ids); those alike are settled, the others meet more leaders, as LEADERS says. This makes hot groups into one.

What is left is found by an exact way, missing(): shingles are put in one order for all texts (those that a sample of texts shows to be
frequent last; any order gives the same links), and texts of similarity J or more share their first common shingle, which is among the
first n - ceil(J n) + 1 of each. Texts of different groups that meet at such a shingle are pairs; a pair is dropped only where its sizes,
the shingle's places, the parity of the shingles in PARITY classes (texts differ in at least as many shingles as in parities), or
the number of first shingles in common prove it to be less similar: of texts of n shingles each, c of them in common, the first k
common ones are among the first n - c + k, which are all among those read as long as k is at most c - ceil(J n) + 1; so k = must_share()
of them have to be met, where chance meets few. Only rows that have a partner by sizes and places travel with their parities. The rest of
the pairs have their sets checked. Groups are the components of all links, and no link is left out.

Cases: null and empty texts (and texts of white space) have fingerprint zero and link like any other; texts
with fewer words than a shingle use the whole sequence; repeated rows and ids each keep their row; a null id
is larger than any other, and a component of null ids only has a null id. Texts are read whole, extra columns
are not passed on, and an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import Scratch, cut, drop

BITS = 64
SHINGLE = 4
BUDGET = 4
SEED = 42
#: A subtree is split when it holds more fingerprints than this.
SPLIT = 4096
#: Most agreeing blocks.
AGREE = 4
#: Words of a shingle, and similarity, of texts that are alike; fingerprints of a text, and shingles behind each.
WORDS, SIMILARITY = 5, 0.8
PRINTS, SAMPLE = 12, 5
#: Classes of shingles whose parity a text has as a bit, and leaders of a bucket by round; what they leave, missing() finds.
PARITY = 1024
LEADERS = (1, 4, 16)
#: First shingles in common that are asked of a pair at most. More hold more places open.
COUNTED = 8
#: Texts of the sample that tells frequent shingles, and shingles that are told at most.
TEXTS, FREQUENT = 4096, 1 << 16
#: Rows of tables that are broadcast.
BROADCAST = 200_000
#: Node pairs with at most so many fingerprint pairs are compared directly.
LEAF = 16
#: Node pairs that are expanded at once.
FRONTIER = 1 << 17
#: Rows of units that a task holds at once, but for the end of the last unit.
ROWS = 1 << 17


def split_words(text: str | None) -> list[bytes]:
    """A-Z are lower-cased, words are split at ASCII white space."""
    return (text or "").encode("utf-8", "replace").lower().split()


def _digests(words: list[bytes], shingle: int, seed: int) -> list[bytes]:
    """XXH64 of every shingle (of the whole sequence, if it has fewer words), big-endian."""
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    if len(words) < shingle:
        return [digest(joined, seed)] if words else []
    ends = list(accumulate((len(w) + 1 for w in words), initial=0))
    return [digest(joined[a : b - 1], seed) for a, b in zip(ends, ends[shingle:])]


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Bits set in over half of the shingles' XXH64."""
    hashes = _digests(split_words(text), shingle, seed)
    n = len(hashes)
    total = np.zeros(BITS, np.int64)
    block = 8192
    for at in range(0, n, block):
        bits = np.unpackbits(np.frombuffer(b"".join(hashes[at : at + block]), np.uint8)).reshape(-1, BITS)
        total += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def fingerprints(documents: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """key and fp (the fingerprint as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, shingle, seed) for t in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["key", "fp"])

    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {rows.dtypes[0][1]}, fp long")


class Forest:
    """Union-find over positions, whole arrays at a time."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def _compress(self) -> None:
        while (above := self.up[self.up]).tobytes() != self.up.tobytes():
            self.up = above

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            self._compress()
            a, b = self.up[a], self.up[b]
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))

    def roots(self) -> np.ndarray:
        self._compress()
        return self.up


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for size steps, one after another."""
    ends = size.cumsum()
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size) + np.repeat(start, size)


def trie_join(a: np.ndarray, b: np.ndarray | None, top: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i in a, j in b) of values within budget bits of each other that agree on the top bits.

    a and b are sorted and distinct; b is None for a join of a with itself (then i < j). A trie node is a
    range of a sorted array. Pairs of nodes are followed together, and children whose bits differ carry one more
    error; pairs beyond the budget are dropped."""
    other = a if b is None else b
    prefix = lambda v: v >> np.uint64(BITS - top)
    heads, at = np.unique(prefix(a), return_index=True)
    ends = np.append(at[1:], len(a))
    low, high = np.searchsorted(prefix(other), heads, "left"), np.searchsorted(prefix(other), heads, "right")
    keep = high > low
    stack = [(top, at[keep], ends[keep], low[keep], high[keep], np.zeros(keep.sum(), np.int64))]
    ones: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def counts(depth: int) -> tuple[np.ndarray, np.ndarray]:
        if depth not in ones:
            bit = lambda v: np.concatenate(([0], ((v >> np.uint64(BITS - 1 - depth)) & np.uint64(1)).astype(np.int64).cumsum()))
            first = bit(a)
            ones[depth] = (first, first if b is None else bit(other))
        return ones[depth]

    while stack:
        depth, l1, h1, l2, h2, errors = stack.pop()
        if len(l1) > FRONTIER:
            half = len(l1) // 2
            stack += [(depth, *(x[s] for x in (l1, h1, l2, h2, errors))) for s in (slice(half, None), slice(half))]
            continue
        size = (h1 - l1) * (h2 - l2)
        small = (size <= LEAF) | (depth == BITS)
        if small.any():
            s1, s2, n1, n2 = l1[small], l2[small], (h1 - l1)[small], (h2 - l2)[small]
            for part in np.array_split(np.arange(len(s1)), 1 + int((n1 * n2).sum()) // FRONTIER):
                rows = _ranges(s1[part], n1[part])
                width = np.repeat(n2[part], n1[part])
                i, j = np.repeat(rows, width), _ranges(np.repeat(s2[part], n1[part]), width)
                near = np.bitwise_count(a[i] ^ other[j]) <= budget
                if b is None:
                    near &= i < j
                if near.any():
                    yield i[near], j[near]
            large = ~small
            l1, h1, l2, h2, errors = l1[large], h1[large], l2[large], h2[large], errors[large]
        if not len(l1):
            continue
        c1, c2 = counts(depth)
        m1, m2 = h1 - (c1[h1] - c1[l1]), h2 - (c2[h2] - c2[l2])
        children = [(l1, m1, l2, m2, errors), (m1, h1, m2, h2, errors), (l1, m1, m2, h2, errors + 1), (m1, h1, l2, m2, errors + 1)]
        x = [np.concatenate(c) for c in zip(*children)]
        keep = (x[1] > x[0]) & (x[3] > x[2]) & (x[4] <= budget)
        if b is None:
            keep &= x[0] <= x[2]  # of two mirrored pairs, one
        if keep.any():
            stack.append((depth + 1, *(c[keep] for c in x)))


Arrangement = tuple[tuple[tuple[int, int], ...], int]


def arrange(v: np.ndarray, blocks: tuple[tuple[int, int], ...]) -> np.ndarray:
    """The values with the blocks' bits in their order."""
    out = np.zeros_like(v)
    for start, width in blocks:
        out = (out << np.uint64(width)) | ((v >> np.uint64(BITS - start - width)) & np.uint64((1 << width) - 1))
    return out


def arrangements(budget: int, total: int, split: int = SPLIT) -> list[Arrangement]:
    """(blocks, bits of the first ones, which agree) for every choice of agreeing blocks; more of them for larger tables, so that
    subtrees hold split / 2 values or fewer on average."""
    for agree in range(1, AGREE + 1):
        blocks = cut_bits(budget + agree)
        if 2 * total <= split << sum(sorted(w for _, w in blocks)[:agree]):
            break
    out = []
    for chosen in combinations(range(len(blocks)), agree):
        order = (*(blocks[k] for k in chosen), *(x for k, x in enumerate(blocks) if k not in chosen))
        out.append((order, sum(blocks[k][1] for k in chosen)))
    return out


def cut_bits(many: int) -> list[tuple[int, int]]:
    """(first bit, width) of blocks."""
    edges = [round(BITS * k / many) for k in range(many + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def unit_stars(block: np.ndarray, left: np.ndarray, right: np.ndarray, part: np.ndarray, fp: np.ndarray, budget: int, cuts: list[Arrangement]) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (fingerprint, root) of the components in some units of a task.

    Units are (arrangement, left part, right part), any values on top (the trie join starts below them); where left = right a
    unit is joined with itself, else its part `left` with its part `right`."""
    forest_of, index = np.unique(fp, return_inverse=True)
    forest = Forest(len(forest_of))
    order = np.lexsort((right, left, block))
    names = np.stack([block, left, right], axis=1)[order]
    for mine in np.split(order, np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1) if len(order) else []:
        (blocks, top), one, other = cuts[block[mine[0]]], left[mine[0]], right[mine[0]]
        values, where = arrange(fp[mine], blocks), index[mine]
        sides = []
        for side in {one, other}:
            own = part[mine] == side
            v, at = np.unique(values[own], return_index=True)
            sides.append((v, where[own][at]))
        a, b = sides[0], (sides[1] if len(sides) > 1 else None)
        for i, j in trie_join(a[0], b and b[0], top, budget):
            forest.link(a[1][i], (b or a)[1][j])
    roots = forest.roots()
    moved = np.flatnonzero(roots != np.arange(len(roots)))
    return forest_of[moved], forest_of[roots[moved]]


_UNIT = ("block", "left", "right", "value")


def whole_units(batches: Iterator[pa.RecordBatch], rows: int = ROWS, unit: tuple[str, ...] = _UNIT) -> Iterator[pa.Table]:
    """The rows of batches that are sorted by unit, in tables of about so many rows that end where a unit does."""
    held = None
    for batch in batches:
        more = pa.Table.from_batches([batch])
        held = more if held is None else pa.concat_tables([held, more])
        if held.num_rows >= rows:
            ends = np.flatnonzero(reduce(np.logical_or, (np.diff(held[c].to_numpy()) != 0 for c in unit)))
            if len(ends):
                yield held.slice(0, ends[-1] + 1)
                held = held.slice(ends[-1] + 1)
    if held is not None and held.num_rows:
        yield held


def links(distinct: DataFrame, budget: int = BUDGET, split: int = SPLIT) -> DataFrame:
    """Star edges (a, b), a > b as signed longs, whose components are those of all links within the budget; distinct is a
    written table."""
    cuts = arrangements(budget, distinct.count(), split)

    def value(blocks: tuple[tuple[int, int], ...], top: int) -> Column:
        out, held = F.lit(0).cast("long"), 0
        for start, width in blocks:
            if held < top:
                out = F.shiftleft(out, width).bitwiseOR(F.shiftrightunsigned("fp", BITS - start - width).bitwiseAND(F.lit((1 << width) - 1).cast("long")))
                held += width
        return out

    rows = distinct.select("fp", F.posexplode(F.array(*[value(*c) for c in cuts])).alias("block", "value"))
    hot = cut(rows.groupBy("block", "value").count().where(F.col("count") > split).select("block", "value", F.ceil(F.col("count") / split).cast("int").alias("many")), "hot")
    n = hot.count()
    rows = rows.join(F.broadcast(hot) if n <= BROADCAST else hot, ["block", "value"], "left").withColumn("parts", F.coalesce("many", F.lit(1))) if n else rows.withColumn("parts", F.lit(1))
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    rows = rows.withColumn("part", part).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.withColumn("left", F.least("part", "with")).withColumn("right", F.greatest("part", "with"))
    units = rows.select(*_UNIT, "part", "fp").repartition(*_UNIT).sortWithinPartitions(*_UNIT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_units(batches):
            col = lambda c, t=t: t[c].to_numpy()
            a, b = unit_stars(col("block"), col("left"), col("right"), col("part"), col("fp").view(np.uint64), budget, cuts)
            a, b = a.view(np.int64), b.view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])

    return units.mapInArrow(run, "a long, b long")


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """One half round: (a, b) with a > b become edges to the smallest neighbour."""
    if small:
        around = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    else:
        around = edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("x")).select("x.*")
    around = cut(around, "around")
    least = cut(around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "least")
    met = around.join(least, "u")
    if small:
        out = met.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x")).select(F.col("x.v").alias("a"), F.col("x.m").alias("b"))
    else:
        out = met.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    stars = cut(out.where("a > b").distinct(), "stars")
    drop(edges, around, least)
    return stars


def components(edges: DataFrame) -> DataFrame:
    """(a, b): every node of an edge but the smallest of its component, with that smallest one."""
    edges, before = cut(edges.distinct(), "edges"), None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return edges
        before = now
        edges = _stars(_stars(edges, small=False), small=True)


def classes(marked: DataFrame, budget: int = BUDGET, split: int = SPLIT) -> DataFrame:
    """key, fp and component (the smallest key reachable) of a table of fingerprints that was written."""
    nodes = cut(marked.groupBy("fp").agg(F.min("key").alias("low")), "nodes")
    stars = components(links(nodes, budget, split))
    named = cut(nodes.join(stars.select(F.col("a").alias("fp"), F.col("b").alias("root")), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root")), "named")
    lows = cut(named.groupBy("root").agg(F.min("low").alias("component")), "lows")
    of_print = cut(named.join(lows, "root").select("fp", "component"), "components")
    return marked.join(of_print, "fp")


def near_duplicates(documents: DataFrame, key: str = "doc_id", budget: int = BUDGET, shingle: int = SHINGLE, split: int = SPLIT) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row."""
    found = classes(cut(fingerprints(documents, key, shingle=shingle), "fingerprints"), budget, split)
    return found.select(F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


_SEEDS = np.array([xxhash.xxh64_intdigest(b"%d" % k) for k in range(PRINTS)], np.uint64)


def _mixed(v: np.ndarray) -> np.ndarray:
    """Another order of 64-bit hashes (the finaliser of SplitMix64)."""
    v = (v ^ (v >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    v = (v ^ (v >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return v ^ (v >> np.uint64(31))


def shingle_set(text: str | None, shingle: int = WORDS, seed: int = SEED) -> np.ndarray:
    """The different hashes of a text's shingles."""
    return np.unique(np.frombuffer(b"".join(_digests(split_words(text), shingle, seed)), ">u8").astype(np.uint64))


def sample_prints(own: np.ndarray) -> np.ndarray:
    """PRINTS fingerprints of a shingle set (none of an empty one): the SimHash of its first SAMPLE hashes in each of as many orders."""
    held = np.zeros((PRINTS, 0), np.uint64)
    for at in range(0, len(own), 65_536):
        held = np.concatenate([held, _mixed(own[None, at : at + 65_536] ^ _SEEDS[:, None])], axis=1)
        if held.shape[1] > SAMPLE:
            held = np.partition(held, SAMPLE - 1, axis=1)[:, :SAMPLE]
    if not len(own):
        return np.zeros(0, np.int64)
    # The values that order the shingles are small where they come first: mixed once more, their bits are even again.
    bits = np.unpackbits(_mixed(held).astype(">u8").view(np.uint8).reshape(PRINTS, -1, BITS // 8), axis=2).sum(axis=1, dtype=np.int32)
    return np.packbits(2 * bits > held.shape[1], axis=1).view(">i8").ravel().astype(np.int64)


def parity(own: np.ndarray) -> np.ndarray:
    """Whether the number of shingles in each of PARITY classes is odd, as longs: sets differ in at least as many shingles as here in bits."""
    odd = np.bincount((own % np.uint64(PARITY)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(">i8").astype(np.int64)


def least_common(sizes: np.ndarray, similarity: float) -> np.ndarray:
    """Shingles that two sets of so many together have in common at least, if they are so similar."""
    return np.ceil(similarity / (1 + similarity) * sizes - 1e-6).astype(np.int64)


def must_share(small: np.ndarray, large: np.ndarray, similarity: float) -> np.ndarray:
    """First shingles, COUNTED at most, that two sets of such sizes have in common at least, if they are so similar: see prefix()."""
    return np.clip(least_common(small + large, similarity) - np.ceil(similarity * large - 1e-6).astype(np.int64) + 1, 1, COUNTED)


def prefix(own: np.ndarray, similarity: float, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first shingles of a set, by their number in the sample and then by hash: so many that sets so similar share one of them."""
    known, many = frequent
    count = np.zeros(len(own), np.int64)
    if len(known) and len(own):
        at = np.minimum(np.searchsorted(known, own), len(known) - 1)
        count = np.where(known[at] == own, many[at], 0)
    first = len(own) - int(np.ceil(similarity * len(own) - 1e-6)) + 1 if len(own) else 0
    return own[np.lexsort((own, count))[:first]]


def frequent_shingles(documents: DataFrame, key: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles, in order, that at least two of about TEXTS texts have, and in how many; the most frequent ones, if they are many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text).view(np.int64))], names=["shingle"])

    some = documents.where(F.pmod(F.xxhash64(key), F.lit(max(1, n // TEXTS))) == 0).select("text")
    found = some.mapInArrow(run, "shingle long").groupBy("shingle").count().where("count > 1").orderBy(F.desc("count"), "shingle").limit(FREQUENT).toArrow()
    known, many = found["shingle"].to_numpy().view(np.uint64), found["count"].to_numpy()
    order = np.argsort(known)
    return known[order], many[order]


def _lists(found: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]).astype(np.int32)), pa.array(np.concatenate(found).view(np.int64)))


def marks(documents: DataFrame, key: str, similarity: float, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """key, two hashes of the sequence of words, and size, parities, prints and first shingles of every row's shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, same, size, bits, prints, firsts = batch.slice(at, 256), [], [], [], [], []
                for text in part.column(1).to_pylist():
                    same.append(xxhash.xxh3_128_digest(b" ".join(split_words(text))))
                    own = shingle_set(text)
                    size.append(len(own))
                    bits.append(parity(own))
                    prints.append(sample_prints(own))
                    firsts.append(prefix(own, similarity, frequent))
                h = np.frombuffer(b"".join(same), np.int64).reshape(-1, 2)
                columns = [part.column(0), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), pa.array(size, pa.int32()), _lists(bits), _lists(prints), _lists(firsts)]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "h", "h2", "size", "bits", "prints", "firsts"])

    rows = documents.select(F.col(key).alias("key"), "text")
    return rows.mapInArrow(run, f"key {rows.dtypes[0][1]}, h long, h2 long, size int, bits array<long>, prints array<long>, firsts array<long>")


def shingle_sets(documents: DataFrame, key: str) -> DataFrame:
    """key and shingles (an array of hashes) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), _lists([shingle_set(t) for t in part.column(1).to_pylist()])], names=["key", "shingles"])

    rows = documents.select(F.col(key).alias("key"), "text")
    return rows.mapInArrow(run, f"key {rows.dtypes[0][1]}, shingles array<long>")


def alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (key, leader) whose shingle sets are so similar."""
    both = pairs.join(sets, "key").join(sets.select(F.col("key").alias("leader"), F.col("shingles").alias("others")), "leader")
    common = F.size(F.array_intersect("shingles", "others"))
    counted = both.select("key", "leader", common.alias("common"), (F.size("shingles") + F.size("others") - common).alias("union"))
    return counted.where(F.col("common") >= similarity * F.col("union") - 1e-9).select("key", "leader")


def _grouped(table: DataFrame, groups: DataFrame | None) -> DataFrame:
    """table with the group of each key: the smallest key that links have brought it together with."""
    if groups is None:
        return table.withColumn("group", F.col("key"))
    return table.join(groups.withColumnsRenamed({"a": "key", "b": "group"}), "key", "left").withColumn("group", F.coalesce("group", "key"))


def several_groups(t: pa.Table, split: int) -> pa.Table:
    """The rows of units with texts of several groups. A unit of more than so many rows is cut into parts, and its pairs of parts are units."""
    unit, codes = t["unit"].to_numpy(), t["group"].combine_chunks().dictionary_encode().indices.to_numpy()
    start = np.flatnonzero(np.diff(unit, prepend=unit[0] - 1))
    many = np.diff(start, append=len(unit))
    met = np.minimum.reduceat(codes, start) != np.maximum.reduceat(codes, start)
    rows = np.flatnonzero(np.repeat(met, many))
    parts = np.repeat(-(-many // split), many)[rows]
    part, own = np.arange(len(unit))[rows] % parts, np.repeat(rows, parts)
    other, part, parts = _ranges(np.zeros(len(rows), np.int64), parts), np.repeat(part, parts), np.repeat(parts, parts)
    low, high = np.minimum(part, other), np.maximum(part, other)
    # A pair of parts is named by a hash. Units that share a name by chance only meet once more.
    name = np.where(parts == 1, unit[own], _mixed(unit[own].view(np.uint64) + (low * parts + high + 1).astype(np.uint64)).view(np.int64))
    side = np.where(low == high, 0, np.where(part == low, 1, 2))
    cut = t.drop_columns(["unit"]).take(pa.array(own)).append_column("unit", pa.array(name)).append_column("side", pa.array(side, pa.int32()))
    return cut.append_column("parts", pa.array(parts, pa.int32()))


def with_partners(t: pa.Table, similarity: float) -> pa.Table:
    """The rows of several_groups() without those that are in no pair of their unit by sizes and places. Parts of a cut unit stay as they
    are: their pairs are looked at only once they are dealt out."""
    stays = t["parts"].to_numpy() > 1
    whole = np.flatnonzero(~stays)
    if len(whole):
        for i, j in unit_pairs(t.take(pa.array(whole)), similarity):
            stays[whole[i]] = stays[whole[j]] = True
    return t.filter(pa.array(stays))


def unit_pairs(t: pa.Table, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (i, j) of whole units, each pair of a unit's texts in different groups that sizes, places and parities, if t has them, allow to
    be so similar, where the unit is one of the first must_share() shingles in common."""
    unit, size = np.unique(t["unit"].to_numpy(), return_inverse=True)[1], t["size"].to_numpy().astype(np.int64)
    order = np.lexsort((size, unit))
    unit, size, place, side = unit[order], size[order], t["pos"].to_numpy()[order], t["side"].to_numpy()[order]
    group = t["group"].combine_chunks().dictionary_encode().indices.to_numpy()[order]
    bits = t["bits"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(order), -1) if "bits" in t.column_names else None
    at, most = unit << 32 | size, np.floor(size / similarity + 1e-6).astype(np.int64)
    width = np.searchsorted(at, unit << 32 | np.minimum(most, (1 << 32) - 1), "right") - np.arange(len(at)) - 1
    for some in np.split(np.arange(len(at)), np.flatnonzero(np.diff(width.cumsum() // FRONTIER)) + 1):
        i, j = np.repeat(some, width[some]), _ranges(some + 1, width[some])
        keep = (group[i] != group[j]) & ((side[i] == 0) | (side[i] != side[j]))
        i, j = i[keep], j[keep]
        both = size[i] + size[j]
        common = least_common(both, similarity)
        # The first of the common shingles has at least `common` from its place on in each, the next one fewer, and so on.
        after = common - must_share(size[i], size[j], similarity) + 1
        keep = (size[i] - place[i] >= after) & (size[j] - place[j] >= after)
        i, j, apart = i[keep], j[keep], (both - 2 * common)[keep]
        if bits is None:
            yield order[i], order[j]
            continue
        for part in np.array_split(np.arange(len(i)), 1 + len(i) // 8192):
            x, y = order[i[part]], order[j[part]]
            keep = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64) <= apart[part]
            if keep.any():
                yield x[keep], y[keep]


def missing(documents: DataFrame, texts: DataFrame, groups: DataFrame | None, key: str, similarity: float, split: int = SPLIT) -> DataFrame:
    """(a, b), a > b: every link between texts of different groups. texts: a written table of marks."""
    scratch, kind = Scratch(documents.sparkSession), texts.schema["key"].dataType.simpleString()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_units(batches, unit=("unit",)):
            yield from with_partners(several_groups(t, split), similarity).select(["unit", "side", "key", "group", "size", "pos"]).to_batches()

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_units(batches, unit=("unit",)):
            keys = t["key"].combine_chunks().dictionary_encode()
            codes, found, times = keys.indices.to_numpy().astype(np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
            for i, j in unit_pairs(t, similarity):
                a, b = codes[i], codes[j]
                found, at = np.unique(np.concatenate([found, np.minimum(a, b) << 32 | np.maximum(a, b)]), return_inverse=True)
                times = np.bincount(at, np.concatenate([times, np.ones(len(a), np.int64)]), len(found)).astype(np.int64)
            size = np.zeros(len(keys.dictionary), np.int64)
            size[codes] = t["size"].to_numpy()
            a, b = found >> 32, found & 0xFFFFFFFF
            least = must_share(np.minimum(size[a], size[b]), np.maximum(size[a], size[b]), similarity)
            name = lambda c, keys=keys: keys.dictionary.take(pa.array(c))
            yield pa.RecordBatch.from_arrays([name(a), name(b), pa.array(times), pa.array(least)], names=["a", "b", "times", "least"])

    rows = _grouped(texts.select("key", "size", "firsts"), groups).select("key", "group", "size", F.posexplode("firsts").alias("pos", "unit"))
    rows = rows.repartition("unit").sortWithinPartitions("unit")
    members = scratch.put(rows.mapInArrow(meet, f"unit long, side int, key {kind}, group {kind}, size int, pos int"), "members")
    rows = members.join(texts.select("key", "bits"), "key").repartition("unit").sortWithinPartitions("unit")
    found = rows.mapInArrow(pair, f"a {kind}, b {kind}, times long, least long").groupBy(F.greatest("a", "b").alias("key"), F.least("a", "b").alias("leader"))
    pairs = scratch.put(found.agg(F.sum("times").alias("times"), F.min("least").alias("least")).where("times >= least").select("key", "leader"), "pairs")
    keys = scratch.put(pairs.select("key").unionByName(pairs.select(F.col("leader").alias("key"))).distinct(), "keys")
    named = documents.select(F.col(key).alias("key"), "text")
    sets = scratch.put(shingle_sets(named.join(keys, "key", "left_semi"), "key"), "sets")
    linked = scratch.put(alike(pairs, sets, similarity).select(F.col("key").alias("a"), F.col("leader").alias("b")), "linked")
    scratch.drop(members, pairs, keys, sets)
    return linked


def similar(documents: DataFrame, texts: DataFrame, key: str, similarity: float = SIMILARITY, budget: int = BUDGET, split: int = SPLIT) -> DataFrame:
    """(a, b): every text of a group of similar texts but the smallest key, with that smallest key. texts: a written table of marks."""
    scratch = Scratch(documents.sparkSession)
    prints = scratch.put(texts.select("key", F.explode("prints").alias("fp")), "prints")
    met = scratch.put(classes(prints, budget, split).select(F.col("component").alias("bucket"), "key").distinct(), "met")
    several = scratch.put(met.groupBy("bucket").count().where("count > 1").select("bucket"), "several")
    held = scratch.put(met.join(several, "bucket", "left_semi"), "held")
    keys = scratch.put(held.select("key").distinct(), "keys")
    named = documents.select(F.col(key).alias("key"), "text")
    sets = scratch.put(shingle_sets(named.join(keys, "key", "left_semi"), "key"), "sets")
    rest = scratch.put(held.join(texts.select("key", "size", "bits"), "key").select("bucket", "key", "size", "bits", F.col("key").alias("group")), "rest")
    scratch.drop(prints, met, several, held, keys)
    apart = reduce(lambda x, y: x + y, (F.bit_count(F.col("bits")[k].bitwiseXOR(F.col("others")[k])) for k in range(PARITY // 64)))
    both = F.col("size") + F.col("its_size")
    may = apart <= both - 2 * F.ceil(similarity / (1 + similarity) * both - 1e-6)
    groups = None
    for many in LEADERS:
        if rest.isEmpty():
            break
        rank = F.row_number().over(Window.partitionBy("bucket").orderBy("key"))
        first = rest.withColumn("rank", rank).where(F.col("rank") <= many)
        leaders = scratch.put(first.select("bucket", F.col("key").alias("leader"), F.col("size").alias("its_size"), F.col("bits").alias("others"), F.col("group").alias("its")), "leaders")
        worth = (F.col("key") > F.col("leader")) & (F.col("group") != F.col("its")) & may
        own, other = rest.alias("own"), leaders.alias("other")
        tried = scratch.put(own.join(other, (F.col("own.bucket") == F.col("other.bucket")) & worth).select("own.bucket", "key", "leader"), "tried")
        pairs = scratch.put(tried.select("key", "leader").distinct(), "pairs")
        linked = scratch.put(alike(pairs, sets, similarity), "linked")
        settled = tried.join(linked, ["key", "leader"], "left_semi").select("bucket", "key").unionByName(leaders.select("bucket", F.col("leader").alias("key")))
        settled = scratch.put(settled.distinct(), "settled")
        left = rest.join(settled, ["bucket", "key"], "left_anti")
        if not linked.isEmpty():
            groups = _joined(groups, linked.select(F.col("key").alias("a"), F.col("leader").alias("b")))
            left = _grouped(left.drop("group"), groups)
        left = scratch.put(left.select("bucket", "key", "size", "bits", "group"), "left")
        # Buckets that earlier links have brought together are done.
        open_ = scratch.put(left.groupBy("bucket").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low != high").select("bucket"), "open")
        before, rest = rest, scratch.put(left.join(open_, "bucket", "left_semi"), "rest")
        scratch.drop(before, leaders, tried, pairs, linked, settled, left, open_)
    scratch.drop(sets, rest)
    more = missing(documents, texts, groups, key, similarity, split)
    if groups is not None and more.isEmpty():
        drop(more)
        return groups
    return _joined(groups, more)


def _joined(groups: DataFrame | None, linked: DataFrame) -> DataFrame:
    """The groups with more links."""
    if groups is None:
        return components(linked)
    after = components(groups.unionByName(linked))
    drop(groups)
    return after


def representatives(documents: DataFrame, similarity: float = SIMILARITY, budget: int = BUDGET, split: int = SPLIT) -> DataFrame:
    """One row of each group of similar texts, with its own columns: the one with the smallest id. Rows without words are one group.

    Where ids repeat or are null, rows are numbered by (id, text) first, so that each is a document of its own."""
    columns, mark, scratch = documents.columns, "_row_of_component", Scratch(documents.sparkSession)
    n, ids = documents.agg(F.count("*"), F.countDistinct("doc_id")).first()
    if n == ids:
        rows = documents.withColumn(mark, F.col("doc_id"))
    else:
        rows = scratch.put(documents.orderBy(F.col("doc_id").asc_nulls_last(), "text").withColumn(mark, F.monotonically_increasing_id()), "numbered")
    marked = scratch.put(marks(rows, mark, similarity, frequent_shingles(rows, mark, n)), "marks")
    # Equal sequences of words first: only the smallest id of each goes on.
    lows = scratch.put(marked.groupBy("h", "h2").agg(F.min("key").alias("low")), "lows")
    copies = scratch.put(marked.select("key", "h", "h2").join(lows, ["h", "h2"]).where("key != low").select("key"), "copies")
    texts = scratch.put(marked.drop("h", "h2").join(copies, "key", "left_anti"), "texts")
    scratch.drop(marked, lows)
    groups = similar(rows, texts, mark, similarity, budget, split)
    gone = scratch.put(copies.unionByName(groups.select(F.col("a").alias("key"))).select(F.col("key").alias(mark)), "gone")
    scratch.drop(texts, copies)
    return rows.join(gone, mark, "left_anti").select(*columns)
