"""Near-duplicate detection by a chosen-path set similarity join.

A document's set holds its distinct shingles of ``width`` words (lower-cased in
A-Z only): two in ``linked``, which is the query's rule, and five in
``deduplicated``. A text with fewer words is one shingle; one without words has
the empty set and is linked with nothing. Documents with equal sets are one
class; classes with ``100 * |A & B| >= 80 * |A | B|`` are linked.

Join. In each of ``TREES`` independent trees a class descends by minwise tokens:
at the root it takes one, below that ``BRANCH`` each, so that at similarity 0.8
a pair shares a child with probability at least 1 - 0.2 ** 2 and a leaf of one
tree with about 0.75 at any depth; eight trees miss fewer than 2 in 100,000 of
the pairs right at the threshold and far fewer above. A node stops branching
when it has at most ``NODE`` classes. Those are compared exhaustively by
sketches of ``SKETCH`` two-bit minwise values, an estimate that only drops pairs
about four standard deviations under the threshold. There are ``LEVELS`` levels, so
that unlike texts that share common words part; nodes still larger at the last one
hold near copies for the most part, and all their classes are candidates of each other.

A node is a hash of the tokens on its path, so a class's nodes are computed where
the class is. Per level only (node, count) pairs meet; bitmaps of bounded size tell
tasks which nodes are small and which are large. So classes alone in a node and
classes of large nodes aren't shuffled by it, whatever the nodes' sizes. A node
that a full bitmap takes for large branches further, which is as good a split.

Confirmation. Candidate pairs are never listed: nodes give edges that span them,
and the components of those edges are families, each class in one. The families'
texts are sent to blocks, where sets are made again and all pairs are decided on
full sets by matrix products. A family of weight ``BLOCK`` (rows, long texts more)
is one block. In a larger one every class is first tested against the family's most
central one (that in most large nodes), of which each block gets a copy. Those not
linked to it, the rest, then meet all the family's classes by sketches, ``WIDE`` at a
time: this parts the family into smaller ones and drops classes that are like no other.
What is left is decided on full sets, all pairs with the rest, block by block, and in
passes of ``PASS`` blocks of the rest, so that no pass deals a text more than a few
times, whatever the family's size. So no task holds the family, no partner is capped
and no pair is emitted but edges that span the links.

Defined results: rows are kept one for one, repeated ids included; a row with a
null id takes part in links but represents none; a null text has no words. A very
long text is one set and weighs more in its block. An empty table gives an empty
result; other columns don't enter, whatever they are called. ``deduplicated`` keeps one row of each
component, and of rows repeated whole one.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow, bounded_batches, drop_stored, fresh, in_sieve, plus, read, salted_join, sieve, sieve_arrays, stored
from .components import components, spanning
from .textkit import LOWER, NOT_SPACE, mix64, pair_hashes, row_unique, slices, span_hashes, utf8, words

TREES, LEVELS, BRANCH, NODE = 8, 5, 2, 128
TOKENS = TREES * BRANCH * (LEVELS - 1)
#: Minwise functions; two bits of each are a class's sketch. The first TREES give the roots, the next TOKENS the children.
SKETCH, SKETCH_LEAST = 128, 92
MARKS = 4 * TREES + TOKENS + SKETCH // 4
#: Full sets that one task holds at a time: rows, each counted once and once more for every HEAVY shingles.
BLOCK, HEAVY, SLAB = 512, 512, 4096
#: Rows of a block of sketches, and blocks of the rest that a pass deals the rows of a large family to: of sketches, of texts.
WIDE, WIDE_PASS, PASS = 8192, 16, 2
#: Values that sketches agree in there: six standard deviations under the threshold, since all pairs of a family are tested by these alone.
WIDE_LEAST = 84
_SEEDS = np.random.default_rng(88172645).integers(1, 1 << 62, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the shingles of each row, and their bounds."""
    low = LOWER[buf]
    starts, ends, bounds = words(low, offsets, NOT_SPACE)
    pairs, rows = pair_hashes(span_hashes(low, starts, ends), bounds, width)
    return row_unique(pairs, rows, len(offsets) - 1)


def minwise(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(rows, SKETCH) minwise values of 32 bits; rows with empty sets hold the largest."""
    out = np.full((len(bounds) - 1, SKETCH), 0xFFFFFFFF, np.uint32)
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        at = bounds[some]
        for j, seed in enumerate(_SEEDS):
            out[some, j] = np.minimum.reduceat(((values * seed) >> np.uint64(32)).astype(np.uint32), at)
    return out


def marks(least: np.ndarray) -> np.ndarray:
    """(rows, 32 + TOKENS + 32) bytes: the roots' tokens, the children's (a byte each), the sketch."""
    bits = ((least >> np.uint32(10)) & np.uint32(3)).astype(np.uint8).reshape(-1, SKETCH // 4, 4)
    sketch = bits[:, :, 0] | bits[:, :, 1] << 2 | bits[:, :, 2] << 4 | bits[:, :, 3] << 6
    return np.concatenate([np.ascontiguousarray(least[:, :TREES]).view(np.uint8), least[:, TREES : TREES + TOKENS].astype(np.uint8), sketch], axis=1)


def _described(docs: DataFrame, text_col: str, width: int) -> DataFrame:
    """Each row's columns but the text, with n_shingles, cls (the set's 128-bit key) and marks."""
    keep = [c for c in docs.columns if c != text_col]
    schema = plus(docs, keep, "n_shingles bigint, cls binary, marks binary")

    def describe(batches):
        for b in batches:
            buf, offsets = utf8(b.column(text_col))
            n, keys, found = [np.zeros(0, np.int64)], [np.zeros((0, 2), ">u8")], [marks(np.zeros((0, SKETCH), np.uint32))]
            for _, _, part, at in slices(buf, offsets):
                v, bounds = shingle_sets(part, at, width)
                n.append(np.diff(bounds))
                keys.append(_keys(v, bounds))
                found.append(marks(minwise(v, bounds)))
            found = np.concatenate(found)
            cols = [pa.array(np.concatenate(n), pa.int64()), _binary(np.concatenate(keys).astype(">u8"), 16), _binary(found, found.shape[1])]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *cols], names=[*keep, "n_shingles", "cls", "marks"])

    return docs.transform(arrow, describe, schema)


def _keys(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """128-bit keys of the sets, big-endian so that bytes sort as numbers do."""
    n = np.diff(bounds).astype(np.uint64)
    sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(x)]) for x in (values, mix64(values ^ np.uint64(0x5851F42D4C957F2D)))]
    return np.stack([mix64(x[bounds[1:]] - x[bounds[:-1]] + n) for x in sums], axis=1).astype(">u8")


def _binary(rows: np.ndarray, width: int) -> pa.Array:
    raw = rows.tobytes()
    return pa.array([raw[i : i + width] for i in range(0, len(raw), width)], pa.binary())


def _bytes(column: pa.Array, width: int) -> np.ndarray:
    """(rows, width) bytes of a column whose values have that width."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _paths(found: np.ndarray, large: list[np.ndarray]):
    """For each level down to the one under the last sieve given: rows of ``found`` (marks) and their nodes there.

    A node is a hash of the tokens on its path, so it is known where the class is. Rows whose node is in its level's sieve of
    large nodes descend by BRANCH other tokens.
    """
    roots = np.ascontiguousarray(found[:, : 4 * TREES]).view(np.uint32).astype(np.uint64)
    tokens = found[:, 4 * TREES : 4 * TREES + TOKENS].astype(np.uint64)
    node = mix64(roots + (np.arange(1, TREES + 1, dtype=np.uint64) << np.uint64(40))).ravel()
    row, tree = np.repeat(np.arange(len(found)), TREES), np.tile(np.arange(TREES), len(found))
    yield row, node
    for depth, sieve in enumerate(large):
        hit = in_sieve(sieve, node)
        row, tree, node = row[hit], tree[hit], node[hit]
        place = [((depth * TREES) + tree) * BRANCH + b for b in range(BRANCH)]
        node = np.concatenate([mix64(node + mix64(tokens[row, p] + np.uint64(((depth + 1) * BRANCH + b + 1) << 20))) for b, p in enumerate(place)])
        row, tree = np.tile(row, BRANCH), np.tile(tree, BRANCH)
        yield row, node


def _trees(classes: DataFrame) -> tuple[list[np.ndarray], list[np.ndarray], bool]:
    """Sieves of the nodes of 2..NODE classes and of larger ones by level, and whether the last level has large ones.

    Only (node, count) pairs are shuffled, summed on the map side, so no node's rows meet here.
    """
    leaf: list[np.ndarray] = []
    large: list[np.ndarray] = []
    some = True
    while some and len(large) < LEVELS:
        shared = classes.sparkSession.sparkContext.broadcast(large)

        def count(batches, shared=shared):
            for b in batches:
                *_, (_, node) = _paths(_bytes(b.column("marks"), MARKS), shared.value)
                node, n = np.unique(node, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(n.astype(np.int64))], names=["node", "n"])

        counts = classes.select("marks").transform(arrow, count, "node:bigint,n:bigint").groupBy("node").agg(F.sum("n").alias("n")).where("n > 1")
        counts = stored(counts, "nodes")
        of = counts.agg(F.count_if(F.col("n") <= NODE).alias("small"), F.count_if(F.col("n") > NODE).alias("big")).first()
        for sieves, x in zip((leaf, large), sieve_arrays(counts.select("node", F.col("n") > NODE), of.small, of.big), strict=True):
            sieves.append(x)
        drop_stored(counts)
        some = of.big > 0
    return leaf, large, some


def _runs(batches, columns):
    """Arrow batches cut so that rows of one node, which are sorted together, are never parted."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b]).select(columns)
        held = t if held is None else pa.concat_tables([held, t])
        node = held.column("node").to_numpy()
        cut = int(np.searchsorted(node, node[-1])) if len(node) else 0
        if cut:
            yield held.slice(0, cut).combine_chunks()
            held = held.slice(cut).combine_chunks()
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def _sizes_allow(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 5 * np.minimum(a, b) >= 4 * np.maximum(a, b)


def _alike(a: np.ndarray, b: np.ndarray, least: int = SKETCH_LEAST) -> np.ndarray:
    """Whether sketches, as words along the last axis, agree in ``least`` values."""
    differ = a ^ b
    return np.bitwise_count((differ | differ >> np.uint64(1)) & np.uint64(0x5555555555555555)).sum(axis=-1) <= SKETCH - least


def _compared(node, n, sketch):
    """Index pairs in the same node that sizes and sketches allow; all pairs, offset by offset."""
    end = np.searchsorted(node, node, "right")
    k, left = 1, np.arange(len(node))
    while len(left := left[left + k < end[left]]):
        for part in np.array_split(left, max(1, len(left) >> 16)):
            part = part[_sizes_allow(n[part], n[part + k])]
            if len(part):
                hit = _alike(sketch[part], sketch[part + k])
                if hit.any():
                    yield part[hit], part[hit] + k
        k += 1


def _edges(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _candidates(classes: DataFrame, leaf: list[np.ndarray], large: list[np.ndarray], hot: bool) -> DataFrame:
    """Edges (u, v) that span the candidate pairs: of each small node by sketches, and of each large one at the last level, which is a vertex under 0."""
    shared = classes.sparkSession.sparkContext.broadcast((leaf, large))

    def place(batches):
        small, big = shared.value
        for b in batches:
            found = _bytes(b.column("marks"), MARKS)
            rows, nodes = [], []
            for (row, node), s, l in zip(_paths(found, big[:-1]), small, big, strict=True):
                hit = in_sieve(s, node) & ~in_sieve(l, node)
                rows.append(row[hit])
                nodes.append(node[hit])
            row = np.concatenate(rows)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes).view(np.int64)), b.column("k").take(at), b.column("n_shingles").take(at), _binary(found[row, 4 * TREES + TOKENS :], SKETCH // 4)], names=["node", "k", "n_shingles", "sketch"])

    def compare(batches):
        for t in _runs(batches, ["node", "k", "n_shingles", "sketch"]):
            ks, at = np.unique(t.column("k").to_numpy(), return_inverse=True)
            sketch = np.ascontiguousarray(_bytes(t.column("sketch"), SKETCH // 4)).view(np.uint64)
            found = list(_compared(t.column("node").to_numpy(), t.column("n_shingles").to_numpy(), sketch))
            if found:
                a, b = (np.concatenate(x) for x in zip(*found, strict=True))
                u, v = spanning(len(ks), at[a], at[b])
                yield _edges(ks[u], ks[v])

    leaves = classes.select("k", "n_shingles", "marks").transform(arrow, place, "node:bigint,k:bigint,n_shingles:bigint,sketch:binary")
    near = leaves.repartition("node").sortWithinPartitions("node").transform(arrow, compare, "u:bigint,v:bigint")
    if hot:
        # a large node is a vertex itself
        near = near.unionByName(_hot(classes, large))
    return near


def _hot(classes: DataFrame, large: list[np.ndarray]) -> DataFrame:
    """Edges (u, v) that span, batch by batch, the classes and the large nodes of the last level that they are in; a node's name is below all classes'."""
    shared = classes.sparkSession.sparkContext.broadcast(large)

    def pick(batches):
        for b in batches:
            *_, (row, node) = _paths(_bytes(b.column("marks"), MARKS), shared.value[:-1])
            hit = in_sieve(shared.value[-1], node)
            k = b.column("k").to_numpy()[row[hit]]
            names, at = np.unique(np.concatenate([k, -1 - (node[hit] >> np.uint64(1)).astype(np.int64)]), return_inverse=True)
            u, v = spanning(len(names), at[: len(k)], at[len(k) :])
            if len(u):
                yield _edges(names[u], names[v])

    return classes.select("k", "marks").transform(arrow, pick, "u:bigint,v:bigint")


def _times(classes: DataFrame, large: list[np.ndarray]) -> DataFrame:
    """k, times of the classes in large nodes of the last level: in how many."""
    shared = classes.sparkSession.sparkContext.broadcast(large)

    def count(batches):
        for b in batches:
            *_, (row, node) = _paths(_bytes(b.column("marks"), MARKS), shared.value[:-1])
            row, n = np.unique(row[in_sieve(shared.value[-1], node)], return_counts=True)
            yield pa.RecordBatch.from_arrays([b.column("k").take(pa.array(row)), pa.array(n.astype(np.int64))], names=["k", "times"])

    return classes.select("k", "marks").transform(arrow, count, "k:bigint,times:bigint")


def _weight() -> Column:
    return F.lit(1) + F.expr(f"n_shingles div {HEAVY}")


def _overlaps(values: np.ndarray, bounds: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets of rows a with those of rows b, by matrix products over slabs of shingles."""
    distinct, at = np.unique(values, return_inverse=True)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.argsort(at, kind="stable")
    at, row = at[order], row[order]
    out = np.zeros((len(a), len(b)), np.float32)
    for first in range(0, len(distinct), SLAB):
        s = slice(*np.searchsorted(at, [first, first + SLAB]))
        x = np.zeros((len(bounds) - 1, min(SLAB, len(distinct) - first)), np.float32)
        x[row[s], at[s] - first] = 1
        out += x[a] @ x[b].T
    return out


def _confirmed(blocks: DataFrame, width: int) -> DataFrame:
    """Edges that span the links of each block (node) between its rows marked a and b, every pair decided on full sets."""

    def confirm(batches):
        for t in _runs(batches, ["node", "k", "text", "a", "b"]):
            node = t.column("node").to_numpy()
            cuts = [0, *(np.flatnonzero(node[1:] != node[:-1]) + 1).tolist(), len(node)]
            for x, y in zip(cuts, cuts[1:], strict=False):
                part = t.slice(x, y - x).combine_chunks()
                k = part.column("k").to_numpy()
                text = part.column("text")
                values, bounds = shingle_sets(*utf8(text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text), width)
                a, b = (np.flatnonzero(np.array(part.column(c).to_pylist(), bool)) for c in ("a", "b"))
                n = np.diff(bounds).astype(np.float64)
                both = _overlaps(values, bounds, a, b).astype(np.float64)
                i, j = np.nonzero(100 * both >= 80 * (n[a][:, None] + n[b][None, :] - both))
                u, v = spanning(len(k), a[i], b[j])
                if len(u):
                    yield _edges(k[u], k[v])

    return blocks.select("node", "k", "text", "a", "b").repartition("node").sortWithinPartitions("node").transform(arrow, confirm, "u:bigint,v:bigint").where("u <> v")


def _texts(base: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (k, h, key, ...) with each one's text; only rows of ``base`` that a sieve of the keys lets through are shuffled."""
    of = sieve(wanted.select("h"), wanted.count())
    h = F.xxhash64("id", "key")
    rows = base.where("text is not null").select("text", "key", h.alias("h")).where(of(h)).dropDuplicates(["h", "key"])
    return rows.join(wanted, ["h", "key"])


def _dealt(rows: DataFrame, blocks: Column, *columns: str) -> DataFrame:
    """``rows`` (family, k, columns), each once for every one of ``blocks``, an array of (i, j, a, b)."""
    return rows.select("family", "k", *columns, F.explode(blocks).alias("x")).select(F.xxhash64("family", "x.i", "x.j").alias("node"), "k", *columns, "x.a", "x.b")


def _block(i: Column, j: Column, a: Column, b: Column) -> Column:
    return F.struct(i.cast("bigint").alias("i"), j.cast("bigint").alias("j"), a.alias("a"), b.alias("b"))


def _first(texts: DataFrame) -> DataFrame:
    """Blocks of all families: a small one is a block; a large one's rows (a) meet its leader (b), of which every block gets a copy."""
    yes, no, zero = F.lit(True), F.lit(False), F.lit(0)
    own, is_lead = F.pmod(F.xxhash64("k"), F.col("nb")), F.col("k") == F.col("lead")
    others = F.filter(F.sequence(zero.cast("bigint"), F.col("nb") - 1), lambda i: i != own)
    mine = F.array(_block(own, zero, yes, is_lead))
    heads = F.concat(mine, F.transform(others, lambda i: _block(i, zero, no, yes)))
    return _dealt(texts, F.when(F.col("nb").isNull(), F.array(_block(zero, zero, yes, yes))).when(is_lead, heads).otherwise(mine), "text")


def _second(rows: DataFrame, first: int, most: int, *columns: str) -> DataFrame:
    """Blocks of large families with rows that aren't linked with the leader: all rows (a), dealt to nb, against those (b), dealt to rb, of which a pass takes ``most`` from ``first`` on."""
    yes, no = F.lit(True), F.lit(False)
    start, end = F.lit(first).cast("bigint"), F.least(F.lit(first + most).cast("bigint"), "rb") - 1
    count = F.sequence(F.lit(0).cast("bigint"), F.col("nb") - 1)
    every = F.transform(F.sequence(start, end), lambda j: _block(F.pmod(F.xxhash64("k"), F.col("nb")), j, yes, no))
    mine = F.pmod(F.xxhash64("k", F.lit(1)), F.col("rb"))
    few = F.transform(count, lambda i: _block(i, mine, no, yes))
    one = (F.col("nb") == 1) & (F.col("rb") == 1)
    blocks = F.when(one, F.array(_block(start, start, yes, F.col("is_rest")))).when(F.col("is_rest") & mine.between(start, end), F.concat(every, few)).otherwise(every)
    return _dealt(rows.where(F.col("rb") > first), blocks, *columns)


def _met(blocks: DataFrame) -> DataFrame:
    """Edges that span the pairs of each block (node) between its rows marked a and b that sizes and sketches allow."""

    def meet(batches):
        for t in _runs(batches, ["node", "k", "n_shingles", "sketch", "a", "b"]):
            node = t.column("node").to_numpy()
            cuts = [0, *(np.flatnonzero(node[1:] != node[:-1]) + 1).tolist(), len(node)]
            for x, y in zip(cuts, cuts[1:], strict=False):
                part = t.slice(x, y - x)
                k, n = (part.column(c).to_numpy() for c in ("k", "n_shingles"))
                sketch = np.ascontiguousarray(_bytes(part.column("sketch"), SKETCH // 4)).view(np.uint64)
                a, b = (np.flatnonzero(np.array(part.column(c).to_pylist(), bool)) for c in ("a", "b"))
                found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
                for rows in np.array_split(a, max(1, len(a) >> 6)):
                    i, j = np.nonzero(_sizes_allow(n[rows][:, None], n[b][None, :]) & _alike(sketch[rows][:, None], sketch[b][None, :], WIDE_LEAST))
                    found.append(spanning(len(k), rows[i], b[j]))
                u, v = spanning(len(k), *(np.concatenate(z) for z in zip(*found, strict=True)))
                if len(u):
                    yield _edges(k[u], k[v])

    return blocks.repartition("node").sortWithinPartitions("node").transform(arrow, meet, "u:bigint,v:bigint").where("u <> v")


def _with_blocks(rows: DataFrame, weight: Column, size: int) -> DataFrame:
    """``rows`` (family, k, is_rest, ...) of families that have a rest, with nb and rb: blocks of all the family's rows and of its rest."""
    blocks = lambda x: F.ceil(F.sum(x) / F.lit(size))
    of = rows.groupBy("family").agg(blocks(weight).alias("nb"), blocks(F.when(F.col("is_rest"), weight)).alias("rb")).where("rb > 0")
    return salted_join(rows, of, "family", F.col("k"))


def _passes(rows: DataFrame, most: int, columns: tuple[str, ...], decide: Callable[[DataFrame], DataFrame], name: str) -> DataFrame | None:
    """Edges that ``decide`` finds in the blocks of ``rows`` (family, k, is_rest, nb, rb, columns), pass by pass."""
    out = None
    for first in range(0, rows.agg(F.max("rb")).first()[0] or 0, most):
        edges = stored(decide(_second(rows, first, most, *columns)), name)
        out = edges if out is None else out.unionByName(edges)
    return out


def _links(base: DataFrame, classes: DataFrame, families: DataFrame, hot: DataFrame | None, width: int) -> DataFrame:
    """Edges that span the links between classes, decided on full sets family by family."""
    wanted = classes.select("k", "h", "key", "n_shingles").join(families, "k")
    wanted = wanted.withColumn("times", F.lit(0).cast("bigint")) if hot is None else wanted.join(hot, "k", "left")
    wanted = stored(wanted, "wanted")
    blocks = F.ceil(F.col("weight") / F.lit(BLOCK)).alias("nb")
    of = wanted.groupBy("family").agg(F.sum(_weight()).alias("weight"), F.max_by("k", F.struct(F.coalesce("times", F.lit(0)).alias("r"), F.col("k").alias("x"))).alias("lead"))
    big_of = stored(of.where(F.col("weight") > BLOCK).select("family", "lead", blocks), "big")
    some_big = not big_of.isEmpty()
    light = wanted.select("k", "h", "key", "family", "n_shingles")
    light = salted_join(light, big_of, "family", F.col("k"), "left") if some_big else light.withColumns({"lead": F.lit(None).cast("bigint"), "nb": F.lit(None).cast("bigint")})
    light = stored(light, "marked")
    texts = stored(_texts(base, light).select("k", "family", "n_shingles", "lead", "nb", "text"), "texts")
    links = stored(_confirmed(_first(texts), width), "links")
    done = [wanted, big_of, light, texts]
    if some_big:
        reached = links.select(F.explode(F.array("u", "v")).alias("k")).distinct().withColumn("is_reached", F.lit(True))
        rest = F.col("is_reached").isNull() & (F.col("k") != F.col("lead"))
        sketch = classes.select("k", F.substring("marks", MARKS - SKETCH // 4 + 1, SKETCH // 4).alias("sketch"))
        tested = light.where("nb is not null").select("k", "family", "lead", "n_shingles").join(sketch, "k").join(reached, "k", "left")
        tested = tested.select("k", "family", "n_shingles", "sketch", rest.alias("is_rest"))
        tested = stored(_with_blocks(tested, F.lit(1), WIDE), "tested")
        near = _passes(tested, WIDE_PASS, ("n_shingles", "sketch"), _met, "near")
        done.append(tested)
        if near is not None:
            parts = components(near).select(F.col("node").alias("k"), F.col("component").alias("family"))
            parts = stored(tested.select("k", "n_shingles", "is_rest").join(parts, "k"), "parts")
            second = texts.where("nb is not null").select("k", "text").join(_with_blocks(parts, _weight(), BLOCK).drop("n_shingles"), "k")
            second = stored(second, "second")
            more = _passes(second, PASS, ("text",), lambda x: _confirmed(x, width), "links")
            links = links if more is None else links.unionByName(more)
            done += [near, parts, second]
    for x in done:
        drop_stored(x)
    return links


def _membership(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """id, key (the text's hash), n_shingles, component (null without words) and component_id of every row."""
    bounded_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("key", F.xxhash64("text"))
    seen = stored(_described(base, "text", width), "sets")
    some = seen.where("n_shingles > 0")
    classes = some.groupBy("cls").agg(F.min(F.struct("id", "key")).alias("one"), F.min("id").alias("id"), F.any_value("n_shingles").alias("n_shingles"), F.any_value("marks").alias("marks"))
    classes = classes.select("cls", "id", F.xxhash64("one.id", "one.key").alias("h"), "one.key", "n_shingles", "marks", F.monotonically_increasing_id().alias("k"))
    classes = stored(classes, "classes")
    leaf, large, hot = _trees(classes)
    # stored, or its tasks would hold a worker that compares and another that contracts
    near = stored(_candidates(classes, leaf, large, hot), "near")
    families = components(near).where("node >= 0").select(F.col("node").alias("k"), F.col("component").alias("family"))
    drop_stored(near)
    times = _times(classes, large) if hot else None
    links = _links(base, classes, families, times, width)
    final = components(links).withColumnRenamed("node", "k")
    own = classes.select("cls", "k", "id")
    least = final.join(own.select("k", "id"), "k").groupBy("component").agg(F.min("id").alias("component_id"))
    named = salted_join(final, least, "component", F.col("k"))
    by_class = own.join(named, "k", "left").select("cls", F.coalesce("component", "k").alias("component"), F.coalesce("component_id", "id").alias("component_id"))
    by_class = stored(by_class, "members")
    members = seen.select("id", "key", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("cls")).alias("cls"))
    copies = F.xxhash64("id", "key")
    out = salted_join(members, by_class, "cls", copies, "left")
    drop_stored(classes)
    return out.select("id", "key", "n_shingles", "component", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def linked(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 2) -> DataFrame:
    """``docs``' ids with n_shingles, component_id and kept."""
    out = _membership(docs, id_col, text_col, width)
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """``docs`` with one row of each component (of least id, then text hash), and every row without words.

    Only rows that a sieve of those to go, or that are repeated whole, lets through are shuffled with their texts.
    """
    members = stored(_membership(docs, id_col, text_col, width).select("id", "key", "component", F.xxhash64("id", "key").alias("h")), "members")
    with_words = members.where("component is not null")
    chosen = with_words.groupBy("component").agg(F.min(F.struct("id", "key", "h")).alias("c")).select(F.col("c.h").alias("h"), F.col("c.key").alias("key"), F.lit(True).alias("pick"))
    marked = with_words.groupBy("h", "key").agg(F.count("*").alias("n")).join(chosen, ["h", "key"], "left")
    odd = stored(marked.where("pick is null or n > 1").select("h", "key", F.col("pick").isNotNull().alias("pick")), "odd")
    own, key = fresh(docs, "row_hash", "text_key")
    text_key = F.xxhash64(F.col(text_col).cast("string"))
    h = F.xxhash64(F.col(id_col), text_key)
    may_be_odd = sieve(odd.select("h"), odd.count())(h)
    rows = docs.withColumns({own: h, key: text_key})
    doubtful = rows.where(may_be_odd).join(odd.select(F.col("h").alias("odd_h"), F.col("key").alias("odd_key"), "pick"), (rows[own] == F.col("odd_h")) & (rows[key] == F.col("odd_key")), "left")
    back = [rows[c] for c in docs.columns]
    fine = doubtful.where("odd_h is null").select(back)
    again = doubtful.where("pick").select(*back, rows[own], rows[key]).dropDuplicates([own, key]).select(docs.columns)
    return docs.where(~may_be_odd).unionByName(fine).unionByName(again)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(read(spark, sf_dir, "documents").select("doc_id", "text"), width=2)


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 1 THEN w ELSE list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]) END) AS sh FROM d WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT u, v FROM i JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * k >= 80 * (x.n + y.n - k)),
ev AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, ev.v FROM r JOIN ev ON ev.u = r.other),
c AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""
