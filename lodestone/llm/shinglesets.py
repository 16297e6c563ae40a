"""Sets of word shingles, and the groups that a Jaccard similarity connects.

The incidence of sets and shingles is multiplied with its transpose in blocks, and only
where an entry can reach the similarity:

1. Columns. Two sets of at least this similarity share `least_shared` of the first columns
   of the smaller in any fixed order (rare ones come first here), as many as its size leaves
   open and EXTRA of it more. Only columns that recur among these are multiplied, and only of
   rows that have enough of them to link with anything.
2. Bounds. In a block, entries are met diagonal by diagonal over rows sorted by size. They
   are discarded where the sizes differ too much, where the parities of the rows' columns
   show that the sets do, or where other bits, a short image of each set, differ in more places
   than the caller's `Bounds` allow for these sizes.
3. Counts. Overlaps of the entries that remain are accumulated over all columns of the two
   sets, a row of the block at a time, so no false link is made.

First, blocks give entries that span what they connect, never all pairs of a group; a block
holds the rows of some columns, each once. What true entries connect is a node from then on,
and a second pass gives all entries between unequal nodes. There, rows of a column's largest
node meet only the rows of other nodes, so a large group that is connected costs little.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import anchors
from lodestone.llm.arrowtools import bounded_batches, map_texts, stored
from lodestone.llm.components import components

NO_ID = -(1 << 63)
#: Pairs compared at once; what rounding may add to a bound.
SLAB, SLACK = 1 << 14, 1e-9
#: Share of a set's size by which its first columns are more than one shared column needs.
EXTRA = 0.06
#: Ids that are broadcast at most; bytes of tokens packed at once; tokens a cell.
FEW_IDS, PACK_BYTES, CELL_TOKENS = 500_000, 4 << 20, 1 << 16
#: Pairs held before those that span them are chosen; rows of a column that are compared one by one with all others.
HELD, LARGE = 1 << 18, 64
#: Bytes of the texts whose sets are multiplied at once.
SLAB_BYTES = 4 << 20
#: Least values of a set that travel with its rows, to tell which of the values that two sets share comes first.
FIRST = 16


#: Words of 64 bits in a set's parities.
PARITY_WORDS = 8


def parities(hashes: np.ndarray) -> bytes:
    """For each class of columns, whether the set has an odd number of them. Two sets differ in
    one shingle at least for each class whose parities differ."""
    count = np.bincount((hashes >> np.uint64(20)).astype(np.int64) % (64 * PARITY_WORDS), minlength=64 * PARITY_WORDS)
    return np.packbits((count & 1).astype(np.uint8), bitorder="little").tobytes()


def most_different(similarity: float) -> Callable:
    """(sizes, sizes) -> how many shingles two sets of this similarity have that only one of them has."""
    share = (1 - similarity) / (1 + similarity)
    return lambda a, b: share * (a.astype(np.int64) + b) + SLACK


class Bounds(NamedTuple):
    """What two sets' bits may differ by: `image` makes the bits of a set's hashes, `most`
    (sizes, sizes) gives the greatest difference that is looked at, and `close` the one that
    is taken for a link before it is counted. The first of the `words` words of 64 bits are the
    set's parities, which `most_different` bounds; `most` and `close` are about the others, or
    about the parities where there are no others."""

    words: int
    image: Callable
    most: Callable
    close: Callable

    def apart(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Differing parities, and differing bits that `most` is about, of rows of bits."""
        differ = np.bitwise_count(x ^ y)
        odd = differ[:, :PARITY_WORDS].sum(axis=1, dtype=np.int64)
        return odd, differ[:, PARITY_WORDS:].sum(axis=1, dtype=np.int64) if self.words > PARITY_WORDS else odd


class Sets:
    """Disjoint sets over 0..n-1, united many pairs at a time; a set's root is its least member."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def root(self, x):
        while True:
            up = self.parent[x]
            if (up == self.parent[up]).all():
                return up
            self.parent[x] = self.parent[up]

    def unite(self, x, y):
        while len(x):
            rx, ry = self.root(x), self.root(y)
            differ = rx != ry
            x, y, rx, ry = x[differ], y[differ], rx[differ], ry[differ]
            np.minimum.at(self.parent, np.maximum(rx, ry), np.minimum(rx, ry))

    def star(self) -> tuple[np.ndarray, np.ndarray]:
        """(members other than roots, their roots)."""
        every = np.arange(len(self.parent))
        top = self.root(every)
        member = np.flatnonzero(top != every)
        return member, top[member]


def words_of(text: str | None) -> bytes:
    """A text's lower-cased words, joined by single spaces."""
    return b" ".join((text or "").encode().lower().split())


def shingles(text: str | None, width: int) -> np.ndarray:
    """The distinct 64-bit hashes of the shingles of `width` words, in order; none without words."""
    return shingles_of(words_of(text), width)


def shingles_of(words: bytes, width: int) -> np.ndarray:
    if not words:
        return np.empty(0, np.uint64)
    data = np.frombuffer(words, np.uint8)
    stops = np.append(np.flatnonzero(data == 32), len(data)) + 1
    starts = np.concatenate([[0], stops[:-1]])
    n = max(1, len(stops) - width + 1)
    prefix_hash = anchors.Prefix(data).hash
    return np.unique(anchors.mix(prefix_hash(starts[:n], stops[-n:] - 1)))


def set_key(hashes: np.ndarray) -> int:
    """Names a set of shingles, as a signed integer."""
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True)


def least_shared(size: int) -> int:
    """How many of the first columns of two linked sets are shared, for the smaller's size."""
    return 1 + int(EXTRA * size)


def prefix(hashes: np.ndarray, common: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The first hashes of a set in the order (count among the common, hash): so many that
    two sets of at least this Jaccard similarity share `least_shared` of them or more."""
    n = len(hashes)
    if not n:
        return hashes
    listed, count = common
    rank = np.zeros(n, np.int64)
    if len(listed):
        at = np.minimum(np.searchsorted(listed, hashes), len(listed) - 1)
        rank = np.where(listed[at] == hashes, count[at], 0)
    return hashes[np.argsort(rank, kind="stable")[: n - int(np.ceil(similarity * n - SLACK)) + least_shared(n)]]


def candidates(value, node, size, bits, side, similarity: float, bounds: Bounds, forest: bool):
    """x, y: pairs of rows of equal `value` (of unequal `side` where it is given) and unequal
    `node` whose sets can have this similarity by their sizes and fingerprints.

    Rows of a value are sorted by size and compared with those behind them, many at once, by
    exclusive-or and bit counts. With `forest`, only pairs that span what all pairs connect:
    the close ones as they are met, then the nearest of each tree, HELD at a time.
    """
    order = np.lexsort((node, size, value))
    value, node, size, bits = value[order], node[order], size[order], bits[order]
    side = None if side is None else side[order]
    sets, out, differ = Sets(int(node.max(initial=-1)) + 1), [], most_different(similarity)
    heads = np.flatnonzero(np.append(True, value[1:] != value[:-1])[: len(value)])
    group = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(value))))

    def scan(only, take):
        """Offers the pairs that fit, of unequal side, by their distance in the order."""
        live, d = np.arange(len(value)) if only is None else np.flatnonzero(only), 1
        while len(live):
            live = live[live + d < len(value)]
            live = live[(value[live] == value[live + d]) & (size[live] >= similarity * size[live + d] - SLACK)]
            if d % 64 == 0 and len(live):  # values whose sets are all connected are done
                top = sets.root(node)
                done = np.minimum.reduceat(top, heads) == np.maximum.reduceat(top, heads)
                live = live[~done[group[live]]]
            pick = live if side is None else live[side[live] != side[live + d]]
            pick = pick[sets.root(node[pick]) != sets.root(node[pick + d])]
            for i in range(0, len(pick), SLAB):
                x = pick[i : i + SLAB]
                odd, far = bounds.apart(bits[x], bits[x + d])
                fits = (odd <= differ(size[x], size[x + d])) & (far <= bounds.most(size[x], size[x + d]))
                take(x[fits], x[fits] + d, far[fits])
            d += 1

    def spanned():
        """Of the pairs held those that span what they connect, the nearest first; others go."""
        x, y, far = (np.concatenate(c) for c in zip(*out, strict=True))
        out.clear()
        best = np.argsort(far, kind="stable")
        while len(best):
            a, b = sets.root(node[x[best]]), sets.root(node[y[best]])
            best, a, b = best[a != b], a[a != b], b[a != b]
            first = np.unique(np.concatenate([np.unique(c, return_index=True)[1] for c in (a, b)]))
            chosen.append((x[best[first]], y[best[first]]))
            sets.unite(a[first], b[first])

    chosen: list = []

    def found(x, y, far):
        if not forest:
            chosen.append((x, y))
            return
        close = far <= bounds.close(size[x], size[y])
        chosen.append((x[close], y[close]))
        sets.unite(node[x[close]], node[y[close]])
        out.append((x[~close], y[~close], far[~close]))
        if sum(len(c[0]) for c in out) > HELD:
            spanned()

    if side is not None:
        long = np.diff(np.append(heads, len(value))) > LARGE
        for at in np.flatnonzero(long).tolist():
            rows = np.arange(heads[at], heads[at + 1] if at + 1 < len(heads) else len(value))
            one, two = rows[side[rows] == side[rows[0]]], rows[side[rows] != side[rows[0]]]
            few, many = sorted((one, two), key=len)
            for x in few.tolist():
                y = many[(node[many] != node[x]) & (np.minimum(size[many], size[x]) >= similarity * np.maximum(size[many], size[x]) - SLACK)]
                odd, far = bounds.apart(bits[y], bits[x])
                own = np.full(len(y), size[x])
                fits = (odd <= differ(own, size[y])) & (far <= bounds.most(own, size[y]))
                chosen.append((np.full(np.count_nonzero(fits), x), y[fits]))
        short = ~long[group]
    else:
        short = None
    scan(short, found)
    if out:
        spanned()
    x, y = (np.concatenate(c) for c in zip(*chosen, strict=True)) if chosen else (np.empty(0, np.int64),) * 2
    return order[x], order[y]


def common_shingles(docs: DataFrame, width: int, documents: int = 8192, most: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that recur in a sample of the documents, in order, and how often they do.

    They only order the shingles of a set; any choice gives the same result."""
    share = max(1, docs.count() // documents)

    def make():
        return lambda texts: {"h": pa.array(np.concatenate([np.empty(0, np.uint64), *(shingles(t, width) for t in texts)]).view(np.int64))}

    sample = map_texts(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0), ["text"], "h long", make)
    rows = sample.groupBy("h").count().where("count > 1").orderBy(F.desc("count"), "h").limit(most).collect()
    listed, count = np.array([r.h for r in rows], np.int64).view(np.uint64), np.array([r["count"] for r in rows], np.int64)
    order = np.argsort(listed)
    return listed[order], count[order]


def recurring(classes: DataFrame) -> DataFrame:
    """value, k: the prefix shingles that more than one set has, with each set that has them.

    Tokens travel packed, a row for each batch and cell of values. A batch sends one token of
    a value to the value's cell and those it sees again, which are known to recur, anywhere;
    so a value that a third of all sets have does not fill its cell.
    """
    total = classes.agg(F.sum(F.length("prefix"))).first()[0] or 0
    cells = max(1, total // 8 // CELL_TOKENS)

    def pack(batches):
        for batch in batches:
            sizes = np.array([len(p) // 8 for p in batch.column(1).to_pylist()], np.int64)
            for rows in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(np.cumsum(sizes) * 8 // PACK_BYTES)) + 1):
                if not len(rows):
                    continue
                part = batch.slice(int(rows[0]), len(rows))
                value = np.frombuffer(b"".join(part.column(1).to_pylist()), "<u8")
                k = np.repeat(part.column(0).to_numpy(), sizes[rows])
                order = np.argsort(value, kind="stable")
                value, k = value[order], k[order]
                same = value[1:] == value[:-1] if len(value) else np.empty(0, bool)
                again, first = np.append(False, same)[: len(value)], np.append(same, False)[: len(value)] & ~np.append(False, same)[: len(value)]
                known = (again | first).astype(np.uint8)
                spread = np.where(again, anchors.mix(k.view(np.uint64)), anchors.mix(value))
                cell = ((spread >> np.uint64(32)) * np.uint64(cells) >> np.uint64(32)).astype(np.int64)
                by = np.argsort(cell, kind="stable")
                cuts = np.searchsorted(cell[by], np.arange(cells + 1)) if cells <= len(value) else np.append(np.flatnonzero(np.append(True, np.diff(cell[by]) != 0)[: len(by)]), len(by))
                out = [(int(cell[by[a]]), int(b - a), np.ascontiguousarray(value[by[a:b]]).tobytes() + k[by[a:b]].tobytes() + known[by[a:b]].tobytes()) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True) if b > a]
                c, n, blob = zip(*out, strict=True) if out else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(n, pa.int32()), pa.array(blob, pa.binary())], names=["cell", "n", "blob"])

    def find(rows: pa.Table) -> pa.Table:
        got = list(zip(rows.column("n").to_pylist(), rows.column("blob").to_pylist(), strict=True))
        value, k, known = (np.concatenate([np.frombuffer(blob, t, n, at * n) for n, blob in got]) for t, at in (("<u8", 0), ("<i8", 8), ("u1", 16)))
        order = np.argsort(value, kind="stable")
        value, k, known = value[order], k[order], known[order].astype(bool)
        same = value[1:] == value[:-1]
        kept = known | np.append(False, same) | np.append(same, False)
        # A token that is known to recur stands for its value; others of the value are here or known.
        return pa.table({"value": value[kept].view(np.int64), "k": k[kept]})

    return classes.select("k", "prefix").mapInArrow(pack, "cell long, n int, blob binary").groupBy("cell").applyInArrow(find, "value long, k long")


def tokens_of(classes: DataFrame, similarity: float) -> DataFrame:
    """value, k, size: the recurring prefix shingles of the sets that have enough of them."""
    tokens = stored(recurring(classes))
    enough = F.col("n") >= 1 + F.floor(F.lit(EXTRA * similarity) * F.col("size") - SLACK)
    rich = tokens.groupBy("k").agg(F.count(F.lit(1)).alias("n")).join(classes.select("k", "size"), "k").where(enough).select("k", "size")
    return stored(tokens.join(rich, "k"))


def _celled(tokens: DataFrame, tile: int) -> DataFrame:
    """Tokens with their cell. Mean cells stay well below a tile, so that only common shingles are dealt in tiles."""
    lead = int(max(0, np.ceil(np.log2(max(1, tokens.count()) * 4 / tile))))
    return tokens.withColumn("cell", F.xxhash64("value").bitwiseAND(F.lit((1 << lead) - 1)))


def first_shared(a: np.ndarray, b: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Whether a pair is to be named where it meets at `value`: at the least of the values that
    both rows' lists of their first values have, or at each value if the lists have none in common."""
    out = np.empty(len(value), bool)
    most = np.iinfo(a.dtype).max
    for i in range(0, len(value), SLAB):
        at = slice(i, i + SLAB)
        same = (a[at, :, None] == b[at, None, :]).any(axis=2)
        least = np.where(same, a[at], most).min(axis=1)
        out[at] = ~same.any(axis=1) | (least == value[at])
    return out


def _compared(similarity: float, bounds: Bounds, forest: bool):
    def compare(key, group):
        kind, i, j = (k.as_py() for k in key[1:])
        k = group.column("k").to_numpy()
        bits = np.frombuffer(b"".join(group.column("bits").to_pylist()), "<u8").reshape(-1, bounds.words)
        node = np.unique(group.column("node").to_numpy(), return_inverse=True)[1]
        side = None if forest or (kind and i == j) else group.column("own").to_numpy() if kind else group.column("minor").to_numpy(zero_copy_only=False)
        value = group.column("value").to_numpy()
        x, y = candidates(value, node, group.column("size").to_numpy(), bits, side, similarity, bounds, forest)
        # Two rows meet at each value that they share, in many tiles, and are a pair once.
        if "first" in group.column_names:
            first = pa.concat_arrays(group.column("first").chunks).flatten().to_numpy().reshape(-1, FIRST)
            kept = np.concatenate([np.empty(0, bool), *(first_shared(first[x[i : i + SLAB]], first[y[i : i + SLAB]], value[x[i : i + SLAB]]) for i in range(0, len(x), SLAB))])
            x, y = x[kept], y[kept]
        u, v = np.minimum(k[x], k[y]), np.maximum(k[x], k[y])
        order = np.lexsort((v, u))
        u, v = u[order], v[order]
        first = np.append(True, (u[1:] != u[:-1]) | (v[1:] != v[:-1]))[: len(u)]
        return pa.table({"u": u[first], "v": v[first]})

    return compare


def spanning_pairs(tokens: DataFrame, classes: DataFrame, similarity: float, tile: int, bounds: Bounds) -> DataFrame:
    """u, v (keys): pairs that span what the candidate pairs within each tile connect. A common
    shingle's rows are split among tiles; other shingles split them in other ways."""
    rows = _celled(tokens, tile)
    sizes = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles")).where("tiles > 1")
    own = F.pmod(F.xxhash64("k", "cell"), F.coalesce("tiles", F.lit(1))).cast("int")
    dealt = rows.join(classes.select("k", "bits"), "k").join(sizes, "cell", "left").select("cell", F.lit(0).alias("kind"), own.alias("i"), F.lit(0).alias("j"), "value", "k", "size", "bits", F.col("k").alias("node"))
    return dealt.groupBy("cell", "kind", "i", "j").applyInArrow(_compared(similarity, bounds, True), "u long, v long").distinct()


def pairs_between(tokens: DataFrame, nodes: DataFrame, classes: DataFrame, similarity: float, tile: int, bounds: Bounds) -> DataFrame:
    """u, v (keys): all candidate pairs of sets of unequal nodes (u, node), each once.

    Sets just below the similarity meet at hundreds of values, each in a tile of its own; so rows
    carry the first of their values, and a pair leaves the tile of the first that is shared."""
    rows = tokens.join(nodes.withColumnRenamed("u", "k"), "k", "left").withColumn("node", F.coalesce("node", "k"))
    counts = rows.groupBy("value", "node").agg(F.count(F.lit(1)).alias("n"))
    most = counts.groupBy("value").agg(F.max_by("node", F.struct("n", "node")).alias("major"), F.count(F.lit(1)).alias("nodes")).where("nodes > 1").select("value", "major")
    rows = stored(rows.join(most, "value").select("value", "k", "size", "node", (F.col("node") != F.col("major")).alias("minor")))
    rows = _celled(rows, tile)
    share = lambda minor: F.ceil(F.count(F.when(F.col("minor") == minor, 1)) / tile).cast("int")
    sizes = rows.groupBy("cell").agg(share(False).alias("majors"), share(True).alias("minors"))
    own = F.array_sort(F.collect_list("value"))
    first = rows.groupBy("k").agg(F.slice(F.concat(own, F.array_repeat(F.element_at(own, 1), FIRST)), 1, FIRST).alias("first"))
    dealt = rows.join(sizes, "cell").join(classes.select("k", "bits").join(first, "k"), "k").withColumn("own", F.pmod(F.xxhash64("k"), F.when(F.col("minor"), F.col("minors")).otherwise(F.col("majors"))).cast("int"))
    columns = ["value", "k", "size", "bits", "node", "minor", "own", "first"]
    place = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"))
    upto = lambda n, f: F.transform(F.sequence(F.lit(0), F.col(n) - 1), f)
    across = F.when(F.col("minor"), upto("majors", lambda i: place(0, i, F.col("own")))).otherwise(upto("minors", lambda j: place(0, F.col("own"), j)))
    among = F.when(F.col("minor"), upto("minors", lambda x: place(1, F.least("own", x), F.greatest("own", x)))).otherwise(F.array().cast("array<struct<kind int, i int, j int>>"))
    dealt = dealt.withColumn("at", F.explode(F.concat(across, among))).select("cell", "at.*", *columns)
    return dealt.groupBy("cell", "kind", "i", "j").applyInArrow(_compared(similarity, bounds, False), "u long, v long").distinct()


def overlaps(rows: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Entries (x, y) of the product of the rows' incidence with its transpose: how many
    columns row x and row y have in common. Rows hold distinct columns."""
    column = np.unique(np.concatenate(rows), return_inverse=True)[1] if rows else np.empty(0, np.int64)
    start = np.append(0, np.cumsum([len(r) for r in rows]))
    mark, out = np.zeros(int(column.max(initial=-1)) + 1, bool), np.zeros(len(x), np.int64)
    order = np.argsort(x, kind="stable")
    cuts = np.flatnonzero(np.append(True, np.diff(x[order]) != 0)[: len(x)])
    for entries in np.split(order, cuts[1:]) if len(order) else []:
        at = int(x[entries[0]])
        own = column[start[at] : start[at + 1]]
        mark[own] = True
        for e in entries.tolist():
            out[e] = np.count_nonzero(mark[column[start[y[e]] : start[y[e] + 1]]])
        mark[own] = False
    return out


def verified(pairs: DataFrame, classes: DataFrame, ids: DataFrame, width: int, similarity: float) -> DataFrame:
    """`pairs` with a column `same`: whether the Jaccard similarity, counted over the two
    sets of shingles, is at least `similarity`. The words of a set come to the pairs that need
    them compressed, which is a quarter of its hashes; sets are made a slab of pairs at a time."""
    wanted = stored(pairs.select(F.explode(F.array("u", "v")).alias("k")).distinct().join(classes.select("k", F.col("id").alias("doc_id")), "k").select("doc_id").distinct())
    # A small list of ids is broadcast, up to a fixed size, so that only texts in question are read on.
    wanted = F.broadcast(wanted) if wanted.count() <= FEW_IDS else wanted

    def make():
        def f(doc_ids, texts):
            found, pack = [words_of(t) for t in texts], zstandard.ZstdCompressor(1).compress
            return {"k": pa.array([set_key(shingles_of(w, width)) for w in found], pa.int64()), "words": pa.array(map(pack, found), pa.binary())}

        return f

    sets = map_texts(ids.join(wanted, "doc_id", "left_semi"), ["doc_id", "text"], "k long, words binary", make).dropDuplicates(["k"])

    def judge(batches):
        pa.set_memory_pool(pa.system_memory_pool())
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            u, v = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            bytes_ = sum(np.array([zstandard.frame_content_size(x.as_py()) for x in batch.column(i)], np.int64) for i in (2, 3))
            same = []
            for part in np.split(np.arange(len(u)), np.flatnonzero(np.diff(np.cumsum(bytes_) // SLAB_BYTES)) + 1):
                if not len(part):
                    continue
                keys, first, at = np.unique(np.concatenate([u[part], v[part]]), return_index=True, return_inverse=True)
                rows = [shingles_of(unpack(batch.column(2 + int(f >= len(part)))[int(part[f % len(part)])].as_py()), width) for f in first]
                x, y = at[: len(part)], at[len(part) :]
                size = np.array([len(r) for r in rows])
                both = overlaps(rows, x, y)
                same.append(both >= similarity * (size[x] + size[y] - both) - SLACK)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(np.concatenate(same) if same else [], pa.bool_())], names=["u", "v", "same"])

    both = pairs.join(sets.select(F.col("k").alias("u"), F.col("words").alias("a")), "u")
    both = both.join(sets.select(F.col("k").alias("v"), F.col("words").alias("b")), "v").select("u", "v", "a", "b")
    return stored(both.mapInArrow(judge, "u long, v long, same boolean"))


def distinct_sets(docs: DataFrame, width: int, similarity: float, bounds: Bounds) -> DataFrame:
    """k, id, name, size, bits, prefix: each distinct set of shingles, with the least doc_id that
    has it and the least that is not NO_ID."""
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, width))

    def make():
        def f(doc_ids, texts):
            found = [shingles(t, width) for t in texts]
            return {"id": pa.array(doc_ids, pa.int64()), "k": pa.array(map(set_key, found), pa.int64()), "size": pa.array([len(h) for h in found], pa.int32()),
                    "bits": pa.array(map(bounds.image, found), pa.binary()), "prefix": pa.array([prefix(h, common.value, similarity).tobytes() for h in found], pa.binary())}

        return f

    found = map_texts(docs, ["doc_id", "text"], "id long, k long, size int, bits binary, prefix binary", make)
    # Rows of one key are alike in all but the id.
    return found.groupBy("k").agg(F.min("id").alias("id"), F.min(F.when(F.col("id") != NO_ID, F.col("id"))).alias("name"), F.first("size").alias("size"), F.first("bits").alias("bits"), F.first("prefix").alias("prefix"))


def connected(docs: DataFrame, bounds: Bounds, width: int, similarity: float, tile: int) -> DataFrame:
    """k, id, name, root: for each distinct set the least doc_id that has it, the least that is
    not null, and the least key of the sets connected to it by Jaccard similarities of
    `similarity` or more. As an id, null is NO_ID."""
    bounded_batches(docs.sparkSession)
    ids = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text")
    classes = stored(distinct_sets(ids, width, similarity, bounds))
    tokens = tokens_of(classes, similarity)
    first = stored(spanning_pairs(tokens, classes, similarity, tile, bounds))
    judged = verified(first, classes, ids, width, similarity)
    edges = judged.where("same").select("u", "v")
    nodes = stored(components(edges).select("u", F.col("root").alias("node")))
    rest = stored(pairs_between(tokens, nodes, classes, similarity, tile, bounds).join(first, ["u", "v"], "left_anti"))
    if not rest.isEmpty():
        edges = edges.unionByName(verified(rest, classes, ids, width, similarity).where("same").select("u", "v"))
    roots = components(edges).withColumnRenamed("u", "k")
    return classes.select("k", "id", "name").join(roots, "k", "left").select("k", "id", "name", F.coalesce("root", "k").alias("root"))
