"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are grouped first, so copies cost one row. Two fingerprints within the
radius agree in one of radius + 1 bit bands; the leading bits of each band name the
cells in which a fingerprint is compared, so no link is lost. A cell of more than
`tile` fingerprints is dealt out in tiles, and every pair of its tiles is a group of
its own. In a group, blocks sorted by population count are compared by exclusive-or
and bit count; block pairs whose counts differ by more than the radius are skipped.
A group emits a spanning star of each of its components, never all its pairs.

Null and empty texts have fingerprint zero and link like any other. Null doc_ids take
part but never name a component unless nothing else does. Repeated rows are copies.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import anchors
from lodestone.llm.arrowtools import map_texts, stored
from lodestone.llm.components import components
from lodestone.llm.shinglesets import NO_ID, PARITY_WORDS, Bounds, Sets, connected, parities, set_key, shingles

SEED = 42
BLOCK = 512
#: Words of 64 bits in a document's fingerprint where near copies are looked for.
WIDE = 4
#: Sets of fewer shingles are always verified: their bits are too few votes to trust.
SMALL = 32


def fingerprint(text: str | None, width: int = 3) -> int:
    """64-bit fingerprint over the shingles of `width` words, as a signed integer."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    stops = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.r_[0, stops[:-1] + 1]
    n = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), stops[-n:].tolist(), strict=True)], "<u8")
    total = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        bits = np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, bits (the fingerprint as a long) for every document."""

    def make():
        return lambda doc_ids, texts: {"doc_id": pa.array(doc_ids, pa.int64()), "bits": pa.array([fingerprint(t, width) for t in texts], pa.int64())}

    return map_texts(docs, ["doc_id", "text"], "doc_id long, bits long", make)


def tile_links(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning star (member, least member) of the links within `a`, or of those
    between `a` and `b` where `b` is given."""
    nodes = a if b is None else np.concatenate([a, b])
    side = np.zeros(len(nodes), bool)
    side[len(a) :] = True
    count = np.bitwise_count(nodes)
    order = np.argsort(count, kind="stable")
    nodes, count, side = nodes[order], count[order].astype(np.int64), side[order]
    sets = Sets(len(nodes))
    for i in range(0, len(nodes), BLOCK):
        rows = slice(i, i + BLOCK)
        for j in range(i, len(nodes), BLOCK):
            columns = slice(j, j + BLOCK)
            if count[j] - count[min(i + BLOCK, len(nodes)) - 1] > radius:
                break
            near = np.bitwise_count(nodes[rows, None] ^ nodes[None, columns]) <= radius
            if b is not None:
                near &= side[rows, None] != side[None, columns]
            x, y = np.nonzero(near)
            sets.unite(x + i, y + j)
    member, top = sets.star()
    return nodes[member], nodes[top]


def _cell(bits: Column, radius: int, lead: int) -> Column:
    """The cells of a fingerprint: band number and the leading `lead` bits of the band."""
    size = 64 // (radius + 1)
    mask = (1 << lead) - 1
    return F.array(*[F.lit(band << lead) + F.shiftrightunsigned(bits, band * size + size - lead).bitwiseAND(F.lit(mask)) for band in range(radius + 1)])


def links(distinct: DataFrame, n: int, radius: int, tile: int) -> DataFrame:
    """u, v: stars over the distinct fingerprints in column bits that lie within the radius."""
    size = 64 // (radius + 1)
    lead = int(min(size, max(0, np.ceil(np.log2(max(1, n) / tile)))))
    cells = distinct.select("bits", F.explode(_cell(F.col("bits"), radius, lead)).alias("cell"))
    sizes = cells.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
    # At most (radius + 1) * 2^16 rows whatever the input; one tile each as a rule.
    dealt = cells.join(F.broadcast(sizes), "cell").withColumn("own", F.pmod(F.xxhash64("bits"), F.col("tiles")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    pairs = dealt.select("cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "bits")

    def compare(key, rows):
        _, i, j = (k.as_py() for k in key)
        bits = rows.column("bits").to_numpy().view(np.uint64)
        own = rows.column("own").to_numpy()
        u, v = tile_links(bits, None, radius) if i == j else tile_links(bits[own == i], bits[own == j], radius)
        return pa.table({"u": pa.array(u.view(np.int64)), "v": pa.array(v.view(np.int64))})

    return pairs.groupBy("cell", "i", "j").applyInArrow(compare, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 3, tile: int = 4096) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for every document."""
    found = stored(fingerprints(docs, width))
    return found.join(named_groups(found, radius, tile), "bits").select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def named_groups(found: DataFrame, radius: int, tile: int) -> DataFrame:
    """bits, component_id: the distinct fingerprints of rows (doc_id, bits), each with the least
    doc_id of those that links within the radius connect it to."""
    classes = stored(found.groupBy("bits").agg(F.min("doc_id").alias("least")))
    roots = components(links(classes.select("bits"), classes.count(), radius, tile))
    rooted = classes.join(roots, classes.bits == roots.u, "left").select("bits", "least", F.coalesce("root", "bits").alias("root"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(names, "root").select("bits", "component_id")


def wide_fingerprint(hashes: np.ndarray) -> bytes:
    """A fingerprint of 64 * WIDE bits: a bit is 1 if set in over half the shingles' hashes."""
    total = np.zeros(64 * WIDE, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        part = hashes[i : i + (1 << 14)]
        more = np.stack([part, *(anchors.mix(part + np.uint64(j) * anchors._GOLD) for j in range(1, WIDE))], axis=1)
        total += np.unpackbits(more.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * total > len(hashes), bitorder="little").tobytes()


def wide_radius(similarity: float, deviations: float) -> int:
    """Differing bits of two wide fingerprints at this Jaccard similarity, that many standard
    deviations above the mean (equal sizes, where the mean is greatest)."""
    apart = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    return int(64 * WIDE * apart + deviations * np.sqrt(64 * WIDE * apart * (1 - apart)))


def similar(docs: DataFrame, width: int = 5, similarity: float = 0.8, tile: int = 16_384, radius: int | None = None, near: int | None = None) -> DataFrame:
    """id, root: for each distinct set of shingles its least doc_id, and the least doc_id
    of those connected to it by Jaccard similarities of `similarity` or more.

    Sets meet by shared shingles (`shinglesets`), and their wide fingerprints are compared in
    tiles, beside parities that rule out without loss; pairs within `radius` bits are verified
    on the sets themselves, so no false link is made. A pair is missed where its fingerprints differ by five standard deviations more than
    the mean at this similarity; sets of fewer than SMALL shingles are always verified, and
    radius = 64 * WIDE looks at every pair. Null doc_ids count as the smallest id.
    """
    found, names = _similar_sets(docs, width, similarity, tile, radius, near)
    return found.join(names, "root").groupBy("id").agg(F.min("least").alias("root"))


def _similar_sets(docs: DataFrame, width: int, similarity: float, tile: int, radius: int | None, near: int | None) -> tuple[DataFrame, DataFrame]:
    """The groups of `similar`: k, id, root (keys) of the distinct sets, and least, the least id of each root."""
    radius = wide_radius(similarity, 5.0) if radius is None else radius
    near = wide_radius(similarity, 0.0) if near is None else near
    image = lambda hashes: parities(hashes) + wide_fingerprint(hashes)
    bounds = Bounds(PARITY_WORDS + WIDE, image, lambda a, b: np.where(np.minimum(a, b) < SMALL, 64 * WIDE, radius), lambda a, b: near)
    found = stored(connected(docs, bounds, width, similarity, tile))
    return found, found.groupBy("root").agg(F.min("id").alias("least"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """One document of each group of `similar` documents, the one of the least doc_id.
    Rows that share a doc_id stay or go together; null and empty texts are one group."""
    keep = similar(docs, **options).where("id = root").select(F.col("id").alias("kept_id"))
    return docs.join(keep, F.coalesce("doc_id", F.lit(NO_ID)) == F.col("kept_id"), "left_semi")


def first_of_copies(docs: DataFrame, radius: int = 3, width: int = 5, similarity: float = 0.8, tile: int = 4096, set_tile: int = 16_384) -> DataFrame:
    """One document of each group of near copies, the one of the least doc_id.

    The groups are those of `near_duplicates`: the tiled comparison of all fingerprints, which
    loses no link within `radius` bits. Groups with texts that `similar` connects as well are
    one. Rows that share a doc_id stay or go together; null and empty texts are one group, and
    null doc_ids count as the smallest id.
    """
    ids = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text")

    def make():
        def f(doc_ids, texts):
            return {"doc_id": pa.array(doc_ids, pa.int64()), "bits": pa.array(map(fingerprint, texts), pa.int64()), "k": pa.array([set_key(shingles(t, width)) for t in texts], pa.int64())}

        return f

    # Copies are one row from here on.
    classes = stored(map_texts(ids, ["doc_id", "text"], "doc_id long, bits long, k long", make).groupBy("bits", "k").agg(F.min("doc_id").alias("doc_id")))
    found, names = _similar_sets(ids, width, similarity, set_tile, None, None)
    sets = found.join(names, "root").select("k", "least")
    # A group is named by its least doc_id, so the groups that a text lies in are an edge between documents.
    both = stored(classes.join(named_groups(classes, radius, tile), "bits").join(sets, "k").select(F.col("component_id").alias("u"), F.col("least").alias("v")).distinct())
    roots = components(both)
    keep = both.select("u").distinct().join(roots, "u", "left").select(F.coalesce("root", "u").alias("kept_id")).distinct()
    return docs.join(keep, F.coalesce("doc_id", F.lit(NO_ID)) == F.col("kept_id"), "left_semi")
