"""Near-duplicates: SimHash in pigeonhole blocks, shingle sets in blocks of minima, exact verification, connected components.

Two operators share the machinery:

* ``link_fingerprints``: 64-bit fingerprints of word shingles, linked when at most ``distance`` bits
  differ. The bits are cut into blocks; close pairs agree on a whole combination of blocks, so they
  meet in a bucket of that combination, where the Hamming distance is verified.
* ``near_duplicates``: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or
  more. Fingerprints of the sets are linked as above. At a similarity of 0.8 about 15% of SimHash bits
  differ, so blocks of bits long enough to tell texts apart lose pairs, most of all short ones; what the
  fingerprints leave apart is looked for in blocks of minima as well: the least hash of two sets is the
  same with a probability that is their similarity, whatever their length, so pairs meet as often as
  ``TABLES`` and ``BLOCK_ROWS`` say. Every candidate pair is verified, first by bounds that lose nothing
  and then by the exact similarity.

Defined results: a null text counts as empty; documents without words have fingerprint zero and are
linked to each other; a null ``doc_id`` is kept and never chosen as a smallest id if another exists;
repeated rows and ties get the same fingerprint; an empty table gives an empty result; further
columns are ignored (or, in ``keep_one``, passed through) whatever their names.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .graph import components

SEED = 42
#: Shingles hashed and unpacked at once, so that a very long text needs no more memory than this.
CHUNK = 1 << 15
#: Buckets of up to this many fingerprints are paired within; larger ones take the flipped-bit way.
PAIRED = 16


def shingles(raw: bytes | None, words: int):
    """Space-joined word shingles of a UTF-8 text, A-Z lower-cased; a shorter text is one shingle."""
    w = (raw or b"").lower().split()
    if len(w) <= words:
        return [b" ".join(w)] if w else []
    return map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False))


def shingle_hashes(raw: bytes | None, words: int) -> np.ndarray:
    """XXH64 of every shingle, repeats included."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(g, SEED) for g in shingles(raw, words)), dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The fingerprint: a bit is 1 if it is set in over half the hashes; 0 for no hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), CHUNK):
        part = np.ascontiguousarray(hashes[i : i + CHUNK]).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fingerprint long)`` of every document; the long holds the 64 bits, signed."""

    def run(batches):
        for b in batches:
            fp = np.array([majority(shingle_hashes(t, words)) for t in b.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, fingerprint long")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _masks(distance: int) -> list[int]:
    """Masks of the block combinations: of distance + 3 blocks, a close pair agrees on some 3 in full."""
    n = distance + 3
    edges = [64 * i // n for i in range(n + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(blocks, n - distance)]


def _far(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def fingerprint_links(distinct: DataFrame, distance: int = 2) -> DataFrame:
    """Links ``(a, b)`` that connect all distinct fingerprints (``fingerprint``) within ``distance`` bits.

    Buckets of up to ``PAIRED`` fingerprints are joined with themselves and each pair is verified. In a
    larger bucket no pairs are made: for distance 2 every member takes, besides itself, each flip of
    one bit outside the shared blocks as a key. Members that meet at a key are within two bits of each
    other, and all pairs within two bits meet, so linking them to the least one loses nothing.
    """
    masks = _masks(distance)
    keys = distinct.select(
        "fingerprint",
        F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col("fingerprint").bitwiseAND(F.lit(_signed(m))).alias("k")) for i, m in enumerate(masks)])).alias("e"),
    ).select("fingerprint", "e.c", "e.k")
    sizes = keys.groupBy("c", "k").agg(F.count("*").alias("n")).where("n > 1")
    members = shared.save(keys.join(sizes, ["c", "k"]), "buckets")
    few = members.where(F.col("n") <= PAIRED)
    x = few.select("c", "k", F.col("fingerprint").alias("a"))
    y = few.select("c", "k", F.col("fingerprint").alias("b"))
    pairs = x.join(y, ["c", "k"]).where((F.col("a") > F.col("b")) & (_far("a", "b") <= distance)).select("a", "b")
    many = members.where(F.col("n") > PAIRED)
    if distance == 2:
        mask = F.element_at(F.array(*[F.lit(_signed(m)) for m in masks]), F.col("c") + 1)
        flips = F.array(F.lit(0), *[F.lit(_signed(1 << i)) for i in range(64)])
        free = F.filter(flips, lambda f: f.bitwiseAND(mask) == 0)
        met = many.select("c", "fingerprint", F.explode(F.transform(free, lambda f: f.bitwiseXOR(F.col("fingerprint")))).alias("k"))
    else:  # the same idea with deletion: agree on all but `distance` of single-bit blocks is not cheap; pair exactly
        z = many.select("c", "k", F.col("fingerprint").alias("a"))
        w = many.select("c", "k", F.col("fingerprint").alias("b"))
        rest = z.join(w, ["c", "k"]).where((F.col("a") > F.col("b")) & (_far("a", "b") <= distance)).select("a", "b")
        return pairs.union(rest).distinct()
    least = met.groupBy("c", "k").agg(F.min("fingerprint").alias("b"), F.count("*").alias("n")).where("n > 1").select("c", "k", "b")
    hot = met.join(least, ["c", "k"]).where("fingerprint <> b").select(F.col("fingerprint").alias("a"), "b")
    return pairs.union(hot).distinct()


def link_fingerprints(docs: DataFrame, words: int = 3, distance: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fingerprint long, component_id)``: the least doc_id reachable over links within ``distance`` bits."""
    fps = shared.save(fingerprints(docs, words, id_col, text_col), "fingerprints")
    nodes = fps.groupBy("fingerprint").agg(F.min("doc_id").alias("rep"))
    comp = components(fingerprint_links(nodes.select("fingerprint"), distance))
    named = nodes.join(comp, F.col("fingerprint") == F.col("node"), "left").select("fingerprint", "rep", F.coalesce("component", "fingerprint").alias("component"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    classes = shared.save(named.join(least, "component").select("fingerprint", "component_id"), "classes")
    return fps.join(classes, "fingerprint").select("doc_id", "fingerprint", "component_id")


def hexadecimal(fingerprint) -> F.Column:
    """16 lowercase hex digits of a signed long."""
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


# --- similarity of shingle sets -------------------------------------------------------------------

#: 48 blocks of 8 minima: a pair at similarity 0.8 meets with a probability of 1 - (1 - 0.8 ** 8) ** 48 = 0.9998.
TABLES, BLOCK_ROWS = 48, 8
#: Tables whose stars come first: they join most of a group of copies, at a few rows for each copy.
FIRST_TABLES = 8
#: Longs of a set's bitmap, which has the bit of each member's hash, and of the wider one that pairs are tested by which that one lets pass.
LANES, WIDE = 8, 32
_DRAWN = np.random.default_rng(20240607).integers(0, 1 << 32, (2, TABLES * BLOCK_ROWS), dtype=np.uint32)


def _blocks(hashes: np.ndarray) -> np.ndarray:
    """The keys under which a set of hashes is met, one for each table, with the table in the upper bits."""
    if not len(hashes):
        return np.zeros(0, dtype=np.int64)
    least, short = np.full(TABLES * BLOCK_ROWS, (1 << 32) - 1, dtype=np.uint32), (hashes >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(short), 512):
        part = (short[i : i + 512, None] ^ _DRAWN[0]) * (_DRAWN[1] | np.uint32(1))
        least = np.minimum(least, part.min(axis=0))
    key = np.zeros(TABLES, dtype=np.uint64)
    for v in least.reshape(TABLES, BLOCK_ROWS).T.astype(np.uint64):
        key = (key ^ v) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return ((key >> np.uint64(8)) | (np.arange(TABLES, dtype=np.uint64) << np.uint64(56))).view(np.int64)


def _bitmap(hashes: np.ndarray, lanes: int = LANES) -> np.ndarray:
    """``lanes`` longs with a bit set for each hash."""
    bits = np.zeros(64 * lanes, dtype=bool)
    bits[hashes % np.uint64(64 * lanes)] = True
    return np.packbits(bits, bitorder="little").view("<i8")


def _row_key(id_col: str, text_col: str):
    return F.xxhash64(F.col(id_col), F.col(text_col))


def _sketches(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """``(row_key, doc_id, node, n, fingerprint, f0..f7, wide array<long>, blocks array<long>)``: ``node`` is a hash of the set of shingles, ``n`` its size."""

    def run(batches):
        import xxhash

        for b in batches:
            maps, wide, blocks = np.zeros((b.num_rows, LANES), dtype=np.int64), np.zeros((b.num_rows, WIDE), dtype=np.int64), []
            prints, node, n = np.zeros(b.num_rows, dtype=np.uint64), np.zeros(b.num_rows, dtype=np.uint64), np.zeros(b.num_rows, dtype=np.int64)
            for i, t in enumerate(b.column(2).to_pylist()):
                h = np.unique(shingle_hashes(t, words))
                node[i], n[i], maps[i] = xxhash.xxh64_intdigest(h.tobytes(), SEED), len(h), _bitmap(h)
                prints[i], wide[i] = majority(h), _bitmap(h, WIDE)
                blocks.append(_blocks(h))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(node.view(np.int64)), pa.array(n), pa.array(prints.view(np.int64)), *[pa.array(np.ascontiguousarray(maps[:, k])) for k in range(LANES)], pa.array(list(wide), type=pa.list_(pa.int64())), pa.array(blocks, type=pa.list_(pa.int64()))],
                names=["row_key", "doc_id", "node", "n", "fingerprint", *[f"f{k}" for k in range(LANES)], "wide", "blocks"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(_row_key(id_col, text_col).alias("row_key"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"row_key long, doc_id {kind}, node long, n long, fingerprint long, {', '.join(f'f{k} long' for k in range(LANES))}, wide array<long>, blocks array<long>")


def _shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """``(node, text binary)`` -> ``(node, grams array<long>)``, distinct hashes."""

    def run(batches):
        for b in batches:
            sets = [np.unique(shingle_hashes(t, words)).view(np.int64) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, type=pa.list_(pa.int64()))], names=["node", "grams"])

    return docs.mapInArrow(run, "node long, grams array<long>")


def _facts(nodes: DataFrame, name: str) -> DataFrame:
    """``nodes`` with its id as ``name`` and its size and bitmaps as ``name_0`` and on."""
    return nodes.select(F.col("node").alias(name), F.col("n").alias(f"{name}_0"), *[F.col(f"f{k}").alias(f"{name}_{k + 1}") for k in range(LANES)], F.col("wide").alias(f"{name}_wide"))


def _may(similarity: float) -> F.Column:
    """Whether the sets of ``a`` and ``b`` may be similar enough by their sizes and bitmaps; true of all that are.

    Each bit in which two bitmaps differ is a shingle that only one set has, and similar sets have at
    most ``(1 - similarity) / (1 + similarity)`` of their members to themselves. The wide bitmaps, in
    which hardly two members share a bit, are looked at last.
    """
    most = (1 - similarity) / (1 + similarity) * (F.col("a_0") + F.col("b_0")) + 1e-6
    alone = sum((_far(f"a_{k}", f"b_{k}") for k in range(1, LANES + 1)), F.lit(0))
    closer = F.aggregate(F.zip_with("a_wide", "b_wide", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    return (F.least("a_0", "b_0") >= similarity * F.greatest("a_0", "b_0") - 1e-6) & F.when(alone <= most, closer <= most).otherwise(False)


def _alike(nodes: DataFrame) -> DataFrame:
    """Candidate pairs ``(a, b)`` of nodes by their fingerprints: equal ones, and those that pigeonhole blocks find within two bits."""
    least = shared.save(nodes.groupBy("fingerprint").agg(F.min("node").alias("least"), F.count("*").alias("n")), "prints")
    equal = nodes.join(least.where("n > 1"), "fingerprint").where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    ends = [least.select(F.col("fingerprint").alias(c), F.col("least").alias(f"n{c}")) for c in "ab"]
    linked = fingerprint_links(least.select("fingerprint")).join(ends[0], "a").join(ends[1], "b")
    return equal.union(linked.select("na", "nb"))


def _verified(pairs: DataFrame, nodes: DataFrame, texts, words: int, similarity: float) -> DataFrame:
    """Of candidate pairs ``(a, b)`` those whose shingle sets are similar enough, by their bounds first."""
    return _exact(pairs.join(_facts(nodes, "a"), "a").join(_facts(nodes, "b"), "b").where(_may(similarity)).select("a", "b"), texts, words, similarity)


def _exact(pairs: DataFrame, texts, words: int, similarity: float) -> DataFrame:
    """Of pairs ``(a, b)`` those whose shingle sets are similar enough, by the sets."""
    near = shared.save(pairs, "near")
    wanted = near.select(F.col("a").alias("node")).union(near.select(F.col("b").alias("node"))).distinct()
    sets = shared.save(_shingle_sets(texts(wanted), words), "sets")
    both = near.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("s")), "a").join(sets.select(F.col("node").alias("b"), F.col("grams").alias("t")), "b")
    common = F.size(F.array_intersect("s", "t"))
    # texts of no words are in no bucket: their sets are equal, so they are one node already
    links = both.where(common >= similarity * (F.size("s") + F.size("t") - common)).select("a", "b")
    out = shared.save(links, "links")
    shared.drop(near)
    shared.drop(sets)
    return out


def _across(placed: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Pairs ``(a, b)`` of members ``placed(k, node, lead, component)`` of one bucket that lie in different components and may be similar.

    The bounds are tested where the pairs meet, and a pair only in the least bucket that both are in, so
    of a large group of copies too far from each other no more than the doubtful pairs come out.
    """
    mixed = placed.groupBy("k").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("k")
    held = shared.save(placed.join(mixed, "k"), "open")
    places = held.groupBy("node").agg(F.collect_set("k").alias("ks"))  # at most one of each table
    side = lambda v: held.select("k", "lead", F.col("node").alias(v), F.col("component").alias(f"c{v}")).join(_facts(nodes, v), v).join(places.select(F.col("node").alias(v), F.col("ks").alias(f"ks{v}")), v).drop(*(["lead"] if v == "b" else []))
    met = side("a").join(side("b"), "k").where("a > b and ca <> cb and a <> lead and b <> lead").where(_may(similarity))
    out = shared.save(met.where(F.array_min(F.array_intersect("ksa", "ksb")) == F.col("k")).select("a", "b"), "across")
    shared.drop(held)
    return out


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(row_key, doc_id, group_key)``: rows of one near-duplicate group share ``group_key``.

    Texts with equal sets of shingles are one node. Candidate pairs are first those whose fingerprints
    are close and, in ``FIRST_TABLES`` tables of minima, each bucket's members with its least one, its
    lead; verified links give components. Then come
    the members and leads of all buckets that lie in different components, and last all pairs across
    components in the buckets that still hold several: pairs within a component add nothing. So a group
    of thousands of copies costs a few rows for each, and no candidate is lost.
    """
    sk = shared.save(_sketches(docs, words, id_col, text_col), "sketches")
    nodes = shared.save(
        sk.groupBy("node").agg(F.min("row_key").alias("row_key"), F.min("n").alias("n"), F.min("fingerprint").alias("fingerprint"), *[F.min(f"f{k}").alias(f"f{k}") for k in range(LANES)], F.min("wide").alias("wide"), F.min("blocks").alias("blocks")), "nodes"
    )
    texts_of = docs.select(_row_key(id_col, text_col).alias("row_key"), F.col(text_col).cast("binary").alias("text"))

    def texts(wanted: DataFrame) -> DataFrame:
        keys = nodes.join(wanted, "node", "left_semi").select("node", "row_key")
        return texts_of.join(keys, "row_key").dropDuplicates(["node"]).select("node", "text")

    held = nodes.select("node", F.explode("blocks").alias("k"))
    sizes = held.groupBy("k").agg(F.count("*").alias("n"), F.min("node").alias("lead")).where("n > 1")
    members = shared.save(held.join(sizes, "k"), "members")
    stars = members.where("node <> lead").select("k", F.col("node").alias("a"), F.col("lead").alias("b"))
    first = _verified(_alike(nodes).union(stars.where(F.col("k") < (FIRST_TABLES << 56)).select("a", "b")).distinct(), nodes, texts, words, similarity)
    early = shared.save(components(first), "components")
    named = [early.select(F.col("node").alias(n), F.col("component").alias(f"c{n}")) for n in "ab"]
    apart = stars.join(named[0], "a", "left").join(named[1], "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b"))
    links = first.union(_verified(apart.select("a", "b").distinct(), nodes, texts, words, similarity))
    comp = shared.save(components(links), "components")
    placed = members.where("n > 2").join(comp, "node", "left").select("k", "node", "lead", F.coalesce("component", "node").alias("component"))
    across = _across(placed, nodes, similarity)
    second = _exact(across, texts, words, similarity)
    final = components(links.union(second))
    groups = nodes.select("node").join(final, "node", "left").select("node", F.coalesce("component", "node").alias("group_key"))
    out = shared.save(sk.select("row_key", "doc_id", "node").join(groups, "node").select("row_key", "doc_id", "group_key"), "groups")
    for t in (members, across, second, sk):
        shared.drop(t)
    return out


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the one with the least id (nulls last)."""
    groups = near_duplicates(docs, words, similarity, id_col, text_col)
    key = shared.free(docs, "row_key")
    kept = groups.groupBy("group_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("m")).select(F.col("m.row_key").alias(key))
    rows = docs.withColumn(key, _row_key(id_col, text_col)).join(kept, key, "left_semi")
    return rows.dropDuplicates([key]).drop(key)


# --- queries --------------------------------------------------------------------------------------


def op9_simhash_near_dup(spark, sf_dir: str) -> DataFrame:
    """Contract of operator 9 over the whole of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return link_fingerprints(docs, words=3, distance=2).select("doc_id", hexadecimal(F.col("fingerprint")).alias("fingerprint"), "component_id")
