"""Sharding by extendible hashing, in DataFrame operations only.

A document's address is a string of bits: 32 of the MD5 of its id, then 32 of a hash of its text and of
a row number, which only rows with equal ids ever reach. The directory starts with one bucket; a bucket
over the byte limit, and only such a bucket, splits on its next bit, until every bucket fits. A single
document larger than the limit is a shard of its own, with ``oversize`` set.

The splits down to the depth at which buckets hold about the limit are found from byte sums of cells
(a few for each shard); deeper ones from the rows of the buckets still too large, level by level.
Sums are combined before the shuffle, so a hot address costs no more than any other.

Defined results: a null text has 0 bytes; a null id is addressed as an empty one; repeated rows are
spread by their row number; an empty table gives an empty result; further columns are passed through
by ``shard_rows`` whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

LIMIT = 32 << 20
BITS = 64


def address(id_col, text, row) -> F.Column:
    """64 characters, 0 or 1."""
    first = F.conv(F.substring(F.md5(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 2)
    rest = F.bin(F.xxhash64(text, row).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.concat(F.lpad(first, 32, "0"), F.lpad(rest, 32, "0"))


def _sums(rows: DataFrame, depth) -> DataFrame:
    return rows.groupBy(F.expr(f"substring(address, 1, {depth})").alias("prefix")).agg(F.sum("n_bytes").alias("bytes"), F.sum("n").alias("n"))


def assign(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``rows(uid, address, n_bytes)`` -> ``(uid, n_bytes, shard, shard_bytes, oversize)``; ``shard`` is the bucket's prefix."""
    rows = rows.withColumn("n", F.lit(1))
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    start = min(BITS, max(0, (total // limit).bit_length() - 1))
    cells = shared.save(_sums(rows, start), "cells")
    # every ancestor of every cell, and the shallowest that fits
    levels = cells.select("prefix", "bytes", "n", F.explode(F.sequence(F.lit(0), F.lit(start))).alias("depth"))
    whole = levels.groupBy(F.expr("substring(prefix, 1, depth)").alias("shard")).agg(F.sum("bytes").alias("shard_bytes"), F.sum("n").alias("n"))
    fits = whole.where((F.col("shard_bytes") <= limit) | (F.col("n") == 1))
    up = levels.select("prefix", F.expr("substring(prefix, 1, depth)").alias("shard"), "depth").join(fits, "shard")
    best = up.groupBy("prefix").agg(F.min(F.struct("depth", "shard", "shard_bytes")).alias("m")).select("prefix", "m.shard", "m.shard_bytes")
    at = rows.withColumn("prefix", F.expr(f"substring(address, 1, {start})")).join(best, "prefix", "left").drop("prefix")
    placed = shared.save(at, "placed")
    done = [placed.where("shard is not null").select("uid", "n_bytes", "shard", "shard_bytes")]
    open_ = placed.where("shard is null").select("uid", "address", "n_bytes", "n")
    depth = start
    while depth < BITS and not open_.isEmpty():
        depth += 1
        sums = _sums(open_, depth)
        fit = sums.where((F.col("bytes") <= limit) | (F.col("n") == 1) | F.lit(depth == BITS)).select("prefix", F.col("prefix").alias("shard"), F.col("bytes").alias("shard_bytes"))
        step = shared.save(open_.withColumn("prefix", F.expr(f"substring(address, 1, {depth})")).join(fit, "prefix", "left").drop("prefix"), "placed")
        done.append(step.where("shard is not null").select("uid", "n_bytes", "shard", "shard_bytes"))
        open_ = step.where("shard is null").select("uid", "address", "n_bytes", "n")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.withColumn("oversize", F.col("shard_bytes") > limit)


def shard_rows(docs: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``shard``, ``shard_bytes`` and ``oversize`` (in place of columns of those names)."""
    uid = shared.free(docs, "uid")
    kept = shared.save(docs.withColumn(uid, F.monotonically_increasing_id()), "numbered")  # written once, so that the numbers stay
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long")
    slim = kept.select(F.col(uid).alias("uid"), address(F.col(id_col), F.col(text_col), F.col(uid)).alias("address"), size.alias("n_bytes"))
    got = assign(slim, limit).select(F.col("uid").alias(uid), "shard", "shard_bytes", "oversize")
    return kept.drop("shard", "shard_bytes", "oversize").join(got, uid).drop(uid)


def directory(sharded: DataFrame) -> DataFrame:
    """``(shard, depth, shard_bytes, documents)``: the buckets of the directory, from sharded rows; no prefix is the beginning of another."""
    return sharded.groupBy("shard").agg(F.char_length("shard").alias("depth"), F.min("shard_bytes").alias("shard_bytes"), F.count("*").alias("documents"))


def look_up(keys: DataFrame, buckets: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``keys`` with the ``shard`` that a document of that id is in, by the first 32 bits of its address; null if none, or deeper buckets tell rows of one id apart."""
    bits = F.lpad(F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 2), 32, "0")
    at = shared.free(keys, "prefix")
    depths = buckets.where("depth <= 32").agg(F.array_sort(F.collect_set("depth")).alias("depths"))  # at most 33 numbers
    tried = keys.withColumn(shared.free(keys, "bits"), bits).join(F.broadcast(depths))
    tried = tried.select(*[F.col(f"`{c}`") for c in keys.columns], F.explode_outer(F.transform("depths", lambda d: F.substring(F.col(shared.free(keys, "bits")), F.lit(1), d))).alias(at))
    found = tried.join(buckets.where("depth <= 32").select(F.col("shard").alias(at)), at)
    return keys.join(found.select(F.col(f"`{id_col}`"), F.col(at).alias("shard")).distinct(), id_col, "left")


def write_shards(sharded: DataFrame, path: str) -> None:
    """A folder for each shard below ``path``."""
    sharded.repartition("shard").write.partitionBy("shard").parquet(path)


def op3_sharding(spark, sf_dir: str, limit: int = LIMIT) -> DataFrame:
    """Shard of every document of ``documents``; ``shard`` is the prefix, empty for a single shard."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    slim = docs.select("doc_id", size.alias("n_bytes"), F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("uid"))
    slim = shared.save(slim, "numbered")
    rows = slim.select("uid", address(F.col("doc_id"), F.col("h"), F.col("uid")).alias("address"), "n_bytes")
    return slim.select("uid", "doc_id").join(assign(rows, limit), "uid").select("doc_id", "n_bytes", "shard", "shard_bytes", "oversize")


def oracle(limit: int = LIMIT) -> str:
    """The same by SQL, for ids without repeats: each depth's sums, and the shallowest bucket that fits."""
    return f"""
with docs as (
  select doc_id, coalesce(strlen(text), 0) as n_bytes,
         lpad(bin(cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 8) as bigint)), 32, '0') as address
  from documents),
buckets as (
  select substr(address, 1, depth) as shard, depth, sum(n_bytes) as shard_bytes, count(*) as n
  from docs, range(0, 33) t(depth) group by 1, 2),
fits as (select * from buckets where shard_bytes <= {limit} or n = 1),
placed as (
  select d.doc_id, d.n_bytes, arg_min(f.shard, f.depth) as shard, cast(arg_min(f.shard_bytes, f.depth) as bigint) as shard_bytes
  from docs d, range(0, 33) t(depth) join fits f on f.depth = t.depth and f.shard = substr(d.address, 1, t.depth)
  group by d.doc_id, d.n_bytes)
select doc_id, n_bytes, shard, shard_bytes, shard_bytes > {limit} as oversize from placed
"""


ORACLE = oracle()
