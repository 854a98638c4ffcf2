"""Operator 5 - SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two segments of 32 bits. Of two fingerprints at distance 2 or less, one segment differs
by at most one bit, so the two share one of that segment's 32 one-wildcard variants (the segment with one bit left out).
Variants are index keys. The index holds each distinct value of a segment once, with the number of fingerprints that have
it, so at most two values share a key, however many fingerprints are alike: a key gives one pair of values from its
aggregate. A value that several fingerprints have is a pair with itself.

The fingerprints of a pair of values meet by an equality join and are verified by counting differing bits, block by block:
those of a crowded value are dealt to blocks by hash, and each pair of blocks is a group of its own, so no task holds a
whole value. No pairs leave a task: a pair of blocks gives edges that connect what its links connect.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import Scratch, free, n_partitions, short_batches, tidy
from rankloom.llm.components import _forest, connected_components

SEED, SHINGLE, DISTANCE, CHUNK = 42, 3, 2, 65536
#: Fingerprints of a block.
ROWS = 2048


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit fingerprint of a text's bytes. Null, empty or white-space text gives 0.

    ``bytes.lower`` changes A-Z only and ``bytes.split`` splits at exactly the white space of the contract. Shingles are
    hashed in chunks, so a text of any length needs memory for its words and one chunk.
    """
    words = text.lower().split() if text else []
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    stops = ends[shingle - 1 :].tolist() if len(words) >= shingle else [len(line)]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        h = np.array([digest(line[a:b], SEED) for a, b in zip(starts[at : at + CHUNK], stops[at : at + CHUNK], strict=True)], dtype=">u8")
        ones += np.unpackbits(h.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        text = b.column("text").cast(pa.large_binary())
        fp = pa.array([fingerprint(x.as_py()) for x in text], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), fp], names=["doc_id", "text_hash", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp long) for each row of ``docs``; other columns of ``docs`` play no part."""
    short_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string")).mapInArrow(tidy(_fingerprints), "doc_id long, text_hash long, fp long")


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (segment, a, b, i, j, side); each such group is one pair of blocks."""

    def edges(fp: np.ndarray, split: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
        left, right = (fp, fp) if same else (fp[:split], fp[split:])
        near = np.bitwise_count(left.view(np.uint64)[:, None] ^ right.view(np.uint64)[None, :]) <= DISTANCE
        u, v = np.nonzero(np.triu(near, 1) if same else near)
        return _forest(left[u], right[v]) if len(u) else (fp[:0], fp[:0])

    def out(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        src, dst = (np.concatenate([np.zeros(0, np.int64), *[f[k] for f in found]]) for k in range(2))
        return pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], names=["src", "dst"])

    rest, found, held = None, [], 0

    def handle(t: pa.Table, last: bool) -> int:
        """Verifies the whole groups of ``t`` and tells where the next one begins."""
        nonlocal held
        keys = [t.column(c).to_numpy() for c in ("seg", "a", "b", "i", "j")]
        starts = np.flatnonzero(np.append(True, np.any([k[1:] != k[:-1] for k in keys], axis=0)))
        ends = np.append(starts[1:], t.num_rows) if last else starts[1:]
        fp, right, same = t.column("fp").to_numpy(), t.column("side").to_numpy(), (keys[1] == keys[2]) & (keys[3] == keys[4])
        right = np.append(0, np.cumsum(right))
        for start, end in zip(starts.tolist(), ends.tolist(), strict=False):
            if end - start > 1:
                found.append(edges(fp[start:end], int(end - start - (right[end] - right[start])), bool(same[start])))
                held += len(found[-1][0])
        return int(ends[-1]) if len(ends) else 0

    for b in batches:
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([rest, t]) if rest is not None and rest.num_rows else t
        rest = t.slice(handle(t, False))
        if held > 50_000:
            yield out(found)
            found, held = [], 0
    if rest is not None and rest.num_rows:
        handle(rest, True)
    yield out(found)


def links(fps: DataFrame, scratch: Scratch, rows: int = ROWS) -> DataFrame:
    """Verified links (src, dst) between the distinct fingerprints ``fps`` (fp), enough to connect all at distance 2 or less."""
    spread = fps.select("fp").repartition(n_partitions(fps.sparkSession))
    cut = spread.select("fp", F.posexplode(F.expr("array(fp & 4294967295L, shiftrightunsigned(fp, 32))")).alias("seg", "v"))
    values = scratch.table(cut.groupBy("seg", "v").agg(F.count("*").alias("n")), "values")
    # A key is segment, wildcard and the 31 bits left; of its one or two values, the larger has the wildcard's bit.
    wild = values.repartition(n_partitions(fps.sparkSession)).select("seg", "v", F.explode(F.expr("sequence(0, 31)")).alias("k")).select(F.expr("shiftleft(cast(seg * 32 + k AS BIGINT), 32) | (v & ~shiftleft(1L, k))").alias("key"), "v")
    keys = wild.groupBy("key").agg(F.min("v").alias("a"), F.max("v").alias("b")).where("a < b")
    alike = values.where("n > 1").select("seg", F.col("v").alias("a"), F.col("v").alias("b"))
    pairs = keys.select(F.expr("cast(key div 137438953472L AS INT)").alias("seg"), "a", "b").unionByName(alike)
    size = lambda v: values.select("seg", F.col("v").alias(v), F.ceil(F.col("n") / rows).cast("int").alias(f"{v}_blocks"))
    pairs = scratch.table(pairs.join(size("a"), ["seg", "a"]).join(size("b"), ["seg", "b"]), "pairs")
    # Each fingerprint of a pair's values goes to the pairs of its block with the other value's blocks.
    block = lambda n: F.pmod(F.xxhash64("fp"), n).cast("int")
    to = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), side.cast("int").alias("side"))
    side_a = cut.withColumnRenamed("v", "a").join(pairs, ["seg", "a"]).withColumn("own", block(F.col("a_blocks"))).withColumn(
        "to", F.transform(F.sequence(F.lit(0), F.col("b_blocks") - 1), lambda k: F.when(F.col("a") == F.col("b"), to(F.least("own", k), F.greatest("own", k), F.col("own") > k)).otherwise(to(F.col("own"), k, F.lit(0)))))
    side_b = cut.withColumnRenamed("v", "b").join(pairs.where("a < b"), ["seg", "b"]).withColumn("own", block(F.col("b_blocks"))).withColumn("to", F.transform(F.sequence(F.lit(0), F.col("a_blocks") - 1), lambda k: to(k, F.col("own"), F.lit(1))))
    group = ["seg", "a", "b", "i", "j"]
    dealt = side_a.unionByName(side_b).select("seg", "a", "b", "fp", F.explode("to").alias("to")).select("seg", "a", "b", "to.*", "fp")
    met = dealt.repartition(n_partitions(fps.sparkSession), *group).sortWithinPartitions(*group, "side")
    return met.mapInArrow(tidy(_verify), "src long, dst long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash, fp, root, component_id, all long.

    root is the component's smallest fingerprint, and names the component whatever its ids.
    component_id is the smallest doc_id reachable over links, the row's own included. Fingerprint zero (null, empty or
    white-space text) links like any other. A null doc_id keeps its row and counts as no id; a component without ids has
    a null component_id. Repeated rows stay; an empty table gives an empty result; extra columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.table(fingerprints(docs), "fingerprints")
    classes = scratch.table(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "classes")
    roots = connected_components(links(classes, scratch), scratch)
    member = classes.join(roots.withColumnRenamed("id", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    least = member.groupBy("root").agg(F.min("low").alias("component_id"))
    named = member.join(least, "root").select("fp", "root", "component_id")
    return rows.join(named, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each component of ``docs``, with all its columns: that with the smallest doc_id, then text hash.

    Rows without an id stay only where no row of their component has one. Of rows equal in id and text, the one with the
    smallest hash of its other columns stays. An empty table gives an empty result.
    """
    key_at, row_at, hash_at = free(docs.columns, "key", "row", "hash")
    key = lambda h: F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), h)
    groups = near_duplicates(docs).where("component_id <=> doc_id").groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("one")).select("one.*")
    first = groups.select(key("text_hash").alias(key_at))
    all_columns = [F.col(f"`{c}`") for c in docs.columns]
    hashed = [F.to_json(F.struct(c)) if f.dataType.typeName() in ("map", "variant") else c for c, f in zip(all_columns, docs.schema.fields, strict=True)]
    keyed = docs.select(key(F.xxhash64("text")).alias(key_at), F.xxhash64(*hashed).alias(hash_at), F.struct(*all_columns).alias(row_at))
    return keyed.join(first, key_at).groupBy(key_at).agg(F.min_by(row_at, hash_at).alias(row_at)).select(f"{row_at}.*")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id; nulls, repeats, ties and empty tables as in :func:`near_duplicates`."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
