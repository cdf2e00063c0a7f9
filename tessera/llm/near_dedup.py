"""Near-duplicate groups by min-max hashing.

Each document is its set of distinct 4-word shingles.  Under every one of 48
permutations both the minimum and the maximum are kept, so 48 hash
evaluations give a signature of 96 unbiased values, cut into 24 bands of 4:
two sets of similarity 0.8 share no band with a probability of
(1 - 0.8^4)^24 = 3e-6.

1. Documents with the same shingle set are one class (aggregation by the
   digests of two sets of independent shingle hashes); only one
   representative goes on.
2. Representatives meet in buckets (band, value).  A bucket is never expanded
   into its pairs: all members are compared with one centre, the member that
   meets most others in all its buckets.
3. Links are confirmed on the full sets of both texts, with integers, and on
   shingle hashes that are independent of those that found the candidates.
4. Confirmed links give components.  In a bucket that still holds several, the
   members outside the largest are compared with all its members, on the full
   sets, in tiles of bounded blocks; only links leave a tile.  So nothing is
   capped and no candidate is left out, copies and near copies of one text cost
   one comparison each, and only texts that share a bucket without being
   similar enough cost more (outer members x members of their bucket).

Minima, counts and distinct rows go through partial aggregation; joins have
one row per key on one side, written before, so AQE can split the other.

Cases: null and empty texts have an empty set, are linked with nothing and
kept; texts of fewer than 4 words are one shingle; a null id is linked with
nothing, has no component and is kept; rows that share an id are one node (a
link of one is a link of all) with one result row each; an empty table stays
empty; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import staged
from tessera.llm.components import components
from tessera.llm.tokens import Rolling, encoded, word_hashes

SHINGLE = 4
PERMUTATIONS = 48
ROWS = 4                    # signature values of a band
THRESHOLD = 80              # per cent
BROADCAST_IDS = 2_000_000   # ids (16 bytes each) that are broadcast at most
#: A block of a tile has about so many members and shingles at most.
TILE_MEMBERS, TILE_SHINGLES = 512, 500_000
_ROW = ["id", "text_hash"]


def shingle_sets(text: str | None, k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct 64-bit fingerprints of the k-word shingles under two
    independent hashes (bytes.lower changes A-Z only): the first finds
    candidates, the second decides."""
    both = word_hashes(encoded(text).lower(), both=True)
    return [np.unique(Rolling(h, i).windows(min(k, len(h)))) if len(h) else h for i, h in enumerate(both)]


def set_digest(s: np.ndarray) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(s.tobytes()), "big", signed=True)


def signature(s: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """Minimum and maximum of the set under each permutation, side by side."""
    low = np.full(len(multipliers), np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(len(multipliers), np.uint64)
    for i in range(0, len(s), 4096):
        h = s[i:i + 4096, None] * multipliers
        np.minimum(low, h.min(axis=0), out=low)
        np.maximum(high, h.max(axis=0), out=high)
    return np.stack([low, high], axis=1).ravel()


def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(20).integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)


def sketches(docs: DataFrame, k: int = SHINGLE, permutations: int = PERMUTATIONS, rows: int = ROWS) -> DataFrame:
    """(id, text_hash, n, set_a, set_b, bands) of every row (id, text_hash, text)."""
    def run(batches):
        multipliers = _multipliers(permutations)
        for batch in batches:
            n, a, b, bands = [], [], [], []
            for t in batch.column(2):
                s, exact = shingle_sets(t.as_py(), k)
                n.append(len(exact))
                a.append(set_digest(s))
                b.append(set_digest(exact))
                sig = signature(s, multipliers) if len(s) else np.empty(0, np.uint64)
                bands.append([xxhash.xxh3_64_intdigest(v.tobytes(), seed=j) - (1 << 63)
                              for j, v in enumerate(sig.reshape(-1, rows))])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()),
                 pa.array(bands, pa.list_(pa.int64()))], names=["id", "text_hash", "n", "set_a", "set_b", "bands"])
    return docs.select(*_ROW, "text").mapInArrow(
        run, "id long, text_hash long, n long, set_a long, set_b long, bands array<long>")


def _sets(texts: DataFrame, k: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            sets = [shingle_sets(t.as_py(), k)[1].tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.binary())],
                                             names=["id", "text_hash", "shingles"])
    return texts.select(*_ROW, "text").mapInArrow(run, "id long, text_hash long, shingles binary")


def full_sets(ends: DataFrame, docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(id, text_hash, shingles) of the rows ``ends`` (id, text_hash)."""
    ends = staged(ends.distinct(), "near-ends")
    if ends.count() <= BROADCAST_IDS:
        ends = F.broadcast(ends)
    texts = docs.select(*_ROW, "text").join(ends, _ROW, "left_semi")
    return staged(_sets(texts, k).dropDuplicates(_ROW), "near-sets")


def _confirm(threshold: int):
    def run(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                keep.append(100 * both >= threshold * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))
    return run


def confirmed(pairs: DataFrame, sets: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The pairs (u, u_hash, v, v_hash) whose full sets are similar enough, as (u, v)."""
    v = sets.select(F.col("id").alias("v"), F.col("text_hash").alias("v_hash"), F.col("shingles").alias("v_set"))
    u = sets.select(F.col("id").alias("u"), F.col("text_hash").alias("u_hash"), F.col("shingles").alias("u_set"))
    both = pairs.join(v, ["v", "v_hash"]).join(u, ["u", "u_hash"])
    return both.select("u", "v", "u_set", "v_set").mapInArrow(_confirm(threshold), "u long, v long")


def _overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set of ``a`` with every set of
    ``b``: only shingles on both sides get a bit, so unique ones cost nothing."""
    common = np.intersect1d(np.concatenate(a), np.concatenate(b))
    out = np.zeros((len(a), len(b)), np.int64)

    def bits(sets):
        return np.stack([np.packbits(np.isin(common, s, assume_unique=True)) for s in sets])
    if len(common):
        right = bits(b)
        for i, row in enumerate(bits(a)):
            out[i] = np.bitwise_count(right & row).sum(axis=1)
    return out


def _tile(threshold: int):
    """Links between the outer members and all members of a tile."""
    def run(table: pa.Table) -> pa.Table:
        outer = np.array(table["outer"].to_pylist(), bool)
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in table["shingles"]]
        ids, comp, n = (table[c].to_numpy() for c in ("id", "component", "n"))
        a, b = np.flatnonzero(outer), np.flatnonzero(~outer)
        u, v = [], []
        if len(a) and len(b):
            both = _overlaps([sets[i] for i in a], [sets[i] for i in b])
            hit = (100 * both >= threshold * (n[a][:, None] + n[b][None, :] - both)) & (comp[a][:, None] != comp[b][None, :])
            x, y = np.nonzero(hit)
            u, v = ids[a[x]], ids[b[y]]
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})
    return run


def _blocks(total, many):
    return F.ceil(F.greatest(F.col(total) / TILE_SHINGLES, F.col(many) / TILE_MEMBERS)).cast("int")


def rest_links(buckets: DataFrame, found: DataFrame, sets: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Links (u, v) between different components of a bucket.  In such a
    bucket every member outside its largest component is compared with all
    members.  No pair is a row: the members are cut into blocks of bounded
    size, and a tile (outer block, block) compares its sets inside numpy."""
    of = (buckets.join(found, buckets["id"] == found["node"], "left")
          .select("bucket", *_ROW, "n", F.coalesce("component", "id").alias("component")))
    parts = of.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("n"))
    mixed = staged(parts.groupBy("bucket").agg(F.max(F.struct("size", "component", "n")).alias("top"), F.sum("size").alias("size"),
                                         F.sum("n").alias("all"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
             .withColumn("rest_n", F.col("all") - F.col("top.n")).withColumn("rest", F.col("size") - F.col("top.size"))
             .select("bucket", F.col("top.component").alias("top"), _blocks("rest_n", "rest").alias("outer_blocks"),
                     _blocks("all", "size").alias("all_blocks")), "near-mixed")
    member = of.join(mixed, "bucket").withColumn("at", F.xxhash64(*_ROW))
    outer = member.where(F.col("component") != F.col("top")).select(
        "*", F.lit(True).alias("outer"), F.pmod("at", "outer_blocks").cast("int").alias("i"),
        F.explode(F.sequence(F.lit(0), F.col("all_blocks") - 1)).alias("j"))
    every = member.select(
        "*", F.lit(False).alias("outer"), F.explode(F.sequence(F.lit(0), F.col("outer_blocks") - 1)).alias("i"),
        F.pmod("at", "all_blocks").cast("int").alias("j"))
    rows = outer.unionByName(every).select("bucket", "i", "j", "outer", *_ROW, "n", "component").join(sets, _ROW)
    return rows.groupBy("bucket", "i", "j").applyInArrow(_tile(threshold), "u long, v long").distinct()


def links(reps: DataFrame, docs: DataFrame, k: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """(node, component) of the linked representatives (id, text_hash, n, bands)."""
    member = (reps.select(*_ROW, "n", F.posexplode("bands").alias("band", "value"))
              .select(F.xxhash64("band", "value").alias("bucket"), *_ROW, "n"))
    sizes = staged(member.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "near-sizes")
    buckets = staged(member.join(sizes, "bucket"), "near-members")
    # the member that meets most others is likest the text that the others were made from
    # (aggregates that are joined are written first: their joins then read
    # plain shuffles, which AQE can split at a hot key)
    met = staged(buckets.groupBy(*_ROW).agg(F.sum("size").alias("met")), "near-met")
    centre = staged(buckets.join(met, _ROW).groupBy("bucket")
                    .agg(F.max(F.struct("met", (-F.col("id")).alias("low"), "text_hash", "n")).alias("c")), "near-centres")
    star = buckets.join(centre, "bucket").select(
        (-F.col("c.low")).alias("u"), F.col("c.text_hash").alias("u_hash"), F.col("c.n").alias("u_n"),
        F.col("id").alias("v"), F.col("text_hash").alias("v_hash"), F.col("n").alias("v_n"))
    # sets of too different sizes cannot reach the threshold
    star = star.where((F.col("u") != F.col("v")) & (100 * F.least("u_n", "v_n") >= threshold * F.greatest("u_n", "v_n")))
    star = staged(star.select("u", "u_hash", "v", "v_hash").distinct(), "near-pairs")
    sets = full_sets(buckets.select(*_ROW), docs, k)
    first = staged(confirmed(star, sets, threshold), "near-links")
    found = staged(components(first), "near-components")
    more = staged(rest_links(buckets.drop("size"), found, sets, threshold), "near-rest")
    if more.isEmpty():
        return found
    return staged(components(first.union(more)), "near-components")


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """Per row of ``docs``: doc_id, text_hash, n_shingles, component_id, kept."""
    t = docs[f"`{text}`"]
    own = docs.select(docs[f"`{key}`"].try_cast("long").alias("id"), F.xxhash64(t).alias("text_hash"), t.alias("text"))
    every = staged(sketches(own, k), "near-sketches")
    able = every.where("id IS NOT NULL AND n > 0")
    same = ["set_a", "set_b", "n"]
    classes = staged(able.groupBy(*same).agg(F.min(F.struct(*_ROW)).alias("rep")), "near-classes")
    reps = able.join(classes.select("rep.*"), _ROW).select(*_ROW, "n", "bands").dropDuplicates(_ROW)
    found = links(reps, own.where("id IS NOT NULL"), k, threshold)

    row = every.select(*_ROW, "n", "set_a", "set_b")
    row = staged(row.join(classes.select(*same, F.col("rep.id").alias("rep")), same, "left")
                 .select("id", "text_hash", "n", F.when(F.col("id").isNotNull(), F.coalesce("rep", "id")).alias("rep")), "near-rows")
    # rows that share an id but not the class join their classes
    shared = row.where("id IS NOT NULL").groupBy("id").agg(F.min("rep").alias("v"), F.max("rep").alias("high")).where("v < high")
    if not (shared := staged(shared, "near-shared")).isEmpty():
        more = row.join(shared, "id").select(F.col("rep").alias("u"), "v")
        found = staged(components(found.select(F.col("node").alias("u"), F.col("component").alias("v")).union(more)), "near-components")
    out = row.join(found, row["rep"] == found["node"], "left").select(
        row["id"].alias("doc_id"), "text_hash", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``docs`` with one document of each group, columns unchanged.  Of rows
    that share an id, the one with the smallest text (then columns) stays."""
    gone = staged(groups(docs, key, text, **how).where("NOT kept").select(
        F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t")).distinct(), "near-gone")
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    c = docs[f"`{key}`"]
    left = docs.join(gone, (c.try_cast("long") == gone["_d"]) & (F.xxhash64(docs[f"`{text}`"]) == gone["_t"]), "left_anti")
    again = staged(left.where(left[f"`{key}`"].isNotNull()).groupBy(left[f"`{key}`"].alias("_d"))
                   .agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_d"), "near-repeated")
    if again.isEmpty():
        return left
    cols = [left[f"`{n}`"].alias(n) for n in left.columns]
    first = left.join(again, left[f"`{key}`"] == again["_d"]).groupBy(again["_d"]).agg(
        F.min(F.struct(left[f"`{text}`"].alias("_t"), F.struct(*cols).alias("row"))).alias("m")).select("m.row.*")
    return left.join(again, left[f"`{key}`"] == again["_d"], "left_anti").unionByName(first)
