"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

Every document is scanned once: its word windows are hashed inside generated
code and probed against the hash set of the benchmark's windows; a hash match
is verified on the words themselves.  Only hits (and one row per document)
leave the scan, so the shuffle carries hits, not text, and a document's
windows stay with the document however common a window is.

The hash set is broadcast only while its measured size is within
``BROADCAST_BYTES``; a larger benchmark meets the windows in a shuffled join
with the same result.  There a window travels as its place and two hashes (128
bits, which stand for its words), never with its document's words.

Normalised words: A-Z lower-cased, then runs of digits, a-z and characters
above ASCII.  A window is ``n`` consecutive words; an item of fewer words is
one window as a whole.

Cases: a null text, or one without words, has no windows; a null item text
likewise; a null id is an id of its own; identical rows are one document,
rows that share an id but not the text are separate documents; repeated items
with the same id count once, windows shared by items count for each of them;
empty tables give no hits; other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, staged

WINDOW = 10
BROADCAST_BYTES = 64 << 20
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def normal_words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _BREAK), "")


def benchmark_windows(items: DataFrame, item_id: str = "item_id", text: str = "text", n: int = WINDOW) -> DataFrame:
    """(item_id, len, gram): the distinct windows of every item; ``gram`` is
    its words joined by spaces (words hold none)."""
    ws = items.select(items[f"`{item_id}`"].alias("item_id"), normal_words(items[f"`{text}`"]).alias("ws"))
    size = F.least(F.size("ws"), F.lit(n))
    at = ws.where(F.size("ws") > 0).select(
        "item_id", "ws", size.alias("len"),
        F.explode(F.sequence(F.lit(1), F.size("ws") - size + 1)).alias("at"))
    return at.select("item_id", "len", F.array_join(F.slice("ws", F.col("at"), F.col("len")), " ").alias("gram")).distinct()


def _window_hash(ws: Column, at: Column, size: int, *seed: Column) -> Column:
    return F.xxhash64(*seed, *[F.get(ws, at + j) for j in range(size)])


def hits(docs: DataFrame, windows: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per verified occurrence (doc_id, text_hash, n_words, at, len,
    gram) and, with null ``gram``, at least one row for every document."""
    grams = staged(windows.select("len", "gram").distinct(), "decon-grams")
    by_len = grams.groupBy("len").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("gram") + 64).alias("b")).collect()
    lengths = sorted(r["len"] for r in by_len)              # at most n different lengths
    # the same words, hashed as the documents' windows are
    split = F.split("gram", " ")

    def hashed(*seed):
        return F.coalesce(*[F.when(F.col("len") == k, _window_hash(F.col("_ws"), F.lit(0), k, *seed)) for k in lengths], F.lit(0).cast("long"))
    grams = (grams.withColumn("_ws", split).withColumn("_h", hashed()).withColumn("_i", hashed(F.lit(1)))
             .select("_h", "_i", F.col("len").alias("_len"), "gram"))
    ws = docs.select(docs[f"`{key}`"].alias("doc_id"), F.xxhash64(docs[f"`{text}`"]).alias("text_hash"),
                     normal_words(docs[f"`{text}`"]).alias("ws"))
    at = ws.select("doc_id", "text_hash", "ws", F.size("ws").alias("n_words"), F.explode_outer(
        F.when(F.size("ws") > 0, F.sequence(F.lit(0), F.size("ws") - 1))).alias("at"))
    if len(lengths) > 1:
        at = at.withColumn("len", F.explode(F.array(*[F.lit(k) for k in lengths])))
    else:
        at = at.withColumn("len", F.lit(lengths[0] if lengths else WINDOW))

    def probe(*seed):
        return F.coalesce(*[F.when((F.col("len") == k) & (F.col("at") + k <= F.col("n_words")),
                                   _window_hash(F.col("ws"), F.col("at"), k, *seed)) for k in lengths], F.lit(None).cast("long"))
    same = (F.col("_p") == F.col("_h")) & (F.col("len") == F.col("_len"))
    if sum(r["b"] for r in by_len) <= BROADCAST_BYTES:
        same &= F.array_join(F.slice("ws", F.col("at") + 1, F.col("len")), " ") == F.col("gram")
        found = at.withColumn("_p", probe()).join(F.broadcast(grams), same, "left").where("gram IS NOT NULL OR at IS NULL OR at = 0")
    else:
        # windows without their document's words, those that reach past its end left out, and a row for each document
        none = F.lit(0).cast("long")        # never used, but a hash that cannot be null is computed once, not again for a null test
        spots = at.where("at + len <= n_words").select("doc_id", "text_hash", "n_words", "at", "len",
                                                       F.coalesce(probe(), none).alias("_p"), F.coalesce(probe(F.lit(1)), none).alias("_q"))
        found = (spots.join(grams, same & (F.col("_q") == F.col("_i")))
                 .unionByName(ws.select("doc_id", "text_hash", F.size("ws").alias("n_words")), allowMissingColumns=True))
    return found.select("doc_id", "text_hash", "n_words", "at", "len", "gram")


def _covered(spans: Column) -> Column:
    """Words covered by sorted (at, len) spans."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def add(a, x):
        end = x["at"] + x["len"]
        return F.struct(F.greatest(a["end"], end).alias("end"),
                        (a["n"] + F.greatest(F.lit(0), end - F.greatest(a["end"], x["at"]))).alias("n"))
    return F.aggregate(spans, zero, add, lambda a: a["n"])


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text", n: int = WINDOW) -> DataFrame:
    """Per document: doc_id, text_hash, n_words, n_hit (words inside hits),
    n_items, item_ids (sorted as strings), spans (hit word ranges)."""
    windows = staged(benchmark_windows(items, item_id, item_text, n), "decon-windows")
    found = staged(hits(docs, windows, key, text), "decon-hits")
    span = F.when(F.col("gram").isNotNull(), F.struct("at", "len"))
    per_doc = (found.groupBy("doc_id", "text_hash")
               .agg(F.max("n_words").cast("long").alias("n_words"), F.sort_array(F.collect_set(span)).alias("spans")))
    # items through the distinct windows of each document
    in_doc = found.where("gram IS NOT NULL").select("doc_id", "text_hash", "len", "gram").distinct()
    per_items = (in_doc.join(windows, ["len", "gram"]).select("doc_id", "text_hash", "item_id").distinct()
                 .groupBy(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t"))
                 .agg(F.count(F.lit(1)).cast("long").alias("n_items"),
                      F.sort_array(F.collect_list(F.coalesce(F.col("item_id").cast("string"), F.lit("")))).alias("item_ids")))
    joined = per_doc.join(per_items, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_t")), "left")
    return joined.select("doc_id", "text_hash", "n_words", _covered(F.col("spans")).cast("long").alias("n_hit"),
                         F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
                         F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), "spans")


def drop_contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` without any hit, columns unchanged."""
    bad = (contamination(docs, items, key, text, **how).where("n_hit > 0")
           .select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t")))
    return docs.join(bad, docs[f"`{key}`"].eqNullSafe(bad["_d"]) & (F.xxhash64(docs[f"`{text}`"]) == bad["_t"]), "left_anti")
