"""Operators with a fixed result against brute force, on hard rows."""

import math
import random

import brute
import pytest
from made import CLASH, SCHEMA, clashing, documents, items, made_documents, made_items, ordered  # noqa: F401
from pyspark.sql import functions as F

from tessera.llm import decontaminate, line_dedup, mixing, near_dedup, quality_rules, secrets, substring_dedup

PAIRS = [r[:2] for r in made_documents()]


def test_substring_dedup(clashing):
    out = substring_dedup.deduplicated(clashing)
    got = ordered(out.select("doc_id", "n_words", "n_removed", "kept_sha256").collect())
    assert got == ordered(brute.substring_dedup(PAIRS))
    assert sum(r[2] for r in got) > 1000
    assert all(brute.sha(r.text) == r.kept_sha256 for r in out.collect())


def test_substring_dedup_in_pieces(spark, documents, monkeypatch):
    """Texts longer than a piece, spans and ids beyond the broadcast bounds."""
    monkeypatch.setattr(substring_dedup, "PIECE", 64)
    monkeypatch.setattr(substring_dedup, "BATCH", 7)
    monkeypatch.setattr(substring_dedup, "BROADCAST_IDS", 0)
    monkeypatch.setattr(substring_dedup, "BROADCAST_SPANS", 0)
    got = substring_dedup.deduplicated(documents).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert ordered(got.collect()) == ordered(brute.substring_dedup(PAIRS))


def colliding_words(length=2048):
    """A Thue-Morse word and its complement: equal under every polynomial
    hash modulo a power of two."""
    bits = [bin(i).count("1") % 2 for i in range(length)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def few_hashes(monkeypatch, *modules):
    """Word hashes of eight bits where candidates are looked for."""
    import numpy as np
    from tessera.llm import tokens
    whole = tokens.word_hashes

    def weak(data, both=False):
        first, *second = whole(data, True)
        return (first & np.uint64(255), *second) if both else first & np.uint64(255)
    for m in modules:
        monkeypatch.setattr(m, "word_hashes", weak)


def test_words_that_polynomials_confuse(spark):
    a, b = colliding_words()
    r = random.Random(8)
    shared = [f"w{r.randrange(500)}" for _ in range(60)]
    docs = spark.createDataFrame([(1, " ".join([a, *shared])), (2, " ".join([b, *shared])), (3, a), (4, b)], "doc_id long, text string")
    got = {x.doc_id: x.n_removed for x in substring_dedup.deduplicated(docs).collect()}
    assert got == {1: 0, 2: 60, 3: 0, 4: 0}
    kept = {x.doc_id for x in near_dedup.groups(docs.where("doc_id > 2")).where("kept").collect()}
    assert kept == {3, 4}


def test_weak_hashes_cost_time_and_change_nothing(documents, monkeypatch):
    few_hashes(monkeypatch, substring_dedup, near_dedup)
    got = substring_dedup.deduplicated(documents).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert ordered(got.collect()) == ordered(brute.substring_dedup(PAIRS))
    got = near_dedup.groups(documents).select("doc_id", "n_shingles", "component_id", "kept")
    assert ordered(got.collect()) == ordered(brute.near_duplicates(PAIRS))


def test_decontaminate(clashing, items):
    def one_row(rows):          # identical rows are one document
        return ordered(dict.fromkeys(rows))
    found = decontaminate.contamination(clashing, items.withColumn("gram", F.lit(1)))
    got = found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256), F.col("n_hit") > 0)
    want = brute.decontaminate(PAIRS, [(i if i is not None else "", t) for i, t in made_items()])
    assert sum(w[2] for w in want) > 100
    assert ordered(got.collect()) == one_row((tuple(x) for x in want_by_text(want)))


def want_by_text(want):
    seen = {}
    for w, (d, t) in zip(want, PAIRS):
        seen[d, t] = w
    return seen.values()


def test_decontaminate_without_broadcast(documents, items, monkeypatch):
    whole = ordered(decontaminate.contamination(documents, items).drop("spans", "item_ids").collect())
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    assert ordered(decontaminate.contamination(documents, items).drop("spans", "item_ids").collect()) == whole


def _joins(plan):
    own = [plan] if plan.nodeName() == "Join" else []
    return own + [j for i in range(plan.children().size()) for j in _joins(plan.children().apply(i))]


def test_decontaminate_shuffled(spark, documents, items, monkeypatch):
    """A benchmark too large for any broadcast, and a long document: the same
    result, and no document's words in the rows that are shuffled."""
    long = " ".join(f"w{i % 7919}" for i in range(20000))
    docs = documents.unionByName(spark.createDataFrame([(500, long), (501, None)], "doc_id long, text string"), allowMissingColumns=True)
    tests = items.unionByName(spark.createDataFrame([(20, " ".join(f"w{i}" for i in range(500, 530))), (21, "w7918 w0 w1")], items.schema))
    whole = ordered(decontaminate.contamination(docs, tests).collect())
    assert [r[3:5] for r in whole if r[0] == 500] == [(96, 2)]
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = decontaminate.hits(docs, decontaminate.benchmark_windows(tests))
        joins = _joins(found._jdf.queryExecution().optimizedPlan())
        assert joins and all("array<" not in side.schema().simpleString() for j in joins for side in (j.left(), j.right()))
        assert ordered(decontaminate.contamination(docs, tests).collect()) == whole
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_decontamination_drops_rows(clashing, items):
    bad = {(d, t) for (d, t), w in zip(PAIRS, brute.decontaminate(PAIRS, made_items())) if w[5]}
    left = decontaminate.drop_contaminated(clashing, items)
    assert left.columns == clashing.columns
    assert ordered(left.select("doc_id", "text").collect()) == ordered(p for p in PAIRS if p not in bad)


def test_near_dedup(clashing):
    got = near_dedup.groups(clashing).select("doc_id", "n_shingles", "component_id", "kept")
    assert ordered(got.collect()) == ordered(brute.near_duplicates(PAIRS))


def test_near_dedup_chain(spark, monkeypatch):
    """Neighbours of a chain are similar, its ends are not; many centres are
    needed where the smallest id is at an end."""
    words = [f"w{i}" for i in range(400)]
    rows = [(100 - i if i % 2 else i, " ".join(words[6 * i:6 * i + 100])) for i in range(40)]
    rows += [(200 + i, " ".join(words[:100] + [f"x{i}{j}" for j in range(14)])) for i in range(30)]
    monkeypatch.setattr(near_dedup, "TILE_MEMBERS", 3)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.groups(docs).select("doc_id", "n_shingles", "component_id", "kept")
    assert ordered(got.collect()) == ordered(brute.near_duplicates(rows))


def test_near_dedup_keeps_one_row_of_each_group(clashing):
    left = near_dedup.drop_duplicates(clashing)
    assert left.columns == clashing.columns
    ids = [r.doc_id for r in left.select("doc_id").where("doc_id IS NOT NULL").collect()]
    assert sorted(ids) == sorted({w[0] for w in brute.near_duplicates(PAIRS) if w[3] and w[0] is not None})
    assert left.where("doc_id IS NULL").count() == 2


def test_quality_base(clashing):
    got = quality_rules.judged(clashing, keep=["doc_id"]).select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert ordered(got.collect()) == ordered(brute.quality_base(PAIRS))
    kept = quality_rules.drop_failed(clashing)
    assert kept.columns == clashing.columns and 0 < kept.count() < len(PAIRS)


@pytest.mark.parametrize("text,rule", [
    ("a b " * 3 + "cc", None), (" ".join(f"w{i}#" for i in range(20)), "symbols"),
    (" ".join(f"stop{i}!!" for i in range(20)), "shouting"), (" ".join(f"LOUDLY{chr(65 + i)}" for i in range(20)), "capitals"),
    (" ".join(f"rare{i}" for i in range(60)), "stop_words"), ("\n".join(["- the point"] * 12 + [f"- of {i} things" for i in range(9)]), "duplicate_lines"),
    ("\n".join(f"- the point {i}" for i in range(20)), "bullet_lines"), ("\n".join(f"the rest {i} ..." for i in range(20)), "ellipsis_lines"),
    (" ".join("abcdefghij" * 3 + str(i) for i in range(20)), "word_length")])
def test_quality_verdicts(spark, text, rule):
    docs = spark.createDataFrame([(text, "en")], "text string, lang string")
    r = quality_rules.judged(docs, keep=[]).first()
    assert rule is None or rule in r.failed_rules


def test_line_dedup(clashing):
    got = line_dedup.cleaned(clashing, host="source", length="n_chars")
    assert got.columns == clashing.columns
    want = brute.line_dedup([(s, t) for _, t, _, s, _ in made_documents()])
    assert ordered(got.select("doc_id", "text").collect()) == ordered((p[0], t) for p, t in zip(PAIRS, want))
    assert any(t != p[1] for p, t in zip(PAIRS, want))
    changed = got.where("source = 'site'").select("text", "n_chars").collect()
    assert all(len(r.text) == r.n_chars for r in changed)


def test_line_dedup_without_broadcast(documents, monkeypatch):
    whole = ordered(line_dedup.cleaned(documents, host="source").collect())
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", -1)
    assert ordered(line_dedup.cleaned(documents, host="source").collect()) == whole


def test_mixing(clashing, monkeypatch):
    sizes = {}
    for _, t, _, s, _ in made_documents():
        sizes[s] = sizes.get(s, 0) + len(brute.words(t))
    goal = brute.targets(sizes)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    plan = mixing.planned(clashing).where("doc_id != 41").join(clashing.select("doc_id", "source").distinct(), "doc_id").collect()
    for r in plan:
        assert math.isclose(r.target, goal[r.source]) and r.source_size == sizes[r.source] and r.taken <= 2 * r.size
    assert math.isclose(sum(goal.values()), min(1.5 * sum(sizes.values()), 2.0 * sum(sizes.values())))
    mix = mixing.mixed(clashing)
    assert mix.columns == clashing.columns
    assert mix.count() == mixing.planned(clashing).agg(F.sum("copies")).first()[0]
    assert ordered(mixing.planned(clashing).collect()) == ordered(mixing.planned(clashing.repartition(7)).collect())


def test_mixing_comes_near_targets(spark):
    rows = [(i, "w " * (1 + i % 40), "abcdef"[min(5, i % 9)]) for i in range(20000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    per = mixing.planned(docs).groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect()
    assert len(per) == 6 and all(abs(r.taken / r.target - 1) < 0.03 for r in per)


def test_secrets_base(clashing):
    got = secrets.scanned(clashing, secrets.trained(clashing))
    rows = ordered(got.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256").collect())
    assert rows == ordered(brute.secrets_base(PAIRS))


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame(made_documents()[:5], SCHEMA)
    items = spark.createDataFrame([], "item_id long, text string")
    assert substring_dedup.deduplicated(docs).count() == 0
    assert decontaminate.contamination(docs, items).count() == 0
    assert all(r.n_hit == 0 for r in decontaminate.contamination(some, items).collect())
    assert near_dedup.groups(docs).count() == 0 and near_dedup.drop_duplicates(docs).count() == 0
    assert quality_rules.drop_failed(docs).count() == 0
    assert line_dedup.cleaned(docs, host="source").count() == 0
    assert mixing.planned(docs).count() == 0 and mixing.mixed(docs).count() == 0
    assert secrets.scanned(docs, secrets.trained(docs)).count() == 0


def test_empty_pages(spark):
    from tessera.llm import url_filter, warc
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.derivatives(warc.responses(pages)).count() == 0
    labels = spark.createDataFrame([], "page_id long, bad int")
    assert url_filter.verdicts(pages, labels, (("net", "/", "block"),)).count() == 0


def test_clash_names_are_there(clashing):
    assert set(CLASH) <= set(clashing.columns)
