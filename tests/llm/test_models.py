"""Trained operators, archives and URL templates."""

import gzip
import io
import random
import string
import sys
import uuid

import numpy as np
import pytest
from made import SCHEMA, clashing, documents, items, made_documents, ordered  # noqa: F401
from pyspark.sql import functions as F

from tessera.llm import quality_model, secrets, url_filter, warc


# --- secrets -----------------------------------------------------------------

def samples(seed, n):
    r = random.Random(seed)
    verbs, nouns = "get set load store parse make find count".split(), "user file index table value name record buffer".split()
    rows = []
    for i in range(n):
        rows.append(("".join(r.choice(string.ascii_letters + string.digits) for _ in range(24)), 1))
        name = [r.choice(verbs), *r.sample(nouns, 3), str(r.randint(1, 99))]
        rows.append(("_".join(name) if i % 2 else name[0] + "".join(x.capitalize() for x in name[1:]) + "IsHere", 0))
    return rows


def test_markov_spans_are_found_in_linear_time():
    import time
    model = np.full((secrets.SIZE - 2, secrets.SIZE - 2), 9.0)
    text = "password=abcdefgh1 and aB3xY9kLq7Zr2WvT8mNcR4tU here " * 20_000
    base = secrets.base_spans(text)
    start = time.time()
    got = secrets.markov_spans(text, base, model)
    assert time.time() - start < 30 and len(got) == 20_000 == len(base)
    few = "password=abcdefgh1 x aB3xY9kLq7Zr2WvT8mNcR4tU secret=password=abcdefgh12345678901234"
    base = secrets.base_spans(few)
    want = [(m.start(), 3, m.end()) for m in secrets._RUN.finditer(few) if not any(m.start() < e and s < m.end() for s, _, e in base)]
    assert secrets.markov_spans(few, base, model) == want


def test_ids_that_are_no_numbers_count_as_null(spark):
    docs = spark.createDataFrame([("a", "one two three four five"), ("7", "one two three four five"), ("3", "one two three four five")], "doc_id string, text string")
    from tessera.llm import near_dedup, substring_dedup
    assert {(r.doc_id, r.kept) for r in near_dedup.groups(docs).collect()} == {(None, True), (3, True), (7, False)}
    assert substring_dedup.deduplicated(docs, k=3, anchor=2).where("n_removed > 0").select("doc_id").collect() == [(7,)]
    assert secrets.scanned(docs, secrets.trained(docs)).count() == 3


def test_labels_without_a_document_are_not_drawn(spark):
    docs = spark.createDataFrame([(i, f"text {i} " + ("good prose here. " if i % 2 else "BUY!!! $$$ ") * 9) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i * 500, i % 2) for i in range(1, 3000)] + [(i, i % 2) for i in range(200)], "key long, label int")
    model = quality_model.fit_labelled(docs, labels, max_fit=200)
    out = quality_model.scored(docs, model).collect()
    assert sum((r.score > 0.5) == bool(r.doc_id % 2) for r in out) > 195


def test_markov_models_separate_held_out_samples(spark):
    model = secrets.trained(spark.createDataFrame(samples(1, 400), "text string, random int"), label="random")
    held = samples(2, 300)
    right = sum((secrets.likelihood_ratio(t, model) > 0) == bool(y) for t, y in held)
    assert right / len(held) > 0.97
    found = secrets.scanned(spark.createDataFrame(
        [(1, "the key aB3xY9kLq7Zr2WvT8mNcR4tU ends"), (2, "get_user_file_index_77 store_value_name_record_12 here"), (3, None)],
        "doc_id long, text string"), model).select("doc_id", "spans").collect()
    assert {r.doc_id: r.spans for r in found} == {1: "markov:8:32", 2: "", 3: ""}


@pytest.mark.parametrize("letters", [string.ascii_letters, string.ascii_lowercase, string.ascii_uppercase])
def test_random_keys_without_digits_are_found(spark, letters):
    """The likelihood ratio alone decides: a key of one class of characters counts too."""
    r = random.Random(7)
    keys = ["".join(r.choice(letters) for _ in range(24)) for _ in range(50)]
    words = "internationalisation counterrevolutionary incomprehensibilities"
    plain = (words + " the user finds a file of this name and the index of every value in the table that the record holds ") * 200
    model = secrets.trained(spark.createDataFrame([(1, plain), (2, plain.upper())], "doc_id long, text string"))
    docs = spark.createDataFrame([(i, f"use {k} here") for i, k in enumerate(keys)] + [(99, words)], "doc_id long, text string")
    found = {r.doc_id: r.spans for r in secrets.scanned(docs, model).collect()}
    assert sum(found[i] == "markov:4:28" for i in range(50)) >= 43 and found[99] == ""


def test_pair_counts_match_plain_counting():
    text = "aZ09+/_=- é\tpassword"
    plain = np.zeros((secrets.SIZE, secrets.SIZE), int)
    codes = [secrets.SIZE - 1, *[secrets.ALPHABET.find(chr(b)) + 1 if chr(b) in secrets.ALPHABET else 0 for b in text.encode()], secrets.SIZE - 1]
    for a, b in zip(codes, codes[1:]):
        plain[a, b] += 1
    assert (secrets.pair_counts([text]) == plain).all()


# --- quality classifier --------------------------------------------------------

def quality_rows(seed, n):
    r = random.Random(seed)
    words = "the of and some words that make a plain text about things which people read every day".split()
    rows = []
    for i in range(n):
        w = [r.choice(words) + str(r.randint(0, 99)) * (r.random() < 0.2) for _ in range(r.randint(15, 200))]
        kind = i % 5
        if kind == 0:
            w = [x.upper() + "!!" for x in w]
        elif kind == 1:
            w = w[:4] * 12
        rows.append((int(kind > 1), seed * 100000 + i, " ".join(w)))
    return rows


def test_classifier_on_held_out_rows(spark):
    model = quality_model.fit(spark.createDataFrame(quality_rows(1, 500), "label int, key long, text string"))
    held = quality_rows(2, 300)
    out = quality_model.scored(spark.createDataFrame([(k, t) for _, k, t in held], "doc_id long, text string"), model).collect()
    truth = {k: y for y, k, _ in held}
    assert sum(r.predicted == truth[r.doc_id] for r in out) / len(out) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= quality_model.CUT) for r in out)


def test_classifier_edges(spark):
    rows = [(1, 1, "a b c"), (1, 2, None), (None, 3, "x"), (7, 4, "y"), (1, None, "z")]
    model = quality_model.fit(spark.createDataFrame(rows, "label int, key long, text string"))      # one class only
    docs = spark.createDataFrame([(None, None), (1, ""), (2, "w " * 60000), (2, "é")], "doc_id long, text string")
    scores = {r.score for r in quality_model.scored(docs, model).collect()}
    assert len(scores) == 1 and abs(scores.pop() - 3 / 4) < 1e-9
    empty = quality_model.fit(spark.createDataFrame([], "label int, key long, text string"))
    assert quality_model.scored(docs, empty).first().score == 0.5


def test_picked_rows_depend_on_the_keys_alone(spark):
    rows = spark.createDataFrame([(k % 2, k // 2 * 7, f"t{k}") for k in range(3000)], "label int, key long, text string")
    orders = [rows.coalesce(1).sortWithinPartitions("key"), rows.coalesce(1).sortWithinPartitions(F.desc("key")), rows.repartition(5, "text")]
    for n in (100, 301, 500, 1000):
        got = [ordered(quality_model.picked(some, n).collect()) for some in orders]
        assert got[0] == got[1] == got[2] and 0.8 * n < len(got[0]) <= n
    assert quality_model.picked(rows, 3000).count() == 3000


def test_dual_coordinate_descent_reaches_the_optimum():
    r = np.random.default_rng(3)
    x = r.normal(size=(60, 5))
    y = np.where(x[:, 0] + 0.3 * r.normal(size=60) > 0, 1.0, -1.0)
    cost = np.full(60, 0.5)
    w = quality_model.descend([np.arange(5)] * 60, list(x), y, cost, 5, epochs=2000)

    def objective(w):
        return w @ w / 2 + (cost * np.maximum(0, 1 - y * (x @ w))).sum()
    near = min(objective(w + d) for d in r.normal(size=(2000, 5)) * 0.02)
    assert objective(w) <= near + 1e-6


def test_indicators_are_over_the_whole_text():
    long = "plain words here " * 3000
    assert set(quality_model.indicators(long)) != set(quality_model.indicators(long + "LOUD!! " * 9000))
    assert list(quality_model.indicators("")) == list(quality_model.indicators(None)) == [quality_model.EMPTY]


# --- WARC ----------------------------------------------------------------------

PAGES = [(1, "http://a.example/x", "<html><title>T &amp; t</title><body><p>one\n two</p><script>no()</script><p>three</body>"),
         (2, None, None), (None, "http://b.example/", "<p>é " + "long " * 20000), (4, "http://c.example/\r\nX: y", "<![bad <p>text<<<"),
         (1, "http://a.example/x", "<html><title>T &amp; t</title><body><p>one\n two</p><script>no()</script><p>three</body>")]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("record", F.lit(0))


@pytest.mark.parametrize("compress", [False, True])
def test_derivatives_link_to_their_source(pages, compress):
    out = warc.derivatives(warc.responses(pages, compress=compress), compress=compress).collect()
    assert len(out) == 2 * len(PAGES) and all(r.digest_ok and r.error is None for r in out)
    sources = {}
    for r in warc.responses(pages).collect():
        (headers, block, error), = warc.split_records(bytes(r.record))
        assert not error
        sources[dict(headers)["WARC-Record-ID"]] = (dict(headers), block)
    for r in out:
        headers, block = sources[r.refers_to]
        assert r.target_uri == headers["WARC-Target-URI"] and r.source_payload_digest == headers["WARC-Payload-Digest"]
        (own, body, error), = warc.split_records(bytes(r.record))           # the record itself reads back
        assert not error and body.decode() == r.block and dict(own)["WARC-Refers-To"] == r.refers_to
        assert warc.digest(body) == r.block_digest == dict(own)["WARC-Block-Digest"] and len(body) == r.content_length
        uuid.UUID(r.record_id[10:-1])
        if r.record_type == "metadata":
            assert all(f"source-warc-{n}: {v}" in r.block for n, v in headers.items()) and "source-http-Content-Type: text/html" in r.block
    text = {r.block for r in out if r.record_type == "conversion"}
    assert "T & t\none two\nthree" in text and "" in text


def test_archives_and_broken_records(spark, pages, tmp_path):
    whole = b"".join(bytes(r.record) for r in warc.responses(pages).collect())
    bad = [whole, gzip.compress(whole), whole[:-40], b"nonsense", b"", None, whole[:30], b"\x1f\x8b\x08 broken",
           b"WARC/1.1\r\nWARC-Type: warcinfo\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n", b"WARC/1.1\r\nWARC-Type: response\r\n\r\nx"]
    out = warc.derivatives(spark.createDataFrame([(i, x) for i, x in enumerate(bad)], "i int, record binary"))
    n = {r.record_type: r["count"] for r in out.groupBy("record_type").count().collect()}
    assert n == {"metadata": 14, "conversion": 14, "error": 5}
    (tmp_path / "a.warc").write_bytes(whole)
    assert warc.derivatives(warc.read_archives(spark, str(tmp_path))).count() == 10


class Counted(io.BytesIO):
    """A stream that knows how far it was read."""
    def read(self, n=-1):
        assert n >= 0
        return super().read(n)


@pytest.mark.parametrize("one_member", [False, True])
def test_archives_are_read_record_by_record(spark, pages, tmp_path, monkeypatch, one_member):
    """Large archives: each record comes before the file is read further than it needs."""
    monkeypatch.setattr(warc, "PIECE_BYTES", 997)
    r = random.Random(9)
    one = [warc.serialised([("WARC-Type", "resource"), ("Content-Length", str(n))], r.randbytes(n)) for n in (0, 256, 25600) * 20]
    whole = b"".join(one)
    data = gzip.compress(whole) if one_member else b"".join(gzip.compress(x) for x in one)
    for stream in (Counted(whole), Counted(data)):
        seen, at = 0, []
        for headers, block, error in warc.split_records(stream):
            assert not error and len(block) == int(dict(headers)["Content-Length"])
            seen += 1
            at.append(stream.tell())
        assert seen == 60 and at[0] < 10000 and at[30] < 0.7 * at[-1]
    broken = data[:len(data) // 2] + b"\xff" * 60 + data[len(data) // 2 + 60:]
    out = list(warc.split_records(Counted(broken)))
    good = list(warc.split_records(whole))
    assert out[-1][2].startswith("inflate") and out[:20] == good[:20]
    assert one_member or out[:-1] == good[:len(out) - 1]              # a member that fails its check sum gives no good record
    records = [bytes(r.record) for r in warc.responses(pages).collect()]
    (tmp_path / "a b.warc").write_bytes(b"".join(records))
    (tmp_path / "c.warc.gz").write_bytes(b"".join(gzip.compress(x) for x in records) + b"\x1f\x8b\x08 broken")
    archives = warc.read_archives(spark, str(tmp_path))
    assert dict(archives.dtypes)["record"] == "string" and archives.count() == 2        # no file's bytes in a row
    n = {r.record_type: r["count"] for r in warc.derivatives(archives).groupBy("record_type").count().collect()}
    assert n == {"metadata": 10, "conversion": 10, "error": 1}


def test_a_block_too_large_for_a_row_is_passed_over(monkeypatch):
    monkeypatch.setattr(warc, "ROW_BYTES", 1000)
    data = b"".join(warc.serialised([("WARC-Type", "resource"), ("Content-Length", str(n))], b"x" * n) for n in (10, 5000, 20))
    assert [(len(b), e) for _, b, e in warc.split_records(data)] == [(10, ""), (0, "block of 2 GB or more"), (20, "")]


# --- URL filter ------------------------------------------------------------------

RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def test_url_parts_and_rules(spark):
    urls = ["HTTP://WWW.Example.NET/en/x?q=/de/", "http://a.example.net/de/", "http://net/x", "http://xnet/x", "http://example.com/de",
            "http://É.Example.com/de/é#/en/", "http://a.org/fr/", "http://a.org/FR/", "x://y://z/w", "no scheme/net/", "", None,
            "http://host.net", "http://host.net?/x", "://#", "http://example.net/en/a b\nc"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    out = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.verdicts(
        pages, spark.createDataFrame([], "page_id long, bad int"), RULES).collect()}

    def plain(u):
        at = (u or "").find("://")
        rest = u[at + 3:] if u and at >= 0 else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, tail = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = tail[:min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
        fit = [r for r in RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = max(fit, key=lambda r: len(r[0] + r[1]), default=None)
        return host, path, best[0] + best[1] if best else None, best[2] if best else "allow"
    assert out == {i: plain(u) for i, u in enumerate(urls)}


def test_templates_follow_labels(spark):
    """A branch that differs from its siblings stays its own template and is
    rejected, the others merge; numbers, dates and endings become wildcards."""
    rows, labels = [], []
    for i in range(400):
        section = ("news", "sport", "arts", "spam")[i % 4]
        rows.append((i, f"http://h.example/{section}/{i}.html"))
        labels.append((i, int(section == "spam" or i % 16 == 1)))
    rows += [(1000 + i, f"http://many.example/user{'abcdefghij'[i % 10]}{i}x/profile") for i in range(100)]
    rows += [(2000, "http://deep.example/" + "/".join("abcdefghijk")), (2001, None), (2001, None), (None, "http://h.example/spam/7.html")]
    labels += [(5, 1), (5, 0), (None, 1), (6, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("template", F.lit(1))
    out = url_filter.verdicts(pages, spark.createDataFrame(labels, "page_id long, bad int"), RULES)
    assert out.count() == len(rows)
    got = {(r.host, r.template): r.verdict for r in out.select("host", "template", "verdict").distinct().collect()}
    assert got[("h.example", "/spam/{n}.html")] == "block" and got[("h.example", "/*/{n}.html")] == "allow"
    assert {t for h, t in got if h == "many.example"} == {"/*/profile"}
    assert got[("deep.example", "/a/b/c/d/e/f/g/h/i/j/k")] == "allow" and ("", "") in got
    again = url_filter.verdicts(pages.repartition(5), spark.createDataFrame(labels, "page_id long, bad int"), RULES)
    assert ordered(out.collect()) == ordered(again.collect())


def test_payloads_are_decoded_or_refused(spark):
    import zlib
    page = "<html><head><meta charset='iso-8859-1'></head><p>café gratuit</p></html>"
    latin, squeezed = page.encode("latin-1"), gzip.compress(page.encode("latin-1"))
    raw = zlib.compressobj(wbits=-15)
    chunks = b"%x;x=y\r\n%s\r\n%x\r\n%s\r\n0\r\n\r\n" % (5, squeezed[:5], len(squeezed) - 5, squeezed[5:])
    cases = [([], latin, "café gratuit"), (["Content-Encoding: gzip"], squeezed, "café gratuit"),
             (["content-encoding: deflate"], zlib.compress(latin), "café gratuit"),
             (["Content-Encoding: deflate"], raw.compress(latin) + raw.flush(), "café gratuit"),
             (["Content-Encoding: gzip", "Transfer-Encoding: chunked"], chunks, "café gratuit"),
             (["Content-Type: text/html; charset=no-such"], latin, "café gratuit"),
             (["Content-Type: text/plain; charset=utf-8"], "naïve".encode(), "naïve"),
             (["Content-Type: image/png"], b"\x89PNG", "no text: image/png"), (["Content-Encoding: br"], b"x", "content encoding br"),
             (["Content-Encoding: gzip"], squeezed[:20], "content encoding: cut short"), (["Content-Encoding: gzip"], b"no gzip", "content encoding: "),
             (["Transfer-Encoding: chunked"], b"zz\r\nx", "broken chunks")]
    rows = []
    for i, (headers, payload, _) in enumerate(cases):
        block = "\r\n".join(["HTTP/1.1 200 OK", *headers]).encode() + b"\r\n\r\n" + payload
        rows.append((bytearray(warc.serialised([("WARC-Type", "response"), ("WARC-Record-ID", f"<{i:02d}>"), ("Content-Length", str(len(block)))], block)),))
    out = warc.derivatives(spark.createDataFrame(rows, "record binary")).collect()
    assert sum(r.record_type == "metadata" for r in out) == len(cases)
    got = {r.refers_to or r.record_id: r.block or r.error for r in out if r.record_type != "metadata"}
    assert all(got[f"<{i:02d}>"].startswith(want) for i, (*_, want) in enumerate(cases)) and len(got) == len(cases)


def test_sections_below_any_depth_are_told_apart(spark):
    deep = "/".join("abcdefgh")
    rows = [(i, f"http://deep.example/{deep}/{('clean', 'bad')[i % 2]}/{'xyz'[i % 3]}page-{'abcdefghij'[i % 10]}/{i}") for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "page_id long, bad int")
    out = url_filter.verdicts(pages, labels, RULES).collect()
    assert {(r.page_id % 2, r.verdict) for r in out} == {(0, "allow"), (1, "block")}


def plain_templates(rows, z=url_filter.Z_SIMILAR):
    """The template tree of (path, labelled, bad) rows of one host, node by node."""
    import re

    def shape(s):
        stem = re.sub(r"\.[A-Za-z]{1,5}$", "", s)
        kind = ("{n}" if re.fullmatch("[0-9]+", stem) else "{date}" if re.fullmatch("[0-9]{4}-[0-9]{1,2}(-[0-9]{1,2})?", stem)
                else "{hex}" if re.fullmatch("(?=.*[0-9])[0-9a-fA-F-]{8,}", stem)
                else "{id}" if 2 * sum(c.isdigit() for c in stem) > len(stem) else None)
        return None if kind is None else kind + s[len(stem):]

    def grow(rows, node):
        branches = {}
        for path, parts, l, b in rows:
            if not parts:
                out[path] = node + ("/" if path.endswith("/") else "")
            else:
                branches.setdefault(shape(parts[0]) or parts[0], []).append((path, parts, l, b))
        plain = {k: rs for k, rs in branches.items() if shape(rs[0][1][0]) is None}
        al, ab = (sum(r[i] for rs in plain.values() for r in rs) for i in (2, 3))
        following = {}
        for k, rs in branches.items():
            name, l, b = k, sum(r[2] for r in rs), sum(r[3] for r in rs)
            if k in plain and len(plain) > 1:
                differs = False
                if l and al > l:
                    share = ab / al
                    differs = abs(b / l - (ab - b) / (al - l)) > z * (share * (1 - share) * (1 / l + 1 / (al - l))) ** 0.5
                name = k if differs else "*"
            following.setdefault(name, []).extend((p, parts[1:], l, b) for p, parts, l, b in rs)
        for name, rs in following.items():
            grow(rs, f"{node}/{name}")
    out = {}
    grow([(p, [s for s in p.split("/") if s], l, b) for p, l, b in rows], "")
    return out


def test_templates_equal_a_plain_tree(spark):
    r = random.Random(6)
    paths = {"/" + "/".join(r.choice(["news", "sport", "spam", "x9", "12", "2020-01", "abcdef12", "a.html"]) for _ in range(r.randint(0, 6))) + r.choice(["", "/"])
             for _ in range(400)}
    rows = []
    for p in sorted(paths):
        n = r.randint(1, 6)
        rows.append(("h", p, n, n, sum(r.random() < (0.8 if "spam" in p else 0.1) for _ in range(n))))
    got = url_filter.templates(spark.createDataFrame(rows, "host string, path string, n long, labelled long, bad long")).collect()
    assert {x.path: x.template for x in got} == plain_templates([(p, l, b) for _, p, _, l, b in rows])


def test_bad_section_among_thin_siblings_stays(spark):
    """Many branches of a page each merge, the section that differs from them does not."""
    rows = [(i, f"http://hot.example/slug{'abcdefghij'[i % 10]}x{i}y/view") for i in range(1000)]
    rows += [(i, f"http://hot.example/casino/page-{'abcdefghij'[i % 10]}") for i in range(1000, 1200)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i >= 1000)) for i in range(1200)], "page_id long, bad int")
    out = url_filter.verdicts(pages, labels, RULES)
    got = {r.page_id: (r.template, r.verdict) for r in out.select("page_id", "template", "verdict").collect()}
    assert {got[i] for i in range(1000)} == {("/*/view", "allow")}
    assert {got[i] for i in range(1000, 1200)} == {("/casino/*", "block")}


def test_purity_is_smoothed(spark):
    rows = [("h", "/a", "/t", 3, 3, 3), ("h", "/b", "/u", 50, 50, 5)]
    out = {r.template: r.bad_share for r in url_filter.purities(
        spark.createDataFrame([(*r[:2], *r[3:], r[2]) for r in rows], "host string, path string, n long, labelled long, bad long, template string")).collect()}
    prior = 8 / 53
    assert abs(out["/t"] - (3 + 8 * prior) / 11) < 1e-12 and abs(out["/u"] - (5 + 8 * prior) / 58) < 1e-12


# --- pipeline ----------------------------------------------------------------------

def test_pipeline_stages_keep_the_columns(spark, clashing, items, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, before = clashing, None
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == clashing.columns, name
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        assert before is None or set(ids) <= set(before)
        before = ids
    assert before and len(made_documents()) > len(set(before))


def test_pipeline_on_an_empty_table(spark, items, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_worker_code_travels_by_value():
    from pyspark import cloudpickle
    assert b"_classes" in cloudpickle.dumps(secrets.markov_spans) and "tessera.llm" in sys.modules
