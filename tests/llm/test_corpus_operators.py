"""Substring dedup, Jaccard join, WARC, main text and the pipeline against brute force."""

import base64
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brooklet.llm import ngram_join, substring, warc
from brooklet.llm.common import bloom_filter, bloom_hash, in_bloom, scratch

from .conftest import prose


def brute_removed(rows, window):
    """doc_id, n_words, n_removed, kept: a row's windows are held against those of smaller (doc_id, start, text hash)."""
    starts = defaultdict(list)
    words = [(t or "").encode().split() for _, t in rows]
    keys = [(-(1 << 63) if i is None else i, substring.copy_of((t or "").encode())) for i, t in rows]
    for r, w in enumerate(words):
        for k in range(len(w) - window + 1):
            starts[tuple(w[k : k + window])].append((keys[r][0], k, keys[r][1]))
    first = {g: min(s) for g, s in starts.items()}
    for r, (i, _) in enumerate(rows):
        w, gone = words[r], set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < (keys[r][0], k, keys[r][1]):
                gone.update(range(k, k + window))
        kept = [x for k, x in enumerate(w) if k not in gone]
        yield i, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()


@pytest.mark.parametrize("hot", [substring.HOT_ANCHOR, 1, 2])
def test_substring_is_brute_force(documents, none, rows, hot):
    got = sorted(map(tuple, substring.deduplicated(documents, hot=hot).collect()), key=str)
    assert got == sorted(brute_removed([(i, t) for i, t, _ in rows[0]], 20), key=str)
    least = documents.withColumn("doc_id", F.when(F.col("doc_id") == 1, F.lit(-(1 << 63))).otherwise(F.col("doc_id")))  # it sorts with null, and stays itself
    assert substring.deduplicated(least, hot=hot).where(F.col("doc_id") == -(1 << 63)).count() == 1
    assert substring.deduplicated(none, hot=hot).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_substring_on_few_words(spark, seed):
    """Two or three words only: periods, overlaps, repeats inside one piece."""
    r = random.Random(seed)
    rows = [(k, " ".join(r.choice("ab" if k % 3 else "abc") for _ in range(r.choice((3, 25, 60, 200))))) for k in range(25)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for hot in (substring.HOT_ANCHOR, 3):
        assert sorted(map(tuple, substring.deduplicated(d, 7, hot).collect())) == sorted(brute_removed(rows, 7))


def test_substring_on_families_of_near_copies(spark):
    """Edits 15 to 25 words apart: known windows cover all words of a piece while windows between them are new."""
    r, rows = random.Random(1), []
    for family in range(120):
        base = [f"f{family}w{k}" for k in range(34 if family % 2 else 90)]
        edits = [[25], [8], [], [5, 26]] if family % 2 else [list(np.cumsum([r.randrange(25), *(r.randint(15, 25) for _ in range(3))])) for _ in range(8)]
        for places in edits:
            rows.append((len(rows), " ".join(f"z{len(rows)}" if k in places else w for k, w in enumerate(base))))
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for hot in (substring.HOT_ANCHOR, 3):
        assert sorted(map(tuple, substring.deduplicated(d, hot=hot).collect())) == sorted(brute_removed(rows, 20))


def test_substring_on_a_line_that_many_share(spark, monkeypatch):
    """A line in every document, copies by the dozen: hot from the start, hot by count, or not."""
    monkeypatch.setattr(substring, "OFTEN", 5)
    line = prose(31, 27)
    rows = [(k, f"{prose(k, 9 + k % 30)} {line} {prose(k + 500, 30)}") for k in range(60)] + [(k, prose(77, 70)) for k in range(60, 90)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    wanted = sorted(brute_removed(rows, 20))
    for hot in (substring.HOT_ANCHOR, 25):
        assert sorted(map(tuple, substring.deduplicated(d, hot=hot).collect())) == wanted


def test_substring_leaves_spacing_and_columns(spark, documents, rows):
    out = substring.replaced(documents, 20).toPandas()
    assert list(out.columns) == documents.columns and 2 not in set(out.doc_id) and {4, 5, 6, 7} <= set(out.doc_id.dropna())
    ten = out[out.doc_id == 10].iloc[0]
    assert ten.text == prose(6, 30) and ten.n_chars == len(ten.text)
    assert out[out.doc_id == 16].iloc[0].text == dict((i, t) for i, t, _ in rows[0])[16]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), min_size=1, max_size=15), min_size=1, max_size=4))
def test_suffix_automaton(sequences):
    automaton = substring.SuffixAutomaton()
    inside = lambda part, whole: any(whole[k : k + len(part)] == part for k in range(len(whole) - len(part) + 1))
    for n, s in enumerate(sequences):
        before = sequences[:n]
        for at, got in enumerate(automaton.statistics(s)):
            assert got == max(k for k in range(at + 2) if not k or any(inside(s[at + 1 - k : at + 1], b) for b in before))
        for at, got in enumerate(automaton.add(s)):
            assert got == max(k for k in range(at + 2) if not k or any(inside(s[at + 1 - k : at + 1], b) for b in [*before, s[:at]]))


def brute_components(rows, n, num, den):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [(i, len(sets[k]), least.get(find(k)) if sets[k] else i) for k, (i, _) in enumerate(rows)]


def edited(seed, words, changes):
    r, out = random.Random(seed), list(words)
    for _ in range(changes):
        out[r.randrange(len(out))] = f"z{r.randrange(10**6)}"
    return " ".join(out)


@pytest.mark.parametrize(("n", "num", "den"), [(4, 85, 100), (5, 80, 100), (4, 95, 100)])
def test_components_are_brute_force(spark, n, num, den):
    """Stars of near copies on both sides of the threshold, chains, tiny sets, shared passages."""
    rows, k = [], 0
    for size in (6, 9, 13, 30, 47, 90, 200, 430):
        base = prose(size, size).split()
        for copy in range(12):
            rows.append((k := k + 1, edited(copy * 1000 + size, base, copy * size // 300 + copy % 2)))
        chain = base
        for step in range(5):
            chain = edited(step, chain, max(1, size // 60)).split()
            rows.append((k := k + 1, " ".join(chain).upper()))
        rows.append((k := k + 1, " ".join(base[: int(size * 0.9)])))
        rows.append((k := k + 1, " ".join(base[:40]) + " " + prose(k, size)))
    random.Random(1).shuffle(rows)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, ngram_join.jaccard_components(d, n, num, den).collect()))
    assert got == brute_components(rows, n, num, den)
    assert len({c for *_, c in got}) < len(rows) - 20


def test_components_with_small_tiles(spark, monkeypatch):
    """Blocks of a tile in tasks of their own give the same result."""
    monkeypatch.setattr(ngram_join, "TILE_SETS", 4)
    base = prose(5, 150).split()
    rows = [(k, edited(k, base, 5 + k % 4)) for k in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, ngram_join.jaccard_components(d).collect())) == brute_components(rows, 4, 85, 100)


def test_components_beyond_broadcast(spark, monkeypatch):
    """Where too many rows are wanted to be broadcast, a Bloom filter and joins give the same."""
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", 3)
    base = prose(6, 100).split()
    rows = [(k, edited(k, base, k % 6)) for k in range(30)] + [(k, prose(k, 90)) for k in range(30, 60)] + [(61, prose(31, 90))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, ngram_join.jaccard_components(d).collect())) == brute_components(rows, 4, 85, 100)


def test_components_edges(documents, none, rows):
    got = sorted(map(tuple, ngram_join.jaccard_components(documents).collect()), key=str)
    assert got == sorted(brute_components([(i, t) for i, t, _ in rows[0]], 4, 85, 100), key=str)
    assert ngram_join.jaccard_components(none).count() == 0


@pytest.mark.parametrize("most", [ngram_join.BROADCAST_ROWS, 3])
def test_components_bridged_by_null_ids(spark, monkeypatch, most):
    """Near copies without an id link two documents that do not link with each other."""
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", most)
    rows = []
    for family in range(6):
        base = prose(50 + family, 120).split()
        left, right = (" ".join("zz" if k in places else w for k, w in enumerate(base)) for places in ((20, 40), (70, 90)))
        rows += [(2 * family + 1, left), (None, " ".join(base)), (None, " ".join(base)), (2 * family + 2, right)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, ngram_join.jaccard_components(d).collect()), key=str)
    assert got == sorted(brute_components(rows, 4, 85, 100), key=str)
    assert all(c == 2 * ((i - 1) // 2) + 1 for i, _, c in got if i is not None)


def test_bounds_and_bloom(spark):
    r = np.random.default_rng(1)
    for _ in range(50):
        a, b = (np.unique(r.integers(0, 400, n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for n in (200, 230))
        x, y = ngram_join.folded([ngram_join.bitmap(a), ngram_join.bitmap(b)])
        assert ngram_join.overlap_bound(x, y, len(a), len(b)) >= len(np.intersect1d(a, b))
    keys = spark.range(0, 3000, 3)
    bloom = bloom_filter(keys, "id", 1000)
    rows = spark.range(3000).select("id", bloom_hash("id").alias("h")).toPandas()
    passed = set(rows.id[in_bloom(bloom, rows.h.to_numpy())])
    assert set(range(0, 3000, 3)) <= passed and len(passed) < 1300


def brute_records(rows):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    for i, _, h in rows:
        data, least = (h or "").encode(), first.get(h or "", i)
        yield i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if least == i else "revisit", None if least == i else least


@pytest.mark.parametrize(("plain", "level"), [(True, 0), (False, 0), (False, 6)])
def test_warc(spark, plain, level):
    """Payloads full of record starts, in files of many splits."""
    fake = "WARC/1.1\r\nContent-Length: 7\r\n\r\nxx"
    member = "\x1f\x08\x04" + "a" * 6 + "\x0c\x00SL\x08\x00" + " \x00\x00\x00" * 5
    rows = [(k, "http://x/\r\ny" if k % 3 else None, (fake * k if k % 2 else "same") if k % 5 else None) for k in range(40)]
    rows += [(3, "u", fake * 3), (None, "u", "same"), (None, None, "own"), (99, "ü", member * 9), (100, "u", "é" * 5000)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int").repartition(3)
    manifest = warc.write_archives(pages, scratch(spark, "warc-test"), plain=plain, level=level, file_bytes=3000)
    got = warc.read_archives(manifest, split_bytes=700).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == sorted(brute_records(rows), key=str)
    assert warc.op6(pages.where("false")).count() == 0


@pytest.mark.parametrize("most", [warc.BROADCAST_ROWS, 0])
def test_warc_with_many_equal_pages(spark, monkeypatch, most):
    """Repeated payloads by a broadcast, or dealt out several ways."""
    monkeypatch.setattr(warc, "BROADCAST_ROWS", most)
    rows = [(k, "u", None if k % 3 == 0 else "same" if k % 3 == 1 else f"own {k}") for k in range(200)] + [(None, "u", "none"), (None, None, "none")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("first", F.lit(1)).withColumn("salt", F.lit("x")).repartition(4)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.op6(pages).collect()), key=str)
    assert got == sorted(brute_records(rows), key=str)


def test_warc_of_other_writers(spark, tmp_path):
    """Other versions and types, no digest, no lengths of gzip members, headers longer than a read, payloads that look like records."""
    import gzip

    def other(kind, block, *fields):
        return b"WARC/1.0\r\n" + "".join(f"{x}\r\n" for x in (f"WARC-Type: {kind}", *fields, f"Content-Length: {len(block)}")).encode() + b"\r\n" + block + b"\r\n\r\n"

    http = "Content-Type: application/http; msgtype=response"
    page = b"<p>" + b"WARC/1.0\r\nContent-Length: 3\r\n\r\n" * 40 + gzip.compress(b"inner") + b"</p>"
    records = [
        other("warcinfo", b"software: x\r\n", "Content-Type: application/warc-fields"), other("request", b"GET / HTTP/1.1\r\n\r\n", "Content-Type: application/http; msgtype=request"),
        other("response", b"HTTP/1.1 200 OK\r\n\r\n" + page, http, "WARC-Record-ID: <urn:uuid:1>", "WARC-Target-URI: http://x/" + "a" * 200_000),
        other("revisit", b"HTTP/1.1 304 Not Modified\r\n\r\n", http, "WARC-Payload-Digest: sha1:ABC"), warc.record(7, "u", page, None, False), other("metadata", b""),
    ]
    (tmp_path / "a.warc").write_bytes(b"".join(records))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(r, 0 if k % 2 else 6) for k, r in enumerate(records)))
    files = [(str(p), p.stat().st_size, len(records)) for p in sorted(tmp_path.iterdir())]
    wanted = [("warcinfo", None, 13), ("request", None, 0), ("response", None, len(page)), ("revisit", None, None), ("response", 7, len(page)), ("metadata", None, 0)]
    for split in (500, 1 << 20):
        got = warc.read_archives(spark.createDataFrame(files, warc.MANIFEST), split_bytes=split).orderBy("path", "offset").collect()
        assert [(r.record_type, r.page_id, r.payload_bytes) for r in got] == wanted * 2
        assert got[3].payload_digest == "ABC" and got[2].payload_digest == warc.digest_of(page) == got[8].payload_digest


def test_warc_gzip_is_standard_and_broken_chains_raise(spark, tmp_path):
    import gzip

    data = warc.record(1, "u", b"hello", None, False)
    assert gzip.decompress(warc.member(data) + warc.member(data)) == data * 2
    fields, block = warc.parsed(data)
    assert fields["warc-type"] == "response" and block.endswith(b"hello") and fields["warc-payload-digest"] == "sha1:" + warc.digest_of(b"hello")
    (tmp_path / "a.warc.gz").write_bytes(warc.member(data) + b"junk" + warc.member(data))
    manifest = spark.createDataFrame([(str(tmp_path / "a.warc.gz"), (tmp_path / "a.warc.gz").stat().st_size, 2)], warc.MANIFEST)
    with pytest.raises(ValueError, match="chain"):
        warc.read_archives(manifest)


def test_pipeline(spark, documents, rows, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, rows[1])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    documents.write.parquet(str(tmp_path / "documents.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == documents.columns
        kept[name] = [r.doc_id for r in docs.collect()]
    first, second, third, fourth = kept.values()
    assert {4, 5, 6, 8, 23}.isdisjoint(first) and {1, 2, 3, 7, 9, 15} <= set(first)
    assert {2, 3}.isdisjoint(second) and {1, 9, 15} <= set(second) and second.count(17) == 1
    assert 15 in third and 15 not in fourth and {9, 14} <= set(fourth) and 1 in third and None not in second
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in out if r.doc_id is not None) == sorted(i for i in fourth if i is not None)
    assert [n for n, _ in corpus_pipeline.STAGES] == list(kept) + ["BPE encoding and decoding"]


def test_rows_of_a_repeated_id_are_judged_by_their_own_texts(spark):
    import corpus_pipeline

    base, other = prose(21, 100), prose(22, 100)
    near = lambda t: t + " tail"
    third, fourth = prose(23, 100), prose(24, 100)
    low, high = sorted((third, fourth))
    rows = [(1, low), (2, near(low)), (2, high), (3, near(high)), (4, base), (4, near(base)), (4, other), (4, other), (5, None), (5, None), (6, ""), (6, other), (None, base), (7, "one"), (None, None), (None, None), (None, " "), (None, prose(25, 80)), (None, near(prose(25, 80))), (None, prose(25, 80))]
    docs = spark.createDataFrame([(i, t, "en", "src", 9) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = sorted(((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()), key=str)
    wanted = [(1, low), (2, high), (4, base), (4, other), (5, None), (6, ""), (7, "one"), (None, None), (None, None), (None, " "), (None, prose(25, 80))]
    assert got == sorted(((i, t, "en", "src", 9) for i, t in wanted), key=str)


def test_language_stage_acts(spark):
    """Rows change, and rows go: labels are set, texts in no learned language and unwanted languages leave."""
    import corpus_pipeline

    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    blind = d.withColumn("lang", F.when(F.col("doc_id") % 4 != 0, F.col("lang")))
    extra = spark.createDataFrame([(-1, "Съешь же ещё этих мягких французских булок.", None), (-2, "0123 4567", None)], "doc_id long, text string, lang string")
    out = corpus_pipeline.identify_language(spark, blind.unionByName(extra, allowMissingColumns=True), "")
    assert out.where("lang is null or doc_id < 0").count() == 0 and out.count() >= 0.99 * d.where("rlike(text, '[a-z]')").count()
    changed = out.join(blind.select("doc_id", F.col("lang").alias("was")), "doc_id").where("not (lang <=> was)").count()
    assert changed >= 0.2 * d.count()


def test_stages_of_no_rows(spark, none, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, "some words of a benchmark item that nobody has")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, none, str(tmp_path))
        assert out.columns == none.columns and out.count() == 0
    assert corpus_pipeline.encode(spark, none, "").count() == 0


def test_registered(spark, small):
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names


@pytest.mark.parametrize(("num", "den"), [(85, 100), (80, 100), (70, 100)])
def test_few_unrelated_sets_share_a_signature(num, den):
    """Unrelated sets of any size meet next to never, and linked sets always do."""
    levels, r = ngram_join.Levels(num, den), np.random.default_rng(3)
    made = lambda n: np.unique(r.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
    for size in (6, 12, 40, 60, 134, 430, 1500):
        seen = Counter()
        for _ in range(400):
            seen.update(set(ngram_join.signatures(made(size), levels).tolist()))
        assert max(seen.values()) == 1
        for _ in range(60):
            a = made(size)
            both = -(-size * 2 * num // (num + den))  # the least overlap of two linked sets of this size
            b = np.sort(np.concatenate((r.permutation(a)[:both], made(size - both))))
            assert set(ngram_join.signatures(a, levels).tolist()) & set(ngram_join.signatures(b, levels).tolist())


def test_covered_windows_are_joined():
    seen = lambda *rows: substring.record(substring.SEEN, *np.array(rows, np.int64).reshape(-1, 4).T)
    assert len(substring.joined(seen(), 20)) == 0
    assert substring.joined(seen((7, 1, 0, 5), (8, 1, 0, 4), (9, 1, 0, 9), (9, 1, 3, 6), (9, 2, 0, 6)), 20).tolist() == [(1, 0, 4, 25), (1, 0, 9, 29), (1, 3, 6, 26), (2, 0, 6, 26)]
