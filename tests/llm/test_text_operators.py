"""Language, quality, BPE, token files, media and decontamination against brute force."""

import hashlib
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from brooklet.llm import bpe, decontamination, language, media, quality, token_files, tokens
from brooklet.llm.common import scratch

from .conftest import prose


def text_of(t):
    return t or ""


@pytest.fixture(scope="module")
def reference_ids(rows):
    library = tokens.loaded(tokens.default_path())
    return {t: library.encode(t, add_special_tokens=False).ids for t in {text_of(t) for _, t, _ in rows[0]}}


def test_bpe_is_the_library(documents, none, rows, reference_ids):
    library = tokens.loaded(tokens.default_path())
    got = sorted(map(tuple, bpe.op4(documents).drop("repaired_joins").collect()), key=str)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    wanted = [(i, len(ids := reference_ids[text_of(t)]), digest(" ".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False))) for i, t, _ in rows[0]]
    assert got == sorted(wanted, key=str)
    assert bpe.op4(none).count() == 0
    full = {(r.doc_id, tuple(r.ids), r.decoded) for r in bpe.encode_documents(documents).collect()}
    assert full == {(i, tuple(reference_ids[text_of(t)]), library.decode(reference_ids[text_of(t)], skip_special_tokens=False)) for i, t, _ in rows[0]}


def test_bpe_chunks_are_shared_and_joins_are_repaired():
    a, b = prose(1, 3000).encode(), prose(2, 500).encode()
    shared = set(bpe.chunks(a)) & set(bpe.chunks(b + b" " + a))
    assert b"".join(bpe.chunks(a)) == a and len(shared) >= len(bpe.chunks(a)) - 2

    class Greedy(bpe.ChunkEncoder):
        """Encodes each chunk wrongly at its start, so that every join must be repaired."""

        def _entries(self, texts):
            for t in texts:
                entry = next(super()._entries([t]))
                yield entry if t in (a, whole) else entry._replace(ids=b"\x01\0\0\0" + entry.ids)

    whole = a
    entries, repaired = Greedy(tokens.default_path()).encode([a])[0]
    assert repaired == len(bpe.chunks(a)) - 1 and b"".join(e.ids for e in entries) == tokens.encoded([a], tokens.default_path())[0]


def test_words_are_encoded_as_the_library_does():
    library = tokens.loaded(tokens.default_path())
    texts = ["", "İstanbul don.t a.. b,. J̌o ǅ K̸ ﬁ", "<|ENDOFTEXT|> <|endoftext|>x", "ÉCOLE, Straße. x y", "1234 a1b2 's 't"]
    got = tokens.encoded([t.encode() for t in texts], tokens.default_path())
    assert [np.frombuffer(g, np.uint32).tolist() for g in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_few_words_are_remembered_for_token_files(monkeypatch):
    path, sizes, plain = tokens.default_path(), [], tokens.encoded
    library = tokens.loaded(path)
    texts = [f"the the, once{k} once{k}x " + "of " * 20 for k in range(300)] + ["", "x" * 5000, "", "the last"]
    wanted = [library.encode(t, add_special_tokens=False).ids for t in texts]
    tokens._memory.clear()
    tokens._met.clear()
    monkeypatch.setattr(tokens, "SPARING_WORDS", 100)
    monkeypatch.setattr(tokens, "SPARING_BYTES", 2000)
    monkeypatch.setattr(tokens, "encoded", lambda some, *a: sizes.append([len(t) for t in some]) or plain(some, *a))
    for _ in range(2):  # in the second round, words come again
        got = tokens.encoded_sparingly([t.encode() for t in texts], path)
        assert [np.frombuffer(g, np.uint32).tolist() for g in got] == wanted
        assert len(tokens._memory[path]) <= 100 and {b"the", b"of"} <= set(tokens._memory[path])
    assert len(tokens._memory[path]) == 100
    assert all(sum(s) <= 2000 or len(s) == 1 for s in sizes) and sum(map(len, sizes)) == 2 * len(texts)
    assert list(tokens.encoded_sparingly([], path)) == []
    tokens._memory.clear()
    tokens._met.clear()


def test_list_of_token_files_stays_in_the_jvm(spark, monkeypatch, tmp_path):
    rows = [(k, f"w{k} of the") for k in range(40)]
    manifest = token_files.write_token_files(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path))
    made, create = [], spark.createDataFrame
    monkeypatch.setattr(spark, "createDataFrame", lambda *a, **b: made.append(create(*a, **b)) or made[-1])
    assert sorted(r.doc_id for r in token_files.read_token_files(spark, manifest).collect()) == list(range(40))
    assert made and not any("PythonRDD" in x._jdf.rdd().toDebugString() for x in made)


def test_token_files(spark, documents, none, rows, reference_ids):
    start, wanted = 0, []
    order = lambda t: np.uint64(xxhash.xxh64_intdigest(text_of(t).encode(), 42)).astype(np.int64)
    for i, t, _ in sorted(rows[0], key=lambda r: (r[0] is not None, r[0] or 0, order(r[1]))):
        ids = np.array([*reference_ids[text_of(t)], 2], "<u4")
        wanted.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = sorted(map(tuple, token_files.op2(documents).collect()), key=lambda r: r[1])
    assert got == wanted
    assert token_files.op2(none).count() == 0


def test_token_file_blocks_round_trip(spark, tmp_path):
    ids = np.random.default_rng(1).integers(0, 50_000, 200_000).astype("<u4")
    with open(tmp_path / "x.ids", "wb") as f:
        writer = token_files.Writer(f)
        for k in range(0, 200_000, 7000):
            writer.add(k, ids[k : k + 7000].tobytes())
        writer.close()
    reader = token_files.Reader(str(tmp_path / "x.ids"))
    assert b"".join(x for _, _, x in reader.documents()) == ids.tobytes()
    assert reader.block(2) == ids[2 << 16 : 3 << 16].tobytes()
    (tmp_path / "bad").write_bytes(b"x" * 100)
    with pytest.raises(ValueError, match="no token file"):
        token_files.Reader(str(tmp_path / "bad"))


def brute_language(rows, most=language.PROFILE_GRAMS):
    def grams(text):
        words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
        return Counter(p[k : k + n] for w in words for n in (1, 2, 3) for p in [f" {w} "] for k in range(len(p) - n + 1) if p[k : k + n] != " ")

    code = lambda g: sum(ord(c) << 21 * k for k, c in enumerate(reversed(g)))
    rank = lambda c: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], code(x[0])))[:most]]
    profiles = {}
    for i, t, g in rows:
        if t is not None and g is not None and (i is None or zlib.crc32(str(i).encode()) % 4 != 2):
            profiles.setdefault(g, Counter()).update(grams(t))
    profiles = {g: {x: k for k, x in enumerate(rank(c))} for g, c in profiles.items()}
    for i, t, _ in rows:
        own = rank(grams(t))
        cost = {g: sum(abs(p[x] - k) if x in p else most for k, x in enumerate(own)) for g, p in profiles.items()}
        yield i, i is not None and zlib.crc32(str(i).encode()) % 4 == 2, min(sorted(cost), key=cost.get) if own else "und"


def test_language_is_brute_force(documents, none, rows):
    got = language.op3(documents).collect()
    assert sorted(((r.doc_id, r.held_out, r.lang_pred) for r in got), key=str) == sorted(brute_language(rows[0]), key=str)
    assert all(0 <= r.score <= 1 and 0 <= r.similarity <= 1 for r in got)
    assert language.op3(none).count() == 0
    kept = language.filtered(documents, language.fitted(documents)).toPandas()
    assert list(kept.columns) == documents.columns and {4, 5, 6, 8, 23}.isdisjoint(kept.doc_id.dropna()) and {1, 14} <= set(kept.doc_id.dropna())
    assert language.filtered(none, language.fitted(documents)).count() == 0 and language.filtered(documents, language.fitted(none)).count() == 0
    assert {r.lang_pred for r in language.op3(documents.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_filter_acts(spark):
    """Labels that are wrong or missing are set; what is in no learned language goes, as do languages that aren't wanted."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 400")
    profiles = language.fitted(d)
    wrong = d.withColumn("lang", F.when(F.col("doc_id") % 3 == 0, F.lit(None).cast("string")).otherwise(F.lit("xx")))
    strange = ["Съешь же ещё этих мягких французских булок. " * 9, hashlib.sha512(b"x").hexdigest() * 9, "人人生而自由在尊严和权利上一律平等 " * 9, "12345 67890 !!! " * 30]
    extra = spark.createDataFrame([(-k - 1, t, "en") for k, t in enumerate(strange)], "doc_id long, text string, lang string")
    kept = language.filtered(wrong.unionByName(extra, allowMissingColumns=True), profiles)
    assert kept.columns == d.columns
    pair = kept.join(d.select("doc_id", F.col("lang").alias("own")), "doc_id").selectExpr("count(*) n", "avg(int(lang = own)) a").first()
    assert kept.where("doc_id < 0").count() == 0 and pair.n == d.count() and pair.a > 0.98
    assert {r.lang for r in language.filtered(d, profiles, languages=["de"]).select("lang").distinct().collect()} == {"de"}


def test_language_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = language.op3(d).where("held_out").join(d, "doc_id").selectExpr("avg(int(lang = lang_pred)) a").first()
    assert held.a > 0.98


def test_quality_held_out_accuracy_and_edges(spark, documents, none):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.op7(d, labels).join(labels, "doc_id").where("held_out").toPandas()
    rank, ones = rows.score.rank(), (rows.quality == 1)
    auc = (rank[ones].sum() - ones.sum() * (ones.sum() + 1) / 2) / (ones.sum() * (~ones).sum())
    assert auc > 0.97 and (rows.predicted == rows.quality).mean() > 0.97
    few = spark.createDataFrame([(1, 1, 0), (2, 0, None), (None, 1, 0), (9, None, 1)], "doc_id long, quality int, toxic int")
    got = quality.op7(documents, few).collect()
    assert len(got) == documents.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert quality.op7(none, few).count() == 0 and {r.score for r in quality.op7(documents, few.where("false")).collect()} == {0.5}


def test_quality_is_brute_force(spark, documents):
    """Pooling and the network in plain Python, number by number, with repeated doc_ids, conflicting and repeated labels."""
    from math import exp, tanh

    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (7, 1, 0), (9, 1, 0), (9, 1, 0), (10, 0, 1), (11, 0, 0), (12, 0, 1), (14, 1, 0), (17, 1, 0), (18, 0, 0), (20, 1, 0), (20, 0, 0), (21, 0, 0), (16, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fitted(documents, labels)
    assert model.layers is not None and model.prior == 0.5
    mean, spread, w1, b1, w2, b2 = (x.tolist() for x in model.layers)

    def vector(term):
        if term in model.vectors:
            return model.vectors[term].astype(float).tolist()
        own = quality.index_vector(term).astype(float).tolist()
        size = sum(x * x for x in own) ** 0.5
        return [x / size for x in own] if size else own

    def score(text):
        words = text_of(text).encode().split()
        total, before = [0.0] * quality.DIMENSIONS, None
        for w in words:
            for t in quality.terms(w) + ([quality.AGAIN] if w == before else []):
                total = [a + b for a, b in zip(total, vector(t), strict=True)]
            before = w
        z = [(t / max(1, len(words)) - m) / s for t, m, s in zip(total, mean, spread, strict=True)]
        h = [tanh(sum(z[k] * w1[k][j] for k in range(len(z))) + b1[j]) for j in range(len(b1))]
        return 1 / (1 + exp(-max(-30.0, min(30.0, (sum(a * b for a, b in zip(h, w2, strict=True)) + b2[0]) / model.temperature))))

    got = quality.scored(documents, model).join(documents.select("doc_id", "text"), "doc_id").collect()
    assert got and all(any(abs(score(t) - r.score) < 1e-5 for t in [x.text for x in got if x.doc_id == r.doc_id]) for r in got)
    fewer = quality.fitted(documents, labels, sample_rows=2, sample_bytes=1000)
    assert all(0 <= r.score <= 1 for r in quality.scored(documents, fewer).collect())


def test_quality_terms():
    assert quality.terms(b"Word,") == [b"word", b","] and quality.terms(b"|") == [b"|"] and quality.terms(b"--A.b-c!!") == [b"--", b"a.b-c", b"!!"]
    x = quality.temperature(np.array([4.0, -4.0, 4.0, 4.0]), np.array([1.0, 0.0, 1.0, 0.0]))
    assert x > 1.5


def test_media(documents, none, rows):
    got = {(r.doc_id, r.n_bytes, r.payload_sha256): r for r in media.op10(documents).collect()}
    for i, t, _ in rows[0]:
        data = text_of(t).encode()
        padded = data.ljust(max(1, -(-len(data) // 192)) * 192, b" ")
        r = got[i, len(data), hashlib.sha256(padded).hexdigest()]
        stream = media.mux(padded)
        assert (r.payload_bytes, r.tail_crc32, r.media_bytes, r.media_sha256) == (len(padded), zlib.crc32(padded[-16:]), len(stream), hashlib.sha256(stream).hexdigest())
        assert r.units == -(-len(padded) // media.UNIT_BYTES) and r.random_access_pts == [k * media.TICKS for k in range(0, r.units, media.GROUP)]
        assert "discontinuities=0;bad_sections=0" in r.feature
    assert media.op10(none).count() == 0


def test_media_faults():
    stream = media.mux(bytes(range(256)) * 60)
    assert media.demux(stream)["payload"] == bytes(range(256)) * 60
    assert media.demux(media.mux(b""))["payload"] == b""
    lost = media.demux(stream[: 188 * 9] + stream[188 * 10 :])
    assert lost["discontinuities"] == 1
    broken = bytearray(stream)
    broken[20] ^= 1  # inside the association table, so that the tables can't be trusted
    with pytest.raises(ValueError):
        media.demux(bytes(broken))
    with pytest.raises(ValueError):
        media.demux(stream[:-1])


def brute_contaminated(rows, items):
    """Every window of every item at every place of every text."""
    for i, t, _ in rows:
        own = decontamination.tokens(text_of(t).encode())[0].tolist()
        for item, text in items:
            seq = decontamination.tokens(text_of(text).encode())[0].tolist()
            width = min(decontamination.WINDOW, len(seq))
            share = decontamination.LEAST_SHARE if len(seq) >= 7 else 1.0
            if width and any(sum(a == b for a, b in zip(own[p : p + width], seq[q : q + width], strict=True)) >= share * width for p in range(len(own) - width + 1) for q in range(len(seq) - width + 1)):
                yield i, item


def test_decontamination(spark, documents, none, rows):
    swapped = rows[1].split()
    for k in range(4, 30, 5):
        swapped[k] = "other"
    items = [(1, rows[1]), (2, " ".join(swapped).upper()), (3, None), (4, ""), (5, "w1 w2 w3"), (6, prose(77, 40)), (7, rows[1])]
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(0))
    wanted = sorted(brute_contaminated(rows[0], items), key=str)
    got = decontamination.contaminated(documents, benchmark).collect()
    assert sorted(((r.doc_id, r.item_id) for r in got), key=str) == wanted and {(15, 1), (15, 2), (15, 7)} <= set(wanted)
    assert all(r.overlap >= 0.75 for r in got) and all((r.from_word, r.to_word) == (40, 70) for r in got if (r.doc_id, r.item_id) == (15, 1))
    blocks = decontamination.contaminated(documents, benchmark, block_bytes=150).collect()
    assert sorted(map(tuple, blocks), key=str) == sorted(map(tuple, got), key=str)
    several = decontamination.decontaminated(documents, benchmark, block_bytes=150)
    clean = decontamination.decontaminated(documents, benchmark)
    assert several.columns == clean.columns and sorted(map(tuple, several.collect()), key=str) == sorted(map(tuple, clean.collect()), key=str)
    assert clean.columns == documents.columns and clean.count() == documents.count() - len({i for i, _ in wanted})
    assert decontamination.contaminated(none, benchmark).count() == 0 and decontamination.contaminated(documents, benchmark.where("false")).count() == 0


def test_one_word_texts_and_items(monkeypatch):
    """A text and an item of one repeated word: as many diagonals as words, however few hits are held at once."""
    index = decontamination.Index([(1, "la " * 3000), (2, "la lo " * 30)])
    wanted = index.matches([b"la " * 5000, b"lo la " * 40, b"lo " * 50])
    assert [k for k, *_ in wanted[0]] == [0] and [k for k, *_ in wanted[1]] == [1] and set(wanted) == {0, 1}
    monkeypatch.setattr(decontamination, "HITS", 100)
    assert index.matches([b"la " * 5000, b"lo la " * 40, b"lo " * 50]) == wanted


def test_masks_find_substitutions():
    r = np.random.default_rng(5)
    index = decontamination.Index([(1, prose(3, 40))])
    words = prose(3, 40).split()
    found = 0
    for _ in range(300):
        changed = words[10:30]
        for k in r.choice(20, 5, replace=False):
            changed[k] = "zzz"
        found += bool(index.matches([(prose(99, 10) + " " + " ".join(changed)).encode()]))
    assert found >= 297


def test_excerpts_cut_by_the_ends_of_a_document():
    """15 to 19 tokens of an item that are a whole document, its end or its beginning; 14 are too few."""
    item, other = prose(3, 40).split(), prose(99, 30).split()
    index = decontamination.Index([(1, " ".join(item))])
    for n in (14, 15, 17, 19):
        texts = [item[10 : 10 + n], item[:n], item[-n:], other + item[:n], item[-n:] + other, other + item[10 : 10 + n] + other]
        got = index.matches([" ".join(t).encode() for t in texts])
        assert sorted(got) == (list(range(6)) if n >= 15 else [])
        places = [(0, n), (0, n), (0, n), (30, 30 + n), (0, n), (30, 30 + n)]
        for k, found in got.items():
            ((_, share, begin, end),) = found
            assert share >= n / 20 and begin <= places[k][0] and end >= places[k][1] and 0 <= begin and end <= len(texts[k])


@pytest.mark.parametrize("length", range(7, 21))
def test_masks_leave_no_pattern_out(length):
    """Every way of replacing a quarter of a window's tokens, by length of item."""
    words = [f"w{k}" for k in range(length)]
    index = decontamination.Index([(1, " ".join(words))])
    texts = [" ".join("zzz" if k in gone else w for k, w in enumerate(words)).encode() for gone in combinations(range(length), length // 4)]
    assert sorted(index.matches(texts)) == list(range(len(texts)))


def test_scratch_is_shared(spark):
    assert scratch(spark, "x").startswith("file://" + spark.conf.get("spark.checkpoint.dir") + "/x-")
