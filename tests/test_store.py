"""The store's tools over a log on disk."""

from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from brooklet.functions import embedders
from brooklet.operators import consolidate, ingest, search
from brooklet.plans.store import Store
from brooklet.schema import EmbeddingError, InvalidTierError, NotFoundError, StoreError
from brooklet.sources import files
from brooklet.streaming import streams

DAY = 86_400.0


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "log"))


def items(spark, *contents, **more):
    rows = [(k, c, *more.values()) for k, c in enumerate(contents)]
    return spark.createDataFrame(rows, "position long, content string" + "".join(f", {k} string" for k in more))


def state(store):
    return {r.id: r for r in store.memories().collect()}


def test_remember_update_history(spark, store):
    with pytest.raises(ValueError):
        store.remember("  ", 1.0)
    with pytest.raises(InvalidTierError):
        store.remember("x", 1.0, "nope")
    first = store.remember("Always use port 8080", 1.0, "core", ["x"], "me", "agent/alice")
    again = store.remember("Always use port 8080", 2.0, "core", namespace="agent/alice")
    assert again["deduplicated"] and again["id"] == first["id"] and state(store)[1].updated_at == 2.0
    new = store.update_memory(first["id"], "Always use port 9090", 3.0)
    assert [(r.id, r.archived) for r in store.history(first["id"]).collect()] == [(new["id"], False), (first["id"], True)] == [(r.id, r.archived) for r in store.history(new["id"]).collect()]
    kept = state(store)[new["id"]]
    assert (kept.tier, kept.namespace, kept.source, kept.tags, kept.supersedes) == ("core", "agent/alice", "", ["x"], first["id"])
    assert store.history(99).count() == 0
    with pytest.raises(NotFoundError):
        store.update_memory(99, "x", 4.0)
    # quirk 10: after an archive the same text is stored once, and found again
    third = store.remember("Always use port 8080", 5.0, "core", namespace="agent/alice")
    assert not third["deduplicated"] and store.remember("Always use port 8080", 6.0, "core", namespace="agent/alice")["id"] == third["id"]


def test_recall_and_access(spark, store):
    store.remember_batch(items(spark, "zebra stripes are black", "zebra food is grass", "the moon is far", "zebra stripes are black"), 1.0)
    assert len(state(store)) == 3
    hits = store.recall({0: "zebra stripes", 1: "moon"}, 10.0, limit=2)
    rows = hits.collect()
    assert [r.id for r in rows if r["query"] == 0][0] == 1 and all(rows[k].score >= rows[k + 1].score for k in range(len(rows) - 1) if rows[k]["query"] == rows[k + 1]["query"])
    assert state(store)[1].access_count == 0  # a read changes nothing
    store.note_access(hits, 11.0)
    assert state(store)[1].access_count >= 1 and state(store)[1].last_accessed == 11.0
    odd = ['"test" (content) {special}', "'; DROP TABLE x; --", "", "привет 日本 😀", "nonsense_qqq"]
    assert store.recall(dict(enumerate(odd)), 12.0).count() >= 0
    shout = store.recall({0: "луна"}, 12.0, translate=lambda q: "moon").collect()
    assert shout[0].id == 3


def test_batches(spark, store):
    """Quirk 11: blank contents stop a batch; equal texts in two namespaces are two memories with their own entities."""
    assert store.remember_batch(items(spark, "same text @bob", "same text @bob", namespace="a"), 1.0) == {"imported": 1, "deduplicated": 1, "embedded": 1}
    assert store.remember_batch(items(spark, "same text @bob", "other", namespace="b"), 2.0)["imported"] == 2
    assert store.related("@BOB").count() == 2 and store.related("@bob", namespace="b").count() == 1
    assert [(r.name, r.memory_count) for r in store.entity_counts("mention").collect()] == [("@bob", 2)]
    with pytest.raises(Exception, match="blank content"):
        store.remember_batch(items(spark, "fine", " "), 3.0)
    assert len(state(store)) == 3 and store.remember_batch(items(spark, "x").where("false"), 4.0)["imported"] == 0


def test_retention(spark, store):
    now = 400 * DAY
    store.remember_batch(items(spark, "old learned", tier="learned"), now - 100 * DAY)
    store.remember_batch(items(spark, "old core", tier="core"), now - 100 * DAY)
    store.remember_batch(items(spark, "old rule", tier="procedural"), now - 200 * DAY)
    store.remember_batch(items(spark, "old work", tier="working", namespace="n"), now - 2 * DAY)
    assert store.compact(now, dry_run=True)["archived"] == 1 and not state(store)[1].archived
    assert store.compact(now)["archived"] == 1 and state(store)[1].archived and state(store)[1].updated_at == now - 100 * DAY
    assert store.cleanup_working(now - 2 * DAY + 86_400) == 0 and store.cleanup_working(now) == 1  # strictly older
    assert store.unarchive(1, now)["unarchived"] and store.unarchive(1, now)["reason"] == "not archived"
    assert store.forget(1, now, "elsewhere")["reason"] == "namespace mismatch" and store.forget(1, now)["forgotten"]
    assert store.get_procedures() == "## Agent Rules (from memory)\n- old rule" and store.get_procedures("zzz") == ""
    row = store.stats().first()
    assert (row.total, row.archived, row.by_tier) == (2, 2, {"core": 1, "procedural": 1})


def test_states_and_today(spark, store):
    a = store.save_state("step 1", 10 * DAY + 5)
    b = store.save_state("step 2", 10 * DAY + 6)
    assert state(store)[a["id"]].archived and [r.id for r in store.today(10 * DAY + 50).collect()] == [b["id"]] and store.today(11 * DAY).count() == 0


@pytest.mark.parametrize("exact", [100, 0])
def test_consolidate(spark, store, exact):
    """Quirk 15: a merged text stays in its group's namespace."""
    store.remember_batch(items(spark, "the quick brown fox jumps over the lazy dog", "the quick brown fox jumps over the lazy dogs", "entirely different words in here", namespace="ns"), 1.0)
    assert store.consolidate(2.0, 0.8, dry_run=True, exact_up_to=exact)["groups"] == 1 and not any(r.archived for r in state(store).values())
    done = store.consolidate(2.0, 0.8, exact_up_to=exact)
    assert (done["groups"], done["archived"]) == (1, 1) and state(store)[1].archived and state(store)[2].supersedes == 1
    store.remember_batch(items(spark, "the quick brown fox jumps over the lazy dogs!", namespace="ns"), 3.0)
    store.consolidate(4.0, 0.8, merge=lambda ms: " + ".join(sorted(m["content"] for m in ms)), exact_up_to=exact)
    merged = [r for r in state(store).values() if " + " in r.content]
    assert len(merged) == 1 and merged[0].namespace == "ns" and merged[0].supersedes in (2, 4)


def test_conversation(spark, store, tmp_path):
    """Quirk 13: the ids are those that were inserted."""
    (tmp_path / "c.json").write_text('{"messages":\n [{"role": "user", "content": "We decided to use Postgres now."}, {"role": "user", "content": null}, {"role": "assistant", "content": "WE DECIDED TO USE POSTGRES NOW."}]}')
    messages = files.conversation(spark, str(tmp_path / "c.json"))
    done = store.process_conversation(messages, 1.0)
    assert done["extracted"] == 1 and done["by_type"] == {"decisions": 1} and [r.id for r in done["memories"].collect()] == [1]
    assert state(store)[1].tags == ["decisions", "auto-extracted"] and state(store)[1].tier == "episodic"
    (tmp_path / "d.json").write_text('[{"role": "user", "content": "x"}]')
    assert files.conversation(spark, str(tmp_path / "d.json")).first().content == "x"


def test_markdown_in_and_out(spark, store, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.md").write_text("## One\n\nA paragraph that is long enough to stay.")
    (tmp_path / "in" / "deep" / "b.md").write_text("## Two\n\nAnother paragraph that is long enough.")
    (tmp_path / "in" / "c.txt").write_text("not markdown, whatever is in it")
    assert store.import_markdown(str(tmp_path / "in"), 1.0)["imported"] == 2 and store.import_markdown(str(tmp_path / "in"), 2.0)["deduplicated"] == 2
    assert "not found" in store.import_markdown(str(tmp_path / "none"), 1.0)["error"]
    assert [(r.id, r.source) for r in store.memories().orderBy("id").collect()] == [(1, "a.md"), (2, "b.md")]
    store.remember("A core fact", 3.0, "core")
    files.write_markdown(store.export_markdown(), str(tmp_path / "out"))
    text = "\n".join(p.read_text().removesuffix("\n") for p in sorted((tmp_path / "out").glob("part-*")) if p.stat().st_size)
    assert text.startswith("# Agent Memory Export\n\n\n## Core\n\nA core fact\n") and text.count("## Learned") == 1 and "<!-- source: a.md -->\n## One" in text


def test_log(spark, store):
    store.remember("one fact to keep", 1.0)
    store.forget(1, 2.0)
    before = state(store)
    store.compacted()
    assert state(store) == before and store._commits() == [1]
    store.unarchive(1, 3.0)
    assert not state(store)[1].archived and store._commits() == [1, 2]
    assert store.dispatch("stats", {}).first().total == 1
    with pytest.raises(StoreError):
        store.dispatch("drop", {})


def sizes(rows):
    """An embedder of two numbers."""
    return rows.select("id", F.array(F.length("content").cast("double"), F.lit(1.0)).alias("embedding"))


def test_own_embedder(spark, tmp_path):
    """It makes the stored vectors and those of the queries."""
    own = Store(spark, str(tmp_path / "log"), embed=sizes)
    own.remember_batch(items(spark, "aaaa", "bbbb", "c" * 400), 1.0)
    assert own.consolidate(2.0, 0.9999)["groups"] == 1
    hits = own.recall({0: "d" * 300}, 3.0, recency_weight=0.0).collect()
    assert hits[0].id == 3 and own.derived("vectors").where("id = 3").first().embedding == [400.0, 1.0]


def test_a_failing_embedder_stores_nothing(spark, tmp_path):
    def broken(rows):
        return rows.select("id", F.raise_error(F.lit("no model")).cast("array<float>").alias("embedding"))

    store = Store(spark, str(tmp_path / "log"), embed=broken)
    with pytest.raises(EmbeddingError, match="no model"):
        store.remember_batch(items(spark, "some text @bob"), 1.0)
    assert store.memories().count() == 0 and store.entities().count() == 0 and store._commits() == [-1]
    whole = Store(spark, str(tmp_path / "log"))
    assert whole.remember("some text @bob", 2.0)["id"] == 1 and whole.entity_counts("mention").count() == 1


def test_null_embedder_searches_by_keywords(spark, tmp_path):
    store = Store(spark, str(tmp_path / "log"), embed="null")
    done = store.remember("zebra stripes are black", 1.0)
    assert not done["embedded"] and [r.id for r in store.recall({0: "zebra"}, 2.0).collect()] == [1] and store.recall({0: "moon"}, 2.0).count() == 0
    with pytest.raises(EmbeddingError):
        store.remember("another zebra", 3.0) and store.consolidate(4.0)


def test_embedders_by_name(spark, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    assert embedders.embedder("null") is None and embedders.embedder("hash", 64).dim == 64 and embedders.embedder("whatever").dim == 128 and isinstance(embedders.embedder("auto"), embedders.HashEmbedder)
    with pytest.raises(EmbeddingError):
        embedders.embedder("static")
    library = Tokenizer(models.WordLevel({"red": 0, "fox": 1, "[UNK]": 2}, unk_token="[UNK]"))
    library.pre_tokenizer = pre_tokenizers.Whitespace()
    library.save(str(tmp_path / "tokenizer.json"))
    np.save(tmp_path / "vectors.npy", np.array([[1, 0, 0], [0, 1, 0], [0, 0, 2]], np.float32))
    lazy = embedders.embedder("static", folder=str(tmp_path))
    assert not lazy.loaded and lazy.dim == 3 and lazy.loaded
    rows = spark.createDataFrame([(1, "red fox"), (2, "red red"), (3, ""), (4, None)], "id long, content string")
    got = {r.id: [round(x, 4) for x in r.embedding] for r in lazy(rows).collect()}
    assert got == {1: [0.7071, 0.7071, 0], 2: [1, 0, 0], 3: [0, 0, 0], 4: [0, 0, 0]}
    known = embedders.LazyEmbedder(lambda: embedders.StaticEmbedder(str(tmp_path)), 3)
    assert known.dim == 3 and not known.loaded
    store = Store(spark, str(tmp_path / "log"), embed=lazy)
    store.remember_batch(items(spark, "red fox", "blue sea"), 1.0)
    assert store.stats().first().bytes_per_vector == 12 and store.recall({0: "fox"}, 2.0).first().id == 1


def test_stored_search_is_search_of_the_texts(spark, store, small):
    """The index and vectors that commits keep give what is made of the texts for a call, over several commits and a base."""
    documents = spark.read.parquet(f"{small}/documents.parquet").where("length(text) > 5")
    chosen = documents.select(F.col("doc_id").alias("position"), F.col("text").alias("content"), "source", F.array("lang").alias("tags"))
    for part in range(3):
        store.remember_batch(chosen.where(F.col("position") % 3 == part), 1.0)
    asked = {1: "general public license", 2: "the password token of onerth", 3: "ouaux", 4: ""}
    fresh = {tuple(r) for r in search.recall(store.memories(), asked, 50.0).collect()}
    close = lambda rows: {(r["query"], r["id"], round(r["score"], 3)) for r in rows}
    names = ("query", "id", "content", "tier", "source", "score", "method", "importance")
    wanted = close([dict(zip(names, r, strict=True)) for r in fresh])
    assert len(wanted) >= 15 and close(r.asDict() for r in store.recall(asked, 50.0).collect()) == wanted
    store.compacted()
    assert close(r.asDict() for r in store.recall(asked, 50.0).collect()) == wanted and store.vacuum() >= 12
    store.remember("one more about a public license", 2.0)
    assert close(r.asDict() for r in store.recall(asked, 50.0).collect()) == close(r.asDict() for r in search.recall(store.memories(), asked, 50.0).collect())
    plan = search.occurrences(store.derived("postings"), {1: search.phrases("license")})._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "StringStartsWith(token,license)" in plan


def test_large_batches_keep_every_row(spark, tmp_path):
    """200,000 rows: ids are dense and distinct, in the order of position, whatever the ranges."""
    rows = spark.range(200_000).select((F.col("id") * 7919 % 200_003).alias("position"), F.concat(F.lit("fact "), F.col("id")).alias("content"))
    new = ingest.numbered(ingest.prepared(rows), 11, 1.0)
    assert tuple(new.agg(F.count("id"), F.countDistinct("id"), F.min("id"), F.max("id")).first()) == (200_000, 200_000, 11, 200_010)
    both = new.join(rows.withColumn("wanted", 11 + F.row_number().over(Window.orderBy("position")) - 1), "content")
    assert both.where("id <> wanted").count() == 0
    store = Store(spark, str(tmp_path / "log"), embed="null")
    assert store.remember_batch(rows, 1.0)["imported"] == 200_000 and store.remember_batch(rows.where("position < 1000"), 2.0) == {"imported": 0, "deduplicated": rows.where("position < 1000").count(), "embedded": 0}
    assert tuple(store.memories().agg(F.count("id"), F.countDistinct("id"), F.max("id")).first()) == (200_000, 200_000, 200_000)


def test_equal_positions_are_numbered(spark):
    rows = spark.range(5000).select(F.lit(3).alias("position"), F.col("id").cast("string").alias("content"))
    got = ingest.numbered(ingest.prepared(rows), 1, 1.0).agg(F.countDistinct("id"), F.max("id")).first()
    assert tuple(got) == (5000, 5000)


def test_one_writer_at_a_time(spark, store, monkeypatch):
    from brooklet.plans import store as module

    other = Store(spark, store.path)
    with store._turn():
        monkeypatch.setattr(module, "PATIENCE", 0.5)
        with pytest.raises(StoreError, match="another writer"):
            other.remember("while another writes", 1.0)
    monkeypatch.setattr(module, "PATIENCE", 120.0)
    with ThreadPoolExecutor(4) as pool:
        done = list(pool.map(lambda k: Store(spark, store.path).remember(f"text number {k}", 1.0)["id"], range(4)))
    assert sorted(done) == [1, 2, 3, 4] and store.memories().count() == 4
    fs, path = store._fs(f"{store.path}/_writer")
    fs.create(path, False).close()  # of a writer that died
    monkeypatch.setattr(module, "LEASE", -1.0)
    assert store.remember("after a crash", 2.0)["id"] == 5


def test_commits_are_compacted_by_themselves(spark, tmp_path):
    store = Store(spark, str(tmp_path / "log"), embed="null", compact_every=2)
    for k in range(5):
        store.remember(f"text number {k}", float(k))
    assert len(store._commits()) <= 3 and store._commits()[0] >= 2 and store.memories().count() == 5 and store.recall({0: "text"}, 9.0).count() == 5


@pytest.mark.parametrize("length", [150, 1000])
def test_long_chains_and_cycles(spark, length):
    from brooklet.operators import history

    columns = "id long, supersedes long, content string, created_at double, archived boolean"
    rows = [(k, k - 1 if k else None, f"v{k}", float(k), k < length - 1) for k in range(length)] + [(5000, 5002, "a", 1.0, False), (5001, 5000, "b", 2.0, False), (5002, 5001, "c", 3.0, False)]
    memories = spark.createDataFrame(rows, columns)
    got = history.history(memories, spark.createDataFrame([(0, length // 2), (1, 5001)], "query long, id long")).orderBy("query", "position").collect()
    assert [r.id for r in got if r["query"] == 0] == list(range(length - 1, -1, -1)) and sorted(r.id for r in got if r["query"] == 1) == [5000, 5001, 5002]


def test_lsh_finds_near_vectors(spark):
    """Recall against all pairs on the embeddings of documents, and a band that holds thousands."""
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    vectors = embedders.embedder("hash")(documents).cache()
    exact = consolidate.exact_pairs(vectors, 0.9)
    roots = {r.id: r.root for r in consolidate.components(consolidate.lsh_pairs(vectors, 0.9, 128)).collect()}
    pairs = exact.collect()
    assert len(pairs) > 20 and sum(a in roots and roots[a] == roots.get(b) for a, b in pairs) >= 0.9 * len(pairs)
    same = spark.range(3000).select("id", F.array(F.lit(1.0), F.lit(2.0), (F.col("id") / 3e5).cast("double")).alias("embedding"))
    found = consolidate.lsh_pairs(same, 0.99, 3)
    assert found.count() < 16 * 3000 * 8 and consolidate.components(found).select("root").distinct().count() == 1
