"""Functions against plain Python and, for keyword search, SQLite's own index."""

import hashlib
import math
import random
import re
import sqlite3
import struct

import pytest
from pyspark.sql import functions as F

from brooklet.functions import classify, extraction, markdown, text, vectors
from brooklet.functions.entities import entities
from brooklet.functions.importance import importance
from brooklet.operators import consolidate, search
from brooklet.schema import InvalidTierError, checked_tier, decoded_tags, encoded_tags, in_namespace, normalize_legacy


def column(spark, values, expression, name="v", kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, {name} {kind}")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col(name))).collect()]


def test_namespaces_match_whole_segments_and_case(spark):
    """Quirk 1: one rule, case-sensitive, on every path."""
    names = ["agent", "agent/alice", "agents", "AGENT/x", "a%/b", "a_/c", "axb/d", ""]
    assert column(spark, names, lambda c: in_namespace(c, "agent")) == [True, True, False, False, False, False, False, False]
    assert column(spark, names, lambda c: in_namespace(c, "a%")) == [False] * 4 + [True] + [False] * 3
    assert all(column(spark, names, lambda c: in_namespace(c, None)))


def test_tiers_and_tags(spark):
    """Quirk 2: an unknown tier raises everywhere."""
    with pytest.raises(InvalidTierError):
        checked_tier("nope")
    assert column(spark, ['["a", " b "]', "a, b,,c ", "", None], lambda c: decoded_tags(c)) == [["a", "b"], ["a", "b", "c"], [], []]
    assert column(spark, [["a", "b"], []], lambda c: encoded_tags(c), kind="array<string>") == ["a,b", ""]


def test_legacy_rows(spark):
    old = spark.createDataFrame([(1, "x", "core", '["t"]', 5.0)], "id long, content string, tier string, tags string, created_at double")
    row = normalize_legacy(old).first()
    assert (row.tier, row.tags, row.namespace, row.archived, row.importance) == ("core", ["t"], "", False, 0.5) and row.content_hash == hashlib.sha256(b"x").hexdigest()[:16]


def test_sizes(spark):
    assert column(spark, [0.0, 1023.0, 1024.0, 5e6, 3e9, 5e13], lambda c: text.human_size(c), kind="double") == ["0.0 B", "1023.0 B", "1.0 KB", "4.8 MB", "2.8 GB", "45.5 TB"]


@pytest.mark.parametrize(("content", "kind", "name"), [
    ("ask @admin now", "mention", "@admin"), ("mail a.b@c.example, ok", "email", "a.b@c.example,"), ("see https://x.example/a?b=1).", "url", "https://x.example/a?b=1"), ("ip 10.0.0.255!", "ip", "10.0.0.255"),
    ("at host:8080 x", "port", ":8080"), ("\n/etc/hosts", "path", "/etc/hosts"), ("costs $1,000 today", "money", "$1,000"), ("took 2.5GB", "number_unit", "2.5GB"), ("set OPENAI_KEY", "env_var", "OPENAI_KEY"), ("a #tag", "hashtag", "#tag"),
])
def test_entity_kinds(spark, content, kind, name):
    assert (name, kind) in [tuple(e) for e in column(spark, [content], entities)[0]]


def test_entities_keep_the_first_spelling(spark):
    got = column(spark, ["@Bob and @bob and @BOB; x@bob ABC ABCD", "", None], entities)
    assert [tuple(e) for e in got[0] if e["type"] == "mention"] == [("@Bob", "mention")] and got[1] == [] and ("ABC", "env_var") not in [tuple(e) for e in got[0]]


def test_importance(spark):
    rows = spark.createDataFrame([("plain words here", "working", 0), ("- key: must\n- b=1", "core", 5), ("x" * 650, "learned", 2)], "c string, t string, n int")
    got = [r[0] for r in rows.select(importance(F.col("c"), F.col("t"), F.col("n"))).collect()]
    assert got == [round(0.06 + 0.04, 4), round(0.3 + 0.04 + 0.2 + 0.15 * 0.6 + 0.15 * 0.4, 4), round(0.18 + 0.2 * 0.85 + 0.08, 4)]


def brute_embedding(content, dim=128):
    words = [w for w in re.split(r"[\s\W]+", content.lower().strip()) if len(w) >= 2]
    grams = [f"#{w}#"[i : i + n] for w in words for n in (2, 3) for i in range(len(w) + 3 - n)]
    out = [0] * dim
    for token, weight in ([(w, 3) for w in words] + [(g, 1) for g in grams])[:200]:
        for v in struct.unpack("<4I", hashlib.md5(token.encode()).digest()):
            out[v % dim] += weight if v >> 16 & 1 else -weight
    return out


def test_hash_embedding(spark):
    contents = ["Hello wörld a", "", "  ", "ab", "one two three " * 90, "日本語 テスト", None]
    rows = spark.createDataFrame(list(enumerate(contents)), "id long, content string")
    assert {r.id: r.counts for r in vectors.hash_counts(rows).collect()} == {i: brute_embedding(c or "") for i, c in enumerate(contents)}
    norms = {r.id: math.hypot(*r.embedding) for r in vectors.hash_embedded(rows).collect()}
    assert norms[0] == pytest.approx(1) and norms[1] == 0


def test_cosine_and_quantisation(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0, -2.0], [0.0, 0.0, 0.0]), (1, [3.0, 3.0, 3.0], [1.0, 1.0, 1.0])], "i int, a array<double>, b array<double>")
    got = rows.orderBy("i").select(vectors.cosine(F.col("a"), F.col("b")), vectors.dequantised(vectors.quantised(F.col("a"))), vectors.quantised(F.col("a"))["q"]).collect()
    assert got[0][0] == 0 and got[1][0] == pytest.approx(1) and got[0][1] == pytest.approx([1, 0, -2], abs=0.02) and got[1][2] == [-128] * 3


def test_classify(spark):
    """Quirk 9 stays: a word of hexadecimal letters looks like a number."""
    cases = {'"exact phrase"': 0.9, "@bob": 0.8, "decade review": 0.8, "привет мир": 0.7, "what is x": 0.3, "is it broken?": 0.3, "alpha beta gamma delta omega": 0.3, "alpha": 0.6, "alpha beta docker": 0.5, "alpha beta gamma": 0.4}
    assert column(spark, list(cases), lambda c: classify.weights(c)["fts_w"]) == list(cases.values())
    assert column(spark, ["hello", "привет", "ab дв", ""], classify.mostly_foreign) == [False, True, True, False]


def test_extraction_order_and_guards(spark):
    content = "Note: backups run nightly. We decided to use Postgres.\nDB_URL = x\nTODO: ok"
    got = [(x["type"], x["text"]) for x in column(spark, [content], extraction.extractions)[0]]
    assert got[0] == ("important", "Note: backups run nightly. We decided to use Postgres.") and ("config", "DB_URL=x") in got and not any(t == "todos" for t, _ in got)


def test_markdown_chunks():
    """Quirk 14: short pieces are dropped."""
    fence = "`" * 3
    page = f"# A title that is long enough to stay\n## One\n\nshort\n\nThis paragraph is long enough to stay.\n\n{fence}\ncode line one\n\ncode line two\n{fence}\n## Two\n" + "\n".join(f"- bullet {k} " + "x" * 90 for k in range(12))
    got = markdown.chunks(page)
    assert got[0] == "# A title that is long enough to stay" and got[1] == "## One\nThis paragraph is long enough to stay." and got[2] == f"## One\n{fence}\ncode line one\n\ncode line two\n{fence}"
    assert len(got) == 15 and all(c.startswith("## Two\n- bullet") for c in got[3:])
    nested = "## H\n- parent\n" + "\n".join("  - sub " + "y" * 200 for _ in range(9))
    parts = markdown.chunks(nested)
    assert len(parts) == 3 and all(c.startswith("## H\n- parent\n  - sub") and len(c) <= 800 for c in parts)
    assert markdown.chunks(None) == [] and markdown.chunks("z" * 2000) == ["z" * 2000]


def test_phrases():
    p = search.Phrase
    assert search.phrases("the of") == [] and search.phrases("Café") == [p(("cafe",), True)]
    assert search.phrases("red fox") == [p(("red", "fox")), p(("red",), False, True), p(("fox",), False, True), p(("red",)), p(("fox",))]
    assert search.phrases("API_KEY") == [p(("api", "key"), True)] and len(search.phrases("one two three")) == 3 + 3 + 3


def test_bm25_is_sqlite(spark):
    """Ranks of an external-content index with three columns."""
    r = random.Random(4)
    words = "alpha beta gamma delta alphabet betamax red fox node_js café".split()
    rows = [(k, " ".join(r.choice(words) for _ in range(r.randrange(3, 40))), r.choice(("red", "fox src", "")), [r.choice(words) for _ in range(r.randrange(3))], k % 7 == 0) for k in range(120)]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(content, source, tags)")
    db.executemany("INSERT INTO f(rowid, content, source, tags) VALUES (?, ?, ?, ?)", [(i, c, s, ",".join(t)) for i, c, s, t, _ in rows])
    memories = spark.createDataFrame(rows, "id long, content string, source string, tags array<string>, archived boolean")
    asked = {1: ("red fox", '"red fox" OR red AND fox OR red OR fox'), 2: ("alpha beta red", '"alpha beta red" OR "alpha beta" OR "beta red" OR alpha* AND beta* AND red OR alpha* OR beta* OR red'), 3: ("node_js", "node_js*"), 4: ("CAFE", "CAFE*")}
    got = {(x["query"], x["id"]): x["rank"] for x in search.bm25(memories, {q: t for q, (t, _) in asked.items()}).collect()}
    wanted = {}
    for q, (_, match) in asked.items():
        match = match.replace("node_js*", '"node js" *')
        wanted |= {(q, i): rank for i, rank in db.execute("SELECT rowid, rank FROM f WHERE f MATCH ?", (match,))}
    assert set(got) == set(wanted) and all(got[k] == pytest.approx(wanted[k], abs=1e-9) for k in got)


def test_recall_on_one_hit_scores_zero_keywords(spark):
    """Quirk 5: when all ranks are equal the keyword part is 0."""
    memories = spark.createDataFrame([(1, "zebra stripes", "", [], False, "learned", "", 0.0, None, 0.5)], "id long, content string, source string, tags array<string>, archived boolean, tier string, namespace string, created_at double, supersedes long, importance double")
    assert search.keyword_hits(memories, {0: "zebra"}, 5).first()["fts_score"] == 0.0
    assert search.recall(memories, {0: "zebra", 1: ""}, 0.0, keyword_only=True, recency_weight=0.0).first()["score"] == 0.0


def test_consolidation_pairs(spark):
    r = random.Random(2)
    base = [[r.gauss(0, 1) for _ in range(32)] for _ in range(6)]
    rows = [(6 * k + j, [x + r.gauss(0, 0.05) for x in b]) for j, b in enumerate(base) for k in range(5)] + [(100, base[0]), (101, base[0]), (102, [0.0] * 32)]
    frame = spark.createDataFrame(rows, "id long, embedding array<double>")
    exact, lsh = consolidate.exact_pairs(frame, 0.85), consolidate.lsh_pairs(frame, 0.85, 32)
    brute = {(a, b) for a, x in rows for b, y in rows if a < b and sum(map(lambda p: p[0] * p[1], zip(x, y, strict=True))) >= 0.85 * math.hypot(*x) * math.hypot(*y) > 0}
    assert {tuple(p) for p in exact.collect()} == brute
    roots = lambda pairs: {tuple(x) for x in consolidate.components(pairs).collect()}
    assert roots(exact) == roots(lsh) and len({b for _, b in roots(exact)}) == 6
