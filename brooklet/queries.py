"""The queries of the store's operators over the driver's tables, and their DuckDB forms."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .checkpoints import checkpointed, scratch
from .functions import classify
from .functions.entities import entities as entities_of
from .functions.extraction import PATTERNS
from .functions.importance import importance
from .functions.markdown import markdown_chunks
from .functions.text import accent_tables, human_size
from .functions.vectors import dequantised, hash_counts, hash_embedded, quantised
from .operators import consolidate, history, ingest, reads, retention, search
from .plans.store import EVENT, Store, fold
from .schema import ACTION_WORDS, EN_STOP, MEMORY, QUESTION_WORDS, RU_STOP, TECH_TERMS, TIERS, encoded_tags, normalize_legacy, tier_name
from .streaming.streams import daily_counts

NOW = 1_711_929_600.0
START = 1_704_067_200
SEARCHES = {1: "general public license", 2: "the password token of onerth", 3: "was thnt public-version 3", 4: "ouaux"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as memories; everything but id, content and source follows from doc_id and lang."""
    d = F.col("doc_id")
    columns = {
        "id": d, "content": F.col("text"), "tier": tier_name(d % 5), "source": F.col("source"), "tags": F.array("lang"), "namespace": F.concat_ws("/", "lang", "source"),
        "created_at": START + d * 3600.0, "updated_at": START + d * 3600.0, "archived": d % 11 == 0, "content_hash": F.substring(F.sha2("text", 256), 1, 16),
        "access_count": d % 3, "last_accessed": F.lit(None), "supersedes": F.when(d % 4 != 0, d - 1), "importance": (d % 10) / 10.0,
    }
    return table(spark, sf_dir, "documents").select(*(columns[f.name].cast(f.dataType).alias(f.name) for f in MEMORY))


M = f"""m AS (SELECT doc_id AS id, text AS content, {list(TIERS)}[doc_id % 5 + 1] AS tier, source, lang || '/' || source AS namespace, lang,
  ({START} + doc_id * 3600)::DOUBLE AS created_at, doc_id % 11 = 0 AS archived, doc_id % 3 AS access_count,
  CASE WHEN doc_id % 4 <> 0 THEN doc_id - 1 END AS supersedes, ((doc_id % 10) / 10.0)::DOUBLE AS importance FROM documents)"""


def orders_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as texts that hold every kind of entity: id, content."""
    o = table(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return o.select(k.alias("id"), F.concat(
        F.lit("- Order #ord"), k, F.lit(" for @cust"), c, F.lit(" costs $"), F.floor("o_totalprice").cast("string"), F.lit(",000\nnote: see https://shop.example.com/o/"), k, F.lit("). Host 10.0."), k % 256, F.lit("."), c % 256,
        F.lit(" listens on :"), k % 9000 + 1000, F.lit(", logs /var/log/app"), c % 7, F.lit(".log took "), k % 500, F.lit("ms, "), c % 9, F.lit(".5GB\nSHOP_KEY="), c, F.lit(" must stay secret, ask ops"), c % 3, F.lit("@example.com, #ORD"), k),
        ).toDF("id", "content")


O = """o AS (SELECT o_orderkey AS id, '- Order #ord' || o_orderkey || ' for @cust' || o_custkey || ' costs $' || floor(o_totalprice)::BIGINT || ',000\nnote: see https://shop.example.com/o/' || o_orderkey
  || '). Host 10.0.' || o_orderkey % 256 || '.' || o_custkey % 256 || ' listens on :' || (o_orderkey % 9000 + 1000) || ', logs /var/log/app' || o_custkey % 7 || '.log took ' || o_orderkey % 500 || 'ms, '
  || o_custkey % 9 || '.5GB\nSHOP_KEY=' || o_custkey || ' must stay secret, ask ops' || o_custkey % 3 || '@example.com, #ORD' || o_orderkey AS content FROM orders)"""  # noqa: E741
_W, _NS, _S = r"[\p{L}\p{N}_]", r"[^\s\x0B]", r"[\s\x0B]"


def entities_sql(rows: str) -> str:
    """Entities of rows (id, content): memory_id, type, name; words are told by splitting, as RE2 has no lookaround."""
    word = rf"list_filter(regexp_split_to_array(content, '[^\p{{L}}\p{{N}}_]+'), w -> regexp_full_match(w, '[A-Z][A-Z0-9_]{{2,}}') AND (contains(w, '_') OR length(w) >= 4))"
    kinds = {
        "email": rf"regexp_extract_all(content, '{_NS}+@{_NS}+\.{_NS}+')",
        "url": rf"list_transform(regexp_extract_all(content, 'https?://{_NS}+'), x -> rtrim(x, '.,;)'))",
        "mention": rf"regexp_extract_all(content, '(?:^|[ \t\n,;(\[])(@{_W}+)', 1)",
        "hashtag": rf"regexp_extract_all(content, '#{_W}+')",
        "ip": r"regexp_extract_all(content, '\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}\b')",
        "port": r"regexp_extract_all(content, ':[0-9]{4,5}\b')",
        "path": rf"list_filter(regexp_extract_all(content, '(?m)(?:^|{_S})([~/]{_NS}+)', 1), x -> contains(x, '/') AND length(x) > 2)",
        "money": r"regexp_extract_all(content, '\$[0-9][0-9,]*')",
        "number_unit": r"regexp_extract_all(content, '\b[0-9]+(?:\.[0-9]+)?(?:MB|GB|KB|TB|ms|s|min|hr|h)\b')",
        "env_var": word,
    }
    parts = " UNION ALL ".join(f"SELECT id, {k} AS kind, '{name}' AS type, unnest({sql}) AS name, generate_subscripts({sql}, 1) AS pos FROM {rows}" for k, (name, sql) in enumerate(kinds.items()))
    return f"""SELECT id AS memory_id, type, name, pos, kind FROM ({parts}) QUALIFY row_number() OVER (PARTITION BY id, type, lower(name) ORDER BY pos) = 1"""


def importance_sql(rows: str, tier: str) -> str:
    tests = lambda xs: "least(1.0, round(0.2 * (" + " + ".join(f"({x})::INT" for x in xs) + "), 1))"
    structure = tests([rf"regexp_matches(content, '{p}')" for p in ("(?m)^- ", r"(?m)^\* ", r"(?m)^[0-9]+\. ", rf"{_W}+:{_S}+{_NS}", rf"{_W}+={_NS}", "```")])
    action = tests([*(f"contains(lower(content), '{w}')" for w in ACTION_WORDS), rf"regexp_matches(content, '[A-Z_]{{3,}}={_NS}')"])
    return f"""SELECT r.id, round(0.3::DOUBLE * (CASE {tier} WHEN 'core' THEN 1.0 WHEN 'procedural' THEN 0.9 WHEN 'learned' THEN 0.6 WHEN 'episodic' THEN 0.4 ELSE 0.2 END)::DOUBLE
      + 0.2::DOUBLE * (CASE WHEN length(content) < 30 THEN 0.2 WHEN length(content) < 100 THEN 0.2 + 0.8 * (length(content) - 30) / 70.0::DOUBLE WHEN length(content) <= 500 THEN 1.0 WHEN length(content) <= 800 THEN 1.0 - 0.3 * (length(content) - 500) / 300.0::DOUBLE ELSE 0.7 END)::DOUBLE
      + 0.2::DOUBLE * least(1.0, coalesce(n, 0) / 5.0::DOUBLE) + 0.15::DOUBLE * {structure}::DOUBLE + 0.15::DOUBLE * {action}::DOUBLE, 4) AS importance
      FROM {rows} r LEFT JOIN (SELECT memory_id, count(*) AS n FROM ({entities_sql(rows)}) GROUP BY 1) e ON e.memory_id = r.id"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations, and customers as messages that say something for each family: run, message, content."""
    own = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("run"), F.col("turn").alias("message"), F.col("text").alias("content"))
    k = F.col("c_custkey")
    said = F.concat(
        F.lit("Important: customer "), k, F.lit(" pays late.\nMAX_RETRY = "), k % 9, F.lit("; set limit to "), k % 50, F.lit(" items. We decided to call "), F.col("c_name"), F.lit(". Let's use plan "), k % 4,
        F.lit("!\nTurns out segment "), F.col("c_mktsegment"), F.lit(" grows. Always check balance "), F.floor("c_acctbal").cast("string"), F.lit(". I prefer mail. TODO: write to "), F.col("c_name"), F.lit("\nBalance is due.\nregion: number "), F.col("c_nationkey"))
    made = table(spark, sf_dir, "customer").select((F.lit(1_000_000) + F.floor(k / 50)).alias("run"), k.alias("message"), said.alias("content"))
    return own.unionByName(made)


MESSAGES = """msg AS (SELECT conv_id AS run, turn AS message, text AS content FROM conversations UNION ALL
  SELECT 1000000 + c_custkey // 50, c_custkey, 'Important: customer ' || c_custkey || ' pays late.' || chr(10) || 'MAX_RETRY = ' || c_custkey % 9 || '; set limit to ' || c_custkey % 50 || ' items. We decided to call ' || c_name || '. Let''s use plan ' || c_custkey % 4
  || '!' || chr(10) || 'Turns out segment ' || c_mktsegment || ' grows. Always check balance ' || floor(c_acctbal)::BIGINT || '. I prefer mail. TODO: write to ' || c_name || chr(10) || 'Balance is due.' || chr(10) || 'region: number ' || c_nationkey FROM customer)"""


def extraction_sql(messages: str = MESSAGES, columns: str = "run, message, text, type, tier") -> str:
    parts = []
    for k, (family, tier, pattern, group, over, stop) in enumerate(PATTERNS):
        p = pattern.replace("(?iu)", "(?i)").replace(r"(?:^|(?<=\n)|", "(?m)(?:^|").replace("'", "''")
        trim = lambda g, p=p: rf"regexp_replace(regexp_extract_all(content, '{p}', {g})[i], '^[\s\x0B]+|[\s\x0B]+$', '', 'g')"
        whole = trim(0)
        if group is None and family == "config":
            whole = f"{trim(1)} || '=' || {trim(2)}"
        elif group is None and "[:=]" in pattern:
            whole = f"{trim(1)} || ': ' || {trim(2)}"
        elif group is None:
            whole = trim(1)
        sized = whole if not group else trim(group)
        sized = sized if stop else rf"regexp_replace({sized}, '\.+$', '')"
        parts.append(f"SELECT run, message, {k} AS pattern, i AS match, {whole} AS text, {sized} AS sized, {over} AS least, '{family}' AS type, '{tier}' AS tier FROM (SELECT *, unnest(range(1, len(regexp_extract_all(content, '{p}')) + 1)) AS i FROM msg)")
    return f"""WITH {messages}, x AS ({' UNION ALL '.join(parts)})
      SELECT {columns} FROM x WHERE length(sized) > least AND length(sized) < 500 AND text <> ''
      QUALIFY row_number() OVER (PARTITION BY run, lower(text) ORDER BY message, pattern, match) = 1"""


QUESTIONS = [
    '"exact words" here', "@someone said", "see https://a.example/x", "www.example.org page", "error 5003", "commit deadbeef1", "decade facade", "привет мир сегодня", "日本語 テキスト", "what is the cache", "почему сервер упал", "is it broken?", "?",
    "alpha beta gamma delta epsilon", "server", "", "blue green", "restart the docker server please", "yellow red pink", "how", "When did ivan call", "the of and", "json parser broken again", "tell me", "git push rejected today", "Où est la clé", "naïve café déjà vu",
    "12 ab", "a1b2c3d4", "why not", "big small tall wide deep low", "port forward", "ssh key lost again", "где ключ", "describe everything", "ordinary words only", "one", "Two Words", "three plain words", "four very plain words",
]


def questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(QUESTIONS)), "query long, text string")


def classify_sql() -> str:
    quoted = lambda xs: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"
    values = ", ".join(f"({k}, '{t}')".replace("'", "'") for k, t in enumerate(q.replace("'", "''") for q in QUESTIONS))
    return rf"""WITH q(query, text) AS (VALUES {values}), r AS (SELECT *, list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'), w -> length(w) > 1 AND NOT list_contains({quoted(sorted({*EN_STOP, *RU_STOP}))}, w)) AS words,
      length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) AS letters, length(regexp_replace(text, '[^\p{{L}}]|[\x{{00}}-\x{{24F}}]', '', 'g')) AS strange FROM q),
      c AS (SELECT query, CASE WHEN regexp_matches(text, '"[^"]+"') THEN 0.9 WHEN regexp_matches(text, '@[\p{{L}}\p{{N}}_]+|https?://\S+|www\.\S+') THEN 0.8
      WHEN regexp_matches(text, '\b[0-9]{{3,}}\b|\b[0-9a-fA-F]{{6,}}\b') THEN 0.8 WHEN letters > 0 AND strange * 2 > letters THEN 0.7
      WHEN len(words) > 0 AND (list_contains({quoted(QUESTION_WORDS)}, words[1]) OR trim(text) LIKE '%?') THEN 0.3 WHEN len(words) >= 5 THEN 0.3 WHEN len(words) <= 2 THEN 0.6
      WHEN len(list_intersect(words, {quoted(TECH_TERMS)})) > 0 THEN 0.5 ELSE 0.4 END::DOUBLE AS fts_w FROM r) SELECT query::BIGINT AS query, fts_w, round(1 - fts_w, 1) AS vec_w FROM c"""


def hash_counts_sql(rows: str, dim: int = 128) -> str:
    """id, idx, w over rows (id, content); CTEs for a WITH RECURSIVE-free statement."""
    return rf"""SELECT id, idx, sum(w)::INT AS w FROM (
      SELECT id, (v % {dim})::INT AS idx, weight * CASE WHEN (v >> 16) % 2 = 1 THEN 1 ELSE -1 END AS w FROM (
        SELECT id, weight, ('0x' || substr(h, 8 * k + 7, 2) || substr(h, 8 * k + 5, 2) || substr(h, 8 * k + 3, 2) || substr(h, 8 * k + 1, 2))::BIGINT AS v FROM (
          SELECT id, weight, md5(token) AS h, unnest([0, 1, 2, 3]) AS k FROM (
            SELECT id, unnest(list_slice(list_concat(list_transform(words, x -> {{'token': x, 'weight': 3}}), list_transform(flatten(list_transform(words, x -> list_concat(
              list_transform(range(1, length(x) + 2), i -> substr('#' || x || '#', i, 2)), list_transform(range(1, length(x) + 1), i -> substr('#' || x || '#', i, 3))))), x -> {{'token': x, 'weight': 1}})), 1, 200), recursive := true)
            FROM (SELECT id, list_slice(list_filter(regexp_split_to_array(lower(content), '[^\p{{L}}\p{{N}}_]+'), x -> length(x) >= 2), 1, 200) AS words FROM {rows}))))) GROUP BY 1, 2"""


def bm25_sql(queries: dict[int, str], rows: str = "m") -> str:
    """query, id, rank over rows (id, content, source, lang): counted in token lists, not by joins."""
    a, b = accent_tables()
    tokens = lambda c: rf"list_filter(regexp_split_to_array(lower(translate({c}, '{a}', '{b}')), '[^\p{{L}}\p{{N}}]+'), x -> x <> '')"
    out = []
    for q, text in queries.items():
        ps = search.phrases(text)
        hit = lambda p, c: " AND ".join(f"starts_with({c}[i + {j}], '{t}')" if p.prefix and j == len(p.tokens) - 1 else f"{c}[i + {j}] = '{t}'" for j, t in enumerate(p.tokens))
        f = [" + ".join(f"len(list_filter(range(1, len({c}) + 1), i -> coalesce({hit(p, c)}, false)))" for c in ("c1", "c2", "c3")) for p in ps]
        score = lambda k: f"ln_{k} * f{k} * 2.2 / (f{k} + 1.2 * (0.25 + 0.75 * dl / avgdl))"
        whole = " AND ".join(f"f{k} > 0" for k, p in enumerate(ps) if p.in_and) or "true"
        terms = " + ".join(f"(CASE WHEN {whole} THEN {score(k)} ELSE 0 END)" if p.in_and else score(k) for k, p in enumerate(ps))
        stats = ", ".join(f"count(*) FILTER (f{k} > 0) AS n{k}" for k in range(len(ps)))
        idf = ", ".join(f"(CASE WHEN (n - n{k} + 0.5) <= (n{k} + 0.5) THEN 1e-6 ELSE ln((n - n{k} + 0.5) / (n{k} + 0.5)) END)::DOUBLE AS ln_{k}" for k in range(len(ps)))
        some = " OR ".join(f"f{k} > 0" for k in range(len(ps)))
        out.append(f"""SELECT {q}::BIGINT AS query, id, -({terms})::DOUBLE AS rank FROM (SELECT id, len(c1) + len(c2) + len(c3) AS dl, {", ".join(f"({x})::DOUBLE AS f{k}" for k, x in enumerate(f))} FROM tok) d,
          (SELECT n, avgdl, {idf} FROM (SELECT count(*)::DOUBLE AS n, avg(dl)::DOUBLE AS avgdl, {stats} FROM (SELECT len(c1) + len(c2) + len(c3) AS dl, {", ".join(f"{x} AS f{k}" for k, x in enumerate(f))} FROM tok))) s WHERE {some}""")
    return f"tok AS MATERIALIZED (SELECT id, {tokens('content')} AS c1, {tokens('source')} AS c2, {tokens('lang')} AS c3 FROM {rows}), ranked AS ({' UNION ALL '.join(out)})"


def recall_sql(limit: int = 5) -> str:
    weights = {1: (0.4, 0.6), 2: (0.5, 0.5), 3: (0.4, 0.6), 4: (0.6, 0.4)}
    values = ", ".join(f"({q}, '{t}', {weights[q][0]}::DOUBLE, {weights[q][1]}::DOUBLE)" for q, t in SEARCHES.items())
    emb = lambda n, rows: f"{n} AS MATERIALIZED (SELECT id, list(coalesce(w, 0)::DOUBLE ORDER BY idx) AS v FROM (SELECT a.id, a.idx, c.w FROM (SELECT id, unnest(range(128)) AS idx FROM {rows}) a LEFT JOIN ({hash_counts_sql(rows)}) c ON a.id = c.id AND a.idx = c.idx) GROUP BY 1)"
    return f"""WITH {M}, qs(id, content, fts_w, vec_w) AS (VALUES {values}), {bm25_sql(SEARCHES)}, {emb("dv", "m")}, {emb("qv", "qs")},
      kw AS (SELECT query, id, CASE WHEN max(rank) OVER w = min(rank) OVER w THEN 0 ELSE (max(rank) OVER w - rank) / (max(rank) OVER w - min(rank) OVER w) END AS s
        FROM (SELECT r.* FROM ranked r JOIN m USING (id) WHERE NOT archived QUALIFY row_number() OVER (PARTITION BY query ORDER BY rank, id) <= {3 * limit}) WINDOW w AS (PARTITION BY query)),
      near AS (SELECT q.id::BIGINT AS query, d.id, 1 - coalesce(list_cosine_similarity(d.v, q.v), 0) AS dist FROM dv d, qv q QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY dist, d.id) <= {6 * limit}),
      vec AS (SELECT query, id, greatest(0, 1 - dist) AS s FROM near JOIN m USING (id) WHERE NOT archived QUALIFY row_number() OVER (PARTITION BY query ORDER BY dist, id) <= {3 * limit}),
      fused AS (SELECT coalesce(k.query, v.query) AS query, coalesce(k.id, v.id) AS id, coalesce(k.s, 0) AS ks, coalesce(v.s, 0) AS vs FROM kw k FULL JOIN vec v ON k.query = v.query AND k.id = v.id)
      SELECT f.query, f.id, tier, source, round(((fts_w * ks + vec_w * vs) * 0.9 + exp(-greatest(0, {NOW} - created_at) / 3600 * 0.01) * 0.1) * (0.8 + 0.4 * importance), 4) AS score,
      CASE WHEN fts_w > 0.6 THEN 'keyword' WHEN vec_w > 0.6 THEN 'semantic' ELSE 'hybrid' END AS method, importance FROM fused f JOIN m ON m.id = f.id JOIN qs ON qs.id = f.query
      WHERE f.id NOT IN (SELECT supersedes FROM m WHERE supersedes IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY f.query ORDER BY score DESC, f.id) <= {limit}"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event log: every document inserted, some archived, brought back and linked; accesses from events."""
    m = memories(spark, sf_dir)
    base = m.select(F.lit(0).alias("seq"), F.col("created_at").alias("ts"), F.lit("insert").alias("op"), F.col("id").alias("target"), F.lit(None).alias("value"), F.struct(*m.columns).alias("memory"))
    mark = lambda seq, op, keep, value=None: m.where(keep).select(F.lit(seq).alias("seq"), F.lit(NOW + seq).alias("ts"), F.lit(op).alias("op"), F.col("id").alias("target"), (F.lit(None) if value is None else value).alias("value"), F.lit(None).alias("memory"))
    size = F.lit(max(1, m.count()))
    reads_ = table(spark, sf_dir, "events").groupBy((F.col("user_id") % size).alias("target")).agg(F.count("*").alias("value"), F.max(F.unix_timestamp("ts")).alias("ts"))
    access = reads_.select(F.lit(4).alias("seq"), "ts", F.lit("access").alias("op"), "target", "value", F.lit(None).alias("memory"))
    rows = [base, mark(1, "archive", "id % 7 = 0"), mark(2, "unarchive", "id % 22 = 0"), mark(3, "link", "id % 9 = 0", F.col("id") + 1), access]
    cast = lambda r: r.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in EVENT))
    out = cast(rows[0])
    for r in rows[1:]:
        out = out.union(cast(r))
    return out


def as_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as items to remember, without blank ones."""
    return table(spark, sf_dir, "documents").where("rlike(text, '[^ \\t\\n\\r]')").select(F.col("doc_id").alias("position"), F.col("text").alias("content"), F.col("lang").alias("namespace"), "source")


#: What remember_batch makes of documents: of equal texts in a namespace the first, numbered in order.
IMPORTED = r"""i AS (SELECT row_number() OVER (ORDER BY doc_id) AS id, text AS content, lang AS namespace, source FROM
  (SELECT * FROM documents WHERE regexp_matches(text, '[^ \t\n\r]') QUALIFY row_number() OVER (PARTITION BY sha256(text), lang ORDER BY doc_id) = 1))"""


def remembered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new store of all documents, remembered in two batches of which the second has all of the first again."""
    store, items = Store(spark, scratch(spark, "store"), embed=None), as_items(spark, sf_dir)
    store.remember_batch(items.where("position % 2 = 0"), NOW)
    store.remember_batch(items, NOW + 1)
    return store.memories().select("id", "content_hash", "namespace", "tier", "created_at", "importance")


def changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store of all documents, and each kind of change to it."""
    store = Store(spark, scratch(spark, "store"), embed=None)
    store.remember_batch(as_items(spark, sf_dir), NOW)
    text = store.memories().where("id = 1").first()
    store.remember(text["content"], NOW + 1, namespace=text["namespace"])
    store.save_state("step one of three", NOW + 2)
    store.save_state("step two of three", NOW + 3)
    store.forget(2, NOW + 4)
    store.forget(4, NOW + 5)
    store.unarchive(4, NOW + 6)
    store.update_memory(7, "a new text instead of the seventh", NOW + 7, tags=["new"])
    store.add_procedure("Always run the tests first", NOW + 8, namespace="rules")
    store.forget(5, NOW + 9, "no/such/namespace")
    return store.memories().select("id", "content_hash", "tier", "namespace", "archived", "supersedes", "updated_at", F.array_join("tags", ",").alias("tags"))


CHANGED = f"""WITH {IMPORTED}, n AS (SELECT count(*) AS n FROM i), old AS (SELECT id, content, 'learned' AS tier, namespace, id IN (2, 7) AS archived, NULL::BIGINT AS supersedes,
    (CASE id WHEN 1 THEN {NOW} + 1 WHEN 2 THEN {NOW} + 4 WHEN 4 THEN {NOW} + 6 WHEN 7 THEN {NOW} + 7 ELSE {NOW} END)::DOUBLE AS updated_at, '' AS tags FROM i),
  new AS (SELECT n + 1 AS id, 'step one of three' AS content, 'working' AS tier, '' AS namespace, true AS archived, NULL::BIGINT AS supersedes, ({NOW} + 3)::DOUBLE AS updated_at, 'state' AS tags FROM n
    UNION ALL SELECT n + 2, 'step two of three', 'working', '', false, NULL, {NOW} + 3, 'state' FROM n UNION ALL SELECT n + 3, 'a new text instead of the seventh', 'learned', (SELECT namespace FROM i WHERE id = 7), false, 7, {NOW} + 7, 'new' FROM n
    UNION ALL SELECT n + 4, 'Always run the tests first', 'procedural', 'rules', false, NULL, {NOW} + 8, '' FROM n)
  SELECT id, substr(sha256(content), 1, 16) AS content_hash, tier, namespace, archived, supersedes, updated_at, tags FROM (SELECT * FROM old UNION ALL SELECT * FROM new)"""


def conversed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store of what all conversations, taken for one, say."""
    store = Store(spark, scratch(spark, "store"), embed=None)
    said = messages(spark, sf_dir).select((F.col("run") * 1000 + F.col("message") % 1000).cast("int").alias("message"), "content")
    store.process_conversation(said, NOW)
    return reads.tagged(store.memories(), "auto-extracted").select("id", "content", "tier", F.array_join("tags", ",").alias("tags"), "source")


#: Pages and their chunks, written out: literal, as no SQL has the line machine.
PAGES = {
    1: ("# A title that is long enough to stay\n## One\n\nshort\n\nThis paragraph is long enough to stay.\n", ["# A title that is long enough to stay", "## One\nThis paragraph is long enough to stay."]),
    2: ("no header at all but a paragraph that stays\n\nand a second one, which is as long as it must be", ["no header at all but a paragraph that stays", "and a second one, which is as long as it must be"]),
    3: ("## Code\n```\nline one of some code\n\nline two of some code\n```\nafter the code, a paragraph of words", ["## Code\n```\nline one of some code\n\nline two of some code\n```", "## Code\nafter the code, a paragraph of words"]),
    4: ("## Short\n\nno", []),
}


def _queries() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    q: dict[str, tuple[Callable, str | None]] = {}
    q["recall_hybrid"] = (lambda s, d: search.recall(memories(s, d), SEARCHES, NOW).drop("content"), recall_sql())
    q["bm25_search"] = (lambda s, d: search.bm25(memories(s, d), SEARCHES).select("query", "id", F.round("rank", 6).alias("rank")), f"WITH {M}, {bm25_sql(SEARCHES)} SELECT query, id, round(rank, 6) AS rank FROM ranked")
    q["ingest_dedup"] = (
        lambda s, d: ingest.new_items(ingest.prepared(table(s, d, "documents").select(F.col("doc_id").alias("position"), F.col("text").alias("content"), F.concat_ws("/", "lang", "source").alias("namespace")), checked=False), memories(s, d).where("id % 3 = 0")).select("position", "content_hash", "namespace"),
        f"""WITH {M} SELECT doc_id AS position, substr(sha256(text), 1, 16) AS content_hash, lang || '/' || source AS namespace FROM documents d
        WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.id % 3 = 0 AND NOT m.archived AND m.content = d.text AND m.namespace = d.lang || '/' || d.source) QUALIFY row_number() OVER (PARTITION BY sha256(text), lang, source ORDER BY doc_id) = 1""",
    )
    q["remember_batch"] = (
        remembered,
        rf"""WITH e AS (SELECT * FROM documents WHERE regexp_matches(text, '[^ \t\n\r]')), a AS (SELECT row_number() OVER (ORDER BY doc_id) AS id, text AS content, lang AS namespace, {NOW}::DOUBLE AS created_at FROM (SELECT * FROM e WHERE doc_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY sha256(text), lang ORDER BY doc_id) = 1)),
        b AS (SELECT row_number() OVER (ORDER BY doc_id) + (SELECT count(*) FROM a) AS id, text AS content, lang AS namespace, ({NOW} + 1)::DOUBLE AS created_at FROM (SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.content = e.text AND a.namespace = e.lang) QUALIFY row_number() OVER (PARTITION BY sha256(text), lang ORDER BY doc_id) = 1)),
        r0 AS (SELECT * FROM a UNION ALL SELECT * FROM b), s AS ({importance_sql("r0", "'learned'")}) SELECT r0.id, substr(sha256(content), 1, 16) AS content_hash, namespace, 'learned' AS tier, created_at, importance FROM r0 JOIN s ON s.id = r0.id""",
    )
    q["store_changes"] = (changed, CHANGED)
    q["process_conversation"] = (
        conversed,
        f"""SELECT row_number() OVER (ORDER BY message, pattern, match) AS id, text AS content, tier, type || ',auto-extracted' AS tags, 'conversation' AS source FROM
        (SELECT * FROM ({extraction_sql(MESSAGES.replace("msg AS (", "own AS (") + ", msg AS (SELECT 0 AS run, (run * 1000 + message % 1000) AS message, content FROM own)", "message, pattern, match, text, type, tier")}))""",
    )
    q["tagged"] = (lambda s, d: reads.tagged(memories(s, d), "en").select("id", "tier"), f"WITH {M} SELECT id, tier FROM m WHERE NOT archived AND lang = 'en'")
    q["stats"] = (
        lambda s, d: reads.stats(memories(s, d)).select("total", "archived", "latest", "avg_importance", "bytes_per_vector", F.to_json("by_tier").alias("by_tier")),
        f"""WITH {M}, t AS (SELECT tier, count(*) AS n FROM m WHERE NOT archived GROUP BY 1) SELECT count(*) FILTER (NOT archived) AS total, count(*) FILTER (archived) AS archived, max(created_at) FILTER (NOT archived) AS latest,
        round(sum(importance) FILTER (NOT archived) / count(*) FILTER (NOT archived), 4) AS avg_importance, 512::INT AS bytes_per_vector, (SELECT '{{' || string_agg('"' || tier || '":' || n, ',' ORDER BY tier) || '}}' FROM t) AS by_tier FROM m""",
    )
    day = START + 20 * 86_400 + 50_000.0
    q["today"] = (lambda s, d: reads.today(memories(s, d), day), f"WITH {M} SELECT id, content, tier, source, created_at FROM m WHERE NOT archived AND created_at >= {START + 20 * 86_400}")
    q["namespace_filter"] = (lambda s, d: search.selected(memories(s, d), "learned", "en/src1").select("id", "namespace").union(search.selected(memories(s, d), None, "fr").select("id", "namespace")), f"WITH {M} SELECT id, namespace FROM m WHERE NOT archived AND (tier = 'learned' AND namespace = 'en/src1' OR starts_with(namespace, 'fr/'))")
    q["compact"] = (lambda s, d: retention.compactable(memories(s, d), NOW, 60).select("id", "tier"), f"WITH {M} SELECT id, tier FROM m WHERE NOT archived AND created_at < {NOW} - 60 * 86400 AND access_count <= 0 AND tier NOT IN ('core', 'procedural')")
    q["cleanup_working"] = (lambda s, d: retention.expired_working(memories(s, d), day).select("id"), f"WITH {M} SELECT id FROM m WHERE NOT archived AND tier = 'working' AND created_at < {day} - 86400")
    q["procedures"] = (lambda s, d: reads.procedures(memories(s, d), "es"), f"WITH {M} SELECT '## Agent Rules (from memory)' || string_agg(chr(10) || '- ' || content, '' ORDER BY created_at, id) AS text FROM m WHERE NOT archived AND tier = 'procedural' AND starts_with(namespace, 'es/')")
    q["export_markdown"] = (
        lambda s, d: reads.export_markdown(memories(s, d)).select("id", "text"),
        f"WITH {M} SELECT id, CASE WHEN row_number() OVER (PARTITION BY tier ORDER BY created_at, id) = 1 THEN chr(10) || '## ' || upper(tier[1]) || tier[2:] || chr(10) || chr(10) ELSE '' END || '<!-- source: ' || source || ' -->' || chr(10) || content || chr(10) AS text FROM m WHERE NOT archived",
    )
    q["entities_documents"] = (lambda s, d: reads.memory_entities(memories(s, d)).drop("position", "key"), f"WITH {M} SELECT memory_id, type, name FROM ({entities_sql('m')})")
    q["entities_orders"] = (lambda s, d: reads.memory_entities(orders_text(s, d)).drop("position", "key"), f"WITH {O} SELECT memory_id, type, name FROM ({entities_sql('o')})")
    q["entity_counts"] = (
        lambda s, d: reads.entity_counts(reads.memory_entities(orders_text(s, d)), orders_text(s, d).withColumn("archived", F.col("id") % 11 == 0)),
        f"WITH {O} SELECT arg_min(name, memory_id * 1000 + kind * 100 + pos) AS name, type, count(DISTINCT memory_id) AS memory_count FROM ({entities_sql('o')}) WHERE memory_id % 11 <> 0 GROUP BY lower(name), type ORDER BY memory_count DESC, 1, 2 LIMIT 50",
    )
    q["related"] = (lambda s, d: reads.related(reads.memory_entities(memories(s, d)), memories(s, d), "with", None, None), f"WITH {M} SELECT id, content, tier, source, name AS entity_name, type AS entity_type, created_at FROM ({entities_sql('m')}) e JOIN m ON m.id = e.memory_id WHERE lower(name) = 'with' AND NOT archived")
    score = lambda rows, tier: rows.select("id", importance(F.col("content"), tier, F.size(entities_of(F.col("content")))).alias("importance"))
    q["importance_documents"] = (lambda s, d: score(memories(s, d), F.col("tier")), f"WITH {M} {importance_sql('m', 'r.tier')}")
    q["importance_orders"] = (lambda s, d: score(orders_text(s, d), F.lit("core")), f"WITH {O} {importance_sql('o', chr(39) + 'core' + chr(39))}")
    q["conversation_extract"] = (lambda s, d: ingest.conversation_items(messages(s, d)).select("run", "message", "text", "type", "tier"), extraction_sql())
    q["classify_query"] = (lambda s, d: questions(s).select("query", classify.weights(F.col("text")).alias("w")).select("query", "w.*"), classify_sql())
    q["hash_embed"] = (
        lambda s, d: hash_counts(memories(s, d)).select("id", F.array_join(F.col("counts").cast("array<string>"), ",").alias("counts")),
        f"WITH {M}, c AS ({hash_counts_sql('m')}) SELECT a.id, string_agg(coalesce(w, 0)::VARCHAR, ',' ORDER BY a.idx) AS counts FROM (SELECT id, unnest(range(128)) AS idx FROM m) a LEFT JOIN c ON c.id = a.id AND c.idx = a.idx GROUP BY 1",
    )
    q["knn"] = (
        lambda s, d: search.nearest(vectors(s, d), vectors(s, d).where("id % 20 = 0").select(F.col("id").alias("query"), F.col("embedding").alias("vector")), 10).select("query", "id", F.round("distance", 6).alias("distance")),
        "SELECT q.vec_id AS query, e.vec_id AS id, round(1 - list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS distance FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY 1 - list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), e.vec_id) <= 10",
    )
    q["quantise"] = (
        lambda s, d: vectors(s, d).select("id", quantised(F.col("embedding")).alias("v")).select("id", F.round("v.scale", 6).alias("scale"), F.array_join(F.col("v.q").cast("array<string>"), ",").alias("q"), F.round(F.element_at(dequantised(F.col("v")), 1), 5).alias("first")),
        """WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, list_min(embedding)::DOUBLE AS lo, CASE WHEN list_max(embedding) = list_min(embedding) THEN 1.0 ELSE list_max(embedding)::DOUBLE - list_min(embedding)::DOUBLE END AS sc FROM embeddings),
        x AS (SELECT id, lo, sc, list_transform(v, y -> least(127, greatest(-128, trunc((y - lo) / sc * 255 - 128)))::INT) AS q FROM e) SELECT id, round(sc, 6) AS scale, array_to_string(q, ',') AS q, round((q[1] + 128) / 255::DOUBLE * sc + lo, 5) AS first FROM x""",
    )
    q["history"] = (
        lambda s, d: history.history(memories(s, d), memories(s, d).where("id % 20 = 0").select(F.col("id").alias("query"), "id")).select("query", "position", "id", "archived"),
        f"""WITH RECURSIVE {M}, start AS (SELECT id AS query, id FROM m WHERE id % 20 = 0), back(query, id, age) AS (SELECT query, id, 0 FROM start UNION ALL SELECT b.query, m.supersedes, b.age - 1 FROM back b JOIN m ON m.id = b.id WHERE m.supersedes IS NOT NULL),
        ahead(query, id, age) AS (SELECT query, id, 0 FROM start UNION ALL SELECT a.query, m.id, a.age + 1 FROM ahead a JOIN m ON m.supersedes = a.id), c AS (SELECT * FROM back UNION SELECT * FROM ahead)
        SELECT query, (max(age) OVER (PARTITION BY query) - age)::BIGINT AS position, c.id, archived FROM c JOIN m ON m.id = c.id""",
    )
    q["current_only"] = (lambda s, d: memories(s, d).where("not archived").select("id", "tier").join(search.superseded(memories(s, d)), "id", "left_anti"), f"WITH {M} SELECT id, tier FROM m WHERE NOT archived AND id NOT IN (SELECT supersedes FROM m WHERE supersedes IS NOT NULL)")

    def consolidated(s: SparkSession, d: str) -> DataFrame:
        v = vectors(s, d)
        rows = v.select("id", F.col("id").cast("string").alias("content"), F.col("id").cast("double").alias("created_at"))
        return consolidate.groups(rows, consolidate.components(consolidate.exact_pairs(v, 0.42, True))).select("root", "id", "kept", "kept_id")

    q["consolidate_exact"] = (
        consolidated,
        """WITH RECURSIVE p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.42),
        r(a, b) AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a), g AS (SELECT a AS id, least(a, min(b)) AS root FROM r GROUP BY a),
        k AS (SELECT root, id, row_number() OVER (PARTITION BY root ORDER BY length(id::VARCHAR) DESC, id DESC) = 1 AS kept FROM g) SELECT root, id, kept, max(CASE WHEN kept THEN id END) OVER (PARTITION BY root) AS kept_id FROM k""",
    )
    q["consolidate_lsh"] = (lambda s, d: consolidate.components(consolidate.lsh_pairs(checkpointed(hash_embedded(memories(s, d))), 0.85, 128)), None)
    q["markdown_chunks"] = (lambda s, d: memories(s, d).select("id", F.posexplode(markdown_chunks(F.concat(F.lit("## "), F.col("source"), F.lit("\n"), F.col("content")))).alias("chunk", "content")), None)
    q["markdown_pages"] = (
        lambda s, d: s.createDataFrame([(k, t) for k, (t, _) in PAGES.items()], "id long, content string").select("id", F.posexplode(markdown_chunks(F.col("content"))).alias("chunk", "content")),
        "SELECT * FROM (VALUES " + ", ".join(f"({k}::BIGINT, {n}::INT, '{c}')" for k, (_, cs) in PAGES.items() for n, c in enumerate(cs)) + ") AS t(id, chunk, content)",
    )
    q["store_fold"] = (
        lambda s, d: fold(log(s, d)).select("id", "archived", "updated_at", "supersedes", "access_count", "last_accessed"),
        f"""WITH {M}, a AS (SELECT user_id % (SELECT greatest(1, count(*)) FROM documents) AS id, count(*) AS n, floor(max(epoch(ts)))::DOUBLE AS last FROM events GROUP BY 1)
        SELECT m.id, CASE WHEN m.id % 22 = 0 THEN false WHEN m.id % 7 = 0 THEN true ELSE archived END AS archived, CASE WHEN m.id % 9 = 0 THEN {NOW} + 3 WHEN m.id % 22 = 0 THEN {NOW} + 2 WHEN m.id % 7 = 0 THEN {NOW} + 1 ELSE created_at END AS updated_at,
        CASE WHEN m.id % 9 = 0 THEN m.id + 1 ELSE supersedes END AS supersedes, access_count + coalesce(n, 0)::BIGINT AS access_count, last AS last_accessed FROM m LEFT JOIN a ON a.id = m.id""",
    )
    q["normalize_legacy"] = (
        lambda s, d: normalize_legacy(table(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), (F.col("doc_id") % 5).cast("int").alias("tier"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('["'), "lang", F.lit('", " x "]'))).otherwise(F.concat("lang", F.lit(" , y,"))).alias("tags"), F.lit(1.5).alias("created_at"))).select("id", "tier", encoded_tags(F.col("tags")).alias("tags"), "archived", "content_hash", "importance"),
        f"WITH {M} SELECT id, tier, CASE WHEN id % 2 = 0 THEN lang || ',x' ELSE lang || ',y' END AS tags, false AS archived, substr(sha256(content), 1, 16) AS content_hash, 0.5::DOUBLE AS importance FROM m",
    )
    q["human_size"] = (
        lambda s, d: table(s, d, "orders").select(F.col("o_orderkey").alias("id"), human_size(F.col("o_totalprice") * F.col("o_custkey") * F.col("o_orderkey")).alias("size")),
        "WITH x AS (SELECT o_orderkey AS id, o_totalprice * o_custkey * o_orderkey AS b FROM orders) SELECT id, CASE WHEN b < 1024 THEN printf('%.1f B', b) WHEN b < 1048576 THEN printf('%.1f KB', b / 1024) WHEN b < 1073741824 THEN printf('%.1f MB', b / 1048576) WHEN b < 1099511627776 THEN printf('%.1f GB', b / 1073741824) ELSE printf('%.1f TB', b / 1099511627776) END AS size FROM x",
    )
    q["daily_counts"] = (lambda s, d: daily_counts(table(s, d, "events")), "SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
    return q


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in _queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: re.sub(r"\b([a-z]) -> ", r"lambda \1: ", sql) for k, (_, sql) in _queries().items() if sql}


