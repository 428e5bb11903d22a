"""The numbered queries and their SQL; each applies its operator to the whole table it is meant for."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlattice.llm import chunks, graphsearch, jaccard, langid, mixing, nearpairs, packing, phrases, sharding, substrings, turns, urlfilter, warc
from seqlattice.operators.ordering import row_numbers
from seqlattice.session import materialize

# The rules of the url query.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
SHARDS = [f"shard-{k:03d}" for k in range(64)]


def tokenizer(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_warc(spark: SparkSession, folder: str) -> DataFrame:
    records = warc.read(warc.write(_table(spark, folder, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return nearpairs.near_duplicates(_table(spark, folder, "embeddings"))


def op3_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.join(_table(spark, folder, "documents"), size=4, threshold=85)


def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    named = langid.predict(docs.select("doc_id", "text"), langid.train(docs))
    return named.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op5_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(map(str, RULES)) + " AS r(host, path, verdict)")
    return urlfilter.judge(_table(spark, folder, "pages"), rules)


def op6_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.place(_table(spark, folder, "documents"), "doc_id", SHARDS).select("doc_id", "slot", "shard")


def op7_bpe(spark: SparkSession, folder: str) -> DataFrame:
    coded = chunks.encode(_table(spark, folder, "documents"), tokenizer("byte_bpe_50k.json"), with_text=True)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(_table(spark, folder, "documents"), tokenizer("word_bpe_49k.json"))


def op9_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = substrings.dedup(_table(spark, folder, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op10_nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _table(spark, folder, "embeddings")
    return graphsearch.search(graphsearch.build_index(vectors), vectors.filter(F.col("vec_id") % 20 == 0))


def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(_table(spark, folder, "documents"))


def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    rows = _table(spark, folder, "conversations")
    fixed = turns.repair(turns.damaged(rows))
    every = rows.groupBy(turns.spaced("conv_id").alias("conv")).agg(F.first("conv_id", ignorenulls=True).alias("conv_id"))
    found = every.join(fixed.counts, "conv", "left").join(fixed.audits, "conv", "left").join(turns.text_hashes(fixed.turns), "conv", "left")
    zeros = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def op13_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    sized = materialize(docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size")))
    names = sized.select("source", F.col("source").isNull().alias("missing")).distinct()
    turn = F.col("number") % 3
    weights = row_numbers(names, [], ["missing", "source"], "number").select("source", F.when(turn == 1, 5).when(turn == 2, 2).otherwise(1).alias("weight"))
    return mixing.mix(sized, weights).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {q.__name__: q for q in (op1_warc, op2_embedding_dedup, op3_ngram_join, op4_language_id, op5_url_filter, op6_sharding, op7_bpe, op8_packing, op9_substring_dedup, op10_nearest_vectors, op11_collocations, op12_conversation_repair, op13_source_mix)}

_PARTS = """
    SELECT page_id, url, translate(regexp_extract(after, '^([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(after, '^[^/?#]*([^?#]*)', 1, 's') AS path
    FROM (SELECT page_id, url, coalesce(regexp_extract(url, '^.*?://(.*)$', 1, 's'), '') AS after FROM pages)
"""



def _repair_ways() -> list[str]:
    """SQL for the best ``(cost, audit, text)`` of each state after one more row; states are 1 start, 2 s, 3 u, 4 a."""
    turn = {1: (3, "user"), 2: (3, "user"), 3: (4, "assistant"), 4: (3, "user")}
    ways: dict[int, list[str]] = {1: [], 2: [], 3: [], 4: []}

    def way(state: int, cost: str, letters: str, text: str, when: str = "true") -> str:
        return f"{{'c': CASE WHEN {when} THEN st[{state}].c + {cost} ELSE 1000000000 END, 'a': st[{state}].a || '{letters}', 'r': st[{state}].r || {text}}}"

    for state in turn:
        at, lead, text = state, "", "''"
        for _ in range(3):
            paid = 2 * len(lead)
            ways[at].append(way(state, f"{paid + 3}", lead + "D", text))
            to, role = turn[at]
            ways[to].append(way(state, f"{paid + 2} + d.cut", lead + "R", f"{text} || chr(10) || '{role}:' || d.text", "NOT d.forced"))
            for initial, before, after in (("s", (1,), 2), ("u", (1, 2, 4), 3), ("a", (3,), 4)):
                if at in before:
                    ways[after].append(way(state, f"{paid} + d.cut", lead + "K", f"{text} || chr(10) || d.role || ':' || d.text", f"NOT d.forced AND d.role[1] = '{initial}'"))
            at, lead, text = to, lead + "I", f"{text} || chr(10) || '{role}:'"
    return [f"list_sort([{', '.join(w)}])[1]" for w in ways.values()]


ORACLES = {
    "op1_warc": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS payload FROM pages
        ), d AS (
            SELECT page_id, strlen(payload) AS payload_bytes, sha256(payload) AS payload_digest, min(page_id) OVER (PARTITION BY payload) AS first FROM p
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
        FROM d
    """,
    "op2_embedding_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), links AS (
            SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.95
        ), reach(vec_id, c) AS (
            SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.y FROM reach r JOIN links l ON r.c = l.x
        ), n AS (
            SELECT x, count(*) AS n FROM links GROUP BY x
        )
        SELECT vec_id, coalesce(max(n), 0) AS n_links, min(c) AS component_id, vec_id = min(c) AS kept FROM reach LEFT JOIN n ON n.x = vec_id GROUP BY vec_id
    """,
    "op3_ngram_join": """
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
            FROM documents
        ), s AS (
            SELECT doc_id, list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
                                              WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w
        ), g AS (
            SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s
        ), links AS (
            SELECT a.doc_id AS x, b.doc_id AS y FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
        ), reach(doc_id, c) AS (
            SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON r.c = l.x
        )
        SELECT doc_id, len(any_value(s)) AS n_shingles, min(c) AS component_id FROM reach JOIN s USING (doc_id) GROUP BY doc_id
    """,
    "op9_substring_dedup": """
        WITH w AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
        ), t AS (
            SELECT doc_id, list_transform(range(1, len(w) - 33), lambda i: array_to_string(w[i:i + 34], ' ')) AS t FROM w
        ), u AS (
            SELECT doc_id, unnest(t) AS x, generate_subscripts(t, 1) AS i FROM t
        ), again AS (
            SELECT doc_id, i FROM u WHERE x IN (SELECT x FROM u GROUP BY x HAVING count(*) > 1)
        ), gone AS (
            SELECT DISTINCT doc_id, i + o.range AS k FROM again, range(35) o
        ), every AS (
            SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS k FROM w
        ), left_over AS (
            SELECT doc_id, string_agg(x, ' ' ORDER BY k) AS kept FROM every ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id
        ), removed AS (
            SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id
        )
        SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM w LEFT JOIN left_over USING (doc_id) LEFT JOIN removed USING (doc_id)
    """,
    "op5_url_filter": f"""
        WITH u AS ({_PARTS}), rules(rhost, rpath, verdict) AS (VALUES {", ".join(map(str, RULES))}), m AS (
            SELECT u.page_id, u.host, u.path, r.rhost || r.rpath AS rule, r.verdict,
                   row_number() OVER (PARTITION BY u.page_id, u.url ORDER BY length(r.rhost || r.rpath) DESC NULLS LAST, length(r.rhost) DESC) AS k
            FROM u LEFT JOIN rules r ON (u.host = r.rhost OR ends_with(u.host, '.' || r.rhost)) AND starts_with(u.path, r.rpath)
        )
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
    """,
    "op11_collocations": """
        WITH p AS (
            SELECT coalesce(lang, 'und') AS lang,
                   unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
            FROM documents
        ), w AS (
            SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p
        ), f AS (
            SELECT lang, m, phrase, count(*) AS f
            FROM (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase FROM w, (VALUES (1), (2), (3)) AS v(m))
            GROUP BY lang, m, phrase
        ), n AS (
            SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang
        ), c AS (
            SELECT *, string_split(phrase, ' ') AS g FROM f WHERE m > 1 AND f >= 10
        ), over AS (
            SELECT lang, part, max(f) AS over
            FROM (SELECT lang, f, unnest([g[1] || ' ' || g[2], g[2] || ' ' || g[3]]) AS part FROM c WHERE m = 3) GROUP BY lang, part
        ), cuts AS (
            SELECT lang, phrase, f, 1 AS k, g[1] AS x, array_to_string(g[2:m], ' ') AS y FROM c UNION ALL SELECT lang, phrase, f, 2, g[1] || ' ' || g[2], g[3] FROM c WHERE m = 3
        ), scored AS (
            SELECT c.lang, c.phrase, c.f AS a, k, l.f AS l, r.f AS r, 1000000::HUGEINT * c.f * c.f // (l.f::HUGEINT * r.f) AS score
            FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = c.x JOIN f r ON r.lang = c.lang AND r.phrase = c.y
        ), best AS (
            SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
        ), ranked AS (
            SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank
            FROM best b LEFT JOIN over o ON o.lang = b.lang AND o.part = b.phrase WHERE o.over IS NULL OR 100 * o.over < 50 * b.a
        )
        SELECT t.lang, rank, phrase, a, l, t.r, n, score::BIGINT AS score FROM ranked t JOIN n ON n.lang = t.lang WHERE rank <= 2000
    """,
    "op12_conversation_repair": f"""
        WITH RECURSIVE k AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT) AS bytes
            FROM conversations
        ), crc AS (
            SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, b:
                list_reduce(list_prepend(xor(c, b), range(8)), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END))) % 20 AS kind
            FROM k
        ), damaged AS (
            SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                   CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                   unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
            FROM crc WHERE kind <> 0
        ), placed AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS pos FROM damaged
        ), d AS (
            SELECT conv_id, pos, turn, role, text, blank, again AND NOT blank AS again, (NOT ended AND NOT blank AND NOT again)::INT AS cut, blank OR again AS forced,
                   lag(role[1]) OVER (PARTITION BY conv_id ORDER BY pos) || role[1] AS pair
            FROM (SELECT *, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank, regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') AS ended,
                         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again FROM placed)
        ), path(conv_id, pos, st) AS (
            SELECT conv_id, 0::BIGINT, [{{'c': 0, 'a': '', 'r': ''}}, {", ".join(["{'c': 1000000000, 'a': '', 'r': ''}"] * 3)}] FROM conversations GROUP BY conv_id
            UNION ALL
            SELECT p.conv_id, d.pos, [{", ".join(_repair_ways())}] FROM path p JOIN d ON d.conv_id IS NOT DISTINCT FROM p.conv_id AND d.pos = p.pos + 1
        ), best AS (
            SELECT conv_id, list_sort([st[1], st[4], {{'c': st[3].c + 2, 'a': st[3].a || 'I', 'r': st[3].r || chr(10) || 'assistant:'}},
                                       {{'c': st[2].c + 4, 'a': st[2].a || 'II', 'r': st[2].r || chr(10) || 'user:' || chr(10) || 'assistant:'}}])[1] AS w
            FROM path QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC) = 1
        ), n AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum(blank::INT) AS blank, sum(again::INT) AS duplicate, sum(cut) AS truncated,
                   count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal
            FROM d GROUP BY conv_id
        )
        SELECT b.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
               coalesce(illegal, 0)::BIGINT AS illegal, w.c::BIGINT AS cost, w.a AS audit, sha256(w.r[2:]) AS repaired_sha256
        FROM best b LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM b.conv_id
    """,
    "op13_source_mix": """
        WITH d AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size, md5('0:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
        ), s AS (
            SELECT source, sum(size) AS source_size, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM d GROUP BY source
        ), fill AS (
            SELECT *, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS words,
                   sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight
            FROM s WINDOW o AS (ORDER BY source_size * 10 / w, source NULLS LAST)
        ), clamp AS (
            SELECT *, 3 * source_size * weight <= w * words AS capped FROM fill
        ), open AS (
            SELECT sum(source_size) - coalesce(sum(3 * source_size) FILTER (WHERE capped), 0) AS words, coalesce(sum(w) FILTER (WHERE NOT capped), 1) AS weight FROM clamp
        ), t AS (
            SELECT source, source_size, CASE WHEN capped THEN (3 * source_size)::DOUBLE ELSE (w * words)::DOUBLE / weight::DOUBLE END AS target,
                   CASE WHEN capped THEN 3 * source_size ELSE w * words // weight END AS goal
            FROM (SELECT c.source, c.source_size, c.w, c.capped, o.words, o.weight FROM clamp c, open o)
        ), part AS (
            SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN goal // t.source_size ELSE 0 END AS whole,
                   CASE WHEN t.source_size > 0 THEN goal % t.source_size ELSE 0 END AS part,
                   sum(size) OVER (PARTITION BY d.source, h) AS same, sum(size) OVER (PARTITION BY d.source ORDER BY h) AS upto
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
        )
        SELECT doc_id, size::BIGINT AS size, source_size::BIGINT AS source_size, target,
               (whole * size + CASE WHEN upto <= part THEN size WHEN upto - same < part THEN size * (part - upto + same) // same ELSE 0 END)::BIGINT AS taken
        FROM part
    """,
}
