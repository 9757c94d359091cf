"""The queries of this package over a folder of tables, and SQL for those that SQL can express."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import (
    ann, collocations, decontaminate, importance, quality, sentencepieces, simhash, substrings, token_counts, toolcalls, toxicity, urlgraph, warc,
)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: rules of the URL query: verdict, host, path
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"),
         ("block", "com", "/de/")]


def op1_hnsw_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return ann.nearest(_table(spark, sf, "embeddings"))


def op2_toxicity_chain(spark: SparkSession, sf: str) -> DataFrame:
    made = toxicity.scored(_table(spark, sf, "documents").select("doc_id", "text"), toxicity.chain_labels(_table(spark, sf, "labels")))
    return made.drop("text")


def op3_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_simhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf, "documents"))


def op5_warc_archives(spark: SparkSession, sf: str) -> DataFrame:
    return warc.archived(_table(spark, sf, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_benchmark_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.contained(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))


def op7_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    made = substrings.deduplicated(_table(spark, sf, "documents").select("doc_id", "text"))
    return made.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    return sentencepieces.encoded(_table(spark, sf, "documents"), public_tokenizers.path("piece_bpe_32k.model"), keep_ids=False)


def op9_url_link_graph(spark: SparkSession, sf: str) -> DataFrame:
    return urlgraph.judged(_table(spark, sf, "pages"), RULES).drop("trust", "distrust")


def op10_tool_calls(spark: SparkSession, sf: str) -> DataFrame:
    schemas = spark.sql("""SELECT * FROM VALUES ('lookup', 'query', 'string', true), ('lookup', 'words', 'integer', true),
        ('answer', 'query', 'array', true), ('answer', 'words', 'integer', true), ('answer', 'lang', 'string', false)
        AS schemas(tool, parameter, type, required)""")
    calls, results, context = toolcalls.exchanges(_table(spark, sf, "conversations"))
    return toolcalls.formatted(calls, results, schemas).unionByName(context).withColumn("problems", F.array_join("problems", "; "))


def op11_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf, "documents"))


def op12_importance_resampling(spark: SparkSession, sf: str) -> DataFrame:
    return importance.resampled(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))


def op13_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality.judged(_table(spark, sf, "documents"), _table(spark, sf, "labels").where("quality = 1"))


QUERIES = {f.__name__: f for f in (
    op1_hnsw_neighbours, op2_toxicity_chain, op3_token_counts, op4_simhash_near_dedup, op5_warc_archives,
    op6_benchmark_decontamination, op7_substring_dedup, op8_sentencepiece, op9_url_link_graph, op10_tool_calls,
    op11_collocations, op12_importance_resampling, op13_quality_rules)}



_LINK = r"(?i)href\s*=\s*[\x22\x27]?(?:https?:)?//([^/?#\x22\x27\s<>]+)"


def _graph_sql(rounds: int = 400, damping: float = urlgraph.DAMPING) -> str:
    """The propagation of op9, by recursion over far more rounds than it takes to settle."""
    cases = "\n".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{v}|{h}{p}'"
        for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2])))
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
        WITH RECURSIVE parts AS (SELECT page_id, html, {lower.format("coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')")} AS host,
                coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
        hit AS MATERIALIZED (SELECT *, CASE {cases} END AS hit FROM parts),
        links AS (SELECT host AS src, {lower.format(f"unnest(regexp_extract_all(html, '{_LINK}', 1))")} AS dst
            FROM hit WHERE host <> ''),
        up AS (SELECT DISTINCT host, regexp_extract(host, '^[^.]+\.([^.]+\..+)$', 1) AS parent FROM hit WHERE host <> ''),
        edges AS (SELECT src, dst, count(*) AS n FROM (SELECT src, dst FROM links WHERE src <> dst
            UNION ALL SELECT host, parent FROM up WHERE parent <> '' UNION ALL SELECT parent, host FROM up WHERE parent <> '') GROUP BY src, dst),
        both_ways AS (SELECT 'trust' AS kind, src, dst, n FROM edges UNION ALL SELECT 'distrust', dst, src, n FROM edges),
        steps AS MATERIALIZED (SELECT kind, src, dst, n::DOUBLE / sum(n) OVER (PARTITION BY kind, src) AS share FROM both_ways),
        seeds AS (SELECT host, CASE WHEN hit LIKE 'allow%' THEN 'trust' ELSE 'distrust' END AS kind, count(*) AS n FROM hit WHERE hit IS NOT NULL GROUP BY ALL),
        r0 AS MATERIALIZED (SELECT host, kind, n::DOUBLE / sum(n) OVER (PARTITION BY kind) AS rank FROM seeds),
        walk AS (SELECT host, kind, rank, 0 AS round FROM r0
            UNION ALL SELECT host, kind, sum(rank), max(round) FROM (
                SELECT dst AS host, s.kind, rank * share * {damping} AS rank, round + 1 AS round FROM steps s JOIN walk w ON s.kind = w.kind AND s.src = w.host WHERE round < {rounds}
                UNION ALL SELECT host, kind, rank * {1 - damping}, (SELECT max(round) + 1 FROM walk) FROM r0 WHERE (SELECT max(round) FROM walk) < {rounds})
            GROUP BY host, kind),
        scores AS (SELECT host, coalesce(sum(rank) FILTER (kind = 'trust'), 0) AS t, coalesce(sum(rank) FILTER (kind = 'distrust'), 0) AS d
            FROM walk WHERE round = {rounds} GROUP BY host)
        SELECT page_id, host, path, split_part(hit, '|', 2) AS rule,
            CASE WHEN hit IS NOT NULL THEN split_part(hit, '|', 1) WHEN coalesce(d, 0) > coalesce(t, 0) * {urlgraph.FACTOR} THEN 'block' ELSE 'allow' END AS verdict
        FROM hit LEFT JOIN scores USING (host)"""


ORACLES = {
    "op5_warc_archives": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha256(h) AS payload_digest,
              min(page_id) OVER (PARTITION BY h) AS head FROM p)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND head <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND head <> page_id THEN head END AS refers_to FROM d""",
    "op9_url_link_graph": _graph_sql(),
    "op10_tool_calls": r"""
        WITH RECURSIVE t AS (SELECT conv_id AS conversation, turn::BIGINT AS turn, role, text, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM conversations),
        asked AS (SELECT DISTINCT conversation, turn, 'call_' || turn AS call_id, CASE WHEN words <= 20 THEN 'lookup' ELSE 'answer' END AS name, contains(text, chr(10)) AS many,
                  '{"query":' || CASE WHEN contains(text, chr(10)) THEN to_json(string_split(text, chr(10)))::VARCHAR ELSE to_json(text)::VARCHAR END || ',"words":' || words || '}' AS arguments,
                  CASE WHEN turn >= 2 THEN 'call_' || (turn - 2) END AS parent FROM t WHERE role = 'user'),
        numbered AS (SELECT *, row_number() OVER (PARTITION BY conversation, call_id ORDER BY turn, name, arguments, parent NULLS FIRST) AS place FROM asked),
        calls AS (SELECT * FROM numbered WHERE place = 1),
        levels AS (SELECT conversation, call_id, 0 AS level FROM calls c WHERE parent IS NULL OR NOT EXISTS (
                       SELECT 1 FROM calls p WHERE p.conversation = c.conversation AND p.call_id = c.parent)
                   UNION ALL SELECT c.conversation, c.call_id, level + 1 FROM levels l JOIN calls c ON c.conversation = l.conversation AND c.parent = l.call_id),
        told AS (SELECT conversation, 'call_' || (turn - 1) AS call_id, text AS content, count(*) AS n FROM t WHERE role = 'assistant' GROUP BY ALL),
        answers AS (SELECT conversation, call_id, min(content) AS content, sum(n)::BIGINT AS results FROM told GROUP BY ALL),
        every AS (SELECT n.*, CASE WHEN place = 1 THEN level END AS level, CASE WHEN place = 1 THEN content END AS content,
                  CASE WHEN place = 1 THEN results END AS results FROM numbered n LEFT JOIN levels USING (conversation, call_id) LEFT JOIN answers USING (conversation, call_id)),
        checked AS (SELECT *, concat_ws('; ', CASE WHEN many <> (name = 'answer') THEN 'type of query' END,
                    CASE WHEN level = 0 AND parent IS NOT NULL THEN 'unknown parent' END) AS problems FROM every)
        SELECT conversation, turn, call_id, level::BIGINT AS level, CASE WHEN place > 1 THEN 'duplicate' WHEN results IS NULL THEN 'pending' ELSE 'linked' END AS status,
               coalesce(results, 0) AS results, problems, problems = '' AS valid,
               '{"arguments":' || arguments || ',"id":"' || call_id || '","name":"' || name || '"' ||
               CASE WHEN parent IS NOT NULL THEN ',"parent":"' || parent || '"' ELSE '' END ||
               CASE WHEN content IS NOT NULL THEN ',"result":' || to_json(content) ELSE '' END || '}' AS message FROM checked
        UNION ALL SELECT r.conversation, NULL, r.call_id, NULL, CASE WHEN c.call_id IS NULL THEN 'orphan' ELSE 'extra' END, n,
               CASE WHEN c.call_id IS NULL THEN 'unknown call' ELSE '' END, c.call_id IS NOT NULL,
               '{"id":"' || r.call_id || '"' || CASE WHEN r.content IS NOT NULL THEN ',"result":' || to_json(r.content) ELSE '' END || '}'
        FROM told r LEFT JOIN calls c USING (conversation, call_id) LEFT JOIN answers a ON a.conversation = r.conversation AND a.call_id = r.call_id
        WHERE c.call_id IS NULL OR r.content IS DISTINCT FROM a.content
        UNION ALL SELECT conversation, turn, NULL, NULL, 'context', 0, '', true,
               '{' || CASE WHEN text IS NOT NULL THEN '"content":' || to_json(text) || ',' ELSE '' END || '"role":' || to_json(role) || '}'
        FROM t WHERE role NOT IN ('user', 'assistant')""",
    "op6_benchmark_decontamination": r"""
        WITH texts AS (
            SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
            UNION ALL
            SELECT 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') FROM benchmark),
        widths AS (SELECT DISTINCT least(5, len(w)) AS k FROM texts WHERE kind = 'b' AND len(w) > 0),
        places AS (SELECT kind, id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM texts, widths
                   WHERE kind = 'd' OR k = least(5, len(w))),
        shingles AS (SELECT DISTINCT kind, id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM places),
        sizes AS (SELECT id, count(*) AS n FROM shingles WHERE kind = 'b' GROUP BY id)
        SELECT d.id AS doc_id, b.id AS item_id, any_value(n)::INTEGER AS item_shingles, count(*)::INTEGER AS shared_shingles,
               count(*)::DOUBLE / any_value(n) AS containment
        FROM shingles d JOIN shingles b ON d.s = b.s AND d.k = b.k AND d.kind = 'd' AND b.kind = 'b' JOIN sizes ON sizes.id = b.id
        GROUP BY d.id, b.id HAVING 5 * count(*) >= 4 * any_value(n)""",
    "op7_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        windows AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s
                    FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM d)),
        firsts AS (SELECT s, min(doc_id) AS f FROM windows GROUP BY s),
        gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS p FROM windows JOIN firsts USING (s) WHERE f < doc_id),
        words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS k, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)""",
    "op11_collocations": r"""
        WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
            words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
            places AS (SELECT lang, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i FROM words, (SELECT unnest([1, 2, 3, 4]) AS size)),
            f AS MATERIALIZED (SELECT lang, w[i:i + size - 1] AS p, count(*) AS n FROM places GROUP BY ALL HAVING count(*) >= 30),
            candidates AS (SELECT lang, p, n AS a FROM f WHERE len(p) > 1),
            cuts AS (SELECT c.lang, c.p, a, k, x.n AS l, y.n AS r, (2000000::HUGEINT * a // (x.n + y.n))::BIGINT AS score
                FROM (SELECT *, unnest(generate_series(1, len(p) - 1)) AS k FROM candidates) c
                JOIN f x ON x.lang = c.lang AND x.p = c.p[:k] JOIN f y ON y.lang = c.lang AND y.p = c.p[k + 1:]),
            best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
            inner_parts AS (SELECT DISTINCT lang, p[i:i + w - 1] AS p, a AS longer FROM (SELECT *, unnest(generate_series(1, len(p) - w + 1)) AS i
                FROM (SELECT *, unnest(generate_series(2, len(p) - 1)) AS w FROM candidates))),
            kept AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM inner_parts x WHERE x.lang = b.lang AND x.p = b.p AND 100::HUGEINT * longer >= 80::HUGEINT * b.a)),
            ranked AS (SELECT *, array_to_string(p, ' ') AS phrase FROM kept)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
        FROM ranked JOIN (SELECT lang, count(*) AS n FROM (SELECT lang, unnest(w) FROM words) GROUP BY lang) USING (lang)
        QUALIFY rank <= 2000""",
}
