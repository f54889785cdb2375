"""The registered query of each operator, with its production parameters, and SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitsliced, chat, multi_index, near_dedup, packing, pieces, pii, quality, shards, url_rules
from .common import Workspace, table


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places and checksums of pieces; the operator gives their ids too."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), length=1024, end_id=0).drop("ids")


SITE_RULES = [
    url_rules.Rule.site("block", "net/"),
    url_rules.Rule.site("allow", "example.net/en/"),
    url_rules.Rule.site("block", "example.com/de/"),
    url_rules.Rule.site("allow", "org/fr/"),
]
#: What no site rule decides is blocked for these words in host or path.
BLOCKED_WORDS = ["adult", "bets", "casino", "porn", "xxx"]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"), SITE_RULES + [url_rules.Rule.word("block", w) for w in BLOCKED_WORDS])


def op4_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.search(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0", k=20)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_nbest_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.segment(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), n=4)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the whole text with pseudonyms, and how many spans of each kind were replaced."""
    out = pii.digest(table(spark, sf_dir, "documents"), pii.key_of(spark))
    return out.select("doc_id", "text", F.coalesce(F.size("pii"), F.lit(0)).cast("long").alias("n_replaced"), "pii")


def op8_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: from the files of rewritten shards, and from the plan where a shard keeps its rows."""
    docs, work = table(spark, sf_dir, "documents"), Workspace(spark, "shards")
    plan = work.save(shards.reshard(docs, old_shards=32, new_shards=40, work=work), "plan")
    files = shards.rewrite(docs, plan, f"{work.root}/files")
    work.keep("files", "plan")
    text = F.coalesce("text", F.lit(""))
    size = F.octet_length(text).cast("long") + shards.OVERHEAD
    written = files.select("doc_id", size.alias("size"), F.crc32(text).alias("text_crc32"), "shard", "slot")
    as_before = plan.join(F.broadcast(shards.affected(plan)), "shard", "left_anti").select(*written.columns)
    return written.unionByName(as_before).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitsliced.top_k(table(spark, sf_dir, "embeddings"), "vec_id % 100 = 0", k=10, scale=1024)


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat.digests(chat.format_conversations(chat.as_events(rows)))


QUERIES = {
    "op1_near_dedup": op1_near_dedup,
    "op2_pack": op2_pack,
    "op3_url_filter": op3_url_filter,
    "op4_ann_search": op4_ann_search,
    "op5_quality": op5_quality,
    "op6_nbest_segment": op6_nbest_segment,
    "op7_pii": op7_pii,
    "op8_reshard": op8_reshard,
    "op9_top_k": op9_top_k,
    "op10_chat_format": op10_chat_format,
}

ORACLE_SQL: dict[str, str] = {
    "op1_near_dedup": r"""
        WITH RECURSIVE said AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), sets AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) END AS s FROM said
        ), entries AS (
            SELECT min(doc_id) AS rep, len(s) AS n, unnest(s) AS x FROM sets WHERE len(s) > 0 GROUP BY s
        ), shared AS (
            SELECT a.rep AS a, b.rep AS b, count(*) AS ab, any_value(a.n) AS na, any_value(b.n) AS nb
            FROM entries a JOIN entries b ON a.x = b.x AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY 1, 2
        ), links AS (
            SELECT a, b FROM shared WHERE 100 * ab >= 80 * (na + nb - ab)
        ), edges AS (
            SELECT a, b FROM links UNION ALL SELECT b, a FROM links
        ), reach AS (
            SELECT rep AS a, rep AS b FROM (SELECT DISTINCT rep FROM entries)
            UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a
        ), least AS (
            SELECT a AS rep, min(b) AS component FROM reach GROUP BY a
        ), reps AS (
            SELECT s, min(doc_id) AS rep FROM sets WHERE len(s) > 0 GROUP BY s
        )
        SELECT doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, coalesce(component, doc_id) AS component_id, coalesce(component, doc_id) = doc_id AS kept
        FROM sets LEFT JOIN reps ON sets.s = reps.s LEFT JOIN least ON reps.rep = least.rep""",
    "op9_top_k": """
        WITH fine AS (
            SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0
              AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, r.vec_id, CAST(list_sum([z[1] * z[2] FOR z IN list_zip(q.v, r.v)]) AS BIGINT) AS score
            FROM fine q JOIN fine r ON q.vec_id % 100 = 0 AND q.vec_id <> r.vec_id AND len(q.v) = len(r.v)
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10""",
    "op10_chat_format": r"""
        WITH rows AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
        ), marked AS (
            SELECT *, length(text) + len(regexp_extract_all(text,
                '<\\*\|im_start\|>|<\\*\|im_end\|>|<\\*s>|<\\*/s>|\[\\*INST\]|\[\\*/INST\]|<\\*<SYS>>|<\\*</SYS>>')) AS escaped
            FROM rows
        )
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(length('<|im_start|>') + length(role) + 1 + escaped + length('<|im_end|>') + 1) AS BIGINT) AS formatted_chars
        FROM marked GROUP BY conv_id""",
    "op3_url_filter": r"""
        WITH parts AS (
            SELECT page_id, instr(url, '://') AS mark, substr(url, instr(url, '://') + 3) AS rest FROM pages
        ), split AS (
            SELECT page_id,
                   CASE WHEN mark > 0 THEN lower(regexp_extract(rest, '^[^/?#]*')) ELSE '' END AS host,
                   CASE WHEN mark > 0 THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
            FROM parts
        ), ruled AS (
            SELECT page_id, host, path, CASE
                WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
                WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
                WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
                WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/'
            END AS rule FROM split
        )
        SELECT page_id, host, path, rule, CASE
            WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
            WHEN rule IS NOT NULL THEN 'allow'
            WHEN regexp_matches(translate(host || path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '(^|[^0-9a-z])(adult|bets|casino|porn|xxx)([^0-9a-z]|$)') THEN 'block'
            ELSE 'allow' END AS verdict
        FROM ruled""",
}
