"""One query per operator over its whole tables, with the SQL that yields the same rows where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from portage.llm import (
    chat, decontamination, fill_in_middle, lexical_search, line_dedup, near_dedup, packing, quality_classifier, quality_rules,
    sharding, substring_dedup, vector_search, warc,
)
from portage.session import shared_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark, sf_dir):
    return quality_classifier.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_decontamination(spark, sf_dir):
    found = decontamination.contaminated_documents(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), slop=decontamination.SLOP)
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
        F.size("near_items").cast("long").alias("n_near_items"), F.sha2(F.array_join("near_items", ","), 256).alias("near_sha256"),
    )


def op3_sharding(spark, sf_dir):
    shards, grown = dict.fromkeys(range(16), 1.0), dict.fromkeys(range(17), 1.0)
    return sharding.assign_shards(_table(spark, sf_dir, "documents"), shards, grown)


def op4_substring_dedup(spark, sf_dir):
    return substring_dedup.drop_repeated_passages(_table(spark, sf_dir, "documents")).drop("kept_text")


def op5_minhash_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_packing(spark, sf_dir):
    return pack(_table(spark, sf_dir, "documents"))


def pack(docs: DataFrame, with_ids: bool = False) -> DataFrame:
    """Packed with the vocabulary of ``byte_bpe_50k.json``, read as ranks, and its added tokens."""
    return packing.pack_documents(
        docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=with_ids,
        added=packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json")),
    )


def op7_warc(spark, sf_dir):
    archive = shared_dir(spark, "archive")
    warc.write_archive(_table(spark, sf_dir, "pages"), archive)
    return warc.read_page_records(spark, archive)


def op8_chat_formatting(spark, sf_dir):
    conversations = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-1, 0, "user", own), (-1, 1, "assistant", own)], conversations.schema)
    return chat.read_conversations(chat.format_conversations(conversations.union(added)))


def op9_line_dedup(spark, sf_dir):
    kept = line_dedup.drop_repeated_lines(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op10_quality_rules(spark, sf_dir):
    judged = quality_rules.judge_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return judged.drop("text_key")


def op11_fill_in_middle(spark, sf_dir):
    made = fill_in_middle.fill_in_middle(_table(spark, sf_dir, "documents"))
    back = fill_in_middle.restored(F.col("output"), F.col("form"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(back, 256).alias("restored_sha256"),
    )


def op12_vector_search(spark, sf_dir):
    return vector_search.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op13_lexical_search(spark, sf_dir):
    return lexical_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {query.__name__: query for query in (
    op1_quality_classifier, op2_decontamination, op3_sharding, op4_substring_dedup, op5_minhash_near_dedup, op6_packing,
    op7_warc, op8_chat_formatting, op9_line_dedup, op10_quality_rules, op11_fill_in_middle, op12_vector_search, op13_lexical_search,
)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SQL_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
_TERM = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"
_CONTROL_SQL = r"<\|start\|>|<\|text\|>|<\|end\|>|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|<\|im_start\|>|<\|im_end\|>" \
    r"|<\|endoftext\|>|<\|startoftext\|>|<\|system\|>|<\|user\|>|<\|assistant\|>|<unk>|<pad>"


def _form_length(column: str) -> str:
    """Characters of a text's form: four more for each control string or mark, if it has to be escaped."""
    return (
        f"length({column}) + CASE WHEN regexp_matches({column}, '{_CONTROL_SQL}|\\\\u[0-9a-f]+;') "
        f"THEN 4 * len(regexp_extract_all({column}, '{_CONTROL_SQL}|\\\\u')) ELSE 0 END"
    )


ORACLE_SQL = {
    "op2_decontamination": rf"""
        WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item_id,
                regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        item_window AS (SELECT DISTINCT item_id, array_to_string(w[s:s + 9], ' ') AS phrase, least(len(w), 10) AS n
            FROM item, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(s) WHERE len(w) > 0),
        doc AS (SELECT doc_id, row_number() OVER () AS r,
                regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        place AS (SELECT r, s, n, array_to_string(w[s:s + n - 1], ' ') AS phrase
            FROM doc, unnest(range(1, len(w) + 1)) AS t(s), (SELECT DISTINCT n FROM item_window) WHERE s + n - 1 <= len(w)),
        hit AS (SELECT r, s, n, item_id FROM place JOIN item_window USING (phrase, n)),
        word AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM hit) GROUP BY r),
        held AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
            FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r),
        spot AS (SELECT r, s, w[s] AS t FROM doc, unnest(range(1, len(w) + 1)) AS t(s)),
        often AS (SELECT t, count(*) AS c FROM spot GROUP BY t),
        bag AS (SELECT DISTINCT item_id, n + 2 AS reach, list_sort(list_distinct(string_split(phrase, ' '))) AS terms FROM item_window),
        rare AS (SELECT item_id, reach, terms, t FROM (SELECT *, unnest(terms) AS t FROM bag) JOIN often USING (t)
            QUALIFY row_number() OVER (PARTITION BY item_id, reach, terms ORDER BY c, t) = 1),
        close AS (SELECT r, s, w, item_id, reach, terms FROM rare JOIN spot USING (t) JOIN doc USING (r)
            WHERE list_has_all(w[greatest(1, s - reach + 1):s + reach - 1], terms)),
        around AS (SELECT r, count(*) AS n_near, string_agg(item_id, ',' ORDER BY item_id) AS near FROM (
            SELECT DISTINCT r, item_id FROM close, unnest(range(greatest(1, s - reach + 1), s + 1)) AS t(a)
            WHERE list_has_all(w[a:a + reach - 1], terms)) GROUP BY r)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
            sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
            coalesce(n_near, 0) AS n_near_items, sha256(coalesce(near, '')) AS near_sha256
        FROM doc LEFT JOIN word USING (r) LEFT JOIN held USING (r) LEFT JOIN around USING (r)""",
    "op4_substring_dedup": rf"""
        WITH doc AS (SELECT doc_id, {_SQL_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
        place AS (SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS phrase
            FROM doc, unnest(range(1, len(w) - 18)) AS t(s)),
        later AS (SELECT doc_id, s FROM place QUALIFY row_number() OVER (PARTITION BY phrase ORDER BY doc_id, s) > 1),
        gone AS (SELECT doc_id, list(DISTINCT p) AS g FROM (SELECT doc_id, unnest(range(s, s + 20)) AS p FROM later)
            GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(len(g), 0) AS n_removed, sha256(CASE WHEN g IS NULL
            THEN array_to_string(w, ' ') ELSE array_to_string(list_filter(w, lambda x, i: NOT list_contains(g, i)), ' ') END
            ) AS kept_sha256
        FROM doc LEFT JOIN gone USING (doc_id)""",
    "op5_minhash_near_dedup": rf"""
        WITH RECURSIVE doc AS (SELECT doc_id, {_SQL_WORDS.format(text=_LOWER)} AS w FROM documents),
        shingles AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_sort(list_distinct(list_transform(
            range(1, greatest(len(w) - 4, 1) + 1), lambda s: array_to_string(w[s:s + 4], ' ')))) END AS x FROM doc),
        one AS (SELECT min(doc_id) AS node, x, len(x) AS n FROM shingles WHERE len(x) > 0 GROUP BY x),
        term AS (SELECT node, n, unnest(x) AS t FROM one),
        pair AS (SELECT a.node AS u, b.node AS v FROM term a JOIN term b ON a.t = b.t AND a.node < b.node
            GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
        edge AS (SELECT u, v FROM pair UNION ALL SELECT v, u FROM pair),
        reach(node, other) AS (SELECT node, node FROM one UNION SELECT reach.node, edge.v FROM reach JOIN edge ON reach.other = edge.u),
        component AS (SELECT node, min(other) AS c FROM reach GROUP BY node)
        SELECT s.doc_id, len(s.x) AS n_shingles, coalesce(c, s.doc_id) AS component_id, coalesce(c, s.doc_id) = s.doc_id AS kept
        FROM shingles s LEFT JOIN one ON one.x = s.x LEFT JOIN component ON component.node = one.node""",
    "op7_warc": """
        WITH page AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        marked AS (SELECT page_id, h, max(page_id) OVER (PARTITION BY h) AS newest, strlen(h) AS n FROM page)
        SELECT page_id, n AS payload_bytes, sha1(h) AS payload_digest,
            CASE WHEN n >= 1000 AND page_id < newest THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN n >= 1000 AND page_id < newest THEN newest END AS refers_to
        FROM marked""",
    "op8_chat_formatting": rf"""
        WITH turn AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(9 + {_form_length('role')} + 8 + {_form_length('text')} + 8) AS BIGINT) AS formatted_chars
        FROM turn GROUP BY conv_id""",
    "op9_line_dedup": rf"""
        WITH raw AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS every FROM documents),
        solid AS (SELECT doc_id, every, list_filter(range(1, len(every) + 1),
            lambda i: regexp_matches(every[i], '[^\x20\x09-\x0D]')) AS places FROM raw),
        doc AS (SELECT doc_id, every, places, list_transform(places, lambda i: array_to_string(
            {_SQL_WORDS.format(text='every[i]')}, ' ')) AS l, list_transform(places, lambda i: len({_SQL_WORDS.format(text='every[i]')})) AS n FROM solid),
        line AS (SELECT doc_id, l, n, unnest(range(1, len(l) + 1)) AS p FROM doc),
        run AS (
            SELECT doc_id, l, p AS s, list_filter(range(p, least(len(l), p + 19) + 1), lambda e: list_sum(n[p:e]) >= 20)[1] AS e FROM line
            UNION ALL
            SELECT doc_id, l, list_filter(range(greatest(1, p - 19), p + 1), lambda s: list_sum(n[s:p]) >= 20)[-1], p FROM line),
        named AS (SELECT DISTINCT doc_id, s, e, array_to_string(l[s:e], chr(10)) AS content FROM run WHERE s IS NOT NULL AND e IS NOT NULL),
        later AS (SELECT doc_id, s, e FROM named QUALIFY row_number() OVER (PARTITION BY content ORDER BY doc_id, s) > 1),
        gone AS (SELECT doc_id, list(DISTINCT p) AS g FROM (SELECT doc_id, unnest(range(s, e + 1)) AS p FROM later) GROUP BY doc_id)
        SELECT doc_id, len(l) AS n_lines, coalesce(len(g), 0) AS n_removed, sha256(array_to_string(CASE WHEN g IS NULL THEN every
            ELSE list_filter(every, lambda x, i: NOT coalesce(list_contains(g, list_position(places, i)), false)) END, chr(10))) AS kept_sha256
        FROM doc LEFT JOIN gone USING (doc_id)""",
    "op11_fill_in_middle": r"""
        WITH doc AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
                regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS t FROM documents),
        drawn AS (SELECT doc_id, text, t, len(t) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(t) + 1) AS one,
                CAST('0x' || h[9:16] AS BIGINT) % (len(t) + 1) AS two, CAST('0x' || h[17:24] AS BIGINT) % 100 AS rate,
                CAST('0x' || h[25:32] AS BIGINT) % 100 AS suffix_first FROM doc),
        parted AS (SELECT doc_id, text, n, array_to_string(t[1:least(one, two)], '') AS p,
                array_to_string(t[least(one, two) + 1:greatest(one, two)], '') AS m, array_to_string(t[greatest(one, two) + 1:n], '') AS s,
                CASE WHEN text = '' OR rate >= 50 OR regexp_matches(text, '<[PSM]>') THEN 'plain'
                    WHEN suffix_first < 80 THEN 'spm' ELSE 'psm' END AS form FROM drawn)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
            CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars, sha256(CASE form WHEN 'plain' THEN text
                WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
            sha256(text) AS restored_sha256
        FROM parted""",
    "op12_vector_search": """
        WITH whole AS (SELECT vec_id, row_number() OVER () AS r,
                list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (SELECT q.vec_id AS query_id, q.r AS k, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
            FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND q.r <> c.r)
        SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM scored
        WINDOW w AS (PARTITION BY k ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5""",
    "op13_lexical_search": rf"""
        WITH doc AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, {_TERM}) AS t FROM documents),
        total AS (SELECT count(*) FILTER (len(t) > 0) AS docs, CAST(sum(len(t)) AS BIGINT) AS terms FROM doc),
        term AS (SELECT r, doc_id, len(t) AS n, unnest(t) AS t FROM doc),
        posting AS (SELECT r, doc_id, n, t, count(*) AS tf FROM term GROUP BY r, doc_id, n, t),
        weight AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
            FROM posting, total GROUP BY t),
        wanted AS (SELECT k, item_id, unnest(t) AS t FROM (
            SELECT row_number() OVER () AS k, item_id, regexp_extract_all({_LOWER}, {_TERM}) AS t FROM benchmark)),
        scored AS (SELECT k, item_id, r, doc_id,
                CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // terms)))) AS BIGINT) AS score
            FROM wanted JOIN weight USING (t) JOIN posting USING (t), total GROUP BY k, item_id, r, doc_id)
        SELECT item_id, CAST(row_number() OVER w AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
        WINDOW w AS (PARTITION BY k ORDER BY score DESC, doc_id) QUALIFY row_number() OVER w <= 10""",
}
