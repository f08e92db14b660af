"""One query per operator over its whole tables, and the SQL of those that SQL can express on whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import bpe, collocations, conversations, decontaminate, embeddings, langid, linededup, ngramlm, pieces, simhash, substrings, suffixdedup, urlfilter
from pagemill.llm.shared import fold_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_line_dedup")
def op1_line_dedup(spark, folder):
    out = linededup.dedup_lines(table(spark, folder, "documents"))
    return out.select("doc_id", "n_lines", F.size("removed_lines").cast("bigint").alias("n_removed"), "removed_lines")


@query("op3_byte_bpe")
def op3_byte_bpe(spark, folder):
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.encode_documents(table(spark, folder, "documents"), ranks, public_tokenizers.PATTERN, with_ids=False)


#: The rules of the query, as its contract fixes them.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


@query(
    "op4_url_filters",
    "WITH r(rule_host, rule_path, rule_verdict) AS (VALUES " + ", ".join(map(str, RULES)) + "), "
    "p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, "
    "coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages) "
    "SELECT page_id, host, path, (SELECT arg_max(rule_host || rule_path, length(rule_host || rule_path)) FROM r WHERE (host = rule_host OR host LIKE '%.' || rule_host) AND starts_with(path, rule_path)) AS rule, "
    "coalesce((SELECT arg_max(rule_verdict, length(rule_host || rule_path)) FROM r WHERE (host = rule_host OR host LIKE '%.' || rule_host) AND starts_with(path, rule_path)), 'allow') AS verdict FROM p",
)
def op4_url_filters(spark, folder):
    return urlfilter.judge_urls(table(spark, folder, "pages"), spark.createDataFrame(RULES, "host string, path string, verdict string"))


@query("op5_simhash")
def op5_simhash(spark, folder):
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query("op6_lm_scoring")
def op6_lm_scoring(spark, folder):
    held_out = F.coalesce(fold_of("doc_id") == 1, F.lit(False))
    docs = table(spark, folder, "documents").select("doc_id", "text", held_out.alias("held_out"))
    scored = ngramlm.score_texts(docs, "NOT held_out")
    return scored.select("doc_id", (~F.col("learnt")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query(
    "op7_embedding_dedup",
    "WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL), "
    "l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95), "
    "reach(a, b) AS (SELECT a, b FROM l UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a), "
    "c AS (SELECT a, min(b) AS least FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a) "
    "SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(least, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(least, vec_id)) AS kept "
    "FROM embeddings LEFT JOIN c ON vec_id = c.a LEFT JOIN n ON vec_id = n.a",
)
def op7_embedding_dedup(spark, folder):
    return embeddings.link_embeddings(table(spark, folder, "embeddings"))


@query("op8_language_id")
def op8_language_id(spark, folder):
    docs = table(spark, folder, "documents").withColumn("held_out", F.coalesce(fold_of("doc_id") == 0, F.lit(False)))
    model = langid.fit(docs.where("NOT held_out"))
    return langid.predict(docs, model, ["doc_id", "held_out"])


_WORDS9 = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


@query(
    "op9_decontamination",
    f"WITH d AS (SELECT doc_id, {_WORDS9} AS w FROM documents), b AS (SELECT item_id::VARCHAR AS item, {_WORDS9} AS w FROM benchmark), "
    "p AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[s : s + least(len(w), 10) - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS s FROM b WHERE len(w) > 0)), "
    "sizes AS (SELECT DISTINCT n FROM p), x AS (SELECT doc_id, s, n, array_to_string(w[s : s + n - 1], ' ') AS phrase FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes)), "
    "h AS (SELECT doc_id, s, p.n, item FROM x JOIN p USING (phrase) WHERE x.n = p.n), "
    "hit AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(s, s + n)) AS place FROM h) GROUP BY 1), "
    "i AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1) "
    "SELECT doc_id, len(w) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(i.n, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated "
    "FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN i USING (doc_id)",
)
def op9_decontamination(spark, folder):
    found = decontaminate.find_contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s.end - s.first)
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


@query("op2_suffix_array_dedup")
def op2_suffix_array_dedup(spark, folder):
    return suffixdedup.dedup_suffixes(table(spark, folder, "documents"), with_text=False)


@query(
    "op10_substring_dedup",
    "WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents), "
    "x AS (SELECT doc_id, s, array_to_string(w[s : s + 12], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS s FROM d)), "
    "f AS (SELECT t, min(doc_id) AS first FROM x GROUP BY t), "
    "g AS (SELECT DISTINCT doc_id, unnest(range(s, s + 13)) AS place FROM x JOIN f USING (t) WHERE first < doc_id), "
    "k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS kept, count(*) AS n FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS place FROM d) ANTI JOIN g USING (doc_id, place) GROUP BY 1) "
    "SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)",
)
def op10_substring_dedup(spark, folder):
    return substrings.dedup_substrings(table(spark, folder, "documents"), with_text=False)


@query("op11_conversation_repair")
def op11_conversation_repair(spark, folder):
    turns = table(spark, folder, "conversations")
    return conversations.repair_conversations(conversations.damage(turns), all_ids=turns)


@query("op12_sentencepiece")
def op12_sentencepiece(spark, folder):
    model = pieces.read_model(public_tokenizers.path("piece_bpe_32k.model"))
    return pieces.encode_pieces(table(spark, folder, "documents"), model, with_ids=False)


@query(
    "op13_collocations",
    "WITH p AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')), '[^\\x20\\x09]+') AS w FROM documents), "
    "o AS (SELECT lang, unnest(list_transform(range(1, len(w) + 1), lambda i: w[i : i + 2])) AS w FROM p), "
    "g AS MATERIALIZED (SELECT lang, k, array_to_string(w[1 : k], ' ') AS phrase, count(*) AS f FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS k FROM o) GROUP BY ALL), "
    "n AS (SELECT lang, sum(f) AS n FROM g WHERE k = 1 GROUP BY lang), c AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS w FROM g WHERE k > 1 AND f >= 10), "
    "parts AS MATERIALIZED (SELECT lang, k, phrase, f AS a, j, array_to_string(w[1 : j], ' ') AS front, array_to_string(w[j + 1 :], ' ') AS back FROM (SELECT *, unnest(range(1, k)) AS j FROM c)), "
    "cut AS (SELECT p.*, l.f AS l, r.f AS r, (1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f) AS score FROM parts p JOIN g l ON l.lang = p.lang AND l.phrase = front JOIN g r ON r.lang = p.lang AND r.phrase = back), "
    "best AS (SELECT lang, phrase, k, a, min((score, j, l, r)) AS m FROM cut GROUP BY ALL), "
    "inside AS (SELECT lang, phrase, max(f) AS f FROM (SELECT lang, f, unnest([array_to_string(w[1 : 2], ' '), array_to_string(w[2 : 3], ' ')]) AS phrase FROM c WHERE k = 3) GROUP BY ALL), "
    "left_over AS (SELECT b.lang, b.phrase, a, m[3] AS l, m[4] AS r, m[1]::BIGINT AS score FROM best b LEFT JOIN inside i ON b.k = 2 AND i.lang = b.lang AND i.phrase = b.phrase WHERE i.f IS NULL OR 100 * i.f < 50 * b.a), "
    "ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM left_over) "
    "SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000",
)
def op13_collocations(spark, folder):
    return collocations.mine_phrases(table(spark, folder, "documents"))
