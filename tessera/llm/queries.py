"""The registered queries of this subpackage: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import documents
from .exact_dedup import copies_in
from .license_scan import license_scan
from .maxscore import top_k
from .ngram_join import similarity_classes
from .packing import packed
from .piece_codec import encoded
from .quality import quality_scores
from .substring import repeated_spans
from .token_counts import token_counts
from .toxicity import toxic_documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_topk_search": lambda spark, d: top_k(documents(spark, d), documents(spark, d, "benchmark")),
    "op2_toxicity": lambda spark, d: toxic_documents(documents(spark, d), documents(spark, d, "labels")),
    "op3_exact_dedup": lambda spark, d: copies_in(documents(spark, d)),
    "op4_packing": lambda spark, d: packed(documents(spark, d)),
    "op5_piece_codec": lambda spark, d: encoded(documents(spark, d)),
    "op6_token_counts": lambda spark, d: token_counts(documents(spark, d)),
    "op7_substring_dedup": lambda spark, d: repeated_spans(documents(spark, d)).select("doc_id", "first_word", "n_words", "of_doc_id"),
    "op8_ngram_jaccard": lambda spark, d: similarity_classes(documents(spark, d)),
    "op9_license_scan": lambda spark, d: license_scan(documents(spark, d)),
    "op10_quality": lambda spark, d: quality_scores(documents(spark, d), documents(spark, d, "labels")),
}

_WORDS = r"regexp_extract_all(lower(text), '[a-z0-9\x{80}-\x{10FFFF}]+')"

ORACLE_SQL: dict[str, str] = {
    "op1_topk_search": rf"""
        WITH q AS (SELECT item_id, unnest(list_distinct({_WORDS})) AS w FROM benchmark),
        d AS (SELECT doc_id, {_WORDS} AS ws FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
        n AS (SELECT count(*) AS n, sum(len(ws))::DOUBLE / count(*) AS avgdl FROM d),
        occ AS (SELECT doc_id, len(ws) AS dl, unnest(ws) AS w FROM d),
        p AS (SELECT doc_id, dl, w, count(*) AS tf FROM occ WHERE w IN (SELECT w FROM q) GROUP BY ALL),
        df AS (SELECT w, count(*) AS df FROM p GROUP BY w),
        s AS (SELECT doc_id, w, floor(1000.0::DOUBLE * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 2.2::DOUBLE)
                / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)))::BIGINT AS impact FROM p JOIN df USING (w), n),
        t AS (SELECT item_id, doc_id, sum(impact)::BIGINT AS score FROM q JOIN s USING (w) GROUP BY ALL HAVING sum(impact) > 0)
        SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM t
        QUALIFY rank <= 10
    """,
    "op3_exact_dedup": """
        SELECT doc_id, keep_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS keep_id FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL)
        WHERE doc_id <> keep_id
    """,
    "op7_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(text, '[^ \t\n\r\v\f]+') AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
        x AS (SELECT doc_id, unnest(list_transform(range(len(w) - 44), lambda p: {'p': p, 'k': md5(array_to_string(w[p + 1:p + 45], ' '))})) AS x FROM d WHERE len(w) >= 45),
        f AS (SELECT doc_id, x.p AS p, first_value(doc_id) OVER o AS of_doc_id, first_value(x.p) OVER o AS of_p FROM x WINDOW o AS (PARTITION BY x.k ORDER BY doc_id, x.p)),
        r AS (SELECT *, p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 45 AS gap FROM f WHERE doc_id <> of_doc_id OR p <> of_p),
        s AS (SELECT *, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM r)
        SELECT doc_id, min(p) AS first_word, max(p) + 45 - min(p) AS n_words, arg_min(of_doc_id, p) AS of_doc_id FROM s GROUP BY doc_id, run
    """,
    "op8_ngram_jaccard": r"""
        WITH RECURSIVE d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(lower(text), '[a-z0-9\x{80}-\x{10FFFF}]+') AS w
              FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL)),
        g AS (SELECT k, doc_id, list_distinct(list_transform(range(1, greatest(len(w) - 1, 2)), lambda i: array_to_string(w[i:i + 2], ' '))) AS s FROM d WHERE len(w) > 0),
        e AS (SELECT k, doc_id, len(s) AS n, unnest(s) AS x FROM g),
        p AS (SELECT any_value(l.doc_id) AS a, any_value(r.doc_id) AS b
              FROM e l JOIN e r ON l.x = r.x AND l.doc_id < r.doc_id GROUP BY l.k, r.k HAVING count(*) / (any_value(l.n) + any_value(r.n) - count(*)) >= 0.6),
        q AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
        c(id, root) AS (SELECT DISTINCT a, a FROM q UNION SELECT q.b, c.root FROM c JOIN q ON q.a = c.id WHERE c.root < q.b),
        m AS (SELECT id, min(root) AS root FROM c GROUP BY id),
        n AS (SELECT a, count(*) AS links FROM q GROUP BY a)
        SELECT i.doc_id, coalesce(m.root, i.doc_id) AS class_id, coalesce(n.links, 0) AS links
        FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) i LEFT JOIN m ON m.id = i.doc_id LEFT JOIN n ON n.a = i.doc_id
    """,
}
