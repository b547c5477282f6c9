"""SQL for the catalogue's queries, in DuckDB's dialect; loops of fixed length are unrolled."""

from __future__ import annotations

from tessera.functions.hashing import PRIME, family
from tessera.functions.text import STOPWORDS

REVIEWS = "reviews AS (SELECT o_custkey AS u, l_partkey AS b, ceil(l_quantity / 10)::DOUBLE AS stars FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
UB = f"{REVIEWS}, ub AS (SELECT DISTINCT u, b FROM reviews)"
RATINGS = f"{REVIEWS}, ratings AS (SELECT u, b, avg(stars) AS stars FROM reviews GROUP BY ALL)"
HELD_OUT = "(u * 7 + b * 13) % 50 = 0"
WORDS = r"list_filter(regexp_split_to_array(regexp_replace(lower(text), '[[:punct:]0-9]', '', 'g'), '\s+'), lambda w: w <> '')"
OCC = f"occ AS (SELECT source, lang, unnest({WORDS}) AS word FROM documents)"
BASKETS = "bk AS (SELECT DISTINCT l_orderkey AS k, p_brand AS i FROM lineitem JOIN part ON l_partkey = p_partkey)"


def itemsets(k: int, support: int) -> str:
    """SELECT items, support of frequent itemsets of size k over bk(k, i)."""
    names = [f"b{j}" for j in range(k)]
    joins = "".join(f" JOIN bk {b} ON {b}.k = b0.k AND {a}.i < {b}.i" for a, b in zip(names, names[1:]))
    items = ", ".join(f"{b}.i" for b in names)
    return f"SELECT concat_ws(',', {items}) AS items, count(*) AS support FROM bk b0{joins} GROUP BY {items} HAVING count(*) >= {support}"


def minimum(n: int, x: str = "u") -> str:
    return ", ".join(f"min(({a}::BIGINT * {x} + {b}) % {PRIME}) AS h{j}" for j, (a, b) in enumerate(family(n)))


def banded(n: int, rows: int, x: str = "u", member: str = "b", source: str = "ub") -> str:
    """sig and bands CTEs: bd(id, band, key)."""
    keys = ", ".join("concat_ws('-', " + ", ".join(f"h{j}" for j in range(k, k + rows)) + ")" for k in range(0, n, rows))
    return f"sig AS (SELECT {member} AS id, {minimum(n, x)} FROM {source} GROUP BY {member}), bd AS (SELECT id, unnest(range({n // rows})) AS band, unnest([{keys}]) AS key FROM sig)"


def model(ratings: str, member: str, other: str, least: int, prune: bool = True) -> str:
    """SELECT a, b, n, sim (positive Pearson) of pairs of members."""
    enough = f"SELECT * FROM {ratings} WHERE {member} IN (SELECT {member} FROM {ratings} GROUP BY 1 HAVING count(*) >= {least})" if prune else f"SELECT * FROM {ratings}"
    return f"""SELECT a, b, n, round((n * sxy - sx * sy) / (sqrt(n * sxx - sx * sx) * sqrt(n * syy - sy * sy)), 6) AS sim FROM (
        SELECT x.{member} AS a, y.{member} AS b, count(*) AS n, sum(x.stars) AS sx, sum(y.stars) AS sy, sum(x.stars * x.stars) AS sxx, sum(y.stars * y.stars) AS syy, sum(x.stars * y.stars) AS sxy
        FROM ({enough}) x JOIN ({enough}) y ON x.{other} = y.{other} AND x.{member} < y.{member} GROUP BY 1, 2 HAVING count(*) >= {least})
        WHERE n * sxx - sx * sx > 1e-9 AND n * syy - sy * sy > 1e-9 AND round((n * sxy - sx * sy) / (sqrt(n * sxx - sx * sx) * sqrt(n * syy - sy * sy)), 6) > 0"""


TFIDF = f"""{OCC}, tf AS (SELECT source AS id, word, count(*) AS tf FROM occ GROUP BY ALL), most AS (SELECT id, max(tf) AS most FROM tf GROUP BY id),
    df AS (SELECT word, count(*) AS df FROM tf GROUP BY word), n AS (SELECT count(DISTINCT id) AS n FROM tf),
    sc AS (SELECT id, word, round(tf / most * log2(n / df), 6) AS score FROM tf JOIN most USING (id) JOIN df USING (word), n),
    prof AS (SELECT id, word, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, word) AS rank FROM sc QUALIFY rank <= 200)"""
SEEN = "seen AS (SELECT DISTINCT lang AS \"user\", source AS id FROM documents), up AS (SELECT DISTINCT \"user\", word FROM seen JOIN prof USING (id))"


def edges(n: int) -> str:
    """e(src, dst) and both directions l(s, d)."""
    return f"""{UB}, e AS (SELECT x.u AS src, y.u AS dst, count(*) AS n FROM ub x JOIN ub y ON x.b = y.b AND x.u < y.u GROUP BY 1, 2 HAVING count(*) >= 2 ORDER BY n DESC, src, dst LIMIT {n}),
        l AS (SELECT src AS s, dst AS d FROM e UNION ALL SELECT dst, src FROM e)"""


def labels(rounds: int) -> str:
    out = "l0 AS (SELECT DISTINCT s AS id, s AS label FROM l)"
    for k in range(rounds):
        out += f", l{k + 1} AS (SELECT id, label FROM (SELECT s AS id, label, count(*) AS k FROM l JOIN l{k} ON d = l{k}.id GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY id ORDER BY k DESC, label) = 1)"
    return out


COMP = "reach AS (SELECT DISTINCT s AS id, s AS other FROM l UNION SELECT reach.id, l.d FROM reach JOIN l ON reach.other = l.s), comp AS (SELECT id, min(other) AS component FROM reach GROUP BY id)"


def levels(depth: int = 30) -> str:
    """p(root, node, level, sigma), level by level."""
    out = "p0 AS (SELECT DISTINCT s AS root, s AS node, 0::BIGINT AS level, 1.0::DOUBLE AS sigma FROM l)"
    for k in range(depth):
        old = f"SELECT root, node FROM p{k}" + (f" UNION ALL SELECT root, node FROM p{k - 1}" if k else "")
        out += f", p{k + 1} AS MATERIALIZED (SELECT root, d AS node, {k + 1}::BIGINT AS level, sum(sigma) AS sigma FROM p{k} JOIN l ON node = s WHERE (root, d) NOT IN ({old}) GROUP BY root, d)"
    return out + ", p AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM p{k}" for k in range(depth + 1)) + ")"


BETWEEN = f"""{edges(200)}, {levels()}, bt AS (SELECT src, dst, round(sum(x.sigma * y.sigma / st.sigma) / 2, 6) AS betweenness FROM (SELECT s, d, least(s, d) AS src, greatest(s, d) AS dst FROM l) l
    JOIN p x ON x.node = l.s JOIN p y ON y.root = l.d JOIN p st ON st.root = x.root AND st.node = y.node AND st.level = x.level + 1 + y.level GROUP BY src, dst)"""



def cuts(n: int, top: int = 60, depth: int = 30) -> str:
    """SELECT id, community of the best of n cuts by betweenness, ties by edge; each round's CTEs end in its number."""
    out = f"{edges(top)}, e0 AS MATERIALIZED (SELECT src, dst FROM e), dg AS MATERIALIZED (SELECT s AS id, count(*) AS degree FROM l GROUP BY s), m AS MATERIALIZED (SELECT count(*) AS m FROM e)"
    for r in range(n + 1):
        out += f", l{r} AS MATERIALIZED (SELECT src AS s, dst AS d FROM e{r} UNION ALL SELECT dst, src FROM e{r})"
        out += f", reach{r} AS (SELECT id, id AS other FROM dg UNION SELECT reach{r}.id, l{r}.d FROM reach{r} JOIN l{r} ON reach{r}.other = l{r}.s)"
        out += f", comp{r} AS MATERIALIZED (SELECT id, min(other) AS community FROM reach{r} GROUP BY id)"
        out += f""", q{r} AS MATERIALIZED (SELECT {r} AS r, round(sum(coalesce(k, 0) / m - pow(degree / (2.0 * m), 2)), 6) AS q FROM (SELECT community, sum(degree) AS degree FROM dg JOIN comp{r} USING (id) GROUP BY 1)
            LEFT JOIN (SELECT x.community, count(*) AS k FROM e0 JOIN comp{r} x ON x.id = src JOIN comp{r} y ON y.id = dst WHERE x.community = y.community GROUP BY 1) USING (community), m)"""
        if r == n:
            break
        p = f"p{r}x"
        out += f", {p}0 AS MATERIALIZED (SELECT DISTINCT s AS root, s AS node, 0::BIGINT AS level, 1.0::DOUBLE AS sigma FROM l{r})"
        for k in range(depth):
            old = f"SELECT root, node FROM {p}{k}" + (f" UNION ALL SELECT root, node FROM {p}{k - 1}" if k else "")
            out += f", {p}{k + 1} AS MATERIALIZED (SELECT root, d AS node, {k + 1}::BIGINT AS level, sum(sigma) AS sigma FROM {p}{k} JOIN l{r} ON node = s WHERE (root, d) NOT IN ({old}) GROUP BY root, d)"
        out += f", {p} AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM {p}{k}" for k in range(depth + 1)) + ")"
        out += f""", b{r} AS MATERIALIZED (SELECT least(s, d) AS src, greatest(s, d) AS dst, round(sum(x.sigma * y.sigma / st.sigma) / 2, 6) AS b FROM l{r} l
            JOIN {p} x ON x.node = l.s JOIN {p} y ON y.root = l.d JOIN {p} st ON st.root = x.root AND st.node = y.node AND st.level = x.level + 1 + y.level GROUP BY 1, 2)"""
        out += f", e{r + 1} AS MATERIALIZED (SELECT src, dst FROM b{r} QUALIFY row_number() OVER (ORDER BY b DESC, src, dst) > 1)"
    every = " UNION ALL ".join(f"SELECT {r} AS r, id, community FROM comp{r}" for r in range(n + 1))
    scores = " UNION ALL ".join(f"SELECT * FROM q{r}" for r in range(n + 1))
    return f"WITH RECURSIVE {out} SELECT id, community FROM ({every}) WHERE r = (SELECT r FROM ({scores}) ORDER BY q DESC, r LIMIT 1)"


def report(support: int, most: int = 6) -> str:
    """The report's lines: candidates of each size that has frequent itemsets, then those."""
    shown = "string_agg('(' || array_to_string(list_transform(items, lambda x: '''' || x || ''''), ', ') || ')', ',' ORDER BY items)"
    ctes = [BASKETS, "c1 AS (SELECT DISTINCT [i] AS items FROM bk)"]
    for k in range(1, most + 1):
        names = [f"b{j}" for j in range(k)]
        joins = "".join(f" JOIN bk {b} ON {b}.k = b0.k AND {a}.i < {b}.i" for a, b in zip(names, names[1:]))
        items = ", ".join(f"{b}.i" for b in names)
        ctes.append(f"f{k} AS MATERIALIZED (SELECT [{items}] AS items FROM bk b0{joins} GROUP BY {items} HAVING count(*) >= {support})")
        if k < most:
            whole = " AND ".join(f"list_concat(items[:{j}], items[{j + 2}:]) IN (SELECT items FROM f{k})" for j in range(k + 1))
            ctes.append(f"c{k + 1} AS (SELECT items FROM (SELECT list_append(x.items, y.items[-1]) AS items FROM f{k} x JOIN f{k} y ON x.items[:{k - 1}] = y.items[:{k - 1}] AND x.items[-1] < y.items[-1]) WHERE {whole})")
    parts = ["SELECT 'Candidates:' AS value", "SELECT 'Frequent Itemsets:'"]
    for k in range(1, most + 1):
        parts += [f"SELECT {shown} FROM c{k} WHERE EXISTS (FROM f{k}) HAVING count(*) > 0", f"SELECT {shown} FROM f{k} HAVING count(*) > 0"]
    return f"WITH {', '.join(ctes)} " + " UNION ALL ".join(parts)


POINTS = "pt AS (SELECT vec_id AS id, label::BIGINT AS label, embedding::DOUBLE[] AS v FROM embeddings)"


def farthest(k: int) -> str:
    """f(cluster, id, v): farthest-first seeds."""
    out = "f0 AS (SELECT 0::BIGINT AS cluster, id, v FROM pt ORDER BY id LIMIT 1)"
    for j in range(1, k):
        so_far = " UNION ALL ".join(f"SELECT * FROM f{i}" for i in range(j))
        out += f", f{j} AS MATERIALIZED (SELECT {j}::BIGINT AS cluster, id, v FROM (SELECT pt.id, any_value(pt.v) AS v, min(list_distance(pt.v, c.v)) AS away FROM pt, ({so_far}) c GROUP BY pt.id) ORDER BY away DESC, id LIMIT 1)"
    return out + ", f AS (" + " UNION ALL ".join(f"SELECT * FROM f{j}" for j in range(k)) + ")"


def lloyd(rounds: int, dims: int = 64) -> str:
    """a{rounds}(id, cluster, distance), from seeds f."""
    out = "c0 AS (SELECT cluster, v FROM f)"
    for r in range(rounds + 1):
        out += f", a{r} AS MATERIALIZED (SELECT pt.id, any_value(pt.v) AS v, arg_min(c.cluster, (list_distance(pt.v, c.v), c.cluster)) AS cluster, min(list_distance(pt.v, c.v)) AS distance FROM pt, c{r} c GROUP BY pt.id)"
        if r < rounds:
            mean = ", ".join(f"avg(v[{i}])" for i in range(1, dims + 1))
            out += f", c{r + 1} AS MATERIALIZED (SELECT coalesce(m.cluster, c.cluster) AS cluster, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN (SELECT cluster, [{mean}] AS v FROM a{r} GROUP BY cluster) m USING (cluster))"
    return out


DIMS = "dm AS (SELECT id, label AS cluster, unnest(range(64)) AS dim, unnest(v) AS x FROM pt)"
STATS = f"WITH {POINTS}, {DIMS} SELECT cluster, dim, count(*) AS n, round(sum(x), 6) AS sum, round(sum(x * x), 6) AS sumsq FROM dm GROUP BY cluster, dim"
CENTRES = "ct AS (SELECT cluster, list(m ORDER BY dim) AS centre FROM (SELECT cluster, dim, avg(x) AS m FROM dm GROUP BY ALL) GROUP BY cluster)"

TEXT_NUMBER = "('0x' || substr(md5({0}), 1, 8))::BIGINT"


def number(text: str) -> str:
    return TEXT_NUMBER.format(text)


WINDOWS = "ev AS (SELECT *, unnest([date_trunc('day', ts) - k * INTERVAL 1 DAY FOR k IN range(3)]) AS start FROM events)"
#: 3-day windows that slide by a day are aligned to 1970-01-01, a day like any other.


def zeros(h: str) -> str:
    return f"CASE WHEN {h} = 0 THEN 1 ELSE bit_count(({h} & -{h}) - 1)::BIGINT END"


def fm(by: str, source: str) -> str:
    """SELECT by, estimate."""
    x = f"({number('user_id::VARCHAR')} % {PRIME})"
    runs = ", ".join(f"max({zeros(f'(({a}::BIGINT * {x} + {b}) % {PRIME})')}) AS z{j}" for j, (a, b) in enumerate(family(24, seed=36)))
    groups = " + ".join(f"pow(2.0, list_sort([{', '.join(f'z{j}' for j in range(g * 6, g * 6 + 6))}])[4])" for g in range(4))
    return f"SELECT {by}, truth, ({groups}) / 4 AS estimate FROM (SELECT {by}, count(DISTINCT user_id) AS truth, {runs} FROM {source} GROUP BY {by})"


def positions(key: str) -> str:
    x = f"({number(key)} % {PRIME})"
    return "[" + ", ".join(f"(({a}::BIGINT * {x} + {b}) % {PRIME}) % 10000" for a, b in family(8, seed=6)) + "]"


RESERVOIR = f"rs AS (SELECT event_id, event_type, {number('event_id::VARCHAR')} AS priority FROM events ORDER BY priority, event_id LIMIT 100)"
TRENDING = "SELECT tag, n, dense_rank() OVER (ORDER BY n DESC) AS rank FROM ({0}) QUALIFY rank <= 3"
MEAN = "round(sum(sim * stars) / sum(sim), 6) AS prediction"


def predictions(member: str, source: str, best: int | None = None, least: int = 1) -> str:
    """Both models: m(a, b, sim); member is what the model pairs."""
    held, known = f"SELECT * FROM ratings WHERE {HELD_OUT}", f"SELECT * FROM ratings WHERE NOT ({HELD_OUT})"
    rank = f" QUALIFY row_number() OVER (PARTITION BY t.u, t.b ORDER BY sim DESC, m.o) <= {best} AND count(*) OVER (PARTITION BY t.u, t.b) >= {least}" if best else ""
    other = "r.u = t.u AND r.b = m.o" if member == "b" else "r.b = t.b AND r.u = m.o"
    return f"""WITH {RATINGS}, known AS ({known}), md AS ({source}), m AS (SELECT a AS me, b AS o, sim FROM md UNION ALL SELECT b, a, sim FROM md)
        SELECT u, b, {MEAN} FROM (SELECT t.u, t.b, sim, r.stars FROM ({held}) t JOIN m ON m.me = t.{member} JOIN known r ON {other}{rank}) GROUP BY u, b"""


SQL: dict[str, str] = {
    "review_count": "SELECT count(*) AS n FROM orders",
    "reviews_in_year": "SELECT count(*) AS n FROM orders WHERE year(o_orderdate) = 1997",
    "reviews_by_year": "SELECT year(o_orderdate) AS year, count(*) AS n FROM orders GROUP BY 1",
    "distinct_users": "SELECT count(DISTINCT o_custkey) AS n FROM orders",
    "top_users": "SELECT o_custkey AS user_id, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, user_id LIMIT 10",
    "top_words": f"WITH {OCC} SELECT word, count(*) AS n FROM occ GROUP BY word ORDER BY n DESC, word LIMIT 50",
    "top_words_no_stopwords": f"WITH {OCC} SELECT word, count(*) AS n FROM occ WHERE word NOT IN ({', '.join(repr(w) for w in STOPWORDS)}) GROUP BY word ORDER BY n DESC, word LIMIT 50",
    "category_avg_topn": f"WITH {REVIEWS}, bi AS (SELECT b, avg(stars) AS stars FROM reviews GROUP BY b) SELECT trim(category) AS category, round(avg(stars), 6) AS average FROM (SELECT unnest(string_split(p_name, ' ')) AS category, stars FROM bi JOIN part ON b = p_partkey) GROUP BY 1 ORDER BY average DESC, category LIMIT 20",
    "busy_items": "SELECT l_partkey AS item, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 40",
    "semi_join_subset": "SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)",
    "anti_join_subset": "SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)",
    "inner_join_totals": "SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1",
    "json_fields": "SELECT (props->>'k')::BIGINT AS k, count(*) AS n FROM events GROUP BY 1",
    "union_distinct": "SELECT c_nationkey::BIGINT AS nation FROM customer UNION SELECT s_nationkey FROM supplier",
    "non_empty_filter": "SELECT DISTINCT event_type FROM events WHERE event_type <> ''",
    "alphabetic_words": f"WITH {OCC} SELECT word, count(*) AS n FROM occ WHERE regexp_full_match(word, '[A-Za-z]+') GROUP BY word ORDER BY n DESC, word LIMIT 100",
    "hash_sample": f"SELECT o_orderkey FROM orders WHERE {number('o_orderkey::VARCHAR')} % 1000 < 10",
    "text_numbers": "SELECT n_name, list_reduce(list_prepend(0::HUGEINT, list_transform(range(1, length(n_name) + 1), lambda k: ord(n_name[k])::HUGEINT)), lambda t, c: (t * 256 + c) % 10000)::BIGINT AS h FROM nation",
    "basket_case1": f"WITH {UB} SELECT u AS basket, string_agg(b, ',' ORDER BY b) AS items, count(*) AS n FROM ub GROUP BY u",
    "basket_case2": f"WITH {UB} SELECT b AS basket, string_agg(u, ',' ORDER BY u) AS items, count(*) AS n FROM ub GROUP BY b",
    "basket_size_filter": f"WITH {UB} SELECT u AS basket, count(*) AS n FROM ub GROUP BY u HAVING count(*) > 50",
    "frequent_itemsets": f"WITH {BASKETS} " + " UNION ALL ".join(f"SELECT {k}::BIGINT AS size, * FROM ({itemsets(k, 20)})" for k in range(1, 7)),
    **{f"apriori_{k}": f"WITH {BASKETS} {itemsets(k, 20)}" for k in (1, 2, 3, 4)},
    "fpgrowth_itemsets": f"WITH {BASKETS} " + " UNION ALL ".join(f"SELECT {k}::BIGINT AS size, * FROM ({itemsets(k, 20)})" for k in range(1, 7)),
    "sparse_itemsets": f"WITH {UB}, bk AS (SELECT u AS k, b AS i FROM ub) " + " UNION ALL ".join(f"SELECT {k}::BIGINT AS size, * FROM ({itemsets(k, 4)})" for k in (1, 2, 3)),
    "cooccurrence_pairs": f"WITH {UB} SELECT x.b AS a, y.b AS b, count(*) AS n FROM ub x JOIN ub y ON x.u = y.u AND x.b < y.b GROUP BY 1, 2 HAVING count(*) >= 5",
    "jaccard_pairs": f"WITH {UB}, s AS (SELECT b, count(*) AS k FROM ub GROUP BY b) SELECT a, c.b, round(n / (x.k + y.k - n), 6) AS sim FROM (SELECT x.b AS a, y.b AS b, count(*) AS n FROM ub x JOIN ub y ON x.u = y.u AND x.b < y.b GROUP BY 1, 2) c JOIN s x ON x.b = a JOIN s y ON y.b = c.b WHERE n / (x.k + y.k - n) >= 0.05",
    "minhash_signature": f"WITH {UB}, sig AS (SELECT b AS id, {minimum(30)} FROM ub GROUP BY b) SELECT id, unnest(range(30)) AS h, unnest([{', '.join(f'h{j}' for j in range(30))}]) AS value FROM sig",
    "lsh_candidates": f"WITH {UB}, {banded(30, 2)} SELECT DISTINCT x.id AS a, y.id AS b FROM bd x JOIN bd y ON x.band = y.band AND x.key = y.key AND x.id < y.id",
    "lsh_similar_pairs": f"WITH {UB}, {banded(60, 1)}, cd AS (SELECT DISTINCT x.id AS a, y.id AS b FROM bd x JOIN bd y ON x.band = y.band AND x.key = y.key AND x.id < y.id), s AS (SELECT b, count(*) AS k FROM ub GROUP BY b) SELECT a, cd.b, round(any_value(n / (x.k + y.k - n)), 6) AS sim FROM (SELECT cd.a, cd.b, count(*) AS n FROM cd JOIN ub x ON x.b = cd.a JOIN ub y ON y.b = cd.b AND y.u = x.u GROUP BY ALL) cd JOIN s x ON x.b = a JOIN s y ON y.b = cd.b WHERE n / (x.k + y.k - n) >= 0.05 GROUP BY a, cd.b",
    "doc_frequency": f"WITH {OCC} SELECT word, count(DISTINCT source) AS df FROM occ GROUP BY word HAVING count(DISTINCT source) > 1",
    "tfidf_top_words": f"WITH {TFIDF} SELECT id, word, score, rank FROM prof",
    "user_profile": f'WITH {TFIDF}, {SEEN} SELECT "user", word FROM up',
    "content_predict": f"""WITH {TFIDF}, {SEEN} SELECT s."user", s.id, round(count(*) / sqrt((any_value(nu) * any_value(ni))::DOUBLE), 6) AS sim FROM seen s JOIN up ON up."user" = s."user" JOIN prof ON prof.id = s.id AND prof.word = up.word
        JOIN (SELECT "user", count(*) AS nu FROM up GROUP BY 1) x ON x."user" = s."user" JOIN (SELECT id, count(*) AS ni FROM prof GROUP BY 1) y ON y.id = s.id GROUP BY s."user", s.id HAVING sim >= 0.01""",
    "item_pearson": f"WITH {RATINGS} {model('ratings', 'b', 'u', 3)}",
    "user_pearson_lsh": f"""WITH {RATINGS}, en AS (SELECT * FROM ratings WHERE u IN (SELECT u FROM ratings GROUP BY 1 HAVING count(*) >= 3)), {banded(30, 1, 'b', 'u', 'en')},
        cd AS (SELECT DISTINCT x.id AS a, y.id AS b FROM bd x JOIN bd y ON x.band = y.band AND x.key = y.key AND x.id < y.id), s AS (SELECT u, count(*) AS k FROM en GROUP BY u),
        nr AS (SELECT a, c.b FROM (SELECT cd.a, cd.b, count(*) AS n FROM cd JOIN en x ON x.u = cd.a JOIN en y ON y.u = cd.b AND y.b = x.b GROUP BY ALL) c JOIN s x ON x.u = a JOIN s y ON y.u = c.b WHERE n / (x.k + y.k - n) >= 0.01)
        SELECT a, b, n, sim FROM ({model('en', 'u', 'b', 3, False)}) SEMI JOIN nr USING (a, b)""",
    "top_neighbours": f"WITH {RATINGS}, md AS ({model('ratings', 'b', 'u', 3)}), m AS (SELECT a, b, sim FROM md UNION ALL SELECT b, a, sim FROM md) SELECT a, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS rank, b, sim FROM m QUALIFY rank <= 5",
    "item_cf_predict": predictions("b", model("known", "b", "u", 3)),
    "item_cf_predict_top": predictions("b", model("known", "b", "u", 3), best=3),
    "user_cf_predict": predictions("u", model("known", "u", "b", 2, False), best=5, least=2),
    "user_cf_published": predictions("u", f"""SELECT a, b, n, sim FROM ({model('en', 'u', 'b', 3, False)}) SEMI JOIN nr USING (a, b)""", best=5, least=5).replace("md AS (", f"""en AS (SELECT * FROM known WHERE u IN (SELECT u FROM known GROUP BY 1 HAVING count(*) >= 3)), {banded(30, 1, 'b', 'u', 'en')},
        cd AS (SELECT DISTINCT x.id AS a, y.id AS b FROM bd x JOIN bd y ON x.band = y.band AND x.key = y.key AND x.id < y.id), sz AS (SELECT u, count(*) AS k FROM en GROUP BY u),
        nr AS (SELECT a, c.b FROM (SELECT cd.a, cd.b, count(*) AS n FROM cd JOIN en x ON x.u = cd.a JOIN en y ON y.u = cd.b AND y.b = x.b GROUP BY ALL) c JOIN sz x ON x.u = a JOIN sz y ON y.u = c.b WHERE n / (x.k + y.k - n) >= 0.01), md AS (""", 1),
    "model_json": f"WITH {RATINGS}, md AS ({model('ratings', 'b', 'u', 3)}) SELECT a::VARCHAR AS id1, b::VARCHAR AS id2, sim FROM md UNION ALL SELECT b::VARCHAR, a::VARCHAR, sim FROM md",
    "model_pair": f"""WITH {TFIDF}, {SEEN} SELECT 'items' AS model, id, count(*) AS n FROM prof GROUP BY id UNION ALL SELECT 'users', "user", count(*) FROM up GROUP BY 2""",
    "itemset_report": report(20),
    "girvan_newman": cuts(3),
    "text_index": 'SELECT c_name AS id, row_number() OVER (ORDER BY c_name) - 1 AS "index" FROM (SELECT DISTINCT c_name FROM customer)',
    "minhash_text_keys": f"WITH {UB}, nm AS (SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT u FROM ub)), ix AS (SELECT c_custkey, dense_rank() OVER (ORDER BY c_name) - 1 AS x FROM nm), tx AS (SELECT b, x FROM ub JOIN ix ON u = c_custkey), sig AS (SELECT b AS id, {minimum(30, 'x')} FROM tx GROUP BY b) SELECT id, unnest(range(30)) AS h, unnest([{', '.join(f'h{j}' for j in range(30))}]) AS value FROM sig",
    "stream_micro_batches": "SELECT event_id, event_type FROM events",
    "stream_pushed_tags": "SELECT r_name AS tag FROM region WHERE regexp_full_match(r_name, '[A-Za-z]+')",
    "text_lines": "SELECT c_name AS value FROM customer",
    "json_rows": "SELECT o_orderkey::VARCHAR AS review_id, o_custkey::VARCHAR AS user_id, o_totalprice AS stars, strftime(o_orderdate, '%Y-%m-%d') AS date, NULL::VARCHAR AS text FROM orders",
    "json_runs": "SELECT year(o_orderdate) AS year, count(*) AS n FROM orders WHERE year(o_orderdate) IN (1995, 1996, 1997) GROUP BY 1",
    "csv_rows": "SELECT o_custkey::VARCHAR AS user_id, o_orderkey::VARCHAR AS business_id FROM orders",
    "csv_header_tokens": "SELECT o_custkey::VARCHAR AS user_id, o_orderkey::VARCHAR AS business_id FROM orders",
    "csv_blocks": "SELECT o_orderkey % 3 AS round, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1, 2",
    "csv_points": f"WITH {POINTS} SELECT id, round(list_sum(v), 6) AS total, v[64] AS last FROM pt",
    "chunk_files": f"WITH {POINTS} SELECT id % 4 AS chunk, count(*) AS n, sum(id)::BIGINT AS ids FROM pt GROUP BY 1",
    "bfr_chunks": f"WITH {POINTS} SELECT k + 1 AS round_id, count(*) AS n FROM pt, range(4) r(k) WHERE id % 4 <= k GROUP BY 1",
    "sample_dataset": "SELECT c_custkey::VARCHAR AS user_id, c_name AS business_id FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)",
    "hashtags": "SELECT tag, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS tag FROM part) WHERE regexp_full_match(tag, '[A-Za-z]+') GROUP BY tag",
    "comma_lists": "SELECT category, count(*) AS n FROM (SELECT unnest(CASE WHEN p_partkey % 10 > 0 THEN string_split(p_name, ' ') ELSE ['None'] END) AS category FROM part) GROUP BY 1",
    "betweenness_lines": f"WITH {BETWEEN} SELECT '(''' || src || ''', ''' || dst || '''), ' || betweenness AS value FROM bt",
    "community_report": f"WITH RECURSIVE {edges(200)}, {COMP} SELECT string_agg('''' || id || '''', ', ' ORDER BY id) AS value FROM comp GROUP BY component",
    "cluster_json": f"""WITH {POINTS}, {DIMS}, st AS (SELECT cluster, dim, avg(x) AS m, sqrt(abs(sum(x * x) / count(*) - (sum(x) / count(*)) * (sum(x) / count(*)))) AS s FROM dm WHERE id % 4 <> 0 GROUP BY ALL),
        ds AS (SELECT p.id, st.cluster, sqrt(sum(pow((x - m) / CASE WHEN s = 0 THEN 1 ELSE s END, 2))) AS d FROM dm p JOIN st USING (dim) WHERE p.id % 4 = 0 AND p.id < 4000 GROUP BY ALL),
        best AS (SELECT id, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS d FROM ds GROUP BY id)
        SELECT '{{' || string_agg('"' || id || '": ' || CASE WHEN d < 16 THEN cluster ELSE -1 END, ', ' ORDER BY id) || '}}' AS value FROM best""",
    "bloom_line": f"WITH bits AS (SELECT DISTINCT unnest({positions('c_name')}) AS pos FROM customer WHERE c_custkey % 2 = 0), st AS (SELECT list(pos) AS st FROM bits) SELECT string_agg(list_has_all(st, {positions('c_name')})::INTEGER::VARCHAR, ' ' ORDER BY c_custkey) AS value FROM customer, st WHERE c_custkey <= 1500",
    "trending_board": "SELECT tag || ' : ' || n AS value FROM (" + TRENDING.format("SELECT event_type AS tag, count(*) AS n FROM events GROUP BY 1") + ")",
    "items_by_number": "SELECT l_partkey % 8 AS partition, count(*) AS n_rows FROM lineitem GROUP BY 1",
    "coreview_edges": f"WITH {UB} SELECT x.u AS src, y.u AS dst, count(*) AS n FROM ub x JOIN ub y ON x.b = y.b AND x.u < y.u GROUP BY 1, 2 HAVING count(*) >= 7",
    "strongest_edges": f"WITH {edges(200)} SELECT src, dst FROM e",
    "degrees": f"WITH {edges(200)} SELECT s AS id, count(*) AS degree FROM l GROUP BY s",
    "graph_index": f'WITH {edges(200)} SELECT id, row_number() OVER (ORDER BY id) - 1 AS "index" FROM (SELECT DISTINCT s AS id FROM l)',
    "label_propagation": f"WITH {edges(200)}, {labels(5)} SELECT id, label FROM l5",
    "components": f"WITH RECURSIVE {edges(200)}, {COMP} SELECT id, component FROM comp",
    "bfs_paths": f"WITH {edges(200)}, {levels()} SELECT root, node, level, sigma FROM p",
    "edge_betweenness": f"WITH {BETWEEN} SELECT src, dst, betweenness FROM bt",
    "gn_first_cut": f"WITH {BETWEEN} SELECT src, dst, betweenness FROM bt ORDER BY betweenness DESC, src, dst LIMIT 1",
    "modularity": f"""WITH RECURSIVE {edges(200)}, {COMP}, m AS (SELECT count(*) AS m FROM e), dg AS (SELECT component, count(*) AS degree FROM l JOIN comp ON id = s GROUP BY 1),
        inr AS (SELECT x.component, count(*) AS k FROM e JOIN comp x ON x.id = src JOIN comp y ON y.id = dst WHERE x.component = y.component GROUP BY 1)
        SELECT round(sum(coalesce(k, 0) / m - pow(degree / (2.0 * m), 2)), 6) AS q FROM dg LEFT JOIN inr USING (component), m""",
    "farthest_init": f"WITH {POINTS}, {farthest(5)} SELECT cluster, id FROM f",
    "kmeans_fixed": f"WITH {POINTS}, {farthest(5)}, {lloyd(3)} SELECT id, cluster, round(distance, 4) AS distance FROM a3",
    "nearest_centre": f"WITH {POINTS}, {DIMS}, {CENTRES} SELECT id, arg_min(cluster, (d, cluster)) AS cluster, round(min(d), 6) AS distance FROM (SELECT id, cluster, list_distance(v, centre) AS d FROM pt, ct) GROUP BY id",
    "outlier_split": f"WITH {POINTS}, {DIMS}, {CENTRES}, aw AS (SELECT id, cluster, list_distance(v, centre) AS d FROM pt JOIN ct ON label = cluster) SELECT id, cluster, round(d, 6) AS distance, d > 1.1 * avg(d) OVER (PARTITION BY cluster) AS outlier FROM aw",
    "cluster_stats": STATS,
    "ds_merge": STATS,
    "mahalanobis_assign": f"""WITH {POINTS}, {DIMS}, st AS (SELECT cluster, dim, avg(x) AS m, sqrt(abs(sum(x * x) / count(*) - (sum(x) / count(*)) * (sum(x) / count(*)))) AS s FROM dm WHERE id % 4 <> 0 GROUP BY ALL),
        ds AS (SELECT p.id, st.cluster, sqrt(sum(pow((x - m) / CASE WHEN s = 0 THEN 1 ELSE s END, 2))) AS d FROM dm p JOIN st USING (dim) WHERE p.id % 4 = 0 GROUP BY ALL),
        best AS (SELECT id, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS d FROM ds GROUP BY id)
        SELECT id, CASE WHEN d < 16 THEN cluster END AS cluster, CASE WHEN d < 16 THEN round(d, 6) END AS distance FROM best""",
    "bloom_probe": f"WITH bits AS (SELECT DISTINCT unnest({positions('c_name')}) AS pos FROM customer WHERE c_custkey % 2 = 0), st AS (SELECT list(pos) AS st FROM bits) SELECT DISTINCT c_name AS key, list_has_all(st, {positions('c_name')})::INTEGER AS hit FROM customer, st",
    "bloom_fp_rate": "SELECT count(*) AS keys, round(pow(1 - exp(-8.0::DOUBLE * count(*) / 10000.0::DOUBLE), 8), 9) AS rate FROM customer WHERE c_custkey % 2 = 0",
    "fm_estimate": f"WITH {WINDOWS} SELECT start::TIMESTAMP AS start, truth, estimate, round((estimate - truth) * 100.0 / truth, 6) AS error FROM ({fm('start', 'ev')})",
    "window_distinct": f"WITH {WINDOWS} SELECT start::TIMESTAMP AS start, count(*) AS n_events, count(DISTINCT user_id) AS n_users FROM ev GROUP BY start",
    "reservoir_sample": f"WITH {RESERVOIR} SELECT event_id, event_type, priority FROM rs",
    "trending_tags": f"WITH {RESERVOIR} " + TRENDING.format("SELECT event_type AS tag, count(*) AS n FROM rs GROUP BY 1"),
    "trending_users": TRENDING.format("SELECT user_id::VARCHAR AS tag, count(*) AS n FROM events GROUP BY 1"),
    "stream_window_counts": f"WITH {WINDOWS} SELECT start::TIMESTAMP AS start, count(*) AS n_events, count(DISTINCT user_id) AS n_users FROM ev GROUP BY start",
    "stream_distinct": f"WITH {WINDOWS} SELECT start::TIMESTAMP AS start, estimate FROM ({fm('start', 'ev')})",
    "stream_trending": TRENDING.format("SELECT event_type AS tag, count(*) AS n FROM events GROUP BY 1"),
    "stream_session": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
        SELECT user_id, min(ts)::TIMESTAMP AS start, (max(ts) + INTERVAL 6 HOUR)::TIMESTAMP AS "end", count(*) AS n FROM s GROUP BY user_id, k""",
    "stream_tumbling": "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "stream_reservoir": f"WITH {RESERVOIR} SELECT event_id, priority FROM rs",
}
