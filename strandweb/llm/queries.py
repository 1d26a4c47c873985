"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweb.llm import canonical, leakage, packing, reading, seen, setjoin, terms
from strandweb.session import checkpointed, spread, table

SIMILAR, LEAST_LINKS = Fraction(4, 5), 5


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, on all cores."""
    return spread(table(spark, sf_dir, "documents"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = setjoin.record_sets(table(spark, sf_dir, "page_data"), "page_id", "links", LEAST_LINKS)
    _, pairs = setjoin.similar_sets(sets, SIMILAR, LEAST_LINKS)
    found = setjoin.expand_pairs(pairs, setjoin.members_of(sets))
    return found.select(F.col("a").alias("page_id_a"), F.col("b").alias("page_id_b"))


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per page in a class: the class (its smallest page id), its copies, and to how many classes it is similar."""
    sets = setjoin.record_sets(table(spark, sf_dir, "page_data"), "page_id", "links", LEAST_LINKS)
    classes, pairs = setjoin.similar_sets(sets, SIMILAR, LEAST_LINKS)
    partners = pairs.select(F.explode(F.array("class_a", "class_b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("partners"))
    members = setjoin.members_of(sets)
    named = sets.select("record").join(members, "record", "left").select(F.col("record").alias("page_id"), F.coalesce("rep", "record").alias("rep"))
    known = classes.select("rep", "copies").join(partners, "rep", "left")
    return named.join(known, "rep").select("page_id", F.col("rep").alias("class_id"), "copies", F.coalesce("partners", F.lit(0)).alias("n_links"))


def p1_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of one table and updates of another with nearly the same links."""
    both = setjoin.pairs_between(table(spark, sf_dir, "page_data"), table(spark, sf_dir, "page_updates"), "page_id", "update_id", "links", SIMILAR, LEAST_LINKS)
    return both.select(F.col("a").alias("page_id"), F.col("b").alias("update_id"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = canonical.repeats(table(spark, sf_dir, "page_dumps"), "raw_id", "body")
    return found.select(F.col("first").alias("first_raw_id"), F.col("record").alias("raw_id"))


def p2_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, _ = canonical.collapse(table(spark, sf_dir, "page_dumps"), "raw_id", "body")
    return records.select(F.col("first").alias("first_raw_id"), "copies")


def _seen(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    history, tasks = table(spark, sf_dir, "task_history"), table(spark, sf_dir, "tasks")
    return seen.seen_messages(history, [F.col("run_id"), F.col("url")], tasks, "msg_no", [F.col("run.id"), F.col("url")])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seen(spark, sf_dir)[0].where("certain").select(F.col("message").alias("msg_no"))


def p3_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: the audit with certainly absent keys, the filters' hits, and how many of them the confirmation rejects."""
    return _seen(spark, sf_dir)[1]


def p3_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with a key, and how many of them were seen before."""
    seen_ones = _seen(spark, sf_dir)[0].where("certain").agg(F.count(F.lit(1)).alias("n_seen"))
    n = table(spark, sf_dir, "tasks").where("run.id is not null and url is not null").count()
    return seen_ones.select(F.lit(n).cast("long").alias("n_messages"), "n_seen", (F.lit(n) - F.col("n_seen")).alias("n_new"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _page_terms(spark, sf_dir)
    marks = F.filter(F.array(F.when(F.col("is_rare"), "rare"), F.when(F.col("is_common"), "common")), lambda x: x.isNotNull())
    return counts.select("column_name", "term", F.explode(marks).alias("mark"))


def _page_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "page_data")
    kinds = pages.select(F.array(F.when(F.col("content_type") != "", F.col("content_type"))).alias("content_type"))
    n = pages.count()
    parts = [terms.marked(terms.ngram_counts(d, c, 1), n).select(F.lit(c).alias("column_name"), F.col("terms")[0].alias("term"), "occurrences", "records", "is_rare", "is_common") for d, c in ((pages, "links"), (kinds, "content_type"))]
    return parts[0].unionByName(parts[1])


def p5_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page_terms(spark, sf_dir)


def p5_link_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and pairs of links that follow each other on a page, with occurrences and pages."""
    counts = terms.ngram_counts(table(spark, sf_dir, "page_data"), "links", 2)
    return counts.select(F.col("terms")[0].alias("first_link"), F.coalesce(F.get("terms", F.lit(1)), F.lit("")).alias("next_link"), "occurrences", F.col("records").alias("pages"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = checkpointed(packing.token_counts(_documents(spark, sf_dir), "doc_id", "text"))
    return packing.containers(counts).select("container", F.col("record").alias("doc_id"), "piece", "begin", "size")


def p8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of containers of 2,048 ASCII words: sizes that plain engines can count."""
    counts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("record"), F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z0-9]+"), F.lit(0))).cast("long").alias("tokens"))
    return packing.containers(checkpointed(counts)).select(F.col("record").alias("doc_id"), "piece", "begin", "size")


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row on the containers of all documents: what must not be, and whether less than 1 % of their space (and one container) is unused."""
    packed = p8_containers(spark, sf_dir).groupBy("container").agg(F.sum("size").alias("held"), F.count_distinct("doc_id", "piece").alias("n"), F.count(F.lit(1)).alias("n_rows"))
    n, held = F.count(F.lit(1)), F.coalesce(F.sum("held"), F.lit(0))
    overfull, repeated = (F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)) for c in (F.col("held") > packing.CAPACITY, F.col("n") != F.col("n_rows")))
    return packed.agg(overfull.alias("n_overfull"), repeated.alias("n_repeated"), (n * packing.CAPACITY - held <= held * 0.01 + packing.CAPACITY).alias("well_filled"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leakage.leaks(_documents(spark, sf_dir), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text")
    return found.select(F.col("record").alias("doc_id"), F.col("item").alias("item_id"))


def p9_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the leaked spans: the words that are left of each, as number and hash."""
    clean = leakage.without_leaks(_documents(spark, sf_dir), "text", table(spark, sf_dir, "eval_items"), "item_id", "text")
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return clean.select("doc_id", F.size(words).alias("n_words_left"), F.md5(F.array_join(words, " ")).alias("digest"))


def _levels(spark: SparkSession, sf_dir: str, least_words: int) -> DataFrame:
    documents, labels = _documents(spark, sf_dir), table(spark, sf_dir, "grade_labels")
    english = documents.where(F.lower("lang").startswith("en")).select("doc_id", "text", "source")
    model = reading.fit_documents(english, "doc_id", "text", labels, "doc_id", "grade")
    return reading.with_levels(english, "text", model, least_words)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _levels(spark, sf_dir, 40).where("level >= 4").select("doc_id")


def p10_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each source and level."""
    return _levels(spark, sf_dir, 0).groupBy("source", "level").agg(F.count(F.lit(1)).alias("n_documents"))


def p10_word_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The informative words of the graded English texts, with their acquisition grades in thousandths."""
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "grade_labels")
    rows = reading.graded(documents.where(F.lower("lang").startswith("en")), "doc_id", "text", labels, "doc_id", "grade")
    return reading.word_grades(checkpointed(rows)).select("word", "n_texts", F.round(F.col("grade") * 1000).cast("int").alias("grade_milli"))


QUERIES = {f.__name__: f for f in (p1_found, p1_classes, p1_between, p2_found, p2_records, p3_found, p3_error_rate, p3_counts, p5_found, p5_terms, p5_link_pairs, p8_containers, p8_pieces, p8_fill, p9_found, p9_clean, p10_found, p10_profile, p10_word_grades)}

_SETS = """
WITH sets AS (SELECT page_id, list_sort(list_distinct(links)) AS s FROM page_data WHERE len(list_distinct(links)) >= 5),
tok AS (SELECT page_id, len(s) AS k, unnest(s) AS t FROM sets),
sim AS (
    SELECT a.page_id AS a, b.page_id AS b FROM tok a JOIN tok b ON a.t = b.t AND a.page_id < b.page_id AND 5 * least(a.k, b.k) >= 4 * greatest(a.k, b.k)
    GROUP BY 1, 2, a.k, b.k HAVING 9 * count(*) >= 4 * (a.k + b.k)
)"""
_LETTERS = r"regexp_replace(lower({}), '[^\p{{L}}\p{{Nd}}]', '', 'g')"
_TEXT = lambda f: f"coalesce({_LETTERS.format(f'body->>{f!r}')}, '-')"
_RECORDS = f"""
WITH good AS (SELECT raw_id, CAST(body AS JSON) AS body FROM page_dumps WHERE json_valid(body) AND json_type(body) = 'OBJECT'),
canon AS (
    SELECT raw_id, concat_ws('|', {_TEXT('url')}, coalesce(CAST(CAST(body->>'status' AS DOUBLE) AS VARCHAR), '-'), {_TEXT('lastRunID')}, {_TEXT('lastUpdatedAt')}, {_TEXT('foundAt')}, {_TEXT('contentType')},
        array_to_string(list_sort(list_distinct(list_filter(list_transform(coalesce(CAST(body->'links' AS VARCHAR[]), []), lambda x: {_LETTERS.format('x')}), lambda x: x <> ''))), ' ')) AS canonical FROM good
)"""
_TERMS = """SELECT 'links' AS column_name, term, count(*) AS occurrences, count(DISTINCT page_id) AS records FROM (SELECT page_id, unnest(links) AS term FROM page_data) WHERE term IS NOT NULL GROUP BY 2
        UNION ALL SELECT 'content_type', content_type, count(*), count(*) FROM page_data WHERE content_type <> '' GROUP BY 2"""
_GRAMS = """w AS (SELECT 0 AS side, doc_id AS id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents
            UNION ALL SELECT 1, item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') FROM eval_items),
        u AS (SELECT side, id, generate_subscripts(w, 1) AS i, unnest(w) AS t FROM w),
        g AS (SELECT side, id, i, string_agg(t, ' ') OVER r AS gram FROM u WINDOW r AS (PARTITION BY side, id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) QUALIFY count(*) OVER r = 13)"""
SQL = {
    "p1_found": _SETS + " SELECT a AS page_id_a, b AS page_id_b FROM sim",
    "p1_classes": _SETS
    + """, cls AS (SELECT s, min(page_id) AS class_id, count(*) AS copies FROM sets GROUP BY s),
    links AS (SELECT x, count(*) AS n FROM (SELECT unnest([a, b]) AS x FROM sim WHERE a IN (SELECT class_id FROM cls) AND b IN (SELECT class_id FROM cls)) GROUP BY 1)
    SELECT page_id, class_id, copies, coalesce(n, 0) AS n_links FROM sets JOIN cls USING (s) LEFT JOIN links ON x = class_id""",
    "p1_between": """WITH l AS (SELECT page_id AS id, list_distinct(links) AS s FROM page_data WHERE len(list_distinct(links)) >= 5), r AS (SELECT update_id AS id, list_distinct(links) AS s FROM page_updates WHERE len(list_distinct(links)) >= 5),
        lt AS (SELECT id, len(s) AS k, unnest(s) AS t FROM l), rt AS (SELECT id, len(s) AS k, unnest(s) AS t FROM r)
        SELECT lt.id AS page_id, rt.id AS update_id FROM lt JOIN rt ON lt.t = rt.t AND 5 * least(lt.k, rt.k) >= 4 * greatest(lt.k, rt.k) GROUP BY lt.id, rt.id, lt.k, rt.k HAVING 9 * count(*) >= 4 * (lt.k + rt.k)""",
    "p2_found": _RECORDS + " SELECT min(raw_id) OVER (PARTITION BY canonical) AS first_raw_id, raw_id FROM canon QUALIFY first_raw_id < raw_id",
    "p2_records": _RECORDS + " SELECT min(raw_id) AS first_raw_id, count(*) AS copies FROM canon GROUP BY canonical",
    "p3_found": """SELECT msg_no FROM tasks t WHERE run.id IS NOT NULL AND url IS NOT NULL AND (
            EXISTS (SELECT 1 FROM task_history h WHERE h.run_id = t.run.id AND h.url = t.url)
            OR EXISTS (SELECT 1 FROM tasks o WHERE o.run.id = t.run.id AND o.url = t.url AND o.msg_no < t.msg_no))""",
    "p3_counts": """WITH k AS (SELECT min(msg_no) AS m, run.id AS r, url AS u, count(*) AS n FROM tasks WHERE run.id IS NOT NULL AND url IS NOT NULL GROUP BY 2, 3)
        SELECT CAST(sum(n) AS BIGINT) AS n_messages, CAST(sum(n - new) AS BIGINT) AS n_seen, CAST(sum(new) AS BIGINT) AS n_new FROM (
            SELECT n, CASE WHEN EXISTS (SELECT 1 FROM task_history h WHERE h.run_id = k.r AND h.url = k.u) THEN 0 ELSE 1 END AS new FROM k)""",
    "p5_terms": f"SELECT column_name, term, occurrences, records, records = 1 AS is_rare, records > 0.05 * (SELECT count(*) FROM page_data) AS is_common FROM ({_TERMS})",
    "p5_found": f"""SELECT column_name, term, 'rare' AS mark FROM ({_TERMS}) WHERE records = 1
        UNION ALL SELECT column_name, term, 'common' FROM ({_TERMS}) WHERE records > 0.05 * (SELECT count(*) FROM page_data)""",
    "p5_link_pairs": """WITH p AS (SELECT page_id, links, unnest(range(1, len(links) + 1)) AS i FROM page_data),
        n AS (SELECT page_id, links[i] AS a, '' AS b FROM p WHERE links[i] IS NOT NULL UNION ALL SELECT page_id, links[i], links[i + 1] FROM p WHERE links[i] IS NOT NULL AND links[i + 1] IS NOT NULL)
        SELECT a AS first_link, b AS next_link, count(*) AS occurrences, count(DISTINCT page_id) AS pages FROM n GROUP BY 1, 2""",
    "p8_pieces": """SELECT doc_id, piece, 2048 * piece AS begin, CAST(least(2048, n - 2048 * piece) AS INTEGER) AS size
        FROM (SELECT doc_id, n, unnest(range(0, greatest(1, (n + 2047) // 2048))) AS piece FROM (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+')) AS n FROM documents))""",
    "p8_fill": "SELECT CAST(0 AS BIGINT) AS n_overfull, CAST(0 AS BIGINT) AS n_repeated, true AS well_filled",
    "p9_found": f"WITH {_GRAMS} SELECT DISTINCT d.id AS doc_id, e.id AS item_id FROM g d JOIN g e USING (gram) WHERE d.side = 0 AND e.side = 1",
    "p9_clean": f"""WITH {_GRAMS}, h AS (SELECT DISTINCT id, i FROM g WHERE side = 0 AND gram IN (SELECT gram FROM g WHERE side = 1)), c AS (SELECT DISTINCT id, unnest(range(i, i + 13)) AS i FROM h),
        l AS (SELECT id, count(*) AS n, string_agg(t, ' ' ORDER BY i) AS words FROM (SELECT * FROM u WHERE side = 0) ANTI JOIN c USING (id, i) GROUP BY 1)
        SELECT doc_id, CAST(coalesce(n, 0) AS INTEGER) AS n_words_left, md5(coalesce(words, '')) AS digest FROM documents LEFT JOIN l ON id = doc_id""",
    "p10_word_grades": f"""WITH l AS (SELECT doc_id, {', '.join(f'avg(CASE WHEN grade = {k} THEN 1.0 ELSE 0.0 END) AS v{k}' for k in range(1, 6))} FROM grade_labels WHERE grade BETWEEN 1 AND 5 GROUP BY 1),
        d AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{Nl}}\\p{{No}}]+')) AS w, {', '.join(f'v{k}' for k in range(1, 6))} FROM documents JOIN l USING (doc_id) WHERE lower(lang) LIKE 'en%' AND text <> ''),
        t AS (SELECT {', '.join(f'sum(v{k}) + 1 AS t{k}' for k in range(1, 6))} FROM d),
        u AS (SELECT word, count(*) AS n_texts, {', '.join(f'sum(v{k}) + 0.02 AS v{k}' for k in range(1, 6))} FROM (SELECT unnest(w) AS word, * EXCLUDE (w) FROM d) GROUP BY 1 HAVING count(*) >= 4),
        s AS (SELECT word, n_texts, {', '.join(f'v{k} / t{k} AS s{k}' for k in range(1, 6))}, {' + '.join(f'v{k} / t{k}' for k in range(1, 6))} AS s FROM u, t),
        p AS (SELECT word, n_texts, {', '.join(f's{k} / s AS p{k}' for k in range(1, 6))} FROM s)
        SELECT word, n_texts, CAST(round(({' + '.join(f'{k} * p{k}' for k in range(1, 6))}) * 1000) AS INTEGER) AS grade_milli FROM p WHERE -({' + '.join(f'p{k} * ln(p{k})' for k in range(1, 6))}) <= 0.85 * ln(5)""",
}
