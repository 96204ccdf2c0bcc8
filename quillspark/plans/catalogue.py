"""The named queries over the tables of a folder, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.functions import scalars
from quillspark.operators import graph, groups, lookups, objects, pages, rules, search, variants
from quillspark.plans.register import ORACLE, QUERIES, query  # noqa: F401
from quillspark.sources import table
from quillspark.streaming import events as event_windows

# Search ------------------------------------------------------------------------------------------------------------

LINES_SQL = """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents),
o AS (SELECT *, coalesce(sum(length(line)) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + n AS before FROM l),
t AS (SELECT doc_id, n AS line_no, before + length(line) - length(ltrim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12))) AS start,
        trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS txt FROM o)
"""


@query(LINES_SQL + "SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, CAST(start AS BIGINT) AS start, txt, CAST(start + length(txt) AS BIGINT) AS \"end\" FROM t WHERE txt <> ''")
def line_fragments(spark, sf_dir):
    return search.line_fragments(table(spark, sf_dir, "documents"), ["doc_id"])


@query("""
WITH c AS (SELECT doc_id, string_split(text, '') AS c FROM documents),
p AS (SELECT doc_id, unnest(list_filter(range(1, len(c) - 1), lambda i: c[i] = 'e' AND c[i+1] = 'l' AND c[i+2] = 'e')) AS p FROM c)
SELECT doc_id, CAST(p - 1 AS BIGINT) AS start, CAST(p + 2 AS BIGINT) AS "end" FROM p""")
def phrase_positions_overlap(spark, sf_dir):
    return search.phrase_fragments(table(spark, sf_dir, "documents"), "ele", ["doc_id"])


@query("SELECT doc_id, CAST((length(text) - length(replace(text, 'ele', ''))) / 3 AS BIGINT) AS n_matches FROM documents")
def phrase_count_nonoverlap(spark, sf_dir):
    return search.phrase_counts(table(spark, sf_dir, "documents"), "ele", ["doc_id"])


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Z][a-z]+')) AS BIGINT) AS n_matches FROM documents")
def regex_match_count(spark, sf_dir):
    return search.regex_counts(table(spark, sf_dir, "documents"), "[A-Z][a-z]+", ["doc_id"])


@query("""
WITH m AS (SELECT doc_id, string_split_regex(text, '[0-9]+') AS gaps, regexp_extract_all(text, '[0-9]+') AS found FROM documents),
r AS (SELECT doc_id, generate_subscripts(found, 1) AS n, unnest(found) AS txt, gaps FROM m),
s AS (SELECT doc_id, n, txt, length(gaps[n]) AS gap FROM r)
SELECT doc_id, CAST(sum(gap) OVER w + coalesce(sum(length(txt)) OVER b, 0) AS BIGINT) AS start,
  CAST(sum(gap) OVER w + coalesce(sum(length(txt)) OVER b, 0) + length(txt) AS BIGINT) AS "end", txt FROM s
WINDOW w AS (PARTITION BY doc_id ORDER BY n), b AS (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def regex_fragments(spark, sf_dir):
    return search.regex_fragments(table(spark, sf_dir, "documents"), "[0-9]+", ["doc_id"])


@query("SELECT conv_id, turn, replace(text, 'the', '') AS text, CAST((length(text) - length(replace(text, 'the', ''))) / 3 AS BIGINT) AS n_replaced FROM conversations")
def redact_text(spark, sf_dir):
    return search.redact_text(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "the")


@query("SELECT conv_id, turn, replace(text, 'on', '[ON]') AS text, CAST((length(text) - length(replace(text, 'on', ''))) / 2 AS BIGINT) AS n_replaced FROM conversations")
def replace_text(spark, sf_dir):
    return search.replace_text(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "on", "[ON]")


@query("""
WITH p AS (SELECT conv_id, turn, string_split(text, 'on') AS p FROM conversations),
l AS (SELECT *, least(len(p) - 1, greatest(0, 5 - coalesce(sum(len(p) - 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS k FROM p)
SELECT conv_id, turn, CAST(k AS BIGINT) AS n_replaced,
  array_to_string(p[1:CAST(k AS BIGINT) + 1], '#') || CASE WHEN k < len(p) - 1 THEN 'on' || array_to_string(p[CAST(k AS BIGINT) + 2:], 'on') ELSE '' END AS text FROM l""")
def replace_with_quota(spark, sf_dir):
    return search.replace_with_quota(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "on", "#", 5, ["conv_id"], "turn")


@query(LINES_SQL + r"SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, txt FROM t WHERE regexp_matches(txt, '^([0-9]+[.)]|[-*]|[A-Z][a-z]*[.)]) ?')")
def list_marker_lines(spark, sf_dir):
    lines = search.line_fragments(table(spark, sf_dir, "documents"), ["doc_id"])
    return lines.where(F.col("txt").rlike(r"^([0-9]+[.)]|[-*]|[A-Z][a-z]*[.)]) ?")).select("doc_id", "line_no", "txt")


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text, count(*) AS n_pages FROM conversations GROUP BY conv_id")
def text_per_document(spark, sf_dir):
    return search.text_of_documents(table(spark, sf_dir, "conversations"), ["conv_id"], "turn")


# Pages: turns of conversations ----------------------------------------------------------------------------------------


def _pages(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return pages.renumber(turns, ["conv_id"], "turn").select("conv_id", "page_index", "role", "text")


PAGES_SQL = "WITH p AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS page_index, role, text FROM conversations) "


@query("SELECT conv_id, count(*) AS n_pages FROM conversations GROUP BY conv_id")
def page_count(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_pages"))


@query(PAGES_SQL + "SELECT * FROM p WHERE page_index >= 1 AND page_index < 7 AND (page_index - 1) % 2 = 0")
def page_slice_step(spark, sf_dir):
    return pages.slice_pages(_pages(spark, sf_dir), 1, 7, 2)


@query(PAGES_SQL + ", s AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM p) SELECT conv_id, page_index - 1 AS page_index, role, text FROM s WHERE n >= 3 AND page_index BETWEEN 1 AND 2")
def extract_range(spark, sf_dir):
    return pages.extract_range(_pages(spark, sf_dir), ["conv_id"], 2, 3)


@query(PAGES_SQL + "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY page_index) - 1 AS page_index, role, text FROM p WHERE page_index + 1 NOT IN (1, 3, 9)")
def delete_pages(spark, sf_dir):
    return pages.delete_pages(_pages(spark, sf_dir), ["conv_id"], [1, 3, 9])


@query(PAGES_SQL + """, n AS (SELECT conv_id, least(count(*), 2) AS place FROM p GROUP BY conv_id)
SELECT p.conv_id, CASE WHEN p.page_index >= n.place THEN p.page_index + 1 ELSE p.page_index END AS page_index, role, text FROM p JOIN n USING (conv_id)
UNION ALL SELECT conv_id, place, 'new', 'blank' FROM n""")
def insert_shift(spark, sf_dir):
    every = _pages(spark, sf_dir)
    new = every.select("conv_id").distinct().withColumns({"role": F.lit("new"), "text": F.lit("blank")})
    return pages.insert_pages(every, new, 2, ["conv_id"])


@query(PAGES_SQL + """, u AS (SELECT 0 AS part, * FROM p WHERE role = 'user' UNION ALL SELECT 1, * FROM p WHERE role = 'assistant' UNION ALL SELECT 2, * FROM p WHERE role NOT IN ('user', 'assistant'))
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, page_index) - 1 AS page_index, role, text FROM u""")
def concat_renumber(spark, sf_dir):
    every = _pages(spark, sf_dir)
    return pages.concatenate([every.where("role = 'user'"), every.where("role = 'assistant'"), every.where("role NOT IN ('user', 'assistant')")], ["conv_id"])


@query(PAGES_SQL + "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN page_index = 0 THEN 2.5 ELSE page_index END) - 1 AS page_index, role, text FROM p")
def move_page(spark, sf_dir):
    return pages.move_page(_pages(spark, sf_dir), ["conv_id"], 0, 2)


@query(PAGES_SQL + "SELECT * FROM p UNION ALL SELECT conv_id, max(page_index) + 1, NULL, NULL FROM p GROUP BY conv_id")
def append_blank(spark, sf_dir):
    return pages.append_blank(_pages(spark, sf_dir), ["conv_id"])


@query("SELECT page_index, count(*) AS n_documents, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM (" + PAGES_SQL + "SELECT * FROM p) GROUP BY page_index")
def split_per_page(spark, sf_dir):
    return _pages(spark, sf_dir).groupBy("page_index").agg(F.count("*").alias("n_documents"), F.sum(F.length("text")).alias("n_chars"))


# Lookups ----------------------------------------------------------------------------------------------------------------


@query("""
WITH r(layer, lo, hi, first) AS (VALUES (1, -1000.0, -500.01, 100), (1, 0.0, 1999.99, 200), (2, 1000.0, 5999.99, 300), (3, -250.0, 250.0, 400)),
m AS (SELECT c_custkey, c_acctbal, layer, lo, first, row_number() OVER (PARTITION BY c_custkey ORDER BY layer, lo) AS k FROM customer JOIN r ON c_acctbal BETWEEN lo AND hi)
SELECT c.c_custkey, CAST(m.layer AS INTEGER) AS layer, CAST(m.first + floor(m.c_acctbal - m.lo) AS BIGINT) AS code FROM customer c LEFT JOIN m ON m.c_custkey = c.c_custkey AND k = 1""")
def range_lookup(spark, sf_dir):
    ranges = spark.createDataFrame([(1, -1000.0, -500.01, 100), (1, 0.0, 1999.99, 200), (2, 1000.0, 5999.99, 300), (3, -250.0, 250.0, 400)], "layer int, lo double, hi double, first int")
    codes = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return lookups.range_lookup(codes, ranges, "c_acctbal", 500.0).select("c_custkey", "layer", F.floor(F.col("first") + F.floor(F.col("c_acctbal") - F.col("lo"))).alias("code"))


@query("""
WITH s AS (SELECT n_name AS source_name, 1 AS priority, 'nation' AS kind FROM nation UNION ALL SELECT r_name, 2, 'region' FROM region UNION ALL SELECT lower(c_mktsegment), 0, 'segment' FROM customer GROUP BY 1),
b AS (SELECT *, row_number() OVER (PARTITION BY lower(source_name) ORDER BY priority DESC, source_name) AS k FROM s)
SELECT c.c_custkey, b.kind, b.source_name FROM customer c LEFT JOIN b ON lower(b.source_name) = lower(c.c_mktsegment) AND b.k = 1""")
def fallback_resolution(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    sources = (
        table(spark, sf_dir, "nation").select(F.col("n_name").alias("source_name"), F.lit(1).alias("priority"), F.lit("nation").alias("kind"))
        .unionAll(table(spark, sf_dir, "region").select("r_name", F.lit(2), F.lit("region")))
        .unionAll(customer.select(F.lower("c_mktsegment"), F.lit(0), F.lit("segment")).distinct())
    )
    return lookups.first_of_sources(customer.select("c_custkey", "c_mktsegment"), sources, "c_mktsegment", "priority").select("c_custkey", "kind", "source_name")


@query("""SELECT o_orderkey, o_custkey, c_name, n_name, CAST(o_totalprice AS DOUBLE) AS o_totalprice FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey""")
def placement_join(spark, sf_dir):
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    joined = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"], "left")
    return joined.select("o_orderkey", "o_custkey", "c_name", "n_name", "o_totalprice")


@query("""
WITH a AS (SELECT doc_id, 'quality' AS name, CAST(quality AS VARCHAR) AS v FROM labels UNION ALL SELECT doc_id, 'toxic', CAST(toxic AS VARCHAR) FROM labels),
b AS (SELECT doc_id, 'lang' AS name, lang AS v FROM documents UNION ALL SELECT doc_id, 'quality', '?' FROM documents)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.name, b.name) AS name, coalesce(a.v, b.v) AS value,
  CASE WHEN a.v IS NULL THEN 'right' WHEN b.v IS NULL THEN 'left' ELSE 'both' END AS found_in
FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.name = b.name""")
def metadata_sync(spark, sf_dir):
    labels, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").select("doc_id", "lang")
    left = labels.select("doc_id", F.lit("quality").alias("name"), F.col("quality").cast("string").alias("value")).unionAll(labels.select("doc_id", F.lit("toxic"), F.col("toxic").cast("string")))
    right = docs.select("doc_id", F.lit("lang").alias("name"), F.col("lang").alias("value")).unionAll(docs.select("doc_id", F.lit("quality"), F.lit("?")))
    return lookups.synchronise(left, right, ["doc_id", "name"], "left")


@query("""
SELECT DISTINCT doc_id, 'right' AS missing_in FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
UNION ALL SELECT DISTINCT doc_id, 'left' FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE l.doc_id = d.doc_id)""")
def coverage_gaps(spark, sf_dir):
    return lookups.coverage_gaps(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id"), ["doc_id"])


@query("""SELECT o_orderkey, o_custkey, o_totalprice FROM orders a WHERE EXISTS (SELECT 1 FROM orders b WHERE b.o_custkey = a.o_custkey AND b.o_orderdate > a.o_orderdate AND b.o_totalprice > a.o_totalprice)""")
def later_cover_semijoin(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    return lookups.covered_later(orders.withColumn("_at", F.unix_micros(F.col("o_orderdate").cast("timestamp"))), "o_custkey", "_at", F.col("o_totalprice")).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT l_orderkey, l_linenumber, p_name FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size > 25")
def object_resolve(spark, sf_dir):
    part = table(spark, sf_dir, "part").where("p_size > 25").select("p_partkey", "p_name")
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return items.join(part, items["l_partkey"] == part["p_partkey"], "left").select("l_orderkey", "l_linenumber", "p_name")


# Aggregates and content identity ------------------------------------------------------------------------------------------


@query("""
WITH d AS (SELECT doc_id, sha256(text) AS digest FROM documents)
SELECT doc_id, digest, min(doc_id) OVER (PARTITION BY digest) AS canonical_id, count(*) OVER (PARTITION BY digest) AS n_copies FROM d""")
def dedup_canonical(spark, sf_dir):
    return groups.canonical_ids(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5, CAST(strlen(text) AS BIGINT) AS n_bytes FROM documents")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.md5("text").alias("md5"), F.octet_length("text").cast("long").alias("n_bytes"))


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def latest_wins(spark, sf_dir):
    return groups.latest(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], ["event_id", "event_type"])


@query("""
WITH r AS (SELECT label, generate_subscripts(embedding, 1) - 1 AS dimension, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)
SELECT label, CAST(dimension AS INTEGER) AS dimension, round(avg(x), 6) AS mean FROM r GROUP BY ALL""")
def centroid(spark, sf_dir):
    return groups.centroids(table(spark, sf_dir, "embeddings"), "label", "embedding").withColumn("mean", F.round("mean", 6))


@query("SELECT event_type, quantile_cont(value, 0.5) AS median FROM events GROUP BY event_type")
def median_by_group(spark, sf_dir):
    return groups.exact_medians(table(spark, sf_dir, "events"), "event_type", "value")


@query("""
WITH s AS (SELECT p_brand, p_size, sum(length(p_name) + 1) AS w FROM part GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY w DESC, p_size) AS k FROM s)
SELECT p_brand, p_size AS mode, CAST(w AS BIGINT) AS weight FROM r WHERE k = 1""")
def weighted_mode(spark, sf_dir):
    return groups.weighted_mode(table(spark, sf_dir, "part"), "p_brand", "p_size", F.length("p_name") + 1)


@query("""
SELECT l_suppkey, min(l_quantity) AS x0, max(l_quantity) AS x1, min(l_extendedprice) AS y0, max(l_extendedprice) AS y1 FROM lineitem GROUP BY l_suppkey""")
def bounding_boxes(spark, sf_dir):
    return objects.bounding_boxes(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_quantity", "l_extendedprice")


@query("""
SELECT l_orderkey // 4 AS cell_x, CAST(l_linenumber // 4 AS BIGINT) AS cell_y, CAST((sum(CAST(l_quantity AS BIGINT)) + count(*) // 2) // count(*) AS BIGINT) AS mean FROM lineitem GROUP BY ALL""")
def box_downscale(spark, sf_dir):
    cells = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("q"))
    return groups.box_means(cells, "l_orderkey", "l_linenumber", "q", 4)


@query("SELECT 1000000 + row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS object_id, n_regionkey, n_name FROM nation")
def object_registration(spark, sf_dir):
    return objects.register_objects(table(spark, sf_dir, "nation"), ["n_regionkey"], ["n_nationkey"], 1_000_001).select("object_id", "n_regionkey", "n_name")


# Ordered, layout-like logic -----------------------------------------------------------------------------------------------


@query("""
WITH f AS (SELECT user_id, event_id, event_type, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS run_no FROM f)
SELECT user_id, CAST(run_no AS BIGINT) AS run_no, min(event_type) AS event_type, min(event_id) AS "first", max(event_id) AS "last", count(*) AS n FROM g GROUP BY user_id, run_no""")
def run_islands(spark, sf_dir):
    return groups.runs(table(spark, sf_dir, "events"), ["user_id"], ["event_id"], "event_type")


@query("""
WITH RECURSIVE v AS (SELECT p_brand, list_reverse(list_sort(list_distinct(list(CAST(p_size AS DOUBLE))))) AS s FROM part GROUP BY p_brand),
t(p_brand, s, i, head, tier) AS (
  SELECT p_brand, s, 1, s[1], 1 FROM v
  UNION ALL SELECT p_brand, s, i + 1, CASE WHEN head > s[i+1] * 1.05 THEN s[i+1] ELSE head END, CASE WHEN head > s[i+1] * 1.05 THEN least(tier + 1, 3) ELSE tier END FROM t WHERE i < len(s))
SELECT p_brand, s[i] AS size, CAST(tier AS INTEGER) AS tier FROM t""")
def heading_tiers(spark, sf_dir):
    sizes = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.collect_set(F.col("p_size").cast("double")).alias("s"))  # of fixed domain
    return sizes.select("p_brand", F.explode(groups.head_relative_tiers(F.col("s"), 1.05, 3)).alias("t")).select("p_brand", "t.size", "t.tier")


@query("""
WITH RECURSIVE o AS (SELECT l_orderkey, l_extendedprice AS y, l_linenumber AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_quantity, l_linenumber) AS k FROM lineitem),
t(l_orderkey, id, k, head, row_no) AS (
  SELECT l_orderkey, id, k, y, 1 FROM o WHERE k = 1
  UNION ALL SELECT t.l_orderkey, o.id, o.k, CASE WHEN t.head - o.y > 5000 THEN o.y ELSE t.head END, CASE WHEN t.head - o.y > 5000 THEN t.row_no + 1 ELSE t.row_no END
  FROM t JOIN o ON o.l_orderkey = t.l_orderkey AND o.k = t.k + 1)
SELECT l_orderkey, CAST(id AS BIGINT) AS id, CAST(row_no AS INTEGER) AS row_no FROM t""")
def row_groups(spark, sf_dir):
    point = F.struct(F.col("l_extendedprice").alias("y"), F.col("l_quantity").alias("x"), F.col("l_linenumber").alias("id"))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(point).alias("p"))  # lines of an order
    return lines.select("l_orderkey", F.explode(groups.head_relative_rows(F.col("p"), 5000.0)).alias("r")).select("l_orderkey", "r.id", "r.row_no")


@query("""
WITH f AS (SELECT user_id, event_id, CASE WHEN lag(value) OVER w > 0 AND value / lag(value) OVER w BETWEEN 0.5 AND 2.0 AND event_type = lag(event_type) OVER w THEN 0
    WHEN row_number() OVER w = 1 THEN 1 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, event_id, CAST(sum(b) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS paragraph FROM f""")
def paragraph_groups(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("event_id")
    before = F.lag("value").over(w)
    goes_on = (before > 0) & (F.col("value") / F.nullif(before, F.lit(0.0))).between(0.5, 2.0) & (F.col("event_type") == F.lag("event_type").over(w))
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    return groups.paragraphs(events, ["user_id"], "event_id", ~F.coalesce(goes_on, F.lit(False))).select("user_id", "event_id", "paragraph")


@query("""
WITH g AS (SELECT l_orderkey, l_extendedprice AS x, lead(l_extendedprice) OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_linenumber) - l_extendedprice AS gap FROM lineitem)
SELECT l_orderkey, max(gap) AS gap, arg_max(x, (gap, x)) AS cut FROM g WHERE gap IS NOT NULL GROUP BY l_orderkey HAVING max(gap) >= 1000""")
def column_gap(spark, sf_dir):
    return objects.widest_gaps(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_extendedprice", 1000)


# Graphs -------------------------------------------------------------------------------------------------------------------


@query("""
WITH RECURSIVE n AS (SELECT c_custkey AS id, CASE WHEN c_custkey // 3 > 0 THEN c_custkey // 3 END AS parent FROM customer),
u(id, top, depth) AS (SELECT id, id, 0 FROM n UNION ALL SELECT u.id, n.parent, depth + 1 FROM u JOIN n ON n.id = u.top WHERE n.parent IS NOT NULL)
SELECT u.id, u.top AS root, CAST(u.depth AS BIGINT) AS depth FROM u JOIN n ON n.id = u.top WHERE n.parent IS NULL""")
def chain_depth(spark, sf_dir):
    up = F.expr("c_custkey div 3")
    return graph.chain_depths(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(up > 0, up).alias("parent")))


@query("""
WITH RECURSIVE n AS (SELECT c_custkey AS id, CASE WHEN c_custkey // 3 > 0 THEN c_custkey // 3 END AS parent, c_name AS name FROM customer),
d(id, path) AS (SELECT id, name FROM n WHERE parent IS NULL UNION ALL SELECT n.id, d.path || '.' || n.name FROM d JOIN n ON n.parent = d.id)
SELECT id, path FROM d""")
def qualified_names(spark, sf_dir):
    up = F.expr("c_custkey div 3")
    return graph.qualified_names(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(up > 0, up).alias("parent"), F.col("c_name").alias("name")))


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT l_partkey AS src, l_suppkey + 1000000 AS dst FROM lineitem UNION SELECT DISTINCT l_suppkey + 1000000, l_orderkey + 2000000 FROM lineitem),
h(id, hop) AS (SELECT p_partkey, 0 FROM part WHERE p_size = 1 UNION SELECT e.dst, h.hop + 1 FROM h JOIN e ON e.src = h.id WHERE h.hop < 2)
SELECT id, CAST(min(hop) AS INTEGER) AS hop FROM h GROUP BY id""")
def reachable_objects(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    edges = items.select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + 1_000_000).alias("dst")).unionAll(items.select(F.col("l_suppkey") + 1_000_000, F.col("l_orderkey") + 2_000_000))
    return graph.hops(edges, table(spark, sf_dir, "part").where("p_size = 1").select(F.col("p_partkey").alias("id")), 2)


@query("""
WITH n AS (SELECT event_id, CASE WHEN event_type <> 'error' THEN lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) END AS next, user_id, event_type FROM events),
b AS (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) <> 'error' THEN 0 ELSE 1 END AS head FROM n),
g AS (SELECT *, sum(head) OVER (PARTITION BY user_id ORDER BY event_id) AS chain FROM b)
SELECT event_id AS id, min(event_id) OVER (PARTITION BY user_id, chain) AS head, row_number() OVER (PARTITION BY user_id, chain ORDER BY event_id) - 1 AS place FROM g""")
def action_chain(spark, sf_dir):
    following = F.lead("event_id").over(Window.partitionBy("user_id").orderBy("event_id"))
    links = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_type") != "error", following).alias("next"))
    return graph.walk_chains(links)


@query("""
WITH RECURSIVE e AS (SELECT c_custkey // 2 AS src, c_custkey AS dst FROM customer WHERE c_custkey % 5 <> 0),
r(id) AS (SELECT c_custkey FROM customer WHERE c_custkey <= 3 UNION SELECT e.dst FROM r JOIN e ON e.src = r.id)
SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT id FROM r)""")
def unreachable_objects(spark, sf_dir):
    ids = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    edges = ids.where("id % 5 <> 0").select(F.expr("id div 2").alias("src"), F.col("id").alias("dst"))
    return graph.unreachable(ids, edges, ids.where("id <= 3"))


@query("""
WITH o AS (SELECT l_orderkey, bool_and(l_returnflag <> 'R') AS all_on, bool_or(l_returnflag <> 'R') AS any_on, arg_min(l_returnflag <> 'R', struct_pack(n := l_linenumber, v := l_returnflag <> 'R')) AS first_on FROM lineitem GROUP BY l_orderkey),
v AS (SELECT o_custkey, CASE o_orderkey % 4 WHEN 0 THEN all_on WHEN 1 THEN any_on WHEN 2 THEN NOT first_on END AS value, o_orderkey % 4 = 3 AS bad FROM orders JOIN o ON l_orderkey = o_orderkey)
SELECT o_custkey AS id, CASE WHEN bool_or(bad) THEN NULL ELSE bool_or(value) END AS value FROM v GROUP BY o_custkey""")
def boolean_visibility(spark, sf_dir):
    items, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    none = F.lit(None).cast("boolean")
    leaves = items.select((F.col("l_orderkey") * 10 + F.col("l_linenumber") + 10**12).alias("id"), (F.col("l_orderkey") + 10**9).alias("parent"), F.col("l_linenumber").cast("long").alias("place"), F.lit(None).cast("string").alias("op"), (F.col("l_returnflag") != "R").alias("value"))
    kind = F.col("o_orderkey") % 4
    some = orders.join(items.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi")
    op = F.when(kind == 0, "And").when(kind == 1, "Or").when(kind == 2, "Not").otherwise("Xor")
    inner = some.select((F.col("o_orderkey") + 10**9).alias("id"), F.col("o_custkey").cast("long").alias("parent"), F.col("o_orderkey").cast("long").alias("place"), op.alias("op"), none.alias("value"))
    tops = some.select(F.col("o_custkey").cast("long").alias("id")).distinct().select("id", F.lit(None).cast("long").alias("parent"), F.lit(0).cast("long").alias("place"), F.lit("Or").alias("op"), none.alias("value"))
    return graph.expression_values(leaves.unionByName(inner).unionByName(tops))


# Scalars ------------------------------------------------------------------------------------------------------------------


@query(r"""SELECT doc_id, replace(replace(replace(regexp_replace(text, '([\\()])', '\\\1', 'g'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t') AS literal FROM documents""")
def escape_literal(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", scalars.escape_literal(F.col("text")).alias("literal"))


@query("""
WITH RECURSIVE o(k, rest, digits) AS (SELECT DISTINCT o_orderkey, o_orderkey, '' FROM orders UNION ALL SELECT k, rest // 8, CAST(rest % 8 AS VARCHAR) || digits FROM o WHERE rest > 0)
SELECT k AS o_orderkey, CASE WHEN digits = '' THEN '0' ELSE digits END AS octal, k AS back FROM o WHERE rest = 0""")
def base_convert(spark, sf_dir):
    octal = scalars.to_octal(F.col("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", octal.alias("octal"), scalars.from_octal(octal).alias("back"))


@query("SELECT event_id, 'D:' || strftime(ts, '%Y%m%d%H%M%S') || 'Z' AS tagged, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events")
def date_convert(spark, sf_dir):
    tagged = scalars.iso_to_tagged_date(F.col("ts"))
    return table(spark, sf_dir, "events").select("event_id", tagged.alias("tagged"), scalars.tagged_date_to_iso(tagged).alias("iso"))


@query("SELECT l_orderkey, l_linenumber, 2.0 * l_quantity + 0.5 * l_tax + 10.0 AS x, -1.0 * l_quantity + 3.0 * l_tax + 20.0 AS y FROM lineitem")
def affine_apply(spark, sf_dir):
    x, y = scalars.affine(F.col("l_quantity"), F.col("l_tax"), (2.0, -1.0, 0.5, 3.0, 10.0, 20.0))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", x.alias("x"), y.alias("y"))


@query("""
WITH c AS (SELECT l_orderkey, l_linenumber, l_tax AS a, l_quantity - 25 AS b, l_discount AS c FROM lineitem),
r AS (SELECT *, b * b - 4 * a * c AS d FROM c)
SELECT l_orderkey, l_linenumber, CASE WHEN abs(a) < 1e-12 THEN CASE WHEN abs(b) < 1e-12 THEN 0 ELSE 1 END WHEN d < 0 THEN 0 ELSE 2 END AS n_roots,
  round(CASE WHEN abs(a) < 1e-12 THEN CASE WHEN abs(b) < 1e-12 THEN NULL ELSE -c / b END WHEN d < 0 THEN NULL ELSE least((-b - sqrt(d)) / (2 * a), (-b + sqrt(d)) / (2 * a)) END, 6) + 0.0 AS smallest FROM r""")
def quadratic_roots(spark, sf_dir):
    roots = scalars.quadratic_roots(F.col("l_tax"), F.col("l_quantity") - 25, F.col("l_discount"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.size(roots).alias("n_roots"), (F.round(F.get(roots, F.lit(0)), 6) + 0.0).alias("smallest"))


@query("""
WITH c AS (SELECT l_orderkey, l_linenumber, l_orderkey % 256 AS c, l_partkey % 256 AS m, l_suppkey % 256 AS y, l_linenumber % 256 AS k FROM lineitem),
r AS (SELECT l_orderkey, l_linenumber, (255 - c) * (255 - k) // 255 AS r, (255 - m) * (255 - k) // 255 AS g, (255 - y) * (255 - k) // 255 AS b FROM c)
SELECT l_orderkey, l_linenumber, CAST(r AS INTEGER) AS r, CAST(g AS INTEGER) AS g, CAST(b AS INTEGER) AS b, CAST((299 * r + 587 * g + 114 * b) // 1000 AS INTEGER) AS gray FROM r""")
def colour_convert(spark, sf_dir):
    c, m, y, k = (F.col(x) % 256 for x in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    r, g, b = scalars.cmyk_to_rgb(c, m, y, k)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", r.alias("r"), g.alias("g"), b.alias("b"), scalars.gray(r, g, b).alias("gray"))


@query("SELECT p_partkey, regexp_replace(upper(p_brand[1:1]) || 'BCDEF+' || p_name, '^[A-Z]{6}[+]', '') AS name, CAST(trunc(p_retailprice) AS BIGINT) AS price FROM part")
def names_and_numbers(spark, sf_dir):
    tagged = F.concat(F.upper(F.substring("p_brand", 1, 1)), F.lit("BCDEF+"), F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", scalars.without_subset_prefix(tagged).alias("name"), F.col("p_retailprice").cast("long").alias("price"))


@query("SELECT o_orderkey, (o_orderkey >> 2) & 1 = 1 AS may_print, (o_orderkey >> 3) & 1 = 1 AS may_change, (o_orderkey >> 4) & 1 = 1 AS may_copy FROM orders")
def permission_flags(spark, sf_dir):
    bits = scalars.flags(F.col("o_orderkey"), {"may_print": 2, "may_change": 3, "may_copy": 4})
    return table(spark, sf_dir, "orders").select("o_orderkey", *[c.alias(n) for n, c in bits.items()])


@query("""
WITH s AS (SELECT p_partkey, p_size * 10 AS w, CAST(p_retailprice AS BIGINT) AS h FROM (SELECT p_partkey, p_size, floor(p_retailprice) AS p_retailprice FROM part))
SELECT p_partkey, CASE WHEN greatest(w, h) <= 500 THEN CAST(w AS BIGINT) ELSE greatest(1, CAST(floor(w * 500 / greatest(w, h)) AS BIGINT)) END AS w,
  CASE WHEN greatest(w, h) <= 500 THEN h ELSE greatest(1, CAST(floor(h * 500 / greatest(w, h)) AS BIGINT)) END AS h FROM s""")
def fit_within(spark, sf_dir):
    w, h = scalars.fit_within((F.col("p_size") * 10).cast("long"), F.floor("p_retailprice"), 500)
    return table(spark, sf_dir, "part").select("p_partkey", w.alias("w"), h.alias("h"))


# Metadata, rules ------------------------------------------------------------------------------------------------------------


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.missing') IS NULL AS lacks FROM events")
def props_json(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.get_json_object("props", "$.missing").isNull().alias("lacks"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, CAST(len(regexp_extract_all(html, '<li>')) AS BIGINT) AS n_items FROM pages")
def html_title_items(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_count("html", F.lit("<li>")).cast("long").alias("n_items"))


@query("""
SELECT doc_id, 'short' AS rule, 'warning' AS severity, 'fewer than 200 characters' AS message FROM documents WHERE length(text) < 200
UNION ALL SELECT doc_id, 'no-sentence', 'error', 'no full stop' FROM documents WHERE NOT contains(text, '.')
UNION ALL SELECT doc_id, 'length', 'error', 'n_chars differs from the text' FROM documents WHERE n_chars <> length(text)""")
def rule_findings(spark, sf_dir):
    checks = {
        "short": ("warning", F.length("text") < 200, "fewer than 200 characters"),
        "no-sentence": ("error", ~F.contains("text", F.lit(".")), "no full stop"),
        "length": ("error", F.col("n_chars") != F.length("text"), "n_chars differs from the text"),
    }
    return rules.findings(table(spark, sf_dir, "documents"), ["doc_id"], checks)


@query("""
WITH m AS (SELECT doc_id, length(text) AS c, len(string_split(text, ' ')) AS w, len(string_split(text, chr(10))) AS l FROM documents)
SELECT doc_id, 'max_chars' AS "limit", CAST(c AS BIGINT) AS value, CAST(5000 AS BIGINT) AS cap FROM m WHERE c > 5000
UNION ALL SELECT doc_id, 'max_words', w, 800 FROM m WHERE w > 800 UNION ALL SELECT doc_id, 'max_lines', l, 20 FROM m WHERE l > 20""")
def limit_violations(spark, sf_dir):
    measures = {"max_chars": F.length("text"), "max_words": F.size(F.split("text", " ")), "max_lines": F.size(F.split("text", "\n"))}
    return rules.limit_violations(table(spark, sf_dir, "documents"), ["doc_id"], measures, rules.Limits())


@query("SELECT conv_id, turn, CAST(sum(length(text)) OVER w AS BIGINT) AS spent, sum(length(text)) OVER w <= 600 AS within FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def cumulative_budget(spark, sf_dir):
    return rules.spend(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), ["conv_id"], "turn", F.length("text"), 600).drop("text")


@query("""
SELECT l_orderkey, bool_and(l_returnflag = 'N') AS all_on, bool_or(l_returnflag = 'N') AS any_on, bool_or(l_returnflag <> 'N') AS any_off, bool_and(l_returnflag <> 'N') AS all_off FROM lineitem GROUP BY l_orderkey""")
def visibility_policy(spark, sf_dir):
    states = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_returnflag") == "N").alias("on"))
    names = {"all_on": "AllOn", "any_on": "AnyOn", "any_off": "AnyOff", "all_off": "AllOff"}
    return states.groupBy("l_orderkey").agg(*[rules.visible(p, "on").alias(n) for n, p in names.items()])


@query("""
WITH f AS (SELECT doc_id, CASE WHEN quality = 0 THEN 'junk' END AS a, CASE WHEN toxic = 1 THEN 'toxic' END AS b FROM labels)
SELECT d.lang, count(*) AS n, count(a) AS n_junk, count(b) AS n_toxic, count(a) + count(b) = 0 AS valid FROM f JOIN documents d USING (doc_id) GROUP BY d.lang""")
def findings_summary(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    both = labels.join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    junk, toxic = F.count_if(F.col("quality") == 0), F.count_if(F.col("toxic") == 1)
    return both.groupBy("lang").agg(F.count("*").alias("n"), junk.alias("n_junk"), toxic.alias("n_toxic"), (junk + toxic == 0).alias("valid"))


@query("""
WITH u AS (SELECT user_id AS owner, event_type AS name, value, 0 AS gen, event_id FROM events UNION ALL SELECT user_id, 'view', 0.0, 1, event_id FROM events WHERE event_type = 'error'),
r AS (SELECT *, row_number() OVER (PARTITION BY owner, name ORDER BY gen DESC, event_id DESC) AS k FROM u)
SELECT owner, name, value FROM r WHERE k = 1""")
def attachments_upsert(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    old = events.select(F.col("user_id").alias("owner"), F.col("event_type").alias("name"), "value", F.lit(0).alias("gen"), "event_id")
    new = events.where("event_type = 'error'").select(F.col("user_id").alias("owner"), F.lit("view").alias("name"), F.lit(0.0).alias("value"), F.lit(1).alias("gen"), "event_id")
    return old.unionByName(new).groupBy("owner", "name").agg(F.max_by("value", F.struct("gen", "event_id")).alias("value"))


@query("SELECT l_orderkey, count(*) AS n FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM lineitem h WHERE h.l_orderkey = l.l_orderkey AND h.l_returnflag = 'R') GROUP BY l_orderkey")
def visible_minus_hidden(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag")
    hidden = items.where("l_returnflag = 'R'").select("l_orderkey")
    return items.join(hidden, "l_orderkey", "left_anti").groupBy("l_orderkey").agg(F.count("*").alias("n"))


# Windows over events (an extension; the same functions take streams) ---------------------------------------------------------


@query("""
SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def events_hourly(spark, sf_dir):
    out = event_windows.windowed_counts(table(spark, sf_dir, "events"))
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""
WITH f AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM f)
SELECT user_id, min(ts) AS session_start, count(*) AS n FROM g GROUP BY user_id, s""")
def event_sessions(spark, sf_dir):
    return event_windows.sessions(table(spark, sf_dir, "events")).withColumn("session_start", F.col("session_start").cast("timestamp_ntz"))


# More scalars and lookups -------------------------------------------------------------------------------------------------


@query("""
SELECT o_orderkey, CAST(CASE WHEN ((o_custkey % 24) * 30 - 360 + 720) % 360 % 90 = 0 THEN ((o_custkey % 24) * 30 - 360 + 720) % 360 END AS INTEGER) AS rotation FROM orders""")
def page_rotation(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.rotation((F.col("o_custkey") % 24) * 30 - 360).alias("rotation"))


@query("""
WITH c AS (SELECT l_orderkey, l_linenumber, l_quantity AS x, l_tax AS y, l_quantity + 1 AS x2, l_tax + 2 AS y2 FROM lineitem),
p AS (SELECT l_orderkey, l_linenumber, 2.0 * x + 0.5 * y AS a, 2.0 * x2 + 0.5 * y AS b, 2.0 * x + 0.5 * y2 AS c, 2.0 * x2 + 0.5 * y2 AS d, -1.0 * x + 3.0 * y AS e, -1.0 * x2 + 3.0 * y AS f, -1.0 * x + 3.0 * y2 AS g, -1.0 * x2 + 3.0 * y2 AS h FROM c)
SELECT l_orderkey, l_linenumber, round(least(a, b, c, d), 6) AS x0, round(least(e, f, g, h), 6) AS y0, round(greatest(a, b, c, d), 6) AS x1, round(greatest(e, f, g, h), 6) AS y1 FROM p""")
def image_boxes(spark, sf_dir):
    box = scalars.corner_box(F.col("l_quantity"), F.col("l_tax"), F.lit(1.0), F.lit(2.0), (2.0, -1.0, 0.5, 3.0, 0.0, 0.0))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[F.round(c, 6).alias(n) for c, n in zip(box, ("x0", "y0", "x1", "y1"), strict=True)])


@query("""
WITH c AS (SELECT l_orderkey, l_linenumber, l_quantity AS p0, l_quantity * 3 - 40 AS p1, 60 - l_quantity AS p2, l_tax AS p3 FROM lineitem),
q AS (SELECT *, p3 - 3 * p2 + 3 * p1 - p0 AS a, 2 * (p2 - 2 * p1 + p0) AS b, p1 - p0 AS c FROM c),
t AS (SELECT *, CASE WHEN abs(a) < 1e-12 THEN CASE WHEN abs(b) < 1e-12 THEN [] ELSE [-c / b] END WHEN b * b - 4 * a * c < 0 THEN [] ELSE [(-b - sqrt(greatest(0, b * b - 4 * a * c))) / (2 * a), (-b + sqrt(greatest(0, b * b - 4 * a * c))) / (2 * a)] END AS t FROM q),
v AS (SELECT l_orderkey, l_linenumber, list_concat([p0, p3], list_transform(list_filter(t, lambda x: x > 0 AND x < 1), lambda x: (1 - x) * (1 - x) * (1 - x) * p0 + 3 * (1 - x) * (1 - x) * x * p1 + 3 * (1 - x) * x * x * p2 + x * x * x * p3)) AS v FROM t)
SELECT l_orderkey, l_linenumber, round(list_min(v), 6) AS low, round(list_max(v), 6) AS high FROM v""")
def cubic_bounds(spark, sf_dir):
    q = F.col("l_quantity")
    low, high = scalars.cubic_bounds(q, q * 3 - 40, 60 - q, F.col("l_tax"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("""
WITH v AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(event_id AS VARCHAR) WHEN 1 THEN '2.5' WHEN 2 THEN ' TRUE ' ELSE event_type END AS v FROM events)
SELECT event_id, CASE WHEN regexp_full_match(trim(v), '[+-]?[0-9]{1,18}') THEN CAST(trim(v) AS BIGINT) END AS as_int,
  CASE WHEN regexp_full_match(trim(v), '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)') THEN CAST(trim(v) AS DOUBLE) END AS as_real,
  CASE WHEN lower(trim(v)) IN ('true', '1') THEN true WHEN lower(trim(v)) IN ('false', '0') THEN false END AS as_bool FROM v""")
def typed_values(spark, sf_dir):
    kind = F.col("event_id") % 4
    v = F.when(kind == 0, F.col("event_id").cast("string")).when(kind == 1, "2.5").when(kind == 2, " TRUE ").otherwise(F.col("event_type"))
    rows = table(spark, sf_dir, "events").select("event_id", v.alias("v"))
    return rows.select("event_id", *[c.alias(n) for n, c in scalars.typed(F.col("v")).items()])


@query("""
WITH c AS (SELECT p_partkey, p_size - 2 AS r, p_size * 3 AS g, CAST(p_partkey % 300 AS INTEGER) AS b FROM part)
SELECT p_partkey, CASE WHEN least(r, g, b) < 0 OR greatest(r, g, b) > 255 THEN NULL WHEN greatest(r, g, b) > 1 THEN r / 255.0 ELSE CAST(r AS DOUBLE) END AS r,
  CASE WHEN least(r, g, b) < 0 OR greatest(r, g, b) > 255 THEN NULL WHEN greatest(r, g, b) > 1 THEN b / 255.0 ELSE CAST(b AS DOUBLE) END AS b FROM c""")
def colour_normalise(spark, sf_dir):
    r, _, b = scalars.normalized_rgb(F.col("p_size") - 2, F.col("p_size") * 3, F.col("p_partkey") % 300)
    return table(spark, sf_dir, "part").select("p_partkey", r.alias("r"), b.alias("b"))


@query("SELECT o_orderkey, ((o_orderkey % 256) >> 6) & 3 AS a, ((o_orderkey % 256) >> 4) & 3 AS b, ((o_orderkey % 256) >> 2) & 3 AS c, (o_orderkey % 256) & 3 AS d FROM orders")
def unpack_samples(spark, sf_dir):
    s = scalars.samples_of(F.col("o_orderkey") % 256, 2)
    return table(spark, sf_dir, "orders").select("o_orderkey", *[F.get(s, F.lit(i)).alias(n) for i, n in enumerate("abcd")])


@query("""
WITH t(part, value) AS (VALUES ('ABEJA', 'a'), ('view', 'v'), ('click', 'c'), ('error', '!')),
n AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type || '_uni0041.alt' ELSE event_type END AS name FROM events),
p AS (SELECT event_id, unnest(string_split(split_part(name, '.', 1), '_')) AS part, generate_subscripts(string_split(split_part(name, '.', 1), '_'), 1) AS k FROM n),
r AS (SELECT event_id, k, coalesce(value, CASE WHEN p.part = 'uni0041' THEN 'A' END) AS v FROM p LEFT JOIN t ON t.part = p.part)
SELECT event_id, CASE WHEN bool_and(v IS NOT NULL) THEN string_agg(v, '' ORDER BY k) END AS value FROM r GROUP BY event_id""")
def resolve_names(spark, sf_dir):
    parts = spark.createDataFrame([("ABEJA", "a"), ("view", "v"), ("click", "c"), ("error", "!")], "part string, value string")
    name = F.when(F.col("event_id") % 3 == 0, F.concat("event_type", F.lit("_uni0041.alt"))).otherwise(F.col("event_type"))
    return lookups.resolve_names(table(spark, sf_dir, "events").select("event_id", name.alias("name")), parts, "event_id", "name")


@query("""
SELECT DISTINCT c_custkey, n_nationkey FROM customer JOIN nation ON lower(c_mktsegment) = lower(n_name) OR lower(c_mktsegment) = lower('SEG' || n_name) OR lower(c_mktsegment) = CASE n_nationkey % 5 WHEN 0 THEN 'automobile' WHEN 1 THEN 'building' WHEN 2 THEN 'furniture' WHEN 3 THEN 'machinery' ELSE 'household' END""")
def alias_match(spark, sf_dir):
    k = F.col("n_nationkey") % 5
    other = F.when(k == 0, "automobile").when(k == 1, "building").when(k == 2, "furniture").when(k == 3, "machinery").otherwise("household")
    fonts = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.concat(F.lit("SEG"), "n_name").alias("full"), other.alias("other"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return lookups.with_aliases(customer, fonts, "c_mktsegment", ["n_name", "full", "other"], "n_nationkey").select("c_custkey", "n_nationkey")


@query("SELECT p_partkey, CASE upper(regexp_replace(p_type, '[-_ /.]', '', 'g')) WHEN 'ECONOMY' THEN 'ECO' ELSE upper(regexp_replace(p_type, '[-_ /.]', '', 'g')) END AS name FROM part")
def algorithm_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", scalars.algorithm_name(F.col("p_type"), {"ECONOMY": "ECO"}).alias("name"))


@query("""
SELECT l.doc_id, l.quality, l.toxic FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id AND d.lang = 'fr')
UNION ALL SELECT doc_id, 0, 0 FROM documents WHERE lang = 'fr'""")
def upsert_rows(spark, sf_dir):
    new = table(spark, sf_dir, "documents").where("lang = 'fr'").select("doc_id", F.lit(0).alias("quality"), F.lit(0).alias("toxic"))
    return lookups.upsert(table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), new, ["doc_id"])


# Rows, marks and pictures ----------------------------------------------------------------------------------------------------


@query("""
WITH m AS (SELECT doc_id, string_split_regex(text, '([a-z]+)[.]([0-9]+)@mail') AS gaps, regexp_extract_all(text, '([a-z]+)[.]([0-9]+)@mail') AS found FROM documents),
r AS (SELECT doc_id, generate_subscripts(found, 1) AS n, unnest(found) AS txt, gaps FROM m),
s AS (SELECT doc_id, n, txt, length(gaps[n]) AS gap FROM r),
o AS (SELECT doc_id, txt, sum(gap) OVER w + coalesce(sum(length(txt)) OVER b, 0) AS start FROM s
  WINDOW w AS (PARTITION BY doc_id ORDER BY n), b AS (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT doc_id, CAST(start AS BIGINT) AS start, CAST(start + length(txt) AS BIGINT) AS "end", txt, regexp_extract(txt, '([a-z]+)[.]([0-9]+)@mail', 1) AS group_1, regexp_extract(txt, '([a-z]+)[.]([0-9]+)@mail', 2) AS group_2 FROM o""")
def regex_groups(spark, sf_dir):
    return search.regex_fragments(table(spark, sf_dir, "documents"), "([a-z]+)[.]([0-9]+)@mail", ["doc_id"], groups=2)


@query(LINES_SQL + r"""
SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, CASE WHEN regexp_matches(trim(txt), '^[•·◦‣▪●■⁃–—*\x{95}-](\s|$)') THEN 'ul' ELSE 'ol' END AS marker FROM t
WHERE regexp_matches(trim(txt), '^[•·◦‣▪●■⁃–—*\x{95}-](\s|$)') OR regexp_matches(trim(txt), '^\(?([0-9]{1,3}|[ivxlcdmIVXLCDM]{1,5}|[A-Za-z])[.)](\s|$)')""")
def list_marker_classes(spark, sf_dir):
    lines = search.line_fragments(table(spark, sf_dir, "documents"), ["doc_id"])
    return lines.select("doc_id", "line_no", search.list_marker(F.col("txt")).alias("marker")).where("marker IS NOT NULL")


@query("""
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM (SELECT doc_id, text FROM documents WHERE doc_id % 7 <> 0) a FULL JOIN (SELECT doc_id, CASE WHEN lang = 'fr' THEN text || '!' ELSE text END AS text FROM documents WHERE doc_id % 5 <> 0) b ON a.doc_id = b.doc_id
WHERE a.doc_id IS NULL OR b.doc_id IS NULL OR a.text <> b.text""")
def changed_objects(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    new = docs.where("doc_id % 5 <> 0").select("doc_id", F.when(F.col("lang") == "fr", F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"))
    return lookups.changed_rows(docs.where("doc_id % 7 <> 0"), new, "doc_id", ["text"])


@query("""
WITH w AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_extendedprice - lag(l_extendedprice) OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_linenumber) >= 5000 THEN 1 ELSE 0 END AS new, l_extendedprice FROM lineitem)
SELECT l_orderkey, l_linenumber, CAST(sum(new) OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_linenumber) AS BIGINT) AS "column" FROM w""")
def layout_columns(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return groups.columns_by_gap(items, ["l_orderkey"], "l_extendedprice", "l_linenumber", 5000).select("l_orderkey", "l_linenumber", "column")


@query("""
WITH r AS (SELECT o_custkey, o_orderkey, count(*) AS cells FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
f AS (SELECT *, CASE WHEN cells = lag(cells) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) THEN 0 ELSE 1 END AS new FROM r),
g AS (SELECT *, sum(new) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS run FROM f)
SELECT o_custkey, min(o_orderkey) AS first, max(o_orderkey) AS last, count(*) AS n_rows, any_value(cells) AS n_cells FROM g GROUP BY o_custkey, run HAVING count(*) >= 2 AND any_value(cells) >= 2""")
def table_runs(spark, sf_dir):
    cells = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("cells"))
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey").join(cells, "o_orderkey")
    return groups.table_runs(rows, ["o_custkey"], "o_orderkey", "cells")


@query("""
SELECT l_orderkey, l_linenumber, l_quantity * 2.0 + 1.0 * l_tax AS a, l_quantity * -1.0 + 1.0 * 3.0 AS b, l_discount * 2.0 + 2.0 * l_tax AS c, l_discount * -1.0 + 2.0 * 3.0 AS d,
  5.0 * 2.0 + l_quantity * l_tax + 7.0 AS e, 5.0 * -1.0 + l_quantity * 3.0 + l_discount AS f FROM lineitem""")
def matrix_products(spark, sf_dir):
    q, d, t, n = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax"), F.lit
    out = scalars.matrix_product([q, n(1.0), d, n(2.0), n(5.0), q], [n(2.0), n(-1.0), t, n(3.0), n(7.0), d])
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[c.alias(x) for c, x in zip(out, "abcdef", strict=True)])


@query("""
WITH b AS (SELECT p_partkey, least(p_size, p_partkey % 40) AS x0, greatest(p_size, p_partkey % 40) AS x1, least(p_partkey % 30, 12) AS y0, greatest(p_partkey % 30, 12) AS y1 FROM part),
c AS (SELECT p_partkey, greatest(x0, 5) AS x0, greatest(y0, 3) AS y0, least(x1, 25) AS x1, least(y1, 10) AS y1 FROM b)
SELECT p_partkey, CASE WHEN x0 <= x1 AND y0 <= y1 THEN x0 END AS x0, CASE WHEN x0 <= x1 AND y0 <= y1 THEN y0 END AS y0, CASE WHEN x0 <= x1 AND y0 <= y1 THEN x1 END AS x1, CASE WHEN x0 <= x1 AND y0 <= y1 THEN y1 END AS y1 FROM c""")
def crop_boxes(spark, sf_dir):
    box = scalars.rectangle(F.col("p_size"), F.col("p_partkey") % 30, F.col("p_partkey") % 40, F.lit(12))
    cut = scalars.crop(box, [F.lit(5), F.lit(3), F.lit(25), F.lit(10)])
    return table(spark, sf_dir, "part").select("p_partkey", *[c.alias(n) for c, n in zip(cut, ("x0", "y0", "x1", "y1"), strict=True)])


@query("""
SELECT p_partkey, p_size AS gray, CASE p_size % 4 WHEN 0 THEN 10 WHEN 1 THEN 40 WHEN 2 THEN 70 ELSE 0 END AS r, CASE p_size % 4 WHEN 0 THEN 20 WHEN 1 THEN 50 WHEN 2 THEN 80 ELSE 0 END AS g, CASE p_size % 4 WHEN 0 THEN 30 WHEN 1 THEN 60 WHEN 2 THEN 90 ELSE 0 END AS b FROM part""")
def palette_colours(spark, sf_dir):
    r, g, b = scalars.indexed_to_rgb(F.col("p_size") % 4, [(10, 20, 30), (40, 50, 60), (70, 80, 90)])
    return table(spark, sf_dir, "part").select("p_partkey", scalars.gray_to_rgb(F.col("p_size"))[1].alias("gray"), r.alias("r"), g.alias("g"), b.alias("b"))


@query(r"""
SELECT l_orderkey, l_linenumber, regexp_replace(printf('%.6f', CASE WHEN abs(l_discount - 0.05) < 0.0000005 THEN 0.0 ELSE CAST(l_quantity AS DOUBLE) * 0.25 + CASE WHEN l_linenumber % 2 = 0 THEN 0.125 ELSE 0.0 END END), '\.?0+$', '') AS number FROM lineitem""")
def number_texts(spark, sf_dir):
    value = F.when(F.abs(F.col("l_discount") - 0.05) < 0.0000005, 0.0).otherwise(F.col("l_quantity").cast("double") * 0.25 + F.when(F.col("l_linenumber") % 2 == 0, 0.125).otherwise(0.0))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", scalars.format_number(value).alias("number"))


@query("""
WITH n AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '/' || event_type WHEN 1 THEN CAST(event_id AS VARCHAR) WHEN 2 THEN event_type || ' x' ELSE '' END AS n FROM events)
SELECT event_id, CASE WHEN event_id % 4 = 0 THEN ltrim(n, '/') WHEN event_id % 4 = 1 THEN 'F' || n END AS name FROM n""")
def safe_names(spark, sf_dir):
    kind = F.col("event_id") % 4
    name = F.when(kind == 0, F.concat(F.lit("/"), "event_type")).when(kind == 1, F.col("event_id").cast("string")).when(kind == 2, F.concat("event_type", F.lit(" x"))).otherwise("")
    return table(spark, sf_dir, "events").select("event_id", scalars.safe_name(name, "F").alias("name"))


@query("""
WITH h AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE printf('%x', o_orderkey) END AS d FROM orders)
SELECT o_orderkey, lower(CASE WHEN length(d) % 2 = 1 THEN d || '0' ELSE d END) AS bytes FROM h""")
def hex_operands(spark, sf_dir):
    digits = F.lower(F.hex("o_orderkey"))
    text = F.when(F.col("o_orderkey") % 5 == 0, F.lit("<zz>")).otherwise(F.concat(F.lit("< "), digits, F.lit(" >rest")))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.lower(F.hex(scalars.hex_operand(text))).alias("bytes"))


@query("""
SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'png' WHEN 1 THEN 'jpg' WHEN 2 THEN 'gif' WHEN 3 THEN 'bmp' WHEN 4 THEN 'jp2' END AS kind FROM events""")
def image_kinds(spark, sf_dir):
    heads = ["89504E470D0A1A0A00", "FFD8FFE0", "474946383961", "424D0000", "0000000C6A502020", "255044462D"]
    head = F.get(F.array(*[F.lit(h) for h in heads]), (F.col("event_id") % 6).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", scalars.image_kind(F.unhex(head)).alias("kind"))


@query("""
SELECT o_orderkey, o_orderkey % 3 <> 0 AS same FROM orders""")
def json_equal(spark, sf_dir):
    key = F.col("o_orderkey").cast("string")
    a = F.concat(F.lit('{"a": '), key, F.lit(', "b": [1, 2]}'))
    b = F.concat(F.lit('{ "b":[1,2],"a":'), F.when(F.col("o_orderkey") % 3 == 0, F.lit("-1")).otherwise(key), F.lit("}"))
    return table(spark, sf_dir, "orders").select("o_orderkey", variants.same_json(a, b).alias("same"))


@query("""
SELECT event_id, event_type = 'error' AND event_id % 2 = 0 AS unsigned FROM events WHERE event_type IN ('error', 'view')""")
def unsigned_fields(spark, sf_dir):
    fields = table(spark, sf_dir, "events").where("event_type IN ('error', 'view')")
    kind = F.when(F.col("event_type") == "error", "Sig").otherwise("Tx")
    value = F.when(F.col("event_id") % 2 == 1, F.col("value"))
    return fields.select("event_id", rules.unsigned(kind, value).alias("unsigned"))


@query("""
SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'fr' || o_orderkey WHEN 1 THEN 'any' || o_orderkey ELSE 'de' || o_orderkey END AS title FROM orders""")
def localized_texts(spark, sf_dir):
    key, kind = F.col("o_orderkey").cast("string"), F.col("o_orderkey") % 3
    item = lambda lang, value: F.struct(F.lit(lang).cast("string").alias("lang"), F.concat(F.lit(value), key).alias("value"))
    items = F.when(kind == 0, F.array(item("de", "de"), item("fr", "fr"))).when(kind == 1, F.array(item("de", "de"), item(None, "any"))).otherwise(F.array(item("de", "de"), item("en", "en")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", items.alias("items"))
    return rows.select("o_orderkey", scalars.localized("items", "fr").alias("title"))
