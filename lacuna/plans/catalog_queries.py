"""Queries over the catalogue operators."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.checkpoints import cut_lineage
from lacuna.functions import geo, refs
from lacuna.functions.citation import citation_title
from lacuna.functions.status import comment_clauses
from lacuna.operators import geo as places
from lacuna.operators import levels, records, retirement, status, timespans, tree
from lacuna.plans.inputs import LATITUDE, LONGITUDE, catalog, catalog_texts, customers, nation_texts, suppliers, table
from lacuna.plans.registry import query
from lacuna.sources import index_pages, lookups
from lacuna.sources.catalog import lineages, parse_records

# SQL views of the stand-in catalogue, computed from the tables without any text.
CUST = """cust AS (
  SELECT c.*, n_name, r_name, 'c' || c_custkey AS id, 'n' || n_nationkey AS nid, 'r' || r_regionkey AS rid,
    CASE WHEN c_acctbal < 0 THEN 'extinct' WHEN c_mktsegment = 'AUTOMOBILE' THEN 'not endangered'
      WHEN c_mktsegment = 'BUILDING' THEN 'threatened' WHEN c_mktsegment = 'FURNITURE' THEN 'shifting'
      WHEN c_mktsegment = 'HOUSEHOLD' THEN 'moribund' ELSE 'nearly extinct' END AS status,
    CAST(c_custkey * 37 % 3000 - 1000 AS INTEGER) AS y0,
    CAST(c_custkey * 37 % 3000 - 1000 + c_custkey % 11 AS INTEGER) AS y1,
    (c_custkey * 7919 % 170001) / 1000.0::DOUBLE - 85 AS lat,
    (c_custkey * 104729 % 360001) / 1000.0::DOUBLE - 180 AS lon,
    ['0','1','2','3','4','5','6a','6b','7','8a','8b','9','10'][c_custkey % 13 + 1] AS grade,
    CAST(c_custkey % 13 AS INTEGER) AS grade_pos,
    CAST(c_custkey % 3 AS INTEGER) AS n_targets
  FROM customer c JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
SUPP = """supp AS (
  SELECT *, 's' || s_suppkey AS id,
    CASE WHEN s_acctbal < 0 THEN 'family' WHEN s_acctbal > 9000 THEN 'dialect' ELSE 'language' END AS level,
    (s_suppkey * 31 * 7919 % 170001) / 1000.0::DOUBLE - 85 AS lat,
    (s_suppkey * 31 * 104729 % 360001) / 1000.0::DOUBLE - 180 AS lon,
    CAST(s_suppkey * 37 % 3000 - 1000 AS INTEGER) AS y0,
    CAST(s_suppkey * 37 % 3000 - 1000 + s_suppkey % 11 AS INTEGER) AS y1
  FROM supplier)"""
ORD = """ord AS (
  SELECT 'o' || o_orderkey AS id, cust.id AS cid, nid, rid, 'Order ' || o_orderkey AS name,
    CASE WHEN o_orderstatus = 'P' THEN 'language' ELSE 'dialect' END AS level
  FROM orders JOIN cust ON o_custkey = c_custkey)"""
NODES = f"""{CUST}, {SUPP}, {ORD}, rec AS (
  SELECT 'n' || n_nationkey AS id, n_name AS name, 'family' AS level,
    ['r' || n_regionkey, 'n' || n_nationkey] AS lineage FROM nation
  UNION ALL SELECT id, c_name, 'language', [rid, nid, id] FROM cust
  UNION ALL SELECT id, name, level, [rid, nid, cid, id] FROM ord
  UNION ALL SELECT id, s_name, level, [id] FROM supp)"""
STATUSES = """statuses(status_id, status_ordinal, status, lo, hi) AS (VALUES
  ('safe', 1, 'not endangered', 0, 6), ('vulnerable', 2, 'threatened', 7, 7),
  ('definite', 3, 'shifting', 8, 8), ('severe', 4, 'moribund', 9, 9),
  ('critical', 5, 'nearly extinct', 10, 10), ('extinct', 6, 'extinct', 11, 12))"""
KM = """2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin(radians({b}lat - {a}lat) / 2), 2)
  + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin(radians({b}lon - {a}lon) / 2), 2))))"""


@query(f"""WITH {NODES} SELECT id AS languoid_id, name, level, lineage[-2] AS parent_id,
  lineage[1] AS top_id, CAST(len(lineage) AS INTEGER) AS depth FROM rec""")
def ini_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog(spark, sf_dir, "name", "level").select("languoid_id", "name", "level", "parent_id", "top_id", "depth")


@query(f"""WITH {CUST} SELECT id AS languoid_id, 'NOCODE_' || c_custkey AS hid, 'i' || c_custkey AS iso639_3,
  lat AS latitude, lon AS longitude, y0 AS start_year, y1 AS end_year, status, 'E28' AS source,
  '2020-' || lpad((c_custkey % 12 + 1)::VARCHAR, 2, '0') || '-' || lpad((c_custkey % 28 + 1)::VARCHAR, 2, '0')
    || ' ' || lpad((c_custkey % 24)::VARCHAR, 2, '0') || ':00:00' AS status_date
  FROM cust""")
def typed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers, coordinates, intervals and timestamps of records."""
    return customers(spark, sf_dir, "hid", "iso639_3", "latitude", "longitude", "timespan", "endangerment").select(
        "languoid_id", "hid", "iso639_3", "latitude", "longitude",
        "timespan.start_year", "timespan.end_year", "endangerment.status", "endangerment.source",
        F.col("endangerment.date").cast("string").alias("status_date"),
    )


@query(f"""WITH {CUST} SELECT id AS languoid_id,
  'Linked to ' || n_name || ' by **pr:b' || c_custkey || '**, as is said.' AS family_text FROM cust""")
def text_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customers(spark, sf_dir, "classification").select(
        "languoid_id", F.col("classification.family").alias("family_text")
    )


@query(f"""WITH {CUST} SELECT id AS languoid_id, unnest(CASE WHEN c_mktsegment = 'BUILDING' THEN [NULL]
  WHEN c_acctbal < 0 THEN [n_name, 'ZZ'] ELSE [n_name] END) AS country FROM cust""")
def list_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.explode_list(customers(spark, sf_dir, "countries"), "countries", "country", keep_empty=True)


@query("""SELECT c_custkey, 'a' AS id, c_name AS name, 4 AS ord, TRUE AS current FROM customer
  UNION ALL SELECT c_custkey, 'b', 'second', 9, FALSE FROM customer
  UNION ALL SELECT c_custkey, 'c', NULL, 9, TRUE FROM customer""")
def default_inherit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A config text per customer whose sections inherit from ``[DEFAULT]``."""
    text = F.concat(
        F.lit("[DEFAULT]\ncurrent = True\nord = 9\nname = \n\n[a]\nord = 4\nname = "), "c_name",
        F.lit("\n\n[b]\nname = second\ncurrent = False\n\n[c]\n"),
    )
    configs = table(spark, sf_dir, "customer").select("c_custkey", text.alias("text"))
    schema = {"name": "string", "ord": "int", "current": "boolean"}
    return lookups.parse_lookup(configs, schema)


@query(f"""WITH {CUST} SELECT id AS languoid_id, 'alpha' AS provider, c_name AS name, 'en' AS lang FROM cust
  UNION ALL SELECT id, 'alpha', 'Alt ' || c_custkey, NULL FROM cust
  UNION ALL SELECT id, 'beta (1987)', c_name, NULL FROM cust""")
def altname_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.altnames(customers(spark, sf_dir, "altnames"))


@query(f"""WITH {CUST} SELECT id AS languoid_id, c_name AS name FROM cust
  UNION ALL SELECT id, 'Alt ' || c_custkey FROM cust""")
def altname_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.distinct_names(customers(spark, sf_dir, "altnames"))


@query(f"""WITH {CUST} SELECT 'en' AS lang, count(*) AS n_names FROM cust
  UNION ALL SELECT NULL, 2 * count(*) FROM cust""")
def lang_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.altnames(customers(spark, sf_dir, "altnames")).groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_names")
    )


@query(f"""WITH {CUST} SELECT id AS languoid_id, NULL AS label, 'https://example.org/c/' || c_custkey || '?q=%20a' AS url,
    'example.org' AS host FROM cust
  UNION ALL SELECT id, c_name, 'https://h' || c_custkey % 7 || '.example.net/' || c_custkey,
    'h' || c_custkey % 7 || '.example.net' FROM cust""")
def link_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.links(customers(spark, sf_dir, "links"))


@query("""SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host FROM pages""")
def link_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", refs.link_struct(F.col("url"))["host"].alias("host"))


@query(f"""WITH {CUST} SELECT id AS languoid_id, 'hh' AS provider, 'src' || c_custkey % 50 || ':Key' || c_custkey AS key,
    NULL AS pages FROM cust
  UNION ALL SELECT id, 'pr', 'b' || c_custkey, '12-34' FROM cust""")
def ref_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.sources(customers(spark, sf_dir, "sources"))


@query(f"""WITH {CUST} SELECT id AS languoid_id, 'hh' AS provider, 'src' || c_custkey % 50 || ':Key' || c_custkey AS key,
    '46-48' AS pages FROM cust
  UNION ALL SELECT id, 'pr', 'b' || c_custkey, NULL FROM cust""")
def inline_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.prose_refs(customers(spark, sf_dir, "classification"))


@query(f"""WITH {CUST} SELECT id AS languoid_id, 'pr:b' || c_custkey AS only_prose, '' AS only_list
  FROM cust WHERE c_mktsegment = 'MACHINERY'""")
def derived_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.ref_differences(customers(spark, sf_dir, "classification")).select(
        "languoid_id",
        F.array_join("only_prose", ",").alias("only_prose"),
        F.array_join("only_list", ",").alias("only_list"),
    )


@query("""SELECT page_id, url_decode(url) AS decoded, url_decode(url_encode(html)) = html AS intact,
  url_decode(url || '+x%20' || url_encode(substr(html, 1, 40)) || '%2B') AS plus FROM pages""")
def percent_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select(
        "page_id",
        refs.percent_decode(F.col("url")).alias("decoded"),
        (refs.percent_decode(F.replace(F.url_encode("html"), F.lit("+"), F.lit("%20"))) == F.col("html")).alias("intact"),
        refs.percent_decode(
            F.concat("url", F.lit("+x%20"), F.replace(F.url_encode(F.substring("html", 1, 40)), F.lit("+"), F.lit("%20")), F.lit("%2B"))
        ).alias("plus"),
    )


@query("""SELECT p.p_partkey, 'n' || n_nationkey AS languoid_id FROM nation JOIN part t ON t.p_partkey = n_nationkey
  JOIN part p ON list_has_all(string_split(p.p_name, ' '), string_split(t.p_name, ' '))""")
def trigger_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("title"))
    triggers = parse_records(nation_texts(spark, sf_dir), ("triggers",)).where("triggers IS NOT NULL")
    return records.trigger_hits(titles, triggers.select("languoid_id", "triggers").persist(), "p_partkey")


def _given_triggers(rows: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """Triggers made of words of a text; ``pattern`` has {0}, {1} ... for the words."""
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    parts = re.split(r"\{(\d)\}", pattern)
    line = F.concat(*[words[int(x)] if n % 2 else F.lit(x) for n, x in enumerate(parts)])
    made = rows.select(F.col(key).cast("string").alias("languoid_id"), F.array(line).alias("lines"))
    return made.select("languoid_id", refs.triggers(F.col("lines")).alias("triggers")).where("triggers[0][0] IS NOT NULL")


@query("""WITH t AS (SELECT n_nationkey AS id, string_split(p_name, ' ') AS w FROM nation JOIN part ON p_partkey = n_nationkey)
  SELECT p.p_partkey, t.id::VARCHAR AS languoid_id FROM t JOIN part p ON list_contains(string_split(p.p_name, ' '), t.w[1])
  AND NOT list_contains(string_split(p.p_name, ' '), t.w[2])""")
def trigger_match_negated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triggers that exclude a word, over part names."""
    titles = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("title"))
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("n_nationkey"))
    triggers = _given_triggers(nations, "n_nationkey", "p_name", "{0} and NOT {1}")
    return records.trigger_hits(titles, triggers, "p_partkey")


@query(r"""WITH b AS (SELECT item_id, regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+') AS w FROM benchmark),
  d AS (SELECT doc_id, regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+') AS w FROM documents)
  SELECT doc_id, item_id::VARCHAR AS languoid_id FROM b JOIN d ON list_contains(d.w, b.w[3]) AND list_contains(d.w, b.w[5])
  AND NOT list_contains(d.w, b.w[8])""")
def trigger_match_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triggers of benchmark words, one of them excluded, over whole texts."""
    titles = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("title"))
    triggers = _given_triggers(table(spark, sf_dir, "benchmark"), "item_id", "text", "{2} AND {4} AND not {7}")
    return records.trigger_hits(titles, triggers, "doc_id")


@query(f"""WITH {CUST} SELECT id AS languoid_id, y0 AS start_year, y1 AS end_year, y1 - y0 + 1 AS years FROM cust""")
def timespan_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("timespan")
    return customers(spark, sf_dir, "timespan").select(
        "languoid_id", "timespan.start_year", "timespan.end_year",
        (t["end_year"] - t["start_year"] + 1).alias("years"),
    )


# Inputs that an operator reads more than once are stored first, so that their
# texts are parsed once; a compiled catalogue makes this needless.


def _spans(df: DataFrame) -> DataFrame:
    return df.select(F.col("languoid_id").alias("id"), "timespan.start_year", "timespan.end_year")


@query(f"""WITH {CUST}, {SUPP} SELECT s.y0 AS left_start, s.y1 AS left_end, c.y0 AS right_start, c.y1 AS right_end,
  count(*) AS n_pairs FROM supp s JOIN cust c ON s.y0 <= c.y1 AND c.y0 <= s.y1 GROUP BY 1, 2, 3, 4""")
def timespan_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping spans of suppliers and customers."""
    return timespans.overlap_spans(
        _spans(suppliers(spark, sf_dir, "timespan")), _spans(customers(spark, sf_dir, "timespan"))
    )


@query(f"""WITH {CUST}, n AS (SELECT y0, y1, count(*) AS n FROM cust GROUP BY y0, y1)
  SELECT a.id, a.y0 AS start_year, a.y1 AS end_year, CAST(sum(n.n) AS BIGINT) AS n_overlaps
  FROM cust a JOIN n ON a.y0 <= n.y1 AND n.y0 <= a.y1 GROUP BY a.id, a.y0, a.y1""")
def timespan_overlap_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = cut_lineage(spark, _spans(customers(spark, sf_dir, "timespan")))
    return timespans.overlap_counts(spans, spans)


@query(f"WITH {CUST} SELECT id AS languoid_id FROM cust WHERE y0 <= 0 AND 0 <= y1")
def timespan_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timespans.as_of(customers(spark, sf_dir, "timespan"), 0).select("languoid_id")


@query(f"""WITH {NODES}, flat AS (SELECT id, len(lineage) AS d, unnest(lineage) AS a, generate_subscripts(lineage, 1) AS p FROM rec)
  SELECT id AS languoid_id, a AS ancestor_id, CAST(d - p AS INTEGER) AS distance FROM flat""")
def tree_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.closure(lineages(catalog_texts(spark, sf_dir)))


@query(f"""WITH {NODES} SELECT id AS languoid_id FROM rec WHERE list_contains(lineage, 'n3') AND id <> 'n3'""")
def tree_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.descendants(lineages(catalog_texts(spark, sf_dir)), "n3").select("languoid_id")


@query(f"""WITH {NODES}, flat AS (SELECT unnest(lineage) AS a, generate_subscripts(lineage, 1) AS p, len(lineage) AS d FROM rec)
  SELECT a AS languoid_id, CAST(p AS INTEGER) AS depth, bool_or(p = d) AS has_record FROM flat GROUP BY a, p""")
def nodes_from_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.nodes_from_paths(lineages(catalog_texts(spark, sf_dir))).select("languoid_id", "depth", "has_record")


def _order_parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineage of the customer of each order item, and of its supplier's nation."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = F.concat(F.lit("r"), F.col("n_regionkey").cast("string"))
    nid = F.concat(F.lit("n"), F.col("n_nationkey").cast("string"))
    suppliers_at = (
        table(spark, sf_dir, "supplier")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("s_suppkey").alias("l_suppkey"),
            F.array(region, nid, F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))).alias("right"),
        )
    )
    customers_at = (
        table(spark, sf_dir, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("c_custkey").alias("o_custkey"),
            F.array(region, nid, F.concat(F.lit("c"), F.col("c_custkey").cast("string"))).alias("left"),
        )
    )
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    return (
        items.join(orders, "l_orderkey").join(customers_at, "o_custkey").join(suppliers_at, "l_suppkey")
    )


@query("""SELECT CASE WHEN c_nationkey = s_nationkey THEN 'n' || c_nationkey
    WHEN cn.n_regionkey = sn.n_regionkey THEN 'r' || cn.n_regionkey END AS ancestor_id,
  CAST(CASE WHEN c_nationkey = s_nationkey THEN 2 WHEN cn.n_regionkey = sn.n_regionkey THEN 4 ELSE 6 END AS INTEGER) AS distance,
  count(*) AS n_items
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON l_suppkey = s_suppkey JOIN nation cn ON c_nationkey = cn.n_nationkey
  JOIN nation sn ON s_nationkey = sn.n_nationkey GROUP BY 1, 2""")
def lowest_common_ancestor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the customer and the supplier of order items meet in the tree, and how far apart they are."""
    left, right = F.col("left"), F.col("right")
    return (
        _order_parties(spark, sf_dir)
        .groupBy(
            tree.lowest_common_ancestor(left, right).alias("ancestor_id"),
            tree.tree_distance(left, right).alias("distance"),
        )
        .agg(F.count(F.lit(1)).alias("n_items"))
    )


@query(f"""WITH {NODES}
  SELECT id AS languoid_id, level, NULL AS parent_level, 'top-level dialect' AS rule FROM supp WHERE level = 'dialect'
  UNION ALL SELECT id, level, 'language', 'language not under family' FROM ord WHERE level = 'language'""")
def level_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = catalog(spark, sf_dir, "level").select("languoid_id", "parent_id", "level")
    return levels.level_violations(cut_lineage(spark, nodes))


@query(f"""WITH {NODES}, hidden AS (
    SELECT c.id, count(o.id) AS n, count(*) FILTER (WHERE o.level = 'language') AS n_lang
    FROM cust c LEFT JOIN ord o ON o.cid = c.id WHERE c_mktsegment = 'HOUSEHOLD' GROUP BY c.id),
  regions AS (SELECT DISTINCT rid AS id FROM cust UNION SELECT 'r' || n_regionkey FROM nation)
  SELECT id AS languoid_id, CASE WHEN n_lang > 0 THEN 'family' WHEN n > 0 THEN 'language' END AS inferred_level
  FROM hidden WHERE n > 0 UNION ALL SELECT id, 'family' FROM regions""")
def level_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of nodes whose records are withheld: regions, and customers of one segment."""
    withheld = table(spark, sf_dir, "customer").where("c_mktsegment = 'HOUSEHOLD'").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("languoid_id")
    )
    shown = catalog(spark, sf_dir, "level").join(withheld, "languoid_id", "left_anti")
    nodes = cut_lineage(spark, tree.nodes_from_paths(shown, "level"))
    return levels.infer_levels(nodes).where("level IS NULL").select("languoid_id", "inferred_level")


@query(f"WITH {SUPP} SELECT id AS languoid_id FROM supp WHERE level = 'language'")
def isolate_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.isolates(catalog(spark, sf_dir, "level")).select("languoid_id")


@query(f"""WITH {NODES} SELECT lineage[1] AS top_id, count(*) AS n_records,
  count(*) FILTER (WHERE level = 'family') AS n_families, count(*) FILTER (WHERE level = 'language') AS n_languages,
  count(*) FILTER (WHERE level = 'dialect') AS n_dialects, CAST(max(len(lineage)) AS INTEGER) AS max_depth
  FROM rec GROUP BY 1""")
def family_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.family_rollup(catalog(spark, sf_dir, "level"))


@query(f"""WITH {NODES} SELECT lineage[1] AS top_id, count(*) AS n_records FROM rec
  WHERE lineage[1] NOT IN ('r0', 'r4') GROUP BY 1""")
def family_rollup_without_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.family_rollup(tree.exclude_roots(catalog(spark, sf_dir, "level"), ["r0", "r4"])).select(
        "top_id", "n_records"
    )


@query(f"WITH {CUST} SELECT rid AS top_id, r_name AS area, count(*) AS n_languages FROM cust GROUP BY 1, 2")
def family_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.family_areas(customers(spark, sf_dir, "level", "macroareas"))


@query(f"WITH {CUST} SELECT rid AS top_id, status, count(*) AS n_records FROM cust GROUP BY 1, 2")
def family_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.family_statuses(customers(spark, sf_dir, "endangerment"))


@query(f"""WITH {CUST} SELECT 'language' AS level, upper(substr(c_name, 1, 1)) AS initial, c_name AS name, id AS languoid_id,
  '- [' || c_name || ' [' || id || '][i' || c_custkey || ']](tree/' || rid || '/' || nid || '/' || id || '/md.ini)' AS line
  FROM cust""")
def index_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_pages.build_index(customers(spark, sf_dir, "level", "name", "iso639_3"))


_CODE = "translate(lpad({key} % 1000, 3, '0'), '0123456789', 'abcdefghij')"


@query(f"""WITH {CUST} SELECT id AS languoid_id, CASE WHEN c_acctbal < 0 THEN 'missing' WHEN c_mktsegment = 'BUILDING' THEN 'name'
    WHEN c_mktsegment = 'FURNITURE' THEN 'level' ELSE 'code' END AS problem
  FROM cust WHERE c_acctbal < 0 OR c_mktsegment IN ('BUILDING', 'FURNITURE', 'MACHINERY')""")
def index_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of an index of all records, checked against records that have since changed."""
    customer = F.col("languoid_id").startswith("c")
    code = F.when(customer, F.expr(_CODE.format(key="cast(substring(languoid_id, 2) AS bigint)")))
    all_records = cut_lineage(
        spark, catalog(spark, sf_dir, "level", "name").select("languoid_id", "level", "name", "lineage", code.alias("iso639_3"))
    )
    lines = index_pages.build_index(all_records).select("level", F.col("line").alias("value"))
    entries = index_pages.parse_index_lines(lines)
    state = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("languoid_id"), "c_acctbal", F.col("c_mktsegment").alias("segment")
    )
    now = all_records.join(state, "languoid_id", "left").where(~F.coalesce(F.col("c_acctbal") < 0, F.lit(False))).select(
        "languoid_id", "lineage",
        F.when(F.col("segment") == "BUILDING", "New name").otherwise(F.col("name")).alias("name"),
        F.when(F.col("segment") == "FURNITURE", "dialect").otherwise(F.col("level")).alias("level"),
        F.when(~F.coalesce(F.col("segment") == "MACHINERY", F.lit(False)), F.col("iso639_3")).alias("iso639_3"),
    )
    return index_pages.index_problems(entries, now).select("languoid_id", "problem")


@query(f"""WITH {NODES} SELECT level, CAST(CASE level WHEN 'family' THEN 1 WHEN 'language' THEN 2 ELSE 3 END AS INTEGER) AS ordinal,
  count(*) AS n_records FROM rec GROUP BY 1, 2""")
def level_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        catalog(spark, sf_dir, "level")
        .groupBy("level", levels.level_ordinal(F.col("level")).alias("ordinal"))
        .agg(F.count(F.lit(1)).alias("n_records"))
    )


@query(f"""WITH {CUST}, {STATUSES} SELECT status, status_id, CAST(status_ordinal AS INTEGER) AS status_ordinal, count(*) AS n_records
  FROM cust JOIN statuses USING (status) GROUP BY 1, 2, 3""")
def status_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = customers(spark, sf_dir, "endangerment").select("languoid_id", "endangerment.status")
    return (
        status.status_lookup(named, lookups.default_statuses(spark))
        .groupBy("status", "status_id", "status_ordinal")
        .agg(F.count(F.lit(1)).alias("n_records"))
    )


@query(f"""WITH {CUST}, {STATUSES} SELECT cust.id AS languoid_id, cust.status, grade, s.status AS grade_status,
  CAST(s.status_ordinal AS INTEGER) AS grade_ordinal FROM cust LEFT JOIN statuses s ON grade_pos BETWEEN lo AND hi""")
def status_from_egids(spark: SparkSession, sf_dir: str) -> DataFrame:
    graded = records.status_comments(customers(spark, sf_dir, "endangerment")).select("languoid_id", "status", "grade")
    return status.status_from_grade(graded, lookups.default_statuses(spark))


@query(f"""WITH {CUST}, {STATUSES} SELECT cust.id AS languoid_id, cust.status, s.status AS grade_status
  FROM cust JOIN statuses s ON grade_pos BETWEEN lo AND hi WHERE s.status <> cust.status""")
def status_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    graded = records.status_comments(customers(spark, sf_dir, "endangerment")).select("languoid_id", "status", "grade")
    return status.status_disagreements(graded, lookups.default_statuses(spark)).select(
        "languoid_id", "status", "grade_status"
    )


@query("""WITH words(word, name, ordinal) AS (VALUES ('at risk', 'not endangered', 1), ('safe', 'not endangered', 1),
    ('vulnerable', 'threatened', 2), ('threatened', 'shifting', 3), ('endangered', 'shifting', 3),
    ('severely endangered', 'moribund', 4), ('critically endangered', 'nearly extinct', 5),
    ('dormant', 'extinct', 6), ('awakening', 'extinct', 6)),
  said AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'Vulnerable' WHEN 'view' THEN 'At risk'
    WHEN 'error' THEN 'Dormant' WHEN 'purchase' THEN 'Endangered' ELSE 'Unknown' END AS label FROM events)
  SELECT label, name AS label_status, CAST(ordinal AS INTEGER) AS label_ordinal, count(*) AS n_events
  FROM said LEFT JOIN words ON word = lower(label) GROUP BY 1, 2, 3""")
def status_from_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    label = (
        F.when(kind == "click", "Vulnerable").when(kind == "view", "At risk").when(kind == "error", "Dormant")
        .when(kind == "purchase", "Endangered").otherwise("Unknown")
    )
    said = table(spark, sf_dir, "events").select("event_id", label.alias("label"))
    return (
        status.status_from_label(said, lookups.default_statuses(spark), "elcat")
        .groupBy("label", "label_status", "label_ordinal")
        .agg(F.count(F.lit(1)).alias("n_events"))
    )


@query(f"""WITH {CUST} SELECT id AS languoid_id, status, c_name AS name, id || '-x' AS codes, grade,
  grade || CASE WHEN c_custkey % 2 = 0 THEN '*' ELSE '' END AS label,
  upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) AS remark FROM cust""")
def comment_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.status_comments(customers(spark, sf_dir, "endangerment"))


@query("""SELECT 'c' || c_custkey AS id, unnest([c_name, 'Other']) AS name, unnest(['Severely endangered', 'Vulnerable']) AS label
  FROM customer""")
def comment_clauses_of_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A comment that judges two varieties."""
    comment = F.concat(
        "c_name", F.lit(" (1-a) = Severely endangered (20 percent certain) [x](y); Other (2-b, c) = Vulnerable")
    )
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"),
        F.inline(comment_clauses(comment)),
    ).select("id", "name", "label")


_TARGETS = f"""{CUST}, targets AS (
  SELECT id AS languoid_id, 'i' || c_custkey AS code,
    CASE n_targets WHEN 0 THEN 'non-existent' WHEN 1 THEN 'merge' ELSE 'split' END AS reason,
    unnest(CASE n_targets WHEN 0 THEN [NULL] WHEN 1 THEN [0] ELSE [0, 1] END) AS position,
    unnest(CASE n_targets WHEN 0 THEN [NULL] WHEN 1 THEN ['i' || (c_custkey + 1)]
      ELSE ['i' || (c_custkey + 2), 'i' || (c_custkey + 1)] END) AS target
  FROM cust WHERE c_acctbal < 0)"""


@query(f"""WITH {_TARGETS} SELECT t.languoid_id, code, reason, CAST(position AS INTEGER) AS position, target, cust.id AS target_id
  FROM targets t LEFT JOIN cust ON t.target = 'i' || cust.c_custkey""")
def iso_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = customers(spark, sf_dir, "iso639_3", "iso_retirement").select(
        "languoid_id", "iso639_3", "iso_retirement"
    )
    return retirement.resolve_once(cut_lineage(spark, coded)).select(
        "languoid_id", "code", "reason", "position", "target", "target_id"
    )


@query(f"""WITH RECURSIVE {_TARGETS}, walk(code, final, hops, dead) AS (
    SELECT code, target, CASE WHEN target IS NULL THEN 0 ELSE 1 END, target IS NULL FROM targets
    UNION SELECT w.code, coalesce(t.target, w.final), CASE WHEN t.target IS NULL THEN w.hops ELSE w.hops + 1 END, t.target IS NULL
    FROM walk w JOIN targets t ON w.final = t.code WHERE NOT w.dead)
  SELECT DISTINCT code, final, CAST(hops AS INTEGER) AS hops, CASE WHEN dead THEN 'none' ELSE 'current' END AS status
  FROM walk WHERE dead OR NOT EXISTS (SELECT 1 FROM targets t WHERE t.code = walk.final)""")
def iso_resolve_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = retirement.retirement_targets(customers(spark, sf_dir, "iso_retirement"))
    return retirement.resolve_codes(spark, changes).select("code", "final", "hops", "status")


@query(f"""WITH {CUST} SELECT CASE n_targets WHEN 0 THEN 'non-existent' WHEN 1 THEN 'merge' ELSE 'split' END AS reason,
  n_targets, count(*) AS n_records FROM cust WHERE c_acctbal < 0 GROUP BY 1, 2""")
def retirement_arity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retirement.arity_report(customers(spark, sf_dir, "iso_retirement"))


@query(f"""WITH {CUST} SELECT id AS languoid_id, CASE n_targets WHEN 1 THEN 'abc' ELSE 'abc,def' END AS only_remedy,
  CASE n_targets WHEN 1 THEN 'i' || (c_custkey + 1)
    ELSE array_to_string(list_sort(['i' || (c_custkey + 1), 'i' || (c_custkey + 2)]), ',') END AS only_change_to
  FROM cust WHERE c_acctbal < 0 AND n_targets > 0""")
def remedy_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retirement.remedy_differences(customers(spark, sf_dir, "iso_retirement")).select(
        "languoid_id",
        F.array_join("only_remedy", ",").alias("only_remedy"),
        F.array_join("only_change_to", ",").alias("only_change_to"),
    )


@query(f"""WITH {CUST} SELECT id AS languoid_id, unnest(CASE WHEN c_custkey % 2 = 0 THEN ['E16', 'E17', 'E18'] ELSE ['E20'] END) AS version
  FROM cust WHERE c_mktsegment = 'FURNITURE'""")
def versions_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.versions(customers(spark, sf_dir, "hh_ethnologue_comment"))


@query(f"""WITH {CUST}, ids AS (
    SELECT id AS languoid_id, 'alpha' AS scheme, unnest(['a' || c_custkey, 'b' || c_custkey % 1000]) AS identifier FROM cust
    UNION ALL SELECT id, 'web', 'https://example.org/é ' || c_custkey FROM cust
    UNION ALL SELECT id, 'iso639-3', 'i' || c_custkey FROM cust),
  asked AS (SELECT DISTINCT 'alpha' AS scheme, 'b' || o_custkey AS identifier FROM orders
    UNION ALL SELECT DISTINCT 'iso639-3', 'i' || o_custkey FROM orders
    UNION ALL SELECT DISTINCT 'alpha', 'x' || o_custkey FROM orders)
  SELECT scheme, identifier, languoid_id FROM asked LEFT JOIN ids USING (scheme, identifier)""")
def id_crosswalk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes to records; some codes name several records and some none."""
    keys = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("k")).distinct()
    codes = keys.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(s).alias("scheme"), F.concat(F.lit(p), "k").alias("identifier"))
                    for s, p in (("alpha", "b"), ("iso639-3", "i"), ("alpha", "x"))
                ]
            )
        )
    )
    return records.resolve_ids(codes, customers(spark, sf_dir, "identifier", "iso639_3"))


@query(f"""WITH {CUST} SELECT id AS languoid_id, 'alpha' AS scheme, unnest(['a' || c_custkey, 'b' || c_custkey % 1000]) AS identifier FROM cust
  UNION ALL SELECT id, 'web', 'https://example.org/é ' || c_custkey FROM cust""")
def identifier_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.identifiers(customers(spark, sf_dir, "identifier"))


@query("""SELECT p_partkey, p_name || ' database ' || p_size AS title FROM part""")
def citation_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    title_format = F.concat("p_name", F.lit(" database {0}"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", citation_title(title_format, F.col("p_size").cast("string")).alias("title")
    )


@query("""WITH kinds AS (SELECT doc_id, source, CASE WHEN n_chars >= 20000 THEN 0 WHEN n_chars >= 5000 THEN 1
    WHEN n_chars >= 1000 THEN 2 WHEN n_chars >= 200 THEN 3 ELSE 4 END AS rank FROM documents)
  SELECT source, first(doc_id ORDER BY rank, doc_id) AS doc_id, CAST(min(rank) AS INTEGER) AS rank FROM kinds GROUP BY source""")
def best_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    kind = (
        F.when(n >= 20000, "long_grammar").when(n >= 5000, "grammar").when(n >= 1000, "grammar_sketch")
        .when(n >= 200, "phonology_or_text").otherwise("wordlist_or_less")
    )
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", kind.alias("kind"))
    return status.best_document(docs, lookups.default_document_types(spark), "source", "doc_id", "kind")


@query(f"""WITH {CUST}, {SUPP} SELECT l_orderkey, l_linenumber, l_suppkey, round({KM.format(a="c.", b="s.")}, 3) AS distance_km
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN cust c ON o_custkey = c_custkey JOIN supp s ON l_suppkey = s_suppkey""")
def geo_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the customer to the supplier of each order item."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    c = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"),
        F.expr(LATITUDE.format(k="c_custkey")).alias("lat1"),
        F.expr(LONGITUDE.format(k="c_custkey")).alias("lon1"),
    )
    s = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"),
        F.expr(LATITUDE.format(k="(s_suppkey * 31)")).alias("lat2"),
        F.expr(LONGITUDE.format(k="(s_suppkey * 31)")).alias("lon2"),
    )
    km = geo.haversine_km(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    return items.join(orders, "l_orderkey").join(c, "o_custkey").join(s, "l_suppkey").select(
        "l_orderkey", "l_linenumber", "l_suppkey", F.round(km, 3).alias("distance_km")
    )


def _places(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("languoid_id").alias("id"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon")
    )


@query(f"""WITH {CUST}, {SUPP}, ranked AS (
    SELECT c.id, s.id AS neighbour_id, round({KM.format(a="c.", b="s.")}, 6) AS distance_km,
      row_number() OVER (PARTITION BY c.id ORDER BY round({KM.format(a="c.", b="s.")}, 6), s.id) AS rank
    FROM cust c CROSS JOIN supp s)
  SELECT id, CAST(rank AS INTEGER) AS rank, neighbour_id, round(distance_km, 3) AS distance_km FROM ranked WHERE rank <= 3""")
def geo_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three suppliers nearest to each customer."""
    asked, found = (
        cut_lineage(spark, _places(part(spark, sf_dir, "latitude", "longitude")))
        for part in (customers, suppliers)
    )
    return places.nearest_places(asked, found, 3).withColumn("distance_km", F.round("distance_km", 3))
