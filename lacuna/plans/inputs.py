"""Catalogue and matrix inputs made from the driver tables.

The catalogue stands in as region > nation > customer > order, with suppliers as
further roots. Every record is written as INI text, as it would lie in a file, so
that the queries go through the same parser. Regions have no record file.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.eval import GoldItem, Split
from lacuna.functions.hashing import uniform
from lacuna.functions.status import GRADE_ORDER
from lacuna.kb import KnowledgeBase
from lacuna.sources.catalog import parse_records

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_FEW, _MANY = 1_000, 50_000
"""Records of a task: enough of them to begin with, and the most."""


def spread(rows: DataFrame, key: str, n_rows: int) -> DataFrame:
    """Rows dealt by key to tasks, before their texts are made and parsed.

    A row group is read by one task however many rows it has, and joins of narrow rows are merged to few tasks by their
    bytes; but a record's text costs far more than its bytes.
    """
    tasks = max(16 * rows.sparkSession.sparkContext.defaultParallelism, math.ceil(n_rows / _MANY))
    return rows.repartition(max(1, min(tasks, math.ceil(n_rows / _FEW))), key)


def _literal(text: str) -> str:
    escaped = text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\t", "\\t")
    return f"'{escaped}'"


def fill_in(template: str) -> str:
    """SQL that concatenates a template's text with its ``<<expressions>>``."""
    pieces = re.split(r"<<(.*?)>>", template, flags=re.S)
    parts = [_literal(x) if n % 2 == 0 else f"string({x})" for n, x in enumerate(pieces) if x]
    return f"concat({', '.join(parts)})"


def _year(y: str) -> str:
    return f"concat(if({y} < 0, '-', ''), lpad(abs({y}), 4, '0'))"


SPAN_START = "int({k} * 37 % 3000 - 1000)"
SPAN_END = "int({k} * 37 % 3000 - 1000 + {k} % 11)"
LATITUDE = "({k} * 7919 % 170001) / 1000 - 85"
LONGITUDE = "({k} * 104729 % 360001) / 1000 - 180"


def _span(k: str) -> str:
    start, end = _year(SPAN_START.format(k=k)), _year(SPAN_END.format(k=k))
    return f"concat({start}, '-01-01/', {end}, '-01-01')"


# Every customer has all the sections that its row gives rise to.
_CUSTOMER = f"""# -*- coding: utf-8 -*-
[core]
name = <<c_name>>
level = language
iso639-3 = i<<c_custkey>>
hid = NOCODE_<<c_custkey>>
latitude = <<{LATITUDE.format(k='c_custkey')}>>
longitude = <<{LONGITUDE.format(k='c_custkey')}>>
macroareas =
\t<<r_name>>
countries = <<if(c_mktsegment = 'BUILDING', '', concat('\\n\\t', n_name))>><<if(c_mktsegment <> 'BUILDING' and c_acctbal < 0, '\\n\\tZZ', '')>>
links =
\thttps://example.org/c/<<c_custkey>>?q=%20a
\t[<<c_name>>](https://h<<c_custkey % 7>>.example.net/<<c_custkey>>)
timespan = <<{_span('c_custkey')}>>

[sources]
main =
\t**hh:src<<c_custkey % 50>>:Key<<c_custkey>>**
\t**pr:b<<c_custkey>>**:12-34

[altnames]
alpha =
\t<<c_name>> [en]
\tAlt <<c_custkey>>
\t<<c_name>> [en]
beta (1987) =
\t<<c_name>>

[identifier]
alpha = a<<c_custkey>>;b<<c_custkey % 1000>>
web = https://example.org/%C3%A9%20<<c_custkey>>

[classification]
family = Linked to <<n_name>>
\tby **pr:b<<c_custkey>>**, as is said.
sub = **hh:src<<c_custkey % 50>>:Key<<c_custkey>>**:46-48, after **pr:b<<c_custkey>>**.
subrefs =
\t**hh:src<<c_custkey % 50>>:Key<<c_custkey>>**<<if(c_mktsegment = 'MACHINERY', '', concat('\\n\\t**pr:b', c_custkey, '**'))>>

[endangerment]
status = <<case when c_acctbal < 0 then 'extinct' when c_mktsegment = 'AUTOMOBILE' then 'not endangered'
  when c_mktsegment = 'BUILDING' then 'threatened' when c_mktsegment = 'FURNITURE' then 'shifting'
  when c_mktsegment = 'HOUSEHOLD' then 'moribund' else 'nearly extinct' end>>
source = E28
date = 2020-<<lpad(c_custkey % 12 + 1, 2, '0')>>-<<lpad(c_custkey % 28 + 1, 2, '0')>>T<<lpad(c_custkey % 24, 2, '0')>>:00:00
comment = <<c_name>> (c<<c_custkey>>-x) = <<split('{",".join(GRADE_ORDER)}', ',')[int(c_custkey % 13)]>><<if(c_custkey % 2 = 0, '*', '')>> (<<initcap(c_mktsegment)>>).
"""
_RETIREMENT = """
[iso_retirement]
remedy = <<case c_custkey % 3 when 0 then 'No successor' when 1 then 'Merge into [abc]' else 'Split into [abc] and [def]' end>>
code = i<<c_custkey>>
name = <<c_name>>
effective = 2017-<<lpad(c_custkey % 12 + 1, 2, '0')>>-<<lpad(c_custkey % 28 + 1, 2, '0')>>
reason = <<case c_custkey % 3 when 0 then 'non-existent' when 1 then 'merge' else 'split' end>>
change_to = <<if(c_custkey % 3 = 2, concat('\\n\\ti', c_custkey + 2), '')>><<if(c_custkey % 3 > 0, concat('\\n\\ti', c_custkey + 1), '')>>
"""
_COMMENT = """
[hh_ethnologue_comment]
comment = <<c_name>> is missing
comment_type = <<if(c_custkey % 3 = 0, 'Spurious', 'Missing')>>
ethnologue_versions = <<if(c_custkey % 2 = 0, 'E16/E17/E18', 'E20')>>
isohid = NOCODE_<<c_custkey>>
"""


def customer_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text) of customers, as languages under their nation."""
    nations = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    text = (
        f"concat({fill_in(_CUSTOMER)}, if(c_acctbal < 0, {fill_in(_RETIREMENT)}, ''), "
        f"if(c_mktsegment = 'FURNITURE', {fill_in(_COMMENT)}, '')) AS text"
    )
    path = fill_in("file:/data/tree/r<<r_regionkey>>/n<<n_nationkey>>/c<<c_custkey>>/md.ini")
    c = table(spark, sf_dir, "customer")
    placed = c.join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return spread(placed, "c_custkey", c.count()).selectExpr(f"{path} AS path", text)


def nation_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations, as families. Each has the words of one part name as a trigger."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    core = fill_in("# -*- coding: utf-8 -*-\n[core]\nname = <<n_name>>\nlevel = family\n")
    trigger = fill_in("\n[triggers]\nlgcode =\n\t<<replace(p_name, ' ', ' AND ')>>\n")
    path = fill_in("file:/data/tree/r<<n_regionkey>>/n<<n_nationkey>>/md.ini")
    return (
        table(spark, sf_dir, "nation")
        .join(p, F.col("n_nationkey") == F.col("p_partkey"), "left")
        .selectExpr(f"{path} AS path", f"concat({core}, coalesce({trigger}, '')) AS text")
    )


def order_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders, as dialects of their customer; pending ones claim to be languages."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    text = fill_in(
        "# -*- coding: utf-8 -*-\n[core]\nname = Order <<o_orderkey>>\n"
        "level = <<if(o_orderstatus = 'P', 'language', 'dialect')>>\n"
    )
    path = fill_in("file:/data/tree/r<<n_regionkey>>/n<<n_nationkey>>/c<<c_custkey>>/o<<o_orderkey>>/md.ini")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    placed = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(
        n, F.col("c_nationkey") == F.col("n_nationkey")
    )
    return spread(placed, "o_orderkey", o.count()).selectExpr(f"{path} AS path", f"{text} AS text")


def supplier_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers, as roots: families if in debt, dialects if rich, else languages."""
    k = "(s_suppkey * 31)"
    text = fill_in(
        "# -*- coding: utf-8 -*-\n[core]\n"
        "level = <<case when s_acctbal < 0 then 'family' when s_acctbal > 9000 then 'dialect' else 'language' end>>\n"
        f"name = <<s_name>>\nlongitude = <<{LONGITUDE.format(k=k)}>>\nlatitude = <<{LATITUDE.format(k=k)}>>\n"
        f"timespan = <<{_span('s_suppkey')}>>\n"
    )
    path = fill_in("file:/data/tree/s<<s_suppkey>>/md.ini")
    s = table(spark, sf_dir, "supplier")
    return spread(s, "s_suppkey", s.count()).selectExpr(f"{path} AS path", f"{text} AS text")


def customers(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return parse_records(customer_texts(spark, sf_dir), columns)


def suppliers(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return parse_records(supplier_texts(spark, sf_dir), columns)


def catalog_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text) of all records of the stand-in catalogue."""
    texts = nation_texts(spark, sf_dir)
    for part in (customer_texts, order_texts, supplier_texts):
        texts = texts.unionByName(part(spark, sf_dir))
    return texts


def catalog(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """All records of the stand-in catalogue."""
    return parse_records(catalog_texts(spark, sf_dir), columns)


def knowledge_base(spark: SparkSession, sf_dir: str) -> KnowledgeBase:
    """Vectors as entities, positions as features, the sign as the binary value."""
    return KnowledgeBase.from_vectors(
        table(spark, sf_dir, "embeddings"), "vec_id", "embedding", threshold=0.0
    )


def parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Training cells, held-out targets, and the gold rows of the targets."""
    cells = knowledge_base(spark, sf_dir).cells
    split = Split()
    test = split.test(cells)
    return split.train(cells), test.select("entity_id", "feature"), GoldItem.of_cells(test)


def vector_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Family and area of the vectors: their label, and the label's parity."""
    label = F.col("label")
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("entity_id"),
        F.concat(F.lit("family "), label.cast("string")).alias("family"),
        F.when(label % 3 == 0, "north").when(label % 3 == 1, "south").alias("area"),
    )


def vector_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue facts of the vectors, as prompts use them."""
    return vector_groups(spark, sf_dir).select(
        "entity_id", "family",
        F.concat(F.lit("Vector "), F.col("entity_id").cast("string")).alias("name"),
        F.concat_ws(" > ", "family", F.concat(F.lit("vector "), F.col("entity_id").cast("string"))).alias("lineage_text"),
        "area",
        F.lit(None).cast("string").alias("place"),
    )


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a label: gold is the quality, the score a repeatable draw."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    labels = table(spark, sf_dir, "labels")
    score = uniform([F.col("doc_id")])
    return docs.join(labels, "doc_id").select(
        F.col("doc_id").alias("entity_id"), "lang", "source", "n_chars", "quality", "toxic",
        F.col("quality").alias("gold"),
        score.alias("score"),
        (score >= 0.5).cast("int").alias("pred"),
    )
