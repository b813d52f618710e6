"""The languoid catalogue: a directory tree with one small INI file per node.

Reading many small files is slow on any cluster, so the tree is read once,
parsed in the JVM and written as Parquet; queries run on the Parquet table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.functions import ini as I
from lacuna.functions import intervals, refs

RECORD_FILE = "md.ini"
TREE_DIR = "tree"


def scan_records(spark: SparkSession, root: str) -> DataFrame:
    """(path, text) of every record file below ``root``."""
    return (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", RECORD_FILE)
        .text(root, wholetext=True)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    )


def lineage_of_path(path: Column) -> Column:
    """Ids from the root to the node, taken from the directories of the path."""
    inner = F.regexp_extract(path, rf"(?:^|/){TREE_DIR}/(.*)/{RECORD_FILE}$", 1)
    return F.split(inner, "/")


def with_lineage(df: DataFrame, lineage: Column | str = "lineage") -> DataFrame:
    """Add id, parent, root and depth, all from the lineage array."""
    line = F.col(lineage) if isinstance(lineage, str) else lineage
    if not isinstance(lineage, str):
        df = df.withColumn("lineage", line)
    line = F.col("lineage")
    return df.withColumns(
        {
            "languoid_id": F.element_at(line, -1),
            "parent_id": F.when(F.size(line) > 1, F.element_at(line, -2)),
            "top_id": line[0],
            "depth": F.size(line),
        }
    )


def _all_values(ini: Column, section: str) -> Column:
    """Values of every key of a section, in one array; NULL without the section."""
    entries = F.map_values(F.try_element_at(ini, F.lit(section)))
    return F.flatten(F.transform(entries, I.entry_list))


def _split_ids(entry: Column) -> Column:
    values = F.transform(
        I.entry_list(entry),
        lambda v: F.when(v.contains("://"), F.array(v)).otherwise(F.split(v, ";")),
    )
    trimmed = F.transform(F.flatten(values), lambda v: F.btrim(v))
    return F.filter(trimmed, lambda v: v != "")


def _text(ini: Column, section: str, key: str) -> Column:
    return I.ini_text(ini, section, key)


def _items(ini: Column, section: str, key: str) -> Column:
    return I.ini_list(ini, section, key)


def _section(ini: Column, section_name: str, /, **fields: Column) -> Column:
    """A struct, NULL for records without the section."""
    present = F.try_element_at(ini, F.lit(section_name)).isNotNull()
    return F.when(present, F.struct(*[c.alias(k) for k, c in fields.items()]))


def _classification(ini: Column) -> Column:
    name = "classification"
    return _section(
        ini, name,
        sub=_text(ini, name, "sub"),
        family=_text(ini, name, "family"),
        subrefs=refs.ref_list(_items(ini, name, "subrefs")),
        familyrefs=refs.ref_list(_items(ini, name, "familyrefs")),
    )


def _endangerment(ini: Column) -> Column:
    name = "endangerment"
    return _section(
        ini, name,
        status=_text(ini, name, "status"),
        source=_text(ini, name, "source"),
        date=_text(ini, name, "date").try_cast("timestamp_ntz"),
        comment=_text(ini, name, "comment"),
    )


def _retirement(ini: Column) -> Column:
    name = "iso_retirement"
    return _section(
        ini, name,
        code=_text(ini, name, "code"),
        name=_text(ini, name, "name"),
        effective=_text(ini, name, "effective").try_cast("date"),
        reason=_text(ini, name, "reason"),
        change_to=_items(ini, name, "change_to"),
        change_request=_text(ini, name, "change_request"),
        remedy=_text(ini, name, "remedy"),
        comment=_text(ini, name, "comment"),
    )


def _listing_comment(ini: Column) -> Column:
    name = "hh_ethnologue_comment"
    return _section(
        ini, name,
        comment=_text(ini, name, "comment"),
        comment_type=_text(ini, name, "comment_type"),
        ethnologue_versions=refs.version_list(_text(ini, name, "ethnologue_versions")),
        isohid=_text(ini, name, "isohid"),
    )


def _map_of(ini: Column, section: str, values: Callable[[Column], Column]) -> Column:
    return F.transform_values(F.try_element_at(ini, F.lit(section)), lambda _, v: values(v))


# How each column of a record is made from the parsed INI map.
RECORD_COLUMNS: dict[str, Callable[[Column], Column]] = {
    "name": lambda ini: _text(ini, "core", "name"),
    "level": lambda ini: _text(ini, "core", "level"),
    "macroareas": lambda ini: _items(ini, "core", "macroareas"),
    "countries": lambda ini: _items(ini, "core", "countries"),
    "latitude": lambda ini: _text(ini, "core", "latitude").try_cast("double"),
    "longitude": lambda ini: _text(ini, "core", "longitude").try_cast("double"),
    "hid": lambda ini: _text(ini, "core", "hid"),
    "iso639_3": lambda ini: _text(ini, "core", "iso639-3"),
    "timespan": lambda ini: intervals.timespan(_text(ini, "core", "timespan")),
    "name_comment": lambda ini: _text(ini, "core", "name_comment"),
    "name_pronunciation": lambda ini: _text(ini, "core", "name_pronunciation"),
    "links": lambda ini: F.transform(_items(ini, "core", "links"), refs.link_struct),
    "altnames": lambda ini: _map_of(ini, "altnames", I.entry_list),
    "identifier": lambda ini: _map_of(ini, "identifier", _split_ids),
    "sources": lambda ini: refs.ref_list(_all_values(ini, "sources")),
    "classification": _classification,
    "triggers": lambda ini: refs.triggers(_all_values(ini, "triggers")),
    "endangerment": _endangerment,
    "iso_retirement": _retirement,
    "hh_ethnologue_comment": _listing_comment,
}


def _section_of(column: str) -> str:
    """Columns are named after their section; the others stand in the core."""
    sections = ("altnames", "identifier", "sources", "classification", "triggers", "endangerment", "iso_retirement", "hh_ethnologue_comment")
    return column if column in sections else "core"


def parse_records(records: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """(path, text) to typed records, with all columns or only the named ones.

    No shuffle: each record is parsed where it is read, and of its text the sections
    of the wanted columns only. The columns come out of a
    generator, so filters on them act on finished values; through a plain
    projection Spark would push them down and parse the text once more for
    each filter.
    """
    lineage = lineage_of_path(F.col("path")).alias("lineage")
    wanted = columns or list(RECORD_COLUMNS)
    sections = sorted({_section_of(c) for c in wanted})
    parsed = records.select(lineage, I.parse_ini(F.col("text"), sections).alias("ini"))
    ini = F.col("ini")
    typed = F.struct(*[RECORD_COLUMNS[c](ini).alias(c) for c in wanted])
    return with_lineage(parsed.select("lineage", F.inline_outer(F.array(typed))))


def lineages(records: DataFrame) -> DataFrame:
    """Ids and places of (path, text) from the paths alone; no text is read or parsed."""
    return with_lineage(records.select(lineage_of_path(F.col("path")).alias("lineage")))


def write_catalog(records: DataFrame, out: str) -> None:
    """Parquet, one directory per level, rows clustered by their place in the tree.

    Sorting by the joined lineage keeps a subtree in neighbouring row groups,
    so ``lineage_path`` range filters skip the rest. ``rebalance`` splits a root
    that holds a large share of all records and needs no sampling pass, which
    would read every small file twice.
    """
    (
        records.withColumn("lineage_path", F.concat_ws("/", "lineage"))
        .hint("rebalance", "top_id")
        .sortWithinPartitions("lineage_path")
        .write.mode("overwrite")
        .partitionBy("level")
        .parquet(out)
    )


def read_catalog(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(out)


def compile_catalog(spark: SparkSession, root: str, out: str) -> DataFrame:
    """Read the small files once, write the table, return the table."""
    write_catalog(parse_records(scan_records(spark, root)), out)
    return read_catalog(spark, out)
