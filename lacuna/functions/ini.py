"""INI text to a nested map, without leaving the JVM.

Rules: a line starting with ``#`` or ``;`` is a comment; ``[x]`` opens a
section; the first ``=`` splits key and value; indented lines continue the
key above. Values are taken literally (no ``%`` interpolation). A key or
section that occurs twice keeps its first occurrence.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANKS = " \t\r"


def _trim(c: Column) -> Column:
    return F.btrim(c, F.lit(_BLANKS))


def _let(value: Column, body) -> Column:
    """Bind ``value`` once for use inside ``body``."""
    return F.transform(F.array(value), body)[0]


def _first_wins_map(entries: Column) -> Column:
    """Map of (key, value) structs; the first of equal keys stays.

    Entries are bound once: they hold the whole parse, and every further mention
    would run it again.
    """

    def distinct(es: Column) -> Column:
        return _let(
            F.transform(es, lambda e: e["key"]),
            lambda keys: F.filter(es, lambda e, i: F.array_position(keys, e["key"]) == i + 1),
        )

    return F.map_from_entries(_let(entries, distinct))


def _entry(item: Column) -> Column:
    def fields(lines: Column) -> Column:
        rest = F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1)))
        return F.struct(
            _trim(F.substring_index(item, "=", 1)).alias("key"),
            F.struct(
                lines[0].alias("inline"),
                F.filter(rest, lambda x: x != "").alias("lines"),
            ).alias("value"),
        )

    after = F.substr(item, F.instr(item, F.lit("=")) + 1)
    return _let(F.transform(F.split(after, "\n"), _trim), fields)


def _title(chunk: Column) -> Column:
    return F.substring_index(chunk, "]", 1)


def _section(chunk: Column) -> Column:
    title = _title(chunk)
    body = F.substr(chunk, F.length(title) + 2)
    items = F.filter(F.split(body, r"\n(?=\S)"), lambda i: i.contains("="))
    return F.struct(
        _trim(title).alias("key"),
        _first_wins_map(F.transform(items, _entry)).alias("value"),
    )


def parse_ini(text: Column, sections: Sequence[str] | None = None) -> Column:
    """MAP<section, MAP<key, STRUCT<inline STRING, lines ARRAY<STRING>>>>; with ``sections`` no others are taken apart."""
    clean = F.regexp_replace(text, "\r\n?", "\n")
    clean = F.regexp_replace(clean, r"(?m)^[#;].*$", "")
    # What stands before the first section belongs to none.
    chunks = F.split(F.regexp_replace(F.concat(F.lit("\n"), clean), r"^(?s).*?(?:\n\[|$)", ""), r"\n\[")

    def wanted(chunk: Column) -> Column:
        return chunk != "" if sections is None else (chunk != "") & _trim(_title(chunk)).isin(list(sections))

    return _first_wins_map(F.transform(F.filter(chunks, wanted), _section))


def ini_entry(ini: Column, section: str, key: str) -> Column:
    return F.try_element_at(F.try_element_at(ini, F.lit(section)), F.lit(key))


def entry_text(entry: Column) -> Column:
    """One text: the inline value and its continuation lines. NULL if absent or empty."""
    joined = F.concat_ws(" ", F.concat(F.array(entry["inline"]), entry["lines"]))
    return F.when(entry.isNotNull(), F.nullif(F.btrim(joined), F.lit("")))


def entry_list(entry: Column) -> Column:
    """All values. NULL if the key is absent, an empty array if it is empty."""
    values = F.concat(F.array(entry["inline"]), entry["lines"])
    return F.when(entry.isNotNull(), F.filter(values, lambda v: v != ""))


def ini_text(ini: Column, section: str, key: str) -> Column:
    return entry_text(ini_entry(ini, section, key))


def ini_list(ini: Column, section: str, key: str) -> Column:
    return entry_list(ini_entry(ini, section, key))
