"""Verdicts on URLs by rules and by path templates.

Each host has a tree of templates, grown level by level. Numbers, hexadecimal names and segments with digits become
classes at once. Children whose share of bad labels does not differ from that of their siblings (two-proportion test, 5 %) become
one branch, however many they are: it is written ``*`` where a node has ``VARIABLE`` children or more and ``~`` where
it has fewer. From the ``DEPTH``-th level on, the tree goes on below nodes whose labels are mixed, as deep as
they are; below the others no child can differ, and the rest of their paths is one, ``**``.

A template's share of bad labels is smoothed towards its host's, and that towards ``PRIOR``; a template is rejected at one half. The labels are the URLs that a rule decides.

Paths are counted once per host, all counts are added up before they are shuffled, and rows look up what they need in
one of several copies of it, so a host, path or template may hold any share of the rows.

Defined cases: a null URL, or one without ``://``, has an empty host and path, and is judged as such
by the tree (allowed where nothing is known). Empty segments are segments. Of rules that fit, the longest wins; of equally
long ones the alphabetically first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.llm.store import Store

VARIABLE = 8
DEPTH = 8
SMOOTHING = 4
PRIOR = 0.1
"""Share of bad URLs expected of a host of which nothing is known."""
DIFFERENT = 3.841
SALTS = 8
NUMBER, HEX, MIXED = r"^[0-9]+$", r"^[0-9a-f]{8,}$", r"[0-9]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Rule = tuple[str, str, str]
"""host, path, verdict"""


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL."""
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def rule_for(host: Column, path: Column, rules: list[Rule]) -> Column:
    """(rule, verdict) of the longest rule that fits, or null."""
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for h, p, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]), reverse=True):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _looked_up(rows: DataFrame, table: DataFrame, keys: list[str], own: list[str]) -> DataFrame:
    """``rows`` joined to ``table`` on ``keys``, spread over copies of it by the columns ``own``."""
    copies = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(*own), F.lit(SALTS)).cast("int"))
    return salted.join(copies, [*keys, "salt"]).drop("salt")


def _shape(segment: Column) -> Column:
    return (
        F.when(segment.rlike(NUMBER), "{n}").when(segment.rlike(HEX), "{h}").when(segment.rlike(MIXED), "{x}")
        .otherwise(segment)
    )


def _branches(state: DataFrame) -> DataFrame:
    """(host, template, segment, branch): what each child of each node becomes."""
    children = state.groupBy("host", "template", "segment").agg(F.sum("bad").alias("bad"), F.sum("labels").alias("labels"))
    nodes = children.groupBy("host", "template").agg(
        F.count("*").alias("children"), F.sum("bad").alias("all_bad"), F.sum("labels").alias("all_labels")
    )
    child = _looked_up(children, nodes, ["host", "template"], ["segment"])
    bad, n = F.col("bad").cast("double"), F.col("labels").cast("double")
    other_bad, other_n = F.col("all_bad") - bad, F.col("all_labels") - n
    pooled = F.try_divide(F.col("all_bad").cast("double"), F.col("all_labels").cast("double"))
    gap = F.try_divide(bad, n) - F.try_divide(other_bad, other_n)
    spread = pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), n) + F.try_divide(F.lit(1.0), other_n))
    differs = (n > 0) & (other_n > 0) & (gap * gap >= F.lit(DIFFERENT) * spread) & (gap * gap > 0)
    alone = (F.col("children") == 1) | F.coalesce(differs, F.lit(False))
    branch = F.when(alone, F.col("segment")).when(F.col("children") >= VARIABLE, "*").otherwise("~")
    return child.select("host", "template", "segment", branch.alias("branch"))


def _without_tails(state: DataFrame, level: int) -> DataFrame:
    """``state`` with the rest of the paths below nodes without mixed labels as one last segment."""
    deeper = F.size("segments") > level
    here = state.where(deeper)
    nodes = here.groupBy("host", "template").agg(F.sum("bad").alias("all_bad"), F.sum("labels").alias("all_labels"))
    nodes = nodes.select("host", "template", ((F.col("all_bad") > 0) & (F.col("all_bad") < F.col("all_labels"))).alias("mixed"))
    known = _looked_up(here, nodes, ["host", "template"], ["path"])
    ended = known.withColumns({
        "template": F.when(F.col("mixed"), F.col("template")).otherwise(F.concat("template", F.lit("/**"))),
        "segments": F.when(F.col("mixed"), F.col("segments")).otherwise(F.slice("segments", 1, level)),
    })
    return ended.select(state.columns).unionByName(state.where(~deeper))


def judge(pages: DataFrame, rules: list[Rule], store: Store) -> DataFrame:
    """page_id, host, path, rule, verdict, template and bad_share of each row of ``pages`` (page_id, url)."""
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("found", rule_for(F.col("host"), F.col("path"), rules))
    labelled = F.col("found").isNotNull().cast("long")
    bad = F.coalesce((F.col("found.verdict") == "block").cast("long"), F.lit(0))
    paths = rows.groupBy("host", "path").agg(F.sum(labelled).alias("labels"), F.sum(bad).alias("bad"))
    segments = F.split(F.col("path"), "/")
    state = paths.select("host", "path", "labels", "bad", F.lit("").alias("template"), segments.alias("segments"))
    state = store.keep(state, "paths")
    # What stands before the first slash is empty.
    level = 1
    while not state.where(F.size("segments") > level).isEmpty():
        if level > DEPTH:
            state = store.keep(_without_tails(state, level), f"mixed-{level}")
        deeper = F.size("segments") > level
        here = state.where(deeper).withColumn("segment", _shape(F.col("segments")[level]))
        keys = ["host", "template", "segment"]
        there = _looked_up(here, _branches(here), keys, ["path"])
        there = there.withColumn("template", F.concat("template", F.lit("/"), "branch")).select(state.columns)
        state = store.keep(there.unionByName(state.where(~deeper)), f"level-{level}")
        level += 1
    templates = state.groupBy("host", "template").agg(F.sum("bad").alias("bad"), F.sum("labels").alias("labels"))
    hosts = templates.groupBy("host").agg(F.sum("bad").alias("host_bad"), F.sum("labels").alias("host_labels"))
    of_host = (F.col("host_bad") + F.lit(SMOOTHING * PRIOR)) / (F.col("host_labels") + SMOOTHING)
    of_template = (F.col("bad") + SMOOTHING * of_host) / (F.col("labels") + SMOOTHING)
    judged = _looked_up(templates, hosts, ["host"], ["template"]).select("host", "template", of_template.alias("bad_share"))
    by_path = _looked_up(state.select("host", "path", "template"), judged, ["host", "template"], ["path"])
    verdict = F.coalesce("found.verdict", F.when(F.col("bad_share") >= 0.5, "block").otherwise("allow"))
    return _looked_up(rows, by_path, ["host", "path"], ["page_id"]).select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), "template", "bad_share"
    )
