"""Endangerment status: grades, labels and comments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The order of the graded intergenerational disruption scale.
GRADE_ORDER = ("0", "1", "2", "3", "4", "5", "6a", "6b", "7", "8a", "8b", "9", "10")

_GRADE = r"^\s*(\d{1,2}[ab]?)\*?\s*\("
_PREDICATE = r"^\s*(<=|>=|=)?\s*(\d{1,2}[ab]?)\s*$"
_CLAUSE = r"^\s*(.*?)\s*\(([^()]*)\)\s*=\s*(.*?)\s*$"
_LABEL = r"^([^(\[]*?)\s*\.?\s*(?:[(\[].*)?$"


def grade_rank(grade: Column) -> Column:
    """Position on the scale, NULL for an unknown grade."""
    ranks = F.create_map(*[F.lit(v) for i, g in enumerate(GRADE_ORDER) for v in (g, i)])
    return F.try_element_at(ranks, grade)


def grade_range(predicate: Column) -> Column:
    """``<=6a`` and peers to the closed range of scale positions."""
    op = F.regexp_extract(predicate, _PREDICATE, 1)
    rank = grade_rank(F.nullif(F.regexp_extract(predicate, _PREDICATE, 2), F.lit("")))
    return F.struct(
        F.when(op == "<=", F.lit(0)).otherwise(rank).alias("lo"),
        F.when(op == ">=", F.lit(len(GRADE_ORDER) - 1)).otherwise(rank).alias("hi"),
    )


def comment_clauses(comment: Column) -> Column:
    """``Name (codes) = label (remark); ...`` to an array of structs."""

    def clause(c: Column) -> Column:
        label = F.regexp_extract(c, _CLAUSE, 3)
        return F.struct(
            F.regexp_extract(c, _CLAUSE, 1).alias("name"),
            F.regexp_extract(c, _CLAUSE, 2).alias("codes"),
            F.nullif(F.regexp_extract(label, _GRADE, 1), F.lit("")).alias("grade"),
            F.btrim(F.regexp_extract(label, _LABEL, 1)).alias("label"),
            F.nullif(F.regexp_extract(label, r"\(([^()]*)\)", 1), F.lit("")).alias("remark"),
        )

    parts = F.filter(F.split(comment, r";"), lambda c: c.rlike(_CLAUSE))
    return F.transform(parts, clause)


def label_words(labels: Column) -> Column:
    """``a/b`` means either word."""
    return F.transform(F.split(F.lower(labels), "/"), lambda w: F.btrim(w))
