"""References, links, tagged names and triggers inside record text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The reference syntax is **provider:key**, optionally followed by :pages.
REF_TOKEN = r"\*\*([^:*\s]+):([^*\s]+)\*\*(?::([^\s,;()]*[^\s,;().]))?"
LANG_TAG = r"\s*\[([A-Za-z][A-Za-z0-9-]*)\]$"
LINK = r"^\[([^\]]*)\]\((\S*)\)$"
TAGGED_CODE = r"\[([a-z]{3})\]"


def _blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def ref_struct(token: Column) -> Column:
    return F.struct(
        F.regexp_extract(token, REF_TOKEN, 1).alias("provider"),
        F.regexp_extract(token, REF_TOKEN, 2).alias("key"),
        _blank_to_null(F.regexp_extract(token, REF_TOKEN, 3)).alias("pages"),
    )


def inline_refs(text: Column) -> Column:
    """Every well-formed reference in prose, in order."""
    tokens = F.regexp_extract_all(text, F.lit(REF_TOKEN), F.lit(0))
    return F.transform(tokens, ref_struct)


def ref_list(items: Column) -> Column:
    """References of a list value; items that are none are left out."""
    return F.transform(F.filter(items, lambda i: i.rlike(REF_TOKEN)), ref_struct)


def ref_keys(refs: Column) -> Column:
    """Distinct ``provider:key`` of parsed references."""
    return F.array_distinct(
        F.transform(refs, lambda r: F.concat_ws(":", r["provider"], r["key"]))
    )


def link_struct(item: Column) -> Column:
    marked = item.rlike(LINK)
    url = F.when(marked, F.regexp_extract(item, LINK, 2)).otherwise(item)
    return F.struct(
        F.when(marked, F.regexp_extract(item, LINK, 1)).alias("label"),
        url.alias("url"),
        F.try_parse_url(url, F.lit("HOST")).alias("host"),
    )


def tagged_name(name: Column) -> Column:
    """``Quillar [en]`` to (name, lang); names without a tag have lang NULL."""
    return F.struct(
        F.regexp_replace(name, LANG_TAG, "").alias("name"),
        _blank_to_null(F.regexp_extract(name, LANG_TAG, 1)).alias("lang"),
    )


def percent_decode(c: Column) -> Column:
    """Percent-decode; a value that is no valid encoding is kept as it is.

    A plus sign stands for itself, as it does outside of forms.
    """
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


NOT = r"^(?i:not)\s+"


def triggers(items: Column) -> Column:
    """Alternatives (outer array) of terms that must all hold (inner array). A term is a word, or ``NOT`` and a word."""
    return F.transform(items, lambda i: F.split(i, r"\s+(?i:and)\s+"))


def text_words(text: Column) -> Column:
    """Distinct words: runs of letters and digits, lower-cased."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def required_words(alternative: Column) -> Column:
    """Words that a title needs; terms are taken apart like titles."""
    terms = F.filter(alternative, lambda t: ~t.rlike(NOT))
    return F.array_distinct(F.flatten(F.transform(terms, text_words)))


def holds(words: Column, alternative: Column) -> Column:
    """Whether a title with these words has all that is required and nothing that is excluded.

    An alternative that requires nothing holds nowhere.
    """
    required = required_words(alternative)
    excluded = F.filter(alternative, lambda t: t.rlike(NOT))
    clear = F.forall(excluded, lambda t: F.size(F.array_except(text_words(F.regexp_replace(t, NOT, "")), words)) > 0)
    return (F.size(required) > 0) & (F.size(F.array_except(required, words)) == 0) & clear


def trigger_match(title: Column, alternatives: Column) -> Column:
    """True if some alternative holds for the title."""
    words = text_words(title)
    return F.exists(alternatives, lambda alternative: holds(words, alternative))


def derived_ref_difference(prose: Column, listed: Column) -> Column:
    """Keys only in the prose and keys only in the list."""
    in_prose, in_list = ref_keys(inline_refs(prose)), ref_keys(listed)
    return F.struct(
        F.array_sort(F.array_except(in_prose, in_list)).alias("only_prose"),
        F.array_sort(F.array_except(in_list, in_prose)).alias("only_list"),
    )


def version_list(c: Column) -> Column:
    """``E16/E17`` to an array."""
    return F.filter(F.split(c, "/"), lambda v: v != "")


def remedy_codes(c: Column) -> Column:
    """Bracketed three-letter codes in the text of a remedy."""
    return F.regexp_extract_all(c, F.lit(TAGGED_CODE), F.lit(1))
