"""RDF terms as strings in N3 form: `<iri>`, `_:label`, `"lexical"@lang`, `"lexical"^^<datatype>`.

Terms are opaque: two are equal only if their strings are. Null terms have null results.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(term: Column | str) -> Column:
    return F.col(term) if isinstance(term, str) else term


def is_bnode(term: Column | str) -> Column:
    return _c(term).startswith("_:")


def is_iri(term: Column | str) -> Column:
    return _c(term).startswith("<")


def is_literal(term: Column | str) -> Column:
    return _c(term).startswith('"')


def parts(term: Column | str) -> Column:
    """struct(kind, value, lang, datatype) of a term."""
    t = _c(term)
    literal = lambda group: F.nullif(F.regexp_extract(t, r'(?s)^"(.*)"(?:@([A-Za-z0-9\-]+)|\^\^<([^>]*)>)?\z', group), F.lit(""))
    value = F.when(is_iri(t), F.substring(t, F.lit(2), F.greatest(F.length(t) - 2, F.lit(0))))
    return F.struct(
        F.when(is_iri(t), "iri").when(is_bnode(t), "bnode").when(is_literal(t), "literal").alias("kind"),
        value.when(is_bnode(t), F.substring(t, F.lit(3), F.length(t))).when(is_literal(t), F.coalesce(literal(1), F.lit(""))).alias("value"),
        F.when(is_literal(t), literal(2)).alias("lang"),
        F.when(is_literal(t), literal(3)).alias("datatype"),
    )


def skolem(term: Column | str, prefix: str = "", as_bnode: bool = True) -> Column:
    """Blank nodes with a prefixed label, as blank nodes or as IRIs; other terms unchanged."""
    t = _c(term)
    label = F.substring(t, F.lit(3), F.length(t))
    named = F.concat(F.lit(f"_:{prefix}"), label) if as_bnode else F.concat(F.lit(f"<{prefix}"), label, F.lit(">"))
    return F.when(is_bnode(t), named).otherwise(t)


def safe_label(term: Column | str) -> Column:
    """Blank nodes whose label starts with a digit get a leading `j`."""
    t = _c(term)
    return F.when(t.rlike("^_:[0-9]"), F.concat(F.lit("_:j"), F.substring(t, F.lit(3), F.length(t)))).otherwise(t)
