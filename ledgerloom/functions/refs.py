"""Typed references as column expressions.

A reference is a string with one of the prefixes below. Parsing gives struct(kind, ident, sub): the
digest for objects and digests, the id for entities, cell and output name for named outputs, artifact
and rest for URIs; null if nothing matches. One trailing line feed is accepted after a reference.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the grammar.
PREFIXES = ("object:", "digest:", "cell:", "record:", "run:", "commit:", "branch:", "render:", "sol://")
ID = "[A-Za-z0-9_:-]+"
HEX64 = "[a-f0-9]{64}"
PATTERNS = {
    "object": f"object:sha256:({HEX64})()",
    "digest": f"digest:sha256:({HEX64})()",
    "named_output": f"cell:({ID})#({ID})",
    "cell": f"cell:({ID})()",
    "record": f"record:({ID})()",
    "run": f"run:({ID})()",
    "commit": f"commit:({ID})()",
    "branch": f"branch:({ID})()",
    "render": f"render:({ID})()",
    "sol_uri": "sol://([^/]+)/([^/]+/[^\\n]+)",
}


def is_ref(c: Column) -> Column:
    """One pattern, so that ``c`` is computed once."""
    return c.rlike(r"\A(" + "|".join(PREFIXES) + ")")


def _whole(pattern: str) -> str:
    return rf"^{pattern}\n?\z"


def _fits(c: Column, pattern: str) -> Column:
    """Only texts with the prefix of a kind are matched."""
    return c.startswith(pattern[: pattern.index("(")]) & c.rlike(_whole(pattern))


def kind_of(c: Column) -> Column:
    """The kind alone, null if nothing matches: a filter by kind, which goes down to every row, takes no text apart."""
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(PATTERNS.items()):
        out = F.when(_fits(c, pattern), F.lit(kind)).otherwise(out)
    return out


def parse_ref(c: Column) -> Column:
    """The kinds exclude one another, since ids have no # and prefixes differ."""
    out = F.lit(None).cast("struct<kind:string,ident:string,sub:string>")
    for kind, pattern in reversed(PATTERNS.items()):
        part = lambda k, whole=_whole(pattern): F.regexp_extract(c, whole, k)
        out = F.when(_fits(c, pattern), F.struct(F.lit(kind).alias("kind"), part(1).alias("ident"), F.nullif(part(2), F.lit("")).alias("sub"))).otherwise(out)
    return out


def bare_id(c: Column, prefix: str) -> Column:
    """``c`` without one leading ``prefix:``."""
    return F.when(c.startswith(prefix + ":"), F.substring(c, F.lit(len(prefix) + 2), F.length(c))).otherwise(c)


def object_ref(content: Column) -> Column:
    return F.concat(F.lit("object:sha256:"), F.sha2(content, 256))


def digest_ref(content: Column) -> Column:
    return F.concat(F.lit("digest:sha256:"), F.sha2(content, 256))
