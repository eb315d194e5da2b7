"""Tags from file names and anchor phrases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone import constants as C
from lodestone.functions import text as T


def _lookup(key: Column, table: dict[str, str]) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), F.lit(C.GENERAL))


def tag_of(source: Column, text: Column) -> Column:
    """The tag of a chunk: by slug for scrapes; for other files anchor phrases, then the file's default."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for prefix, table in C.TAGS_BY_SLUG.items():
        slug = F.substring(source, len(prefix) + 1, F.length(source) - len(prefix) - 4)
        out = out.when(source.startswith(prefix) & source.endswith(".txt"), _lookup(slug, table))
    return out.otherwise(F.coalesce(T.first_tag(text, C.OVERRIDE_PHRASES), _lookup(source, C.TAGS_BY_PDF)))
