"""The derived queries over small cases that were written down with their results."""

import json
import os

import pytest

from lodestone import catalog
from lodestone.catalog import derived

with open(os.path.join(os.path.dirname(__file__), "literals.json")) as f:
    CASES = json.load(f)
#: Their rows of the tables have other shapes, or they read tags from a table.
OTHERS = {"synonym_audit", "skip_sections", "parse_query_rules", "clean_scrapes", "page_texts"}


def rows_of(df, columns):
    return sorted(([r[c] for c in columns] for r in df.collect()), key=repr)


def literal(spark, name):
    table = CASES["tables"][name]
    return spark.createDataFrame([tuple(r) for r in table["rows"]], table["schema"])


@pytest.mark.parametrize("name", sorted(set(CASES["queries"]) - OTHERS))
def test_literal(spark, monkeypatch, name):
    case = CASES["queries"][name]
    for table in case["tables"]:
        monkeypatch.setattr(getattr(derived, table), "frame", lambda *_, t=table: literal(spark, t))
    assert rows_of(catalog.QUERIES[name](spark, "none"), case["columns"]) == sorted(case["rows"], key=repr)


def test_literal_parse(spark):
    case = CASES["queries"]["parse_query_rules"]
    tags = spark.createDataFrame([(t,) for t in derived.TAGS], "disaster_type string")
    got = derived.Q.parse_queries(literal(spark, "REPLIES").withColumnRenamed("id", "query_id"), tags)
    assert rows_of(got, case["columns"]) == case["rows"]


def test_literal_scrapes(spark):
    raw, want = literal(spark, "RAW"), {r[0]: r[1:] for r in CASES["tables"]["CLEANED"]["rows"]}
    ids = {r.source: r.id for r in raw.collect()}
    for dialect in ("ready", "cross", "emd"):
        for r in derived.L.clean_scrapes(raw.where(raw.dialect == dialect).select("source", "text"), dialect).collect():
            assert [r.text, r.in_lines, r.out_lines] == [want[ids[r.source]][0].rstrip("\n") + "\n", *want[ids[r.source]][1:]]


def test_literal_sections(spark):
    case, lines = CASES["queries"]["skip_sections"], {}
    for source, _, line in sorted(map(tuple, CASES["tables"]["SECTIONS"]["rows"])):
        lines.setdefault(source, []).append(line)
    files = spark.createDataFrame(list(lines.items()), "source string, lines array<string>")
    kept = derived.L.skip_sections(derived.F.col("lines"), derived.L.sections_of(derived.F.col("source")))
    got = {r.source: "|".join(r.kept) for r in files.select("source", kept.alias("kept")).collect()}
    assert got == {row[case["columns"].index("source")]: row[case["columns"].index("lines")] for row in case["rows"]}


def test_literal_pages(spark):
    case = CASES["queries"]["page_texts"]
    assert rows_of(derived.P.page_texts(literal(spark, "WORDS"), ["page"]), case["columns"]) == case["rows"]
