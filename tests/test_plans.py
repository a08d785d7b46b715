"""Plans of the registered queries, and p-values against closed values."""

import math

import pytest

import __spark_entry__ as spark_entry
from tessera import catalog
from tessera.operators import pvalues

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize(
    ("name", "columns"),
    [
        ("topk_inner_product", {"vec_id", "label", "embedding"}),
        ("unit_offsets", {"doc_id", "text"}),
        ("missing_scores", {"doc_id", "source"}),
        ("condition_rollup", {"event_type", "value"}),
        ("edge_counts", {"l_orderkey", "l_partkey", "o_orderkey", "o_custkey", "c_custkey", "c_nationkey", "n_name", "n_nationkey"}),
        ("html_paragraphs", {"page_id", "html"}),
    ],
)
def test_scans_read_only_what_is_used(spark, name, columns):
    import re

    text = plan(catalog.queries()[name](spark, SF))
    read = {c.split(":")[0] for s in re.findall(r"ReadSchema: struct<(.*?)>\n", text) for c in re.split(r",(?![^<]*>)", s)}
    assert read <= columns | {"doc_id"}


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_no_query_has_a_cartesian_product(spark, name):
    text = plan(catalog.queries()[name](spark, SF))
    assert "CartesianProduct" not in text


def test_filters_reach_the_scan(spark):
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,40.0)" in plan(catalog.queries()["gold_incoming_xref"](spark, SF))


def test_entry(spark):
    df = spark_entry.entry(spark)
    assert df.count() == 1 and "ndcg" in df.columns
    assert set(spark_entry.oracle_sql()) <= set(spark_entry.queries())


def test_p_values():
    # Published: 68 pairs, lesser sum 171, p about 9.2e-10 without the tie term.
    z = (171 - 68 * 69 / 4) / math.sqrt(68 * 69 * 137 / 24)
    assert pvalues.normal_two_sided(z) == pytest.approx(9.2e-10, rel=0.02)
    assert pvalues.chi_squared_tail(62.693, 2) == pytest.approx(math.exp(-62.693 / 2))
    assert pvalues.chi_squared_tail(7.815, 3) == pytest.approx(0.05, rel=1e-3)


def test_nothing_else_imports_the_training_data_operators():
    from pathlib import Path

    root = Path(catalog.__file__).parent
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert not [line for line in path.read_text().splitlines() if line.lstrip().startswith(("import ", "from ")) and "llm" in line]
