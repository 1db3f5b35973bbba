"""Queries take their whole tables."""

from collections import defaultdict

import pytest

from .compare import SF, duck


def test_recursive_expand_all(spark):
    from quillspark.plans import registry

    out = defaultdict(set)
    for (k,) in duck("SELECT o_orderkey FROM orders").itertuples(index=False):
        if k % 4:
            out[k].add((k * 7 + 3) % 15000)
        if k % 5 == 0 and k > 0:
            out[k].add(k // 2)
    want = {}
    for src in list(out):
        level = {src}
        for hop in (1, 2, 3):
            level = {dst for x in level for dst in out.get(x, ())}
            for dst in level:
                want.setdefault((src, dst), hop)
    got = registry.queries()["recursive_expand_all"](spark, SF).collect()
    assert len(got) == len(want) and {(r["src"], r["dst"]): r["hop"] for r in got} == want
    assert max(r["src"] for r in got) >= 400


@pytest.mark.parametrize(("name", "table"), [("fuzzy_date_all", "orders"), ("slugify_all", "documents"), ("sliding_lev_all", "part"), ("roman_mended", "part"), ("running_head", "part"), ("vocabulary_match", "part")])
def test_whole_tables(spark, name, table):
    """A row for every row of the table."""
    from quillspark.plans import registry

    got = registry.queries()[name](spark, SF).toPandas()
    assert len(got) == duck(f"SELECT count(*) AS n FROM {table}")["n"][0]
