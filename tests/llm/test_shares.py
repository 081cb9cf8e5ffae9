"""Shares of the mixes on the tables themselves."""

import os

import pytest
from pyspark.sql import functions as F

from lodestrata.llm import registry
from lodestrata.llm.tokens import token_counts
from lodestrata.session import table

DIR = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the test tables")
def test_shares_within_one_text(spark):
    docs = token_counts(table(spark, DIR, "documents"), ["doc_id", "source"], "text")
    typical = {r[0]: r[1] for r in docs.where("n_tokens > 0").groupBy("source").agg(F.percentile_approx("n_tokens", 0.5)).collect()}
    rows = registry.p9_report(spark, DIR).collect()
    assert len(rows) == 24
    for r in rows:
        assert abs(r.gap_tokens) <= typical[r.source] and r.most_copies <= r.max_repeats
