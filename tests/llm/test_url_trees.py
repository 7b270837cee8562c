"""The trees of the URL filter on the driver's pages."""

import os

import pytest
from pyspark.sql import functions as F

from olai.llm import url_filter
from olai.llm.common import table
from olai.llm.op1_url_filter import RULES, op1_url_filter

SF = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are absent")
def test_trees_judge_urls_that_no_rule_fits(spark):
    rows = op1_url_filter(spark, SF).withColumn("lead", F.regexp_extract("path", "^/([^/]*)", 1)).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/pages.parquet").count()
    free = [r for r in rows if r.rule is None]
    assert min(sum(r.verdict == v for r in free) for v in ("allow", "block")) > 50 and len({r.score for r in free}) > 10
    # By what a URL looks like, also within one suffix.
    org = [r for r in free if r.host.endswith(".org")]
    assert {r.verdict for r in org} == {"allow", "block"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are absent")
def test_held_out_urls(spark):
    rows = url_filter.lexical_features(table(spark, SF, "pages", "page_id", "url"))
    rule = url_filter.rule_of(F.col("host"), F.col("path"), RULES, verdict=True)
    rows = rows.withColumn("label", (rule == "block").cast("double")).where("label IS NOT NULL").select("url", "label", *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in url_filter.FEATURES])
    apart = F.crc32("url") % 5 == 0
    model = url_filter.fit_trees(rows.where(~apart))
    judged = url_filter.score_trees(model, rows.where(apart)).select("label", "score").collect()
    assert sum((r.score >= 0.5) == (r.label == 1) for r in judged) >= 0.93 * len(judged)
