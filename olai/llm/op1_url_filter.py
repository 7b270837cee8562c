"""Query of the URL filter."""

from olai.llm.common import table
from olai.llm.url_filter import filter_urls

RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))


def op1_url_filter(spark, sf_dir):
    return filter_urls(table(spark, sf_dir, "pages", "page_id", "url"), RULES)
