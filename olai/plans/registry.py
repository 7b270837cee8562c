"""All core queries by name, each taking ``(spark, sf_dir)``, and their DuckDB SQL."""

from olai.plans import lexicon_queries, script_queries, tamil_queries

QUERIES = {**lexicon_queries.QUERIES, **tamil_queries.QUERIES, **script_queries.QUERIES}
ORACLE_SQL = {**lexicon_queries.ORACLE_SQL, **tamil_queries.ORACLE_SQL, **script_queries.ORACLE_SQL}
