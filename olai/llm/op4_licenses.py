"""Query of the licence scan."""

from pyspark.sql import functions as F

from olai.llm.common import table
from olai.llm.licenses import NOTICE, scan_licenses


def op4_licenses(spark, sf_dir):
    """Documents laid out as files: source, language and hundred of ids are directories.

    A text of whose lines, blank ones aside, half or more are notices is a licence file of its directory, however long it is.
    """
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source", "lang")
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    notice = F.when(F.rlike("text", F.lit(NOTICE)), 2 * F.size(F.filter(lines, lambda x: F.rlike(x, F.lit(NOTICE)))) >= F.size(lines))
    name = F.concat(F.when(notice, "LICENSE-").otherwise(""), F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit(".txt"))
    path = F.concat_ws("/", "source", "lang", F.floor(F.col("doc_id") / 100).cast("string"), name)
    return scan_licenses(docs.select("doc_id", "text", path.alias("path")))
