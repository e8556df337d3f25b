"""python -m foliograph extract|convert|diagnose PATH [txt|md|html]: answers for a file, or for all documents of a folder.

Exit codes: 0 done, 1 a document could not be read, 64 wrong usage. With several documents each answer follows its path.
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from .plans import documents
from .sources.packages import open_documents, read_files

USAGE = __doc__.partition("\n")[0]


def main(args: list[str]) -> int:
    formats = {"txt": "text", "md": "md", "html": "html"}
    if len(args) < 2 or args[0] not in ("extract", "convert", "diagnose") or len(args) > (3 if args[0] == "convert" else 2) or (len(args) == 3 and args[2] not in formats):
        print(USAGE, file=sys.stderr)
        return 64
    answer = {"extract": "text", "diagnose": "diagnose"}.get(args[0]) or formats[args[2] if len(args) == 3 else "md"]
    spark = SparkSession.builder.appName("foliograph").config("spark.ui.enabled", "false").getOrCreate()
    opened = open_documents(read_files(spark, args[1]).drop("format")).cache()
    failed = opened.where("tag = 'error'").select("doc_id", "name", "text").toLocalIterator()
    status = 0
    for r in failed:
        print(f"{r.doc_id}: {r.name}: {r.text}", file=sys.stderr)
        status = 1
    several = opened.select("doc_id").distinct().limit(2).count() > 1
    for r in documents.ANSWERS[answer](opened.where("tag <> 'error'")).orderBy("doc_id").toLocalIterator():
        print(f"{r[0]}\n{r[1]}" if several else r[1])
    return status


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
