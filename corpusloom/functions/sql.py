"""The engine from SQL: functions as session-wide SQL functions, tables as views."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.types import ArrayType, StringType
from pyspark.sql.udtf import UserDefinedTableFunction
from pyspark.sql.functions import udtf

from corpusloom.operators.chunking import pack
from corpusloom.sources.bibtex import entries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Functions that SQL can say itself: temporary SQL functions stay inside the optimizer, unlike Python ones.
EXPRESSIONS = {
    "corpus_words(t STRING) RETURNS ARRAY<STRING>": r"regexp_extract_all(lower(t), '[\\p{L}\\p{N}]+', 0)",
    "corpus_jaccard(a ARRAY<STRING>, b ARRAY<STRING>) RETURNS DOUBLE": "CASE WHEN size(array_union(a, b)) = 0 THEN 1.0D ELSE size(array_intersect(a, b)) / size(array_union(a, b)) END",
    "corpus_doi(t STRING) RETURNS STRING": r"nullif(regexp_replace(regexp_replace(lower(regexp_extract(t, '(?i)(10\\.[0-9]{4,9}/\\S+)', 1)), '[)\\]>,.;:!?\"\\s]+$', ''), '(?<=[0-9])\\.?v[0-9]+$', ''), '')",
    "corpus_pmcid(t STRING) RETURNS STRING": r"'PMC' || nullif(regexp_extract(t, '(?i)\\bPMC\\s?([0-9]{5,9})\\b', 1), '')",
    "corpus_arxiv(t STRING) RETURNS STRING": r"nullif(regexp_extract(t, '([0-9]{4}\\.[0-9]{4,5})', 1), '')",
    "corpus_stem(t STRING) RETURNS STRING": r"substring(regexp_replace(t, '[^\\p{L}\\p{N}_\\-]', '_'), 1, 100)",
    "corpus_similarity(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": "1 / (1 + aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0.0D, (s, x) -> s + x))",
}


class Chunks:
    """chunks(text): idx, chunk."""

    def eval(self, text: str):
        yield from enumerate(pack(text or ""))


class Bibliography:
    """bib_entries(text): key, title, year, doi."""

    def eval(self, text: str):
        for e in entries(text or ""):
            yield e["key"], e["title"], e["year"], e["doi"]


def table_functions() -> dict[str, UserDefinedTableFunction]:
    return {"corpus_chunks": udtf(Chunks, returnType="idx: int, chunk: string"), "corpus_bib": udtf(Bibliography, returnType="key: string, title: string, year: string, doi: string")}


def register(spark: SparkSession, sf_dir: str | None = None) -> None:
    """Register all functions, and the tables under sf_dir as views."""
    for head, body in EXPRESSIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.udf.register("corpus_pack", lambda t: pack(t or ""), ArrayType(StringType()))
    for name, f in table_functions().items():
        spark.udtf.register(name, f)
    for t in TABLES if sf_dir else ():
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
