"""Reading what a search or an evaluation left behind. Files are read as they are; a missing one is empty."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from pyspark.errors import AnalysisException

HIT = "url string, title string, snippet string, date string, engine array<string>, positions map<string,int>"
STATUS = "engine string, ok boolean, count long, latency double, error string, coherence double, decoy boolean"
LABEL = "query string, url string, domain string, form double, authority double, coverage double, rel double, weak_core boolean, len int, _note string"
STATS = "host string, n long, ok long, score_sum double, low long, lat_sum double, lat_n long, last double, delta double, delta_date double"


def search_results(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Hits and engine states of captured searches (SRC1): JSON objects with `results` and `engine_status`, or lists of hits.

    Hits get the file as `source` and their place in it as `pos`. Values that do not fit are null.
    """
    form = f"results array<struct<{_struct(HIT)}>>, engine_status array<struct<{_struct(STATUS)}>>"
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source"), "value")
    whole = F.from_json("value", form)
    listed = F.from_json("value", f"array<struct<{_struct(HIT)}>>")
    is_list = F.ltrim("value").startswith("[")
    hits = raw.select("source", F.posexplode(F.when(is_list, listed).otherwise(whole["results"])).alias("pos", "h")).select("source", "pos", "h.*")
    states = raw.where(~is_list).select("source", F.explode(whole["engine_status"]).alias("s")).select("source", "s.*")
    return hits, states


def _struct(ddl: str) -> str:
    return ", ".join(f"{n}: {t}" for n, t in (part.strip().split(" ", 1) for part in _fields(ddl)))


def _fields(ddl: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, ch in enumerate(ddl):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append(ddl[start:i])
            start = i + 1
    return [*out, ddl[start:]]


def labels(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Labelled rows (SRC10) of a JSON file, a list or an object with `items`, or of JSON lines."""
    if lines:
        return spark.read.schema(LABEL).json(path)
    raw = spark.read.text(path, wholetext=True)
    rows = F.when(F.ltrim("value").startswith("["), F.from_json("value", f"array<struct<{_struct(LABEL)}>>")).otherwise(F.from_json("value", f"items array<struct<{_struct(LABEL)}>>")["items"])
    return raw.select(F.inline(rows))


def queries(spark: SparkSession, path: str) -> DataFrame:
    """One query per line; blank lines and comments are skipped (SRC10)."""
    return spark.read.text(path).select(F.trim("value").alias("query")).where("query != '' and not query like '#%'")


def host_stats(spark: SparkSession, path: str) -> DataFrame:
    """A stored snapshot of host state (SRC7); none if it cannot be read."""
    try:
        return spark.read.schema(STATS).json(path)
    except AnalysisException:
        return spark.createDataFrame([], STATS)


def domain_model(spark: SparkSession, path: str) -> DataFrame:
    """(`host`, `p_bad`) of a learned model (SRC8), a JSON object with `dom`; none if there is no file."""
    try:
        raw = spark.read.text(path, wholetext=True)
    except AnalysisException:
        return spark.createDataFrame([], "host string, p_bad double")
    return raw.select(F.explode(F.from_json("value", "dom map<string,array<double>>")["dom"]).alias("host", "v")).select("host", F.get("v", F.lit(0)).alias("p_bad"))


def first_success(attempts: DataFrame, key: str = "url") -> DataFrame:
    """The text of the first level that gave one (SRC5): attempts (`key`, `level`, `text`)."""
    order = Window.partitionBy(key).orderBy("level")
    return attempts.where(F.length("text") > 0).withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """Files that hold a PDF (SRC9, T9): (`path`, `bytes`)."""
    from pagesift.functions.documents import is_pdf

    return spark.read.format("binaryFile").load(path).where(is_pdf("content")).select("path", F.col("length").alias("bytes"))
