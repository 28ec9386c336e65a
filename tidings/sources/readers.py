"""Sources: JSON lines, CSV, crawl indexes, dated archives, annotation files.

Every reader takes an explicit schema where the format has none, so no job is spent on
inferring one and only the asked-for columns are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidings.functions import text, urls
from tidings.plans.shape import hold, unpack

Paths = str | Sequence[str]

ARTICLE_RAW = "article_url string, html string, article_html string, scrape_timestamp string"
ARTICLE_PARSED = (
    "article_url string, article_text string, ents array<string>, "
    "links array<struct<href:string,text:string,char_start_idx:int,char_end_idx:int,is_press_release:boolean>>"
)
CAPTURES = "url string, timestamp string"


def _paths(paths: Paths) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def read_jsonl(spark: SparkSession, paths: Paths, schema: str | T.StructType, tolerant: bool = True) -> DataFrame:
    """JSON lines, plain or gzip.

    Tolerant: malformed lines are skipped and a truncated gzip gives its readable part.
    Otherwise either fails the job.
    """
    reader = spark.read.schema(schema).option("mode", "DROPMALFORMED" if tolerant else "FAILFAST")
    return reader.option("ignoreCorruptFiles", tolerant).json(_paths(paths))


def read_raw_articles(spark: SparkSession, paths: Paths) -> DataFrame:
    """Raw articles with the page in ``html``, whichever of its two fields holds it."""
    raw = read_jsonl(spark, paths, ARTICLE_RAW)
    return raw.withColumn("html", F.coalesce("html", "article_html")).drop("article_html")


def read_linked_articles(spark: SparkSession, paths: Paths, schema: str = ARTICLE_PARSED) -> DataFrame:
    """Parsed articles with at least one link; a malformed line fails the job."""
    return read_jsonl(spark, paths, schema, tolerant=False).where(F.size("links") > 0)


def read_document_lists(spark: SparkSession, paths: Paths, record: str, columns: bool = False) -> DataFrame:
    """Lines that each hold one document as a list of records; with ``columns`` as a record of lists."""
    lines = spark.read.text(_paths(paths))
    if not columns:
        return lines.select(F.inline(F.from_json("value", f"array<struct<{record}>>")))
    fields = T.StructType.fromDDL(record)
    lists = T.StructType([T.StructField(f.name, T.ArrayType(f.dataType)) for f in fields])
    parsed = lines.select(F.from_json("value", lists).alias("d"))
    return parsed.select(F.inline(F.arrays_zip(*[F.col(f"d.{f.name}").alias(f.name) for f in fields])))


def read_csv(
    spark: SparkSession, paths: Paths, schema: str, columns: Sequence[str] | None = None, drop: Sequence[str] = (),
    multi_line: bool = False,
) -> DataFrame:
    """CSV with a header; ``drop`` takes index columns out. Files with line ends in quotes need ``multi_line`` and are not split."""
    reader = spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", multi_line)
    df = reader.csv(_paths(paths)).drop(*drop)
    return df.select(*columns) if columns else df


def read_csv_headerless(spark: SparkSession, paths: Paths, schema: str = CAPTURES) -> DataFrame:
    """CSV without a header; lines with the wrong number of fields are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").csv(_paths(paths))


def read_crawl_index(spark: SparkSession, paths: Paths) -> DataFrame:
    """Crawl index lines of more than two characters, in column ``line``."""
    return spark.read.text(_paths(paths)).where(F.length("value") > 2).select(F.col("value").alias("line"))


def parse_crawl_index(lines: DataFrame, packet: str = "url string, status string") -> DataFrame:
    """Key, stamp, date and parsed packet of crawl lines; rows whose key is not two tokens go."""
    line = F.col("line")
    return (
        hold(lines, _k=urls.crawl_key_parts(line)).where(F.size("_k") == 2)
        .select(
            urls.clean_url(F.get("_k", 0)).alias("url"), F.get("_k", 1).alias("ts"),
            urls.crawl_date(line).alias("date"), urls.crawl_packet(line, packet).alias("packet"),
        )
    )


def enrich_packets(crawl: DataFrame) -> DataFrame:
    """The packet with the address (no query) and the scrape time, now where unknown."""
    return crawl.select(
        "packet.*", F.substring_index("url", "?", 1).alias("article_url"),
        F.coalesce(F.col("ts"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")).alias("scrape_timestamp"),
    )


def read_sql(spark: SparkSession, query: str, **views: DataFrame) -> DataFrame:
    """A SQL query over named tables, which are registered as temporary views first."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return spark.sql(query)


def read_jdbc(
    spark: SparkSession, url: str, table: str, partition_column: str, lower, upper, partitions: int, **options
) -> DataFrame:
    """A database table read in parallel ranges of one column."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    ranges = {"partitionColumn": partition_column, "lowerBound": lower, "upperBound": upper, "numPartitions": partitions}
    return reader.options(**ranges, **options).load()


def newer_than(df: DataFrame, time: str, cutoff: str) -> DataFrame:
    """What paging backwards until a cutoff date would fetch: rows dated after it."""
    return df.where(F.to_date(time) > F.lit(cutoff).cast("date"))


def read_many(
    spark: SparkSession, pattern: Paths, fmt: str, schema: str | None = None, name_parts: Sequence[str] | None = None,
    outlet: bool = False, **options,
) -> DataFrame:
    """Files by pattern as one table; ``name_parts`` keeps files whose name has one of them.

    ``outlet`` adds the outlet named in front of the file name.
    """
    reader = spark.read.format(fmt).options(**options)
    df = (reader.schema(schema) if schema else reader).load(_paths(pattern))
    if name_parts is not None:
        name = F.substring_index(F.input_file_name(), "/", -1)
        keep = F.lit(False)
        for part in name_parts:
            keep = keep | name.contains(part)
        df = df.where(keep)
    return df.withColumn("source", urls.outlet_from_filename(F.input_file_name())) if outlet else df


def read_dataset(spark: SparkSession, path: Paths) -> DataFrame:
    """One stored dataset, or several by pattern."""
    return spark.read.parquet(*_paths(path))


def read_date_partitions(
    spark: SparkSession, path: str, begin: str, end: str, partition: str = "date", language: tuple[str, object] | None = None
) -> DataFrame:
    """An archive partitioned by date between two dates, both included; other folders are not read."""
    df = spark.read.parquet(path).where(F.col(partition).between(F.lit(begin).cast("date"), F.lit(end).cast("date")))
    return df.where(F.col(language[0]) == language[1]) if language else df


def read_annotation_pairs(spark: SparkSession, docs: Paths, annotations: Paths) -> DataFrame:
    """Sentences with their labels from pairs of text and annotation files.

    Files pair up by the key in their path.
    """
    whole = lambda p: spark.read.text(_paths(p), wholetext=True).select(
        urls.split_key(F.input_file_name()).alias("key"), "value"
    )
    return pair_annotations(whole(docs), whole(annotations))


def pair_annotations(docs: DataFrame, annotations: DataFrame, key: str = "key") -> DataFrame:
    """Sentences with their labels, from (key, value) tables of whole files.

    A text file has one ``URL ``, at most one ``H `` and many ``S<n> `` lines, an annotation file
    ``indicator<TAB>label<TAB>S<n>`` lines; speech labels do not count.
    """
    value = F.col("value")
    lines = unpack(
        docs, [key, text.prefixed_value(value, "URL ").alias("url"), text.prefixed_value(value, "H ").alias("headline")],
        text.prefixed_lines(value, "S"), "_line",
    )
    parts = text.words(F.col("_line"))
    sentences = lines.select(
        key, "url", "headline", F.get(parts, 0).alias("sent_id"),
        F.array_join(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), " ").alias("sentence"),
    )
    fields = F.split("_line", "\t")
    labels = (
        unpack(annotations, [key], F.split(value, "\n"), "_line")
        .where((F.size(fields) == 3) & ~F.lower(F.get(fields, 1)).contains("speech"))
        .select(key, F.trim(F.get(fields, 2)).alias("sent_id"), text.first_token(F.get(fields, 1)).alias("label"))
    )
    return sentences.join(labels, [key, "sent_id"])


def read_rule_lists(spark: SparkSession, paths: Paths) -> DataFrame:
    """Host rules of ad-block lists: lines that start with ``||``, without ``||`` and ``^``."""
    lines = spark.read.text(_paths(paths)).where(F.col("value").startswith("||"))
    return lines.select(F.regexp_replace("value", r"\|\||\^", "").alias("host"))


def from_local(spark: SparkSession, rows, schema: str) -> DataFrame:
    """A small table made on the driver."""
    return spark.createDataFrame(rows, schema)


def read_first(df: DataFrame, n: int, *order: str) -> DataFrame:
    """First n rows, of a given order where one is named."""
    return (df.orderBy(*order) if order else df).limit(n)


def count_readable_lines(spark: SparkSession, paths: Paths) -> DataFrame:
    """Number of lines up to where a file stops being readable."""
    return spark.read.option("ignoreCorruptFiles", True).text(_paths(paths)).agg(F.count(F.lit(1)).alias("n"))
