"""Readers: stored tables, raw CSV corpora, JSON documents and result logs.

Everything that looks at many files does so in one distributed read; the driver never lists or
opens them one by one.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tableworks.functions.columns import col
from tableworks.functions.text import integer_of, missing_to_null, number_of
from tableworks.session import broadcast_if_few, pin
from tableworks.sources import schemas
from tableworks.sources.records import csv_records, record_cells

FILES = {"processed": "table", "raw": "raw"}


def load(spark: SparkSession, base: str, table_id: str, kind: str = "processed") -> DataFrame:
    """A stored table by id; a missing one raises ``AnalysisException``."""
    if kind not in FILES:
        raise ValueError(f"kind must be one of {sorted(FILES)}, not {kind!r}")
    return spark.read.parquet(f"{base}/{table_id}/{FILES[kind]}.parquet")


def load_if_present(
    spark: SparkSession, base: str, table_id: str, kind: str = "processed",
) -> DataFrame | None:
    try:
        return load(spark, base, table_id, kind)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def load_as(spark: SparkSession, base: str, table_id: str, alias: str) -> DataFrame:
    """A stored table, also named for ``relational.use``."""
    df = load(spark, base, table_id)
    df.createOrReplaceTempView(alias)
    return df


def read_csv(spark: SparkSession, path: str, schema: str | None = None, encoding: str = "UTF-8") -> DataFrame:
    """One CSV file or folder with a header, missing tokens as NULL, and its stored order in ``_pos``.

    Without a schema the types are inferred the way dataframe libraries do: int64 when every cell
    is an integer, float64 when every non-missing cell is a number, else text. One aggregate job
    decides for all columns. ``_pos`` is (file offset of the block, row in the block); it follows
    the order within a file. Store the table as Parquet once to fix it.
    """
    reader = spark.read.option("header", True).option("encoding", encoding)
    pos = F.array(
        F.col("_metadata.file_block_start"), F.monotonically_increasing_id()
    ).alias("_pos")
    if schema is not None:
        return reader.schema(schema).option("nullValue", "").csv(path).select("*", pos)
    raw = reader.csv(path)
    names = raw.columns
    texts = raw.select(*[missing_to_null(col(c)).alias(c) for c in names], pos)
    counts = texts.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count(col(c)).alias(f"p{i}") for i, c in enumerate(names)],
        *[F.count(number_of(col(c))).alias(f"f{i}") for i, c in enumerate(names)],
        *[F.count(integer_of(col(c))).alias(f"i{i}") for i, c in enumerate(names)],
    ).first()

    def typed(i: int, name: str) -> Column:
        if counts["n"] and counts[f"i{i}"] == counts["n"]:
            return integer_of(col(name)).alias(name)
        if counts[f"f{i}"] == counts[f"p{i}"]:
            return number_of(col(name)).alias(name)
        return col(name)

    return texts.select(*[typed(i, c) for i, c in enumerate(names)], "_pos")


def _below(root: str, path: Column) -> tuple[Column, Column]:
    """First two path parts below ``root``: a folder, and the file (or Spark output) in it.

    A part may be a plain file or a folder of part files that Spark wrote under that name.
    """
    bare = re.sub(r"^[a-zA-Z0-9]+:/*", "/", root).rstrip("/")
    pattern = re.escape(bare) + r"/([^/]+)/([^/]+)"
    return F.regexp_extract(path, pattern, 1), F.regexp_extract(path, pattern, 2)


def _files(spark: SparkSession, root: str) -> DataFrame:
    """Every file below the folders of ``root``: folder, item and size. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    folder, item = _below(root, F.col("path"))
    return files.select(
        "path", folder.alias("folder"), item.alias("item"), F.col("length").alias("size"),
    ).filter("folder <> ''")


def scan_datasets(spark: SparkSession, root: str, max_mb: float | None = None) -> DataFrame:
    """Folders with a manifest, at least one CSV file and a total size within the limit, by name."""
    return _files(spark, root).groupBy("folder").agg(
        F.sum("size").alias("bytes"),
        F.bool_or(F.col("item").endswith(".csv")).alias("has_csv"),
        F.bool_or(F.col("item") == "datapackage.json").alias("has_manifest"),
    ).filter(
        F.col("has_csv") & F.col("has_manifest")
        & (F.lit(True) if max_mb is None else F.col("bytes") / (1024 * 1024) <= max_mb)
    ).select(F.col("folder").alias("dataset"), "bytes").orderBy("dataset")


def existing_tables(spark: SparkSession, base: str) -> DataFrame:
    """Ids of the stored tables (folders named ``table_…``), sorted."""
    files = _files(spark, base).select(F.col("folder").alias("table_id"))
    return files.filter(F.col("table_id").startswith("table_")).distinct().orderBy("table_id")


def file_sizes(spark: SparkSession, base: str) -> DataFrame:
    """Bytes per stored table and part (``table``, ``raw``, …)."""
    return _files(spark, base).filter(F.col("folder").startswith("table_")).groupBy(
        F.col("folder").alias("table_id"), F.substring_index("item", ".", 1).alias("part"),
    ).agg(F.sum("size").alias("bytes"))


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """``(dataset, title, description)`` from every valid manifest (a JSON object)."""
    folder, item = _below(root, F.col("_metadata.file_path"))
    read = spark.read.option("recursiveFileLookup", True)
    # names are matched before the contents are read: the name test only needs file metadata
    text = read.option("pathGlobFilter", "{datapackage.json,part-*.txt}").text(
        root, wholetext=True).filter(item == "datapackage.json").select(folder.alias("dataset"), "value")
    good = text.filter(F.json_object_keys("value").isNotNull())
    return good.select(
        "dataset", F.get_json_object("value", "$.title").alias("title"),
        F.get_json_object("value", "$.description").alias("description"))


def read_corpus(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """All raw CSV files below ``root`` as corpus rows and headers (see operators.profiling).

    The table id is the folder name; of several files in a folder the first by name is read (a folder of
    part files with headers, as Spark writes them, counts as one file). Files that are not valid UTF-8
    are decoded as Latin-1. Empty header cells are called ``Unnamed: i`` and repeated ones get ``.1``,
    ``.2``. Quoted cells may hold line breaks (see :func:`records.csv_records`). Cells beyond the header are
    kept in ``surplus``, which is null where there are none.
    """
    # written once: three passes below read them
    records = pin(csv_records(spark, root))
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").text(root)
    path = F.col("_metadata.file_path")
    folder, item = _below(root, path)
    facts = lines.groupBy(path.alias("path"), folder.alias("table_id"), item.alias("item")).agg(
        F.bool_and(F.is_valid_utf8("value")).alias("utf8"))
    # one row per file from here on
    in_table = W.partitionBy("table_id")
    chosen = facts.withColumn("_first", F.min("item").over(in_table)).filter("item = _first").withColumn(
        "file_no", F.row_number().over(in_table.orderBy("path")))
    first = records.groupBy("path").agg(F.min("pos").alias("first_pos"))
    files = pin(chosen.join(first, "path").select("path", "table_id", "utf8", "file_no", "first_pos"))
    read = records.join(broadcast_if_few(files), "path")
    text = F.when(F.col("utf8"), F.col("record")).otherwise(F.decode(F.col("record").cast("binary"), "ISO-8859-1"))
    heads = read.filter("pos = first_pos").select(
        "path", "table_id", "file_no", record_cells(F.regexp_replace(text, "^\ufeff", "")).alias("_cells"))
    plain = F.transform("_cells", lambda c, i: F.coalesce(
        F.nullif(c, F.lit("")), F.concat(F.lit("Unnamed: "), i.cast("string"))))
    headers = heads.filter("file_no = 1").select("table_id", plain.alias("_names")).select("table_id", F.transform(
        "_names", lambda c, i: _numbered_copy(c, i, F.col("_names"))).alias("columns"))
    cells = read.filter("pos > first_pos").select("path", "table_id", "pos", record_cells(text).alias("_cells"))
    widths = pin(heads.select("path", F.size("_cells").alias("width")))
    rows = cells.join(broadcast_if_few(widths), "path").select(
        "table_id", "pos",
        F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda i: missing_to_null(F.get("_cells", i))).alias("cells"),
        F.when(F.size("_cells") > F.col("width"), F.slice("_cells", F.col("width") + 1, F.size("_cells"))).alias("surplus"))
    return rows, headers


def _numbered_copy(name: Column, i: Column, names: Column) -> Column:
    before = F.size(F.filter(names, lambda n, j: (n == name) & (j < i)))
    return F.when(before > 0, F.concat(name, F.lit("."), before.cast("string"))).otherwise(name)


def check_structure(spark: SparkSession, root: str, min_columns: int = 3) -> DataFrame:
    """``(dataset, accepted, reason)``: manifest is an object, five first rows fit, enough columns."""
    from tableworks.operators.sampling import head

    rows, headers = read_corpus(spark, root)
    first = head(rows, ["table_id"], ["pos"], 5).groupBy("table_id").agg(
        F.bool_or(F.col("surplus").isNotNull()).alias("too_wide"))
    tables = headers.join(first, "table_id", "left").select(
        F.col("table_id").alias("dataset"), F.size("columns").alias("n_columns"), "too_wide")
    known = manifests(spark, root).select("dataset", F.lit(True).alias("manifest"))
    every = scan_datasets(spark, root).select("dataset")
    reason = (
        F.when(F.col("manifest").isNull(), "manifest is not an object")
        .when(F.col("n_columns").isNull(), "no readable table")
        .when(F.col("too_wide"), "first rows do not fit the header")
        .when(F.col("n_columns") < min_columns, "too few columns")
    )
    return every.join(known, "dataset", "left").join(tables, "dataset", "left").select(
        "dataset", reason.isNull().alias("accepted"), reason.alias("reason"))


def read_documents(
    spark: SparkSession, root: str, schema: str, name: str = "*.json", lines: bool = False,
) -> DataFrame:
    """JSON documents below ``root``, one row each, with ``_path``; unreadable ones are left out.

    A file holds one document, or with ``lines`` one document per line.
    """
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).text(
        root, wholetext=not lines).select("value", F.col("_metadata.file_path").alias("_path"))
    return _objects(text, schema).select("r.*", "_path")


def _objects(text: DataFrame, schema: str) -> DataFrame:
    """Texts that are JSON objects, parsed into the struct ``r``; the others are left out."""
    good = text.filter(F.json_object_keys("value").isNotNull())
    return good.withColumn("r", F.from_json("value", schema)).drop("value")


def read_questions(spark: SparkSession, root: str) -> DataFrame:
    """Question documents with ``number`` and ``subset`` taken from the path."""
    df = read_documents(spark, root, schemas.QUESTION, "question_*.json")
    number = F.regexp_extract("_path", r"question_(\d+)\.json", 1).try_cast("long")
    subset = F.regexp_extract("_path", r"/(single_table|multi_table|distractor_bank)/", 1)
    return df.select("*", number.alias("number"), subset.alias("subset")).filter("number is not null")


def read_result_logs(
    spark: SparkSession, root: str, schema: str = schemas.RECORD, name: str = "question_*.jsonl",
) -> DataFrame:
    """Result logs, files called ``name``: one (pretty-printed) object per file, or JSON lines.

    A file is taken line by line when its first line is already a whole object or the file as a
    whole is no object; lines that do not parse are left out. Each file is one question's log, so
    it is read as one value; logs that are JSON lines throughout go through :func:`read_log_lines`.
    """
    read = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name)
    return result_logs(read.text(root, wholetext=True).select(
        "value", F.col("_metadata.file_path").alias("_path")), schema)


def packed_logs(spark: SparkSession, path: str) -> DataFrame:
    """Log files packed by ``sinks.write_question_logs``: ``(value, _path)``, one row per file."""
    return spark.read.schema("path STRING, value STRING").parquet(path).select("value", F.col("path").alias("_path"))


def result_logs(files: DataFrame, schema: str = schemas.RECORD) -> DataFrame:
    """The records of log files given as rows ``(value, _path)``, see :func:`read_result_logs`."""
    lines = F.filter(F.split("value", r"\r?\n"), lambda l: F.trim(l) != "")
    whole = F.json_object_keys("value").isNotNull() & ~(
        (F.size("_lines") > 1) & F.json_object_keys(F.get("_lines", F.lit(0))).isNotNull())
    objects = files.withColumn("_lines", lines).select(
        "_path", F.explode(F.when(whole, F.array("value")).otherwise(F.col("_lines"))).alias("value"))
    return _objects(objects, schema).select("r.*", *_origin(F.col("_path")))


def read_log_lines(spark: SparkSession, root: str, schema: str = schemas.RECORD) -> DataFrame:
    """Logs in JSON lines form, read in splittable pieces."""
    lines = spark.read.option("recursiveFileLookup", True).text(root).select(
        "value", F.col("_metadata.file_path").alias("_path"))
    return _objects(lines, schema).select("r.*", *_origin(F.col("_path")))


def log_lines(files: DataFrame, schema: str = schemas.RECORD) -> DataFrame:
    """The records of logs in JSON lines form given as rows ``(value, _path)``, one file each."""
    lines = files.select("_path", F.explode(F.split("value", r"\r?\n")).alias("value"))
    return _objects(lines, schema).select("r.*", *_origin(F.col("_path")))


def _origin(path: Column) -> list[Column]:
    parts = F.split(path, "/")
    return [F.element_at(parts, -2).alias("source_dir"), F.element_at(parts, -1).alias("source_file")]


def new_datasets(
    datasets: DataFrame, stored: DataFrame, limit: int | None = None,
) -> DataFrame:
    """Datasets whose name is not stored yet as ``original_name``, by name, at most ``limit``."""
    fresh = datasets.join(
        stored.select(F.col("original_name").alias("dataset")), "dataset", "left_anti"
    ).orderBy("dataset")
    return fresh if limit is None else fresh.limit(limit)
