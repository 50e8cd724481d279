"""Event files: CSV with header, JSON arrays or objects, text lines, JSON lines.

All readers scan many files at once and keep going when one is bad. They return two frames: rows
(string columns ``metric, value, timestamp, meta`` with file and row number, not validated yet) and
one status row per file, whatever it holds. A broken layout fails the file; a bad value fails only its row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegauge.operators.joins import join_summary
from pulsegauge.operators.validate import checked_fields, checked_messages

REQUIRED = ("metric", "value", "timestamp")
FIELDS = (*REQUIRED, "meta")
ROW_COLUMNS = ("source", "row_num", *FIELDS, "raw")
# Accepted extensions, compared without regard to case, and the outcome texts of files.
EXTENSIONS = (".csv", ".json", ".txt")
BAD_EXTENSION = "Invalid file format. Supported: CSV, JSON, TXT"
BAD_HEADER = "CSV must contain columns: metric, value, timestamp"
BAD_LINE = "Expected at least 3 fields (metric,value,timestamp)"
BAD_JSON = "JSON must be an object or array of objects"
BAD_ENCODING = "Invalid file encoding. Please use UTF-8."


@dataclass(frozen=True)
class FileScan:
    """``rows`` of the readable files and ``files`` with ``source, error`` (NULL when readable)."""

    rows: DataFrame
    files: DataFrame

    def checked(self, allow_epoch: bool = False) -> DataFrame:
        return checked_fields(self.rows, allow_epoch)

    def union(self, other: FileScan) -> FileScan:
        return FileScan(self.rows.unionByName(other.rows), self.files.unionByName(other.files))


def _lines(spark: SparkSession, paths: list[str], pattern: str) -> DataFrame:
    """Text lines with their file, the split they came from, and their position in the scan."""
    return (
        spark.read.option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .text(paths)
        .select(
            F.col("_metadata.file_path").alias("source"),
            F.col("_metadata.file_block_start").alias("split"),
            F.is_valid_utf8("value").alias("utf8"),
            F.regexp_replace("value", "\r$", "").alias("line"),
        )
    )


def number_rows(rows: DataFrame, first: int = 1) -> DataFrame:
    """Number the rows of every file in file order, without sorting or gathering a file.

    Within one split the scan order is the file order, so a row's number is its distance from the
    first row of the split plus the row counts of the splits before it. Only the table of splits,
    which has one row per split, is windowed and joined back.
    """
    placed = rows.withColumn("position", F.monotonically_increasing_id())
    splits = placed.groupBy("source", "split").agg(
        F.min("position").alias("start"), F.count(F.lit(1)).alias("held")
    )
    before = Window.partitionBy("source").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select(
        "source", "split", (F.coalesce(F.sum("held").over(before), F.lit(0)) - F.col("start") + first).alias("offset")
    )
    return (
        join_summary(placed, offsets, ["source", "split"], salt=["position"])
        .withColumn("row_num", (F.col("position") + F.col("offset")).cast("bigint"))
        .drop("position", "offset", "split")
    )


def csv_fields(line: Column) -> Column:
    """The fields of one CSV record as an array; a doubled quote inside a quoted field is one quote.

    One expression for every header, so neither the plan nor the driver depends on the headers there are.
    """
    parts = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(r',(?:"[^"]*+(?:""[^"]*+)*+"[^,]*|[^,]*)'), F.lit(0))
    quoted = r'^,"([^"]*+(?:""[^"]*+)*+)"(.*)$'
    inner = lambda p: F.replace(F.regexp_extract(p, "(?s)" + quoted, 1), F.lit('""'), F.lit('"'))
    plain = lambda p: F.substring(p, 2, 1 << 30)
    return F.transform(
        parts,
        lambda p: F.when(p.rlike("(?s)" + quoted), F.concat(inner(p), F.regexp_extract(p, "(?s)" + quoted, 2))).otherwise(plain(p)),
    )


def _listed(spark: SparkSession, paths: list[str], pattern: str) -> DataFrame:
    """One row per file, also of those without a byte, which no scan shows.

    The names come from the file index, which a scan of these paths builds on the driver anyway.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(paths)
    names = [re.sub("^file:/+", "file:/", name) for name in found.inputFiles()]  # as the scan's metadata writes them
    return spark.createDataFrame([(name,) for name in names], "source string")


def _spanning_records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Records of CSV files in which quoted fields hold line ends, numbered from the header (0).

    Where a record ends depends on all before it, so such a file is one task, as a JSON file is.
    """
    text = spark.read.text(paths, wholetext=True).select(
        F.col("_metadata.file_path").alias("source"), F.is_valid_utf8("value").alias("utf8"),
        F.concat(F.lit("\n"), F.replace("value", F.lit("\r\n"), F.lit("\n"))).alias("value"),
    )
    records = F.regexp_extract_all("value", F.lit(r'\n(?:[^"\n]++|"[^"]*+")*+(?:"[^"]*+)?'), F.lit(0))
    lines = F.filter(F.transform(records, lambda r: F.substring(r, 2, 1 << 30)), lambda r: F.trim(r) != "")
    return text.select("source", "utf8", F.posexplode(lines).alias("row_num", "line")).withColumn("row_num", F.col("row_num").cast("bigint"))


def read_csv(spark: SparkSession, paths: list[str], header: list[str] | None = None) -> FileScan:
    """CSV files with a header line; columns in any order, extra columns ignored.

    Files may have different headers; ``header`` names the one that all share. Files are split into
    lines; only those in which a quoted field is still open at a line's end are read again as a whole, and
    their names come to the driver for that.
    """
    pattern = "*.[cC][sS][vV]"
    lines = _lines(spark, paths, pattern)
    is_open = F.col("line").rlike(r'(?:^|,)"[^"]*+(?:""[^"]*+)*+$')
    spanning = [r["source"] for r in lines.filter(is_open).select("source").distinct().collect()]
    split = lines.filter((F.trim("line") != "") & ~F.col("source").isin(spanning)) if spanning else lines.filter(F.trim("line") != "")
    numbered = number_rows(split, first=0).select("source", "row_num", "utf8", "line")
    if spanning:
        numbered = numbered.unionByName(_spanning_records(spark, spanning))
    first_line = F.max(F.when(F.col("row_num") == 0, F.regexp_replace("line", "^\ufeff", "")))
    head = first_line if header is None else F.lit(",".join(header))
    heads = numbered.groupBy("source").agg(csv_fields(head).alias("names"), F.bool_and("utf8").alias("utf8"))
    known = F.forall(F.array(*map(F.lit, REQUIRED)), lambda f: F.array_contains("names", f))
    error = F.when(~F.col("utf8"), F.lit(BAD_ENCODING)).when(~known, F.lit(BAD_HEADER))
    heads = heads.withColumn("error", error)
    listed = _listed(spark, paths, pattern).join(heads.withColumn("seen", F.lit(True)), "source", "left")
    files = listed.select("source", F.when(F.col("seen").isNull(), F.lit(BAD_HEADER)).otherwise(F.col("error")).alias("error"))
    readable = heads.filter("error IS NULL").select("source", "names")
    rows = join_summary(numbered.filter(F.col("row_num") > 0).drop("utf8"), readable, ["source"], salt=["row_num"])
    rows = rows.withColumn("fields", csv_fields(F.col("line")))
    # a name that occurs twice means its last column, as in a dictionary of the row
    place = lambda f: F.size("names") - F.array_position(F.reverse("names"), f)
    pick = lambda f: F.when(F.array_contains("names", f), F.get("fields", place(f).cast("int")))
    rows = rows.select("source", "row_num", *[pick(f).alias(f) for f in FIELDS], F.col("line").alias("raw"))
    return FileScan(rows.select(*ROW_COLUMNS), files)


def read_txt(spark: SparkSession, paths: list[str], meta_rest: bool = False) -> FileScan:
    """Text lines split on commas if there is one, else on tabs; ``#`` lines and blanks skipped.

    The fourth field is the metadata. JSON with commas is cut by the split; ``meta_rest`` takes
    everything after the third separator instead.
    """
    pattern = "*.[tT][xX][tT]"
    lines = _lines(spark, paths, pattern).withColumn("line", F.trim("line"))
    kept = lines.filter((F.col("line") != "") & ~F.col("line").startswith("#"))
    limit = 4 if meta_rest else -1
    parts = F.when(F.col("line").contains(","), F.split("line", ",", limit)).otherwise(F.split("line", "\t", limit))
    split = number_rows(kept).withColumn("parts", parts)
    error = F.when(~F.bool_and("utf8"), F.lit(BAD_ENCODING)).when(
        F.min(F.size("parts")) < len(REQUIRED), F.lit(BAD_LINE)
    )
    status = split.groupBy("source").agg(error.alias("error"))
    sound = status.filter(F.col("error").isNull()).select("source")
    # a file of blanks, comments or nothing is readable and has no rows
    status = _listed(spark, paths, pattern).join(status, "source", "left")
    rows = join_summary(split, sound, ["source"], salt=["row_num"]).select(
        "source", "row_num",
        *[F.trim(F.try_element_at("parts", F.lit(i + 1))).alias(f) for i, f in enumerate(FIELDS)],
        F.col("line").alias("raw"),
    )
    return FileScan(rows, status)


def read_json(spark: SparkSession, paths: list[str], pattern: str = "*.[jJ][sS][oO][nN]") -> FileScan:
    """Files that hold one JSON array of events or one event object.

    A JSON array cannot be split, so each file is one task: this format suits many files of
    moderate size. Large inputs belong in JSON lines (``read_jsonl``), which split freely.
    """
    docs = (
        spark.read.option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .text(paths, wholetext=True)
        .select(
            F.col("_metadata.file_path").alias("source"),
            F.is_valid_utf8("value").alias("utf8"),
            F.when(F.is_valid_utf8("value"), F.try_parse_json("value")).alias("doc"),
        )
    )
    kind = F.schema_of_variant("doc")
    usable = F.coalesce(kind.rlike("^(OBJECT|ARRAY)"), F.lit(False))
    text = F.when(kind.startswith("ARRAY"), F.to_json("doc")).otherwise(F.concat(F.lit("["), F.to_json("doc"), F.lit("]")))
    items = docs.filter(usable).select("source", F.posexplode(F.from_json(text, "array<string>")).alias("pos", "raw"))
    item = items.withColumn("item", F.try_parse_json("raw"))
    rows = item.select(
        "source", (F.col("pos") + 1).cast("bigint").alias("row_num"),
        *[F.try_variant_get("item", f"$.{f}", "string").alias(f) for f in FIELDS],
        "raw",
    )
    error = F.when(~F.col("utf8"), F.lit(BAD_ENCODING)).when(~usable, F.lit(BAD_JSON))
    files = docs.select("source", error.alias("error"))
    return FileScan(rows.select(*ROW_COLUMNS), files)


def read_jsonl(spark: SparkSession, paths: list[str], pattern: str = "*.jsonl") -> DataFrame:
    """JSON-lines messages, one event per line, checked under the message rules."""
    lines = _lines(spark, paths, pattern).withColumn("raw", F.trim("line")).filter(F.col("raw") != "")
    return checked_messages(number_rows(lines).select("source", "row_num", "raw"))


READERS = {".csv": read_csv, ".json": read_json, ".txt": read_txt}
NO_FILE = "File not found"


def extension(path: str) -> str | None:
    """The accepted extension of a path, or None."""
    return next((e for e in EXTENSIONS if path.lower().endswith(e)), None)


def _looked_up(spark: SparkSession, path: str) -> list[tuple[str, bool]]:
    """What the file system has under a path or pattern: (path, whether it is a folder)."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(place)
    return [(str(f.getPath()), f.isDirectory()) for f in found or []]


def read_files(spark: SparkSession, paths: list[str]) -> FileScan:
    """Read files of mixed formats by extension; one scan per format, results united.

    Every path has an outcome: an absent one, a file of another format, and each such file inside a
    folder is listed as failed, and the others are still read.
    """
    if not paths:
        raise ValueError("no files provided")
    entries = [(p, _looked_up(spark, p)) for p in dict.fromkeys(paths)]
    found = [e for _, looked in entries for e in looked]
    folders = [p for p, is_folder in found if is_folder]
    single = [p for p, is_folder in found if not is_folder]
    failed = [(p, NO_FILE if extension(p) else BAD_EXTENSION) for p, looked in entries if not looked] + [(p, BAD_EXTENSION) for p in single if extension(p) is None]
    listed = {e: [p for p in single if extension(p) == e] for e in EXTENSIONS}
    scans = [READERS[e](spark, [*own, *folders]) for e, own in listed.items() if own or folders]
    empty = spark.createDataFrame([], "source string, row_num bigint, metric string, value string, timestamp string, meta string, raw string")
    if failed:
        scans.append(FileScan(empty, spark.createDataFrame(failed, "source string, error string")))
    if folders:
        others = _listed(spark, folders, "*").filter(~F.lower("source").rlike(r"\.(csv|json|txt)$"))
        scans.append(FileScan(empty, others.select("source", F.lit(BAD_EXTENSION).alias("error"))))
    scan, *rest = scans
    for more in rest:
        scan = scan.union(more)
    return scan
