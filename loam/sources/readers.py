"""Reading JSON collections of any of the known forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions.text import article_number, nonempty, strip
from loam.operators.messages import MESSAGES, last_of, question_of
from loam.sources.arrays import elements, first_characters

#: Code of a collection by patterns in its file's name, in order.
CODES = [("gk", "actual_gk|gk_rf"), ("nk", "actual_nk|nk_rf"), ("tk", "actual_tk|tk_rf"), ("koap", "actual_koap|koap"), ("apk", "apk_rf")]
RECORD = ["source_id", "group_id", "code", "article_number", "raw_case", "raw_article", "is_messages_format", "file_name", "item_idx"]


def code_of(name: Column, codes: list[tuple[str, str]] = CODES) -> Column:
    out = F.lit(None).cast("string")
    for code, pattern in reversed(codes):
        out = F.when(name.rlike(f"(?i){pattern}"), code).otherwise(out)
    return out


def items(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """file_name, item_idx and item (JSON text) of all files of a folder that hold an array or a single object. Hidden files are skipped, and so are broken items; large files are read by many tasks."""
    found = elements(spark, path, glob).filter(~F.col("file_name").startswith("."))
    return found.filter(F.expr("try_parse_json(item)").isNotNull())


def records(raw: DataFrame) -> DataFrame:
    """Ingested records of items (file_name, code, item_idx, item) of the four forms: bare messages, messages, case/article, title/content. Others go."""
    v = F.expr("try_parse_json(item)")
    rows = raw.withColumn("_v", v)
    get = lambda path, kind: F.expr(f"try_variant_get(_v, '{path}', '{kind}')")
    rows = rows.withColumns({"_m": F.coalesce(get("$", MESSAGES), get("$.messages", MESSAGES)), **{f"_{k}": get(f"$.{k}", "string") for k in ("case", "article", "title", "content")}})
    has = lambda *names: F.array_contains(F.coalesce(F.json_object_keys("item"), F.array().cast("array<string>")), names[0]) if len(names) == 1 else has(names[0]) | has(*names[1:])
    form = F.when(F.col("_m").isNotNull(), "messages").when(has("case", "article"), "pair").when(has("title", "content"), "titled")
    rows = rows.withColumn("_form", form).filter(F.col("_form").isNotNull())
    text = lambda name: F.coalesce(F.col(name), F.lit(""))
    number, asked = question_of(F.col("code"), text("_title"), text("_content"))
    case = F.when(F.col("_form") == "messages", F.coalesce(last_of(F.col("_m"), "user"), F.lit(""))).when(F.col("_form") == "pair", text("_case")).otherwise(asked)
    article = F.when(F.col("_form") == "messages", F.coalesce(last_of(F.col("_m"), "assistant"), F.lit(""))).when(F.col("_form") == "pair", text("_article")).otherwise(text("_content"))
    rows = rows.withColumns({"raw_case": case, "raw_article": article})
    own = F.when(F.col("_form") == "messages", article_number(F.col("raw_article"))).when(F.col("_form") == "pair", article_number(F.coalesce(nonempty(F.col("raw_article")), F.col("raw_case")))).otherwise(number)
    rows = rows.withColumn("article_number", own)
    stem = F.regexp_replace("file_name", r"\.[^.]*$", "")
    return rows.select(F.concat_ws("_", stem, F.col("item_idx").cast("string")).alias("source_id"), F.concat_ws("_", "code", "article_number").alias("group_id"), "code", "article_number", "raw_case", "raw_article", (F.col("_form") == "messages").alias("is_messages_format"), "file_name", "item_idx")


def raw_directory(spark: SparkSession, path: str, codes: list[tuple[str, str]] = CODES) -> DataFrame:
    """Records of all JSON files of a folder whose names tell a code."""
    return records(items(spark, path).withColumn("code", code_of(F.col("file_name"), codes)).filter(F.col("code").isNotNull())).select(*RECORD)


def texts(spark: SparkSession, path: str, strict: bool) -> DataFrame:
    """value: the lines of JSONL files, and the elements of files that hold one array, of a path that exists.

    Tasks look at the first character of each file; the driver gets one character a file. Large files of both
    kinds are split. strict fails where an array isn't closed or has a blank element.
    """
    first = first_characters(spark, path).collect()
    arrays = [r["path"] for r in first if r["first"] == "["]
    others = [r["path"] for r in first if r["first"] != "["]
    out = spark.createDataFrame([], "value string")
    if others:
        out = out.unionByName(spark.read.text([unquoted(f) for f in others]).select(F.regexp_replace("value", "^\ufeff", "").alias("value")))
    if arrays:
        out = out.unionByName(elements(spark, [unquoted(f) for f in arrays], strict=strict).select(F.col("item").alias("value")))
    return out


def unquoted(uri: str) -> str:
    """The path of a file's URI, whose name may hold quoted characters."""
    from urllib.parse import unquote

    return unquote(uri)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """item of JSONL files, or of files that hold one array; blank and broken lines are skipped, a missing path gives no rows."""
    from pyspark.errors import AnalysisException

    try:
        out = texts(spark, path, False)
    except AnalysisException:
        out = spark.createDataFrame([], "value string")
    return out.select(F.col("value").alias("item")).filter((strip(F.col("item")) != "") & F.expr("try_parse_json(item)").isNotNull())


def with_fields(rows: DataFrame, names: list[str]) -> DataFrame:
    """String fields of item (JSON) as columns; null where there is none."""
    return rows.withColumns({n: F.expr(f"try_variant_get(try_parse_json(item), '$.{n}', 'string')") for n in names})


def record_array(spark: SparkSession, path: str) -> DataFrame:
    """The objects of an array file with all their fields."""
    return spark.read.json(path, multiLine=True)


def training_records(spark: SparkSession, path: str) -> DataFrame:
    """item and messages of JSONL (compressed too) or array files. Blank lines and lines that begin with ``#`` are skipped; any other line that is no JSON object fails the job."""
    rows = texts(spark, path, True).select(strip(F.col("value")).alias("item")).filter((F.col("item") != "") & ~F.col("item").startswith("#"))
    kind = F.expr("schema_of_variant(parse_json(item))")
    rows = rows.withColumn("item", F.when(kind.startswith("OBJECT"), F.col("item")).otherwise(F.raise_error(F.concat(F.lit("no JSON object: "), F.left("item", F.lit(80))))))
    return rows.withColumn("messages", F.expr(f"try_variant_get(try_parse_json(item), '$.messages', '{MESSAGES}')"))


def articles(spark: SparkSession, path: str) -> DataFrame:
    """url, title, content of an array file, which is read by many tasks where it is large; broken elements have nulls."""
    found = elements(spark, path).withColumn("x", F.from_json("item", "url string, title string, content string"))
    return found.select("x.*")


def articles_lines(spark: SparkSession, path: str) -> DataFrame:
    """url, title, content of JSONL files, which are split where they are large."""
    return spark.read.schema("url string, title string, content string").json(path)


def file_map(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    """Articles of the files that exist, with the name each is listed under, in listed order."""
    from pyspark.errors import AnalysisException

    out = None
    for i, (path, name) in enumerate(files.items()):
        try:
            found = elements(spark, path).withColumn("x", F.from_json("item", "title string, content string"))
            part = found.select("x.*", F.lit(name).alias("law_name"), F.lit(i).alias("file_no"))
        except AnalysisException:
            continue
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], "title string, content string, law_name string, file_no int") if out is None else out
