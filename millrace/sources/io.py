"""Readers and writers of corpora: JSON lines, CSV, Parquet, held-out lists, vocabularies, metric logs."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructField, StructType

#: language -> split of the monolingual collection
MONOLINGUAL_SPLITS = {
    "as": "asm_Beng", "bn": "ben_Beng", "brx": "brx_Deva", "doi": "doi_Deva", "gom": "gom_Deva", "gu": "guj_Gujr", "hi": "hin_Deva", "kha": "khasi", "kn": "kan_Knda", "ks": "kas_Arab", "mai": "mai_Deva",
    "ml": "mal_Mlym", "mr": "mar_Deva", "ne": "npi_Deva", "or": "ory_Orya", "pa": "pan_Guru", "sa": "san_Deva", "sat": "santhali", "sd": "snd_Deva", "ta": "tam_Taml", "te": "tel_Telu", "ur": "urd_Arab",
}


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): the lines of JSON lines files, counted from 1 in each file.

    Files are read in splits: lines are numbered within a split, and splits by the lines of those before them.
    """
    texts = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{jsonl,json}").text(path)
    lines = texts.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_at"), "value")
    before = Window.partitionBy("file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    splits = lines.groupBy("file", "_split").agg(F.count("*").alias("_n")).select("file", "_split", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_ahead"))
    within = F.row_number().over(Window.partitionBy("file", "_split").orderBy("_at"))
    return lines.withColumn("_within", within).join(splits, ["file", "_split"]).select("file", (F.col("_ahead") + F.col("_within")).alias("line"), "value")


def read_json_lines(spark: SparkSession, path: str, schema: StructType | str, malformed: str = "fail") -> DataFrame:
    """Rows of a directory of JSON lines with _input_file, _input_line and ordinal; blank lines are passed over.

    Values of the two columns that the data itself has win. A line that is no JSON object is an error; with
    malformed="keep" it is a row of nulls with its text in the column _malformed.
    """
    if malformed not in ("fail", "keep"):
        raise ValueError("malformed lines fail or are kept")
    lines = _numbered_lines(spark, path).where(F.col("value").rlike("\\S"))
    wanted = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    bad = StructField("_malformed", StringType())
    parsed = lines.select("file", "line", F.from_json("value", StructType([*wanted.fields, bad]), {"columnNameOfCorruptRecord": "_malformed"}).alias("r"))
    own = {f.name for f in wanted.fields}
    columns = [F.col(f"r.`{f.name}`") for f in wanted.fields if f.name not in ("_input_file", "_input_line")]
    file = F.coalesce(F.col("r._input_file"), F.col("file")) if "_input_file" in own else F.col("file")
    line = F.coalesce(F.col("r._input_line").cast("long"), F.col("line")) if "_input_line" in own else F.col("line")
    rows = parsed.select(*columns, file.alias("_input_file"), line.alias("_input_line"), F.struct(F.col("file").alias("path"), F.col("line")).alias("ordinal"), F.col("r._malformed").alias("_malformed"))
    if malformed == "keep":
        return rows
    wrong = F.raise_error(F.concat(F.lit("not a JSON object: "), "ordinal.path", F.lit(" line "), F.col("ordinal.line").cast("string")))
    return rows.withColumn("ordinal", F.when(F.col("_malformed").isNull(), F.col("ordinal")).otherwise(wrong)).drop("_malformed")


def numbered(rows: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """rows with number, from 0 in the order of their files' paths and lines: rows are counted within each file, and
    files, a row each, before one another."""
    before = Window.orderBy("_path").rowsBetween(Window.unboundedPreceding, -1)
    files = rows.groupBy(F.col(f"{ordinal}.path").alias("_path")).agg(F.count("*").alias("_n")).select("_path", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_ahead"))
    within = F.row_number().over(Window.partitionBy(f"{ordinal}.path").orderBy(f"{ordinal}.line")) - 1
    return rows.withColumn("_within", within).join(files, F.col(f"{ordinal}.path") == F.col("_path")).withColumn("number", F.col("_ahead") + F.col("_within")).drop("_path", "_ahead", "_within")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of CSV files with a header, all columns strings."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").csv(path, header=True, inferSchema=False, multiLine=True, escape='"')
    return rows.withColumn("_input_file", F.col("_metadata.file_path"))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{parquet,pq}").parquet(path)
    return rows.withColumn("_input_file", F.col("_metadata.file_path"))


def read_local(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of all JSON lines, CSV and Parquet files below a directory, by name of their columns; other files are passed
    over. A column that files hold in several types takes the type of the schema."""
    wanted = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    present = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.lower(F.regexp_extract("path", "[.]([^.]+)$", 1)).alias("kind")).distinct()
    kinds = {r["kind"] for r in present.collect()}  # a row for each kind of file
    parts = []
    if kinds & {"jsonl", "json"}:
        parts.append(read_json_lines(spark, path, wanted).drop("ordinal"))
    if "csv" in kinds:
        parts.append(read_csv(spark, path))
    if kinds & {"parquet", "pq"}:
        parts.append(read_parquet(spark, path))
    if not parts:
        raise ValueError(f"no readable file below {path}")
    types = {f.name: f.dataType for f in wanted.fields}
    out = None
    for part in parts:
        part = part.select(*[F.col(f"`{c}`").cast(types[c]).alias(c) if c in types else F.col(f"`{c}`") for c in part.columns])
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def snapshot(spark: SparkSession, path: str, fetch: Callable[[], DataFrame], refresh: bool = False) -> DataFrame:
    """The table at path; fetched and written there first where it is not, or to be refreshed."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    if refresh or not there:
        fetch().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def read_languages(spark: SparkSession, root: str, languages: list[str], monolingual: bool = False) -> DataFrame:
    """The parts of a local collection, one directory for each language (or its split), tagged _language."""
    unknown = [x for x in languages if monolingual and x not in MONOLINGUAL_SPLITS]
    if unknown:
        raise ValueError(f"no split for {', '.join(unknown)}")
    out = None
    for x in languages:
        part = spark.read.parquet(f"{root}/{MONOLINGUAL_SPLITS[x] if monolingual else x}").withColumn("_language", F.lit(x))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no languages")
    return out


def is_monolingual(dataset: str) -> bool:
    return "indiccorp" in dataset.lower()


def split_buffers(buffer: int, splits: int, seed: int) -> list[tuple[int, int]]:
    """(buffer size, seed) of each split."""
    return [(max(1000, buffer // max(splits, 1)), seed + k + 1) for k in range(splits)]


def read_heldout(spark: SparkSession, path: str) -> DataFrame:
    """(text): the lines of a held-out list that are not blank."""
    return spark.read.text(path).select(F.col("value").alias("text")).where(F.trim("text") != "")


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(id, piece, score) of a vocabulary of tab-separated pieces; ids are line numbers from 0. One file, read whole."""
    text = spark.read.text(path, wholetext=True)
    lines = text.select(F.posexplode(F.filter(F.split("value", "\n"), lambda x: x != "")).alias("id", "_l"))
    return lines.select("id", F.split("_l", "\t")[0].alias("piece"), F.split("_l", "\t")[1].cast("double").alias("score"))


def read_metrics(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a metric log that have both a gradient norm and a loss; an error where there are none."""
    rows = spark.read.schema(schema).json(path).where("grad_norm_pre_clip is not null and loss is not null")
    if rows.isEmpty():
        raise ValueError("no training rows")
    return rows


def _sorted(c: Column, kind: DataType) -> Column:
    """A value with the fields of its structs and the keys of its maps in the order of their names, at every depth."""
    if isinstance(kind, StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        return F.when(c.isNotNull(), F.struct(*[_sorted(c[f.name], f.dataType).alias(f.name) for f in fields]))
    if isinstance(kind, ArrayType):
        return F.transform(c, lambda x: _sorted(x, kind.elementType))
    if isinstance(kind, MapType):
        return F.map_from_entries(F.array_sort(F.map_entries(c)))
    return c


def json_of(c: Column, kind: DataType) -> Column:
    """A struct as compact JSON with sorted keys at every depth, nulls included."""
    return F.to_json(_sorted(c, kind), {"ignoreNullFields": "false"})


def canonical_json(df: DataFrame) -> DataFrame:
    """(value): each row as compact JSON with sorted keys, nulls included."""
    return df.select(json_of(F.struct(*[F.col(f"`{c}`") for c in df.columns]), df.schema).alias("value"))


def write_json(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Canonical JSON lines; a path that exists is an error unless it may be overwritten."""
    canonical_json(df).write.mode("overwrite" if overwrite else "errorifexists").text(path)


def write_document(spark: SparkSession, document: dict, path: str, overwrite: bool = False) -> None:
    """One indented JSON document with sorted keys: manifests, summaries and comparisons."""
    text = json.dumps(document, ensure_ascii=False, indent=2, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite" if overwrite else "errorifexists").text(path)


def read_document(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).where("value <> ''").first()["value"])


def write_tokenizer(spark: SparkSession, metrics: dict, vocabulary: DataFrame, path: str, overwrite: bool = False) -> None:
    """path/metrics (a document), path/tokens_json and path/tokens_tsv for a vocabulary (id, piece, score)."""
    mode = "overwrite" if overwrite else "errorifexists"
    write_document(spark, metrics, f"{path}/metrics", overwrite)
    rows = vocabulary.select("id", F.col("piece").alias("token"), "score").orderBy("id")
    canonical_json(rows).write.mode(mode).text(f"{path}/tokens_json")
    rows.select(F.concat_ws("\t", F.col("id").cast("string"), "token", F.format_string("%.8f", "score")).alias("value")).write.mode(mode).text(f"{path}/tokens_tsv")


def write_split(decided: DataFrame, path: str, overwrite: bool = False) -> None:
    """Accepted and rejected rows, each once, from one pass: partitioned by their fate."""
    fate = F.when(F.size("reasons") == 0, "accepted").otherwise("rejected")
    decided.withColumn("fate", fate).write.partitionBy("fate").mode("overwrite" if overwrite else "errorifexists").parquet(path)


def write_window(records: DataFrame, path: str) -> None:
    """The rows of a transition window as one CSV file with a header; missing columns are empty."""
    names = ["step", "tokens", "phase", "transition_mode", "fineweb_share", "indic_share", "loss", "grad_norm_pre_clip", "learning_rate", "tokens_per_second"]
    rows = records.select(*[F.col(c) if c in records.columns else F.lit(None).cast("string").alias(c) for c in names])
    rows.coalesce(1).sortWithinPartitions("step").write.mode("overwrite").csv(path, header=True)


def append_metrics(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def latest(paths: DataFrame, n: int = 1, column: str = "path") -> DataFrame:
    """The n paths with the highest number at their end."""
    return paths.withColumn("_n", F.regexp_extract(column, "(\\d+)$", 1).try_cast("long")).orderBy(F.desc_nulls_last("_n"), column).limit(n).drop("_n")
