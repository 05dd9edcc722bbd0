"""Files as rows: scans of folders, documents in JSON or YAML, schema files, and what is written back."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdoc.sources.shared import written

try:
    import yaml
except ImportError:  # YAML documents are unreadable then
    yaml = None

#: Folders that scans leave out, source files that hold routes or schemas, files that a run's inputs include by name.
IGNORED_FOLDERS = ("node_modules", ".git", "dist", ".next", ".turbo", ".cache")
SOURCE_FILES = r"\.(tsx?|jsx?|mjs)$"
CONFIG_FILES = ("tsconfig.json", "package.json", "pnpm-lock.yaml", "package-lock.json", "yarn.lock")


def scan_files(spark: SparkSession, root: str, pattern: str = SOURCE_FILES, contents: bool = False) -> DataFrame:
    """``file``, ``size``, ``modified`` (and ``content``) of the files below a folder whose path fits, without ignored folders; each once. File listing and reading are Spark's."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    kept = found.where(F.col("path").rlike(pattern) & ~ignored(F.col("path")))
    columns = [F.col("path").alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("modified")]
    return kept.select(*columns, *([F.col("content").cast("string").alias("content")] if contents else []))


def ignored(path: Column) -> Column:
    """Whether a path lies in an ignored folder."""
    return path.rlike("/(" + "|".join(x.replace(".", r"\.") for x in IGNORED_FOLDERS) + ")(/|$)")


def ignored_folders(spark: SparkSession, root: str) -> DataFrame:
    """The outermost ignored folders that hold a file, once each; Spark lists no folder whose name begins with a dot."""
    name = "|".join(x.replace(".", r"\.") for x in IGNORED_FOLDERS)
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.regexp_extract("path", rf"^(.*?/(?:{name}))/", 1).alias("folder")).where("folder <> ''").distinct()


def file_name_matches(path: Column, extensions: Sequence[str], pattern: str | None = None) -> Column:
    """Whether a file has one of the extensions and, if given, its name fits the pattern."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    ends = name.rlike("(" + "|".join(e.replace(".", r"\.") for e in extensions) + ")$")
    return ends & name.rlike(pattern) if pattern else ends


def exports_handler(content: Column, names: Sequence[str]) -> Column:
    """A cheap look at a source text: does it export one of the names, or a default."""
    return content.rlike(r"export\s+(default\b|(async\s+)?(function|const|let|var)\s+(" + "|".join(names) + r")\b|\{[^}]*\b(" + "|".join(names) + r")\b)")


def calls_router(content: Column) -> Column:
    """A cheap look at a source text: does it call a router's method."""
    return content.rlike(r"\.(get|post|put|patch|delete|options|head|all|on|use|route|basePath)\s*\(")


def inputs(parts: Sequence[DataFrame], without: DataFrame) -> DataFrame:
    """All files of several scans once, less those of ``without`` (``file``)."""
    every = parts[0].select("file")
    for part in parts[1:]:
        every = every.unionByName(part.select("file"))
    return every.distinct().join(without.select("file"), "file", "left_anti")


def file_hashes(spark: SparkSession, root: str) -> DataFrame:
    """SHA-256 of every file's bytes."""
    return scan_files(spark, root, r".").select("file").join(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.col("path").alias("file"), F.sha2("content", 256).alias("hash")), "file")


def _yaml_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for text in batch["content"]:
            try:
                out.append(json.dumps(yaml.safe_load(text), default=str, allow_nan=False))
            except Exception:  # noqa: BLE001  any broken document is a row with a null text
                out.append(None)
        yield pd.DataFrame({"file": batch["file"], "content": pd.Series(out, dtype=object)})


def documents(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``doc`` (VARIANT) and ``problem`` of JSON and YAML files: null documents say whether they are of another kind or can't be read."""
    read = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("content"))
    is_yaml, is_json = F.lower("file").rlike(r"\.ya?ml$"), F.lower("file").rlike(r"\.json$")
    texts = read.where(is_json).unionByName(read.where(is_yaml).mapInPandas(_yaml_rows, "file string, content string")) if yaml else read.where(is_json)
    good = texts.select("file", F.try_parse_json("content").alias("doc")).withColumn("problem", F.when(F.col("doc").isNull(), "unreadable"))
    other = read.where(~is_json & ~is_yaml if yaml else ~is_json).select("file", F.lit(None).cast("variant").alias("doc"), F.lit("unsupported").alias("problem"))
    return good.unionByName(other)


def schema_files(docs: DataFrame, order: str = "file") -> DataFrame:
    """Schemas ``(name, schema)`` of documents: under ``components.schemas``, ``schemas``, or the whole document; of a name the last file's."""
    inner = F.coalesce(F.try_variant_get("doc", "$.components.schemas", "variant"), F.try_variant_get("doc", "$.schemas", "variant"), F.col("doc"))
    found = docs.where("doc IS NOT NULL").select(order, inner.alias("__s"))
    found = found.lateralJoin(found.sparkSession.tvf.variant_explode(F.col("__s").outer()).toDF("__pos", "name", "schema")).where("name IS NOT NULL")
    return found.groupBy("name").agg(F.max_by("schema", order).alias("schema"))


def with_list(docs: DataFrame, member: str) -> tuple[DataFrame, DataFrame]:
    """Documents that hold a list under a member (``actions`` of overlays, ``workflows``), and the others, whose loading fails."""
    good = F.coalesce(F.schema_of_variant(F.try_variant_get("doc", f"$.{member}", "variant")).startswith("ARRAY"), F.lit(False))
    return docs.where(good), docs.where(~good)


def serialized(doc: Column, kind: str = "json") -> Column:
    """A JSON text as it is written: indented by two with a newline at its end, or YAML of 120 columns without anchors. Unreadable text gives null."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            try:
                value = json.loads(text)
            except (TypeError, ValueError):
                out.append(None)
                continue
            out.append(json.dumps(value, indent=2, ensure_ascii=False) + "\n" if kind == "json" else yaml.dump(value, Dumper=_plain(), width=120, sort_keys=False, allow_unicode=True))
        return pd.Series(out, dtype=object)

    return run(doc)


def _plain():
    class Plain(yaml.SafeDumper):
        def ignore_aliases(self, data):
            return True

    return Plain


def write_documents(docs: DataFrame, folder: str, text: str = "text", name: str = "name") -> None:
    """Texts as files of a folder for each name; Spark's committer renames what is complete, so a reader never sees half a file. Earlier files of the same names go."""
    docs.select(F.col(text).alias("value"), F.col(name).alias("name")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("lineSep", "\n").partitionBy("name").text(folder)


def _named_writer(folder: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        made = set()
        for batch in batches:
            sizes = []
            for name, text in zip(batch["name"], batch["text"], strict=True):
                place = f"{root}/{name}"
                parent = place.rpartition("/")[0]
                if parent not in made:
                    system.create_dir(parent, recursive=True)
                    made.add(parent)
                data = text.encode()
                # beside its place first, under a name of this try, then moved: a reader sees the old file or the new one
                part = f"{parent}/.{uuid.uuid4().hex}.part"
                with system.open_output_stream(part) as file:
                    file.write(data)
                system.move(part, place)
                sizes.append(len(data))
            yield pd.DataFrame({"name": batch["name"], "bytes": sizes})

    return run


def write_named(docs: DataFrame, folder: str, text: str = "text", name: str = "name") -> DataFrame:
    """Each text as one file of its own name (which may hold folders) below ``folder``, written by the tasks into that shared place; returns ``(name, bytes)`` of what was written.

    Of texts of one name the least counts, null texts and names are left out, names that lead out of the folder are an error. A file appears whole or not at all, and a task that runs again writes the same files again.
    """
    rows = docs.where(F.col(name).isNotNull() & F.col(text).isNotNull()).groupBy(F.col(name).alias("name")).agg(F.min(text).alias("text"))
    inside = F.when(F.col("name").rlike(r"(^|/)\.\.?(/|$)|^/|^$|/$"), F.raise_error(F.concat(F.lit("no name of a file: "), "name"))).otherwise(F.col("name"))
    return written(rows.select(inside.alias("name"), "text").mapInPandas(_named_writer(folder), "name string, bytes long"), "named-files")


def write_record(rows: DataFrame, folder: str) -> None:
    """A run's state (fingerprints, fragments) as a Parquet table, committed whole."""
    rows.write.mode("overwrite").parquet(folder)


def write_manifest(diagnostics: DataFrame, timings: DataFrame, folder: str) -> None:
    """Diagnostics and phase times as JSON lines, told apart by ``kind``."""
    both = diagnostics.select(F.lit("diagnostic").alias("kind"), F.to_json(F.struct(*diagnostics.columns)).alias("row")).unionByName(timings.select(F.lit("timing").alias("kind"), F.to_json(F.struct(*timings.columns)).alias("row")))
    both.write.mode("overwrite").json(folder)
