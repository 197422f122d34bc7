"""Readers and writers: JSON lines, layout JSON, PDF discovery, snapshots of table sets, a SQLite catalog, benchmarks."""

from __future__ import annotations

import json
import re
import sqlite3
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as X

from folioscan.functions import text as T

DOCUMENT = X.StructType([X.StructField("page_content", X.StringType()), X.StructField("metadata", X.MapType(X.StringType(), X.StringType()))])
#: Captions and boxes are read as raw JSON, since parsers write lists or single texts.
CAPTIONS = ("image_caption", "image_footnote", "img_caption", "img_footnote", "table_caption", "table_footnote")
LAYOUT = X.StructType([*[X.StructField(k, X.StringType()) for k in ("type", "text", "content", "latex", "markdown", "md", "html", "img_path", "table_body", "page_idx", "bbox", *CAPTIONS)]])


def read_jsonl(spark: SparkSession, path: str, schema: X.StructType) -> DataFrame:
    """Rows of JSON lines; malformed and non-object lines go."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def serialise(docs: DataFrame) -> DataFrame:
    return docs.select(F.to_json(F.struct("page_content", "metadata")).alias("value"))


def deserialise(lines: DataFrame) -> DataFrame:
    d = lines.select(F.from_json("value", DOCUMENT).alias("d")).where("d IS NOT NULL")
    return d.select(F.coalesce("d.page_content", F.lit("")).alias("page_content"), F.coalesce("d.metadata", F.create_map().cast("map<string,string>")).alias("metadata"))


def discover_pdfs(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, doc_id) of a folder's PDFs; contents are never read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder).select("path", "length")
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]+)\.pdf$", 1), r"[^a-zA-Z0-9._-]+", "_")
    return files.withColumn("doc_id", F.concat_ws("_", F.substring(stem, 1, 48), F.substring(F.sha1(F.concat_ws("::", "path", F.col("length").cast("string")).cast("binary")), 1, 16)))


def item_text(items: DataFrame) -> F.Column:
    """An item's text: the first of its direct texts, its mark-up without tags, or its captions and table body."""
    blank = lambda c: F.when(T.strip(c) != "", T.strip(c))
    captions = F.concat(*[T.text_list(F.col(k)) for k in CAPTIONS])
    body = F.substring(T.strip_tags(F.col("table_body")), 1, 1200)
    fragments = F.array_join(F.concat(captions, F.when(body != "", F.array(body)).otherwise(F.array().cast("array<string>"))), "\n")
    return F.coalesce(*[blank(F.col(k)) for k in ("text", "content", "latex", "markdown", "md")], blank(T.strip_tags(F.col("html"))), blank(fragments), F.lit(""))


def layout_items(items: DataFrame) -> DataFrame:
    """Items (with an order column `ord` and the fields of LAYOUT) as doc_id, ord, page_idx, type, text, bbox, figure_ids, table_ids."""
    kind = F.lower(F.trim(F.coalesce("type", F.lit(""))))
    ids = lambda t, prefix: F.when(F.col("type") == t, F.array(T.media_id(F.col("img_path"), prefix))).otherwise(F.array().cast("array<string>"))
    named = items.withColumn("type", F.when(kind == "", "text").otherwise(kind))
    return named.select(
        "doc_id", F.col("ord").cast("long").alias("ord"), F.greatest(F.coalesce(F.col("page_idx").try_cast("int"), F.lit(0)), F.lit(0)).alias("page_idx"), "type", item_text(named).alias("text"),
        T.box(F.col("bbox")).alias("bbox"), ids("image", "fig").alias("figure_ids"), ids("table", "tab").alias("table_ids"),
    )


def read_layouts(spark: SparkSession, path: str, blank: bool = False) -> DataFrame:
    """The items of layout JSON arrays, one file a document, with their places in reading order; those without text if asked for."""
    items = spark.read.schema(LAYOUT).option("multiLine", True).json(path).withColumn("file", F.col("_metadata.file_path")).withColumn("n", F.monotonically_increasing_id())
    ord_ = F.row_number().over(Window.partitionBy("file").orderBy("n")) - 1
    found = layout_items(items.select("*", F.regexp_extract("file", r"([^/]+?)(?:_content_list)?\.json$", 1).alias("doc_id"), ord_.alias("ord")))
    return found if blank else found.where("text <> ''")


class Files:
    """A few small files through Spark's file system; a file appears whole or not at all."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def names(self) -> list[str]:
        at = self._path(self.folder)
        return sorted(x.getPath().getName() for x in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def read(self, name: str) -> dict | None:
        """The JSON object in a file; None where it is missing or no object."""
        at = self._path(f"{self.folder}/{name}")
        if not self._fs.exists(at):
            return None
        try:
            found = json.loads("".join(r["value"] for r in self.spark.read.text(str(at)).collect()))
        except ValueError:
            return None
        return found if isinstance(found, dict) else None

    def write(self, name: str, value: dict) -> None:
        """A new file: written under another name, then renamed.  False renames (the name is taken) are errors."""
        staged = self._path(f"{self.folder}/.{name}-{uuid.uuid4().hex}")
        out = self._fs.create(staged, True)
        out.write(json.dumps(value, ensure_ascii=False, default=str).encode())
        out.close()
        if not self._fs.rename(staged, self._path(f"{self.folder}/{name}")):
            self._fs.delete(staged, False)
            raise FileExistsError(name)

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.folder}/{name}"), True)


class Snapshots:
    """A set of tables kept as snapshots under one folder, with numbered manifests of which the highest is current.

    A commit writes every table first, then a manifest with the next number, which appears by one rename.  A reader sees
    either the old set or the new one; a writer that dies leaves only an unnamed folder behind; of two writers that
    commit at once, one fails, and so does one that read an older set than the current one if it names it as its `base`.
    Tables that don't change can be kept: the manifest names the folder that they were written to.  `prune` deletes what
    is no longer current.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.files = Files(spark, folder)

    def _numbers(self) -> list[int]:
        return sorted(int(m[1]) for x in self.files.names() if (m := re.fullmatch(r"manifest-(\d{9})\.json", x)))

    def current(self) -> tuple[int, dict | None]:
        """The number of the current manifest and what it says; 0 and None where there is none."""
        for n in reversed(self._numbers()):
            if (found := self.files.read(f"manifest-{n:09d}.json")) is not None:
                return n, found
        return 0, None

    def manifest(self) -> dict | None:
        return self.current()[1]

    def stage(self, tables: dict[str, DataFrame], name: str | None = None, by: dict[str, str] | None = None) -> dict:
        """Write the tables without naming them current; what `publish` takes.  `by` has columns to lay tables out by."""
        name = name or uuid.uuid4().hex
        for k, df in tables.items():
            writer = df.write.mode("overwrite")
            (writer.partitionBy(by[k]) if by and k in by else writer).parquet(f"{self.folder}/{name}/{k}")
        schemas = {k: df.schema.jsonValue() for k, df in tables.items()}
        return {"snapshot": name, "tables": {k: self._read(f"{self.folder}/{name}/{k}", schemas[k]).count() for k in tables}, "schemas": schemas}

    def _read(self, path: str, schema: dict | None) -> DataFrame:
        """A table by the schema that its manifest gives; one laid out by a column has no file to tell it where it is empty."""
        return (self.spark.read.schema(X.StructType.fromJson(schema)) if schema else self.spark.read).parquet(path)

    def publish(self, staged: dict, keep: Iterable[str] = (), base: int | None = None, **facts) -> str:
        """Make a staged set current, together with the tables of the current set named in `keep`; again for the same set
        does nothing.  With `base` the current set must still have that number."""
        number, now = self.current()
        if now is not None and now.get("snapshot") == staged["snapshot"]:
            return staged["snapshot"]
        if base is not None and base != number:
            raise FileExistsError(f"set {number} is current, not {base}")
        keep = [k for k in keep if k not in staged["tables"]]
        at = {k: now.get("at", {}).get(k, now["snapshot"]) for k in keep} if keep else {}
        counts = {**staged["tables"], **{k: now["tables"][k] for k in keep}}
        schemas = {**staged.get("schemas", {}), **{k: now["schemas"][k] for k in keep if k in now.get("schemas", {})}}
        latest = max(self._numbers(), default=0)
        self.files.write(f"manifest-{latest + 1:09d}.json", {**staged, "tables": counts, "schemas": schemas, **({"at": at} if at else {}), **facts})
        return staged["snapshot"]

    def commit(self, tables: dict[str, DataFrame], keep: Iterable[str] = (), base: int | None = None, by: dict[str, str] | None = None, **facts) -> str:
        return self.publish(self.stage(tables, by=by), keep, base, **facts)

    def _path(self, manifest: dict, table: str) -> str:
        return f"{self.folder}/{manifest.get('at', {}).get(table, manifest['snapshot'])}/{table}"

    def load_of(self, manifest: dict, tables: Iterable[str]) -> dict[str, DataFrame]:
        """Some tables of the set that a manifest names."""
        return {k: self._read(self._path(manifest, k), manifest.get("schemas", {}).get(k)) for k in tables}

    def load(self) -> dict[str, DataFrame]:
        m = self.manifest()
        return self.load_of(m, m["tables"]) if m else {}

    def staged(self, names: dict) -> dict[str, DataFrame]:
        return {k: self._read(f"{self.folder}/{names['snapshot']}/{k}", names.get("schemas", {}).get(k)) for k in names["tables"]}

    def validate(self) -> list[str]:
        """Reasons why the current set is not what its manifest says."""
        m = self.manifest()
        if m is None:
            return ["manifest_missing"]
        out = []
        for k, n in m["tables"].items():
            at = self._path(m, k)
            if k not in Files(self.spark, at.rpartition("/")[0]).names():
                out.append(f"missing_local_file:{k}")
            elif self.load_of(m, [k])[k].count() != n:
                out.append(f"count_mismatch:{k}")
        return out

    def forget(self, *facts: str) -> None:
        """Make the same tables current without some facts, such as the signature by which a repeated ingest is skipped."""
        number, now = self.current()
        if now is not None and any(f in now for f in facts):
            self.files.write(f"manifest-{max(self._numbers()) + 1:09d}.json", {k: v for k, v in now.items() if k not in facts})

    def prune(self) -> None:
        """Delete manifests and tables that are not current; readers of older sets must be done."""
        m = self.manifest() or {"tables": {}, "snapshot": None}
        used = {self._path(m, k)[len(self.folder) + 1 :] for k in m["tables"]}
        for n in self._numbers()[:-1]:
            self.files.delete(f"manifest-{n:09d}.json")
        for x in self.files.names():
            if not re.fullmatch(r"[0-9a-f]{32}", x):
                continue
            if not any(u.startswith(f"{x}/") for u in used):
                self.files.delete(x)
                continue
            for k in Files(self.spark, f"{self.folder}/{x}").names():
                if f"{x}/{k}" not in used:
                    self.files.delete(f"{x}/{k}")


#: Names that a file system keeps for itself.
RESERVED = ("CON", "PRN", "AUX", "NUL", *[f"{d}{n}" for d in ("COM", "LPT") for n in range(1, 10)])


def upload_names(uploads: DataFrame, taken: DataFrame | None = None, name: str = "name", order: str = "upload_id") -> DataFrame:
    """`uploads` with `file`, a safe PDF name for each: no folders, signs that systems refuse or leading dots, and a number
    where another upload or a name in `taken` (file) has it already."""
    base = F.trim(F.element_at(F.split(T.text_or_empty(F.col(name)), "/"), -1))
    safe = F.regexp_replace(F.regexp_replace(F.regexp_replace(base, r'[<>:"/\\|?*\x00-\x1f]', "_"), r"\s+", "_"), r"^\.+", "")
    stem = F.regexp_replace(safe, r"(?s)(.)\.[^.]*$", "$1")
    stem = F.when(stem == "", "uploaded").when(F.upper(stem).isin(*RESERVED), F.concat(F.lit("upload_"), stem)).otherwise(stem)
    rows = uploads.withColumn("__stem", stem)
    # a name's own number among equals; names that are taken count before all uploads
    held = rows.select("__stem").distinct().withColumn("__held", F.lit(0))
    if taken is not None:
        number = taken.select(F.regexp_extract("file", r"^(.*?)(?:_(\d+))?\.pdf$", 1).alias("__stem"), F.coalesce(F.nullif(F.regexp_extract("file", r"^(.*?)(?:_(\d+))?\.pdf$", 2), F.lit("")).try_cast("int"), F.lit(0)).alias("n"))
        held = held.drop("__held").join(number.groupBy("__stem").agg((F.max("n") + 1).alias("__held")), "__stem", "left").na.fill(0, ["__held"])
    place = F.row_number().over(Window.partitionBy("__stem").orderBy(order)) - 1
    numbered = rows.withColumn("__place", place).join(held, "__stem").withColumn("__place", F.col("__place") + F.col("__held"))
    return numbered.withColumn("file", F.concat("__stem", F.when(F.col("__place") > 0, F.concat(F.lit("_"), F.col("__place").cast("string"))).otherwise(""), F.lit(".pdf"))).drop("__stem", "__held", "__place")


def layout_folders(files: DataFrame) -> DataFrame:
    """`files` (path, length, modificationTime in nanoseconds) with `folder`, where a parser keeps what it made of this version of a file."""
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(?s)(.)\.[^.]*$", "$1")
    mark = F.sha1(F.concat_ws("::", "path", F.col("length").cast("string"), F.col("modificationTime").cast("string")).cast("binary"))
    return files.withColumn("folder", F.concat(F.substring(F.regexp_replace(stem, r"[^a-zA-Z0-9._-]+", "_"), 1, 64), F.lit("_"), F.substring(mark, 1, 12)))


def layout_files(found: DataFrame, jobs: DataFrame) -> DataFrame:
    """(path, layout): of the content lists (folder, layout) in each job's folder (path, folder) the first whose name has the
    file's, or else the first."""
    stem = F.lower(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(?s)(.)\.[^.]*$", "$1"))
    lists = found.where(F.col("layout").endswith("_content_list.json"))
    fits = F.contains(F.lower(F.element_at(F.split("layout", "/"), -1)), stem)
    return jobs.join(lists, "folder").groupBy("path").agg(F.min(F.struct((~fits).alias("other"), F.col("layout"))).alias("x")).select("path", "x.layout")


#: Columns of the local catalog that have an index.
INDEXED = {"papers": ("doc_id", "year", "venue"), "citations": ("doc_id", "cited_year"), "sections": ("doc_id", "section")}


def write_sqlite(path: str, papers: DataFrame, citations: DataFrame, sections: DataFrame) -> None:
    """A local catalog file for tools, streamed to the driver's disk row by row; not meant for tables beyond one machine."""
    with sqlite3.connect(path) as db:
        for name, df in (("papers", papers.where("trim(doc_id) <> ''")), ("citations", citations.where("trim(edge_id) <> ''")), ("sections", sections)):
            flat = df.select([F.to_json(c).alias(c) if isinstance(df.schema[c].dataType, (X.ArrayType, X.StructType, X.MapType)) else F.col(c) for c in df.columns])
            db.execute(f"DROP TABLE IF EXISTS {name}")
            db.execute(f"CREATE TABLE {name} ({', '.join(flat.columns)})")
            db.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(flat.columns))})", (tuple(r) for r in flat.toLocalIterator()))
            for c in INDEXED[name]:
                if c in flat.columns:
                    db.execute(f"CREATE INDEX {name}_by_{c} ON {name} ({c})")


def question_rows(lines: DataFrame) -> DataFrame:
    """(question, context) of texts `Q: ... Text: ...`; others go."""
    p = r"(?s)^\s*Q:\s*(.+?)\s*Text:\s*(.+)$"
    return lines.select(F.regexp_extract("text", p, 1).alias("question"), F.regexp_extract("text", p, 2).alias("context")).where("question <> ''")


def evaluation_rows(queries: DataFrame, corpus: DataFrame, qrels: DataFrame) -> DataFrame:
    """(query_id, question, relevant, context_doc_id, context) from judgements with a score above zero."""
    good = qrels.where("score > 0").join(queries.select("query_id", F.col("text").alias("question")), "query_id").join(corpus.select("doc_id", F.col("text").alias("context")), "doc_id")
    each = F.array_sort(F.collect_set(F.struct("doc_id", "context")))
    return good.groupBy("query_id", "question").agg(each.alias("d")).select("query_id", "question", F.transform("d", lambda x: x["doc_id"]).alias("relevant"), F.col("d")[0]["doc_id"].alias("context_doc_id"), F.col("d")[0]["context"].alias("context"))
