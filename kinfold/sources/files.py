"""Reading feeds, archives, manifests and portable documents; writing exports and reports."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.session import write_table

C = F.col
FEED = "data array<struct<id:string,attributes:struct<title:map<string,string>,chapter:string,pages:bigint,readableAt:string,translatedLanguage:string>,relationships:array<struct<type:string,id:string,name:string>>>>"
PORTABLE = "format string, version int, series array<struct<title:string,status:string,aliases:array<string>,sources:array<struct<source:string,source_id:string,url:string>>,reading:array<struct<number:bigint,state:string>>>>"


def read_json_feed(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Documents {data: [...]}, one a file or one a line, as a row for each entry; unknown fields are ignored, broken
    documents give none."""
    return spark.read.schema(FEED).option("multiLine", not lines).json(path).select(F.explode("data").alias("x")).select("x.*")


def read_manifest(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """Path, bytes, modified and sha256 of files; hashes of unchanged ones (same path, bytes, time) come from `known`."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    facts = files.select("path", C("length").alias("bytes"), C("modificationTime").alias("modified"))
    if known is None:
        return files.select("path", C("length").alias("bytes"), C("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))
    same = facts.join(known, ["path", "bytes", "modified"])
    changed = facts.join(known, ["path", "bytes", "modified"], "left_anti").select("path")
    return same.unionByName(files.join(changed, "path").select("path", C("length").alias("bytes"), C("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256")))


def read_archive_members(spark: SparkSession, path: str) -> DataFrame:
    """Members (path, member, bytes, ok) of ZIP archives; a broken archive gives one row with a null member."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for p, content in zip(pdf["path"], pdf["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                        bad = z.testzip()
                        out += [(p, m.filename, m.file_size, m.filename != bad) for m in z.infolist() if not m.is_dir()]
                except zipfile.BadZipFile:
                    out.append((p, None, 0, False))
            yield pd.DataFrame(out, columns=["path", "member", "bytes", "ok"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, member string, bytes bigint, ok boolean")


#: The keys that a portable document may have.
PORTABLE_KEYS = ("format", "version", "exported_at", "series", "separations", "providers")


def load_portable(spark: SparkSession, path: str) -> DataFrame:
    """Portable documents, one a line: version, a row for each series of it, and the keys it shouldn't have (unknown)."""
    rows = spark.read.text(path).filter("trim(value) <> ''")
    keys = F.map_keys(F.from_json("value", "map<string,string>"))
    rows = rows.select(F.from_json("value", PORTABLE).alias("d"), F.array_sort(F.array_except(keys, F.lit(list(PORTABLE_KEYS)))).alias("unknown"))
    return rows.select(C("d.version").alias("version"), "unknown", F.explode("d.series").alias("s")).select("version", "unknown", "s.*")


def portable_document(series: DataFrame, exported_at: str) -> DataFrame:
    """K2: versioned documents of series (title, status, aliases, sources, reading), one a line, ready for write.text; a reader
    takes all lines together, so no task has to hold the catalog."""
    one = F.struct("title", "status", "aliases", "sources", "reading")
    return series.select(F.to_json(F.struct(F.lit("catalog").alias("format"), F.lit(1).alias("version"), F.lit(exported_at).alias("exported_at"), F.array(one).alias("series"))).alias("value"))


#: Fields of a portable document, and of its series and their sources.
SERIES_KEYS = ("title", "status", "downloaded_on_export", "description", "aliases", "sources", "reading")
SOURCE_KEYS = ("source", "source_id", "title", "url", "description", "revision_override", "aliases", "external_ids", "alternates")
_SOURCE = "struct<source:string,source_id:string,title:string,url:string,description:string,revision_override:string,aliases:array<string>,external_ids:map<string,string>,alternates:array<struct<source_id:string,title:string,url:string>>>"
_END = "struct<source:string,source_id:string>"
DOCUMENT = f"format string, version int, exported_at string, series array<struct<title:string,status:string,downloaded_on_export:boolean,description:string,aliases:array<string>,sources:array<{_SOURCE}>,reading:array<struct<chapter:string,status:string,read_at:string>>>>, separations array<struct<left:{_END},right:{_END}>>, providers array<struct<source:string,enabled:boolean>>"
_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def document_lines(d: dict[str, DataFrame], exported_at: str) -> DataFrame:
    """K2: the tables of a document (see catalog_io) as versioned JSON documents, ready for write.text: one for each series with
    its sources, aliases, external ids, alternates and reading states, and one for each separation and preference. A reader
    takes all lines together, so no task holds the catalog; a series' own rows meet, as they are one document."""
    at = ["key", "source"]
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    of = lambda df, keys, col, name: df.groupBy(*keys).agg(F.array_sort(F.collect_set(col)).alias(name))
    ids = d["external_ids"].groupBy(*at).agg(F.sort_array(F.collect_set(F.struct("provider", "value"))).alias("external_ids"))
    src = d["sources"].join(of(d["source_aliases"], at, "alias", "aliases"), at, "left").join(ids, at, "left")
    src = src.join(of(d["alternates"].withColumn("one", F.struct("source_id", "title", "url")), at, "one", "alternates"), at, "left")
    one = F.struct("source", "source_id", "title", "url", "description", C("revision").alias("revision_override"), none("aliases", "array<string>"), none("external_ids", "array<struct<provider:string,value:string>>"), none("alternates", "array<struct<source_id:string,title:string,url:string>>"))
    named = [f for f in SOURCE_KEYS if f not in ("external_ids", "alternates")]  # ids become a map once the sources are sorted
    mapped = lambda x: F.struct(*(x[f].alias(f) for f in named), F.map_from_entries(x["external_ids"]).alias("external_ids"), x["alternates"].alias("alternates"))
    nested = of(src.withColumn("one", one), ["key"], "one", "sources").withColumn("sources", F.transform("sources", mapped))
    rows = d["series"].join(of(d["series_aliases"], ["key"], "alias", "aliases"), "key", "left").join(nested, "key", "left")
    state = F.struct("chapter", C("state").alias("status"), F.date_format("read_at", _TIME).alias("read_at"))
    rows = rows.join(of(d["reading"].withColumn("one", state), ["key"], "one", "reading"), "key", "left")
    kind = DOCUMENT.split("series ", 1)[1].split(", separations")[0].removeprefix("array<").removesuffix(">")
    whole = F.struct("title", "status", C("downloaded").alias("downloaded_on_export"), "description", none("aliases", "array<string>"), none("sources", f"array<{_SOURCE}>"), none("reading", "array<struct<chapter:string,status:string,read_at:string>>")).cast(kind)
    apart = F.struct(F.struct(C("left_source").alias("source"), C("left_id").alias("source_id")).alias("left"), F.struct(C("right_source").alias("source"), C("right_id").alias("source_id")).alias("right"))
    empty = {"series": f"array<{kind}>", "separations": f"array<struct<left:{_END},right:{_END}>>", "providers": "array<struct<source:string,enabled:boolean>>"}

    def line(df: DataFrame, field: str, value) -> DataFrame:
        parts = [F.array(value).cast(k).alias(f) if f == field else F.array().cast(k).alias(f) for f, k in empty.items()]
        return df.select(F.to_json(F.struct(F.lit("catalog").alias("format"), F.lit(1).alias("version"), F.lit(exported_at).alias("exported_at"), *parts)).alias("value"))

    return line(rows, "series", whole).unionByName(line(d["separations"], "separations", apart)).unionByName(line(d["providers"], "providers", F.struct("source", "enabled")))


def load_document(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables of portable documents, one a line, and the fields they shouldn't have (row_key, name). A series' key is the
    least of its sources' identities, else its title; a null line or one that isn't JSON has the field `value`. Documents are parsed
    once, into a table that all others read."""
    rows = spark.read.text(path).filter("trim(value) <> ''")
    d = write_table(rows.select(F.from_json("value", DOCUMENT).alias("d"), F.from_json("value", "map<string,string>").alias("m")), "documents")
    own = F.array_min(F.transform("s.sources", lambda x: F.concat_ws(":", x["source"], F.trim(x["source_id"]))))
    key = F.coalesce(own, F.concat(F.lit("title:"), C("s.title"))).alias("key")
    series = d.select(F.explode("d.series").alias("s")).select(key, "s")
    src = series.select("key", F.explode("s.sources").alias("x"))
    at = lambda p: C(f"p.{p}")
    tables = {
        "series": series.select("key", C("s.title").alias("title"), C("s.status").alias("status"), F.coalesce("s.description", F.lit("")).alias("description"), F.coalesce("s.downloaded_on_export", F.lit(False)).alias("downloaded")),
        "series_aliases": series.select("key", F.explode("s.aliases").alias("alias")),
        "sources": src.select("key", *(C(f"x.{f}").alias(f) for f in ("source", "source_id", "title", "url")), F.coalesce("x.description", F.lit("")).alias("description"), F.coalesce("x.revision_override", F.lit("")).alias("revision")),
        "source_aliases": src.select("key", "x.source", F.explode("x.aliases").alias("alias")),
        "external_ids": src.select("key", "x.source", F.explode("x.external_ids").alias("provider", "value")),
        "alternates": src.select("key", "x.source", F.explode("x.alternates").alias("p")).select("key", "source", at("source_id"), F.coalesce(at("title"), F.lit("")).alias("title"), F.coalesce(at("url"), F.lit("")).alias("url")),
        "reading": series.select("key", F.explode("s.reading").alias("p")).select("key", at("chapter"), at("status").alias("state"), F.to_timestamp(at("read_at"), _TIME).alias("read_at")),
        "separations": d.select(F.explode("d.separations").alias("p")).select(at("left.source").alias("left_source"), at("left.source_id").alias("left_id"), at("right.source").alias("right_source"), at("right.source_id").alias("right_id")),
        "providers": d.select(F.explode("d.providers").alias("p")).select(at("source"), at("enabled")),
    }
    listed = lambda keys: F.lit(list(keys))
    extra = lambda m, keys: F.explode(F.array_except(F.map_keys(m), listed(keys))).alias("name")
    parts = F.from_json(C("m")["series"], "array<map<string,string>>")
    inner = d.select(F.explode(parts).alias("m"))
    unknown = d.filter("m IS NOT NULL").select(F.lit("document").alias("row_key"), extra(C("m"), PORTABLE_KEYS))
    unknown = unknown.union(d.filter("m IS NULL").select(F.lit("document"), F.lit("value"))).union(inner.select(F.concat(F.lit("series:"), F.coalesce(C("m")["title"], F.lit(""))), extra(C("m"), SERIES_KEYS)))
    unknown = unknown.union(inner.select(F.explode(F.from_json(C("m")["sources"], "array<map<string,string>>")).alias("m")).select(F.concat(F.lit("source:"), F.coalesce(C("m")["source_id"], F.lit(""))), extra(C("m"), SOURCE_KEYS)))
    return tables, unknown


def portable_json(series: DataFrame) -> DataFrame:
    """Each series (id, title, status, aliases, sources, reading) as a JSON document."""
    return series.select("id", F.to_json(F.struct("title", "status", "aliases", "sources", "reading")).alias("document"))


def legacy_catalog(series: DataFrame, children: DataFrame, files: DataFrame, releases: DataFrame, identities: DataFrame) -> DataFrame:
    """Series (id, title, status) that have a stored file, with the identities (source:source_id, sorted) its files came
    from. children: id, series_id; files: child_id, release_id, active; releases: id, identity_id."""
    rows = files.filter("active").select("child_id", "release_id").join(children.select(C("id").alias("child_id"), "series_id"), "child_id").join(releases.select(C("id").alias("release_id"), "identity_id"), "release_id")
    rows = rows.select("series_id", "identity_id").distinct().join(identities.select(C("id").alias("identity_id"), "source", "source_id"), "identity_id")
    named = rows.groupBy(C("series_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", "source", "source_id"))), ",").alias("identities"))
    return series.select("id", "title", "status").join(named, "id")


def training_jsonl(labels: DataFrame, key: str = "decision_id") -> DataFrame:
    """K1: labelled pairs as JSON lines in the order of their ids, ready for write.text."""
    return labels.select(key, F.to_json(F.struct(*sorted(labels.columns))).alias("value")).orderBy(key).select(key, "value")


def audit_markdown(report: DataFrame) -> DataFrame:
    """K3: an audit report (name, n) as Markdown lines."""
    return report.select("name", F.concat(F.lit("| "), "name", F.lit(" | "), C("n").cast("string"), F.lit(" |")).alias("line"))


def audit_json(report: DataFrame) -> DataFrame:
    """K3: an audit report (name, n: a few rows) as one JSON document: whether all is well, and the checks by name."""
    checks = F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "n"))))
    return report.agg(F.to_json(F.struct((F.sum("n") == 0).alias("ok"), checks.alias("checks"))).alias("document"))


def action_report(rows: DataFrame, action: str = "action") -> DataFrame:
    """K4: numbers by action."""
    return rows.groupBy(action).agg(F.count("*").alias("n"))


def prometheus_lines(rows: DataFrame, metric: str, labels: list[str], value: str) -> DataFrame:
    """K5: text exposition: metric{label="value"} number, with backslash, quote and line end escaped."""
    escape = lambda c: F.replace(F.replace(F.replace(F.coalesce(C(c).cast("string"), F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    pairs = F.concat_ws(",", *(F.concat(F.lit(f'{x}="'), escape(x), F.lit('"')) for x in labels))
    return rows.select(F.concat(F.lit(metric + "{"), pairs, F.lit("} "), C(value).cast("string")).alias("line")).orderBy("line")
