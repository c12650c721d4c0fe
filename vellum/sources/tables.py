"""CSV, feed and blob sources and sinks."""

from __future__ import annotations

import gzip
import io
import re
import tarfile
import uuid

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import blob_key, media_type, trim_space
from ..operators.gc import delete_batches
from ..schemas import ARTICLE_CSV, BOOKMARK_CSV, FEED_CSV
from .shared import cut
from .store import Store

FEED_ENTRIES = 30
ASSET_BYTES = 20 << 20


class BadCsv(ValueError):
    """The file lacks a column it must have, or has a malformed row."""


def read_csv(spark: SparkSession, path: str, schema: str, required: tuple[str, ...], key: str) -> DataFrame:
    """Rows with the schema's columns, found by name; other columns are ignored, missing ones empty, rows with a blank
    key dropped. Quoted line feeds and doubled quotes are read; a row with too few or too many cells fails the read. The
    column `line` numbers the rows in file order."""
    options = {"header": True, "multiLine": True, "escape": '"', "mode": "FAILFAST", "enforceSchema": False}
    head = spark.read.options(**options).csv(path)
    lost = [c for c in required if c not in head.columns]
    if lost:
        raise BadCsv(f"no column {', '.join(lost)}")
    names = [part.split()[0] for part in schema.split(", ")]
    numbered = head.withColumn("_line", F.monotonically_increasing_id())  # over the scan itself: the same at each reading
    return numbered.select([F.coalesce(F.col(c), F.lit("")).alias(c) if c in head.columns else F.lit("").alias(c) for c in names] + [F.col("_line").alias("line")]).where(trim_space(key) != "")


def read_bookmarks(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, BOOKMARK_CSV, ("url", "created"), "url")


def read_article_csv(spark: SparkSession, path: str, now: str) -> DataFrame:
    rows = read_csv(spark, path, ARTICLE_CSV, ("url",), "url").drop("line")
    return rows.withColumn("created", F.when(trim_space("created") == "", F.lit(now)).otherwise(F.col("created")))


def read_feed_urls(spark: SparkSession, path: str) -> DataFrame:
    """Feed addresses in file order."""
    return read_csv(spark, path, FEED_CSV, ("feed_url",), "feed_url").orderBy("line").select(trim_space("feed_url").alias("feed_url"))


def validate_csv(spark: SparkSession, path: str, schema: str, required: tuple[str, ...], key: str) -> int:
    """Number of rows; raises BadCsv for files that an import would refuse."""
    try:
        return read_csv(spark, path, schema, required, key).agg(F.count(F.lit(1)), *[F.max(F.length(p.split()[0])) for p in schema.split(", ")]).first()[0]
    except BadCsv:
        raise
    except Exception as error:
        raise BadCsv(str(error).splitlines()[0]) from error


def write_csv(df: DataFrame, folder: str, stem: str, at: str) -> tuple[str, int]:
    """Write under a name with the time in it; the path and the number of rows, counted as they are written."""
    path = f"{folder.rstrip('/')}/{stem}-{''.join(c if c.isalnum() else '-' for c in at)}"
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.csv(path, header=True, escape='"', quoteAll=False, emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return path, seen.get["n"]


def source_rows(sources: DataFrame) -> DataFrame:
    """What the sources' CSV holds."""
    return sources.select("name", "feed_url", "status", "article_count", F.coalesce("last_synced_at", F.lit("")).alias("last_synced_at"), "created_at")


# feeds

_ITEM = "array<struct<link: string, tags: array<string>>>"
_RSS = "channel struct<title: string, item: array<struct<link: string, guid: string, category: array<string>>>>"
_ATOM = "title string, entry array<struct<link: array<struct<_href: string, _rel: string>>, id: string, category: array<struct<_term: string>>>>"
_RDF = "channel struct<title: string>, item array<struct<link: string, subject: array<string>>>"
_JSON = "title string, items array<struct<url: string, id: string, tags: array<string>>>"
#: Root elements of the kinds of feeds.
_ROOTS = {"rss": "rss", "feed": "atom", "rdf:RDF": "rdf"}
_PLAIN = r"^[\uFEFF\s]*+(?:<\?xml[^>]*+>\s*+)?<([A-Za-z:]++)[\s>/]"
_SPACE_BEFORE = re.compile(r"[\ufeff\s]*")
_ROOT = re.compile(r"<([^\s>/]+)[\s>/]")
_SKIPPED = (("<?", "?>"), ("<!--", "-->"), ("<!DOCTYPE", ">"))


def root_of(body: str) -> str | None:
    """Name of the root element, behind instructions, comments and a document type, however many."""
    at = _SPACE_BEFORE.match(body).end()
    while kind := next((k for k in _SKIPPED if body.startswith(k[0], at)), None):
        end = body.find(kind[1], at + len(kind[0]))
        if end < 0:
            return None
        at = _SPACE_BEFORE.match(body, end + len(kind[1])).end()
    found = _ROOT.match(body, at)
    return found[1] if found else None


@F.pandas_udf(T.StringType())
def _root_behind(body: pd.Series) -> pd.Series:
    return body.map(lambda x: None if x is None else root_of(x))


def feed_kind(body: Column | str) -> Column:
    """rss, atom, rdf or json; null for what is no feed. The whole prologue is read, however long: a plain one here, what begins with
    comments and the like in Python, as a repeated group would recurse in Java's matcher."""
    body = F.col(body) if isinstance(body, str) else body
    plain = F.nullif(F.regexp_extract(body, _PLAIN, 1), F.lit(""))
    odd = F.when(plain.isNull() & F.regexp_like(body, F.lit(r"^[\uFEFF\s]*+<[?!]")), body)
    root = F.coalesce(plain, _root_behind(odd))
    kind = F.lit(None).cast("string")
    for name, of in _ROOTS.items():
        kind = F.when(root == name, of).otherwise(kind)
    return F.when(F.regexp_like(body, F.lit(r"^[\uFEFF\s]*+\{")) & F.contains(F.replace(body, F.lit("\\/"), F.lit("/")), F.lit("://jsonfeed.org/version/")), "json").otherwise(kind)


def parsed_feed(body: Column | str) -> Column:
    """(title, items) of a body, items in document order with their first link and tags; null if it does not parse as a feed."""
    body = F.col(body) if isinstance(body, str) else body
    text = F.regexp_replace(body, F.lit(r"^\uFEFF"), F.lit(""))
    none = F.array().cast("array<string>")
    rss, atom, rdf = (F.from_xml(text, schema, {"ignoreNamespace": "true", "mode": "PERMISSIVE"}) for schema in (_RSS, _ATOM, _RDF))
    page = lambda links: F.filter(links, lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    first = lambda links: F.coalesce(F.try_element_at(page(links), F.lit(1))["_href"], F.try_element_at(links, F.lit(1))["_href"])
    item = lambda link, tags: F.struct(link.alias("link"), F.coalesce(tags, none).alias("tags"))
    feed = lambda title, items: F.struct(title.alias("title"), F.coalesce(items, F.array().cast(_ITEM)).cast(_ITEM).alias("items"))
    as_json = F.from_json(text, _JSON)
    kind = feed_kind(body)
    return (
        F.when((kind == "rss") & rss["channel"].isNotNull(), feed(rss["channel"]["title"], F.transform(rss["channel"]["item"], lambda x: item(F.coalesce(x["link"], x["guid"]), x["category"]))))
        .when((kind == "atom") & (atom["title"].isNotNull() | atom["entry"].isNotNull()), feed(atom["title"], F.transform(atom["entry"], lambda x: item(first(x["link"]), F.transform(x["category"], lambda c: c["_term"])))))
        .when((kind == "rdf") & rdf["channel"].isNotNull(), feed(rdf["channel"]["title"], F.transform(rdf["item"], lambda x: item(x["link"], x["subject"]))))
        .when((kind == "json") & as_json["items"].isNotNull(), feed(as_json["title"], F.transform(as_json["items"], lambda x: item(F.coalesce(x["url"], x["id"]), x["tags"]))))
    )


def read_feeds(spark: SparkSession, path: str) -> DataFrame:
    """One row a feed file, RSS, Atom, RDF or JSON: title and the first FEED_ENTRIES items in document order; both null for
    a file that is no feed."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("feed"), parsed_feed("value").alias("_f"))
    return files.select("feed", F.col("_f.title").alias("title"), F.slice("_f.items", 1, FEED_ENTRIES).alias("items"))


def feed_entries(feeds: DataFrame) -> DataFrame:
    """Links and tags of the items, in order; items without a link are dropped."""
    items = feeds.select("feed", F.posexplode("items").alias("place", "item"))
    return items.select("feed", "place", trim_space("item.link").alias("link"), F.col("item.tags").alias("tags")).where("link <> ''")


def looks_like_feed(body: Column | str) -> Column:
    """Whether a fetched body is a feed: those become recurring sources, others single captures."""
    return feed_kind(body).isNotNull()


def sniffed(bodies: DataFrame, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """Feeds, and pages."""
    feed = F.coalesce(looks_like_feed(body), F.lit(False))
    return bodies.where(feed), bodies.where(~feed)


def usable_assets(references: DataFrame, assets: DataFrame, blocked: Column) -> DataFrame:
    """References with their stored asset, if it was fetched, is small enough and not on a blocked address; else null."""
    fit = assets.where((F.octet_length("body") <= ASSET_BYTES) & ~blocked)
    return references.join(fit, "url", "left")


# blobs


@F.pandas_udf(T.BinaryType())
def gzip_bytes(data: pd.Series) -> pd.Series:
    return data.map(lambda x: None if x is None else gzip.compress(x if isinstance(x, bytes) else bytes(x), mtime=0))


@F.pandas_udf(T.BinaryType())
def gunzip_bytes(data: pd.Series) -> pd.Series:
    """Null for what is not gzip."""

    def one(x):
        try:
            return None if x is None else gzip.decompress(bytes(x))
        except (OSError, EOFError):
            return None

    return data.map(one)


def row_blobs(rows: DataFrame, entity_type: str, root: str = "sync") -> DataFrame:
    """(key, body): each row as gzipped JSON under its key."""
    body = F.to_json(F.struct(*rows.columns))
    return rows.select(blob_key(F.lit(entity_type), "id", root).alias("key"), gzip_bytes(body.cast("binary")).alias("body"))


def rows_of_blobs(blobs: DataFrame, schema: str) -> DataFrame:
    """Rows back from blobs; those that do not decode are skipped."""
    text = F.decode(gunzip_bytes("body"), "UTF-8")
    parsed = blobs.select(F.from_json(text, schema, {"mode": "PERMISSIVE"}).alias("_row"))
    return parsed.where("_row.id is not null").select("_row.*")


def write_manifest(entries: DataFrame, tombstones: DataFrame, version: int, path: str, base: int | None = None) -> int:
    """Publish a manifest by one record, so that a reader sees all of it or none. base: the number of the write that this one follows;
    Conflict if another has come between (None: whatever is there is followed). The number of this write."""
    store = Store(entries.sparkSession, path, {})
    base, folder = store.version() if base is None else base, f"{store.path}/data/manifest-{uuid.uuid4().hex}"
    entries.write.json(f"{folder}/entries", compression="gzip")
    tombstones.write.json(f"{folder}/tombstones", compression="gzip")
    return store.publish({"manifest": folder, "version": version}, base + 1)


def read_manifest(spark: SparkSession, path: str, entry_schema: str, tombstone_schema: str) -> tuple[DataFrame, DataFrame, int]:
    """Entries, tombstones and version of the last write; nothing and 0 where there is none."""
    store = Store(spark, path, {})
    record = store.record(store.version())
    if not record:
        return spark.createDataFrame([], entry_schema), spark.createDataFrame([], tombstone_schema), 0
    folder = record["manifest"]
    return spark.read.schema(entry_schema).json(f"{folder}/entries"), spark.read.schema(tombstone_schema).json(f"{folder}/tombstones"), record["version"]


def write_assets(assets: DataFrame, folder: str, path: str = "path", data: str = "body") -> int:
    """Each asset as a file of its own under the folder, which is emptied first; SVG is gzipped. The folder may be in any store
    that Arrow can write to. A file appears whole: it is written beside and then moved. The number of files."""
    spark = assets.sparkSession
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root.getFileSystem(spark._jsc.hadoopConfiguration()).delete(root, True)

    def write(batches):
        files, base = store_of(folder)
        n = 0
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                parts = [p for p in (name or "").split("/") if p not in ("", ".")]
                if not parts or ".." in parts:
                    raise ValueError(f"not a path inside the folder: {name!r}")
                target, content = f"{base}/{'/'.join(parts)}", body.as_py() or b""
                files.create_dir(target.rpartition("/")[0], recursive=True)
                draft = f"{target}.{uuid.uuid4().hex}"
                with files.open_output_stream(draft) as out:
                    out.write(gzip.compress(content, mtime=0) if target.lower().endswith(".svg") else content)
                files.move(draft, target)
                n += 1
        yield pa.RecordBatch.from_pydict({"n": [n]})

    return assets.select(path, F.col(data).cast("binary")).mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0


def served(requests: DataFrame, live: DataFrame, path: str = "path", owner: str = "id") -> DataFrame:
    """What the content server answers: status and media type of each request; 404 unless its owner is live."""
    known = live.select(F.col("id").alias(owner)).distinct().withColumn("_live", F.lit(True))
    status = F.when(F.col("_live"), 200).otherwise(404)
    return requests.join(known, owner, "left").withColumns({"status": status, "type": F.when(F.col("_live"), media_type(path))}).drop("_live")


def store_of(place: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system of a folder, and the folder in it."""
    uri = place if "://" in place else place.replace("file:", "file://", 1) if place.startswith("file:/") else f"file://{place}"
    return fs.FileSystem.from_uri(uri)


_FOUND = "key string, folder boolean, last_modified string"


def _listed(root: str, recursive: bool):
    def run(batches):
        files, base = store_of(root)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                found = files.get_file_info(fs.FileSelector(f"{base}/{folder}".rstrip("/"), recursive=recursive, allow_not_found=True))
                for at in range(0, len(found), 10_000):
                    page = [x for x in found[at : at + 10_000] if not (x.base_name.startswith(".") and x.base_name.endswith(".crc"))]
                    yield pa.RecordBatch.from_pydict({
                        "key": pa.array([x.path[len(base) :].lstrip("/") for x in page], pa.string()), "folder": pa.array([x.type == fs.FileType.Directory for x in page], pa.bool_()),
                        "last_modified": pa.array([x.mtime.strftime("%Y-%m-%dT%H:%M:%SZ") if x.mtime else None for x in page], pa.string()),
                    })

    return run


def list_blobs(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """(key, last_modified) of the files under a folder, empty ones too, without the checksums that Hadoop puts beside them. The
    folders in it are listed in executors, each with all that is below it; a prefix starts at its own folder."""
    folder = prefix.rpartition("/")[0]
    first = cut(spark.createDataFrame([(folder,)], "key string").mapInArrow(_listed(path, False), _FOUND))
    folders = first.where("folder").select("key")
    below = folders.repartition(spark.sparkContext.defaultParallelism, "key").mapInArrow(_listed(path, True), _FOUND)
    return first.unionByName(below).where(~F.col("folder") & F.startswith("key", F.lit(prefix))).select("key", "last_modified")


def delete_blobs(keys: DataFrame, path: str, size: int = 1000) -> DataFrame:
    """Delete the files of some keys under a folder, in executors, a batch of about `size` after the other; (key, outcome):
    deleted, missing, or why it failed. A key that leads out of the folder is refused."""

    def run(batches):
        files, base = store_of(path)

        def one(key: str) -> str:
            if not key or any(p in ("", ".", "..") for p in key.split("/")):
                return "refused"
            try:
                files.delete_file(f"{base}/{key}")
            except FileNotFoundError:
                return "missing"
            except OSError as error:
                return "missing" if files.get_file_info(f"{base}/{key}").type == fs.FileType.NotFound else str(error)[:200]
            return "deleted"

        for batch in batches:
            for keys_ in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_pydict({"key": pa.array(keys_, pa.string()), "outcome": pa.array([one(k) for k in keys_], pa.string())})

    grouped = delete_batches(keys.where("key is not null").select("key").distinct(), size)
    return cut(grouped.select("keys").mapInArrow(run, "key string, outcome string"))  # files go once, here


# bundles of a document's files


def _bundle(paths: list[str], bodies: list[bytes | None], hashes: list[str], literal: list[bool]) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as tar:
        for path, body, digest, whole in sorted(zip(paths, bodies, hashes, literal, strict=True)):
            name, data = (path, bytes(body or b"")) if whole else (f"{path}.ref", digest.encode())
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    return gzip.compress(out.getvalue(), mtime=0)


@F.pandas_udf(T.BinaryType())
def bundle(entries: pd.Series) -> pd.Series:
    """Tar.gz of a document's entries (path, body, content_hash, literal); those not literal become pointers."""
    return entries.map(lambda es: _bundle(*zip(*[(e["path"], e["body"], e["content_hash"], e["literal"]) for e in es], strict=True)) if es is not None and len(es) else None)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("body", T.BinaryType()), T.StructField("pointer", T.StringType())])))
def unbundled(data: pd.Series) -> pd.Series:
    """Entries of a bundle; a pointer has the hash of a shared blob for a body."""

    def one(x):
        if x is None:
            return None
        with tarfile.open(fileobj=io.BytesIO(gzip.decompress(bytes(x)))) as tar:
            found = [(m.name, tar.extractfile(m).read()) for m in tar.getmembers() if m.isfile()]
        return [{"path": n.removesuffix(".ref"), "body": None if n.endswith(".ref") else b, "pointer": b.decode() if n.endswith(".ref") else None} for n, b in found]

    return data.map(one)


