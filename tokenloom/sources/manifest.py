"""File manifests of a model hub as tables: selection, metadata, and what a sync would do.  Nothing here goes to a network."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenloom.functions import strings
from tokenloom.functions.patterns import literal


def select_files(manifest: DataFrame, globs: list[str], path_col: str = "path") -> DataFrame:
    """The files that any glob matches; all without globs."""
    return manifest.filter(strings.matches_glob(F.col(path_col), globs)).dropDuplicates([path_col])


def listed_files(manifest: DataFrame, globs: list[str], order_col: str, path_col: str = "path") -> DataFrame:
    """path and place of the files that any glob matches: by the first glob that does, then in the manifest's order, once each.

    A manifest is a short list: its order is made over one partition.
    """
    which = F.least(*(F.when(strings.matches_glob(F.col(path_col), [g]), k) for k, g in enumerate(globs)), F.lit(None).cast("int")) if globs else F.lit(0)
    first = manifest.select(F.col(path_col), F.struct(which.alias("glob"), F.col(order_col).alias("at")).alias("seen")).filter("seen.glob IS NOT NULL").groupBy(path_col).agg(F.min("seen").alias("seen"))
    return first.select(path_col, (F.row_number().over(Window.orderBy("seen", path_col)) - 1).alias("place"))


def with_metadata(files: DataFrame, heads: DataFrame, key: str = "path") -> DataFrame:
    """Selected files with what a HEAD request of each told: path, commit, etag, location, size; nulls where there is no answer.

    heads: path, headers (a map with lower-case names), url, status.
    """
    told = heads.select(key, metadata(F.col("headers"), F.col("url"), F.col("status")).alias("m"))
    return files.join(told, key, "left").select(*files.columns, "m.*")


def local_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """path (below the folder), size and sha256 of the files below a folder, read by Spark wherever that lies."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    below = F.regexp_replace("path", "^.*" + literal(folder.rstrip("/").rpartition("/")[2]) + "/", "")
    return files.select(below.alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def file_url(endpoint: Column, repo: Column, path: Column) -> Column:
    """The place of a file of the main revision; repository types other than models resolve to the same place."""
    return F.concat_ws("/", endpoint, repo, F.lit("resolve"), F.lit("main"), path)


def metadata(headers: Column, url: Column, status: Column) -> Column:
    """commit, etag, location and size from a HEAD response's headers (a map with lower-case names)."""
    linked = lambda a, b: F.coalesce(F.element_at(headers, a), F.element_at(headers, b))
    return F.struct(
        F.element_at(headers, "x-repo-commit").alias("commit"),
        strings.etag(linked("x-linked-etag", "etag")).alias("etag"),
        F.when(status == 302, F.element_at(headers, "location")).otherwise(url).alias("location"),
        linked("x-linked-size", "content-length").try_cast("bigint").alias("size"),
    )


def read_metadata(text: Column) -> Column:
    """commit, etag, timestamp of a local metadata file; null where it has fewer than three lines or a bad number."""
    lines = F.split(text, "\n")
    seconds = F.get(lines, 2).try_cast("double")
    return F.when((F.size(lines) >= 3) & seconds.isNotNull(), F.struct(F.get(lines, 0).alias("commit"), F.get(lines, 1).alias("etag"), F.timestamp_millis((seconds * 1000).cast("long")).alias("timestamp")))


def write_metadata(commit: Column, etag: Column, seconds: Column) -> Column:
    return F.concat(commit, F.lit("\n"), etag, F.lit("\n"), seconds.cast("string"), F.lit("\n"))


def sync(remote: DataFrame, local: DataFrame, key: str = "path") -> DataFrame:
    """What a sync does with each remote file: keep it, refresh its metadata, or fetch it.

    remote: path, commit, etag; local: path, local_commit, local_etag (null without metadata), sha256 of the file.  The first
    that holds: same commit, a full hash; same etag; the file's hash is the etag.
    """
    both = remote.join(local.withColumn("_there", F.lit(True)), key, "left")
    there = F.coalesce("_there", F.lit(False))
    holds = lambda c: F.coalesce(c, F.lit(False))
    action = (
        F.when(holds(strings.is_commit(F.col("commit")) & there & (F.col("local_commit") == F.col("commit"))), "keep")
        .when(holds(there & (F.col("local_etag") == F.col("etag"))), "refresh")
        .when(holds(strings.is_sha256(F.col("etag")) & there & (F.col("sha256") == F.col("etag"))), "refresh")
        .otherwise("fetch")
    )
    return both.withColumn("action", action).drop("_there")


def progress(files: DataFrame, order_col: str = "path") -> DataFrame:
    """Files done and the share of all, in order.  A manifest is a short list: its order is over one partition."""
    return files.select(F.col(order_col), F.row_number().over(Window.orderBy(order_col)).alias("done"), F.count("*").over(Window.partitionBy()).alias("total")).withColumn("fraction", F.col("done") / F.col("total"))


# ---- acting on it --------------------------------------------------------------------------------------------------

#: Folder of a snapshot in which the metadata of its files lie.
KEPT = ".metadata"


def _metadata_files(spark: SparkSession, folder: str) -> dict[str, tuple[str, str]]:
    """commit and etag by path; a file that can't be read is deleted."""
    fs, path = _file_system(spark, folder), spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    if not fs.exists(path(f"{folder}/{KEPT}")):
        return {}
    texts = spark.read.text(f"{folder}/{KEPT}", wholetext=True, recursiveFileLookup=True).select("value", F.col("_metadata.file_path").alias("file"))
    out = {}
    for r in texts.select("file", read_metadata(F.col("value")).alias("m")).collect():
        if r.m is None:
            fs.delete(path(r.file), False)
        else:
            out[r.file.rpartition(f"/{KEPT}/")[2].removesuffix(".txt")] = (r.m.commit, r.m.etag)
    return out


def _file_system(spark: SparkSession, folder: str):  # noqa: ANN202
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def snapshot(spark: SparkSession, registry: str, target: str, commit: str, globs: list[str] | None = None, seconds: float = 0.0) -> DataFrame:
    """Brings the files of a registry's folder that any glob matches to a target folder; returns path, action, done, fraction.

    What ``sync`` decides is done: files are kept, get new metadata, or are copied.  A file's etag is its hash.  Both folders
    may lie wherever Hadoop's file systems reach.  A snapshot is a short list of files, which the driver goes through in order.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path, source, sink = jvm.org.apache.hadoop.fs.Path, _file_system(spark, registry), _file_system(spark, target)
    remote = select_files(local_files(spark, registry), globs or []).select("path", F.lit(commit).alias("commit"), F.col("sha256").alias("etag"))
    sink.mkdirs(path(target))
    known = _metadata_files(spark, target)
    rows = spark.createDataFrame([(k, *v) for k, v in known.items()], "path string, local_commit string, local_etag string")
    local = local_files(spark, target).filter(~F.col("path").startswith(f"{KEPT}/")).select("path", "sha256").join(rows, "path", "left")
    todo = sync(remote, local).select("path", "commit", "etag", "action").orderBy("path").collect()
    for r in todo:
        if r.action == "fetch":
            sink.mkdirs(path(f"{target}/{r.path}").getParent())
            jvm.org.apache.hadoop.fs.FileUtil.copy(source, path(f"{registry}/{r.path}"), sink, path(f"{target}/{r.path}"), False, True, conf)
        if r.action != "keep":
            out = sink.create(path(f"{target}/{KEPT}/{r.path}.txt"), True)
            out.write(bytearray(f"{r.commit}\n{r.etag}\n{seconds}\n".encode()))
            out.close()
    done = spark.createDataFrame([(r.path, r.action) for r in todo], "path string, action string")
    return done.join(progress(done), "path").select("path", "action", "done", "fraction")
