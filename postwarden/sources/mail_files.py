"""Raw mail corpora: MIME folders, index files and CSV files."""

from __future__ import annotations

import email
import email.policy
import itertools
import json
import os
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postwarden.functions import text as tx

BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"
PARSED = (
    "path string, from_email string, recipients string, sent string, subject_raw string, "
    "body_raw string, error string"
)


def read_mail_files(
    spark: SparkSession, folder: str, stream: bool = False, files_per_batch: int | None = None, by_folder: bool = False
) -> DataFrame:
    """(path, content) of every file below ``folder``; with ``stream`` as a file stream.

    A stream ``by_folder`` takes the folders that ``write_mail_dirs`` has listed, each as a whole and once: the driver knows
    folders only, where a file stream keeps every file's name.  Without a list it is a file stream.
    """
    base = _local_path(spark, folder) if stream and by_folder else None
    if base and os.path.isdir(base + LISTED):
        return _folder_stream(spark, folder, base, files_per_batch)
    reader = spark.readStream.schema(BINARY_FILE) if stream else spark.read
    if stream and files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return (
        reader.format("binaryFile").option("recursiveFileLookup", True).load(folder)
        .select("path", "content")
    )


#: Folders between the root and the folders of the mails, so that no listing or commit holds all of them at once.
BUCKETS = 256
#: What the folder with a small file for each of these folders adds to the root's name.
LISTED = "-listed"
#: Bytes and files that a task of a folder stream holds at once.
READ_BYTES, READ_FILES = 4 << 20, 1000


def _local_path(spark: SparkSession, root: str) -> str | None:
    """The path of a folder on a local file system; None on any other."""
    place = spark._jvm.org.apache.hadoop.fs.Path(root)
    scheme = place.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme()
    return place.toUri().getPath() if scheme == "file" else None


def _folder_stream(spark: SparkSession, root: str, base: str, files_per_batch: int | None) -> DataFrame:
    """(path, content) of the files in the listed folders below ``base``, which the tasks list and read a few MB at a time."""
    place = spark._jvm.org.apache.hadoop.fs.Path(root)
    prefix = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()
    listed, schema = prefix + LISTED, "folder string, files bigint"
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        known = spark.read.schema(schema).json(listed).agg(F.count("folder").alias("folders"), F.sum("files").alias("files")).first()
        share = -(-known["folders"] * files_per_batch // max(1, known["files"] or 0))
        reader = reader.option("maxFilesPerTrigger", max(1, share))

    def below(folder: str) -> Iterator[str]:
        """The files that Spark's readers would take: none that is hidden or empty."""
        with os.scandir(folder) as entries:
            for entry in entries:
                hidden = entry.name[0] == "." or (entry.name[0] == "_" and "=" not in entry.name)
                if hidden or entry.name.endswith("._COPYING_"):
                    continue
                if entry.is_dir():
                    yield from below(entry.path)
                elif entry.stat().st_size:
                    yield entry.path

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(paths, contents):
            return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], ["path", "content"])

        paths, contents, size = [], [], 0
        for folder in (name for batch in batches for name in batch.column(0).to_pylist()):
            for path in below(os.path.join(base, folder)):
                with open(path, "rb") as file:
                    contents.append(file.read())
                paths.append(prefix + path[len(base):])
                size += len(contents[-1])
                if size >= READ_BYTES or len(paths) >= READ_FILES:
                    yield rows(paths, contents)
                    paths, contents, size = [], [], 0
        yield rows(paths, contents)

    return reader.json(listed).select("folder").mapInArrow(read, "path string, content binary")


def write_mail_dirs(mails: DataFrame, root: str) -> None:
    """Writes each ``value`` and a line feed as a file, in a folder that is named by ``box``, below one of a few hundred folders.

    Values of one box that meet in a task share a file.  On a local file system the tasks write the files themselves: Hadoop starts
    a process for the mode of every file there.  Other file systems get them from Spark's writer.  Once all files are there, the
    few hundred folders are listed for streams, with their numbers of files; what comes later to a listed folder is not.
    """
    base = _local_path(mails.sparkSession, root)
    if base is None:
        bucket = F.pmod(F.crc32("box"), F.lit(BUCKETS)).alias("bucket")
        mails.select("box", "value", bucket).write.partitionBy("bucket", "box").text(root)
        return

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, n = TaskContext.get(), Counter()
        name = f"part-{task.partitionId():05d}.txt"
        rows = (row for batch in batches for row in zip(batch["box"], batch["value"]))
        for box, group in itertools.groupby(rows, key=lambda row: row[0]):
            bucket = f"bucket={zlib.crc32(box.encode()) % BUCKETS}"
            folder = os.path.join(base, bucket, f"box={box}")
            os.makedirs(folder, exist_ok=True)
            # A file appears whole, so that a task that runs twice does no harm.
            part = os.path.join(folder, f".{name}-{task.taskAttemptId()}")
            with open(part, "wb") as out:
                for _, value in group:
                    out.write((value or "").encode() + b"\n")
            os.replace(part, os.path.join(folder, name))
            n[bucket] += 1
        yield pd.DataFrame({"folder": list(n), "files": list(n.values())}).astype({"folder": str, "files": "int64"})

    named = mails.select(F.coalesce("box", F.lit("unnamed")).alias("box"), "value")
    os.makedirs(base, exist_ok=True)
    written = named.sortWithinPartitions("box").mapInPandas(write, "folder string, files bigint")
    folders = written.groupBy("folder").agg(F.sum("files").alias("files")).collect()
    os.makedirs(base + LISTED, exist_ok=True)
    for row in folders:
        part = os.path.join(base + LISTED, f".{row['folder']}")
        with open(part, "w") as out:
            json.dump(row.asDict(), out)
        os.replace(part, os.path.join(base + LISTED, f"{row['folder']}.json"))


def file_name(path="path"):
    return F.element_at(F.split(path, "/"), -1)


def read_mail_dirs(
    spark: SparkSession, root: str, source: str = "spamassassin", stream: bool = False, files_per_batch: int | None = None,
    by_folder: bool = False,
) -> DataFrame:
    """Files labelled by their folder's name: ham if it contains ``ham``, else spam if ``spam``."""
    folder = F.lower(F.element_at(F.split("path", "/"), -2))
    label = F.when(folder.contains("ham"), "ham").when(folder.contains("spam"), "spam")
    return (
        read_mail_files(spark, root, stream, files_per_batch, by_folder).withColumn("label", label)
        .filter(F.col("label").isNotNull()).withColumn("source", F.lit(source))
    )


def read_trec_index(spark: SparkSession, path: str) -> DataFrame:
    """(label, file_name) of lines with exactly two fields; any label but spam is ham."""
    fields = F.split(tx.squeeze("value"), " ")
    return (
        spark.read.text(path).select(fields.alias("f")).filter(F.size("f") == 2)
        .select(
            F.when(F.lower(F.col("f")[0]) == "spam", "spam").otherwise("ham").alias("label"),
            file_name(F.col("f")[1]).alias("file_name"),
        )
    )


def read_trec(
    spark: SparkSession, index: str, data: str, source: str = "trec2007", stream: bool = False, files_per_batch: int | None = None
) -> DataFrame:
    """Indexed files that exist.  A later index line for the same file wins by label order only.

    With ``stream`` files are taken as they arrive, and matched with the index as it stands.
    """
    labels = read_trec_index(spark, index).groupBy("file_name").agg(F.max("label").alias("label"))
    files = read_mail_files(spark, data, stream, files_per_batch).withColumn("file_name", file_name())
    return files.join(labels, "file_name").drop("file_name").withColumn("source", F.lit(source))


def _plain(part) -> str:
    """Decoded content of a part; a part that cannot be decoded counts as empty."""
    try:
        content = part.get_content()
    except Exception:
        return ""
    if not isinstance(content, str):
        raise TypeError(f"no text in {part.get_content_type()}")
    return content


def _markup(part) -> str:
    """Payload bytes as text under the declared character set, else as UTF-8."""
    raw = part.get_payload(decode=True) or b""
    try:
        return raw.decode(part.get_content_charset() or "utf-8", "ignore")
    except LookupError:
        return raw.decode("utf-8", "ignore")


def _choose_body(message, body_policy: str) -> str:
    if body_policy == "all_plain":
        if not message.is_multipart():
            return _plain(message)
        return "".join(_plain(p) for p in message.walk() if p.get_content_type() == "text/plain")
    if not message.is_multipart():
        return _markup(message)
    for part in message.walk():
        shown = "attachment" not in str(part.get("Content-Disposition"))
        if shown and part.get_content_type() in ("text/html", "text/txt"):
            return _markup(part)
    return ""


def _decode_one(path: str, content: bytes, body_policy: str) -> dict:
    row = dict.fromkeys(
        ["from_email", "recipients", "sent", "subject_raw", "body_raw", "error"]
    )
    row["path"] = path
    try:
        message = email.message_from_bytes(bytes(content), policy=email.policy.default)
        row |= {
            "from_email": str(message.get("from") or ""), "recipients": str(message.get("to") or ""),
            "sent": str(message.get("date") or ""), "subject_raw": str(message.get("subject") or ""),
            "body_raw": _choose_body(message, body_policy),
        }
    except Exception as problem:
        row["error"] = f"{type(problem).__name__}: {problem}"
    return row


def parse_mail(files: DataFrame, body_policy: str = "all_plain") -> DataFrame:
    """Decoded mails next to the columns of ``files`` (which needs path and content).

    ``all_plain`` joins the plain-text parts; ``first_html`` takes the first
    shown HTML part and turns it into text.  A mail that cannot be decoded
    keeps its row, with the reason in ``error``.  Python does the MIME decoding
    only; cleaning is native.
    """
    if body_policy not in ("all_plain", "first_html"):
        raise ValueError(f"unknown policy {body_policy!r}")
    extra = [c for c in files.columns if c not in ("path", "content")]
    kinds = dict(files.dtypes)
    schema = PARSED + "".join(f", `{c}` {kinds[c]}" for c in extra)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                _decode_one(path, content, body_policy)
                for path, content in zip(batch["path"], batch["content"])
            ]
            out = pd.DataFrame(rows, columns=[f.split()[0] for f in PARSED.split(", ")])
            for c in extra:
                out[c] = batch[c].to_numpy()
            yield out

    raw = files.mapInPandas(decode, schema)
    cleaned = tx.clean_text("body_raw")
    body = tx.html_to_text("body_raw") if body_policy == "first_html" else cleaned
    return raw.select(
        F.sha2("path", 256).alias("mail_id"), "path", "from_email", "recipients", "sent",
        tx.clean_text("subject_raw").alias("subject"),
        body.alias("body"), "error", *extra,
    )


def read_csv_mail(
    spark: SparkSession, path: str, label: str | None = None, source: str = "csv",
) -> DataFrame:
    """CSV with sender, subject, body and, unless ``label`` is given, a 0/1 label (1 or 1.0 is spam).

    Rows with a null in any used column, or a label that isn't a number, are dropped.
    """
    df = (
        spark.read.option("header", True).option("multiLine", True)
        .option("quote", '"').option("escape", '"').csv(path)
    )
    mark = F.lit(label) if label else F.when(
        F.col("label").try_cast("double") == 1, "spam"
    ).when(F.col("label").try_cast("double").isNotNull(), "ham")
    return df.select(
        F.col("sender").alias("from_email"), "subject", "body", mark.alias("label"),
        F.lit(source).alias("source"),
    ).na.drop()


def with_mail_id(df: DataFrame, *columns: str) -> DataFrame:
    """Adds an id made from the row's own content, stable across runs and partitionings."""
    cols = columns or ("source", "from_email", "subject", "body")
    return df.withColumn(
        "mail_id", F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256)
    )


def without_repeats(files: DataFrame) -> DataFrame:
    """A stream of files without those whose content has come before, under whatever name.

    The state is a digest per different content.
    """
    return files.withColumn("digest_", F.sha2("content", 256)).dropDuplicates(["digest_"]).drop("digest_")
