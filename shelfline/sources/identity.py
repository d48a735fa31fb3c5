"""File identity audit and manifest conflicts as table jobs.

SHA-256 runs through a file's bytes in order.  A file of more than a block is hashed
block by block in one task each: the digest's state, some hundred bytes, goes from a
block's task to the next one's, and all such files advance side by side.  Blocks are
read directly or, on a store that Spark alone reads, as Spark's splits of the file.
"""

from __future__ import annotations

import _hashlib
import ctypes
import hashlib
import re
from collections.abc import Iterator
from urllib.parse import urlparse

from pyarrow import fs
from pyspark import RDD, SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.session import _hadoop_path

#: Most bytes of one file that a task reads, and bytes that it holds of it.
BLOCK = 128 << 20
PIECE = 4 << 20

#: Records of a split.  Its last record has to be whole, which leaves the end of a file to
#: splits and records smaller by a factor.
RECORDS, FINER = 128, 16

#: OpenSSL's SHA256_CTX: eight words, bit count of two, sixteen words of data, two counters.
_STATE_BYTES = 112


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _opened(path: str):
    """A file of a Spark path, which is no quoted URI."""
    scheme, rest = path.split(":", 1)
    if scheme == "file":
        return fs.LocalFileSystem().open_input_file("/" + rest.lstrip("/"))
    authority, key = rest.lstrip("/").split("/", 1)
    store, root = fs.FileSystem.from_uri(f"{scheme}://{authority}")
    return store.open_input_file(f"{root.rstrip('/')}/{key}")


def _reached(path: str) -> bool:
    """Whether parts of a file can be read without Spark's readers."""
    try:
        _opened(path).close()
    except (ValueError, OSError, NotImplementedError):
        return False
    return True


class _Digest:
    """SHA-256 whose state between two updates is bytes, by the OpenSSL that hashlib uses."""

    def __init__(self, state: bytes | None) -> None:
        self.lib = ctypes.CDLL(_hashlib.__file__)
        self.state = ctypes.create_string_buffer(state or _STATE_BYTES, _STATE_BYTES)
        if state is None:
            self.lib.SHA256_Init(self.state)

    def update(self, data: bytes) -> None:
        self.lib.SHA256_Update(self.state, ctypes.c_char_p(data), ctypes.c_size_t(len(data)))

    def hexdigest(self) -> str:
        out = ctypes.create_string_buffer(32)
        self.lib.SHA256_Final(out, self.state)
        return out.raw.hex()


def resumable() -> bool:
    """Whether this Python's OpenSSL can be asked for a digest's state."""
    return hasattr(ctypes.CDLL(_hashlib.__file__), "SHA256_Update")


def next_block(path: str, length: int, at: int, state: bytes | None, block: int) -> tuple[str, int, int, bytes | None, str | None]:
    """The same five values after one more block; the last one's have the digest.

    Without a state to hand on, a task goes through the whole file, a piece at a time.
    """
    kept = resumable()
    digest = _Digest(state) if kept else hashlib.sha256()
    end = min(length, at + block) if kept else length
    with _opened(path) as file:
        file.seek(at)
        while at < end:
            data = file.read(min(PIECE, end - at))
            if not data:
                raise OSError(f"{path} became shorter while it was hashed")
            digest.update(data)
            at += len(data)
    if at == length:
        return path, length, at, None, digest.hexdigest()
    return path, length, at, digest.state.raw, None


def _long_files(spark: SparkSession, files: list[tuple[str, int]], block: int) -> list[tuple[str, str]]:
    """(path, sha256) of long files: a round of tasks for each block, a task for each file with bytes left."""
    done, left = [], [(path, length, 0, None, None) for path, length in files]
    while left:
        left = spark.sparkContext.parallelize(left, len(left)).map(lambda x: next_block(*x[:4], block)).collect()
        done += [(path, sha) for path, _, _, _, sha in left if sha]
        left = [x for x in left if not x[4]]
    return done


def _splittable(spark: SparkSession, path: str) -> bool:
    """Whether Spark's splits hold a file's bytes as they are, neither decompressed nor left out as hidden."""
    found, _ = _hadoop_path(spark, path)
    codecs = spark._jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(spark._jsc.hadoopConfiguration())
    return codecs.getCodec(found) is None and not found.getName().startswith(("_", "."))


def _records(sc: SparkContext, path: str, record: int, split: int) -> RDD:
    """(offset, bytes) of a file's records of fixed length, a partition for each split."""
    pattern = re.sub(r"([\\{}\[\]*?,^])", r"\\\1", path)
    return sc.newAPIHadoopRDD(
        "org.apache.hadoop.mapreduce.lib.input.FixedLengthInputFormat",
        "org.apache.hadoop.io.LongWritable",
        "org.apache.hadoop.io.BytesWritable",
        conf={
            "mapreduce.input.fileinputformat.inputdir": re.sub(r"([\\,])", r"\\\1", pattern),
            "mapreduce.input.fileinputformat.split.minsize": str(split),
            "mapreduce.input.fileinputformat.split.maxsize": str(split),
            "fixedlengthinputformat.record.length": str(record),
        },
    )


def splits(sc: SparkContext, path: str, length: int, block: int) -> list[tuple[RDD, int]]:
    """(records, partition) that hold a file's bytes once and in order, a block and a tenth at most in each.

    Every level but the last one goes as far as its records are whole; the length of the
    last one's divides the file's.  The block is a power of two, of half a MB at least.
    """
    records = [max(1, block // RECORDS // FINER**x) for x in range(3)]
    least = next(x for x in range(min(records[-1], length), 0, -1) if length % x == 0)
    levels = [(x, x * RECORDS) for x in records] + [(least, records[-1] * RECORDS // least * least)]
    out, at = [], 0
    for record, split in levels:
        rows = _records(sc, path, record, split)
        whole = length % record == 0
        last = rows.getNumPartitions() - (not whole)
        out += [(rows, x) for x in range(at // split, last)]
        at = max(at, last * split)
        if whole:
            break
    return out


def next_split(records: Iterator[tuple[int, bytes]], length: int, at: int, state: bytes | None) -> tuple[int, bytes | None, str | None]:
    """Bytes hashed, state and, at the file's end, digest after one more split; what an earlier split held is passed over."""
    digest, piece = _Digest(state), bytearray()
    for offset, data in records:
        if offset + len(data) <= at:
            continue
        if offset > at:
            raise OSError(f"bytes {at} to {offset} of a file are missing")
        piece += data[at - offset :]
        at = offset + len(data)
        if len(piece) >= PIECE:
            digest.update(bytes(piece))
            piece.clear()
    digest.update(bytes(piece))
    return (at, None, digest.hexdigest()) if at == length else (at, digest.state.raw, None)


def _long_files_by_spark(spark: SparkSession, files: list[tuple[str, int]], block: int) -> list[tuple[str, str]]:
    """(path, sha256) of long files: a round of tasks for each split, a task for each file with splits left."""
    sc = spark.sparkContext
    steps = {path: splits(sc, path, length, block) for path, length in files}
    levels = list({id(rows): rows for x in steps.values() for rows, _ in x}.values())
    first, begin = {}, 0
    for rows in levels:
        first[id(rows)] = begin
        begin += rows.getNumPartitions()
    together = sc.union(levels)
    lengths, states, done = dict(files), {path: (0, None) for path, _ in files}, []
    for number in range(max(map(len, steps.values()))):
        now = {first[id(x[number][0])] + x[number][1]: path for path, x in steps.items() if number < len(x)}
        tasks = {part: (path, lengths[path], *states[path]) for part, path in now.items()}

        def hashed(part, records, tasks=tasks):
            path, *left = tasks[part]
            yield path, *next_split(records, *left)

        for path, at, state, sha in sc.runJob(together.mapPartitionsWithIndex(hashed), list, list(now)):
            states[path] = at, state
            done += [(path, sha)] if sha else []
    if len(done) < len(files):
        raise OSError(f"the end of {len(files) - len(done)} files was not reached")
    return done


def file_hashes(spark: SparkSession, folder: str, pattern: str = "*", block: int = BLOCK) -> DataFrame:
    """(file, sha256) of every file below a folder, hashed on the executors.

    ``file`` is the path relative to the folder, so equal base names stay apart.  Files
    of more than a block are hashed at once, in rounds; only their names, states and
    digests reach the driver.  Where Spark's splits would not hold a file's own bytes
    (names of a compression codec, on a store that Spark alone reads) it is read whole,
    like the shorter ones, and has to be under 2 GB.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .load(folder)
    )
    root = urlparse(folder).path.rstrip("/") + "/"
    name = F.expr("substring(path, instr(path, :root) + length(:root))".replace(":root", _literal(root)))
    found = [tuple(r) for r in files.where(F.col("length") > block).select("path", "length").collect()]
    short = F.col("length") <= block
    if not found or _reached(found[0][0]):
        hashed = _long_files(spark, found, block)
    else:
        split = [x for x in found if resumable() and _splittable(spark, x[0])]
        whole = [path for path, _ in found if path not in dict(split)]
        short = short | F.col("path").isin(whole) if whole else short
        hashed = _long_files_by_spark(spark, split, block) if split else []
    if not hashed:
        return files.select(name.alias("file"), F.sha2("content", 256).alias("sha256"))
    return (
        files.where(short)
        .select("path", F.sha2("content", 256).alias("sha256"))
        .union(spark.createDataFrame(hashed, "path string, sha256 string"))
        .select(name.alias("file"), "sha256")
    )


def audit_files(actual: DataFrame, manifest: DataFrame) -> DataFrame:
    """OK, MISMATCH, MISSING or UNLISTED for every file either side knows."""
    expected = manifest.select("file", F.col("sha256").alias("expected"))
    found = actual.select("file", F.col("sha256").alias("actual"))
    status = (
        F.when(F.col("actual").isNull(), "MISSING")
        .when(F.col("expected").isNull(), "UNLISTED")
        .when(F.col("actual") == F.col("expected"), "OK")
        .otherwise("MISMATCH")
    )
    return expected.join(found, "file", "full_outer").withColumn("status", status)


def audit_counts(audit: DataFrame) -> DataFrame:
    """Matched and listed file counts; passed needs every listed file to match."""
    ok = F.count_if(F.col("status") == "OK")
    listed = F.count_if(F.col("status") != "UNLISTED")
    return audit.agg(
        ok.alias("matched"),
        listed.alias("listed"),
        ((ok == listed) & (listed > 0)).alias("passed"),
    )


def manifest_conflicts(manifests: DataFrame) -> DataFrame:
    """Paths for which the united manifests state different hashes."""
    return (
        manifests.groupBy("file")
        .agg(
            F.count(F.lit(1)).alias("entries"),
            F.count_distinct("sha256").alias("hashes"),
        )
        .where("hashes > 1")
    )
