"""Builds of a table as commits: each is a manifest in a log, made at once or not at all; unchanged parts are shared between builds.

Data files are written below a folder of their own for every attempt. A commit is one file of the log, ``00000007.json``, which names the build and,
for each part, its digest and the folder that holds it. It is written under another name and put in place only if no file of its number is there;
who comes too late reads the log again and takes the next number. So a writer that is killed before leaves files that nothing names, and
of writers at the same time each gets a commit of its own or an error. A part whose digest a committed build has is not written again.
"""

from __future__ import annotations

import json
import os
import uuid
from urllib.parse import urlparse
from urllib.request import url2pathname

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Parts of a build: what a manifest, which the driver holds, may name.
MOST_PARTS = 100_000


def _local(path: str) -> str | None:
    parsed = urlparse(path)
    return url2pathname(parsed.path) if parsed.scheme in ("", "file") else None


def _filesystem(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Write a whole file unless one of its name is there; whether it was written. Nobody ever sees a part of it."""
    local = _local(path)
    if local is not None:
        os.makedirs(os.path.dirname(local), exist_ok=True)
        unfinished = f"{local}.{uuid.uuid4().hex}.unfinished"
        with open(unfinished, "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(unfinished, local)  # fails where the name is taken
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(unfinished)
    jvm = spark._jvm
    fs, where = _filesystem(spark, path)
    unfinished = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.unfinished")
    out = fs.create(unfinished, False)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), spark._jsc.hadoopConfiguration())
    none = spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(unfinished, where, none)  # without OVERWRITE it fails where the name is taken
        return True
    except Exception as error:
        if fs.exists(where):
            fs.delete(unfinished, False)
            return False
        raise error


def log(spark: SparkSession, folder: str) -> list[dict]:
    """The manifests of all commits, the first one first; none where there is no log. Only whole files count."""
    local = _local(folder)
    if local is not None:
        path = os.path.join(local, "log")
        names = sorted(n for n in os.listdir(path) if n.endswith(".json")) if os.path.isdir(path) else []
        out = []
        for n in names:
            with open(os.path.join(path, n), encoding="utf-8") as f:
                out.append(json.load(f))
        return out
    fs, where = _filesystem(spark, f"{folder}/log")
    if not fs.exists(where):
        return []
    paths = sorted(s.getPath().toString() for s in fs.listStatus(where) if s.getPath().getName().endswith(".json"))
    texts = {r.path: r.value for r in spark.read.option("wholetext", True).text(paths).select("value", F.col("_metadata.file_path").alias("path")).collect()} if paths else {}
    return [json.loads(texts[p]) for p in sorted(texts)]


def part_digests(rows: DataFrame, part: str) -> DataFrame:
    """(part, rows, digest): 128 bits of each part's rows as a multiset: repeated rows count, their order doesn't."""
    columns = sorted(c for c in rows.columns if c != part)
    text = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    sums = [F.sum(F.xxhash64(text, F.lit(k)).cast("decimal(38,0)")) for k in (1, 2)]
    shape = F.lit(str(rows.select(*columns).schema.simpleString()))
    return rows.groupBy(F.col(part).alias("part")).agg(F.count("*").alias("rows"), F.sha2(F.concat_ws(":", F.count("*"), *sums, F.max(shape)), 256).alias("digest"))


def commit(rows: DataFrame, folder: str, build: str, part: str) -> dict:
    """Write ``rows`` as a build, part by part, and return its manifest. A build that is there is an error, and stays as it is.

    A null part is the part ``null``. An empty table is a build without parts, whose schema is kept.
    """
    spark, before = rows.sparkSession, log(rows.sparkSession, folder)
    if any(m["build"] == build for m in before):
        raise FileExistsError(f"build {build} stands already")
    named = rows.withColumn(part, F.coalesce(F.col(part).cast("string"), F.lit("null")))
    digests = part_digests(named, part).limit(MOST_PARTS + 1).collect()  # a row for each part, and no more than are checked
    if len(digests) > MOST_PARTS:
        raise ValueError(f"more than {MOST_PARTS} parts")
    known = {(p, x["digest"]): x["folder"] for m in before for p, x in m["parts"].items()}
    new = [r.part for r in digests if (r.part, r.digest) not in known]
    mine = f"data/{uuid.uuid4().hex}"
    if new:
        wanted = spark.createDataFrame([(p,) for p in new], f"{part} string")
        fresh = named.join(F.broadcast(wanted), part, "left_semi")  # as many rows as parts, which are checked
        fresh.withColumn("_part", F.md5(part)).write.partitionBy("_part").parquet(f"{folder}/{mine}")
    own = {r.part: f"{mine}/_part={_md5(r.part)}" for r in digests}
    parts = {r.part: {"digest": r.digest, "rows": r["rows"], "folder": known.get((r.part, r.digest)) or own[r.part]} for r in digests}
    return _put(spark, folder, {"build": build, "part": part, "schema": rows.schema.jsonValue(), "parts": parts})


def _md5(text: str) -> str:
    import hashlib

    return hashlib.md5(text.encode()).hexdigest()


def _put(spark: SparkSession, folder: str, manifest: dict) -> dict:
    while True:
        before = log(spark, folder)
        if any(m["build"] == manifest["build"] for m in before):
            raise FileExistsError(f"build {manifest['build']} stands already")
        if put_if_absent(spark, f"{folder}/log/{len(before) + 1:08}.json", json.dumps(manifest | {"number": len(before) + 1}, sort_keys=True)):
            return manifest | {"number": len(before) + 1}


def read(spark: SparkSession, folder: str, build: str | None = None, parts: list[str] | None = None) -> DataFrame:
    """A build, the last one if none is named, all or named parts; parts that are missing are all named in the error."""
    commits = log(spark, folder)
    found = [m for m in commits if build is None or m["build"] == build]
    if not found:
        raise FileNotFoundError(f"no build {build} in {folder}" if build else f"no build in {folder}")
    manifest = found[-1]
    if parts is not None and (missing := sorted(set(parts) - set(manifest["parts"]))):
        raise FileNotFoundError(f"no such parts: {', '.join(missing)}")
    chosen = [f"{folder}/{x['folder']}" for p, x in sorted(manifest["parts"].items()) if parts is None or p in parts]
    shape = StructType.fromJson(manifest["schema"])
    return spark.read.schema(shape).parquet(*chosen) if chosen else spark.createDataFrame([], shape)
