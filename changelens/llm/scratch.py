"""Tables that an operator writes between two of its steps.

Every multi-step operator cuts its lineage by writing Parquet to the shared folder that the cluster names in
``spark.checkpoint.dir``; a lost executor then costs a re-read, never a recomputation of the whole chain.
"""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only where everything runs on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if "dir" not in _LOCAL:
        _LOCAL["dir"] = "file://" + tempfile.mkdtemp(prefix="changelens-")
    return _LOCAL["dir"]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return a scan of what was written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(columns: list[str], *names: str) -> list[str]:
    """``names``, each with underscores before it until no column has it, whatever its case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def probably_in(rows: DataFrame, ids: DataFrame, column: str, flag: str | None = None) -> DataFrame:
    """The rows whose ``column`` is in the one column of ``ids``, and a few others, without a shuffle of ``rows``.

    The hashed ids become a bitmap of at most 2**28 bits (32 MB), which is broadcast; when it fills up at very large
    sizes more other rows pass, none is lost. With ``flag``, a name that no column has, all rows stay and the answer
    goes to that column.
    """
    bits = min(28, max(18, math.ceil(math.log2(max(1, ids.count()))) + 4))
    at, part, bitmap = fresh(rows.columns, "_slot", "_part", "_bitmap")
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << bits))
    maps = ids.select(slot(ids.columns[0]).alias(at)).groupBy(F.shiftright(at, 15).alias(part)).agg(F.bitmap_construct_agg(F.col(at) % 32768).alias(bitmap))
    joined = rows.withColumn(at, slot(column)).withColumn(part, F.shiftright(at, 15)).join(F.broadcast(maps), part, "left")
    byte = F.conv(F.hex(F.substring(bitmap, F.shiftright((F.col(at) % 32768).cast("int"), 3) + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, (F.col(at) % 8).cast("int")) == 1, F.lit(False))
    return joined.where(hit).select(*rows.columns) if flag is None else joined.select(*rows.columns, hit.alias(flag))


def join_facts(rows: DataFrame, facts: DataFrame, *key: str, share: int = 1000) -> DataFrame:
    """Inner join of ``rows`` with ``facts`` (one row per ``key``, and ``copies``: how many of ``rows`` have it).

    Keys that hold more than one in ``share`` of the rows, fewer than ``share`` of them, are broadcast, so their rows
    stay where they are; the others are joined by shuffle.
    """
    total = facts.agg(F.sum("copies")).first()[0] or 0
    hot = facts.where(F.col("copies") * share > total)
    few = rows.join(F.broadcast(hot.drop("copies")), list(key))
    names = few.columns
    others = rows.join(F.broadcast(hot.select(*key)), list(key), "left_anti").join(facts.where(F.col("copies") * share <= total).drop("copies"), list(key))
    return few.unionByName(others.select(*names))
