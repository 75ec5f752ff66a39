"""Session and settings."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
import uuid
from collections.abc import Mapping
from dataclasses import asdict, dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(app: str = "lexiloom", cores: str = "*", shuffle_partitions: int | None = None) -> SparkSession:
    """A session with adaptive execution; a cluster's own settings win."""
    builder = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", shuffle_partitions)
    return builder.master(f"local[{cores}]").getOrCreate() if not SparkSession.getActiveSession() else builder.getOrCreate()


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores where its source gives fewer partitions than there are cores.

    A small table is often one row group and would keep one core busy.  A table
    with more partitions than cores passes unchanged, so nothing large is moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_folder(spark: SparkSession) -> str:
    """A folder that driver and executors see: ``spark.checkpoint.dir``, or on a local master a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return named or os.path.join(tempfile.gettempdir(), "lexiloom-shared")


def kept(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back.

    It is computed once however often it is used, and the planner knows its
    size, so that a few rows are sent to a large table and not the other way.
    """
    path = f"{shared_folder(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def version_of(table: DataFrame) -> str:
    """A digest of a table's files: their names, sizes and times of change."""
    files = table.select("_metadata.file_path", "_metadata.file_size", F.unix_micros("_metadata.file_modification_time").alias("t")).distinct()
    found = files.agg(F.bit_xor(F.xxhash64("file_path", "file_size", "t")).alias("x"), F.count(F.lit(1)).alias("n")).first()
    return f"{found.n}-{(found.x or 0) & (1 << 64) - 1:016x}"


@dataclass(frozen=True)
class ChunkSettings:
    """Budgets of the chunker: in characters, or in tokens where a tokenizer's file is named.

    In tokens the limit is ``max_tokens``, or else the smaller of the
    tokenizer's own window and ``target_tokens``; the overlap keeps its share.
    """

    max_chars: int = 1000
    overlap: int = 100
    min_chars: int | None = None
    parent_chars: int = 4000
    formulas: str = "inline"  # or "context"
    row_records: bool = True
    table_profiles: bool = True
    max_tokens: int | None = None
    tokenizer: str | None = None
    target_tokens: int = 480

    def __post_init__(self):
        if self.max_chars <= 0:
            raise ValueError("max_chars must be positive")
        if not 0 <= self.overlap < self.max_chars:
            raise ValueError("overlap must be from 0 to below max_chars")
        if self.min_chars is not None and self.min_chars < 0:
            raise ValueError("min_chars must not be negative")
        if self.max_tokens is not None and self.max_tokens <= 0:
            raise ValueError("max_tokens must be positive")
        if self.formulas not in ("inline", "context"):
            raise ValueError("formulas must be inline or context")

    @property
    def minimum(self) -> int:
        return self.min_chars if self.min_chars is not None else max(1, self.max_chars // 3)


@dataclass(frozen=True)
class SearchSettings:
    """Defaults of hybrid retrieval."""

    top_k: int = 5
    rrf_k: int = 60
    min_cosine: float = 0.25
    k1: float = 1.2
    b: float = 0.75
    diversify: bool = True
    unique: bool = True
    rerank: bool = False
    rerank_candidates: int = 0
    rerank_blend: float = 0.0
    variant_weight: float = 0.5

    def __post_init__(self):
        if not 0 <= self.rerank_blend <= 1:
            raise ValueError("rerank_blend must be from 0 to 1")
        if not -1 <= self.min_cosine <= 1:
            raise ValueError("min_cosine must be from -1 to 1")
        if not 0 <= self.variant_weight <= 1:
            raise ValueError("variant_weight must be from 0 to 1")

    @property
    def pool(self) -> int:
        """First-stage candidates per query."""
        n = self.top_k
        if self.rerank:
            n = max(6 * self.top_k, 30, self.rerank_candidates)
        if self.diversify:
            n = max(n, 20)
        return max(n, 3 * self.top_k) if self.unique else n


YES = ("1", "true", "yes", "on")


def settings_from(kind: type, values: Mapping[str, str], prefix: str = "", lenient: bool = False):
    """A settings object from text values, as of an environment; names are upper case after ``prefix``.

    Blank values count as missing.  What isn't a number is an error, or with
    ``lenient`` the default.
    """
    found = {}
    for f in fields(kind):
        raw = (values.get(prefix + f.name.upper()) or "").strip()
        if not raw:
            continue
        sort = str(f.type).split(" ")[0]
        try:
            found[f.name] = raw.lower() in YES if sort == "bool" else int(raw) if sort == "int" else float(raw) if sort == "float" else raw
        except ValueError:
            if not lenient:
                raise ValueError(f"{prefix}{f.name.upper()} must be a number, not {raw!r}") from None
    return kind(**found)


def fingerprint(*settings, **more) -> str:
    """A digest of settings, for run manifests and resume checks."""
    payload = [asdict(s) for s in settings] + [more]
    return hashlib.sha256(json.dumps(payload, sort_keys=True, ensure_ascii=False, default=str).encode()).hexdigest()
