"""Measurement store on plain Parquet: append-only loads, replace-by-file at read time.

A load is claimed, written and committed. The claim is one folder claims/source=S/load=N: a row per file taken on, and one row
without a key for the attempt itself, with its number and the writer's token. Rows go to measurements/load=N, and the
load becomes visible when its file events are appended to the ledger. Every attempt at a source has a load number of its own,
and only the events of a source's newest attempt count: a writer that was given up and commits late is not seen.

Rows of a file are live when the file's newest outcome is the Stored event of the same load; re-delivered and rejected files
need no rewrite of older data. Reading anti-joins the few superseded (file, load) pairs. `compact` folds all tables into a fresh
store: the ledger becomes a snapshot, one row per key and per source, and later loads append behind it.

Claims are taken by one writer at a time, as with any single streaming query; the fence is for writers that are late.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ledger import MISSING, claim_events, ledger_view

# The tables' columns.
LEDGER_SCHEMA = (
    "key STRING, status STRING, run_id STRING, pipeline STRING, pipeline_version INT, format STRING, checksum STRING, "
    "size_bytes BIGINT, row_count INT, invalid_row_count INT, stored_count INT, failed_step STRING, error STRING, "
    "created_at TIMESTAMP, updated_at TIMESTAMP, completed_at TIMESTAMP, token STRING, last_id BIGINT, load BIGINT, source STRING"
)
# A snapshot's row also says how many attempts it stands for.
SNAPSHOT_SCHEMA = LEDGER_SCHEMA + ", earlier_attempts INT"
SOURCE_SCHEMA = "source STRING, load BIGINT, attempt INT, last_id BIGINT"
CLAIM_SCHEMA = (
    "key STRING, path STRING, status STRING, run_id STRING, failed_step STRING, error STRING, created_at TIMESTAMP, updated_at TIMESTAMP, "
    "completed_at TIMESTAMP, attempt INT, token STRING, load BIGINT, source STRING"
)
MEASUREMENT_SCHEMA = (
    "id BIGINT, file_key STRING, line_number INT, sensor_id STRING, timestamp TIMESTAMP, value DOUBLE, unit STRING, "
    "load BIGINT, sensor_type STRING"
)
CATEGORIZED_SCHEMA = (
    "id BIGINT, file_key STRING, line_number INT, sensor_id STRING, timestamp TIMESTAMP, value DOUBLE, unit STRING, "
    "load BIGINT, batch_number INT, category STRING, categorized_at TIMESTAMP, categorized_by_job STRING, "
    "job_base STRING, span STRING, step INT, sensor_type STRING"
)
RESULT_SCHEMA = (
    "job_id STRING, sensor_type STRING, batch_number INT, sensor_id STRING, count BIGINT, min DOUBLE, max DOUBLE, "
    "avg DOUBLE, low_count BIGINT, normal_count BIGINT, high_count BIGINT, critical_count BIGINT, created_at TIMESTAMP, "
    "job_base STRING, span STRING, step INT"
)
FAILURE_SCHEMA = (
    "job_id STRING, sensor_type STRING, batch_number INT, failed_step STRING, error STRING, rows BIGINT, job_base STRING, span STRING, step INT"
)
JOB_SCHEMA = (
    "job_id STRING, sensor_type STRING, status STRING, pipeline STRING, pipeline_version INT, processed BIGINT, batches BIGINT, "
    "failed_batches BIGINT, error STRING, from_load BIGINT, to_load BIGINT, started_at TIMESTAMP, updated_at TIMESTAMP, "
    "completed_at TIMESTAMP, job_base STRING, span STRING"
)
PROGRESS_SCHEMA = JOB_SCHEMA + ", step INT"
REPORT_SCHEMA = "file_key STRING, report STRING, load BIGINT"
SCAN_SCHEMA = (
    "at TIMESTAMP, listed BIGINT, dispatched BIGINT, already_running BIGINT, throttled BIGINT, missing BIGINT, re_dispatched BIGINT, swept BOOLEAN, source STRING"
)

SCAN_COUNTS = ["listed", "dispatched", "already_running", "throttled", "missing", "re_dispatched"]

# Ids of one part of a compacted table; parts of a table without ids go by batches.
PART_IDS, PART_BATCHES = 1 << 20, 1 << 10

# A span of at most so many loads is read by naming its folders, a longer one by listing the table. The rows are the same.
FOLDERS_NAMED = 500


class LateWriter(RuntimeError):
    """A newer attempt at the same source was claimed; this one's rows will not be seen."""


@dataclass(frozen=True)
class Claim:
    """One attempt at a load."""

    source: str
    load: int
    attempt: int
    token: str


def folder_value(text: str) -> str:
    """A partition value as Spark spells it in a folder name; reading gives the text back."""
    return re.sub("[\x00-\x1f\x7f\"#%'*/:=?\\\\{}\\[\\]^]", lambda m: f"%{ord(m[0]):02X}", text)


def replace_by_key(existing: DataFrame, new: DataFrame, keys: list[str], replaced: DataFrame | None = None) -> DataFrame:
    """Drop every existing row whose key is replaced, add the new rows.

    `replaced` names the keys where a key may lose its rows without getting new ones.
    """
    gone = (new if replaced is None else replaced).select(*keys).distinct()
    # The keys are hashed, a shuffle partition's at a time; a merge join would sort all rows.
    return existing.join(gone.hint("shuffle_hash"), keys, "left_anti").unionByName(new)


def empty_table(spark: SparkSession, schema: str) -> DataFrame:
    columns = [F.lit(None).cast(kind).alias(name) for name, kind in (c.strip().split(" ") for c in schema.split(","))]
    return spark.sql("SELECT 1 AS none WHERE false").select(*columns)


def literal_array(values: list, kind: str) -> Column:
    """A list as one constant, whatever its length."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def of_claim(claims: list[Claim], part: Column) -> Column:
    """Load, attempt, token and source of the claim with that place in a list."""
    return F.get(literal_array([asdict(c) for c in claims], "struct<source: string, load: bigint, attempt: int, token: string>"), part)


def part_of(claims: list[Claim]) -> Column:
    """The place of a row's claim in a list of claims, whose load numbers follow each other."""
    return (F.col("load") - claims[0].load).cast("int").alias("part")


class SensorStore:
    """Folders of one store and the ways to read and extend them."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self._next_load: int | None = None
        self._next_id: int | None = None
        self._last_sweep: tuple[int | None] | None = None

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _read(self, table: str, schema: str, below: str = "") -> DataFrame:
        """A table, or only the folders below it that match; an absent one is empty."""
        place = f"{self.path(table)}/{below}".rstrip("/")
        if not self._exists(place):
            return empty_table(self.spark, schema)
        return self.spark.read.schema(schema).option("basePath", self.path(table)).parquet(place)

    def _exists(self, pattern: str) -> bool:
        """Whether any folder has such a name."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(pattern)
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path)
        return found is not None and len(found) > 0

    @staticmethod
    def _write(rows: DataFrame, path: str, partitions: tuple[str, ...] = ()) -> None:
        """Write a folder whole; writing it again replaces it."""
        writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "static")
        (writer.partitionBy(*partitions) if partitions else writer).parquet(path)

    # -- claims ---------------------------------------------------------------

    def claims(self) -> DataFrame:
        """All claims: a row per key and attempt, and one without a key per attempt."""
        return self._read("claims", CLAIM_SCHEMA)

    def _sources(self) -> DataFrame:
        """Sources folded away by a compaction."""
        return self._read("snapshot/sources", SOURCE_SCHEMA)

    def newest_attempts(self) -> DataFrame:
        """(source, load) of each source's newest attempt. Only folder names are read of the claims."""
        return self.claims().select("source", "load").groupBy("source").agg(F.max("load").alias("load"))

    def _own_claims(self, source: str) -> DataFrame:
        return self._read("claims", CLAIM_SCHEMA, f"source={folder_value(source)}").where("key is null")

    def _of_sources(self, table: str, schema: str, folders: list[str]) -> DataFrame:
        """The folders of some sources; those that are absent are left out, and without any nothing is read."""
        there = [f"{self.path(table)}/{folder}" for folder in folders if self._exists(f"{self.path(table)}/{folder}")]
        if not there:
            return empty_table(self.spark, schema)
        return self.spark.read.schema(schema).option("basePath", self.path(table)).parquet(*there)

    def _newest_claims(self, sources: list[str]) -> dict[str, tuple[int, int]]:
        """(load, attempt) of the newest claims of some sources."""
        own = self._of_sources("claims", CLAIM_SCHEMA, [f"source={folder_value(s)}" for s in sources]).where("key is null")
        return {r["source"]: (r["load"], r["attempt"]) for r in own.groupBy("source").agg(F.max("load").alias("load"), F.max("attempt").alias("attempt")).collect()}

    def _folded_attempts(self, sources: list[str]) -> dict[str, int]:
        folded = self._sources().where(F.col("source").isin(sources)).groupBy("source").agg(F.max("attempt").alias("attempt"))
        return {r["source"]: r["attempt"] for r in folded.collect()}

    def claimed_sources(self, sources: list[str]) -> set[str]:
        """Those sources that were ever claimed, folded ones too."""
        return {*self._newest_claims(sources), *self._folded_attempts(sources)}

    def claim_all(self, sources: list[str], keys: DataFrame, as_of: Column) -> list[Claim]:
        """Take the files (part, key, path) of several loads on, as `claim` does for one; `part` says which source a file goes to."""
        own, folded, first = self._newest_claims(sources), self._folded_attempts(sources), self.next_load()
        attempts = [max(own.get(s, (0, 0))[1], folded.get(s, 0)) + 1 for s in sources]
        claims = [Claim(s, first + i, attempt, uuid.uuid4().hex) for i, (s, attempt) in enumerate(zip(sources, attempts))]
        marks = self.spark.range(0, len(claims), 1, 1).select(F.col("id").cast("int").alias("part"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("path"))
        own_values = of_claim(claims, F.col("part"))
        rows = keys.select("part", "key", "path").unionByName(marks).withColumn("_claim", own_values)
        rows = claim_events(rows.select("part", "key", "path", "_claim"), F.col("_claim.source"), as_of)
        self._write_loads(rows.select("*", "_claim.attempt", "_claim.token", "_claim.load", "_claim.source").drop("_claim"), "claims", len(claims), ("source", "load"))
        self._next_load = first + len(claims)
        return claims

    def _write_loads(self, rows: DataFrame, table: str, loads: int, partitions: tuple[str, ...]) -> None:
        """Write the folders of several loads by one job, each load's rows (part) by one task; other folders stay."""
        dealt = rows.repartitionById(loads, "part").drop("part")
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(self.path(table))

    def claim(self, source: str, keys: DataFrame, as_of: Column) -> Claim:
        """Take files (key, path) on: the next attempt at a source, with a load number of its own."""
        own = self._own_claims(source).agg(F.coalesce(F.max("attempt"), F.lit(0))).first()[0]
        folded = self._sources().where(F.col("source") == source).agg(F.coalesce(F.max("attempt"), F.lit(0))).first()[0]
        claim = Claim(source, self.next_load(), max(own, folded) + 1, uuid.uuid4().hex)
        mark = self.spark.range(0, 1, 1, 1).select(F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("path"))
        rows = claim_events(keys.select("key", "path").unionByName(mark), F.lit(source), as_of)
        rows = rows.withColumns({"attempt": F.lit(claim.attempt), "token": F.lit(claim.token)})
        self._write(rows, f"{self.path('claims')}/source={folder_value(source)}/load={claim.load}")
        self._next_load = claim.load + 1
        return claim

    def abandoned(self, before: Column) -> DataFrame:
        """Claimed files of newest attempts that were not committed and were claimed before a time: nobody is working on them."""
        claims = self.claims().join(self.newest_attempts(), ["source", "load"], "left_semi")
        done = self.events().select("source").distinct()
        return claims.where((F.col("updated_at") < before) & F.col("key").isNotNull()).join(done, "source", "left_anti")

    # -- ledger ---------------------------------------------------------------

    def events(self) -> DataFrame:
        """Outcomes of committed loads: those of each source's newest attempt, and what a compaction kept."""
        newest = self.newest_attempts().withColumnRenamed("load", "_newest")
        tail = self._read("ledger", LEDGER_SCHEMA).join(newest, "source", "left")
        tail = tail.where(F.col("_newest").isNull() | (F.col("load") == F.col("_newest"))).drop("_newest")
        return self._read("snapshot/ledger", SNAPSHOT_SCHEMA).unionByName(tail.withColumn("earlier_attempts", F.lit(None).cast("int")))

    def files(self) -> DataFrame:
        """Current row per file: its newest outcome, or Processing while a newer attempt is under way. Attempts counts the
        attempts at the file, those that died too."""
        outcomes = self.events()
        committed = outcomes.select("source", "load").distinct()
        # Claims of attempts that died or were committed count as attempts, but are not shown.
        open_ = self.newest_attempts().join(committed, ["source", "load"], "left_anti").withColumn("_open", F.lit(True))
        claims = self.claims().where("key is not null").join(open_, ["source", "load"], "left")
        claims = claims.withColumn("_rank", F.when(F.col("_open"), F.lit(2)).otherwise(0)).drop("path", "attempt", "_open")
        # A file that was gone when it was asked for keeps the row it had.
        outcomes = outcomes.withColumn("_rank", F.when(F.col("status") == MISSING, 1).otherwise(2))
        both = outcomes.unionByName(claims, allowMissingColumns=True)
        return ledger_view(both.where(F.col("key").isNotNull()), ["_rank", "load"], "token").drop("_rank", "last_id")

    def last_load(self) -> int:
        """Number of the newest committed load, 0 when there is none."""
        return self.events().agg(F.coalesce(F.max("load"), F.lit(0))).first()[0]

    def next_load(self) -> int:
        """Number for the next attempt. The store is asked once; this writer counts on from there."""
        if self._next_load is None:
            claimed = self.claims().agg(F.max("load")).first()[0] or 0
            folded = self._sources().agg(F.max("load")).first()[0] or 0
            self._next_load = max(self.last_load(), claimed, folded) + 1
        return self._next_load

    def next_id(self) -> int:
        """The first free measurement id: a running number over all committed loads, asked once."""
        if self._next_id is None:
            folded = self._sources().agg(F.max("last_id")).first()[0] or 0
            self._next_id = max(folded, self.events().agg(F.max("last_id")).first()[0] or 0) + 1
        return self._next_id

    def committed(self, source: str) -> bool:
        """Whether a source's newest attempt is in the ledger; of the ledger and the claims only its own folders are listed."""
        newest = self._own_claims(source).agg(F.max("load")).first()[0]
        below = f"source={folder_value(source)}" + (f"/load={newest}" if newest is not None else "")
        if not self._read("ledger", LEDGER_SCHEMA, below).limit(1).isEmpty():
            return True
        return not self._sources().where(F.col("source") == source).isEmpty()

    def committed_sources(self, sources: list[str]) -> set[str]:
        """Those of some sources that are committed, as `committed` tells of one."""
        newest = self._newest_claims(sources)
        below = [f"source={folder_value(s)}" + (f"/load={newest[s][0]}" if s in newest else "") for s in sources]
        done = self._of_sources("ledger", LEDGER_SCHEMA, below).select("source").distinct().collect()
        return {*(r["source"] for r in done), *self._folded_attempts(sources)}

    def superseded(self, after: int = 0) -> DataFrame:
        """(file_key, load) of stored loads past `after` that a newer outcome of the file replaced.

        Newer events have higher load numbers, so earlier ones need not be read. A file that was missing replaces nothing.
        """
        events = self.events().where((F.col("load") > after) & F.col("key").isNotNull() & (F.col("status") != MISSING))
        events = events.select(F.col("key").alias("file_key"), "load", "status")
        newest = events.groupBy("file_key").agg(F.max("load").alias("newest"))
        replaced = events.where(F.col("status") == "Stored").join(newest, "file_key")
        return replaced.where(F.col("load") < F.col("newest")).select("file_key", "load")

    # -- loads ----------------------------------------------------------------

    def write_load(self, load: int, readings: DataFrame) -> None:
        """Write the readings of one load, with their ids; writing the same load again replaces it whole."""
        columns = ["id", "file_key", "line_number", "sensor_id", "sensor_type", "timestamp", "value", "unit"]
        self._write(readings.select(*columns), f"{self.path('measurements')}/load={load}", ("sensor_type",))

    def write_all_loads(self, claims: list[Claim], readings: DataFrame) -> None:
        """Write the readings (load) of several loads, with their ids."""
        columns = ["load", "id", "file_key", "line_number", "sensor_id", "sensor_type", "timestamp", "value", "unit"]
        self._write_loads(readings.select(part_of(claims), *columns), "measurements", len(claims), ("load", "sensor_type"))

    def converted_path(self, load: int) -> str:
        """Where the normalized readings of a load lie."""
        return f"{self.path('converted')}/load={load}"

    def write_reports(self, load: int, reports: DataFrame) -> None:
        self._write(reports, f"{self.path('reports')}/load={load}")

    def commit_load(self, claim: Claim, events: DataFrame, last_id: int | None = None) -> None:
        """Append the file events: from here on the load is visible, unless a newer attempt was claimed. A load without any file
        leaves one row without a key."""
        newest = self._own_claims(claim.source).agg(F.max("load")).first()[0]
        if newest is not None and newest != claim.load:
            raise LateWriter(f"attempt {claim.attempt} at {claim.source}: load {newest} was claimed after load {claim.load}")
        mark = empty_table(self.spark, LEDGER_SCHEMA).drop("load", "source")
        mark = mark.unionByName(self.spark.range(0, 1, 1, 1).select(F.lit(last_id).cast("bigint").alias("last_id")), allowMissingColumns=True)
        rows = events.unionByName(mark, allowMissingColumns=True).withColumn("token", F.lit(claim.token))
        self._write(rows, f"{self.path('ledger')}/source={folder_value(claim.source)}/load={claim.load}")
        if last_id is not None:
            self._next_id = last_id + 1

    def write_all_reports(self, claims: list[Claim], reports: DataFrame) -> None:
        self._write_loads(reports.select(part_of(claims), "*"), "reports", len(claims), ("load",))

    def commit_all(self, claims: list[Claim], events: DataFrame, last_ids: list[int]) -> None:
        """Append the file events (load) of several loads: they are written beside the ledger and become visible load by load, in the
        order of their numbers, as a reader that goes by the newest load takes those before it as done."""
        newest = self._newest_claims([claim.source for claim in claims])
        for claim in claims:
            if newest.get(claim.source, (claim.load,))[0] != claim.load:
                raise LateWriter(f"attempt {claim.attempt} at {claim.source}: load {newest[claim.source][0]} was claimed after load {claim.load}")
        part = F.col("part")
        marks = empty_table(self.spark, LEDGER_SCHEMA).drop("load", "source", "last_id")
        own = self.spark.range(0, len(claims), 1, 1).select(F.col("id").cast("int").alias("part"), F.get(literal_array(last_ids, "bigint"), F.col("id").cast("int")).alias("last_id"))
        marks = marks.unionByName(own, allowMissingColumns=True)
        rows = events.select(part_of(claims), "*").drop("load").unionByName(marks, allowMissingColumns=True).withColumn("_claim", of_claim(claims, part))
        rows = rows.withColumn("token", F.col("_claim.token")).select("*", "_claim.load", "_claim.source").drop("_claim")
        beside = f".staging-{uuid.uuid4().hex}"
        self._write_loads(rows, f"ledger/{beside}", len(claims), ("source", "load"))
        Path = self.spark._jvm.org.apache.hadoop.fs.Path
        files = Path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())
        for claim in claims:
            source, load = f"source={folder_value(claim.source)}", f"load={claim.load}"
            files.mkdirs(Path(f"{self.path('ledger')}/{source}"))
            if not files.rename(Path(f"{self.path('ledger')}/{beside}/{source}/{load}"), Path(f"{self.path('ledger')}/{source}/{load}")):
                raise OSError(f"load {claim.load} of {claim.source} could not be committed")
        files.delete(Path(f"{self.path('ledger')}/{beside}"), True)
        self._next_id = last_ids[-1] + 1

    def reports(self) -> DataFrame:
        """Error reports of committed loads."""
        return self._read("reports", REPORT_SCHEMA).join(self._visible_loads(), "load", "left_semi")

    def _visible_loads(self) -> DataFrame:
        """Numbers of committed loads, those folded away too."""
        return self.events().select("load").unionByName(self._sources().select("load")).distinct()

    def loads(self, after: int = 0, upto: int | None = None) -> DataFrame:
        """Rows of committed loads in (after, upto], live or not."""
        last = self.last_load() if upto is None else upto
        wanted = range(after + 1, last + 1)
        below = f"load={{{','.join(map(str, wanted))}}}" if 0 < len(wanted) <= FOLDERS_NAMED else ""
        rows = self._read("measurements", MEASUREMENT_SCHEMA, below)
        rows = rows.where((F.col("load") > after) & (F.col("load") <= last))
        return rows.join(self._visible_loads().where((F.col("load") > after) & (F.col("load") <= last)), "load", "left_semi")

    def measurements(self, after: int = 0, upto: int | None = None) -> DataFrame:
        """Live measurements. No hint: Spark broadcasts the superseded pairs only when small."""
        return self.loads(after, upto).join(self.superseded(after), ["file_key", "load"], "left_anti")

    def compact(self, target_root: str) -> "SensorStore":
        """Fold all tables into a fresh store at another root that goes on where this one stands.

        Kept: live measurements and their categories, jobs with their results, failures and progress, error reports, the scan log, and per
        key its newest outcome, attempts and first creation. Every source stays known as committed. Attempts under way are
        not carried over.
        """
        target = SensorStore(self.spark, target_root)
        # The rebalance gives files of a good size. Folders are few, so a folder's rows are dealt over the tasks by ids or batches, too.
        of_ids, of_batches = F.floor(F.col("id") / PART_IDS), F.floor(F.col("batch_number") / PART_BATCHES)
        live = self.measurements().withColumn("_part", of_ids).hint("rebalance", "load", "sensor_type", "_part").drop("_part")
        live.write.partitionBy("load", "sensor_type").parquet(target.path("measurements"))
        events = self.events()
        current = events.withColumn("_rank", F.when(F.col("status") == MISSING, 1).otherwise(2)).where(F.col("key").isNotNull())
        dead = self.claims().where("key is not null").join(events.select("source").distinct(), "source", "left_semi")
        dead = dead.withColumn("_rank", F.lit(0)).drop("path", "attempt")
        view = ledger_view(current.unionByName(dead, allowMissingColumns=True), ["_rank", "load"], "token")
        # The token goes: the attempts it stands for are in the count.
        view = view.withColumns({"earlier_attempts": F.col("attempts"), "token": F.lit(None).cast("string")})
        columns = [c.strip().split(" ")[0] for c in SNAPSHOT_SCHEMA.split(",")]
        view.select(*columns).write.parquet(target.path("snapshot/ledger"))
        marks = self.claims().groupBy("source", "load").agg(F.max("attempt").alias("attempt"))
        done = events.groupBy("source", "load").agg(F.max("last_id").alias("last_id")).where("source is not null")
        sources = done.join(marks, ["source", "load"], "left").select("source", "load", F.coalesce("attempt", F.lit(1)).alias("attempt"), "last_id")
        folded = self._sources().join(sources.select("source"), "source", "left_anti")
        sources.unionByName(folded).write.parquet(target.path("snapshot/sources"))
        self.reports().write.partitionBy("load").parquet(target.path("reports"))
        self.scans().write.partitionBy("source").parquet(target.path("scans"))
        for table, rows, below, part in (
            ("categorized", self.categorized(), ("job_base", "span", "step", "sensor_type"), of_ids),
            ("results", self.results(), ("job_base", "span", "step"), F.xxhash64("sensor_type", of_batches)),
            ("failures", self.failures(), ("job_base", "span", "step"), F.xxhash64("sensor_type", of_batches)),
            ("jobs", self.jobs(), ("job_base", "span"), F.lit(0)),
        ):
            rows.withColumn("_part", part).hint("rebalance", *below, "_part").drop("_part").write.partitionBy(*below).parquet(target.path(table))
        return target

    # -- scans ----------------------------------------------------------------

    def scans(self) -> DataFrame:
        """The log of scans: one row per micro-batch or sweep."""
        return self._read("scans", SCAN_SCHEMA)

    def last_sweep(self) -> int | None:
        """Second of the last sweep in the log. The log grows with the scans, so it is asked once, and again after each sweep of this writer."""
        if self._last_sweep is None:
            self._last_sweep = (self.scans().where("swept").agg(F.unix_seconds(F.max("at"))).first()[0],)
        return self._last_sweep[0]

    def write_scan(self, source: str, as_of: Column, counts: dict[str, int], swept: bool) -> None:
        """Log one scan; a repeated micro-batch replaces its row."""
        names = SCAN_COUNTS
        row = self.spark.range(0, 1, 1, 1).select(as_of.cast("timestamp").alias("at"), *[F.lit(counts.get(n, 0)).cast("bigint").alias(n) for n in names], F.lit(swept).alias("swept"))
        self._write(row, f"{self.path('scans')}/source={folder_value(source)}")
        if swept:
            self._last_sweep = None

    def write_scans(self, counts: dict[str, dict[str, int]], as_of: Column, swept: bool) -> None:
        """Log the scans of several sources, the first of which may have swept."""
        scans = [{**{n: c.get(n, 0) for n in SCAN_COUNTS}, "source": source, "swept": swept and i == 0} for i, (source, c) in enumerate(counts.items())]
        kinds = ", ".join([f"{n}: bigint" for n in SCAN_COUNTS] + ["swept: boolean", "source: string"])
        part = F.col("id").cast("int")
        rows = self.spark.range(0, len(scans), 1, 1).select(part.alias("part"), as_of.cast("timestamp").alias("at"), F.get(literal_array(scans, f"struct<{kinds}>"), part).alias("_scan"))
        self._write_loads(rows.select("part", "at", "_scan.*"), "scans", len(scans), ("source",))
        if swept:
            self._last_sweep = None

    # -- jobs -----------------------------------------------------------------

    def jobs(self) -> DataFrame:
        return self._read("jobs", JOB_SCHEMA)

    def last_categorized_load(self) -> int:
        done = self.jobs().where(F.col("status") == "Completed")
        return done.agg(F.coalesce(F.max("to_load"), F.lit(0))).first()[0]

    def write_job(self, table: str, job_base: str, span: str, rows: DataFrame, partitions: tuple[str, ...] = (), step: int | None = None) -> None:
        """Write what a job made of one span of loads, or of one step of it; the same base over other loads has other folders."""
        below = "" if step is None else f"/step={step}"
        self._write(rows, f"{self.path(table)}/job_base={folder_value(job_base)}/span={span}{below}", partitions)

    def progress(self, job_base: str | None = None, span: str | None = None) -> DataFrame:
        """Running rows of jobs, one set per finished step."""
        below = f"job_base={folder_value(job_base)}/span={span}" if job_base is not None else ""
        return self._read("progress", PROGRESS_SCHEMA, below)

    def job_states(self) -> DataFrame:
        """Every job as it stands: its final row, or its last progress while it runs."""
        final = self.jobs()
        running = self.progress().join(final.select("job_base", "span").distinct(), ["job_base", "span"], "left_anti")
        columns = [c for c in running.columns if c not in ("job_base", "span", "job_id", "step")]
        last = running.groupBy("job_base", "span", "job_id").agg(F.max_by(F.struct(*columns), "step").alias("_last"))
        return final.unionByName(last.select("job_base", "span", "job_id", "_last.*").select(final.columns))

    def _completed(self, rows: DataFrame) -> DataFrame:
        """Rows of jobs whose job rows, written last, say that they were completed."""
        completed = self.jobs().where(F.col("status") == "Completed").select("job_base", "span").distinct()
        return rows.join(completed, ["job_base", "span"], "left_semi")

    def categorized(self) -> DataFrame:
        """Live categorized measurements of completed jobs."""
        rows = self._completed(self._read("categorized", CATEGORIZED_SCHEMA))
        return rows.join(self.superseded(), ["file_key", "load"], "left_anti")

    def uncategorized(self) -> DataFrame:
        """Live measurements of the loads that jobs have been over which no job gave a category, as those of failed batches."""
        return self.measurements(0, self.last_categorized_load()).join(self.categorized().select("id"), "id", "left_anti")

    def results(self) -> DataFrame:
        """Results per batch and sensor of completed jobs."""
        return self._completed(self._read("results", RESULT_SCHEMA))

    def failures(self) -> DataFrame:
        """Batches of completed jobs in which a step failed that may be skipped."""
        return self._completed(self._read("failures", FAILURE_SCHEMA))
