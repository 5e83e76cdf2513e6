"""Tables that are appended to by numbered batches, parted by day or month, with the live parts named in a file.

A table is a folder. Every batch writes a part of its own below ``data``, parted by time; then a
new manifest in ``manifest`` names the live parts and the last batch of each job. A batch that is
run again after a failure finds its number there and does nothing, and what a failed batch left
is named nowhere, so each batch counts once. Nothing that is stored is written again when rows
are added. A table has one writer at a time; any number may read.
"""

from __future__ import annotations

import json
import uuid
from datetime import UTC, date, datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.node_ids import check_table_name
from ..operators.ingest import first_new, first_write
from . import files

DAY, PART = "day", "part"


class Table:
    def __init__(self, spark: SparkSession, path: str, ts: str | None = None, unit: str = "day"):
        """ts: the column of time that parts the table, by day, or by month where days hold few rows."""
        if unit not in ("day", "month"):
            raise ValueError(f"a table is parted by day or month, not by {unit}")
        self.spark, self.path, self.ts, self.unit = spark, path.rstrip("/"), ts, unit

    def _first_day(self, day: date) -> date:
        return day if self.unit == "day" else day.replace(day=1)

    # manifests
    def manifest(self) -> dict:
        found = [n for n in files.names(self.spark, f"{self.path}/manifest") if n.endswith(".json")]
        return json.loads(files.read_text(self.spark, f"{self.path}/manifest/{found[-1]}")) if found else {"version": 0, "parts": [], "jobs": {}, "schema": None}

    def _commit(self, state: dict) -> None:
        state = state | {"version": state["version"] + 1}
        files.write_text(self.spark, f"{self.path}/manifest/{state['version']:012d}.json", json.dumps(state))

    def done(self, job: str, number: int | None) -> bool:
        return number is not None and self.manifest()["jobs"].get(job, -1) >= number

    # reading
    def _schema(self, state: dict) -> T.StructType:
        return T.StructType.fromJson(state["schema"])

    def _parts(self, state: dict) -> DataFrame:
        schema = self._schema(state).add(PART, T.StringType()).add(DAY, T.DateType())
        held = set(files.names(self.spark, f"{self.path}/data"))
        where = [f"{self.path}/data/{n}" for p in state["parts"] if (n := f"{PART}={p}") in held]
        if not where:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*where)
        since = state.get("since")  # days before it are gone for readers, though their folders may still be there
        return rows if since is None else rows.where(F.col(DAY).isNull() | (F.col(DAY) >= F.lit(since).cast("date")))

    def read(self, since: date | None = None, until: date | None = None) -> DataFrame | None:
        """All rows, or those of some days; only the folders of those are read. None if nothing was ever written."""
        state = self.manifest()
        if state["schema"] is None:
            return None
        rows = self._parts(state)
        if since is not None:
            rows = rows.where((F.col(DAY) >= F.lit(self._first_day(since))) & (F.col(self.ts).cast("date") >= F.lit(since)))
        if until is not None:
            rows = rows.where((F.col(DAY) <= F.lit(until)) & (F.col(self.ts).cast("date") <= F.lit(until)))
        return rows.drop(PART, DAY)

    def days_of(self, rows: DataFrame) -> list[date | None] | None:
        """The days that rows have; None if they have no such column."""
        if self.ts not in rows.columns:
            return None
        return [r[0] for r in rows.select(self._day_of(F.col(self.ts)).alias(DAY)).distinct().collect()]  # a row a day

    def read_days_of(self, rows: DataFrame) -> DataFrame:
        """The table's rows of the days that rows have, those without a time among them; days between are not read."""
        return self.read_days(self.days_of(rows))

    def read_days(self, days: list[date | None] | None) -> DataFrame:
        state = self.manifest()
        if state["schema"] is None:
            raise ValueError(f"{self.path} was never written")
        found = self._parts(state)
        if days is not None:
            some = F.col(DAY).isin([d for d in days if d is not None])
            found = found.where(some | F.col(DAY).isNull() if None in days else some)
        return found.drop(PART, DAY)

    # writing
    def _day_of(self, ts: Column) -> Column:
        return F.trunc(ts, "month") if self.unit == "month" else ts.cast("date")

    def _write(self, df: DataFrame) -> str:
        part = uuid.uuid4().hex
        if self.ts:
            rows = df.withColumn(DAY, self._day_of(F.col(self.ts))).hint("rebalance", DAY)  # else each task writes a file a day
        else:
            rows = df.withColumn(DAY, F.lit(None).cast("date"))
        rows.write.partitionBy(DAY).parquet(f"{self.path}/data/{PART}={part}")
        return part

    def _put(self, df: DataFrame, job: str, number: int | None, keep: bool) -> bool:
        if self.done(job, number):
            return False
        if self.unit == "month" and self.ts is None:
            raise ValueError("a table without a column of time cannot be parted by month")
        part, state = self._write(df), self.manifest()
        own = T.StructType([T.StructField(f.name, f.dataType) for f in df.schema.fields])
        schema = own
        if keep and state["schema"] is not None:  # columns that came later stay
            old = self._schema(state)
            schema = T.StructType([*old.fields, *[f for f in own.fields if f.name not in old.names]])
        jobs = state["jobs"] | ({job: number} if number is not None else {})
        gone = {} if keep else self._expired(state, [f"{PART}={p}" for p in state["parts"]]) | {"since": None}
        self._commit(state | gone | {"parts": [*(state["parts"] if keep else []), part], "jobs": jobs, "schema": json.loads(schema.json())})
        return True

    def append(self, df: DataFrame, job: str = "batch", number: int | None = None) -> bool:
        """df added as a part; False if the job's batch was there already."""
        return self._put(df, job, number, keep=True)

    def replace(self, df: DataFrame, job: str = "batch", number: int | None = None) -> bool:
        """df in place of all rows."""
        return self._put(df, job, number, keep=False)

    def append_new(self, df: DataFrame, keys: list[str], arrival: str, job: str = "batch", number: int | None = None, days: list[date | None] | None = None) -> bool:
        """The first row of each key that the table does not hold yet (nulls are equal).

        Of a table parted by a key only the batch's days are read; days are these (or more), if they are known.
        """
        if self.done(job, number):
            return False
        if self.manifest()["schema"] is None:
            return self.append(first_write(df, keys, arrival), job, number)
        stored = self.read_days(self.days_of(df) if days is None else days) if self.ts in keys else self.read()
        return self.append(first_new(stored, df, keys, arrival), job, number)

    # care: what readers may still be reading is named as expired first, and deleted by a later vacuum
    def _expired(self, state: dict, names: list[str]) -> dict:
        had = state.get("expired", [])
        known, at = {n for n, _ in had}, datetime.now(UTC).isoformat()
        return {"expired": [*had, *[[n, at] for n in names if n not in known]]}

    def drop_before(self, cutoff: date) -> int:
        """The folders that hold days before cutoff only are given up, without reading them; how many there were."""
        state, cutoff = self.manifest(), self._first_day(cutoff)
        known, dropped = {n for n, _ in state.get("expired", [])}, []
        for part in state["parts"]:
            for name in files.names(self.spark, f"{self.path}/data/{PART}={part}"):
                day = name.removeprefix(f"{DAY}=")
                if name != day and day < cutoff.isoformat() and day[:1].isdigit() and f"{PART}={part}/{name}" not in known:
                    dropped.append(f"{PART}={part}/{name}")
        since = max(cutoff.isoformat(), state.get("since") or "")
        self._commit(state | self._expired(state, dropped) | {"since": since})
        return len(dropped)

    def retain(self, days: int, now: datetime) -> int:
        """Gives up whole days older than a period; the period must be positive."""
        if days <= 0:
            raise ValueError("a retention period must be positive")
        return self.drop_before((now - timedelta(days=days)).date())

    def set_policy(self, days: int | None, now: datetime | None = None) -> int:
        """Keeps a retention period with the table, in place of any other (None: without one), and applies it if now is given."""
        if days is not None and days <= 0:
            raise ValueError("a retention period must be positive")
        self._commit(self.manifest() | {"policy": days})
        return self.apply_policy(now) if now is not None else 0

    def policy(self) -> int | None:
        return self.manifest().get("policy")

    def apply_policy(self, now: datetime) -> int:
        days = self.policy()
        return 0 if days is None else self.retain(days, now)

    def compact(self) -> None:
        """All live parts as one, a few files a day; the old ones expire."""
        state = self.manifest()
        if len(state["parts"]) > 1:
            rows = self._parts(state).drop(PART)
            part = self._write(rows.repartition(DAY, F.pmod(F.xxhash64(*rows.columns), F.lit(8))).drop(DAY))
            self._commit(state | self._expired(state, [f"{PART}={p}" for p in state["parts"]]) | {"parts": [part]})
        self.vacuum()

    def vacuum(self, grace: timedelta = timedelta(hours=1), now: datetime | None = None) -> int:
        """Deletes what expired longer than grace ago, parts that no manifest names, and all manifests but the newest; how many folders.

        A reader that began before its parts expired ends well if it takes no longer than grace.
        """
        state, now = self.manifest(), now or datetime.now(UTC)
        due = {n for n, at in state.get("expired", []) if datetime.fromisoformat(at) + grace <= now}
        waiting = [[n, at] for n, at in state.get("expired", []) if n not in due]
        named = {f"{PART}={p}" for p in state["parts"]} | {n.partition("/")[0] for n, _ in waiting}
        gone = sorted(due) + [n for n in files.names(self.spark, f"{self.path}/data") if n not in named and n not in due]
        for name in gone:
            files.delete(self.spark, f"{self.path}/data/{name}")
        if due:
            self._commit(state | {"expired": waiting})
        for name in files.names(self.spark, f"{self.path}/manifest")[:-1]:
            files.delete(self.spark, f"{self.path}/manifest/{name}")
        return len(gone)

    def clear(self) -> None:
        """No rows any more; schema and jobs stay."""
        state = self.manifest()
        self._commit(state | self._expired(state, [f"{PART}={p}" for p in state["parts"]]) | {"parts": []})
        self.vacuum()

    def stats(self, *by: str) -> DataFrame:
        """row_count, files and bytes of the live rows, by day if asked: a Spark job that reads footers, no column."""
        state = self.manifest()
        rows = self._parts(state)
        if not state["parts"]:
            return rows.groupBy(*by).agg(F.count("*").alias("row_count"), F.count("*").alias("files"), F.count("*").alias("bytes"))
        per_file = rows.groupBy(*by, F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n"), F.max("_metadata.file_size").alias("size"))
        sums = [F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"), F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")]
        return per_file.groupBy(*by).agg(*sums)

    def days(self, newest: int = 20) -> list[dict]:
        """day, files, bytes and row_count of the newest days."""
        found = self.stats(DAY).where(F.col(DAY).isNotNull()).orderBy(F.desc(DAY)).limit(newest).collect()
        return [{"day": r[DAY].isoformat(), "files": r["files"], "bytes": r["bytes"], "row_count": r["row_count"]} for r in found]


#: What a new warehouse holds: each table with its column of time, and the steps that bring older ones up to date.
TABLES = {"variables": "sourcetimestamp", "last_values": None, "variable_metadata": None, "events": "event_timestamp", "event_anchor": "event_timestamp", "event_payload": "event_timestamp", "event_rollup": "bucket", "event_rollup_pending": None, "event_types": None, "event_schemas": None}
RETENTION_DAYS = {"events": 365, "event_anchor": 365, "event_payload": 365}


class Warehouse:
    """The historian's tables below one folder, and the migrations that it has had."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def table(self, name: str) -> Table:
        return Table(self.spark, f"{self.path}/{check_table_name(name)}", TABLES.get(name, "event_timestamp" if name.startswith("evt_") else None))

    def names(self) -> list[str]:
        return [n for n in files.names(self.spark, self.path) if files.exists(self.spark, f"{self.path}/{n}/manifest")]

    def migrate(self, steps: list[tuple[str, object]]) -> list[str]:
        """Runs the named steps that have not run here yet, in their order; their names."""
        at = f"{self.path}/_migrations"
        had, ran = set(files.names(self.spark, at)), []
        for name, step in steps:
            if name not in had:
                step(self)
                files.write_text(self.spark, f"{at}/{name}", "done")
                ran.append(name)
        return ran

    def retain(self, now: datetime, days: int | None = None, limits: dict[str, int] | None = None) -> dict[str, int]:
        """Applies retention to the tables that have a period: the shorter of days and their own, which the table keeps or limits give."""
        done, known = {}, set(self.names())
        for name, own in (RETENTION_DAYS if limits is None else limits).items():
            if name in known:
                own = own if limits is not None else self.table(name).policy() or own
                done[name] = self.table(name).retain(min(own, days) if days is not None else own, now)
        return done

    def stats(self) -> DataFrame:
        """table_name, row_count, files, bytes and version of every table that was ever written."""
        each = [t.stats().select(F.lit(n).alias("table_name"), "*", F.lit(t.manifest()["version"]).alias("version")) for n in self.names() if (t := self.table(n)).manifest()["schema"] is not None]
        kinds = "table_name string, row_count long, files long, bytes long, version int"
        return reduce(DataFrame.unionByName, each) if each else self.spark.createDataFrame([], kinds)

    def info(self) -> list[dict]:
        return [r.asDict() for r in self.stats().orderBy("table_name").collect()]


def probe(spark: SparkSession, path: str) -> dict:
    """Whether there is a parquet table at path, its columns, files and bytes."""
    if not files.exists(spark, path):
        return {"exists": False, "columns": [], "files": 0, "bytes": 0}
    n, size = files.usage(spark, path)
    return {"exists": True, "columns": spark.read.parquet(path).columns, "files": n, "bytes": size}
