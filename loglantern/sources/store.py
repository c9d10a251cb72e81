"""The stored table of log entries: Parquet, partitioned by day, its live parts in a log."""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from loglantern.functions.text import is_blank
from loglantern.functions.times import utc_now
from loglantern.operators.projections import stamp_entries
from loglantern.plans.rollups import ROLLUP_SCHEMA, rollup
from loglantern.schema import FILE_SCHEMA, STORE_PARTITIONS, STORE_SCHEMA, ntz
from loglantern.sources.grams import GRAM_SCHEMA, files_with, index_files, searched_positions
from loglantern.sources.manifest import Manifest, Part

# Columns whose equality filters skip row groups by Bloom filter.
BLOOM_COLUMNS = ("source", "event_code", "session_id")

# Names that stand in a directory name as they are.
LOAD_NAME = r"[A-Za-z0-9._-]+"

# Where the partial counts of a part lie, under the root.
ROLLUPS = "_rollup"

# Where the skip index of a part's files lies, under the root.
GRAMS = "_grams"

# Parts of about the same size are merged when there are so many of a day.
FAN_IN = 16

# The directory of rows without a day.
NO_DAY = "__HIVE_DEFAULT_PARTITION__"

# What a later version removed stays for readers so long.
GRACE = timedelta(hours=1)

# Names given to the table at a path, to be told of changes.
_TABLES: dict[str, set[str]] = {}


def new_load_id() -> str:
    """A load name that sorts by the time of the load."""
    return f"{datetime.now(timezone.utc):%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:12]}"


class EntryStore:
    """Stored log entries under one path.

    Rows lie in ``ingest_date=.../part=...`` directories, and a log names those that are
    live: a reader sees one version of it, whole. A load is written as a part under a new
    name; its version replaces what an earlier try of the same load left, so a repeated
    load does not store rows twice. Ids are unique within a load.

    With ``rollups`` every part comes with partial counts (see ``plans.rollups``), which
    live and go with it; with ``grams``, with a skip index for message search (see
    ``sources.grams``). ``grace`` is how long removed parts stay for readers of earlier
    versions.
    """

    def __init__(self, spark: SparkSession, path: str, rollups: bool = False, grace: timedelta = GRACE, grams: bool = False):
        self.spark = spark
        self.path = path.rstrip("/")
        self.rollups = rollups
        self.grams = grams
        self.grace = grace
        self.manifest = Manifest(spark, self.path)

    # --- writing ---

    def _write(self, rows: DataFrame) -> None:
        """Writes directories nobody knows yet; each job stages in a folder of its own."""
        writer = rows.write.mode("overwrite").partitionBy(*STORE_PARTITIONS)
        for name in BLOOM_COLUMNS:
            writer = writer.option(f"parquet.bloom.filter.enabled#{name}", "true")
        writer.option("partitionOverwriteMode", "dynamic").parquet(self.path)

    def _add(self, rows: DataFrame, part: str, load: str | None, numbered: bool) -> list[Part]:
        """Writes rows as a part of each of their days, and its counts."""
        seen = Observation()
        rows = rows.withColumn("part", F.lit(part)).sortWithinPartitions(*STORE_PARTITIONS, "ts")
        if not numbered:
            rows = rows.withColumn("id", F.monotonically_increasing_id())
        stored = [F.min("created_at").cast("string").alias("first"), F.max("created_at").cast("string").alias("last")]
        days = [F.min("ingest_date").alias("low"), F.max("ingest_date").alias("high"), F.count("ingest_date").alias("dated")]
        self._write(rows.select(*FILE_SCHEMA.names).observe(seen, F.count(F.lit(1)).alias("rows"), *stored, *days))
        made = seen.get
        if not made["rows"]:
            return []
        if made["low"] == made["high"] and made["dated"] in (0, made["rows"]):
            counts = {made["low"]: made["rows"]}
        else:
            names = [_directory(day, part) for day in self._days(part)]
            counts = dict(self._read(names).groupBy("ingest_date").count().collect())
        parts = [Part(_directory(d, part), n, load, made["first"], made["last"]) for d, n in sorted(counts.items(), key=str)]
        written = self._read([p.dir for p in parts])
        if self.rollups:
            self._write_beside(rollup(written, *STORE_PARTITIONS), ROLLUPS)
        if self.grams:
            self._write_beside(index_files(written, *STORE_PARTITIONS), GRAMS)
        return parts

    def _write_beside(self, rows: DataFrame, folder: str) -> None:
        """Writes what comes with parts, under their names."""
        rows.hint("rebalance", "ingest_date").write.mode("overwrite").partitionBy(*STORE_PARTITIONS).option(
            "partitionOverwriteMode", "dynamic"
        ).parquet(f"{self.path}/{folder}")

    def _days(self, part: str) -> list[str]:
        """Days that have a directory of this part."""
        files, jvm = self.manifest._files(), self.spark._jvm
        found = files.globStatus(jvm.org.apache.hadoop.fs.Path(f"{self.path}/ingest_date=*/part={part}")) or []
        return [s.getPath().getParent().getName().removeprefix("ingest_date=") for s in found]

    def create(self) -> None:
        """Create the table; does nothing when it is there."""
        self.manifest.commit("create", lambda parts: None if self.manifest.at().number >= 0 else ((), ()))

    # --- reading ---

    def _empty(self, schema=STORE_SCHEMA) -> DataFrame:
        return self.spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema])

    def _read(self, names: list[str], folder: str = "", schema=FILE_SCHEMA) -> DataFrame:
        if not names:
            return self._empty(schema)
        base = f"{self.path}/{folder}".rstrip("/")
        return self.spark.read.schema(schema).option("basePath", base).parquet(*[f"{base}/{n}" for n in names])

    def version(self) -> int:
        return self.manifest.at().number

    def read(self, version: int | None = None, search: str | None = None) -> DataFrame:
        """The rows of a version, the latest by default. What the frame reads stays the same
        whatever is written meanwhile.

        With ``search``, files whose messages cannot hold that text are left out, if the
        store keeps a skip index; the rows of the others still are to be searched.
        """
        names = list(self.manifest.at(version).parts)
        if self.grams and names and not is_blank(search):
            names = self._holding(names, search)
        return self._read(names).select(*STORE_SCHEMA.names)

    def _holding(self, names: list[str], search: str) -> list[str]:
        """Files of the parts that can hold a searched text, or all parts when it is too
        short to tell. A part without an index is read."""
        needed = searched_positions(self.spark, search)
        if not needed:
            return names
        files = self.manifest._files()
        indexed = [n for n in names if files.exists(self.manifest._path(f"{GRAMS}/{n}"))]
        found = files_with(self._read(indexed, GRAMS, GRAM_SCHEMA), needed).collect()
        without = sorted(set(names) - set(indexed))
        return without + sorted(f"{_directory(r.ingest_date, r.part)}/{r.file}" for r in found)

    def read_rollups(self, version: int | None = None) -> DataFrame:
        """The partial counts of a version's parts; reads no entry."""
        if not self.rollups:
            raise ValueError("this store keeps no rollups")
        return self._read(list(self.manifest.at(version).parts), ROLLUPS, ROLLUP_SCHEMA)

    def row_count(self) -> int:
        """Stored rows, from the log alone."""
        return sum(p.rows for p in self.manifest.at().parts.values())

    # --- names in the catalog ---

    def create_table(self, name: str) -> None:
        """Name the table in the catalog; does nothing when the name is there.

        The name is a view of a table ``<name>__parts`` whose partitions are the live parts.
        Stores here register every change; other writers' changes are registered when
        ``create_table`` is called again. One change is a few statements to the catalog:
        readers who need a version whole use ``read``.
        """
        self.create()
        names = name.split(".")
        view, table = (".".join(f"`{part.replace('`', '``')}`" for part in (*names[:-1], names[-1] + end)) for end in ("", "__parts"))
        path = self.path.replace("\\", "\\\\").replace("'", "\\'")
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {table} ({FILE_SCHEMA.toDDL()}) USING parquet "
            f"PARTITIONED BY ({', '.join(STORE_PARTITIONS)}) LOCATION '{path}'"
        )
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(f"CREATE VIEW {view} AS SELECT {', '.join(STORE_SCHEMA.names)} FROM {table}")
        _TABLES.setdefault(self.path, set()).add(table)
        self._changed()

    def _changed(self) -> None:
        """Registers the live parts under the names of the table."""
        for table in list(_TABLES.get(self.path, ())):
            if not self.spark.catalog.tableExists(table):
                _TABLES[self.path].discard(table)
                continue
            live = set(self.manifest.at().parts)
            there = {r.partition for r in self.spark.sql(f"SHOW PARTITIONS {table}").collect()}
            for names, verb in ((there - live, "DROP IF EXISTS"), (live - there, "ADD IF NOT EXISTS")):
                specs = []
                for n in sorted(names):
                    day, part = n.removeprefix("ingest_date=").split("/part=")
                    day = "NULL" if day == NO_DAY else f"DATE'{day}'"
                    specs.append(f"PARTITION (ingest_date={day}, part='{part}')")
                for i in range(0, len(specs), 100):
                    self.spark.sql(f"ALTER TABLE {table} {verb} {(', ' if verb.startswith('DROP') else ' ').join(specs[i : i + 100])}")
            self.spark.catalog.refreshTable(table)

    # --- changes ---

    def append(
        self,
        entries: DataFrame,
        session_id: str | Column,
        created_at: Column | None = None,
        load_id: str | None = None,
        many_days: bool = False,
        few_files: bool = False,
    ) -> int:
        """Store entries under a session and return how many were written.

        All rows get the current UTC time unless ``created_at`` gives another.
        When that spans many days, ``many_days`` gathers the rows by day first,
        large days being split over several tasks. ``few_files`` gathers the rows
        of a small load that comes in many partitions. To repeat a load, give the
        same ``load_id`` and ``created_at`` again: it replaces the earlier try, or, where
        that has been merged with other loads, changes nothing.
        """
        repeated = load_id is not None
        load_id = new_load_id() if load_id is None else load_id
        if not re.fullmatch(LOAD_NAME, load_id):
            raise ValueError(f"a load name has letters, digits and ._- only, not {load_id!r}")
        created_at = utc_now() if created_at is None else created_at
        stamped = stamp_entries(entries, created_at, session_id)
        rows = stamped.withColumns({"ingest_date": F.to_date("created_at"), "load_id": F.lit(load_id)})
        if many_days:
            rows = rows.hint("rebalance", "ingest_date")
        elif few_files:
            rows = rows.hint("rebalance")
        parts = self._add(rows, f"{load_id}-{uuid.uuid4().hex[:8]}", load_id, numbered=False)

        def change(live: dict[str, Part]):
            earlier = [name for name, p in live.items() if p.load == load_id]
            if not parts and not earlier:
                return None
            merged = [name for name, p in live.items() if p.load is None] if repeated else []
            if merged and not self._read(merged).where(F.col("load_id") == load_id).isEmpty():
                return None
            return parts, earlier

        self.manifest.commit("append", change)
        self._changed()
        return sum(p.rows for p in parts)

    def delete_older_than(self, cutoff: datetime) -> int:
        """Delete rows stored before ``cutoff`` (UTC) and return how many.

        The log tells which parts are older, younger, or straddle the cutoff; of the last,
        what is kept is written anew, in one job. All of it is one version, so a run that
        breaks changes nothing and can be repeated.
        """
        day = str(cutoff.date())

        def older(p: Part) -> bool:
            return p.day != NO_DAY and (p.day < day or (p.last is not None and _time(p.last) < cutoff))

        def straddles(p: Part) -> bool:
            return p.day == day and not older(p) and (p.first is None or _time(p.first) < cutoff)

        while True:
            live = self.manifest.at().parts
            gone = [name for name, p in live.items() if older(p)]
            mixed = [name for name, p in live.items() if straddles(p)]
            if not gone and not mixed:
                return 0
            young = self._read(mixed).where(F.col("created_at") >= ntz(cutoff))
            kept = self._add(young, f"kept-{uuid.uuid4().hex}", None, numbered=True) if mixed else []
            if self._swap("retention", kept, [*gone, *mixed]):
                break
        self.vacuum()
        return sum(live[name].rows for name in (*gone, *mixed)) - sum(p.rows for p in kept)

    def clear(self) -> int:
        """Delete everything and return how many rows there were. What arrives meanwhile
        stays."""
        n = 0

        def change(live: dict[str, Part]):
            nonlocal n
            n = sum(p.rows for p in live.values())
            return ((), list(live)) if live else None

        self.manifest.commit("clear", change)
        self._changed()
        self.vacuum()
        return n

    def compact(self, before: date | None = None, fan_in: int = FAN_IN) -> int:
        """Merge small parts and return how many went.

        Days before ``before`` (today by default, UTC) are closed: their parts become one
        each. In later days parts are merged when ``fan_in`` of them have about the same
        size (within a factor of ``fan_in``), so a row is rewritten once per factor, and a
        day with n loads has some fan_in * log(n) parts. Rows keep loads and ids. All is
        one job and one version; when a change meanwhile took some of the parts away,
        nothing is changed.
        """
        closed = str(before or datetime.now(timezone.utc).date())
        live = self.manifest.at().parts

        def tier(p: Part) -> tuple[str, int]:
            return p.day, -1 if p.day < closed else int(math.log(max(p.rows, 1), fan_in) + 1e-9)

        sizes = Counter(tier(p) for p in live.values())
        old = [name for name, p in live.items() if sizes[tier(p)] >= (2 if tier(p)[1] < 0 else fan_in)]
        if not old:
            return 0
        # a part of a day is split over tasks where it is large
        rows = self._read(old).hint("rebalance", "ingest_date")
        merged = self._add(rows, f"merged-{uuid.uuid4().hex}", None, numbered=True)
        if not self._swap("compact", merged, old):
            return 0
        self.vacuum()
        return len(old)

    def _swap(self, what: str, added: list[Part], removed: list[str]) -> bool:
        """Replaces parts by others, if they are all still there."""
        done = self.manifest.commit(what, lambda live: (added, removed) if live.keys() >= set(removed) else None)
        if done is not None:
            self._changed()
        return done is not None

    def vacuum(self, grace: timedelta | None = None) -> int:
        """Delete directories that have not been live for ``grace`` and return how many. A
        day of which readers need nothing goes as a whole."""
        horizon = datetime.now(timezone.utc) - (self.grace if grace is None else grace)
        dead, needed = self.manifest.removed(horizon)
        days = {name.split("/")[0] for name in needed}
        whole = {name.split("/")[0] for name in dead} - days
        for name in [*sorted(whole), *(n for n in dead if n.split("/")[0] in days)]:
            self._delete(name)
        self.manifest.trim(horizon)
        return len(dead)

    def _delete(self, name: str) -> None:
        for path in (name, f"{ROLLUPS}/{name}", f"{GRAMS}/{name}"):
            self.manifest._files().delete(self.manifest._path(path), True)


def _time(text: str) -> datetime:
    return datetime.fromisoformat(text)


def _directory(day: date | str | None, part: str) -> str:
    return f"ingest_date={NO_DAY if day is None else day}/part={part}"


def survivors(rows: DataFrame, cutoff: datetime) -> DataFrame:
    """Rows a retention cutoff keeps: those stored at it or later."""
    return rows.where(F.col("created_at") >= ntz(cutoff))


def deleted_count(rows: DataFrame, cutoff: datetime) -> DataFrame:
    """How many rows a retention cutoff deletes."""
    return rows.where(F.col("created_at") < ntz(cutoff)).agg(F.count(F.lit(1)).alias("deleted"))
