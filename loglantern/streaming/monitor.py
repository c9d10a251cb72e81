"""The live monitor: polls a stream of raw records and stores what is new."""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from loglantern.functions.times import utc_now
from loglantern.operators.filters import session_is
from loglantern.operators.projections import entry_lines
from loglantern.sources.shared import shared_dir
from loglantern.sources.store import EntryStore
from loglantern.streaming.live import monitored_entries

# --- fixed values -----------------------------------------------------------

POLL_INTERVAL = "1 second"
RETRY_DELAY_SECONDS = 5.0
COMPACT_EVERY = 64

# Names in an error that tell of a failed or refused read, which is tried again.
READ_ERRORS = (
    "FAILED_READ_FILE", "FileNotFoundException", "EOFException", "AccessControlException", "AccessDenied",
)

# ----------------------------------------------------------------------------


def monitor_session_id(channel: str, started: datetime | None = None) -> str:
    started = started or datetime.now(timezone.utc)
    return f"Session_{started:%Y%m%d_%H%M%S}_{channel}"


def plain_name(session_id: str) -> str:
    """A session's name for directories; the digest keeps like ones apart."""
    digest = hashlib.sha256(session_id.encode()).hexdigest()[:8]
    return f"{re.sub('[^A-Za-z0-9._-]', '_', session_id)}-{digest}"


class _Events(StreamingQueryListener):
    """Passes on the events of the monitor's own query."""

    def __init__(self, monitor: Monitor):
        self.monitor = monitor

    def onQueryStarted(self, event) -> None:
        if event.name == self.monitor.session_id:
            self.monitor.on_started()

    def onQueryProgress(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        query = self.monitor.query
        if query is not None and str(event.runId) == str(query.runId):
            self.monitor.on_stopped()


def _nothing(*_) -> None:
    pass


class Monitor:
    """Watches one level of one channel and stores the new entries in a session.

    Every start is a session of its own, with its own checkpoint and so with
    empty state; ``start(resume=session_id)`` goes on with an earlier one. A
    batch is stored under a load name made of session and batch number, so a
    batch repeated after a failure replaces itself. Every ``compact_every`` batches small
    loads of the store are merged (None: never).
    """

    def __init__(
        self,
        records: DataFrame,
        store: EntryStore,
        channel: str,
        level: str,
        span: timedelta | str,
        now: datetime | Column | None = None,
        zone: str | None = None,
        fuzzy: str = "compat",
        lines_path: str | None = None,
        lines_format: str = "txt",
        checkpoint_root: str | None = None,
        compact_every: int | None = COMPACT_EVERY,
        on_started: Callable[[], None] = _nothing,
        on_changed: Callable[[int, int], None] = _nothing,
        on_stopped: Callable[[], None] = _nothing,
    ):
        self.store = store
        self.channel = channel
        self.entries = monitored_entries(records, channel, level, span, now, zone, fuzzy).withColumn(
            # In a stream this is the time recorded for the batch, so a repeated
            # batch is stamped, and filed, as it was the first time.
            "created_at",
            utc_now(),
        )
        self.lines_path = lines_path
        self.lines_format = lines_format
        self.checkpoint_root = checkpoint_root
        self.compact_every = compact_every
        self.on_started, self.on_changed, self.on_stopped = on_started, on_changed, on_stopped
        self.session_id: str | None = None
        self.query: StreamingQuery | None = None
        self._listener: _Events | None = None
        self._counted: tuple[int, int, int] | None = None

    @property
    def is_monitoring(self) -> bool:
        return self.query is not None and self.query.isActive

    def start(
        self, resume: str | None = None, once: bool = False, poll: str = POLL_INTERVAL
    ) -> StreamingQuery:
        """Start polling; does nothing when already running.

        ``once`` takes in what is there now and ends.
        """
        if self.is_monitoring:
            return self.query
        spark = self.store.spark
        self.store.create()
        self.session_id = resume or monitor_session_id(self.channel)
        self._counted = None
        root = self.checkpoint_root or shared_dir(spark)
        if self._listener is None:
            self._listener = _Events(self)
            spark.streams.addListener(self._listener)
        trigger = {"availableNow": True} if once else {"processingTime": poll}
        self.query = (
            self.entries.writeStream.queryName(self.session_id)
            .outputMode("append")
            .option("checkpointLocation", f"{root.rstrip('/')}/monitor/{plain_name(self.session_id)}")
            .trigger(**trigger)
            .foreachBatch(self._store_batch)
            .start()
        )
        return self.query

    def _store_batch(self, batch: DataFrame, number: int) -> None:
        load_id = f"{plain_name(self.session_id)}-{number:012d}"
        both = self.lines_path is not None
        if both:
            batch = batch.persist()
        try:
            stored = self.store.append(
                batch,
                self.session_id,
                created_at=F.col("created_at"),
                load_id=load_id,
                few_files=True,
            )
            if both and stored:
                entry_lines(batch, self.lines_format).write.mode("overwrite").text(
                    f"{self.lines_path}/load_id={load_id}"
                )
        finally:
            if both:
                batch.unpersist()
        self._count(number, load_id, stored)
        if self.compact_every and number % self.compact_every == self.compact_every - 1:
            self.store.compact()
        if stored:
            self.on_changed(number, stored)

    def _count(self, number: int, load_id: str, stored: int) -> None:
        """Adds a batch to the running count; one that is repeated replaces itself. Only
        the first batch after a start looks into the store."""
        if self._counted is None:
            mine = session_is(self.session_id) & (F.col("load_id") != load_id)
            before = self.store.read().where(mine).count() if number else 0
        elif self._counted[0] == number:
            before = self._counted[1]
        else:
            before = self._counted[1] + self._counted[2]
        self._counted = (number, before, stored)

    @property
    def running_count(self) -> int:
        """Entries stored in this session up to the last batch, from the counts of the
        batches; what retention deletes meanwhile stays counted."""
        return self._counted[1] + self._counted[2] if self._counted else self.session_count()

    def stop(self) -> None:
        if self.is_monitoring:
            self.query.stop()

    def close(self) -> None:
        """Stop and forget the event callbacks."""
        self.stop()
        if self._listener is not None:
            self.store.spark.streams.removeListener(self._listener)
            self._listener = None

    def run(
        self,
        resume: str | None = None,
        once: bool = False,
        poll: str = POLL_INTERVAL,
        retry_delay: float = RETRY_DELAY_SECONDS,
        retries: int | None = None,
    ) -> None:
        """Poll until stopped. A failed read is tried again after a while, from
        the checkpoint of the same session; other errors are raised."""
        failures = 0
        while True:
            try:
                self.start(resume, once, poll).awaitTermination()
                return
            except StreamingQueryException as error:
                failures += 1
                spent = retries is not None and failures > retries
                if spent or not any(name in str(error) for name in READ_ERRORS):
                    raise
                resume = self.session_id
                time.sleep(retry_delay)

    def session_count(self) -> int:
        """Entries stored in this session so far; all of them match its level."""
        return self.store.read().where(session_is(self.session_id)).count()
