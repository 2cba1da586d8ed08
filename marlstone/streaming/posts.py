"""Posts as they arrive: in the order of each author, classified with retries, archived, matched, alerted once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from marlstone.streaming.feeds import in_event_time

OUT = "author long, post_id long, ts timestamp, text string, answer string, ai_failed boolean, ai_retry_count int"
STATE = "last long, timer long, waiting array<struct<post_id: long, ts: timestamp, text: string, tries: int, due: long>>"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks_state(spark: SparkSession):
    """Stateful processors keep their state in RocksDB: queries started inside do, later ones as the session says."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


class Posts(StatefulProcessor):
    """One author's posts: a cursor, the last post taken, and the posts that wait for their turn or for a retry.

    A post waits until the watermark has passed its time, so that the order of arrival plays no part; then it is taken,
    and the cursor moves to it. Posts at or before the cursor are refused: they are repeats, or too late. A post that
    the model fails on is tried again delay_ms after each try, tries times more; then it is given out as failed.
    Each call to the state crosses to the JVM, so an author's posts are read and written as lists, once a batch, and one
    timer stands for all that wait: the next that is due.
    """

    def __init__(self, model: Callable[[list[str], list[int]], list[str | None]], tries: int, delay_ms: int):
        self.model, self.tries, self.delay_ms = model, tries, delay_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("posts", STATE)

    def _read(self) -> tuple[int | None, int | None, list[tuple]]:
        """The cursor, the time of the timer, and who waits: post_id, ts, text, tries, due."""
        last, timer, waiting = self.state.get() or (None, None, [])
        return last, timer, [tuple(w) for w in waiting]

    def _write(self, last: int | None, timer: int | None, waiting: list[tuple]) -> None:
        soonest = min((w[4] for w in waiting), default=None)
        if soonest is not None and (timer is None or soonest < timer):
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(soonest)
            timer = soonest
        self.state.update((last, timer, waiting))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last, timer, waiting = self._read()
        known = {w[0] for w in waiting}
        for r in rows:
            if (last is None or r.post_id > last) and r.post_id not in known:
                known.add(r.post_id)
                waiting.append((r.post_id, r.ts, r.text, 0, int(r.ts.timestamp() * 1000)))
        self._write(last, timer, waiting)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """All posts that are due go to the model at once."""
        now = timerValues.getCurrentWatermarkInMs()
        last, _, waiting = self._read()
        due, later = sorted(w for w in waiting if w[4] <= now), [w for w in waiting if w[4] > now]
        while due:
            answers = self.model([d[2] for d in due], [d[3] for d in due])
            again = []
            for (post, ts, text, n, at), answer in zip(due, answers, strict=True):
                if answer is None and n < self.tries:
                    again.append((post, ts, text, n + 1, at + self.delay_ms))
                    continue
                yield Row(author=key[0], post_id=post, ts=ts, text=text, answer=answer, ai_failed=answer is None, ai_retry_count=n)
            most = max(d[0] for d in due)
            last = most if last is None else max(last, most)
            later += [a for a in again if a[-1] > now]
            due = [a for a in again if a[-1] <= now]  # as if their time had come one by one
        # The timer that brought us here is gone.
        self._write(last, None, later)

    def close(self) -> None:
        pass


def classified(posts: DataFrame, model: Callable[[list[str], list[int]], list[str | None]], late: str = "1 day", tries: int = 3, delay_ms: int = 300_000) -> DataFrame:
    """author, post_id, ts, text, answer, ai_failed and ai_retry_count of the posts (author, post_id, ts, text) of a stream.

    model: texts and the number of each one's earlier tries to answers, None where it fails. A post's row comes once
    the watermark has passed its time, or that of its last try. Post ids grow with time for an author. Nulls in author,
    post_id or ts name no post. State: what is not older than late or waits for a retry, and a number for each author.
    """
    rows = in_event_time(posts.filter("author is not null and post_id is not null and ts is not null").select("author", "post_id", "ts", "text"), "ts", late)
    return rows.groupBy("author").transformWithState(statefulProcessor=Posts(model, tries, delay_ms), outputStructType=OUT, outputMode="append", timeMode="eventTime")


class Landed:
    """For each batch: archives its posts, reads the answers, matches assets and alerts; a batch that runs again overwrites what it left.

    read: DataFrame of classified posts to one with more columns (the answer's fields); match adds assets; alert: a
    condition on the result.
    """

    def __init__(self, spark: SparkSession, path: str, read: Callable[[DataFrame], DataFrame], match: Callable[[DataFrame], DataFrame], alert, send: Callable[[DataFrame], None] | None = None):
        self.spark, self.path, self.read, self.match, self.alert, self.send = spark, path, read, match, alert, send

    def __call__(self, batch: DataFrame, number: int) -> None:
        at = lambda name: f"{self.path}/{name}/batch={number}"
        batch.write.mode("overwrite").parquet(at("archive"))
        posts = self.spark.read.schema(batch.schema).parquet(at("archive"))  # the stream's work is done once
        signals = self.match(self.read(posts.filter("not ai_failed")))
        signals.withColumn("is_alerted", F.coalesce(self.alert, F.lit(False))).write.mode("overwrite").parquet(at("signals"))
        if self.send:
            self.send(self.spark.read.parquet(at("signals")).filter("is_alerted"))

    def archive(self) -> DataFrame:
        return self.spark.read.schema(OUT).option("recursiveFileLookup", "true").parquet(f"{self.path}/archive")

    def signals(self) -> DataFrame:
        return self.spark.read.option("recursiveFileLookup", "true").parquet(f"{self.path}/signals")
