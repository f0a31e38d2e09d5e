"""State machines over streams of browser events, keyed by tab or client."""

from __future__ import annotations

import bisect
import heapq
import itertools
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from webtel.functions import times

#: How long a page lives at most, and how long after it was left without coming back.
PAGE_MS, UNSEEN_MS = 3_600_000, 600_000
ENDED = "tab string, doc string, start_ms long, end_ms long, reason string, requests long, active_ms long"


#: Rows that are to be sorted are sorted so many at a time, and kept and read in parts.
RUN_ROWS, PART_ROWS, OUT_ROWS = 200_000, 2_000, 10_000


class SortedRuns:
    """Rows of a key, kept in its state and given back in the order of all their columns, the first of which is a long.

    They are kept as sorted runs, which are merged part by part as they are
    read, so that a key's rows are never in memory together.
    """

    def __init__(self, handle, schema: pa.Schema):
        self.schema = schema
        self.runs = handle.getMapState("runs", "run long", "least long, part long, parts long")
        self.parts = handle.getMapState("parts", "run long, part long", "rows binary")

    def _packed(self, rows: pa.Table) -> bytes:
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, self.schema) as w:
            w.write_table(rows)
        return out.getvalue().to_pybytes()

    def _keep(self, run: int, pdfs: list[pd.DataFrame]) -> None:
        longs = {f.name: "int64" for f in self.schema if f.type == pa.int64()}
        pdf = pd.concat(pdfs).astype(longs).sort_values(self.schema.names, na_position="first")
        rows = pa.Table.from_pandas(pdf, self.schema, preserve_index=False).replace_schema_metadata()
        parts = -(-len(rows) // PART_ROWS)
        for i in range(parts):
            self.parts.updateValue((run, i), (self._packed(rows.slice(i * PART_ROWS, PART_ROWS)),))
        self.runs.updateValue((run,), (rows[0][0].as_py(), 0, parts))

    def add(self, pdfs: Iterator[pd.DataFrame]) -> None:
        run = max((k[0] for k in self.runs.keys()), default=-1) + 1
        new, n = [], 0
        for pdf in pdfs:
            new.append(pdf[self.schema.names])
            n += len(pdf)
            if n >= RUN_ROWS:
                self._keep(run, new)
                run, new, n = run + 1, [], 0
        if n:
            self._keep(run, new)

    def least(self) -> list[int]:
        """The first column's least value of each run."""
        return [v[0] for v in self.runs.values()]

    def _take(self, run: int, part: int, parts: int, until: int) -> Iterator[tuple]:
        for i in range(part, parts):
            rows = pa.ipc.open_stream(bytes(self.parts.getValue((run, i))[0])).read_all()
            columns = [c.to_pylist() for c in rows.columns]
            n = bisect.bisect_right(columns[0], until)
            yield from itertools.islice(zip(*columns, strict=True), n)
            if n < len(rows):
                self.parts.updateValue((run, i), (self._packed(rows.slice(n)),))
                self.runs.updateValue((run,), (columns[0][n], i, parts))
                return
            self.parts.removeKey((run, i))
        self.runs.removeKey((run,))

    def take(self, until: int = (1 << 63) - 1) -> Iterator[tuple]:
        """Rows whose first column is `until` at most; they leave the state as they are read, and all have to be."""
        runs = [(k[0], v[1], v[2]) for k, v in self.runs.iterator() if v[0] <= until]
        return heapq.merge(*(self._take(*r, until) for r in runs), key=lambda r: tuple("" if x is None else x for x in r))


class PageStates(StatefulProcessor):
    """Pages of a tab from their commit to their end.

    Rows (at_ms, order, kind, doc) wait in the state until the watermark has
    passed them, so that they are taken in order of time however batches
    are cut. `commit` makes a document the tab's page: a new one, or one that
    was left and is restored. `request` counts for its document, `active` and
    `inactive` start and stop the clock of the tab's pages, `gone` ends them
    all. A page ends an hour after its commit, or ten minutes after it was
    left; a row of such a time comes before the end. State: the waiting rows,
    the open pages, and the tab's current document and whether it is active.
    """

    def init(self, handle):
        self.handle = handle
        self.waiting = SortedRuns(handle, pa.schema([("at_ms", pa.int64()), ("order", pa.int64()), ("kind", pa.string()), ("doc", pa.string())]))
        self.pages = handle.getMapState("pages", "doc string", "start_ms long, left_ms long, requests long, active_from long, active_ms long")
        self.tab = handle.getValueState("tab", "doc string, active boolean")

    def handleInputRows(self, key, rows, timerValues):
        self.waiting.add(rows)
        self.handle.registerTimer(max(min(self.waiting.least()), timerValues.getCurrentWatermarkInMs() + 1))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs()
        pages = {k[0]: list(v) for k, v in self.pages.iterator()}
        doc, active = self.tab.get() if self.tab.exists() else (None, False)
        before, ended = set(pages), []

        def end(d, at, reason):
            start, _, requests, since, spent = pages.pop(d)
            ended.append((key[0], d, start, at, reason, requests, spent + (at - since if since >= 0 else 0)))

        def due(d):
            start, left = pages[d][:2]
            return min((start + PAGE_MS, "hour"), (left + UNSEEN_MS, "unseen")) if left >= 0 else (start + PAGE_MS, "hour")

        def expire(until):
            for at, d, reason in sorted((due(d)[0], d, due(d)[1]) for d in pages):
                if at < until:
                    end(d, at, reason)

        def output():
            pdf = pd.DataFrame(ended, columns=["tab", "doc", "start_ms", "end_ms", "reason", "requests", "active_ms"])
            ended.clear()
            return pdf

        for at, _, kind, d in self.waiting.take(now):
            expire(at)
            if kind == "commit" and d is not None:
                if doc in pages and doc != d:
                    pages[doc][1] = at
                doc = d
                if d in pages:
                    pages[d][1] = -1
                else:
                    pages[d] = [at, -1, 0, at if active else -1, 0]
            elif kind == "request" and d in pages:
                pages[d][2] += 1
            elif kind in ("active", "inactive"):
                active = kind == "active"
                for p in pages.values():
                    if active and p[3] < 0:
                        p[3] = at
                    elif not active and p[3] >= 0:
                        p[4] += at - p[3]
                        p[3] = -1
            elif kind == "gone":
                for d2 in sorted(pages):
                    end(d2, at, "gone")
                doc = None
            if len(ended) >= OUT_ROWS:
                yield output()
        expire(now + 1)
        for d in before - set(pages):
            self.pages.removeKey((d,))
        for d, p in pages.items():
            self.pages.updateValue((d,), tuple(p))
        if doc is None and not active and not pages:
            self.tab.clear()
        else:
            self.tab.update((doc, active))
        again = self.waiting.least() + [due(d)[0] for d in pages]
        if again:
            self.handle.registerTimer(max(min(again), now + 1))
        if ended:
            yield output()

    def close(self):
        pass


def page_lifecycles(stream: DataFrame, ts: str = "ts") -> DataFrame:
    """Ended pages (ENDED) of a watermarked stream of (tab, ts, order, kind, doc); needs the RocksDB state store.

    Rows without a tab are left out. Pages that are open at the last
    watermark stay in the state.
    """
    s = stream.where(F.col("tab").isNotNull() & F.col(ts).isNotNull()).select(F.col("tab").cast("string").alias("tab"), F.unix_millis(ts).alias("at_ms"), F.col("order").cast("long").alias("order"), "kind", F.col("doc").cast("string").alias("doc"), ts)
    return s.groupBy("tab").transformWithStateInPandas(PageStates(), ENDED, "append", "EventTime")


#: Length of an activity bucket, and how far a clock may run back unnoticed.
BUCKET_MS, DRIFT_MS = 524_288, 120_000
BUCKETED = "client string, order long, bucket long, epoch long, reset boolean"


class ClockGuard(StatefulProcessor):
    """The activity bucket of each row in the order of arrival.

    A time inside the current bucket or later decides by itself; one before
    it by less than two minutes stays in the current bucket; one further
    back clears everything: a new epoch begins. State: the current bucket
    and the epoch, and a batch's rows while they are sorted.
    """

    def init(self, handle):
        self.state = handle.getValueState("state", "bucket long, epoch long")
        self.rows = SortedRuns(handle, pa.schema([("order", pa.int64()), ("at_ms", pa.int64())]))

    def handleInputRows(self, key, rows, timerValues):
        bucket, epoch = self.state.get() if self.state.exists() else (None, 0)
        self.rows.add(rows)
        new = self.rows.take()
        while out := list(itertools.islice(new, OUT_ROWS)):
            for i, (order, at) in enumerate(out):
                reset = bucket is not None and bucket * BUCKET_MS - at >= DRIFT_MS
                if bucket is None or reset or at >= (bucket + 1) * BUCKET_MS:
                    bucket = at // BUCKET_MS
                epoch += reset
                out[i] = (key[0], order, bucket, epoch, reset)
            yield pd.DataFrame(out, columns=["client", "order", "bucket", "epoch", "reset"])
        self.state.update((bucket, epoch))

    def close(self):
        pass


def guarded_buckets(stream: DataFrame, client: str, order: str, ts: str) -> DataFrame:
    """(client, order, bucket, epoch, reset) of a stream whose times may jump; `order` is the order of arrival, across batches too."""
    s = stream.where(F.col(client).isNotNull() & F.col(ts).isNotNull() & F.col(order).isNotNull())
    s = s.select(F.col(client).cast("string").alias("client"), F.col(order).cast("long").alias("order"), times.millis(F.col(ts)).alias("at_ms"))
    return s.groupBy("client").transformWithStateInPandas(ClockGuard(), BUCKETED, "append", "None")


def attributed(requests: DataFrame, documents: DataFrame, within: str = "1 hour", columns: tuple[str, ...] = ("page_url",)) -> DataFrame:
    """Requests joined with the document that made them, else with its parent's, as a stream.

    Requests: request_id, document_id, parent_document_id, ts; documents:
    document_id, ts and `columns`. Both have watermarks, and a request comes
    at most `within` after its document. Two outer joins follow each other:
    the second gets the requests of both kinds and tries the parent only for
    those without a document. Rows that stay without any have nulls, and
    come out once the watermarks have passed.
    """
    d = documents.select(F.col("document_id").alias("_doc"), F.col("ts").alias("_doc_ts"), *[F.col(c).alias(f"_{c}") for c in columns])
    near = lambda ts: (F.col("ts") >= F.col(ts)) & (F.col("ts") <= F.col(ts) + F.expr(f"INTERVAL {within}"))
    own = requests.join(d, (F.col("document_id") == F.col("_doc")) & near("_doc_ts"), "leftOuter")
    own = own.withColumn("_parent", F.when(F.col("_doc").isNull(), F.col("parent_document_id"))).drop("_doc_ts")
    p = documents.select(F.col("document_id").alias("_pdoc"), F.col("ts").alias("_pdoc_ts"), *[F.col(c).alias(f"_p_{c}") for c in columns])
    j = own.join(p, (F.col("_parent") == F.col("_pdoc")) & near("_pdoc_ts"), "leftOuter")
    return j.select(*requests.columns, F.when(F.col("_doc").isNotNull(), "document").when(F.col("_pdoc").isNotNull(), "parent").alias("by"), *[F.coalesce(f"_{c}", f"_p_{c}").alias(c) for c in columns])
