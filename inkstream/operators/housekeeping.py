"""Retention over sessions, articles, attachment files and the audit log, as one step."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .delivery import expire_html


def live_sessions(sessions: DataFrame, at: Column) -> DataFrame:
    """Sessions that have not expired at that time."""
    return sessions.where(~F.coalesce(F.col("expires_at") <= at, F.lit(False)))


def files_to_release(attachments: DataFrame, deliveries: DataFrame, cutoff: Column) -> DataFrame:
    """(id, local_path, delete): old files whose article has no pending delivery.

    Several attachments may share a file. It is deleted only where all of them are released, once, with the last of them.
    A path that leaves the folder of the files is released and never deleted.
    """
    pending = deliveries.where("status = 'pending'").select("article_id").distinct()
    kept = attachments.where("local_path IS NOT NULL")
    old = kept.where(F.col("created_at") < cutoff).join(pending, "article_id", "left_anti").select("id", "local_path")
    references = kept.groupBy("local_path").agg(F.count(F.lit(1)).alias("_all"))
    released = old.groupBy("local_path").agg(F.count(F.lit(1)).alias("_old"), F.max("id").alias("_last"))
    inside = ~F.col("local_path").rlike(r"^/|(^|/)\.\.(/|$)")
    full = references.join(released, "local_path").select("local_path", F.when((F.col("_all") == F.col("_old")) & inside, F.col("_last")).alias("_last"))
    return old.join(full, "local_path").select("id", "local_path", F.coalesce(F.col("id") == F.col("_last"), F.lit(False)).alias("delete"))


def delete_files(released: DataFrame, delete: Callable[[str], None]) -> DataFrame:
    """(local_path, error) of every file to delete; `delete` runs on the executors, what it raises concerns that file alone.

    The caller stores the result before reading it twice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            errors = []
            for path in batch.column(0).to_pylist():
                try:
                    delete(path)
                    errors.append(None)
                except FileNotFoundError:
                    # Gone already: an attempt that was repeated after a lost executor.
                    errors.append(None)
                except OSError as error:
                    errors.append(f"{type(error).__name__}: {error}")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(errors, pa.string())], names=["local_path", "error"])

    return released.where("delete").select("local_path").mapInArrow(run, "local_path string, error string")


def after_release(attachments: DataFrame, released: DataFrame, deleted: DataFrame) -> DataFrame:
    """attachments with the paths of released files cleared; the last reference to a file that could not be deleted stays."""
    failed = deleted.where("error IS NOT NULL").select("local_path").withColumn("_failed", F.lit(True))
    gone = released.join(failed, "local_path", "left").where(~(F.col("delete") & F.coalesce("_failed", F.lit(False)))).select("id", F.lit(True).alias("_gone"))
    rows = attachments.join(gone, "id", "left")
    return rows.select(*[F.when(~F.coalesce("_gone", F.lit(False)), F.col(c)).alias(c) if c == "local_path" else F.col(c) for c in attachments.columns])


def housekeeping(tables: dict[str, DataFrame], *, at: Column, article_days: int, attachment_days: int, audit_days: int, delete: Callable[[str], None]) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables after one run, to be written back, and (table, affected) counts.

    tables: sessions, articles, attachments, deliveries, audit_log. Each rule reads its own table and what it depends on;
    a file whose deletion fails keeps its row, is not counted and comes again in the next run.
    """
    before = lambda days: at - F.make_dt_interval(F.lit(days))
    released = cut_lineage(files_to_release(tables["attachments"], tables["deliveries"], before(attachment_days)))
    deleted = cut_lineage(delete_files(released, delete))
    kept_audit = tables["audit_log"].where(~F.coalesce(F.col("created_at") < before(audit_days), F.lit(False)))
    after = {
        "sessions": live_sessions(tables["sessions"], at),
        "articles": expire_html(tables["articles"], before(article_days)),
        "attachments": after_release(tables["attachments"], released, deleted),
        "audit_log": kept_audit,
    }
    markup = F.col("content_html").isNotNull()
    changes = {
        "sessions": (tables["sessions"], after["sessions"], F.lit(True)), "articles": (tables["articles"], after["articles"], markup),
        "attachments": (tables["attachments"], after["attachments"], F.col("local_path").isNotNull()), "audit_log": (tables["audit_log"], after["audit_log"], F.lit(True)),
    }
    counts = None
    for name, (old, new, counted) in changes.items():
        both = old.select(counted.cast("int").alias("_n")).unionByName(new.select((-counted.cast("int")).alias("_n")))
        row = both.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("affected")).select(F.lit(name).alias("table"), "affected")
        counts = row if counts is None else counts.unionByName(row)
    return after, counts


def provider_health(calls: DataFrame, *, threshold: int, cooldown_sec: int) -> DataFrame:
    """State of every provider after its calls, as if each had updated the row of the one before.

    calls: provider, called_at, id, outcome (success or anything else), error, fatal. A success clears failures,
    cooldown and error; a failure raises them, and cools down from `threshold` failures in a row on, or at once if fatal.
    Only what came after the last success matters, so the state is one aggregate over the calls.
    """
    order = F.struct("called_at", "id")
    worked = F.col("outcome") == "success"
    reset = calls.groupBy("provider").agg(F.max(F.when(worked, order)).alias("_reset"))
    failed = ~worked
    since = failed & (F.col("_reset").isNull() | (order > F.col("_reset")))
    rows = calls.join(reset, "provider").withColumn("_order", order).withColumn("_since", F.coalesce(since, F.lit(False)))
    state = rows.groupBy("provider").agg(
        F.count(F.lit(1)).alias("total_calls"), F.count_if(failed).alias("total_failures"), F.count_if("_since").alias("consecutive_failures"),
        F.max_by(F.when(F.col("_since"), F.struct("called_at", "error", "fatal")), F.when(F.col("_since"), F.col("_order"))).alias("_l"), F.max("called_at").alias("updated_at"),
    )
    cools = F.coalesce(F.col("_l.fatal"), F.lit(False)) | (F.col("consecutive_failures") >= threshold)
    until = F.date_trunc("second", F.col("_l.called_at")) + F.make_dt_interval(secs=F.lit(cooldown_sec))
    return state.select(
        "provider", "total_calls", "total_failures", "consecutive_failures", F.when((F.col("consecutive_failures") > 0) & cools, until).alias("cooldown_until"),
        F.col("_l.error").alias("last_error"), "updated_at",
    )
