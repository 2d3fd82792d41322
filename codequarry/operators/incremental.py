"""Processing only new or changed records.

Each batch compares a listing of inputs with a manifest of what earlier batches took in (path, size, checksum): the
listing is anti-joined with the manifest on path, size and checksum, the outcome is written under the batch's
identifier, and a commit file makes it part of the manifest. Whatever fails before the commit leaves only files that no
commit names; the next attempt at the same batch writes its own. A batch that was committed is not run again.

Several batches that are due are caught up with in one pass: the reports are dealt to their batches once, each path's
states are followed through the batches, and all entries are written by one job, a folder a batch.

The manifest is a log: a segment of entries for each pass and a commit file naming the live segments. After
`compact_every` segments they are folded into one, so that reading it stays linear in the number of paths; identifiers
of batches move to a chain of history files then, so that the commit file stays small.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codequarry import storage

ENTRY = ("path", "observed_at", "present", "size", "checksum")
_SCHEMA = "path string, observed_at timestamp_ntz, present boolean, size bigint, checksum string, changed boolean"


class IncrementalBatches:
    """Batches over a changing set of inputs.

    A listing has the columns path, observed_at, present, size, checksum; others are ignored. It may be a
    delta (only reports that came in since the last batch) or, with `full=True`, everything there is, in which
    case paths of the manifest that the listing lacks become absent.

    Nulls: rows without a path are ignored; a NULL observed_at is older than any other; NULL present means not
    present; NULL size or checksum are values of their own. Of several reports of a path the latest counts, of
    equally late ones a present one, then that of the greatest size, then checksum. A report not later than the
    manifest's entry changes nothing. An empty listing gives an empty, committed batch.

    Two writers: both may prepare a batch; only the first commit of a number counts, the other raises and can be run again.
    """

    def __init__(self, spark: SparkSession, root: str, compact_every: int = 8):
        self.spark, self.root, self.compact_every = spark, root, compact_every

    # -------------------------------------------------------- commits

    def _last(self) -> dict:
        commits = [n for n in storage.names(self.spark, f"{self.root}/commits") if n.endswith(".json") and not n.startswith("_")]
        if not commits:
            return {"seq": 0, "segments": [], "batches": [], "history": ""}
        return json.loads(storage.read_text(self.spark, f"{self.root}/commits/{commits[-1]}"))

    def _history(self, last: dict) -> list[dict]:
        """All batches (id, folder, output folder), oldest first."""
        blocks, at = [last["batches"]], last["history"]
        while at:
            block = json.loads(storage.read_text(self.spark, f"{self.root}/history/{at}"))
            blocks.append(block["batches"])
            at = block["before"]
        return [b for block in reversed(blocks) for b in block]

    def _find(self, last: dict, batch_id: str) -> dict | None:
        known = next((b for b in last["batches"] if b["id"] == batch_id), None)
        return known or next((b for b in self._history(last) if b["id"] == batch_id), None)

    def committed(self) -> list[str]:
        """Identifiers of the committed batches, oldest first."""
        return [b["id"] for b in self._history(self._last())]

    def _commit(self, last: dict, segment: str, batches: list[dict]) -> None:
        seq = last["seq"] + 1
        state = {"seq": seq, "segments": [*last["segments"], segment], "batches": [*last["batches"], *batches], "history": last["history"]}
        if len(state["segments"]) > self.compact_every:
            folded = f"folded-{uuid.uuid4().hex}"
            rows = self._latest(self._segments(state["segments"])).withColumn("changed", F.lit(False))
            rows.write.parquet(f"{self.root}/manifest/{folded}")
            name = f"{seq:08d}-{uuid.uuid4().hex}.json"
            block = {"batches": state["batches"], "before": state["history"]}
            storage.write_text(self.spark, f"{self.root}/history/{name}", json.dumps(block))
            state |= {"segments": [folded], "batches": [], "history": name}
        if not storage.write_text(self.spark, f"{self.root}/commits/{seq:08d}.json", json.dumps(state)):
            raise RuntimeError(f"another writer committed number {seq}; run {[b['id'] for b in batches]} again")

    # -------------------------------------------------------- reading

    def _segments(self, segments: list[str]) -> DataFrame:
        if not segments:
            return self.spark.createDataFrame([], _SCHEMA)
        # A segment's folders of batches are read as one table, without their names.
        reader = self.spark.read.schema(_SCHEMA).option("recursiveFileLookup", "true")
        return reader.parquet(*[f"{self.root}/manifest/{s}" for s in segments])

    def _latest(self, rows: DataFrame) -> DataFrame:
        state = F.struct("observed_at", "present", "size", "checksum")
        return rows.groupBy("path").agg(F.max(state).alias("s")).select("path", "s.*")

    def manifest(self) -> DataFrame:
        """The current entry of every path ever seen, absent ones included."""
        return self._latest(self._segments(self._last()["segments"]))

    def output(self, batch_id: str) -> DataFrame:
        """What a committed batch gave."""
        batch = self._find(self._last(), batch_id)
        if batch is None:
            raise KeyError(f"batch {batch_id} is not committed")
        if batch["output"]:
            return self.spark.read.parquet(f"{self.root}/output/{batch['output']}")
        return self._segments([batch["segment"]]).where("changed").select(*ENTRY)

    def outputs(self) -> DataFrame:
        """Changed entries of all committed batches with their batch identifier."""
        folders = [b["segment"] for b in self._history(self._last())]
        of_file = F.regexp_extract("_metadata.file_path", "/batch=([^/]+)/", 1)
        return self._segments(folders).where("changed").select((of_file if folders else F.lit("")).alias("batch"), *ENTRY)

    # -------------------------------------------------------- running

    def run(
        self,
        batch_id: str,
        listing: DataFrame,
        process: Callable[[DataFrame], DataFrame] | None = None,
        full: bool = False,
    ) -> DataFrame:
        """Process what is new or changed as batch `batch_id`; returns the batch's output.

        Without `process` the output is the changed entries themselves.
        """
        last = self._last()
        if self._find(last, batch_id):
            return self.output(batch_id)
        known = self._latest(self._segments(last["segments"]))
        seen = _reports(listing)
        if full:
            gone = known.where("present").join(seen, "path", "left_anti")
            now = F.greatest(F.current_timestamp().cast("timestamp_ntz"), F.col("observed_at"))
            seen = seen.unionByName(
                gone.select(
                    "path",
                    now.alias("observed_at"),
                    F.lit(False).alias("present"),
                    F.lit(None).cast("bigint").alias("size"),
                    F.lit(None).cast("string").alias("checksum"),
                )
            )
        self._take(last, known, seen.withColumn("_n", F.lit(0)), [batch_id], process)
        return self.output(batch_id)

    def catch_up(self, due: list[tuple[str, datetime]], reports: DataFrame, arrived: str = "arrived_at") -> None:
        """Run the batches that are due (identifier and the moment up to which reports take part, rising) in one pass.

        `reports` has the columns of a listing and `arrived`; a report belongs to the first batch whose moment is not
        before it, and those after the last moment wait. Batches that are committed already are left out, and their
        reports with them. NULL `arrived` counts as before all. Each batch's output is as if it had run by itself.
        """
        last = self._last()
        done = {b["id"] for b in self._history(last)}
        moments = [m for _, m in due]
        if moments != sorted(moments):
            raise ValueError("batches must be due in rising order")
        todo = [b for b, _ in due if b not in done]
        if not todo:
            return
        bounds = F.array(*[F.lit(m).cast("timestamp_ntz") for m in moments])
        number = F.coalesce(F.size(F.filter(bounds, lambda m: m < F.col(arrived).cast("timestamp_ntz"))), F.lit(0))
        # Positions in `due` become positions in `todo`; what belongs to committed batches or to none is -1.
        place = {b: i for i, b in enumerate(todo)}
        to = F.array(*[F.lit(place.get(b, -1)) for b, _ in due])
        taken = F.coalesce(F.get(to, F.when(F.col(arrived).isNull(), 0).otherwise(number)), F.lit(-1))
        rows = _reports(reports.withColumn("_n", taken), "_n").where("_n >= 0")
        self._take(last, self._latest(self._segments(last["segments"])), rows, todo, None)

    def _take(self, last: dict, known: DataFrame, seen: DataFrame, ids: list[str], process: Callable | None) -> None:
        """Follow each path through the batches `ids` (numbers in `_n`), write their entries and commit them together.

        Manifest and listings are merged in order of path and batch; comparing a report with the entry before it is the
        anti-join of its listing with the manifest as that batch finds it.
        """
        if bad := [b for b in ids if not re.fullmatch(r"[\w.-]+", b)]:
            raise ValueError(f"identifiers of batches name folders: {bad}")
        state = F.struct("observed_at", "present", "size", "checksum")
        # Reports of one path and batch are reduced before the shuffle, however many there are.
        latest = seen.groupBy("path", "_n").agg(F.max(state).alias("s"))
        rows = latest.unionByName(known.select("path", F.lit(-1).alias("_n"), state.alias("s")))
        # The greatest state so far: the latest observation, of equally late ones that of the earlier batch.
        ranked = F.struct(F.col("s.observed_at").alias("at"), (-F.col("_n")).alias("early"), "s")
        path = Window.partitionBy("path").orderBy("_n")
        now = rows.withColumn("now", F.max(ranked).over(path.rowsBetween(Window.unboundedPreceding, 0)))
        now = now.withColumn("was", F.lag("now").over(path))
        same = F.col("was.s.present") & F.col("was.s.size").eqNullSafe(F.col("s.size")) & F.col("was.s.checksum").eqNullSafe(F.col("s.checksum"))
        names = F.array(*[F.lit(b) for b in ids])
        entries = now.where((F.col("_n") >= 0) & (F.col("now.early") == -F.col("_n"))).select(
            "path", "s.*", (F.col("s.present") & ~F.coalesce(same, F.lit(False))).alias("changed"), F.get(names, F.col("_n")).alias("batch")
        )
        segment = uuid.uuid4().hex
        # Folders by batch: partitions are balanced by size, so that neither many small files nor one large task come.
        entries.hint("rebalance", "batch").write.partitionBy("batch").parquet(f"{self.root}/manifest/{segment}")
        batches = []
        for b in ids:
            folder = f"{segment}/batch={b}"
            if not storage.exists(self.spark, f"{self.root}/manifest/{folder}"):
                empty = self.spark.createDataFrame([], _SCHEMA)
                empty.write.parquet(f"{self.root}/manifest/{folder}")
            output = ""
            if process is not None:
                output = f"{b}-{segment}"
                changed = self._segments([folder]).where("changed").select(*ENTRY)
                process(changed).write.parquet(f"{self.root}/output/{output}")
            batches.append({"id": b, "segment": folder, "output": output})
        self._commit(last, segment, batches)


def _reports(listing: DataFrame, *more: str) -> DataFrame:
    return listing.where(F.col("path").isNotNull()).select(
        "path",
        F.col("observed_at").cast("timestamp_ntz").alias("observed_at"),
        F.coalesce("present", F.lit(False)).alias("present"),
        F.col("size").cast("bigint").alias("size"),
        F.col("checksum").cast("string").alias("checksum"),
        *more,
    )
