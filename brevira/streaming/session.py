"""Live sessions over Structured Streaming: buffers by session, shrunk when their window fills.

Each micro-batch appends its messages to the buffer table, computes every session's pressure in one pass, and runs the
batch chain on the sessions that are under pressure (all of them on a flush); their output replaces their buffer, their facts join
the ledger, and the hashes of their texts are kept for later windows. All state is keyed by session and lies in versioned
folders, so a batch that is run again reads what it read the first time; older versions are deleted.
"""

from __future__ import annotations

import json
import time
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.budget import report
from ..operators.models import Model
from ..plans.compress import COLUMNS, compress, expanded
from ..plans.config import Config, estimate, pressure, reconfigured
from ..session import folders, remove

MESSAGES = "conv_id long, idx long, role string, content string, name string, tool_call_id string, tool_calls array<struct<id:string,type:string,name:string,arguments:string>>, metadata string, compressed boolean"
FACTS = "conv_id long, seq long, category string, content string, turn int, confidence double"
#: State tables and their columns. ``touched``: time of each session's last message, in seconds.
STATE = {
    "buffer": MESSAGES,
    "facts": FACTS,
    "seen": "session_id long, window long, hash string",
    "originals": "conv_id long, idx long, original string",
    "touched": "conv_id long, at double",
}
KEPT = 2


@dataclass
class Sessions:
    """State of all sessions below ``folder``. Sessions without a message for ``ttl`` seconds are forgotten at the next batch."""

    spark: SparkSession
    folder: str
    config: Config = field(default_factory=Config)
    window: int | None = None
    reserve: int = 8_192
    ttl: float | None = 3_600.0
    model: Model | None = None

    def _path(self, name: str, version: int) -> str:
        return f"{self.folder}/{name}-{version:08d}"

    def _exists(self, path: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def state(self, name: str, version: int) -> DataFrame:
        """A state table after batch ``version``; before the first batch what ``load`` has read, or nothing."""
        path = self._path(name, version) if version >= 0 else f"{self.folder}/{name}-loaded"
        if version < 0 and not self._exists(path):
            return self.spark.createDataFrame([], STATE[name])
        return self.spark.read.schema(STATE[name]).parquet(path)

    def buffer(self, version: int) -> DataFrame:
        return self.state("buffer", version)

    def pressures(self, messages: DataFrame) -> DataFrame:
        """(conv_id, pressure): NONE for all where no window is known."""
        e = estimate(messages)
        if self.window is None:
            return e.select("conv_id", F.lit("NONE").alias("pressure"))
        sized = e.select("conv_id", F.lit(self.window).alias("window"), F.lit(self.reserve).alias("reserve"), F.col("estimate").alias("usage"))
        return pressure(sized).select("conv_id", "pressure")

    def _merged(self, old: DataFrame, new: DataFrame) -> DataFrame:
        """The ledger with new facts after the old ones of a session; of equal contents the first stays."""
        last = old.groupBy("conv_id").agg((F.max("seq") + 1).alias("_from"))
        later = new.join(last, "conv_id", "left").withColumn("seq", F.col("seq") + F.coalesce("_from", F.lit(0))).select(*old.columns)
        w = Window.partitionBy("conv_id", F.sha2("content", 256)).orderBy("seq")
        return old.unionByName(later).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")

    def push(self, batch: DataFrame, version: int, flush: bool = False, now: float | None = None) -> DataFrame:
        """Take in one batch as ``version`` (from 0 up); (conv_id, action, rows) of the sessions that it touched."""
        now = time.time() if now is None else now
        others = set(folders(self.spark))
        batch = batch.select(*COLUMNS)
        touched = self.state("touched", version - 1).unionByName(batch.select("conv_id").distinct().withColumn("at", F.lit(now))).groupBy("conv_id").agg(F.max("at").alias("at"))
        if self.ttl is not None:
            touched = touched.where(F.col("at") > now - self.ttl)
        touched.write.mode("overwrite").parquet(self._path("touched", version))
        alive = self.state("touched", version).select("conv_id")
        was = {n: self.state(n, version - 1).join(alive.select(F.col("conv_id").alias("session_id") if n == "seen" else "conv_id"), "session_id" if n == "seen" else "conv_id", "left_semi") for n in ("buffer", "facts", "seen", "originals")}
        whole = was["buffer"].unionByName(batch)
        due = self.pressures(whole)
        due = due if flush else due.where("pressure <> 'NONE'")
        busy = whole.join(due.select("conv_id"), "conv_id", "left_semi")
        calm = whole.join(due.select("conv_id"), "conv_id", "left_anti")
        # rows that an earlier compaction left are flagged and pass through unchanged
        windows = None if self.window is None else busy.select("conv_id").distinct().select("conv_id", F.lit(self.window).alias("window"), F.lit(self.reserve).alias("reserve"), F.lit(0).alias("usage"))
        done = compress(busy, self.config, windows=windows, flush=flush, model=self.model, seen=unseen(was["seen"], version))
        fresh = done.hashes.select("session_id", F.lit(version).cast("long").alias("window"), "hash") if done.hashes is not None else self.spark.createDataFrame([], STATE["seen"])
        first = was["originals"].unionByName(done.originals.join(was["originals"].select("conv_id", "idx"), ["conv_id", "idx"], "left_anti"))
        for name, df in {"buffer": calm.unionByName(done.messages), "facts": self._merged(was["facts"], done.facts), "seen": was["seen"].unionByName(fresh), "originals": first}.items():
            df.select(*self.state(name, -1).columns).write.mode("overwrite").parquet(self._path(name, version))
        remove(self.spark, [f for f in folders(self.spark) if f not in others] + [self._path(n, version - KEPT) for n in STATE if version >= KEPT])
        touched = batch.select("conv_id").distinct() if not flush else whole.select("conv_id").distinct()
        acted = due.select("conv_id").withColumn("_d", F.lit(True))
        rows = self.buffer(version).groupBy("conv_id").agg(F.count("*").alias("rows"))
        return touched.join(acted, "conv_id", "left").join(rows, "conv_id", "left").select("conv_id", F.when(F.col("_d"), "compressed").otherwise("buffered").alias("action"), F.coalesce("rows", F.lit(0)).alias("rows"))

    def run(self, stream: DataFrame, checkpoint: str, out: str, flush: bool = False):
        """Start the stream; each batch's actions are written below the folder ``out``, once however often a batch is run."""

        def take(batch: DataFrame, version: int) -> None:
            batch = batch.persist()
            try:
                self.push(batch, version, flush).write.mode("overwrite").parquet(f"{out}/version={version}")
            finally:
                batch.unpersist()

        return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def configure(self, **changes) -> None:
        """Change settings; state stays. Unknown settings are an error."""
        self.config = reconfigured(self.config, **changes)

    def facts(self, version: int) -> DataFrame:
        return self.state("facts", version)

    def expand(self, version: int, wanted: DataFrame) -> DataFrame:
        """Original texts of the rows of ``wanted`` (conv_id, idx)."""
        return expanded(self.buffer(version), self.state("originals", version), wanted)

    def report(self, version: int) -> DataFrame:
        """Rows and tokens of each session as its messages came and as its buffer holds them."""
        now, was = self.buffer(version), self.state("originals", version)
        rest = now.join(was, ["conv_id", "idx"], "left_anti").select("conv_id", "idx", "content")
        return report(rest.unionByName(was.withColumnRenamed("original", "content")), now, self.config.price)

    def listed(self, version: int) -> DataFrame:
        """(conv_id, at, rows, facts) of all sessions."""
        rows = self.buffer(version).groupBy("conv_id").agg(F.count("*").alias("rows"))
        facts = self.facts(version).groupBy("conv_id").agg(F.count("*").alias("facts"))
        return self.state("touched", version).join(rows, "conv_id", "left").join(facts, "conv_id", "left").na.fill(0, ["rows", "facts"])

    def destroy(self, version: int, gone: DataFrame) -> None:
        """Forget the sessions of ``gone`` (conv_id) as of the last batch ``version``."""
        for name in STATE:
            key = "session_id" if name == "seen" else "conv_id"
            left = self.state(name, version).join(gone.select(F.col("conv_id").alias(key)), key, "left_anti")
            # a folder cannot be written while it is read
            left.select(*self.state(name, -1).columns).write.mode("overwrite").parquet(f"{self.folder}/{name}-next")
            self.spark.read.schema(STATE[name]).parquet(f"{self.folder}/{name}-next").write.mode("overwrite").parquet(self._path(name, version))
            remove(self.spark, [f"{self.folder}/{name}-next"])

    def save(self, version: int, path: str) -> None:
        """Ledger, hashes and settings as JSON files below ``path``; buffers and original texts are not part of it."""
        for name in ("facts", "seen"):
            self.state(name, version).write.mode("overwrite").json(f"{path}/{name}")
        settings = json.dumps({"version": 1, "window": self.window, "reserve": self.reserve, "ttl": self.ttl, "config": asdict(self.config)})
        self.spark.createDataFrame([(settings,)], "value string").write.mode("overwrite").text(f"{path}/settings")


def load(spark: SparkSession, path: str, folder: str, model: Model | None = None, **changes) -> Sessions:
    """Sessions that go on from what ``save`` has written, with state below ``folder``; malformed facts and hashes are skipped.

    ``changes``: settings that replace the saved ones.
    """
    saved = json.loads(spark.read.text(f"{path}/settings").first()["value"])
    s = Sessions(spark, folder, replace(Config(), **saved["config"]), saved["window"], saved["reserve"], saved["ttl"], model)
    s.configure(**changes)
    for name, needed in {"facts": ("conv_id", "category", "content"), "seen": ("session_id", "hash")}.items():
        # read once as text, so that an empty folder of JSON files is an empty table
        lines = spark.read.schema("value string").text(f"{path}/{name}").select(F.from_json("value", STATE[name]).alias("x")).select("x.*")
        lines.dropna(subset=list(needed)).write.mode("overwrite").parquet(f"{folder}/{name}-loaded")
    # a session is touched when it is loaded
    facts = spark.read.schema(FACTS).parquet(f"{folder}/facts-loaded").select("conv_id")
    seen = spark.read.schema(STATE["seen"]).parquet(f"{folder}/seen-loaded").select(F.col("session_id").alias("conv_id"))
    facts.unionByName(seen).distinct().withColumn("at", F.lit(time.time())).write.mode("overwrite").parquet(f"{folder}/touched-loaded")
    return s


def unseen(seen: DataFrame, window_id: int) -> DataFrame:
    """Hashes of other windows of a session: what a window has added itself does not count against it."""
    return seen.where(F.col("window") != window_id)
