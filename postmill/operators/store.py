"""The store of postings as immutable versions: merge, sightings, pruning, publication."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def fold_batch(batch: DataFrame, *, key: str, order: str, overwrite: Sequence[str], sticky: Sequence[str]) -> DataFrame:
    """One row per key of a batch: the last value by ``order``, for sticky columns the last non-empty one."""
    last = [F.max_by(c, order).alias(c) for c in overwrite]
    kept = [F.max_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(order))).alias(c) for c in sticky]
    return batch.where(F.coalesce(F.col(key), F.lit("")) != "").groupBy(key).agg(*last, *kept)


def upsert(stored: DataFrame, batch: DataFrame, *, key: str, overwrite: Sequence[str], sticky: Sequence[str], first: dict[str, Column], keep: Sequence[str]) -> DataFrame:
    """Merge a folded batch into the store.

    ``overwrite`` columns take the batch's value, ``sticky`` ones only when it is not empty,
    ``keep`` columns stay as stored, and ``first`` gives their values for new keys. Both sides are
    hashed by key once; neither is sent to all tasks.
    """
    s, b = stored.alias("s"), batch.alias("b")
    both = s.join(b, F.col(f"s.{key}") == F.col(f"b.{key}"), "full_outer")
    new, seen = F.col(f"s.{key}").isNull(), F.col(f"b.{key}").isNotNull()
    cols = [F.coalesce(F.col(f"b.{key}"), F.col(f"s.{key}")).alias(key)]
    cols += [F.when(seen, F.col(f"b.{c}")).otherwise(F.col(f"s.{c}")).alias(c) for c in overwrite]
    cols += [F.when(F.coalesce(F.col(f"b.{c}"), F.lit("")) != "", F.col(f"b.{c}")).otherwise(F.col(f"s.{c}")).alias(c) for c in sticky]
    cols += [F.when(new, first[c]).otherwise(F.col(f"s.{c}")).alias(c) for c in keep]
    return both.select(*cols)


def count_misses(stored: DataFrame, sighted: DataFrame, scraped: DataFrame, *, key: str = "dedupe_key", source: str = "source_name") -> DataFrame:
    """Misses after a run: 0 for sighted keys, one more for the unsighted of sources that were scraped."""
    s = sighted.select(key).distinct().withColumn("__seen", F.lit(True))
    ok = scraped.select(source).distinct().withColumn("__ok", F.lit(True))
    both = stored.join(s, key, "left").join(ok, source, "left")
    misses = F.when(F.col("__seen"), 0).when(F.col("__ok"), F.coalesce("misses", F.lit(0)) + 1).otherwise(F.coalesce("misses", F.lit(0)))
    return both.withColumn("misses", misses.cast("int")).drop("__seen", "__ok")


# The states of a stored posting.
STATES = ("new", "seen", "shortlisted", "rejected", "delisted")
OVERWRITTEN = ("source_name", "company", "title", "location", "detail_url", "apply_url")


def merge_sightings(stored: DataFrame, batch: DataFrame, *, run_id: int, now: str, status: str = "new") -> DataFrame:
    """Merge what a run sighted into the store, one row per key.

    ``batch`` has the columns of the store that a reader knows, and ord, the order in the batch. New
    keys get first_seen and last_seen ``now`` and ``status``. Known ones keep first_seen and status,
    but for delisted, which becomes seen; the descriptive columns and last_seen, last_run_id are
    overwritten; experience_level and description_text only by what is not empty, with
    description_fetched_at going along with the text; misses fall to 0; hybrid_confirmed only rises.
    All other columns stay. Rows without a key are left out; of rows with one key the last counts,
    for the sticky columns the last that is not empty.
    """
    if status not in STATES:
        raise ValueError(f"unknown status {status!r}")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in batch.columns else F.lit("")
    has = lambda c: F.when(text(c) != "", F.col("ord"))
    rows = batch.where(F.coalesce(F.col("dedupe_key"), F.lit("")) != "")
    folded = rows.groupBy("dedupe_key").agg(
        *[F.max_by(text(c), "ord").alias(f"b_{c}") for c in OVERWRITTEN],
        F.coalesce(F.max_by(text("experience_level"), has("experience_level")), F.lit("")).alias("b_level"),
        F.max_by(F.struct(text("description_text").alias("t"), text("description_fetched_at").alias("at")), has("description_text")).alias("b_text"),
        F.max(F.coalesce(F.col("hybrid_confirmed").cast("int"), F.lit(0)) if "hybrid_confirmed" in batch.columns else F.lit(0)).alias("b_hybrid"),
    )
    both = stored.join(folded, "dedupe_key", "full_outer")
    hit, new = F.col("b_title").isNotNull(), F.col("first_seen").isNull()
    told = F.col("b_text").isNotNull()
    made = {c: F.when(hit, F.col(f"b_{c}")).otherwise(F.col(c)) for c in OVERWRITTEN} | {
        "first_seen": F.when(new, now).otherwise(F.col("first_seen")),
        "last_seen": F.when(hit, now).otherwise(F.col("last_seen")),
        "last_run_id": F.when(hit, F.lit(run_id)).otherwise(F.col("last_run_id")).cast("bigint"),
        "status": F.when(new, status).when(hit & (F.col("status") == "delisted"), "seen").otherwise(F.col("status")),
        "experience_level": F.when(F.col("b_level") != "", F.col("b_level")).otherwise(F.coalesce("experience_level", F.lit(""))),
        "misses": F.when(hit, 0).otherwise(F.col("misses")),
        "hybrid_confirmed": F.greatest(F.coalesce("hybrid_confirmed", F.lit(0)), F.coalesce("b_hybrid", F.lit(0))),
        "description_text": F.when(told, F.col("b_text.t")).otherwise(F.coalesce("description_text", F.lit(""))),
        "description_fetched_at": F.when(told, F.col("b_text.at")).otherwise(F.coalesce("description_fetched_at", F.lit(""))),
    }
    return both.select(*[made[c].alias(c) if c in made else F.col(c) for c in stored.columns])


def merge_counts(stored: DataFrame, batch: DataFrame, *, key: str = "dedupe_key") -> DataFrame:
    """One row: keys that a merge inserts, and rows that it updates (a second row of a new key counts as one)."""
    rows = batch.where(F.coalesce(F.col(key), F.lit("")) != "").groupBy(key).agg(F.count("*").alias("n"))
    both = rows.join(stored.select(key).withColumn("known", F.lit(True)), key, "left")
    new = F.col("known").isNull()
    return both.agg(F.count_if(new).alias("inserted"), F.coalesce(F.sum(F.col("n") - new.cast("int")), F.lit(0)).alias("updated"))


def delist(stored: DataFrame, sighted: DataFrame, scraped: DataFrame, *, threshold: int, forced: Sequence[str] = ()) -> DataFrame:
    """The store after a run's misses: counters, and who is delisted by them.

    Only postings of ``scraped`` sources (read well, with rows) change: sighted ones fall to 0
    misses, unsighted ones that are not delisted gain one, and new or seen ones with ``threshold``
    misses are delisted. New and seen postings of ``forced`` sources are delisted at once.
    """
    if threshold < 1:
        raise ValueError(f"the threshold must be at least 1, got {threshold}")
    s = sighted.select("dedupe_key").distinct().withColumn("__seen", F.lit(True))
    ok = scraped.select("source_name").distinct().withColumn("__ok", F.lit(True))
    both = stored.join(s, "dedupe_key", "left").join(ok, "source_name", "left")
    had = F.coalesce("misses", F.lit(0))
    n = F.when(F.col("__ok") & F.col("__seen"), 0).when(F.col("__ok") & (F.col("status") != "delisted"), had + 1).otherwise(had)
    open_ = F.col("status").isin("new", "seen")
    gone = open_ & ((F.coalesce("__ok", F.lit(False)) & (F.col("__n") >= threshold)) | F.col("source_name").isin(list(forced)))
    out = both.withColumn("__n", n.cast("int")).withColumn("status", F.when(gone, "delisted").otherwise(F.col("status"))).withColumn("misses", F.col("__n"))
    return out.select(*stored.columns)


def with_changes(stored: DataFrame, changes: DataFrame, column: str, *, key: str = "dedupe_key", where: Column | None = None) -> DataFrame:
    """The store with ``column`` replaced for the keys of ``changes`` (key, column), where ``where`` holds.

    An empty value is refused when it is read, since empty means not determined. Of several changes
    of one key the greatest counts.
    """
    new = changes.groupBy(key).agg(F.max(column).alias("__new"))
    checked = F.when(F.coalesce(F.col("__new"), F.lit("")) == "", F.raise_error(F.lit(f"refusing to write an empty {column}"))).otherwise(F.col("__new"))
    both = stored.join(new.withColumn("__hit", F.lit(True)), key, "left")
    hit = F.coalesce("__hit", F.lit(False)) & (F.lit(True) if where is None else F.coalesce(where, F.lit(False)))
    return both.withColumn(column, F.when(hit, checked).otherwise(F.col(column))).select(*stored.columns)


def row_numbers(tokens: Sequence[str]) -> list[int]:
    """Numbers and inclusive ranges like 9-12 as numbers; anything else is refused."""
    out: list[int] = []
    for token in tokens:
        a, dash, b = token.partition("-")
        if not a.strip().isdigit() or dash and not b.strip().isdigit():
            raise ValueError(f"{token!r} is neither a row number nor a range")
        first, last = int(a), int(b) if dash else int(a)
        if first > last:
            raise ValueError(f"the range {token!r} runs backwards")
        out += range(first, last + 1)
    return out


def decide(stored: DataFrame, sheet: DataFrame, decisions: dict[str, Sequence[int]], sweep: str | None = None) -> DataFrame:
    """The store after decisions on rows of the last exported ``sheet`` (row_number, dedupe_key).

    ``decisions`` maps a status to row numbers. A number under two statuses or on no row of the sheet
    refuses all of them. ``sweep`` then gives its status to all postings that are still new.
    """
    numbers = [(int(n), status) for status, ns in decisions.items() for n in set(ns)]
    if len({n for n, _ in numbers}) < len(numbers):
        raise ValueError("a row is given two states")
    for status in [*decisions, *([sweep] if sweep else [])]:
        if status not in STATES:
            raise ValueError(f"unknown status {status!r}")
    out = stored
    if numbers:
        # As many rows as were typed.
        asked = stored.sparkSession.createDataFrame(numbers, "row_number long, status string").join(sheet.select(F.col("row_number").cast("bigint"), "dedupe_key"), "row_number", "left")
        lost = sorted(r.row_number for r in asked.where("dedupe_key IS NULL").collect())
        if lost:
            raise ValueError(f"no such row in the sheet: {', '.join(map(str, lost))}")
        out = with_changes(out, asked, "status")
    return out.withColumn("status", F.when(F.col("status") == "new", sweep).otherwise(F.col("status"))) if sweep else out


def health_record(health: DataFrame, rows: DataFrame) -> DataFrame:
    """Health with ``rows`` (source_name, run_id, rows_found, ok, error, at) in place of older ones of a source and run; at gives their order."""
    both = health.unionByName(rows, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in ("source_name", "run_id", "at")]
    last = both.groupBy("source_name", "run_id").agg(F.max_by(F.struct(*rest, "at"), F.coalesce(F.col("at"), F.lit(""))).alias("r"))
    return last.select("source_name", "run_id", *[F.col(f"r.{c}").alias(c) for c in [*rest, "at"]])


def begin_run(runs: DataFrame, *, kind: str, at: str) -> tuple[int, DataFrame]:
    """The next run's number and the runs with it, not finished."""
    if kind not in ("scrape", "refilter"):
        raise ValueError(f"unknown kind {kind!r}")
    n = (runs.agg(F.max("run_id")).first()[0] or 0) + 1
    return n, runs.unionByName(runs.sparkSession.createDataFrame([(n, at, None, kind)], "run_id long, started_at string, finished_at string, kind string"))


def finish_run(runs: DataFrame, run_id: int, at: str) -> DataFrame:
    return runs.withColumn("finished_at", F.when(F.col("run_id") == run_id, F.lit(at)).otherwise(F.col("finished_at")))


def import_seen(stored: DataFrame, rows: DataFrame, *, run_id: int, now: str) -> DataFrame:
    """The store with ``rows`` as seen: unknown keys come in so, new or delisted ones become so; decisions stay."""
    keys = rows.where(F.trim(F.coalesce("dedupe_key", F.lit(""))) != "").withColumn("dedupe_key", F.trim("dedupe_key"))
    known = stored.join(keys.select("dedupe_key").distinct().withColumn("__hit", F.lit(True)), "dedupe_key", "left")
    turned = known.withColumn("status", F.when(F.col("__hit") & F.col("status").isin("new", "delisted"), "seen").otherwise(F.col("status"))).select(*stored.columns)
    text = {c: F.coalesce(F.first(F.col(c).cast("string")), F.lit("")) if c in rows.columns else F.lit("") for c in OVERWRITTEN}
    fresh = keys.join(stored.select("dedupe_key"), "dedupe_key", "left_anti").groupBy("dedupe_key").agg(*[text[c].alias(c) for c in OVERWRITTEN])
    fresh = fresh.select("*", F.lit(now).alias("first_seen"), F.lit(now).alias("last_seen"), F.lit(run_id).cast("bigint").alias("last_run_id"), F.lit("seen").alias("status"), F.lit(0).alias("misses"))
    return turned.unionByName(fresh.select(*[c for c in fresh.columns if c in stored.columns]), allowMissingColumns=True)


def kept_runs(runs: DataFrame, logged: DataFrame, last: int) -> DataFrame:
    """The runs whose log is kept: the ``last`` scrapes that logged anything, and all runs from the oldest of these on."""
    ids = logged.select("run_id").distinct()
    scrapes = runs.where("kind = 'scrape'").join(ids, "run_id", "left_semi").orderBy(F.desc("run_id")).limit(last)
    oldest = scrapes.agg(F.min("run_id").alias("oldest"))
    return runs.join(ids, "run_id", "left_semi").join(F.broadcast(oldest), F.col("run_id") >= F.col("oldest"), "left_semi")


def miss_streaks(states: DataFrame, *, key: str = "dedupe_key", order: str = "run_id", missed: Column) -> DataFrame:
    """Runs of successive misses (gaps and islands): key, first and last of the streak, and its length.

    Order numbers count the states of a key, so a key has no more rows in its window than there are
    runs.
    """
    w = Window.partitionBy(key).orderBy(order)
    rows = states.select(key, order, missed.alias("m")).withColumn("i", F.row_number().over(w))
    hit = rows.where("m").withColumn("island", F.col("i") - F.row_number().over(w))
    return hit.groupBy(key, "island").agg(F.min(order).alias("first_run"), F.max(order).alias("last_run"), F.count("*").alias("streak")).drop("island")


class VersionedStore:
    """Versions v=N of tables under a folder of any Hadoop file system, and a CURRENT file that names the one in force.

    A run writes a whole new version, checks it, and publishes by renaming a new CURRENT over the
    old one; a run that fails or is dry leaves CURRENT as it was. The one before is kept as
    CURRENT.before.
    """

    def __init__(self, root: str) -> None:
        self.root = root.rstrip("/")

    def _path(self, spark: SparkSession, name: str) -> tuple[object, object]:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _text(self, spark: SparkSession, name: str) -> str | None:
        path, fs = self._path(spark, name)
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _put(self, spark: SparkSession, name: str, text: str) -> None:
        """Write under another name, then rename over the old file in one step."""
        path, fs = self._path(spark, name)
        part, _ = self._path(spark, f".{name}.{uuid.uuid4().hex}")
        stream = fs.create(part, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        jvm = spark.sparkContext._jvm
        overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(fs.makeQualified(part), fs.makeQualified(path), overwrite)

    def current(self, spark: SparkSession | None = None) -> int | None:
        text = self._text(spark or SparkSession.active(), "CURRENT")
        return int(text) if text else None

    def read(self, spark: SparkSession, table: str) -> DataFrame | None:
        """A table of the version in force; None where there is no version or no such table."""
        v = self.current(spark)
        if v is None:
            return None
        path, fs = self._path(spark, f"v={v}/{table}")
        return spark.read.parquet(f"{self.root}/v={v}/{table}") if fs.exists(path) else None

    def write(self, tables: dict[str, DataFrame], checks: dict[str, Callable[[DataFrame], Column]] | None = None, *, dry: bool = False, unique: dict[str, str] | None = None) -> int:
        """Write the tables as the next version, check them and publish; returns its number."""
        spark = SparkSession.active()
        before = self.current(spark)
        v = (before or 0) + 1
        for name, df in tables.items():
            path = f"{self.root}/v={v}/{name}"
            df.write.mode("overwrite").parquet(path)
            written = df.sparkSession.read.parquet(path)
            for what, test in (checks or {}).items():
                if what.partition(":")[0] == name and not written.where(~test(written)).isEmpty():
                    raise ValueError(f"{what} does not hold")
            key = (unique or {}).get(name)
            if key and not written.groupBy(key).count().where("count > 1").isEmpty():
                raise ValueError(f"{name}.{key} is not unique")
        if not dry:
            if before is not None:
                self._put(spark, "CURRENT.before", str(before))
            self._put(spark, "CURRENT", str(v))
        return v


def stored_index(postings: DataFrame, stored: DataFrame, *, key: str = "dedupe_key", columns: Sequence[str] = ("status", "experience_level", "hybrid_confirmed")) -> DataFrame:
    """Postings with what the store knows of them: is_stored, ``columns`` as stored_..., and the length of the stored text."""
    known = stored.select(key, *[F.col(c).alias(f"stored_{c}") for c in columns], F.length(F.coalesce("description_text", F.lit(""))).alias("stored_chars"), F.lit(True).alias("is_stored"))
    return postings.join(known, key, "left").withColumn("is_stored", F.coalesce("is_stored", F.lit(False)))


def by_status(postings: DataFrame, stored: DataFrame, status: str, *, key: str = "dedupe_key") -> tuple[DataFrame, DataFrame]:
    """(postings whose stored state is ``status``, all others); the side of keys is as long as the store, so both are hashed."""
    keys = stored.where(F.col("status") == status).select(key)
    return postings.join(keys, key, "left_semi"), postings.join(keys, key, "left_anti")


def latest_locations(labels: DataFrame, *seen: DataFrame, key: str = "dedupe_key", at: str = "at") -> DataFrame:
    """Labels with the location last seen under their key in any of ``seen`` (key, location, at), and whether it differs from their own.

    Of several at one time the greatest text counts; a key that was never seen keeps its own.
    """
    every = seen[0].select(key, "location", at)
    for s in seen[1:]:
        every = every.unionByName(s.select(key, "location", at))
    last = every.where(F.coalesce("location", F.lit("")) != "").groupBy(key).agg(F.max(F.struct(F.col(at), F.col("location"))).alias("m"))
    both = labels.join(last, key, "left")
    new = F.coalesce("m.location", "location")
    return both.withColumn("latest", new).withColumn("differs", ~new.eqNullSafe(F.col("location"))).drop("m")
