"""The metric store: runs, numeric metrics, detail metrics and orchestration runs.

Tables are Parquet folders partitioned by batch and ``partition_date``.  A row is active
while its ``expiry_date`` is the sentinel.

A store only ever grows.  A writer first appends the files of its batch, then makes the
batch visible by creating the next commit file, which fails if another writer created it
before.  The writer that came second looks at what was committed meanwhile: other datasets
and dates do not concern it and it takes the next number; the same ones are a ``Conflict``.
A batch whose commit is missing or unfinished is not read, so a crash shows nothing.

An expiry is part of a batch too, so a rerun ends the old runs and shows the new ones in one
commit.  Reading applies an expiry to everything committed before it.  ``compact`` writes all
visible rows, with their expiry, as one batch; reading starts at the newest of those.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from plumbline import constants as c
from plumbline.functions.columns import as_column, ntz
from plumbline.session import spread, tasks_for

RUNS, NUMERICS, DETAILS, SKETCHES = "runs", "numerics", "details", "sketches"
EXPIRIES, ORCHESTRATIONS, BASELINES, COMMITS = "expiries", "orchestrations", "baselines", "commits"
_COMMIT = "batch_id string, seq bigint, covers bigint, schemas map<string,string>"
_EXPIRIES = "run_id bigint, expired_at timestamp_ntz, next_rerun_number int"
_ORCHESTRATIONS = (
    "orchestration_run_id bigint, parent_path string, run_status string, start_time timestamp_ntz, end_time timestamp_ntz, "
    "total_datasets bigint, passed_datasets bigint, failed_datasets bigint, not_run_datasets bigint, error_summary string"
)
_SETTLE_TENTHS = 50
RUNNING, COMPLETED, WITH_ERRORS = "running", "completed", "completed_with_errors"


class Conflict(RuntimeError):
    """Another writer committed runs of the same datasets and dates meanwhile."""


def sentinel() -> Column:
    return F.lit(c.ACTIVE_EXPIRY).cast("timestamp_ntz")


def active(df: DataFrame) -> DataFrame:
    return df.filter(F.col("expiry_date") == sentinel())


# ---- reruns -----------------------------------------------------------------

def expire_runs(runs: DataFrame, targets: DataFrame, at) -> DataFrame:
    """All run rows, the active ones of the target (dataset, date) expired at ``at``.

    ``next_rerun_number`` is set on the rows this call expired.
    """
    marks = targets.select(*c.KEYS).distinct().withColumn("_hit", F.lit(True))
    hit = F.col("_hit").isNotNull() & (F.col("expiry_date") == sentinel())
    return runs.join(marks, list(c.KEYS), "left").withColumns(
        {
            "expiry_date": F.when(hit, ntz(as_column(at))).otherwise(F.col("expiry_date")),
            "next_rerun_number": F.when(hit, F.col("rerun_number") + 1),
        }
    ).drop("_hit")


def expire_metrics(metrics: DataFrame, runs: DataFrame, targets: DataFrame, at) -> DataFrame:
    """The same for metric rows: those of the active runs of the targets."""
    ids = (
        active(runs).join(targets.select(*c.KEYS), list(c.KEYS), "left_semi")
        .select("run_id").distinct().withColumn("_hit", F.lit(True))
    )
    hit = F.col("_hit").isNotNull() & (F.col("expiry_date") == sentinel())
    return metrics.join(ids, "run_id", "left").withColumn(
        "expiry_date", F.when(hit, ntz(as_column(at))).otherwise(F.col("expiry_date"))
    ).drop("_hit")


def rerun_numbers(runs: DataFrame, targets: DataFrame) -> DataFrame:
    """Rerun number each target gets after expiry: previous active + 1, first run 1."""
    previous = (
        active(runs).groupBy(*c.KEYS).agg(F.max("rerun_number").alias("previous_rerun_number"))
    )
    return targets.select(*c.KEYS).distinct().join(previous, list(c.KEYS), "left").withColumn(
        "rerun_number", F.coalesce("previous_rerun_number", F.lit(0)) + 1
    )


def next_rerun_numbers(runs: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """max(rerun_number) + 1 over all rows, expired ones too; 0 without history."""
    known = runs.groupBy(*c.KEYS).agg((F.max("rerun_number") + 1).alias("next_rerun_number"))
    if targets is None:
        return known
    return targets.select(*c.KEYS).distinct().join(known, list(c.KEYS), "left").withColumn(
        "next_rerun_number", F.coalesce("next_rerun_number", F.lit(0))
    )


# ---- orchestration ----------------------------------------------------------

def orchestration_id(parent_path: Column, start_time: Column) -> Column:
    """A stable id: path and start time identify an orchestration run."""
    return F.xxhash64(parent_path, start_time)


def start_orchestration(spark: SparkSession, parent_paths: Sequence[str], start_time) -> DataFrame:
    """A ``running`` row per parent path."""
    rows = spark.createDataFrame([(p,) for p in parent_paths], "parent_path string")
    return running(rows, start_time)


def running(paths: DataFrame, start_time) -> DataFrame:
    start = ntz(as_column(start_time))
    return paths.select(
        orchestration_id(F.col("parent_path"), start).alias("orchestration_run_id"),
        "parent_path",
        F.lit(RUNNING).alias("run_status"),
        start.alias("start_time"),
        sentinel().alias("expiry_date"),
    )


def orchestration_rollup(runs: DataFrame) -> DataFrame:
    """Final status and counts of every orchestration run from its active run rows."""
    failed = F.count_if(F.col("check_status") == c.FAIL)
    return (
        active(runs)
        .filter(F.col("orchestration_run_id").isNotNull())
        .groupBy("orchestration_run_id")
        .agg(
            F.count(F.lit(1)).alias("total_datasets"),
            F.count_if(F.col("check_status") == c.PASS).alias("passed_datasets"),
            failed.alias("failed_datasets"),
            F.when(failed == 0, "completed").otherwise("completed_with_errors").alias("run_status"),
            F.when(failed > 0, F.concat(failed.cast("string"), F.lit(" failed")))
            .alias("error_summary"),
        )
    )


def write_running(folder: str, started: DataFrame) -> None:
    """Commit the first version of orchestration runs."""
    _commit(started.sparkSession, folder, {ORCHESTRATIONS: _full_orchestration(started)}, last_commit(started.sparkSession, folder))


def finalize(spark: SparkSession, folder: str, end_time, errors: DataFrame | None = None,
             only: DataFrame | None = None) -> None:
    """Commit the final version of the running orchestration runs.

    Counts come from their active runs at this commit: all of them, passed, failed and those
    that could not be run.  A run completes with errors if any failed or could not be run, or if
    ``errors`` (orchestration_run_id, error_summary) names it.  ``only``: ids to finalize.
    """
    seen = last_commit(spark, folder)
    running_rows = read_orchestrations(spark, folder).filter(F.col("run_status") == RUNNING)
    if only is not None:
        running_rows = running_rows.join(only.select("orchestration_run_id").distinct(), "orchestration_run_id", "left_semi")
    runs = active(read_table(spark, folder, RUNS)) if has_table(spark, folder, RUNS) else spark.createDataFrame(
        [], "orchestration_run_id bigint, check_status string")
    status = F.col("check_status")
    counts = runs.filter(F.col("orchestration_run_id").isNotNull()).groupBy("orchestration_run_id").agg(
        F.count(F.lit(1)).alias("total_datasets"), F.count_if(status == c.PASS).alias("passed_datasets"),
        F.count_if(status == c.FAIL).alias("failed_datasets"), F.count_if(status == c.NOT_RUN).alias("not_run_datasets"),
    )
    out = running_rows.drop("total_datasets", "passed_datasets", "failed_datasets", "not_run_datasets", "error_summary").join(
        counts, "orchestration_run_id", "left")
    if errors is None:
        out = out.withColumn("_error", F.lit(None).cast("string"))
    else:
        out = out.join(errors.select("orchestration_run_id", F.col("error_summary").alias("_error")), "orchestration_run_id", "left")
    numbers = {x: F.coalesce(x, F.lit(0).cast("bigint")) for x in ("total_datasets", "passed_datasets", "failed_datasets", "not_run_datasets")}
    out = out.withColumns(numbers)
    troubled = (F.col("failed_datasets") > 0) | (F.col("not_run_datasets") > 0) | F.col("_error").isNotNull()
    counted = F.concat_ws(
        ", ", F.when(F.col("failed_datasets") > 0, F.concat(F.col("failed_datasets").cast("string"), F.lit(" failed"))),
        F.when(F.col("not_run_datasets") > 0, F.concat(F.col("not_run_datasets").cast("string"), F.lit(" not run"))),
    )
    final = out.withColumns({
        "run_status": F.when(troubled, WITH_ERRORS).otherwise(COMPLETED),
        "error_summary": F.coalesce("_error", F.when(troubled, counted)),
        "end_time": ntz(as_column(end_time)),
    })
    _commit(spark, folder, {ORCHESTRATIONS: _full_orchestration(final)}, seen)


def _full_orchestration(rows: DataFrame) -> DataFrame:
    kinds = T._parse_datatype_string(_ORCHESTRATIONS)
    return rows.select(*(
        (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds.fields
    ))


def read_orchestrations(spark: SparkSession, folder: str, as_of: int | None = None) -> DataFrame:
    """The newest version of every orchestration run, at a commit if one is given.

    A later run of the same parent path expires the earlier one at its start.
    """
    rows = _visible(spark, folder, ORCHESTRATIONS, as_of)
    if rows is None:
        return spark.createDataFrame([], f"{_ORCHESTRATIONS}, expiry_date timestamp_ntz")
    newest = Window.partitionBy("orchestration_run_id").orderBy(F.desc("seq"))
    following = F.lead("start_time").over(Window.partitionBy("parent_path").orderBy("start_time", "orchestration_run_id"))
    return (
        rows.withColumn("_nth", F.row_number().over(newest)).filter("_nth = 1").drop("_nth", "seq")
        .withColumn("expiry_date", F.coalesce(following, sentinel()))
    )


# ---- commits ----------------------------------------------------------------

def _commits(spark: SparkSession, folder: str, as_of: int | None = None) -> list:
    """The commits to read, the newest compaction first; a driver list bounded by compaction.

    Unfinished commit files are no JSON and are passed over.
    """
    try:
        found = spark.read.schema(_COMMIT).json(f"{folder}/{COMMITS}")
        rows = found.filter(F.col("batch_id").isNotNull()).collect()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return []
        raise
    rows = sorted((r for r in rows if as_of is None or r["seq"] <= as_of), key=lambda r: r["seq"])
    packed = max((r for r in rows if r["covers"] is not None), key=lambda r: (r["covers"], r["seq"]), default=None)
    if packed is None:
        return rows
    return [packed] + [r for r in rows if r["covers"] is None and r["seq"] > packed["covers"]]


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def last_commit(spark: SparkSession, folder: str) -> int:
    """The highest commit number in use, unfinished ones too."""
    path, system = _path(spark, f"{folder}/{COMMITS}")
    if not system.exists(path):
        return -1
    names = [x.getPath().getName() for x in system.listStatus(path)]
    return max((int(x.split(".")[0]) for x in names if x.endswith(".json") and x[0].isdigit()), default=-1)


def _claim(spark: SparkSession, folder: str, seq: int, record: dict) -> bool:
    """Create a commit file unless it is there; False if it is."""
    path, system = _path(spark, f"{folder}/{COMMITS}/{seq:012d}.json")
    try:
        out = system.create(path, False)
    except Py4JJavaError as error:
        if system.exists(path):
            return False
        raise error
    try:
        out.write(bytearray((json.dumps({**record, "seq": seq}) + "\n").encode()))
    finally:
        out.close()
    return True


def _commit(spark: SparkSession, folder: str, tables: dict[str, DataFrame], seen: int, covers: int | None = None) -> int:
    """Append the tables as one batch and make it visible; returns its number.

    ``seen``: the last commit that the batch takes into account.
    """
    batch = f"b-{uuid.uuid4().hex}"
    for name, df in tables.items():
        place = f"{folder}/{name}/batch_id={batch}"
        if "partition_date" in df.columns:
            df = df.hint("rebalance", "partition_date").sortWithinPartitions("partition_date", "dataset_name")
            df.write.partitionBy("partition_date").parquet(place)
        else:
            df.write.parquet(place)
    schemas = {name: df.schema.json() for name, df in tables.items()}
    record = {"batch_id": batch, "schemas": schemas, **({} if covers is None else {"covers": covers})}
    seq = seen + 1
    while not _claim(spark, folder, seq, record):
        if covers is None and RUNS in tables:
            _refuse_same_keys(spark, folder, tables[RUNS], seq, BASELINES in tables)
        seq += 1
    return seq


def _refuse_same_keys(spark: SparkSession, folder: str, runs: DataFrame, seq: int, state: bool) -> None:
    """Raise if a commit holds runs of the same keys, or a kept state where this batch has one.

    A commit file is filled right after its creation; one that stays empty was left by a writer
    that died, and shows nothing for good.
    """
    path, system = _path(spark, f"{folder}/{COMMITS}/{seq:012d}.json")
    for _ in range(_SETTLE_TENTHS):
        if system.getFileStatus(path).getLen() > 0:
            break
        time.sleep(0.1)
    other = [r for r in _commits(spark, folder, seq) if r["seq"] == seq and r["covers"] is None and RUNS in (r["schemas"] or {})]
    if other and state and BASELINES in other[0]["schemas"]:
        raise Conflict(f"commit {seq} holds a newer kept state")
    if other:
        theirs = _read_batches(spark, folder, RUNS, other).select(*c.KEYS)
        if not runs.select(*c.KEYS).join(theirs, list(c.KEYS), "left_semi").isEmpty():
            raise Conflict(f"commit {seq} holds runs of the same datasets and dates")


def _read_batches(spark: SparkSession, folder: str, name: str, commits: list) -> DataFrame:
    """The rows of some batches with the number they count from; columns of any of them."""
    fields: dict[str, T.StructField] = {}
    for text in {r["schemas"][name]: None for r in commits}:
        fields = {f.name: f for f in T.StructType.fromJson(json.loads(text)).fields} | fields
    schema = T.StructType(list(fields.values())).add("batch_id", "string")
    places = [f"{folder}/{name}/batch_id={r['batch_id']}" for r in commits]
    rows = spark.read.schema(schema).option("basePath", f"{folder}/{name}").parquet(*places)
    numbers = spark.createDataFrame(
        [(r["batch_id"], r["seq"] if r["covers"] is None else r["covers"]) for r in commits], "batch_id string, seq bigint")
    return rows.join(F.broadcast(numbers), "batch_id").drop("batch_id")  # one row per commit since the last compaction


def _having(spark: SparkSession, folder: str, name: str, as_of: int | None) -> list:
    return [r for r in _commits(spark, folder, as_of) if name in (r["schemas"] or {})]


def _visible(spark: SparkSession, folder: str, name: str, as_of: int | None) -> DataFrame | None:
    own = _having(spark, folder, name, as_of)
    return _read_batches(spark, folder, name, own) if own else None


# ---- files ------------------------------------------------------------------

def run_id(*columns: str) -> Column:
    """A stable id from the natural key."""
    return F.xxhash64(*columns)


def write_metrics(folder: str, runs: DataFrame, numerics: DataFrame, details: DataFrame, *,
                  replace: DataFrame | None = None, at=None, seen: int | None = None,
                  baselines: DataFrame | None = None, sketches: DataFrame | None = None) -> int:
    """Append a batch to the three tables; it becomes visible as a whole.

    ``replace``: (dataset, date) whose active runs end at ``at`` in the same commit.
    ``seen``: the last commit the rows were made from; now, without.
    ``baselines``: the whole kept state after the batch, which takes the place of the former.
    ``sketches``: rows with a run_id like the metrics, which end with their runs.
    """
    spark = runs.sparkSession
    seen = last_commit(spark, folder) if seen is None else seen
    tables = {NUMERICS: numerics, DETAILS: details, RUNS: runs}
    if replace is not None and has_table(spark, folder, RUNS, seen):
        tables[EXPIRIES] = _ended(spark, folder, replace, at, seen)
    if sketches is not None:
        tables[SKETCHES] = sketches
    if baselines is not None:
        tables[BASELINES] = baselines
    return _commit(spark, folder, tables, seen)


def has_table(spark: SparkSession, folder: str, name: str, as_of: int | None = None) -> bool:
    return any(name in (r["schemas"] or {}) for r in _commits(spark, folder, as_of))


def read_table(spark: SparkSession, folder: str, name: str, as_of: int | None = None) -> DataFrame:
    """All rows of complete batches, expired where a later expiry says so.

    Expired runs carry the rerun number that follows them.
    """
    own = _having(spark, folder, name, as_of)
    if not own:
        raise LookupError(f"no committed rows of {name}")
    rows = _read_batches(spark, folder, name, own)
    columns = [x for x in rows.columns if x not in ("seq", "next_rerun_number")]
    if "next_rerun_number" not in rows.columns:
        rows = rows.withColumn("next_rerun_number", F.lit(None).cast("int"))
    ended = _visible(spark, folder, EXPIRIES, as_of)
    if ended is not None:
        # as many tasks as the files need, so that memory of one does not grow with the store
        tasks = tasks_for(spark, (f"{folder}/{name}/batch_id={r['batch_id']}" for r in own))
        rows, ended = spread(rows, tasks, "run_id"), spread(ended, tasks, "run_id")
        per_run = ended.groupBy("run_id").agg(F.sort_array(F.collect_list(
            F.struct("expired_at", F.col("seq").alias("at_seq"), F.col("next_rerun_number").alias("next"))
        )).alias("_ended"))
        later = F.get(F.filter("_ended", lambda e: e["at_seq"] > F.col("seq")), F.lit(0))
        hit = (F.col("expiry_date") == sentinel()) & later.isNotNull()
        rows = rows.join(per_run, "run_id", "left").withColumns({
            "expiry_date": F.when(hit, later["expired_at"]).otherwise(F.col("expiry_date")),
            "next_rerun_number": F.when(hit, later["next"]).otherwise(F.col("next_rerun_number")),
        })
    return rows.select(*columns, *(["next_rerun_number"] if name == RUNS else []))


def read_baselines(spark: SparkSession, folder: str, as_of: int | None = None) -> DataFrame | None:
    """The kept state after the newest commit that has one; a state is written whole."""
    own = [r for r in _commits(spark, folder, as_of) if BASELINES in (r["schemas"] or {})]
    return _read_batches(spark, folder, BASELINES, own[-1:]).drop("seq") if own else None


def _ended(spark: SparkSession, folder: str, targets: DataFrame, at, as_of: int | None = None) -> DataFrame:
    """The active runs of the targets with their end."""
    return active(read_table(spark, folder, RUNS, as_of)).join(
        targets.select(*c.KEYS).distinct(), list(c.KEYS), "left_semi"
    ).select(
        F.col("run_id").cast("bigint").alias("run_id"), ntz(as_column(at)).alias("expired_at"),
        (F.col("rerun_number") + 1).cast("int").alias("next_rerun_number"),
    ).distinct()


def apply_expiry(spark: SparkSession, folder: str, targets: DataFrame, at) -> None:
    """Expire the active runs of the targets, and with them their metrics."""
    seen = last_commit(spark, folder)
    _commit(spark, folder, {EXPIRIES: _ended(spark, folder, targets, at, seen)}, seen)


def compact(spark: SparkSession, folder: str) -> int:
    """Write all visible rows as one batch, which readers then start from.

    Commits of other writers meanwhile stay visible.  Files of older batches stay in place for
    readers that began before, and for reads as of an earlier commit.
    """
    seen = last_commit(spark, folder)
    tables = {name: read_table(spark, folder, name, seen) for name in (NUMERICS, DETAILS, SKETCHES, RUNS) if has_table(spark, folder, name, seen)}
    states = _visible(spark, folder, ORCHESTRATIONS, seen)
    if states is not None:
        newest = Window.partitionBy("orchestration_run_id").orderBy(F.desc("seq"))
        tables[ORCHESTRATIONS] = states.withColumn("_nth", F.row_number().over(newest)).filter("_nth = 1").drop("_nth", "seq")
    kept = read_baselines(spark, folder, seen)
    if kept is not None:
        tables[BASELINES] = kept
    return _commit(spark, folder, tables, seen, covers=seen)
