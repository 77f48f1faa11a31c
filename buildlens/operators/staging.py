"""Moving inputs and outputs: what is missing, requested, received and referenced."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from buildlens.functions.scalars import is_store_path
from buildlens.operators.running import as_of, running_sums


def split_inputs(offers: DataFrame, valid: DataFrame) -> DataFrame:
    """JOIN-3: ``offers(job_id, path_id, submitted_at)`` with ``state``: valid, missing for the
    one build that claims the path (first submitted, then least id), deferred for the others."""
    known = valid.select("path_id").distinct().withColumn("known", F.lit(True))
    claim = offers.groupBy("path_id").agg(F.min(F.struct("submitted_at", "job_id"))["job_id"].alias("claimer"))
    return (
        offers.join(known, "path_id", "left")
        .join(claim, "path_id")
        .select(
            "job_id",
            "path_id",
            F.when(F.col("known"), "valid").when(F.col("job_id") == F.col("claimer"), "missing").otherwise("deferred").alias("state"),
        )
    )


def dealt(df: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """``df`` in so many partitions by ``keys``; without ``parts`` Spark places it as the session says."""
    return df if parts is None else df.repartition(parts, *keys)


def check_requested(offers: DataFrame, requested: DataFrame, parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """JOIN-4: ``requested(job_id, pos, path_id)`` to the accepted paths, each at its first
    position, and the jobs that are rejected for a path that wasn't offered."""
    bad = requested.join(offers.select("job_id", "path_id"), ["job_id", "path_id"], "left_anti").select("job_id").distinct()
    good = requested.join(dealt(bad, parts, "job_id"), "job_id", "left_anti").groupBy("job_id", "path_id").agg(F.min("pos").alias("pos"))
    return good, bad


def reconcile_outputs(requested: DataFrame, reported: DataFrame) -> DataFrame:
    """JOIN-5: both sides ``(job_id, path_id)``; ``state`` is ok, missing or unrequested."""
    a = requested.select("job_id", "path_id").distinct().withColumn("asked", F.lit(True))
    b = reported.select("job_id", "path_id").distinct().withColumn("told", F.lit(True))
    return a.join(b, ["job_id", "path_id"], "full_outer").select(
        "job_id",
        "path_id",
        F.when(F.col("asked") & F.col("told"), "ok").when(F.col("asked"), "missing").otherwise("unrequested").alias("state"),
    )


def unexpected_chunks(chunks: DataFrame, requested: DataFrame) -> DataFrame:
    """JOIN-5: chunks for a path outside the requested set."""
    return chunks.join(requested.select("job_id", "path_id"), ["job_id", "path_id"], "left_anti")


def _seconds(ts: str, kind: str) -> Column:
    """A time as whole seconds that keep its order, also for times without a zone in sessions with summer time."""
    if kind == "timestamp":
        return F.unix_seconds(ts)
    return F.date_diff(ts, F.lit("1970-01-01")).cast("bigint") * 86_400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def path_conflicts(jobs: DataFrame, parts: int | None = None) -> DataFrame:
    """JOIN-8: ``jobs(job_id, key, output, started_at, finished_at)``: pairs of different keys
    that hold one output path at the same time, the earlier id first. Without a start or an end
    a job holds nothing.

    Jobs meet by output and slice of time, in the first slice that both touch. A slice is as
    long as the mean job, so there are at most three entries per job on average, and a popular
    path is split over its slices, of which there are ``parts`` partitions if given.
    """
    kind = jobs.schema["started_at"].dataType.typeName()
    start, end = _seconds("started_at", kind), _seconds("finished_at", kind)
    timed = jobs.where("started_at is not null and finished_at is not null")
    timed = timed.select("job_id", "key", "output", "started_at", "finished_at", F.least(start, end).alias("from"), F.greatest(start, end).alias("to"))
    width = timed.agg(F.greatest(F.lit(1), F.ceil(F.avg(F.col("to") - F.col("from"))).cast("bigint")).alias("width")).first()["width"]
    cut = timed.withColumn("first", F.floor(F.col("from") / width)).withColumn("last", F.floor(F.col("to") / width))
    cut = dealt(cut.drop("from", "to").withColumn("slice", F.explode(F.sequence("first", "last"))), parts, "output", "slice")
    a, b = cut.alias("a"), cut.alias("b")
    return a.join(
        b,
        (F.col("a.output") == F.col("b.output"))
        & (F.col("a.slice") == F.col("b.slice"))
        & (F.col("a.slice") == F.greatest("a.first", "b.first"))
        & (F.col("a.key") != F.col("b.key"))
        & (F.col("a.job_id") < F.col("b.job_id"))
        & (F.col("a.started_at") < F.col("b.finished_at"))
        & (F.col("b.started_at") < F.col("a.finished_at")),
    ).select(F.col("a.output").alias("output"), F.col("a.job_id").alias("job_a"), F.col("b.job_id").alias("job_b"))


def route(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """JOIN-9: ``messages(seq, build_id, ts)`` with ``routed``: whether the build was
    registered then, by ``sessions(build_id, opened_at, closed_at)``, both ends included."""
    held = as_of(messages, sessions, ["build_id"], "ts", "opened_at", "closed_at")
    return held.select(*messages.columns, F.coalesce(F.col("best") >= F.col("ts"), F.lit(False)).alias("routed"))


def verify_digests(contents: DataFrame, announced: DataFrame) -> DataFrame:
    """JOIN-11: ``contents(path_id, content)`` against ``announced(path_id, sha256 hex)``. Content that is
    not there is not right; for paths of any size see ``check_archives``."""
    return contents.select("path_id", F.sha2(F.col("content"), 256).alias("digest")).join(announced, "path_id").select(
        "path_id", "digest", F.coalesce(F.col("digest") == F.col("sha256"), F.lit(False)).alias("ok")
    )


def scan_references(contents: DataFrame, candidates: DataFrame, size: int = 32) -> DataFrame:
    """JOIN-13: ``contents(content_id, content)`` and ``candidates(item_id, token)``: which
    tokens of ``size`` characters stand in a content, that of its own id left out.

    Hash parts are runs of base-32 characters, so contents are cut into the windows of runs
    that are long enough, and meet the candidates in an equi-join.
    """
    runs = F.regexp_extract_all("content", F.lit(rf"[0-9a-df-np-sv-z]{{{size},}}"), F.lit(0))
    windows = contents.select("content_id", F.explode(runs).alias("run")).select(
        "content_id", F.explode(F.transform(F.sequence(F.lit(1), F.length("run") - size + 1), lambda i: F.substring("run", i, F.lit(size)))).alias("token")
    )
    return (
        windows.distinct().join(candidates, "token").where(F.col("content_id") != F.col("item_id")).select("content_id", "item_id").distinct()
    )


#: Bytes of tokens up to which every task gets them all.
TOKEN_BYTES = 32 << 20


def scan_texts(contents: DataFrame, candidates: DataFrame, most: int = TOKEN_BYTES) -> DataFrame:
    """JOIN-13 for tokens of any characters that stand at the start of a text or after white
    space. One linear scan takes the text from each such place up to the longest token's length;
    cut to the lengths that tokens have, it meets them in an equi-join. Tokens of up to TOKEN_BYTES
    in all go to the texts, so that only what is found is shuffled; more meet the distinct windows. Null and empty
    tokens stand nowhere. The driver gets the distinct lengths, which the longest token bounds."""
    told = candidates.where("token <> ''").select("item_id", "token")
    size = told.agg(F.collect_set(F.length("token")).alias("n"), F.coalesce(F.sum(F.octet_length("token")), F.lit(0)).alias("bytes")).first()
    lengths = sorted(size["n"])
    longest = lengths[-1] if lengths else 1
    places = F.array_distinct(F.regexp_extract_all("content", F.lit(rf"(?:\A|(?<=\s))(?=([\s\S]{{1,{longest}}}))"), F.lit(1)))
    starts = contents.select("content_id", F.explode(places).alias("start"))
    fit = F.filter(F.lit(lengths).cast("array<int>"), lambda n: n <= F.length("start"))
    windows = starts.select("content_id", F.explode(F.transform(fit, lambda n: F.substring("start", F.lit(1), n))).alias("token"))
    met = windows.join(F.broadcast(told), "token") if size["bytes"] <= most else windows.distinct().join(told, "token")
    return met.select("content_id", "item_id").distinct()


def size_state(received: Column, nar_size: Column, complete: Column) -> Column:
    """JOIN-15: excess is always an error, a complete content must have the whole size, and one
    of unknown size is no good."""
    return (
        F.when(received.isNull() | nar_size.isNull(), "unknown").when(received > nar_size, "excess").when(complete & (received < nar_size), "short").otherwise("ok")
    )


def check_sizes(contents: DataFrame, path_infos: DataFrame) -> DataFrame:
    """JOIN-15: ``contents(path_id, content, complete)``, and ``bytes`` if the content itself may be
    null, against ``nar_size``."""
    n = F.octet_length("content")
    n = F.coalesce(n, F.col("bytes")) if "bytes" in contents.columns else n
    sized = contents.select("path_id", n.cast("bigint").alias("received"), "complete").join(path_infos, "path_id")
    return sized.select("path_id", "received", "nar_size", size_state(F.col("received"), F.col("nar_size"), F.col("complete")).alias("state"))


def orphans(builds: DataFrame, states: DataFrame) -> DataFrame:
    """JOIN-16: builds without a persisted state, and states that name no build."""
    a = builds.select("build_id").distinct()
    b = states.select("build_id").distinct()
    return (
        a.join(b, "build_id", "left_anti").withColumn("side", F.lit("no state")).unionByName(b.join(a, "build_id", "left_anti").withColumn("side", F.lit("no build")))
    )


def staging_totals(split: DataFrame, path_infos: DataFrame) -> DataFrame:
    """AGG-7: offered and missing paths and bytes to move, per build."""
    missing = F.col("state") == "missing"
    return split.join(path_infos, "path_id", "left").groupBy("job_id").agg(
        F.count("*").alias("offered"),
        F.count_if(missing).alias("missing"),
        F.coalesce(F.sum(F.when(missing, F.col("nar_size"))), F.lit(0)).alias("bytes_to_move"),
    )


#: Bytes up to which the content of a path is put together in one row.
CONTENT_BYTES = 64 << 20


def placed_chunks(chunks: DataFrame) -> DataFrame:
    """AGG-8: (path_id, seq, size, eof, start) of the chunks of ``chunks(path_id, seq, chunk, eof)`` up to
    their path's first eof, with the ``start`` of each in the content. Payloads are not moved,
    and a path of any number of chunks is summed in many tasks."""
    sizes = chunks.select("path_id", "seq", F.coalesce(F.octet_length("chunk"), F.lit(0)).cast("bigint").alias("size"), F.coalesce("eof", F.lit(False)).alias("eof"))
    run = running_sums(sizes, "path_id", "seq", {"upto": F.col("size"), "eofs": F.col("eof").cast("int")})
    return run.where(F.col("eofs") - F.col("eof").cast("int") == 0).select("path_id", "seq", "size", "eof", (F.col("upto") - F.col("size")).alias("start"))


def reassemble(chunks: DataFrame, most: int = CONTENT_BYTES) -> DataFrame:
    """AGG-8: number and bytes of each path's chunks up to its first eof, and their content in
    order, null beyond ``most`` bytes; without an eof the content is incomplete. Larger ones are
    checked chunk by chunk (``stream_digests``, ``scan_chunks``)."""
    sizes = placed_chunks(chunks).groupBy("path_id").agg(F.count("*").alias("chunks"), F.sum("size").alias("bytes"), F.bool_or("eof").alias("complete"), F.max("seq").alias("_last"))
    small = chunks.join(sizes.where(F.col("bytes") <= most).select("path_id", "_last"), "path_id").where(F.col("seq") <= F.col("_last"))
    texts = small.groupBy("path_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "chunk"))), lambda c: c["chunk"]), "").alias("content"))
    return sizes.join(texts, "path_id", "left").select("path_id", "content", "chunks", "bytes", "complete")


def _digests(batches):
    """Rows in the order of (path_id, seq) to a row per path: a SHA-256 state and a count go from batch to batch."""
    at, state, n, size, ended = None, None, 0, 0, False

    def row():
        return pa.record_batch(
            [path, pa.array([n], pa.int64()), pa.array([size], pa.int64()), pa.array([ended]), pa.array([state.hexdigest()])], names=["path_id", "chunks", "bytes", "complete", "sha256"]
        )

    path = None
    for b in batches:
        ids = b.column("path_id")
        for k, (own, chunk, eof) in enumerate(zip(ids.to_pylist(), b.column("chunk"), b.column("eof").to_pylist(), strict=True)):
            if state is None or own != at:
                if state is not None:
                    yield row()
                at, path, state, n, size, ended = own, ids.slice(k, 1), hashlib.sha256(), 0, 0, False
            if ended:
                continue
            n, ended = n + 1, bool(eof)
            if chunk.is_valid:
                data = chunk.as_buffer()
                state.update(data)
                size += len(data)
    if state is not None:
        yield row()


def stream_digests(chunks: DataFrame) -> DataFrame:
    """AGG-8, JOIN-11: (path_id, chunks, bytes, complete, sha256) of each path's chunks up to its
    first eof, whatever their bytes. Chunks are dealt out and sorted by path; one pass carries the digest
    from row to row, so that no row and no task ever holds a content. Null chunks have no bytes."""
    held = chunks.select("path_id", "seq", F.col("chunk").cast("binary").alias("chunk"), "eof")
    kind = chunks.schema["path_id"].dataType.simpleString()
    # one task per path: a digest has to take its bytes in order
    return held.repartition("path_id").sortWithinPartitions("path_id", "seq").mapInArrow(_digests, f"path_id {kind}, chunks bigint, bytes bigint, complete boolean, sha256 string")


def check_archives(chunks: DataFrame, path_infos: DataFrame) -> DataFrame:
    """JOIN-11 and JOIN-15 over chunks: ``path_infos(path_id, nar_size, nar_sha256 hex)`` against what
    has come. A path without any chunk has received nothing and is no good."""
    got = path_infos.join(stream_digests(chunks), "path_id", "left")
    received, complete = F.coalesce("bytes", F.lit(0).cast("bigint")), F.coalesce("complete", F.lit(False))
    state = F.when(F.col("bytes").isNull(), "missing").otherwise(size_state(received, F.col("nar_size"), complete))
    return got.select("path_id", received.alias("received"), "nar_size", state.alias("state"), (F.coalesce(F.col("sha256") == F.col("nar_sha256"), F.lit(False)) & complete).alias("verified"))


def scan_chunks(chunks: DataFrame, candidates: DataFrame, size: int = 32) -> DataFrame:
    """JOIN-13 over chunks: as ``scan_references`` of each path's content up to its first eof, whose id is
    ``path_id``. A chunk is scanned where it lies; for what stands across borders, the end of
    what came before and the start of the chunk are put together, ``size - 1`` characters each.
    Only those short rows are sorted by path. Bytes count as characters of one byte each."""
    text = F.col("chunk") if chunks.schema["chunk"].dataType.simpleString() == "string" else F.decode("chunk", "ISO-8859-1")
    held = chunks.select(F.col("path_id").alias("content_id"), "seq", text.alias("content"), F.coalesce("eof", F.lit(False)).alias("eof"))
    ends = held.groupBy("content_id").agg(F.min(F.when(F.col("eof"), F.col("seq"))).alias("ended"), F.max("seq").alias("last")).where("last > ended")
    held = held.join(ends.select("content_id", "ended"), "content_id", "left").where("ended is null or seq <= ended")
    edge = size - 1
    short = held.select("content_id", "seq", F.substring("content", 1, edge).alias("head"), F.right("content", F.lit(edge)).alias("tail")).where("head <> ''")
    # every chunk here has a character at least, so that so many chunks before are enough
    before = W.partitionBy("content_id").orderBy("seq").rowsBetween(-edge, -1)
    carried = F.right(F.array_join(F.collect_list("tail").over(before), ""), F.lit(edge))
    borders = short.select("content_id", F.concat(carried, F.col("head")).alias("content"))
    return scan_references(held.select("content_id", "content").unionByName(borders), candidates, size)


def unscanned(contents: DataFrame) -> DataFrame:
    """JOIN-13: ids of ``contents(content_id, content)`` that ``scan_references`` can't say anything about."""
    return contents.where("content is null").select("content_id")


def scan_candidates(inputs: DataFrame, outputs: DataFrame, valid: DataFrame | None = None) -> DataFrame:
    """SET-2: distinct paths to scan for; with ``valid`` also all valid ones; unparsable ones go."""
    every = inputs.select("path").unionByName(outputs.select("path"))
    if valid is not None:
        every = every.unionByName(valid.select("path"))
    return every.where(is_store_path(F.col("path"))).distinct()


def extras_seed(references: DataFrame, inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """SET-3: referenced paths that are neither inputs nor outputs themselves."""
    return references.select("path_id").distinct().join(inputs.select("path_id"), "path_id", "left_anti").join(
        outputs.select("path_id"), "path_id", "left_anti"
    )


def snapshot_race(offer: DataFrame, database: DataFrame, live: DataFrame) -> DataFrame:
    """SET-4: paths to pin. Those of the offer that the database calls valid need no pin unless
    the live view calls one of them invalid: then the snapshot raced and all are pinned."""
    in_database = offer.join(database.select("path_id"), "path_id", "left_semi")
    raced = in_database.join(live.select("path_id"), "path_id", "left_anti").agg((F.count("*") > 0).alias("raced"))
    unknown = offer.join(database.select("path_id").withColumn("known", F.lit(True)).distinct(), "path_id", "left")
    return unknown.withColumn("raced", raced.scalar()).select(
        "path_id", F.coalesce("known", F.lit(False)).alias("known"), "raced", (F.col("raced") | F.col("known").isNull()).alias("pinned")
    )


def audit_protocol(messages: DataFrame) -> DataFrame:
    """WIN-4: ``messages(build_id, seq, kind, path_id, requested)`` with a column for each broken rule.

    Kinds: metadata, chunk, path_end, closed, result, output. ``requested`` is false for a
    path that the build did not ask for.
    """
    w = W.partitionBy("build_id").orderBy("seq")
    upto = w.rowsBetween(W.unboundedPreceding, -1)
    by_path = W.partitionBy("build_id", "path_id").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    kind = F.col("kind")
    n = lambda k, over: F.coalesce(F.count_if(kind == k).over(over), F.lit(0))
    open_path = F.last(F.when(kind == "metadata", F.col("path_id")), ignorenulls=True).over(upto)
    pending = n("metadata", upto) - n("path_end", upto)
    return messages.select(
        "*",
        ((kind == "chunk") & (n("metadata", by_path) == 0)).alias("chunk_before_metadata"),
        ((kind == "chunk") & open_path.isNotNull() & (open_path != F.col("path_id"))).alias("interleaved"),
        (kind.isin("metadata", "chunk") & ~F.col("requested")).alias("unrequested"),
        ((kind == "result") & (n("result", upto) > 0)).alias("duplicate_result"),
        ((kind == "output") & (n("result", upto) == 0)).alias("output_before_result"),
        ((kind == "closed") & (pending > 0)).alias("closed_pending"),
    )
