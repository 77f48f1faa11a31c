"""The registered queries over the driver's tables, and the SQL each must equal."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from buildlens.functions import scalars as fn
from buildlens.functions.network import address_key, canonical_key
from buildlens.operators import events as ev
from buildlens.operators import graph, identity, matching, metrics, policy, staging, validate
from buildlens.plans.views import VIEWS, parts, view, with_views
from buildlens.sources import logtail, readers, sinks
from buildlens.sources.schemas import WORKER_PAYLOADS
from buildlens.sources.shared import fresh_path
from buildlens.streaming import gauges, streams, timed, twins, upserts

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that must give the same rows."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = with_views(sql)
        return f

    return put


# ------------------------------------------------------------------ policy

RULES = [
    (0, "allow", "tcp", "192.0.2.0/24", ["443", "8000-8999"]),
    (1, "deny", "any", "192.0.2.7", []),
    (2, "deny", "any", "private", []),
    (3, "allow", "udp", "any", ["0-1023"]),
    (4, "allow", "tcp", "93.184.216.0/25", []),
]
_N = "cast(split_part(ip, '.', 1) AS bigint) * 16777216 + cast(split_part(ip, '.', 2) AS bigint) * 65536 + cast(split_part(ip, '.', 3) AS bigint) * 256 + cast(split_part(ip, '.', 4) AS bigint)"
_PRIVATE = "(n BETWEEN 167772160 AND 184549375 OR n BETWEEN 1681915904 AND 1686110207 OR n BETWEEN 2130706432 AND 2147483647 OR n BETWEEN 2851995648 AND 2852061183 OR n BETWEEN 2886729728 AND 2887778303 OR n BETWEEN 3232235520 AND 3232301055 OR n BETWEEN 3758096384 AND 4026531839 OR n IN (0, 4294967295))"
_DECIDED = f"""WITH numbered AS (SELECT *, {_N} AS n FROM flows),
decided AS (SELECT flow_id, proto, ip, port, CASE
  WHEN proto = 6 AND n BETWEEN 3221225984 AND 3221226239 AND (port = 443 OR port BETWEEN 8000 AND 8999) THEN 0
  WHEN n = 3221225991 THEN 1 WHEN {_PRIVATE} THEN 2 WHEN proto = 17 AND port <= 1023 THEN 3
  WHEN proto = 6 AND n BETWEEN 1572395008 AND 1572395135 THEN 4 END AS rule_idx FROM numbered)"""


def decided(spark: SparkSession, d: str) -> DataFrame:
    raw = spark.createDataFrame(RULES, "rule_idx int, action string, proto string, dst string, ports array<string>")
    rules, _ = policy.compile_policy(raw)
    return policy.decide_flows(view(spark, d, "flows"), rules, "deny")


@query(_DECIDED + " SELECT flow_id, rule_idx, CASE WHEN rule_idx IN (0, 3, 4) THEN 'allow' ELSE 'deny' END AS action FROM decided")
def policy_decide(spark, d):
    return decided(spark, d).select("flow_id", "rule_idx", "action")


@query(_DECIDED + " SELECT rule_idx, CASE WHEN rule_idx IN (0, 3, 4) THEN 'allow' ELSE 'deny' END AS action, count(*) AS n FROM decided GROUP BY ALL")
def policy_hits(spark, d):
    return decided(spark, d).groupBy("rule_idx", "action").agg(F.count("*").alias("n"))


@query(f"WITH numbered AS (SELECT flow_id, ip, {_N} AS n FROM flows) SELECT flow_id, ip, {_PRIVATE} AS private FROM numbered")
def ip_scope(spark, d):
    return policy.ip_scope(view(spark, d, "flows")).select("flow_id", "ip", "private")


# ---------------------------------------------------------------- matching


def jobs(spark: SparkSession, d: str) -> DataFrame:
    features = view(spark, d, "job_features").groupBy("job_id").agg(F.collect_list("feature").alias("features"))
    return view(spark, d, "jobs").join(features, "job_id", "left").withColumn("features", F.coalesce("features", F.array().cast("array<string>")))


def caps(spark: SparkSession, d: str) -> DataFrame:
    have = view(spark, d, "worker_features").groupBy("worker_id", "system").agg(F.collect_list("feature").alias("have"))
    return (
        view(spark, d, "worker_systems")
        .join(have, ["worker_id", "system"], "left")
        .select(F.col("worker_id").alias("worker"), "system", F.coalesce("have", F.array().cast("array<string>")).alias("have"))
    )


def registrations(spark: SparkSession, d: str) -> DataFrame:
    systems = view(spark, d, "worker_systems").groupBy("worker_id").agg(F.collect_list("system").alias("systems"))
    return view(spark, d, "workers").join(systems, "worker_id").withColumn("session", F.col("worker_id"))


_FIT = """ws.system = j.system AND NOT EXISTS (SELECT 1 FROM job_features f WHERE f.job_id = j.job_id AND NOT EXISTS
  (SELECT 1 FROM worker_features wf WHERE wf.worker_id = ws.worker_id AND wf.system = ws.system AND wf.feature = f.feature))"""


@query(f"SELECT j.job_id, count(ws.worker_id) AS n_workers, min(ws.worker_id) AS first_worker FROM jobs j LEFT JOIN worker_systems ws ON {_FIT} GROUP BY j.job_id")
def cap_match(spark, d):
    return matching.count_matches(jobs(spark, d), caps(spark, d))


_NOW, _YEAR = "1995-06-17 00:00:00", 365 * 86400


@query(f"""SELECT j.job_id, j.system FROM jobs j WHERE NOT (j.phase = 'P' AND j.submitted_at + INTERVAL 365 DAYS > TIMESTAMP '{_NOW}')
  AND NOT EXISTS (SELECT 1 FROM worker_systems ws WHERE {_FIT})""")
def cap_unservable(spark, d):
    queued = jobs(spark, d).withColumn("requeued_at", F.when(F.col("phase") == "P", F.col("submitted_at")))
    return matching.unservable(queued, caps(spark, d), F.lit(_NOW), _YEAR).select("job_id", "system")


@query("""SELECT array_to_string(list_sort(list(DISTINCT system)), ',') AS systems,
  (SELECT CASE WHEN sum(max_jobs) > 0 THEN cast(greatest(1, least(256, floor(sum(max_jobs) * 200 / 100))) AS bigint) END FROM workers) AS max_jobs FROM worker_systems""")
def fleet_capacity(spark, d):
    return metrics.fleet_capacity(registrations(spark, d)).withColumn("systems", F.array_join("systems", ","))


@query("SELECT system, count(DISTINCT worker_id) AS workers FROM worker_systems GROUP BY system")
def workers_per_system(spark, d):
    return metrics.workers_per_system(registrations(spark, d))


@query("SELECT DISTINCT worker_name, system FROM workers JOIN worker_systems USING (worker_id)")
def builder_up(spark, d):
    return metrics.builder_up(registrations(spark, d))


@query("SELECT DISTINCT system FROM worker_systems")
def all_systems(spark, d):
    return metrics.all_systems(registrations(spark, d))


@query(f"""WITH hits AS (SELECT ws.worker_id AS worker, j.job_id, j.submitted_at AS position, row_number() OVER (PARTITION BY ws.worker_id ORDER BY j.submitted_at, j.job_id) AS n
  FROM jobs j JOIN worker_systems ws ON {_FIT}) SELECT worker, job_id, position FROM hits WHERE n = 1""")
def first_eligible(spark, d):
    return matching.first_eligible(jobs(spark, d).withColumn("position", F.col("submitted_at")), caps(spark, d))


@query("SELECT worker_id, s_nationkey % 5 <> 0 AS trusted FROM supplier JOIN workers ON worker_id = s_suppkey")
def check_signers(spark, d):
    regs = view(spark, d, "SELECT s_suppkey AS worker_id, 'key-' || cast(s_nationkey AS string) AS signing_public_key FROM supplier")
    keys = view(spark, d, "SELECT 'key-' || cast(n_nationkey AS string) AS key FROM nation WHERE n_nationkey % 5 <> 0")
    return matching.check_signers(regs, keys).select("worker_id", "trusted")


@query("SELECT s_suppkey AS peer, lower(replace(s_name, '#', '-')) AS name FROM supplier WHERE s_suppkey % 3 = 0 OR s_suppkey % 7 = 0")
def admit_peers(spark, d):
    peers = view(spark, d, "SELECT s_suppkey AS peer, lower(replace(s_name, '#', '-')) || '.tail.example' AS node_name, s_suppkey % 3 = 0 AS a, s_suppkey % 7 = 0 AS b FROM supplier")
    tags = F.array_compact(F.array(F.when(F.col("a"), "tag:worker"), F.when(F.col("b"), "tag:builder"), F.lit("tag:any")))
    return validate.admit_peers(peers.withColumn("tags", tags), ["tag:worker", "tag:builder"]).select("peer", "name")


@query("""WITH q AS (SELECT o_custkey % 100 + 1 AS session, o_custkey AS key, o_orderkey AS job_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders)
  SELECT session, key, job_id FROM q WHERE n = 1""")
def resume_matches(spark, d):
    queue = view(spark, d, "SELECT o_orderkey AS job_id, o_custkey AS key, o_orderdate AS position FROM orders")
    regs = queue.select((F.col("key") % 100 + 1).alias("session"), "key").groupBy("session").agg(F.collect_set("key").alias("resumable_keys"))
    return matching.resume_matches(queue, regs)


@query("""SELECT worker_id AS worker, system, 'native' AS features FROM worker_systems
  UNION ALL SELECT worker_id, 'riscv64-linux', 'base' FROM workers WHERE worker_id % 3 = 0
  UNION ALL SELECT worker_id, 'aarch64-linux', 'base' FROM workers WHERE worker_id % 2 = 1 AND worker_id % 3 = 0""")
def effective_caps(spark, d):
    own = registrations(spark, d).select(F.col("worker_id").alias("worker"), "systems", F.array(F.lit("native")).alias("features"))
    emulated = own.where("worker % 3 = 0").select("worker", F.explode(F.array(F.lit("riscv64-linux"), F.lit("aarch64-linux"))).alias("system"))
    return matching.effective_caps(own, emulated, ("base",)).withColumn("features", F.array_join("features", ","))


_START = "1992-03-01 00:00:00"


@query(f"""WITH gone AS (SELECT ws.worker_id, ws.system, TIMESTAMP '{_START}' + to_days(cast(ws.worker_id * 20 AS int)) AS departed_at FROM worker_systems ws),
  last AS (SELECT j.job_id, max(ws.departed_at) AS departed_at FROM jobs j JOIN gone ws ON {_FIT}
    AND ws.departed_at <= j.submitted_at AND j.submitted_at < ws.departed_at + INTERVAL 10 DAYS GROUP BY j.job_id)
  SELECT j.job_id, CASE WHEN j.submitted_at < TIMESTAMP '{_START}' + INTERVAL 10 DAYS THEN TIMESTAMP '{_START}' + INTERVAL 10 DAYS ELSE l.departed_at + INTERVAL 10 DAYS END AS deadline
  FROM jobs j LEFT JOIN last l ON j.job_id = l.job_id""")
def expected_deadline(spark, d):
    start = F.lit(_START).cast("timestamp_ntz")
    gone = caps(spark, d).withColumn("departed_at", start + F.make_interval(days=(F.col("worker") * 20).cast("int")))
    return matching.expected_deadline(jobs(spark, d), gone, start, 10 * 86400)


# ----------------------------------------------------------------- staging

#: The deal of ``lineitem`` (``views.view``) for joins by job and path, and the columns of these.
_PAIRS, _PAIR = "l_orderkey, l_partkey", ("job_id", "path_id")


def _claims(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "claims").repartition(parts(spark, d), "path_id")


@query("""WITH first AS (SELECT *, row_number() OVER (PARTITION BY path_id ORDER BY submitted_at, job_id) AS n FROM claims)
  SELECT f.job_id, f.path_id, CASE WHEN v.path_id IS NOT NULL THEN 'valid' WHEN n = 1 THEN 'missing' ELSE 'deferred' END AS state FROM first f LEFT JOIN valid_now v ON f.path_id = v.path_id""")
def missing_split(spark, d):
    return staging.split_inputs(_claims(spark, d), view(spark, d, "valid_now"))


@query("""WITH first AS (SELECT *, row_number() OVER (PARTITION BY path_id ORDER BY submitted_at, job_id) AS n FROM claims),
  state AS (SELECT f.job_id, f.path_id, v.path_id IS NULL AND n = 1 AS missing FROM first f LEFT JOIN valid_now v ON f.path_id = v.path_id)
  SELECT s.job_id, count(*) AS offered, count_if(missing) AS missing, cast(coalesce(sum(CASE WHEN missing THEN nar_size END), 0) AS bigint) AS bytes_to_move
  FROM state s LEFT JOIN store_paths p ON s.path_id = p.path_id GROUP BY s.job_id""")
def staging_totals(spark, d):
    split = staging.split_inputs(_claims(spark, d), view(spark, d, "valid_now"))
    return staging.staging_totals(split, view(spark, d, "store_paths").select("path_id", "nar_size"))


@query("""WITH bad AS (SELECT DISTINCT r.job_id FROM requested r WHERE NOT EXISTS (SELECT 1 FROM offers o WHERE o.job_id = r.job_id AND o.path_id = r.path_id))
  SELECT job_id, path_id, min(pos) AS pos FROM requested WHERE job_id NOT IN (SELECT job_id FROM bad) GROUP BY job_id, path_id""")
def check_requested(spark, d):
    n = parts(spark, d)
    return staging.check_requested(view(spark, d, "offers", _PAIRS), view(spark, d, "requested").repartition(n, *_PAIR), n)[0]


@query("""SELECT coalesce(a.job_id, b.job_id) AS job_id, coalesce(a.path_id, b.path_id) AS path_id,
  CASE WHEN b.job_id IS NULL THEN 'missing' WHEN a.job_id IS NULL THEN 'unrequested' ELSE 'ok' END AS state FROM offers a FULL JOIN reported b ON a.job_id = b.job_id AND a.path_id = b.path_id""")
def reconcile_outputs(spark, d):
    return staging.reconcile_outputs(view(spark, d, "offers", _PAIRS), view(spark, d, "reported", _PAIRS).repartition(parts(spark, d), *_PAIR))


@query("SELECT path_id, min(phase) AS phase FROM phased GROUP BY path_id")
def first_phase(spark, d):
    return graph.first_phase(view(spark, d, "phased"))


@query("""WITH p AS (SELECT path_id, min(phase) AS phase FROM phased GROUP BY path_id)
  SELECT referrer, reference, a.phase AS referrer_phase, b.phase AS reference_phase FROM refs JOIN p a ON a.path_id = referrer LEFT JOIN p b ON b.path_id = reference
  WHERE referrer <> reference AND (b.phase IS NULL OR b.phase > a.phase)""")
def audit_staging(spark, d):
    return graph.audit_staging(view(spark, d, "phased"), view(spark, d, "refs"))


@query("""WITH x AS (SELECT l_orderkey AS id, l_partkey % 5 AS item, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey % 5) - 1 AS pos FROM lineitem)
  SELECT id, item, cast(pos AS int) AS pos, row_number() OVER (PARTITION BY id, item ORDER BY pos) > 1 AS duplicate FROM x""")
def first_occurrence(spark, d):
    lists = view(spark, d, "SELECT l_orderkey AS id, array_sort(collect_list(struct(l_linenumber, l_partkey % 5 AS item))) AS x FROM lineitem GROUP BY l_orderkey")
    return identity.first_occurrence(lists.select("id", F.col("x.item").alias("items"))).select("id", "item", "pos", "duplicate")


# ---------------------------------------------------------------- identity


def _le(n: str) -> str:
    h = f"printf('%016x', {n})"
    return "unhex(" + " || ".join(f"substr({h}, {15 - 2 * i}, 2)" for i in range(8)) + ")"


def _feed(text: str) -> str:
    return f"{_le(f'strlen({text})')} || encode({text})"


_KEY = f"""sha256({_feed('lang')} || {_feed('source')} || {_le('1')} || {_feed('text')} || {_le('0')} || {_le('0')} || {_le('0')}
  || {_feed("'/nix/store'")} || {_feed("'/build'")} || unhex('00'))"""


def requests(spark: SparkSession, d: str) -> DataFrame:
    none = F.create_map().cast("map<string,string>")
    return view(spark, d, "SELECT doc_id AS job_id, lang AS system, source AS builder, text FROM documents").select(
        "job_id",
        F.col("job_id").alias("submitted_at"),
        "system",
        "builder",
        F.array("text").alias("args"),
        none.alias("env"),
        none.alias("outputs"),
        F.array().cast("array<string>").alias("input_paths"),
        F.lit("/nix/store").alias("store_dir"),
        F.lit("/build").alias("tmp_dir_in_sandbox"),
        F.lit(False).alias("fixed_output"),
    )


@query(f"SELECT doc_id AS job_id, {_KEY} AS key FROM documents")
def dedupe_key(spark, d):
    return identity.dedupe_key(requests(spark, d)).select("job_id", "key")


@query(f"SELECT {_KEY} AS key, min(doc_id) AS leader, count(*) - 1 AS followers FROM documents GROUP BY key")
def dedupe_groups(spark, d):
    return identity.dedupe_groups(identity.dedupe_key(requests(spark, d)))


@query("""WITH e AS (SELECT *, max(finished_at) OVER (PARTITION BY key ORDER BY submitted_at, job_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM builds),
  l AS (SELECT *, e IS NULL OR e <= submitted_at AS leads FROM e)
  SELECT key, job_id, cast(sum(CASE WHEN leads THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY submitted_at, job_id ROWS UNBOUNDED PRECEDING) AS bigint) AS island, leads FROM l""")
def inflight_groups(spark, d):
    return identity.inflight_groups(view(spark, d, "builds"))


@query("""SELECT a.output, a.job_id AS job_a, b.job_id AS job_b FROM holders a JOIN holders b ON a.output = b.output AND a.key <> b.key AND a.job_id < b.job_id
  AND a.started_at < b.finished_at AND b.started_at < a.finished_at""")
def path_conflicts(spark, d):
    return staging.path_conflicts(view(spark, d, "holders"), parts(spark, d))


@query("""WITH r AS (SELECT o_custkey AS dedupe_key, o_orderkey AS build_id, o_orderdate AS assigned_at, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders)
  SELECT dedupe_key, build_id, assigned_at FROM r WHERE n = 1""")
def latest_assignment(spark, d):
    return identity.latest_assignment(view(spark, d, "SELECT o_custkey AS dedupe_key, o_orderkey AS build_id, o_orderdate AS assigned_at FROM orders"))


@query("""WITH r AS (SELECT o_custkey AS dedupe_key, o_orderkey AS build_id, CASE WHEN o_orderstatus = 'F' THEN 'finished' ELSE 'running' END AS phase,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus = 'F' DESC, o_orderdate DESC, o_orderkey DESC) AS n FROM orders) SELECT dedupe_key, build_id, phase FROM r WHERE n = 1""")
def latest_states(spark, d):
    states = view(spark, d, "SELECT o_custkey AS dedupe_key, o_orderkey AS build_id, CASE WHEN o_orderstatus = 'F' THEN 'finished' ELSE 'running' END AS phase, o_orderdate AS updated_at FROM orders")
    return sinks.latest_states(states).select("dedupe_key", "build_id", "phase")


# -------------------------------------------------------------- validation

_H = "'/nix/store/' || translate(md5(cast(o_orderkey AS string)), 'e', 'z') || '-"


@query("""SELECT o_orderkey AS job_id, CASE o_orderkey % 12 WHEN 0 THEN 'no outputs' WHEN 1 THEN 'invalid store dir' WHEN 2 THEN 'input: bad path' WHEN 3 THEN 'input: duplicate'
  WHEN 4 THEN 'output: bad path' WHEN 5 THEN 'output: duplicate' WHEN 6 THEN 'output: also an input' WHEN 7 THEN 'builder not absolute' WHEN 8 THEN 'invalid tmp dir'
  WHEN 9 THEN 'invalid tmp dir' WHEN 10 THEN 'invalid tmp dir' END AS reject_reason FROM orders""")
def validate_requests(spark, d):
    base = view(spark, d, f"SELECT o_orderkey AS job_id, o_orderkey % 12 AS c, {_H}in' AS a, {_H}out' AS b, {_H}dev' AS e FROM orders")
    c = F.col("c")
    one = F.when(c == 4, F.lit("/nix/store/short-out")).when(c == 6, F.col("a")).otherwise(F.col("b"))
    two = F.when(c == 5, F.col("b")).otherwise(F.col("e"))
    df = base.select(
        "job_id",
        F.when(c == 0, F.create_map().cast("map<string,string>")).otherwise(F.create_map(F.lit("out"), one, F.lit("dev"), two)).alias("outputs"),
        F.when(c == 1, "/tmp/store").otherwise("/nix/store").alias("store_dir"),
        F.when(c == 2, F.array(F.lit("/etc/shadow"))).when(c == 3, F.array("a", "a")).otherwise(F.array("a")).alias("input_paths"),
        F.when(c == 7, "bin/sh").otherwise("/bin/sh").alias("builder"),
        F.when(c == 8, "build").when(c == 9, "/build/../x").when(c == 10, "/nix/store/x").otherwise("/build").alias("tmp_dir_in_sandbox"),
    )
    return validate.validate_requests(df).select("job_id", "reject_reason")


@query("""SELECT o_orderkey AS job_id, CASE o_orderkey % 6 WHEN 0 THEN 'invalid build id' WHEN 1 THEN 'builder not absolute' WHEN 2 THEN 'invalid tmp dir' WHEN 3 THEN 'invalid output path' END AS reject_reason FROM orders""")
def validate_assignments(spark, d):
    base = view(spark, d, f"SELECT o_orderkey AS job_id, o_orderkey % 6 AS c, md5(cast(o_orderkey AS string)) AS id, {_H}out' AS b FROM orders")
    c = F.col("c")
    df = base.select(
        "job_id",
        F.when(c == 0, F.concat("id", F.lit("\n"))).otherwise(F.col("id")).alias("build_id"),
        F.when(c == 1, "sh").otherwise("/bin/sh").alias("builder"),
        F.when(c == 2, "/a/..").otherwise("/build").alias("tmp_dir_in_sandbox"),
        F.create_map(F.lit("out"), F.when(c == 3, F.concat("b", F.lit("/bin"))).otherwise(F.col("b"))).alias("outputs"),
    )
    return validate.validate_assignments(df).select("job_id", "reject_reason")


_PATHS = """SELECT path_id, CASE path_id % 7 WHEN 0 THEN path || chr(10) WHEN 1 THEN path || '/bin' WHEN 2 THEN path || '?x=1+2' WHEN 3 THEN replace(path, '/nix', '/nax')
  WHEN 4 THEN substr(path, 1, 40) WHEN 5 THEN path || ',b' ELSE path END AS path FROM store_paths"""


@query(f"SELECT path_id, regexp_full_match(path, '/nix/store/[0-9a-df-np-sv-z]{{32}}-[0-9a-zA-Z+._?=-]+') AS ok FROM ({_PATHS})")
def store_path_check(spark, d):
    return view(spark, d, _PATHS).select("path_id", fn.is_store_path(F.col("path")).alias("ok"))


@query("""WITH c AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 11 = 0 THEN 222 WHEN event_id % 5 = 0 THEN 137 ELSE event_id % 3 END AS code, CASE WHEN event_id % 8 = 0 THEN 9 END AS signal FROM events),
  x AS (SELECT event_id, coalesce(code, 128 + signal, 1) AS exit_code FROM c)
  SELECT event_id, cast(exit_code AS bigint) AS exit_code, CASE WHEN exit_code = 0 THEN 'ok' WHEN exit_code = 222 THEN 'declined' WHEN exit_code = 137 AND event_id % 2 = 0 THEN 'memory limit' WHEN exit_code > 128 THEN 'signal' ELSE 'failed' END AS outcome FROM x""")
def exit_class(spark, d):
    raw = view(spark, d, "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 11 = 0 THEN 222 WHEN event_id % 5 = 0 THEN 137 ELSE event_id % 3 END AS code, CASE WHEN event_id % 8 = 0 THEN 9 END AS signal FROM events")
    code = fn.exit_code(F.col("code"), F.col("signal")).cast("bigint")
    return raw.select("event_id", code.alias("exit_code"), fn.outcome(code, F.col("event_id") % 2 == 0).alias("outcome"))


@query("SELECT event_id, code AS exit_code, code BETWEEN 0 AND 255 AS valid, code = 0 AS success FROM (SELECT event_id, event_id % 600 - 20 AS code FROM events)")
def exit_code_check(spark, d):
    return validate.check_exit_codes(view(spark, d, "SELECT event_id, event_id % 600 - 20 AS exit_code FROM events"))


@query("""SELECT event_id, event_type NOT IN ('click', 'purchase') AS retryable FROM events""")
def transport_failures(spark, d):
    raw = view(spark, d, "SELECT event_id, CASE event_type WHEN 'click' THEN 'NotFound' WHEN 'purchase' THEN 'InvalidArgument' WHEN 'view' THEN 'Unavailable' ELSE 'Unknown' END AS status FROM events")
    return raw.select("event_id", fn.is_retryable(F.col("status")).alias("retryable"))


@query("""SELECT o_orderkey AS job_id, CASE o_orderkey % 5 WHEN 0 THEN 'kvm,big-parallel' WHEN 1 THEN '' WHEN 2 THEN 'kvm,uid-range' ELSE '' END AS features FROM orders""")
def required_features(spark, d):
    env = F.col("c")
    blob = '{"requiredSystemFeatures":["kvm",7,"uid-range"]}'
    m = (
        F.when(env == 0, F.create_map(F.lit("requiredSystemFeatures"), F.lit(" kvm  big-parallel ")))
        .when(env == 1, F.create_map(F.lit("requiredSystemFeatures"), F.lit(" "), F.lit("__json"), F.lit(blob)))
        .when(env == 2, F.create_map(F.lit("__json"), F.lit(blob)))
        .when(env == 3, F.create_map(F.lit("__json"), F.lit("not json")))
        .otherwise(F.create_map().cast("map<string,string>"))
    )
    raw = view(spark, d, "SELECT o_orderkey AS job_id, o_orderkey % 5 AS c FROM orders").withColumn("env", m)
    return raw.select("job_id", F.array_join(fn.required_features(F.col("env")), ",").alias("features"))


@query("""WITH cut AS (SELECT doc_id, substr(text, 1, list_max([n FOR n IN range(0, 129) IF strlen(substr(text, 1, cast(n AS int))) <= 128])) AS c FROM documents)
  SELECT doc_id, replace(replace(replace(c, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n') AS label FROM cut""")
def label_value(spark, d):
    return view(spark, d, "SELECT doc_id, text FROM documents").select("doc_id", fn.label_value(F.col("text")).alias("label"))


@query("""WITH s AS (SELECT CASE doc_id % 3 WHEN 0 THEN 'tmp_archive' WHEN 1 THEN 'nar' ELSE 'tmp_unpacked' END AS kind, source AS id, cast(sum(n_chars) AS bigint) AS bytes FROM documents GROUP BY 1, 2)
  SELECT kind, id, bytes, CASE kind WHEN 'tmp_archive' THEN bytes > 20000 WHEN 'nar' THEN bytes > 40000 ELSE bytes >= 30000 END AS rejected FROM s""")
def size_screen(spark, d):
    raw = view(spark, d, "SELECT CASE doc_id % 3 WHEN 0 THEN 'tmp_archive' WHEN 1 THEN 'nar' ELSE 'tmp_unpacked' END AS kind, source AS id, n_chars AS bytes FROM documents")
    return validate.screen_sizes(raw, {"tmp_archive": 20_000, "nar": 40_000, "tmp_unpacked": 30_000})


@query("SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 3 <> 0 THEN 'none' WHEN o_orderkey % 2 = 0 THEN 'isolated' ELSE 'host' END AS mode FROM orders")
def network_mode(spark, d):
    raw = view(spark, d, "SELECT o_orderkey AS job_id FROM orders")
    env = F.create_map(F.lit("NIX_OUTPUT_CHECKED"), F.when(F.col("job_id") % 3 == 0, "1").otherwise("0"))
    return raw.select("job_id", fn.network_mode(fn.is_fixed_output(env), F.col("job_id") % 2 == 0).alias("mode"))


# ------------------------------------------------------------------- graph


@query("""WITH known AS (SELECT path_id FROM store_paths WHERE path_id % 3 <> 0), covered AS (SELECT DISTINCT reference FROM refs JOIN known a ON a.path_id = referrer JOIN known b ON b.path_id = reference WHERE referrer <> reference)
  SELECT path, c.reference IS NULL AS pinned FROM store_paths LEFT JOIN covered c ON c.reference = path_id""")
def pin_plan(spark, d):
    paths = view(spark, d, "store_paths")
    known = paths.where("path_id % 3 <> 0").select(F.col("path_id").alias("id"), "path")
    return graph.pin_plan(paths.select("path"), known, view(spark, d, "refs"))


@query("""WITH RECURSIVE walk AS (SELECT p_partkey AS path_id, 0 AS depth FROM part WHERE p_partkey % 97 = 0 AND p_partkey % 5 <> 0
  UNION SELECT r.reference, w.depth + 1 FROM walk w JOIN refs r ON r.referrer = w.path_id WHERE r.reference % 5 <> 0 AND r.reference <> r.referrer)
  SELECT path_id, min(depth) AS depth FROM walk GROUP BY path_id""")
def closure(spark, d):
    seeds = view(spark, d, "SELECT p_partkey AS path_id FROM part WHERE p_partkey % 97 = 0")
    known = view(spark, d, "SELECT p_partkey AS path_id FROM part WHERE p_partkey % 5 = 0 UNION ALL SELECT cast(0 AS bigint) FROM region WHERE r_regionkey = 0")
    return graph.closure(seeds, view(spark, d, "refs"), known)


@query("""WITH RECURSIVE own AS (SELECT referrer, reference FROM refs WHERE referrer <> reference),
  walk AS (SELECT p_partkey AS node, 0 AS level FROM part WHERE p_partkey = 0 UNION SELECT o.referrer, w.level + 1 FROM walk w JOIN own o ON o.reference = w.node)
  SELECT node, max(level) AS level FROM walk GROUP BY node""")
def topo_levels(spark, d):
    return graph.topo_levels(view(spark, d, "SELECT p_partkey AS node FROM part"), view(spark, d, "refs"))


@query("""SELECT DISTINCT reference AS path_id FROM refs WHERE reference % 3 <> 0 AND reference % 5 <> 0""")
def extras_seed(spark, d):
    ids = lambda where: view(spark, d, f"SELECT DISTINCT reference AS path_id FROM refs WHERE {where}")
    return staging.extras_seed(ids("true"), ids("reference % 3 = 0"), ids("reference % 5 = 0"))


@query("""WITH cases AS (SELECT 'quiet' AS kind, path_id FROM valid_now UNION ALL SELECT 'raced', path_id FROM valid_now WHERE path_id % 11 <> 0),
  gone AS (SELECT DISTINCT k.kind FROM (SELECT DISTINCT kind FROM cases) k JOIN valid_now v ON NOT EXISTS (SELECT 1 FROM cases c WHERE c.kind = k.kind AND c.path_id = v.path_id))
  SELECT k.kind, p.path_id, v.path_id IS NOT NULL AS known, g.kind IS NOT NULL AS raced, g.kind IS NOT NULL OR v.path_id IS NULL AS pinned
  FROM (SELECT DISTINCT kind FROM cases) k JOIN store_paths p ON true LEFT JOIN valid_now v ON v.path_id = p.path_id LEFT JOIN gone g ON g.kind = k.kind""")
def snapshot_race(spark, d):
    paths, valid = view(spark, d, "SELECT path_id FROM store_paths"), view(spark, d, "valid_now")
    quiet = staging.snapshot_race(paths, valid, valid).withColumn("kind", F.lit("quiet"))
    return quiet.unionByName(staging.snapshot_race(paths, valid, valid.where("path_id % 11 <> 0")).withColumn("kind", F.lit("raced")))


@query("SELECT DISTINCT path FROM store_paths WHERE path_id % 2 = 0 OR path_id % 3 = 0")
def scan_candidates(spark, d):
    paths = view(spark, d, "store_paths")
    bad = F.concat("path", F.lit("/x"))
    return staging.scan_candidates(paths.where("path_id % 2 = 0"), paths.where("path_id % 3 = 0").unionByName(paths.where("path_id % 7 = 0").withColumn("path", bad)))


@query("""SELECT build, reference FROM (SELECT DISTINCT p.build, r.reference FROM phased p JOIN refs r ON r.referrer = p.path_id WHERE r.referrer <> r.reference) x
  WHERE NOT EXISTS (SELECT 1 FROM phased q WHERE q.build = x.build AND q.path_id = x.reference)""")
def open_needs(spark, d):
    return graph.open_needs(view(spark, d, "phased"), view(spark, d, "refs"), parts(spark, d))


# ------------------------------------------------------------------ events

_UPTO = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
_BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


@query("""WITH c AS (SELECT unnest(['submitted', 'dispatched', 'declined', 'requeued', 'failed', 'succeeded']) AS counter)
  SELECT counter, count(l.seq) AS n FROM c LEFT JOIN lifecycle l ON l.kind = counter AND NOT (l.kind = 'submitted' AND l.duplicate) GROUP BY counter""")
def lifecycle_counters(spark, d):
    return ev.lifecycle_counters(view(spark, d, "lifecycle"))


@query("""WITH last AS (SELECT job_id, kind, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, seq DESC) AS n FROM lifecycle WHERE ts <= TIMESTAMP '2024-01-16 00:00:00')
  SELECT count(*) AS depth FROM last WHERE n = 1 AND kind IN ('submitted', 'requeued')""")
def queue_depth(spark, d):
    return ev.queue_depth(view(spark, d, "lifecycle"), F.lit("2024-01-16 00:00:00").cast("timestamp_ntz"))


@query("""SELECT build_id, bool_or(kind <> 'log') AS concluded, arg_max(kind, seq) FILTER (kind <> 'log') AS last_end, CASE WHEN bool_or(kind <> 'log') THEN 'concluded' ELSE 'resubmit' END AS verdict FROM attach GROUP BY build_id""")
def verdicts(spark, d):
    return ev.verdicts(view(spark, d, "attach"))


_CAPPED = "SELECT worker_id AS id, CASE kind WHEN 'request_job' THEN 'resend' WHEN 'result_failed' THEN 'attempt' WHEN 'log' THEN 'reconnect' ELSE kind END AS kind FROM messages"


@query(f"WITH c AS ({_CAPPED}), g AS (SELECT id, kind, count(*) AS n FROM c GROUP BY id, kind) SELECT * FROM g WHERE (kind = 'resend' AND n > 3) OR (kind = 'attempt' AND n >= 3) OR (kind = 'reconnect' AND n > 30)")
def cap_violations(spark, d):
    return ev.cap_violations(view(spark, d, _CAPPED))


_LEDGER = "SELECT worker_id AS session, seq, CASE kind WHEN 'result_ok' THEN 'assignment' WHEN 'result_failed' THEN 'resumed' ELSE kind END AS kind FROM messages"


@query(f"""WITH l AS ({_LEDGER}), b AS (SELECT *, cast(sum(CASE kind WHEN 'request_job' THEN 1 WHEN 'assignment' THEN -1 ELSE 0 END) OVER (PARTITION BY session ORDER BY seq {_UPTO}) AS bigint) AS balance FROM l)
  SELECT session, seq, kind, balance, min(balance) OVER (PARTITION BY session ORDER BY seq {_UPTO}) >= 0 AS ok FROM b""")
def credit_ledger(spark, d):
    return ev.credit_ledger(view(spark, d, _LEDGER))


_REPLAY = "SELECT worker_id AS build_id, seq, bytes FROM messages"


@query(f"""WITH r AS (SELECT *, cast(sum(bytes + 64) OVER (PARTITION BY build_id ORDER BY seq {_UPTO}) AS bigint) AS running FROM ({_REPLAY})),
  o AS (SELECT *, bool_or(running > 2097152) OVER (PARTITION BY build_id ORDER BY seq {_UPTO}) AS overflowed FROM r)
  SELECT build_id, seq, bytes, running, overflowed, CASE WHEN overflowed THEN 0 ELSE running END AS backlog FROM o""")
def replay_accounting(spark, d):
    return ev.replay_accounting(view(spark, d, _REPLAY), 2 << 20)


_WATCHED = "SELECT worker_id AS build_id, seq FROM messages WHERE kind = 'request_job'"


@query(f"""WITH r AS (SELECT *, sum(bytes + 64) OVER (PARTITION BY build_id ORDER BY seq {_UPTO}) AS running FROM ({_REPLAY})),
  o AS (SELECT build_id, min(seq) AS over_at FROM r WHERE running > 65536 GROUP BY build_id)
  SELECT s.build_id, s.seq, o.over_at, coalesce(s.seq >= o.over_at, false) AS rejected FROM ({_WATCHED}) s LEFT JOIN o ON o.build_id = s.build_id""")
def late_subscribers(spark, d):
    return ev.late_subscribers(view(spark, d, _WATCHED), ev.replay_accounting(view(spark, d, _REPLAY), 1 << 16))


_CHUNKED = "SELECT worker_id AS build_id, seq % 3 AS path_id, seq, CASE kind WHEN 'log' THEN 'chunk' WHEN 'result_failed' THEN 'restart' ELSE kind END AS kind FROM messages"


@query(f"""WITH c AS ({_CHUNKED}), m AS (SELECT *, max(CASE WHEN kind = 'restart' THEN seq END) OVER (PARTITION BY build_id, path_id) AS last FROM c)
  SELECT build_id, path_id, seq, kind FROM m WHERE kind = 'chunk' AND (last IS NULL OR seq > last)""")
def trim_restarts(spark, d):
    return ev.trim_restarts(view(spark, d, _CHUNKED))


_SESSIONS = "SELECT worker_id AS worker, seq AS n, bytes / 2048 AS seconds FROM messages"


@query(f"""WITH s AS ({_SESSIONS}), i AS (SELECT *, sum(CASE WHEN seconds > 60 THEN 1 ELSE 0 END) OVER (PARTITION BY worker ORDER BY n {_UPTO}) AS island FROM s)
  SELECT worker, n, seconds, cast(least(60, pow(2, least(30, row_number() OVER (PARTITION BY worker, island ORDER BY n) - 1))) AS bigint) AS delay FROM i""")
def backoff(spark, d):
    return ev.backoff(view(spark, d, _SESSIONS))


_READS = "SELECT worker_id AS build_id, seq, CASE WHEN kind = 'heartbeat' THEN NULL ELSE seq % 2 END AS subscriber FROM messages"


@query(f"""WITH r AS ({_READS}), p AS (SELECT *, count(*) FILTER (subscriber IS NULL) OVER (PARTITION BY build_id ORDER BY seq {_UPTO}) AS produced FROM r),
  c AS (SELECT *, produced - (row_number() OVER (PARTITION BY build_id, subscriber ORDER BY seq) - 1) AS lag FROM p WHERE subscriber IS NOT NULL)
  SELECT build_id, subscriber, min(seq) AS seq, max(lag) AS lag FROM c WHERE lag > 5 GROUP BY build_id, subscriber""")
def slow_subscribers(spark, d):
    return ev.slow_subscribers(view(spark, d, _READS), 5)


@query(f"""WITH m AS (SELECT *, count(*) FILTER (kind = 'metadata') OVER p AS path_meta, count(*) FILTER (kind = 'metadata') OVER b AS meta, count(*) FILTER (kind = 'path_end') OVER b AS ends, count(*) FILTER (kind = 'result') OVER b AS results,
  last_value(CASE WHEN kind = 'metadata' THEN path_id END IGNORE NULLS) OVER b AS open_path FROM staged
  WINDOW b AS (PARTITION BY build_id ORDER BY seq {_BEFORE}), p AS (PARTITION BY build_id, path_id ORDER BY seq {_BEFORE}))
  SELECT build_id, seq, kind = 'chunk' AND path_meta = 0 AS chunk_before_metadata, kind = 'chunk' AND open_path IS NOT NULL AND open_path <> path_id AS interleaved, kind IN ('metadata', 'chunk') AND NOT requested AS unrequested,
  kind = 'result' AND results > 0 AS duplicate_result, kind = 'output' AND results = 0 AS output_before_result, kind = 'closed' AND meta > ends AS closed_pending FROM m""")
def audit_protocol(spark, d):
    return staging.audit_protocol(view(spark, d, "staged")).drop("path_id", "requested", "kind")


_BEATS = "SELECT worker_id AS worker, ts, seq, cast(8 AS bigint) AS max_jobs, seq % 5 AS free, seq % 3 AS pending, seq % 4 AS active, bytes AS load1 FROM messages WHERE kind = 'heartbeat'"


@query(f"""WITH b AS ({_BEATS}), l AS (SELECT *, row_number() OVER (PARTITION BY worker ORDER BY ts DESC, seq DESC) AS n FROM b)
  SELECT worker, greatest(0, max_jobs - free - pending - active) AS running, load1 FROM l WHERE n = 1""")
def running_jobs(spark, d):
    return ev.running_jobs(view(spark, d, _BEATS))


# ---------------------------------------------------------------- contents


@query("SELECT path_id, string_agg(chunk, '' ORDER BY seq) AS content, count(*) AS chunks, cast(sum(strlen(chunk)) AS bigint) AS bytes, true AS complete FROM chunks GROUP BY path_id")
def reassemble(spark, d):
    return staging.reassemble(view(spark, d, "chunks"))


@query("SELECT doc_id AS path_id, sha256(text) AS digest, doc_id % 10 <> 0 AS ok FROM documents")
def verify_digests(spark, d):
    bodies = view(spark, d, "bodies").withColumnRenamed("doc_id", "path_id")
    told = bodies.select("path_id", F.sha2(F.when(F.col("path_id") % 10 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content")), 256).alias("sha256"))
    return staging.verify_digests(bodies, told)


@query("""SELECT doc_id AS path_id, strlen(text) AS received, strlen(text) + doc_id % 3 - 1 AS nar_size, CASE WHEN doc_id % 3 = 0 THEN 'excess' WHEN doc_id % 3 = 2 AND doc_id % 2 = 0 THEN 'short' ELSE 'ok' END AS state FROM documents""")
def check_sizes(spark, d):
    bodies = view(spark, d, "bodies").withColumnRenamed("doc_id", "path_id").withColumn("complete", F.col("path_id") % 2 == 0)
    return staging.check_sizes(bodies, bodies.select("path_id", (F.octet_length("content") + F.col("path_id") % 3 - 1).cast("bigint").alias("nar_size")))


@query("""SELECT DISTINCT doc_id AS content_id, item_id FROM bodies JOIN candidates ON contains(' ' || translate(content, chr(10) || chr(9), '  '), ' ' || translate(token, chr(10) || chr(9), '  '))""")
def scan_texts(spark, d):
    return staging.scan_texts(view(spark, d, "SELECT doc_id AS content_id, content FROM bodies"), view(spark, d, "candidates"))


@query("SELECT DISTINCT referrer AS content_id, reference AS item_id FROM refs JOIN store_paths ON path_id = reference WHERE referrer <> reference")
def scan_references(spark, d):
    part = "translate(md5(cast({} AS string)), 'e', 'z')"
    contents = view(spark, d, f"SELECT referrer AS content_id, concat_ws(' ', collect_list('/nix/store/' || {part.format('reference')} || '-part')) AS content FROM refs GROUP BY referrer")
    return staging.scan_references(contents, view(spark, d, f"SELECT path_id AS item_id, {part.format('path_id')} AS token FROM store_paths"))


@query("SELECT path_id, count(*) AS chunks, cast(sum(strlen(chunk)) AS bigint) AS bytes, true AS complete, sha256(string_agg(chunk, '' ORDER BY seq)) AS sha256 FROM chunks GROUP BY path_id")
def stream_digests(spark, d):
    return staging.stream_digests(view(spark, d, "chunks"))


@query("""WITH whole AS (SELECT path_id, cast(sum(strlen(chunk)) AS bigint) AS bytes, sha256(string_agg(chunk, '' ORDER BY seq)) AS sha256 FROM chunks GROUP BY path_id),
  told AS (SELECT path_id, bytes + path_id % 3 - 1 AS nar_size, CASE WHEN path_id % 5 = 0 THEN sha256('other') ELSE sha256 END AS nar_sha256 FROM whole UNION ALL SELECT DISTINCT path_id + 1000000000, 10, sha256('none') FROM chunks WHERE path_id % 7 = 0)
  SELECT t.path_id, coalesce(w.bytes, 0) AS received, t.nar_size, CASE WHEN w.path_id IS NULL THEN 'missing' WHEN w.bytes > t.nar_size THEN 'excess' WHEN w.bytes < t.nar_size THEN 'short' ELSE 'ok' END AS state,
  coalesce(w.sha256 = t.nar_sha256, false) AS verified FROM told t LEFT JOIN whole w ON w.path_id = t.path_id""")
def check_archives(spark, d):
    chunks = view(spark, d, "chunks")
    # announced sizes and digests, some of them wrong, of whole contents, and paths of which nothing comes
    whole = chunks.groupBy("path_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "chunk"))), lambda c: c["chunk"]), "").alias("c"))
    digest = F.when(F.col("path_id") % 5 == 0, F.sha2(F.lit("other"), 256)).otherwise(F.sha2("c", 256))
    told = whole.select("path_id", (F.octet_length("c") + F.col("path_id") % 3 - 1).cast("bigint").alias("nar_size"), digest.alias("nar_sha256"))
    none = chunks.where("path_id % 7 = 0").select((F.col("path_id") + 1_000_000_000).alias("path_id"), F.lit(10).cast("bigint").alias("nar_size"), F.sha2(F.lit("none"), 256).alias("nar_sha256")).distinct()
    return staging.check_archives(chunks, told.unionByName(none))


@query("SELECT DISTINCT referrer AS content_id, reference AS item_id FROM refs JOIN store_paths ON path_id = reference WHERE referrer <> reference")
def scan_chunks(spark, d):
    part = "translate(md5(cast({} AS string)), 'e', 'z')"
    whole = view(spark, d, f"SELECT referrer AS path_id, concat_ws(' ', collect_list('/nix/store/' || {part.format('reference')} || '-part')) AS c FROM refs GROUP BY referrer")
    # chunks of 7, 12 or 50 characters, so that hash parts lie across borders
    step = "CASE path_id % 3 WHEN 0 THEN 7 WHEN 1 THEN 12 ELSE 50 END"
    cut = whole.select("path_id", "c", F.expr(step).alias("step")).select("path_id", "c", "step", F.explode(F.expr("sequence(0, length(c) div step)")).alias("seq"))
    chunks = cut.select("path_id", "seq", F.expr("substring(c, cast(seq * step + 1 AS int), step)").alias("chunk"), F.expr("seq = length(c) div step").alias("eof"))
    return staging.scan_chunks(chunks, view(spark, d, f"SELECT path_id AS item_id, {part.format('path_id')} AS token FROM store_paths"))


_ROUTED = "SELECT seq, seq % 3000 AS build_id, ts FROM messages"


@query("SELECT seq, seq % 3000 AS build_id, ts, coalesce(seq % 3000 % 4 <> 0 AND ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00', false) AS routed FROM messages")
def route(spark, d):
    open_ = view(spark, d, "SELECT DISTINCT seq % 3000 AS build_id FROM messages WHERE seq % 3000 % 4 <> 0").select(
        "build_id", F.lit("2024-01-05 00:00:00").cast("timestamp_ntz").alias("opened_at"), F.lit("2024-01-20 00:00:00").cast("timestamp_ntz").alias("closed_at")
    )
    return staging.route(view(spark, d, _ROUTED), open_)


@query("""SELECT job_id AS build_id, CASE WHEN job_id % 3 = 0 THEN 'no state' ELSE 'no build' END AS side FROM jobs WHERE (job_id % 3 = 0) <> (job_id % 5 = 0)""")
def orphans(spark, d):
    ids = lambda where: view(spark, d, f"SELECT job_id AS build_id FROM jobs WHERE {where}")
    return staging.orphans(ids("job_id % 3 = 0"), ids("job_id % 5 = 0"))


_ATTACHED = "SELECT seq % 500 AS build_id, CASE kind WHEN 'log' THEN 'added_path' WHEN 'result_ok' THEN 'exit_code' ELSE kind END AS kind, 'p' || cast(seq % 7 AS string) AS path, CASE WHEN seq % 500 % 3 = 0 THEN 1 ELSE 0 END AS code FROM messages"


@query(f"""WITH a AS ({_ATTACHED}), g AS (SELECT build_id, list_sort(list(DISTINCT path) FILTER (kind = 'added_path')) AS paths, max(code) FILTER (kind = 'exit_code') AS code FROM a GROUP BY build_id)
  SELECT build_id, array_to_string(paths, ',') AS paths FROM g WHERE code = 0 AND len(paths) > 0""")
def added_paths(spark, d):
    return sinks.added_paths(view(spark, d, _ATTACHED)).withColumn("paths", F.array_join("paths", ","))


@query("SELECT event_id AS build_id, event_id % 4 NOT IN (0, 3) AS oom FROM events")
def oom_flags(spark, d):
    text = F.when(F.col("event_id") % 4 == 0, "low 0\noom_kill 0").when(F.col("event_id") % 4 == 3, "oom 1\nxoom_kill 2").otherwise(F.concat(F.lit("high 1\noom_kill "), F.col("event_id").cast("string"), F.lit("\nmax 0")))
    return readers.oom_flags(view(spark, d, "SELECT event_id FROM events").select(F.col("event_id").alias("build_id"), text.alias("events")))


_METRICS = """WITH c AS (SELECT 'builds_' || k || '_total' AS metric, k FROM (SELECT unnest(['submitted', 'dispatched', 'declined', 'requeued', 'failed', 'succeeded']) AS k))
  SELECT metric, NULL AS worker, NULL AS system, count(l.seq) AS value FROM c LEFT JOIN lifecycle l ON l.kind = k AND NOT (l.kind = 'submitted' AND l.duplicate) GROUP BY metric
  UNION ALL SELECT 'queue_depth', NULL, NULL, (WITH last AS (SELECT job_id, kind, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, seq DESC) AS n FROM lifecycle) SELECT count(*) FROM last WHERE n = 1 AND kind IN ('submitted', 'requeued'))
  UNION ALL SELECT 'workers_connected', NULL, NULL, count(*) FROM workers
  UNION ALL SELECT 'builder_up', worker_name, system, 1 FROM workers JOIN worker_systems USING (worker_id)
  UNION ALL SELECT 'workers_for_system', NULL, system, count(*) FROM worker_systems GROUP BY system"""


@query(_METRICS)
def metrics_table(spark, d):
    life = view(spark, d, "lifecycle")
    depth = ev.queue_depth(life, F.lit("2200-01-01 00:00:00").cast("timestamp_ntz"))
    return metrics.metrics_table(ev.lifecycle_counters(life), depth, registrations(spark, d))


_NAMES = ", ".join(f"({i}, '{k}', '{text}')" for i, (k, text) in enumerate(metrics.HELP.items()))


@query(f"""WITH names(place, metric, text) AS (VALUES {_NAMES}), t AS ({_METRICS}),
  lines AS (SELECT place, metric, 0 AS part, '# HELP fleet_' || metric || ' ' || text AS line FROM names
    UNION ALL SELECT place, metric, 1, '# TYPE fleet_' || metric || CASE WHEN metric LIKE '%_total' THEN ' counter' ELSE ' gauge' END FROM names
    UNION ALL SELECT place, t.metric, 2, 'fleet_' || t.metric || CASE WHEN worker IS NULL AND system IS NULL THEN '' ELSE '{{' ||
      concat_ws(',', 'worker="' || worker || '"', 'system="' || system || '"') || '}}' END || ' ' || value FROM t JOIN names n ON n.metric = t.metric)
  SELECT row_number() OVER (ORDER BY place, part, line) AS position, line FROM lines""")
def metrics_text(spark, d):
    # the exposition is as small as the fleet, and its order is part of it
    text = metrics.metrics_text(metrics_table(spark, d)).withColumn("id", F.monotonically_increasing_id())
    return text.select(F.row_number().over(W.orderBy("id")).alias("position"), "line")


@query("SELECT row_number() OVER (ORDER BY worker_name, system) AS position, worker_name, system FROM (SELECT DISTINCT worker_name, system FROM workers JOIN worker_systems USING (worker_id)) x")
def export_order(spark, d):
    rows = metrics.order_export(builder_up(spark, d).repartition(3)).withColumn("id", F.monotonically_increasing_id())
    return rows.select(F.row_number().over(W.orderBy("id")).alias("position"), "worker_name", "system")


# ------------------------------------------------------- sources and sinks


def _requests_as_text(spark: SparkSession, d: str) -> str:
    """Request documents of orders in a folder: every seventh of another version, every eleventh
    without a builder, every thirteenth cut short."""
    o = view(spark, d, "SELECT * FROM jobs")
    n = F.col("job_id")
    env = F.when(n % 4 == 0, F.create_map(F.lit("NIX_OUTPUT_CHECKED"), F.lit("1"))).otherwise(F.create_map(F.lit("A"), n.cast("string")))
    doc = F.struct(
        F.when(n % 7 == 0, 2).otherwise(1).alias("version"),
        F.when(n % 11 != 0, "/bin/sh").alias("builder"),
        F.array(F.lit("-c"), n.cast("string")).alias("args"),
        env.alias("env"),
        F.lit("/tmp").alias("topTmpDir"),
        F.lit("/build").alias("tmpDirInSandbox"),
        F.lit("/nix/store").alias("storeDir"),
        "system",
        F.array(F.concat(F.lit("/nix/store/in-"), n.cast("string"))).alias("inputPaths"),
        F.create_map(F.lit("out"), F.concat(F.lit("/nix/store/out-"), n.cast("string"))).alias("outputs"),
        F.lit("ignored").alias("unknownKey"),
    )
    text = F.to_json(doc)
    path = fresh_path(spark, "requests")
    o.select(F.when(n % 13 == 0, F.left(text, F.lit(40))).otherwise(text).alias("value")).write.text(path)
    return path


@query("""SELECT job_id, system, '/bin/sh' AS builder, '/nix/store/in-' || job_id AS inputs, '/nix/store/out-' || job_id AS output, job_id % 4 = 0 AS fixed_output
  FROM jobs WHERE job_id % 7 <> 0 AND job_id % 11 <> 0 AND job_id % 13 <> 0""")
def read_requests(spark, d):
    good, _ = readers.read_requests(spark, _requests_as_text(spark, d))
    return good.select(F.get("args", F.lit(1)).cast("bigint").alias("job_id"), "system", "builder", F.array_join("input_paths", ",").alias("inputs"), F.col("outputs")["out"].alias("output"), "fixed_output")


@query("""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN job_id % 13 = 0 THEN 'not a request document' WHEN job_id % 11 = 0 THEN 'missing builder' WHEN job_id % 7 = 0 THEN 'unsupported version' END AS reason FROM jobs) x
  WHERE reason IS NOT NULL GROUP BY reason""")
def rejected_requests(spark, d):
    _, bad = readers.read_requests(spark, _requests_as_text(spark, d))
    return bad.groupBy("reason").agg(F.count("*").alias("n"))


@query("""SELECT p.path, count(r.reference) AS n_references, count(q.path) AS n_valid FROM (SELECT * FROM store_paths WHERE path_id % 5 <> 0) p
  LEFT JOIN refs r ON r.referrer = p.path_id LEFT JOIN (SELECT * FROM store_paths WHERE path_id % 5 <> 0) q ON q.path_id = r.reference GROUP BY p.path""")
def read_store(spark, d):
    folder = fresh_path(spark, "store")
    view(spark, d, "SELECT path_id AS id, path FROM store_paths WHERE path_id % 5 <> 0").write.parquet(f"{folder}/valid_paths")
    view(spark, d, "refs").write.parquet(f"{folder}/refs")
    paths, refs = readers.read_store(spark, folder)
    ends = paths.select(F.col("id").alias("reference"), F.col("path").alias("other"))
    return (
        paths.join(refs, paths["id"] == refs["referrer"], "left").join(ends, "reference", "left").groupBy("path").agg(F.count("reference").alias("n_references"), F.count("other").alias("n_valid"))
    )


@query("""SELECT path_id, CASE WHEN path_id % 6 = 0 THEN 'path' WHEN path_id % 10 = 5 THEN 'deriver' WHEN path_id % 7 = 0 THEN 'nar hash' WHEN path_id % 9 = 0 THEN 'references' END AS field,
  CASE WHEN path_id % 6 <> 0 AND path_id % 10 <> 5 AND path_id % 7 <> 0 AND path_id % 9 <> 0 THEN path || ',' || path || '-x' END AS refs,
  CASE WHEN path_id % 6 <> 0 AND path_id % 10 <> 5 AND path_id % 7 <> 0 AND path_id % 9 <> 0 AND path_id % 10 <> 0 THEN path END AS deriver FROM store_paths""")
def normalize_path_infos(spark, d):
    n, path = F.col("path_id"), F.col("path")
    raw = view(spark, d, "store_paths").select(
        "path_id",
        F.when(n % 6 == 0, F.concat(path, F.lit("/x"))).otherwise(path).alias("store_path"),
        F.when(n % 7 == 0, F.unhex(F.lit("00"))).otherwise(F.unhex(F.sha2(path, 256))).alias("nar_sha256"),
        "nar_size",
        F.array(F.concat(path, F.lit("-x")), path, path, F.when(n % 9 == 0, "relative").otherwise(path)).alias("references"),
        F.array(F.lit("b"), F.lit("a"), F.lit("b")).alias("signatures"),
        F.when(n % 10 == 0, "").when(n % 10 == 5, "/etc/passwd").otherwise(path).alias("deriver"),
        F.lit("").alias("ca"),
    )
    good, bad = readers.normalize_path_infos(raw)
    none = F.lit(None).cast("string")
    return good.select("path_id", none.alias("field"), F.array_join("references", ",").alias("refs"), "deriver").unionByName(bad.select("path_id", "field", none.alias("refs"), none.alias("deriver")))


@query("SELECT 'key-' || s_suppkey AS key, s_suppkey % 3 <> 0 AS trusted FROM supplier")
def read_trusted_keys(spark, d):
    k = F.col("s_suppkey")
    name = F.concat(F.lit("key-"), k.cast("string"))
    line = F.when(k % 3 == 0, F.concat(F.lit("  # "), name)).when(k % 3 == 1, F.concat(F.lit("\t"), name, F.lit("  "))).otherwise(F.concat(name, F.lit("\r")))
    path = fresh_path(spark, "keys")
    table = view(spark, d, "SELECT s_suppkey FROM supplier")
    table.select(line.alias("value")).unionByName(table.select(F.lit("   ").alias("value"))).write.text(path)
    keys = readers.read_trusted_keys(spark, path).withColumn("trusted", F.lit(True))
    return table.select(name.alias("key")).join(keys, "key", "left").select("key", F.coalesce("trusted", F.lit(False)).alias("trusted"))


@query("""SELECT 'liveness' AS kind, worker_id AS worker, count(*) AS n, NULL AS last_build FROM messages GROUP BY worker_id
  UNION ALL SELECT 'log_chunk', worker_id, count(*), max('b' || seq) FROM messages WHERE kind = 'log' GROUP BY worker_id
  UNION ALL SELECT 'build_result', worker_id, count(*), max('b' || seq) FROM messages WHERE kind IN ('result_ok', 'result_failed') GROUP BY worker_id""")
def demux(spark, d):
    kind = F.col("kind")
    build = F.concat(F.lit("b"), F.col("seq").cast("string"))
    raw = view(spark, d, "messages").select(
        F.col("worker_id").alias("worker"), "ts", "seq",
        F.when(kind == "log", "log_chunk").when(kind.startswith("result"), "build_result").when(kind == "request_job", "job_request").otherwise("heartbeat").alias("kind"),
        F.when(kind == "log", F.struct(build.alias("build_id"), F.lit("x").alias("data"))).alias("log_chunk"),
        F.when(kind.startswith("result"), F.struct(build.alias("build_id"), F.lit(0).alias("exit_code"), F.lit("").alias("error"))).alias("build_result"),
    )
    missing = [F.lit(None).cast(t).alias(k) for k, t in WORKER_PAYLOADS.items() if k not in raw.columns]
    tables = readers.demux(raw.select("*", *missing))
    count = lambda k, last: tables[k].groupBy("worker").agg(F.count("*").alias("n"), last.alias("last_build")).select(F.lit(k).alias("kind"), "worker", "n", "last_build")
    none = F.max(F.lit(None).cast("string"))
    return count("liveness", none).unionByName(count("log_chunk", F.max("build_id"))).unionByName(count("build_result", F.max("build_id")))


@query("SELECT worker_id AS build_id, count(*) AS chunks, cast(sum(strlen('log ' || seq)) AS bigint) AS bytes FROM messages WHERE kind = 'log' GROUP BY worker_id")
def tail_logs(spark, d):
    path = fresh_path(spark, "logs")
    logs = view(spark, d, "SELECT worker_id, seq, ts FROM messages WHERE kind = 'log'")
    data = F.concat(F.lit("log "), F.col("seq").cast("string")).cast("binary")
    logs.select(F.col("worker_id").cast("string").alias("build_id"), "seq", F.col("ts").cast("timestamp").alias("ts"), data.alias("data")).repartition(6).write.parquet(path)
    counted = readers.tail_logs(spark, path, 2).groupBy(F.col("build_id").cast("bigint").alias("build_id"))
    return streams.drained(counted.agg(F.count("*").alias("chunks"), F.sum(F.octet_length("data")).cast("bigint").alias("bytes")))


@query("""SELECT o_orderkey AS build, CASE WHEN o_orderkey % 2 = 0 THEN 'running' ELSE 'finished' END AS phase, CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 0 END AS n_extras, true AS good FROM orders WHERE o_orderkey % 10 < 8
  UNION ALL SELECT NULL, NULL, NULL, false FROM orders WHERE o_orderkey % 10 >= 8""")
def read_build_states(spark, d):
    n = F.col("o_orderkey")
    extra = F.concat(F.lit(',"extras":[{"store_path":"/p","references":["/q"]},{"store_path":"/q"}]'))
    head = F.concat(F.lit('{"dedupe_key":"k","build_id":"'), n.cast("string"), F.lit('","phase":'))
    phase = F.when(n % 2 == 0, F.concat(F.lit('"running"'), F.when(n % 10 == 8, "").otherwise(',"deadline_unix":5'))).otherwise(F.lit('"finished","exit_code":0'))
    text = F.concat(head, phase, F.when(n % 3 == 0, extra).otherwise(""), F.when(n % 10 == 9, "").otherwise("}"))
    good, bad = readers.read_build_states(view(spark, d, "SELECT o_orderkey FROM orders").select(text.alias("value")))
    none = lambda t, c: F.lit(None).cast(t).alias(c)
    kept = good.select(F.col("build_id").cast("bigint").alias("build"), "phase", F.size("extras").alias("n_extras"), F.lit(True).alias("good"))
    return kept.unionByName(bad.select(none("bigint", "build"), none("string", "phase"), none("int", "n_extras"), F.lit(False).alias("good")))


@query("SELECT DISTINCT worker_name, system, true AS written, false AS again, true AS changed FROM workers JOIN worker_systems USING (worker_id) WHERE worker_id % 4 <> 0")
def write_if_changed(spark, d):
    path = fresh_path(spark, "snapshot")
    rows = builder_up(spark, d)
    some = view(spark, d, "SELECT worker_name FROM workers WHERE worker_id % 4 <> 0")
    told = [sinks.write_if_changed(rows, path), sinks.write_if_changed(rows.repartition(3), path), sinks.write_if_changed(rows.join(some, "worker_name", "left_semi"), path)]
    return spark.read.schema("worker_name string, system string").json(path).select("*", *[F.lit(t).alias(c) for t, c in zip(told, ("written", "again", "changed"), strict=True)])


@query("SELECT path_id, list_last(string_split(path, '/')) AS name FROM store_paths")
def base_names(spark, d):
    return view(spark, d, "store_paths").select("path_id", fn.base_name(F.col("path")).alias("name"))


@query("SELECT r.job_id, r.path_id FROM requested r WHERE NOT EXISTS (SELECT 1 FROM offers o WHERE o.job_id = r.job_id AND o.path_id = r.path_id)")
def unexpected_chunks(spark, d):
    return staging.unexpected_chunks(view(spark, d, "SELECT job_id, path_id FROM requested").repartition(parts(spark, d), *_PAIR), view(spark, d, "offers", _PAIRS))


@query("SELECT job_id FROM jobs WHERE job_id NOT IN (SELECT job_id FROM job_features)")
def dropped_jobs(spark, d):
    return matching.dropped_jobs(view(spark, d, "SELECT job_id FROM jobs"), view(spark, d, "SELECT DISTINCT job_id FROM job_features"))


# version 6 addresses, and version 4 ones mapped into version 6
_SIX = """SELECT event_id AS flow_id, CASE event_id % 3 WHEN 0 THEN 6 WHEN 1 THEN 17 ELSE 58 END AS proto, cast(event_id % 1024 AS int) AS port, CASE event_id % 7
  WHEN 0 THEN '::ffff:10.0.0.' || cast(event_id % 256 AS string) WHEN 1 THEN '::ffff:93.184.216.' || cast(event_id % 256 AS string) WHEN 2 THEN '2001:db8::' || cast(event_id % 1000 AS string)
  WHEN 3 THEN 'fe80::' || cast(event_id % 1000 AS string) WHEN 4 THEN '2001:0DB8:0:0:1::' || cast(event_id % 10 AS string) WHEN 5 THEN '::1' ELSE 'fd00::' || cast(event_id % 1000 AS string) END AS ip FROM events"""
RULES_SIX = [(0, "allow", "tcp", "2001:db8::/80", ["0-511"]), (1, "deny", "any", "private", []), (2, "allow", "udp", "93.184.216.0/25", []), (3, "allow", "any", "2001:db8:0:0:1::/80", [])]


@query(f"""WITH s AS ({_SIX}) SELECT flow_id, ip, flow_id % 7 IN (0, 3, 5, 6) AS private FROM s""")
def ip_scope_six(spark, d):
    return policy.ip_scope(view(spark, d, _SIX)).select("flow_id", "ip", "private")


@query(f"""WITH s AS ({_SIX}), r AS (SELECT flow_id, CASE WHEN flow_id % 7 = 2 AND proto = 6 AND port <= 511 THEN 0 WHEN flow_id % 7 IN (0, 3, 5, 6) THEN 1
  WHEN flow_id % 7 = 1 AND proto = 17 AND flow_id % 256 < 128 THEN 2 WHEN flow_id % 7 = 4 THEN 3 END AS rule_idx FROM s)
  SELECT flow_id, rule_idx, CASE WHEN rule_idx IN (0, 2, 3) THEN 'allow' ELSE 'deny' END AS action FROM r""")
def policy_decide_six(spark, d):
    raw = spark.createDataFrame(RULES_SIX, "rule_idx int, action string, proto string, dst string, ports array<string>")
    return policy.decide_flows(view(spark, d, _SIX), policy.compile_policy(raw)[0], "deny").select("flow_id", "rule_idx", "action")


@query(f"""WITH s AS ({_SIX}) SELECT flow_id, CASE flow_id % 7 WHEN 0 THEN '0a0000' || printf('%02x', flow_id % 256) WHEN 1 THEN '5db8d8' || printf('%02x', flow_id % 256)
  WHEN 2 THEN '20010db8' || repeat('0', 20) || lpad(cast(flow_id % 1000 AS string), 4, '0') WHEN 3 THEN 'fe80' || repeat('0', 24) || lpad(cast(flow_id % 1000 AS string), 4, '0')
  WHEN 4 THEN '20010db8000000000001' || repeat('0', 11) || cast(flow_id % 10 AS string) WHEN 5 THEN repeat('0', 31) || '1' ELSE 'fd00' || repeat('0', 24) || lpad(cast(flow_id % 1000 AS string), 4, '0') END AS address FROM s""")
def canonical_addresses(spark, d):
    return view(spark, d, _SIX).select("flow_id", canonical_key(address_key(F.col("ip"))).alias("address"))


@query("""WITH RECURSIVE own AS (SELECT referrer, reference FROM refs WHERE referrer <> reference),
  known AS (SELECT p_partkey AS path_id FROM part WHERE p_partkey % 5 = 0 OR p_partkey % 8 = 3),
  seed AS (SELECT p_partkey AS path_id FROM part WHERE p_partkey % 41 = 2 AND p_partkey NOT IN (SELECT path_id FROM known)),
  walk AS (SELECT path_id, 0 AS depth FROM seed UNION SELECT o.reference, w.depth + 1 FROM walk w JOIN own o ON o.referrer = w.path_id
    WHERE w.path_id % 9 <> 0 AND o.reference NOT IN (SELECT path_id FROM known)),
  found AS (SELECT path_id, min(depth) AS depth FROM walk GROUP BY path_id),
  inside AS (SELECT o.* FROM own o JOIN found a ON a.path_id = o.referrer JOIN found b ON b.path_id = o.reference),
  climb AS (SELECT path_id AS node, 0 AS level FROM found WHERE path_id NOT IN (SELECT referrer FROM inside) UNION SELECT i.referrer, c.level + 1 FROM climb c JOIN inside i ON i.reference = c.node),
  levels AS (SELECT node, max(level) AS level FROM climb GROUP BY node)
  SELECT path_id, depth, path_id % 9 = 0 AS error, level FROM found JOIN levels ON node = path_id""")
def extras(spark, d):
    ids = lambda where: view(spark, d, f"SELECT p_partkey AS path_id FROM part WHERE {where}")
    metadata = view(spark, d, "SELECT reference AS path_id FROM refs WHERE reference % 9 <> 0 UNION SELECT referrer FROM refs WHERE referrer % 9 <> 0")
    return graph.extras(ids("p_partkey % 41 = 2"), ids("p_partkey % 5 = 0"), ids("p_partkey % 8 = 3"), view(spark, d, "refs"), metadata)


# several cycles joined by ways: circles of 2 to 8 parts, with side ways, ways between neighbours and a tail
_RINGS = """SELECT p_partkey AS referrer, CASE WHEN p_partkey % 8 = 7 OR p_partkey = (SELECT max(p_partkey) FROM part) THEN p_partkey - p_partkey % 8 ELSE p_partkey + 1 END AS reference FROM part WHERE p_partkey % 24 < 16
  UNION SELECT p_partkey, p_partkey + 16 FROM part WHERE p_partkey % 48 = 5 UNION SELECT p_partkey, p_partkey + 2 FROM part WHERE p_partkey % 40 = 9 UNION SELECT p_partkey, p_partkey + 1 FROM part WHERE p_partkey % 24 >= 16"""


@query(f"""WITH RECURSIVE rings AS ({_RINGS}), nodes AS (SELECT p_partkey AS node FROM part), links AS (SELECT DISTINCT referrer, reference FROM rings JOIN nodes a ON a.node = referrer JOIN nodes b ON b.node = reference WHERE referrer <> reference),
  reach AS (SELECT node AS x, node AS y FROM nodes UNION SELECT x, reference FROM reach JOIN links ON referrer = y),
  pairs AS (SELECT a.x AS node, a.y AS other FROM reach a JOIN reach b ON b.x = a.y AND b.y = a.x)
  SELECT node, min(other) AS component, count(*) AS size FROM pairs GROUP BY node""")
def strong_components(spark, d):
    return graph.strong_components(view(spark, d, "SELECT p_partkey AS node FROM part"), view(spark, d, _RINGS))


# ---------------------------------------------------------------- timeouts


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY worker_id ORDER BY ts) > INTERVAL 12 HOURS THEN 1 ELSE 0 END AS fresh FROM messages),
  s AS (SELECT *, sum(fresh) OVER (PARTITION BY worker_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
  SELECT worker_id AS worker, min(ts) AS started, max(ts) AS last_seen, count(*) AS messages FROM s GROUP BY worker_id, session""")
def silent_workers(spark, d):
    return twins.silent_workers(view(spark, d, "SELECT worker_id AS worker, ts FROM messages"), 43_200)


@query(f"""WITH t AS (SELECT *, first_value(ts) OVER (PARTITION BY build_id ORDER BY ts, seq) AS first_ts, sum(bytes) OVER (PARTITION BY build_id ORDER BY ts, seq {_UPTO}) AS log_bytes,
    last_value(CASE WHEN bytes > 0 THEN ts END IGNORE NULLS) OVER (PARTITION BY build_id ORDER BY ts, seq {_BEFORE}) AS heard FROM ticks),
  r AS (SELECT build_id, ts, seq, CASE WHEN cancelled THEN 'cancelled' WHEN ts >= TIMESTAMP '2024-01-25 00:00:00' THEN 'timed out' WHEN log_bytes > 1048576 THEN 'log size' WHEN ts - coalesce(heard, first_ts) > INTERVAL 120 HOURS THEN 'silence' END AS reason FROM t),
  n AS (SELECT *, row_number() OVER (PARTITION BY build_id ORDER BY ts, seq) AS n FROM r WHERE reason IS NOT NULL) SELECT build_id, ts, reason FROM n WHERE n = 1""")
def abort_reasons(spark, d):
    ticks = view(spark, d, "ticks").withColumn("deadline", F.lit("2024-01-25 00:00:00").cast("timestamp_ntz"))
    return twins.abort_reasons(ticks, 1 << 20, 120 * 3600)


_SUBS = "SELECT worker_id AS build_id, ts, seq, CASE kind WHEN 'request_job' THEN 1 ELSE -1 END AS change FROM messages WHERE kind IN ('request_job', 'result_failed')"


_GONE = f"""WITH s AS ({_SUBS}), l AS (SELECT *, sum(change) OVER (PARTITION BY build_id ORDER BY ts, seq {_UPTO}) <= 0 AS gone FROM s),
  r AS (SELECT *, lag(gone) OVER (PARTITION BY build_id ORDER BY ts, seq) AS before, min(CASE WHEN NOT gone THEN ts END) OVER (PARTITION BY build_id ORDER BY ts, seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS back FROM l)
  SELECT build_id, min(ts) AS left_at, min(ts) + INTERVAL 6 HOURS AS abandoned_at FROM r WHERE gone AND NOT coalesce(before, false) AND (back IS NULL OR back - ts > INTERVAL 6 HOURS) AND ts + INTERVAL 6 HOURS <= {{}} GROUP BY build_id"""


@query(_GONE.format("(SELECT max(ts) FROM s)"))
def abandoned(spark, d):
    return twins.abandoned(view(spark, d, _SUBS), 6 * 3600)


_FINISHED = "SELECT worker_id AS result_id, ts AS finished_at FROM messages WHERE kind = 'result_ok'"
_ACKS = "SELECT worker_id AS result_id, ts AS acked_at FROM messages WHERE kind = 'heartbeat'"


@query(f"""WITH f AS ({_FINISHED}), a AS ({_ACKS}) SELECT result_id, finished_at FROM f WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.result_id = f.result_id AND acked_at >= finished_at AND acked_at <= finished_at + INTERVAL 12 HOURS)""")
def expired_results(spark, d):
    keyed = view(spark, d, _FINISHED).select(F.struct("result_id", "finished_at").alias("result_id"), "finished_at")
    acks = view(spark, d, _ACKS)
    # an acknowledgement is for a worker; each result of it within the time is served
    own = keyed.select("result_id", F.col("result_id.result_id").alias("w")).join(acks.withColumnRenamed("result_id", "w"), "w").select("result_id", "acked_at")
    return twins.expired_results(keyed, own, 43_200).select("result_id.result_id", "finished_at")


_DELIVERED = "SELECT seq % 700 AS dedupe_key, ts, seq FROM messages WHERE kind IN ('result_ok', 'result_failed')"


@query(f"WITH r AS ({_DELIVERED}), n AS (SELECT *, row_number() OVER (PARTITION BY dedupe_key ORDER BY ts, seq) AS n FROM r) SELECT dedupe_key, seq FROM n WHERE n = 1")
def dedupe_results(spark, d):
    return twins.dedupe_results(view(spark, d, _DELIVERED))


_LOST = "SELECT worker_id AS job_id, ts, seq, CASE kind WHEN 'result_failed' THEN 'lost' ELSE kind END AS kind FROM messages"


@query(f"""WITH l AS ({_LOST}), n AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts, seq) AS attempts FROM l WHERE kind = 'lost')
  SELECT job_id, ts, attempts, attempts <= 3 AS requeued, CASE WHEN attempts <= 3 THEN ts + INTERVAL 1 HOURS END AS protected_until FROM n WHERE attempts <= 4""")
def requeues(spark, d):
    return twins.requeues(view(spark, d, _LOST), 3600)


_SUBMITS = "SELECT seq AS job_id, worker_id % 40 AS system, ts FROM messages WHERE kind = 'log'"
_OPEN = "SELECT worker_id % 40 AS system, ts AS opens, ts + INTERVAL 1 HOURS AS closes FROM messages WHERE kind = 'request_job'"


@query(f"""WITH s AS ({_SUBMITS}), i AS ({_OPEN}), f AS (SELECT s.job_id, min(greatest(opens, ts)) AS served_at FROM s JOIN i ON s.system = i.system AND closes > ts AND opens <= ts + INTERVAL 2 HOURS GROUP BY s.job_id)
  SELECT s.job_id, CASE WHEN served_at IS NULL THEN 'declined' WHEN served_at = ts THEN 'now' ELSE 'waits' END AS decision, served_at FROM s LEFT JOIN f ON s.job_id = f.job_id""")
def admissions(spark, d):
    return twins.admissions(view(spark, d, _SUBMITS), view(spark, d, _OPEN), 7200)


_LOGS = "SELECT worker_id AS build_id, ts, bytes FROM messages WHERE kind = 'log'"


@query(f"WITH l AS ({_LOGS}) SELECT build_id, cast(sum(bytes) AS bigint) AS bytes, min(ts) AS first_ts, max(ts) AS last_ts FROM l GROUP BY build_id")
def live_log_bytes(spark, d):
    return twins.live_log_bytes(view(spark, d, _LOGS))


_RATES = f"WITH l AS ({_LOGS}), b AS (SELECT build_id, cast(sum(bytes) AS bigint) AS bytes, min(ts) AS first_ts, max(ts) AS last_ts FROM l GROUP BY build_id) SELECT *, CASE WHEN last_ts > first_ts THEN bytes / (date_diff('microsecond', first_ts, last_ts) / 1000000) END AS bytes_per_second FROM b"


@query(_RATES)
def log_rate(spark, d):
    return twins.log_rate(twins.live_log_bytes(view(spark, d, _LOGS)))


# ----------------------------------------------------------------- streams


def events_stream(spark: SparkSession, d: str) -> DataFrame:
    """``events`` as a stream of its files, in the columns of the view ``messages``."""
    path = f"{d}/events.parquet"
    # a pattern, since a stream takes a single file for no folder
    raw = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 4).parquet(path + "*")
    return raw.selectExpr(*_projection(VIEWS["messages"]))


def _projection(sql: str) -> list[str]:
    """The select list of a view over one table."""
    return [c.strip() for c in re.split(r",(?![^(]*\))", sql[sql.index("SELECT") + 6 : sql.rindex("FROM")])]


_KINDS = "CASE kind WHEN 'heartbeat' THEN 'submitted' WHEN 'log' THEN 'dispatched' WHEN 'request_job' THEN 'declined' WHEN 'result_ok' THEN 'succeeded' ELSE 'failed' END"


@query(f"WITH m AS (SELECT {_KINDS} AS counter, seq % 10 = 0 AS duplicate FROM messages) SELECT counter, count(*) AS n FROM m WHERE NOT (counter = 'submitted' AND duplicate) GROUP BY counter")
def live_counters_stream(spark, d):
    return streams.drained(streams.live_counters(events_stream(spark, d).selectExpr(f"{_KINDS} AS kind", "seq % 10 = 0 AS duplicate")))


@query(f"WITH l AS ({_LOGS}) SELECT build_id, cast(sum(bytes) AS bigint) AS bytes, min(ts) AS first_ts, max(ts) AS last_ts FROM l GROUP BY build_id")
def live_log_bytes_stream(spark, d):
    logs = events_stream(spark, d).where("kind = 'log'").selectExpr("worker_id AS build_id", "ts", "bytes")
    return streams.drained(streams.live_log_bytes(logs))


_STATES = "SELECT seq % 700 AS dedupe_key, CASE WHEN kind = 'result_ok' THEN 'finished' ELSE 'running' END AS phase, ts AS updated_at, seq AS build_id FROM messages"


@query(f"""WITH s AS ({_STATES}), n AS (SELECT *, row_number() OVER (PARTITION BY dedupe_key ORDER BY phase = 'finished' DESC, updated_at DESC, build_id DESC) AS n FROM s)
  SELECT dedupe_key, phase, updated_at, build_id FROM n WHERE n = 1""")
def latest_state_stream(spark, d):
    path = fresh_path(spark, "states")
    states = events_stream(spark, d).selectExpr("seq % 700 AS dedupe_key", "CASE WHEN kind = 'result_ok' THEN 'finished' ELSE 'running' END AS phase", "ts AS updated_at", "seq AS build_id")
    upserts.latest_state_stream(states, f"{path}/table").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return upserts.upserted(spark, f"{path}/table", states.schema)


@query()
def requeues_stream(spark, d):
    lost = events_stream(spark, d).selectExpr("worker_id AS job_id", "ts", "seq", "CASE kind WHEN 'result_failed' THEN 'lost' ELSE kind END AS kind")
    rule = lambda events: twins.requeues(events, 3600)
    path = fresh_path(spark, "requeues")
    run = upserts.by_batch(lost, rule, f"{path}/table", f"{path}/events").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return upserts.upserted(spark, f"{path}/table", rule(spark.createDataFrame([], lost.schema)).schema)


ORACLE_SQL["requeues_stream"] = ORACLE_SQL["requeues"]

#: How far the streams' watermarks stay behind; they announce what is sure by then.
LATE = "1 hour"
_SURE = "(SELECT max(ts) - INTERVAL 1 HOURS FROM {})"


def _announced(spark: SparkSession, d: str, name: str, make, end: str | None = None) -> DataFrame:
    """Rows of a stream with timers, over all that is there, with times as in the tables; with an
    ``end``, ``make`` also gets the moments that move the clock."""
    got = timed.settled(lambda own, *moments: make(events_stream(own, d).withColumn("ts", F.col("ts").cast("timestamp")), *moments), spark, fresh_path(spark, name), end)
    return got.withColumns({c: F.col(c).cast("timestamp_ntz") for c, kind in got.dtypes if kind == "timestamp"})


@query(_GONE.format(_SURE.format("s")))
def abandoned_stream(spark, d):
    def make(messages):
        subs = messages.where("kind IN ('request_job', 'result_failed')")
        return timed.abandoned(subs.selectExpr("worker_id AS build_id", "ts", "seq", "CASE kind WHEN 'request_job' THEN 1 ELSE -1 END AS change"), 6 * 3600, LATE, 400 * 86_400)

    return _announced(spark, d, "abandoned", make)


_DEADLINE = "TIMESTAMP '2024-01-25 00:00:00'"


@query(f"""WITH t AS (SELECT *, {_DEADLINE} AS deadline, sum(bytes) OVER (PARTITION BY build_id ORDER BY ts, seq {_UPTO}) AS log_bytes, lead(ts) OVER (PARTITION BY build_id ORDER BY ts, seq) AS next,
    coalesce(last_value(CASE WHEN bytes > 0 THEN ts END IGNORE NULLS) OVER (PARTITION BY build_id ORDER BY ts, seq {_BEFORE}), first_value(ts) OVER (PARTITION BY build_id ORDER BY ts, seq)) AS heard,
    coalesce(last_value(CASE WHEN bytes > 0 THEN ts END IGNORE NULLS) OVER (PARTITION BY build_id ORDER BY ts, seq {_UPTO}), first_value(ts) OVER (PARTITION BY build_id ORDER BY ts, seq)) + INTERVAL 120 HOURS AS quiet FROM ticks),
  r AS (SELECT build_id, ts, 0 AS place, seq, CASE WHEN cancelled THEN 'cancelled' WHEN ts >= deadline THEN 'timed out' WHEN log_bytes > 1048576 THEN 'log size' WHEN ts - heard > INTERVAL 120 HOURS THEN 'silence' END AS reason FROM t
    UNION ALL SELECT build_id, least(deadline, quiet), 1, seq, CASE WHEN deadline <= quiet THEN 'timed out' ELSE 'silence' END FROM t WHERE next IS NULL OR next > least(deadline, quiet)),
  n AS (SELECT *, row_number() OVER (PARTITION BY build_id ORDER BY ts, place, seq) AS n FROM r WHERE reason IS NOT NULL AND ts <= {_SURE.format('ticks')}) SELECT build_id, ts, reason FROM n WHERE n = 1""")
def abort_reasons_stream(spark, d):
    def make(messages):
        ticks = messages.selectExpr("worker_id AS build_id", "ts", "seq", "CASE WHEN kind = 'log' THEN bytes ELSE 0 END AS bytes", "seq % 997 = 0 AS cancelled", f"cast({_DEADLINE} AS timestamp) AS deadline")
        return timed.abort_reasons(ticks, 1 << 20, 120 * 3600, LATE, 400 * 86_400)

    return _announced(spark, d, "aborts", make)


@query()
def admissions_stream(spark, d):
    def make(messages, moments):
        submits = messages.where("kind = 'log'").selectExpr("seq AS job_id", "worker_id % 40 AS system", "ts")
        opened = messages.where("kind = 'request_job'").selectExpr("worker_id % 40 AS system", "ts AS opens", "ts + INTERVAL 1 HOURS AS closes")
        return timed.admissions(submits, opened, 7200, LATE, moments=moments)

    # the table is all there is, so that what the watermark leaves open at its end is decided as well
    return _announced(spark, d, "admissions", make, "2200-01-01 00:00:00")


ORACLE_SQL["admissions_stream"] = ORACLE_SQL["admissions"]


@query(f"""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY worker_id ORDER BY ts) > INTERVAL 12 HOURS THEN 1 ELSE 0 END AS fresh FROM messages),
  s AS (SELECT *, sum(fresh) OVER (PARTITION BY worker_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
  SELECT worker_id AS worker, min(ts) AS started, max(ts) AS last_seen, count(*) AS messages FROM s GROUP BY worker_id, session HAVING max(ts) + INTERVAL 12 HOURS <= {_SURE.format('messages')}""")
def silent_workers_stream(spark, d):
    return _announced(spark, d, "silent", lambda messages: streams.silent_workers(messages.selectExpr("worker_id AS worker", "ts"), 43_200, LATE))


@query(f"SELECT DISTINCT dedupe_key FROM ({_DELIVERED})")
def dedupe_results_stream(spark, d):
    def make(messages):
        results = messages.where("kind IN ('result_ok', 'result_failed')").selectExpr("seq % 700 AS dedupe_key", "ts", "seq")
        return streams.dedupe_results(results, "400 days").select("dedupe_key")

    return _announced(spark, d, "deliveries", make)


@query(f"""WITH f AS ({_FINISHED}), a AS ({_ACKS}) SELECT result_id, finished_at FROM f WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.result_id = f.result_id AND acked_at >= finished_at AND acked_at <= finished_at + INTERVAL 12 HOURS)
  AND finished_at + INTERVAL 12 HOURS <= least((SELECT max(finished_at) FROM f), (SELECT max(acked_at) FROM a)) - INTERVAL 1 HOURS""")
def expired_results_stream(spark, d):
    def make(messages):
        finished = messages.where("kind = 'result_ok'").selectExpr("worker_id AS result_id", "ts AS finished_at")
        return streams.expired_results(finished, messages.where("kind = 'heartbeat'").selectExpr("worker_id AS result_id", "ts AS acked_at"), 43_200, LATE)

    return _announced(spark, d, "expired", make)


@query("""WITH l AS (SELECT worker_id AS build_id, strlen('log ' || seq || chr(10)) AS n FROM messages WHERE kind = 'log')
  SELECT build_id, cast(sum(n) AS bigint) AS bytes, cast(sum(n) AS bigint) AS upto FROM l GROUP BY build_id""")
def tail_growing_logs_stream(spark, d):
    """Logs are read when a part of their lines is there, and again when all are, from the byte on at which the first run ended."""
    path = fresh_path(spark, "growing")
    lines = view(spark, d, "SELECT worker_id AS build_id, seq, 'log ' || cast(seq AS string) || chr(10) AS data FROM messages WHERE kind = 'log'")
    half = lines.groupBy("build_id").agg(F.percentile_approx("seq", 0.5).alias("half"))
    for there in (lines.join(half, "build_id").where("seq <= half").drop("half"), lines):
        logtail.write_logs(there, f"{path}/logs")
        new = logtail.tail_growing_logs(spark, f"{path}/logs").select("build_id", "at", F.octet_length("data").alias("n"))
        new.writeStream.format("parquet").option("path", f"{path}/read").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    read = spark.read.schema("build_id string, at bigint, n int").parquet(f"{path}/read")
    return read.groupBy(F.col("build_id").cast("bigint").alias("build_id")).agg(F.sum("n").cast("bigint").alias("bytes"), F.max(F.col("at") + F.col("n")).alias("upto"))


_CONNECTED = "SELECT worker_id AS session, ts, seq, 'w' || cast(worker_id % 50 AS string) AS worker_name, worker_id % 2 = 0 AS arm, kind <> 'result_failed' AS open FROM messages"


@query(f"""WITH j AS (SELECT kind, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, seq DESC) AS n FROM lifecycle),
  t AS ({_CONNECTED}), o AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts DESC, seq DESC) AS n FROM t),
  s AS (SELECT session, worker_name, 'x86_64-linux' AS system FROM o WHERE n = 1 AND open UNION ALL SELECT session, worker_name, 'aarch64-linux' FROM o WHERE n = 1 AND open AND arm),
  g AS (SELECT 'queue_depth' AS metric, NULL AS worker, NULL AS system, count(*) AS value FROM j WHERE n = 1 AND kind IN ('submitted', 'requeued')
    UNION ALL SELECT 'workers_connected', NULL, NULL, count(*) FROM o WHERE n = 1 AND open
    UNION ALL SELECT DISTINCT 'builder_up', worker_name, system, 1 FROM s
    UNION ALL SELECT 'workers_for_system', NULL, system, count(*) FROM s GROUP BY system)
  SELECT metric, worker, system, cast(value AS bigint) AS value FROM g WHERE value > 0""")
def live_gauges_stream(spark, d):
    def entities(own):
        messages = events_stream(own, d)
        systems = F.when(F.col("open"), F.when(F.col("arm"), F.array(F.lit("x86_64-linux"), F.lit("aarch64-linux"))).otherwise(F.array(F.lit("x86_64-linux"))))
        sessions = messages.selectExpr(*_projection(_CONNECTED)).withColumn("systems", systems)
        return gauges.job_rows(messages.selectExpr(*_projection(VIEWS["lifecycle"]))).unionByName(gauges.session_rows(sessions))

    return gauges.live_gauges(entities, spark, fresh_path(spark, "gauges"))
