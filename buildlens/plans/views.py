"""Views over the driver's tables that give every operator an input. The SQL is common to
Spark and the oracle."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    "store_paths": """SELECT p_partkey AS path_id, '/nix/store/' || translate(md5(cast(p_partkey AS string)), 'e', 'z') || '-part-' || cast(p_partkey AS string) AS path,
        cast(p_size AS bigint) * 1024 AS nar_size FROM part""",
    "refs": """SELECT p_partkey AS referrer, cast(floor(p_partkey / 2) AS bigint) AS reference FROM part
        UNION SELECT p_partkey, cast(floor(p_partkey / 3) AS bigint) FROM part
        UNION SELECT p_partkey, p_partkey FROM part WHERE p_partkey % 10 = 0""",
    "jobs": """SELECT o_orderkey AS job_id, o_orderdate AS submitted_at, o_orderstatus AS phase,
        CASE o_orderkey % 3 WHEN 0 THEN 'x86_64-linux' WHEN 1 THEN 'aarch64-linux' ELSE 'x86_64-darwin' END AS system FROM orders""",
    "job_features": """SELECT o_orderkey AS job_id, 'kvm' AS feature FROM orders WHERE o_orderkey % 4 = 0
        UNION ALL SELECT o_orderkey, 'big-parallel' FROM orders WHERE o_orderkey % 5 = 0
        UNION ALL SELECT o_orderkey, 'uid-range' FROM orders WHERE o_orderkey % 7 = 0""",
    "workers": "SELECT s_suppkey AS worker_id, s_name AS worker_name, cast(s_suppkey % 8 + 1 AS int) AS max_jobs FROM supplier",
    "worker_systems": """SELECT s_suppkey AS worker_id, 'x86_64-linux' AS system FROM supplier
        UNION ALL SELECT s_suppkey, 'aarch64-linux' FROM supplier WHERE s_suppkey % 2 = 0""",
    "worker_features": """SELECT s_suppkey AS worker_id, 'x86_64-linux' AS system, 'kvm' AS feature FROM supplier WHERE s_suppkey % 2 = 1
        UNION ALL SELECT s_suppkey, 'x86_64-linux', 'uid-range' FROM supplier WHERE s_suppkey % 5 = 0
        UNION ALL SELECT s_suppkey, 'x86_64-linux', 'big-parallel' FROM supplier WHERE s_suppkey % 3 <> 0
        UNION ALL SELECT s_suppkey, 'aarch64-linux', 'big-parallel' FROM supplier WHERE s_suppkey % 2 = 0""",
    "offers": "SELECT DISTINCT l_orderkey AS job_id, l_partkey AS path_id FROM lineitem",
    "claims": "SELECT o.job_id, o.path_id, j.submitted_at FROM offers o JOIN jobs j ON o.job_id = j.job_id",
    "valid_now": "SELECT p_partkey AS path_id FROM part WHERE p_partkey % 3 <> 0",
    "flows": """SELECT event_id AS flow_id, ts, CASE event_id % 3 WHEN 0 THEN 6 WHEN 1 THEN 17 ELSE 1 END AS proto,
        CASE event_id % 5 WHEN 0 THEN '10.0.' || cast(event_id % 256 AS string) || '.7' WHEN 1 THEN '192.0.2.' || cast(event_id % 256 AS string)
        WHEN 2 THEN '127.0.0.1' WHEN 3 THEN '100.' || cast(event_id % 256 AS string) || '.1.1' ELSE '93.184.216.' || cast(event_id % 256 AS string) END AS ip,
        cast((event_id * 37) % 9000 AS int) AS port FROM events""",
    "messages": """SELECT event_id AS seq, ts, user_id AS worker_id, CASE event_type WHEN 'view' THEN 'heartbeat' WHEN 'click' THEN 'log'
        WHEN 'signup' THEN 'request_job' WHEN 'purchase' THEN 'result_ok' ELSE 'result_failed' END AS kind,
        cast(floor(value * 1024) AS bigint) AS bytes FROM events""",
    "chunks": """SELECT conv_id AS path_id, turn AS seq, text AS chunk, turn = max(turn) OVER (PARTITION BY conv_id) AS eof FROM conversations""",
    "bodies": "SELECT doc_id, text AS content FROM documents",
    "candidates": "SELECT item_id, substr(text, 1, 32) AS token FROM benchmark",
    "requested": """SELECT l_orderkey AS job_id, l_linenumber AS pos, CASE WHEN l_orderkey % 50 = 0 AND l_linenumber = 1 THEN l_partkey + 1000000 ELSE l_partkey END AS path_id FROM lineitem""",
    "reported": """SELECT job_id, path_id FROM offers WHERE path_id % 7 <> 0 UNION ALL SELECT job_id, path_id + 5000000 FROM offers WHERE path_id % 11 = 0""",
    "phased": "SELECT o.path_id, j.job_id AS build, cast(j.job_id % 5 AS int) AS phase FROM offers o JOIN jobs j ON o.job_id = j.job_id",
    "lifecycle": """SELECT seq, ts, worker_id AS job_id, CASE WHEN seq % 17 = 0 THEN 'requeued' WHEN kind = 'heartbeat' THEN 'submitted' WHEN kind = 'log' THEN 'dispatched'
        WHEN kind = 'request_job' THEN 'declined' WHEN kind = 'result_ok' THEN 'succeeded' ELSE 'failed' END AS kind, seq % 10 = 0 AS duplicate FROM messages""",
    "attach": """SELECT seq, ts, seq % 2500 AS build_id, CASE kind WHEN 'result_ok' THEN 'exit_code' WHEN 'result_failed' THEN 'error' ELSE 'log' END AS kind, bytes FROM messages""",
    "builds": """SELECT o_orderkey AS job_id, o_custkey AS key, o_orderdate AS submitted_at, o_orderdate + INTERVAL 60 DAYS AS finished_at FROM orders""",
    "holders": """SELECT DISTINCT o_orderkey AS job_id, o_custkey AS key, l_partkey AS output, o_orderdate AS started_at, o_orderdate + INTERVAL 1 DAYS AS finished_at
        FROM orders JOIN lineitem ON o_orderkey = l_orderkey""",
    "staged": """SELECT seq, worker_id AS build_id, seq % 4 AS path_id, seq % 13 <> 0 AS requested,
        CASE kind WHEN 'heartbeat' THEN 'metadata' WHEN 'log' THEN 'chunk' WHEN 'request_job' THEN 'path_end' WHEN 'result_ok' THEN 'result' ELSE CASE WHEN seq % 2 = 0 THEN 'output' ELSE 'closed' END END AS kind FROM messages""",
    "ticks": """SELECT worker_id AS build_id, ts, seq, CASE WHEN kind = 'log' THEN bytes ELSE 0 END AS bytes, seq % 997 = 0 AS cancelled FROM messages""",
}


def _used(sql: str) -> list[str]:
    """Views and tables that a query uses, each behind what it uses itself."""
    out: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"(?:FROM|JOIN)\s+(\w+)", text):
            if name in VIEWS and name not in out:
                visit(VIEWS[name])
                if name not in out:
                    out.append(name)
            elif name in TABLES and name not in out:
                out.append(name)

    visit(sql)
    return out


def with_views(sql: str) -> str:
    """The oracle's query: the tables are there, the views are defined in front."""
    views = [v for v in _used(sql) if v in VIEWS]
    if not views:
        return sql
    head = "WITH RECURSIVE " if sql.startswith("WITH RECURSIVE ") else "WITH "
    own = sql.removeprefix(head)
    return head + ",\n".join(f"{v} AS ({VIEWS[v]})" for v in views) + (f",\n{own}" if own != sql else f"\n{sql}")


#: Views that take the distinct rows of ``lineitem``, and rows that one task gets of it there.
DISTINCT, ROWS = ("offers", "holders"), 1 << 18


def parts(spark: SparkSession, sf_dir: str, table: str = "lineitem") -> int:
    """Partitions for the rows of a table, which grow with it, so that what a task holds does not; never fewer
    than the session's own. Rows are counted from the files' footers."""
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet").count()
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS))


def view(spark: SparkSession, sf_dir: str, sql: str, deal: str = "l_orderkey") -> DataFrame:
    """A view, or a query over views and tables, on Spark. Where views take distinct rows of ``lineitem``, it is first dealt
    out by ``deal``; so distinct rows, and joins by just those columns, need no further exchange."""
    if re.fullmatch(r"\w+", sql):
        sql = f"SELECT * FROM {sql}"
    used = _used(sql)
    hints = {"lineitem": f"/*+ REPARTITION({parts(spark, sf_dir)}, {deal}) */ "} if any(v in used for v in DISTINCT) else {}
    heads = [f"{n} AS ({VIEWS[n]})" if n in VIEWS else f"{n} AS (SELECT {hints.get(n, '')}* FROM parquet.`{sf_dir}/{n}.parquet`)" for n in used]
    return spark.sql("WITH " + ",\n".join(heads) + f"\n{sql}")
