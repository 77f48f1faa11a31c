"""Rules on hand-made rows, with cases at, one below and one above each limit."""

import datetime as dt
import hashlib
import ipaddress
import json
import random
import struct

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from buildlens.functions import network as net
from buildlens.functions import scalars as fn
from buildlens.operators import events as ev
from buildlens.operators import graph, identity, matching, metrics, policy, staging, validate
from buildlens.sources import readers, sinks
from buildlens.sources.schemas import ATTACH_EVENT, BUILD_REQUEST, PATH_INFO, WORKER_MESSAGE, WORKER_PAYLOADS
from buildlens.streaming import twins

H = "0" * 32
RULES = "rule_idx int, action string, proto string, dst string, ports array<string>"
FLOWS = "flow_id bigint, proto int, ip string, port int"


def values(df, *cols):
    return sorted(tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.collect())


def decide(spark, rules, flows, default="allow"):
    ok, bad = policy.compile_policy(spark.createDataFrame(rules, RULES))
    assert bad.count() == 0
    got = policy.decide_flows(spark.createDataFrame([(i, *f) for i, f in enumerate(flows)], FLOWS), ok, default)
    return [r.action for r in got.orderBy("flow_id").collect()]


def test_first_match_wins(spark):
    rules = [(0, "allow", "tcp", "192.0.2.0/24", ["443", "8000-8999"]), (1, "deny", None, "192.0.2.7", None)]
    flows = [(6, "192.0.2.7", 443), (6, "192.0.2.7", 8500), (6, "192.0.2.7", 80), (17, "192.0.2.7", 443), (6, "192.0.3.1", 443)]
    assert decide(spark, rules, flows, "deny") == ["allow", "allow", "deny", "deny", "deny"]


def test_keywords_and_version_6(spark):
    rules = [(0, "deny", "any", "private", []), (1, "deny", "tcp", "2001:db8::/32", ["25"])]
    flows = [(6, ip, 80) for ip in ("10.1.2.3", "127.0.0.1", "fd00::1", "::ffff:10.1.2.3", "::ffff:127.0.0.1", "::ffff:93.184.216.34")]
    flows += [(6, "2001:db8::5", 25), (6, "2001:db8::5", 443), (6, "93.184.216.34", 80)]
    assert decide(spark, rules, flows) == ["deny"] * 5 + ["allow", "deny", "allow", "allow"]


def test_bad_rules_are_rejected(spark):
    rows = [(0, "deny", "any", "not-an-ip", []), (1, "deny", "any", "10.0.0.0/33", []), (2, "deny", "any", "any", ["80-70"]), (3, "deny", "any", "any", ["70000"]), (4, "drop", "any", "any", []), (5, "deny", "any", "::/129", [])]
    ok, bad = policy.compile_policy(spark.createDataFrame(rows, RULES))
    assert ok.count() == 0
    assert [r.reason for r in bad.orderBy("rule_idx").collect()] == ["bad destination", "bad prefix length", "bad port range", "bad port range", "bad action", "bad prefix length"]


def test_many_rules_equal_a_naive_loop(spark, monkeypatch):
    rng = random.Random(0)
    v4 = lambda: ".".join(str(rng.choice([0, 1, 10, 255])) for _ in range(4))
    v6 = lambda: str(ipaddress.IPv6Address(rng.choice([0, 1, 0xFD << 120, 0x20010DB8 << 96, 0xFFFF0A000001]) + rng.randrange(3)))
    rules = []
    for i in range(60):
        ip = v4() if i % 3 else v6()
        top = 32 if i % 3 else 128
        dst = rng.choice(["any", "private", f"{ip}/{rng.choice([1, 7, 8, 9, 24, 30, top])}", ip]) if i % 7 == 0 else f"{ip}/{rng.choice([7, 8, 9, 24, 30, top])}"
        rules.append((i, rng.choice(["allow", "deny"]), rng.choice(["any", "tcp", "udp"]), dst, rng.choice([[], ["80"], ["1-100", "443"]])))
    flows = [(rng.choice([6, 17, 1]), v4() if i % 2 else v6(), rng.choice([80, 443, 101])) for i in range(80)]

    def naive(f):
        ip = ipaddress.ip_address(f[1])
        ip = getattr(ip, "ipv4_mapped", None) or ip
        for _, action, proto, dst, ports in rules:
            if {"any": True, "tcp": f[0] == 6, "udp": f[0] == 17}[proto] and (not ports or any(int(p.split("-")[0]) <= f[2] <= int(p.split("-")[-1]) for p in ports)):
                if dst == "any" or (dst == "private" and private(ip)) or (dst not in ("any", "private") and ip in ipaddress.ip_network(dst, strict=False)):
                    return action
        return "allow"

    def private(ip):
        nets = "0.0.0.0/32 10.0.0.0/8 100.64.0.0/10 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.168.0.0/16 224.0.0.0/4 255.255.255.255/32 ::/127 fc00::/7 fe80::/10 ff00::/8"
        return any(ip in ipaddress.ip_network(n) for n in nets.split())

    want = [naive(f) for f in flows]
    assert decide(spark, rules, flows) == want
    monkeypatch.setattr(policy, "BROADCAST_RULES", 5)
    assert decide(spark, rules, flows) == want


def test_address_keys(spark):
    good = ["::", "::1", "1::", "1:2:3:4:5:6:7:8", "fe80::1:2", "::ffff:1.2.3.4", "64:ff9b::1.2.3.4", "1.2.3.4", "0.0.0.0", "A:b::C"]
    bad = ["", "1.2.3", "1.2.3.256", "01.2.3.4", "1:2", "1:::2", "1::2::3", "g::", "1:2:3:4:5:6:7:8:9", "12345::", " ::1", "::1\n", ":1"]
    df = spark.createDataFrame([(s,) for s in good + bad], "ip string").select("ip", net.address_key(F.col("ip")).alias("key"))
    got = {r.ip: r.key for r in df.collect()}
    for s in good:
        assert got[s] == format(int(ipaddress.ip_address(s)), "08x" if "." in s and ":" not in s else "032x"), s
    assert {s: got[s] for s in bad} == dict.fromkeys(bad)


def test_store_paths(spark):
    good = [f"/nix/store/{H}-foo", f"/nix/store/{H}-foo_1.2+x?=y", f"/nix/store/{H}-.hidden"]
    bad = ["/nix/store/abc-foo", "/nix/store/", "/nix/store/..", f"/nix/store/{H}-abc/../../etc", f"/nix/store/{H}-abc/bin/sh", "/etc/shadow", f"/nix/storeX/{H}-abc", f'/nix/store/{H}-a")(allow', f"/nix/store/{H}-a\nb", f"/nix/store/{H}-a,b", f"/nix/store/{H}-ab\n", None]
    df = spark.createDataFrame([(p,) for p in good + bad], "p string").select("p", fn.is_store_path(F.col("p")).alias("ok"))
    assert {r.p: r.ok for r in df.collect()} == {**dict.fromkeys(good, True), **dict.fromkeys(bad, False)}


REQUEST = ("x86_64-linux", "/bin/sh", ["-c"], {}, {"out": f"/nix/store/{H}-out"}, [f"/nix/store/{H}-in"], "/build", "/nix/store", False, None)


def request(**changes):
    names = [c.strip().split()[0] for c in "system, builder, args, env, outputs, input_paths, tmp_dir_in_sandbox, store_dir, fixed_output, submitted_at".split(",")]
    return tuple({**dict(zip(names, REQUEST, strict=True)), **changes}.values())


def test_request_rules_in_order(spark):
    a = f"/nix/store/{H}-in"
    cases = [
        (request(), None),
        (request(outputs={}, store_dir="/x"), "no outputs"),
        (request(store_dir="/x", builder="sh"), "invalid store dir"),
        (request(input_paths=[a, a, "/etc"]), "input: duplicate"),
        (request(input_paths=["/etc", a, a]), "input: bad path"),
        (request(outputs={"a": a}), "output: also an input"),
        (request(outputs={"a": f"/nix/store/{H}-o", "b": f"/nix/store/{H}-o"}), "output: duplicate"),
        (request(outputs={"a": "x"}, builder="sh"), "output: bad path"),
        (request(builder="sh"), "builder not absolute"),
        (request(tmp_dir_in_sandbox="build"), "invalid tmp dir"),
        (request(tmp_dir_in_sandbox="/a/../b"), "invalid tmp dir"),
        (request(tmp_dir_in_sandbox="/nix/store/x"), "invalid tmp dir"),
        (request(tmp_dir_in_sandbox="/private/tmp/x..y"), None),
    ]
    df = validate.validate_requests(spark.createDataFrame([c[0] for c in cases], BUILD_REQUEST))
    assert [r.reject_reason for r in df.collect()] == [c[1] for c in cases]


def test_assignments(spark):
    ids = [("0123456789abcdefABCDEF0123456789", None), ("../../../../etc", "invalid build id"), ("/etc", "invalid build id"), ("0123", "invalid build id"), ("", "invalid build id")]
    df = spark.createDataFrame([(i, "/bin/sh", "/build", {"out": f"/nix/store/{H}-o"}) for i, _ in ids], "build_id string, builder string, tmp_dir_in_sandbox string, outputs map<string,string>")
    assert [r.reject_reason for r in validate.validate_assignments(df).collect()] == [w for _, w in ids]


def naive_key(r):
    h = hashlib.sha256()
    feed = lambda s: h.update(struct.pack("<Q", len(s.encode())) + s.encode())
    count = lambda n: h.update(struct.pack("<Q", n))
    feed(r[0]), feed(r[1]), count(len(r[2])), [feed(x) for x in r[2]]
    for m in (r[3], r[4]):
        count(len(m))
        for k in sorted(m):
            feed(k), feed(m[k])
    count(len(r[5])), [feed(x) for x in sorted(r[5])], feed(r[7]), feed(r[6]), h.update(bytes([r[8]]))
    return h.hexdigest()


words = st.text(st.characters(codec="utf-8", exclude_categories=["Cs"], exclude_characters="\x00"), max_size=6)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(words, st.lists(words, max_size=3), st.dictionaries(words, words, max_size=3), st.booleans()), min_size=1, max_size=5))
def test_dedupe_key_bytes(spark, cases):
    rows = [request(system=s, args=a, env=e, input_paths=a, fixed_output=f) for s, a, e, f in cases]
    got = [r.key for r in identity.dedupe_key(spark.createDataFrame(rows, BUILD_REQUEST)).collect()]
    assert got == [naive_key(r) for r in rows]


def test_sections_cannot_collide(spark):
    rows = [request(args=["-c", "K", "V"], env={}), request(args=["-c"], env={"K": "V"})]
    a, b = [r.key for r in identity.dedupe_key(spark.createDataFrame(rows, BUILD_REQUEST)).collect()]
    assert a != b


def test_features(spark):
    envs = [({"requiredSystemFeatures": "kvm big-parallel"}, ["kvm", "big-parallel"]), ({"__json": '{"requiredSystemFeatures":["kvm", 3]}'}, ["kvm"]), ({}, []), ({"requiredSystemFeatures": " ", "__json": '{"requiredSystemFeatures":["kvm"]}'}, []), ({"__json": "x"}, []), ({"__json": '{"requiredSystemFeatures":"kvm"}'}, [])]
    df = spark.createDataFrame([(e,) for e, _ in envs], "env map<string,string>").select(fn.required_features(F.col("env")).alias("f"))
    assert [r.f for r in df.collect()] == [w for _, w in envs]


def test_labels(spark):
    cases = ['a"b\nc\\d', "x" * 300, "é" * 300, "", "x" * 128, "x" * 127 + "é"]
    want = ['a\\"b\\nc\\\\d', "x" * 128, "é" * 64, "", "x" * 128, "x" * 127]
    df = spark.createDataFrame([(c,) for c in cases], "v string").select(fn.label_value(F.col("v")).alias("v"))
    assert [r.v for r in df.collect()] == want


def test_capabilities_do_not_leak_across_systems(spark):
    caps = spark.createDataFrame([("w", "x86_64-linux", ["kvm"]), ("w", "aarch64-linux", [])], "worker string, system string, have array<string>")
    jobs = spark.createDataFrame([(1, "x86_64-linux", ["kvm"]), (2, "aarch64-linux", ["kvm"]), (3, "aarch64-linux", []), (4, "x86_64-linux", ["kvm", "big"])], "job_id bigint, system string, features array<string>")
    assert values(matching.match_workers(jobs, caps), "job_id") == [1, 3]
    assert values(matching.count_matches(jobs, caps), "job_id", "n_workers") == [(1, 1), (2, 0), (3, 1), (4, 0)]
    assert values(matching.first_eligible(jobs.withColumn("position", -F.col("job_id")), caps), "worker", "job_id") == [("w", 3)]
    now = dt.datetime(2024, 1, 1)
    queued = jobs.withColumn("requeued_at", F.when(F.col("job_id") == 2, F.lit(now - dt.timedelta(seconds=29))).when(F.col("job_id") == 4, F.lit(now - dt.timedelta(seconds=30))))
    assert values(matching.unservable(queued, caps, F.lit(now), 30), "job_id") == [4]


def test_expected_deadline(spark):
    t = dt.datetime(2024, 1, 1)
    s = lambda n: t + dt.timedelta(seconds=n)
    gone = spark.createDataFrame([("x", ["kvm"], s(100)), ("x", ["kvm"], s(110)), ("x", [], s(115))], "system string, have array<string>, departed_at timestamp")
    jobs = spark.createDataFrame([(1, s(29), "y", []), (2, s(120), "x", ["kvm"]), (3, s(120), "x", ["big"]), (4, s(140), "x", ["kvm"]), (5, s(139), "x", ["kvm"])], "job_id bigint, submitted_at timestamp, system string, features array<string>")
    got = matching.expected_deadline(jobs, gone, F.lit(t), 30)
    assert values(got.where("deadline is not null"), "job_id", "deadline") == [(1, s(30)), (2, s(140)), (5, s(140))]


def test_signers_none_and_empty(spark, tmp_path):
    regs = spark.createDataFrame([("a",), ("b",)], "signing_public_key string")
    assert values(matching.check_signers(regs, None), "trusted") == [True, True]
    assert readers.read_trusted_keys(spark, str(tmp_path / "none")) is None
    (tmp_path / "keys").write_text("\n # all\n\n")
    assert values(matching.check_signers(regs, readers.read_trusted_keys(spark, str(tmp_path / "keys"))), "trusted") == [False, False]
    (tmp_path / "more").write_text("  a \n#b\n")
    assert values(matching.check_signers(regs, readers.read_trusted_keys(spark, str(tmp_path / "more"))), "signing_public_key", "trusted") == [("a", True), ("b", False)]


def test_peers(spark):
    peers = spark.createDataFrame([("a.tail.net", ["t"]), ("b", [])], "node_name string, tags array<string>")
    assert values(validate.admit_peers(peers, []), "name") == ["a", "b"]
    assert values(validate.admit_peers(peers, ["t"]), "name") == ["a"]


def test_capacity(spark):
    schema = "session string, worker_name string, systems array<string>, max_jobs int"
    two = spark.createDataFrame([("1", "a", ["x", "y"], 100), ("2", "b", ["x"], 50)], schema)
    assert [tuple(r) for r in metrics.fleet_capacity(two).collect()] == [(["x", "y"], 256)]
    assert [tuple(r) for r in metrics.fleet_capacity(two, 10, 256).collect()] == [(["x", "y"], 15)]
    assert [tuple(r) for r in metrics.fleet_capacity(two.limit(0)).collect()] == [([], None)]
    assert [tuple(r) for r in metrics.fleet_capacity(two.withColumn("max_jobs", F.lit(1)), 1).collect()] == [(["x", "y"], 1)]


def test_snapshot_is_written_on_change_only(spark, tmp_path):
    df, path = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "n int, s string"), str(tmp_path / "snap")
    assert [sinks.write_if_changed(d, path) for d in (df, df, df.limit(1), df.limit(1))] == [True, False, True, False]


def test_metrics_text(spark):
    regs = spark.createDataFrame([("1", 'a"b', ["x"], 1)], "session string, worker_name string, systems array<string>, max_jobs int")
    life = spark.createDataFrame([("submitted", False), ("submitted", True), ("failed", False)], "kind string, duplicate boolean")
    depth = spark.createDataFrame([(3,)], "depth bigint")
    lines = [r.line for r in metrics.metrics_text(metrics.metrics_table(ev.lifecycle_counters(life), depth, regs)).collect()]
    assert lines[:3] == ["# HELP fleet_builds_submitted_total Builds accepted.", "# TYPE fleet_builds_submitted_total counter", "fleet_builds_submitted_total 1"]
    assert 'fleet_builder_up{worker="a\\"b",system="x"} 1' in lines and "fleet_queue_depth 3" in lines and 'fleet_workers_for_system{system="x"} 1' in lines


def test_requested_paths(spark):
    offers = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "job_id bigint, path_id string")
    asked = spark.createDataFrame([(1, 0, "b"), (1, 1, "a"), (1, 2, "b"), (2, 0, "a"), (2, 1, "z")], "job_id bigint, pos int, path_id string")
    good, bad = staging.check_requested(offers, asked)
    assert values(good, "job_id", "pos", "path_id") == [(1, 0, "b"), (1, 1, "a")] and values(bad, "job_id") == [2]


def test_reference_scan(spark):
    a, b, c = ("/nix/store/" + x * 32 for x in "abc")
    contents = spark.createDataFrame([(1, f"x {b}-in y{a}-self"), (2, "0" * 40)], "content_id bigint, content string")
    tokens = spark.createDataFrame([(1, "a" * 32), (3, "b" * 32), (4, "c" * 32), (5, "0" * 32)], "item_id bigint, token string")
    assert values(staging.scan_references(contents, tokens), "content_id", "item_id") == [(1, 3), (2, 5)]
    assert c


def test_pins(spark):
    valid = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (5, "e")], "id bigint, path string")
    refs = spark.createDataFrame([(1, 2), (2, 3), (5, 5)], "referrer bigint, reference bigint")
    offer = spark.createDataFrame([(p,) for p in "abcde"], "path string")
    assert values(graph.pin_plan(offer, valid, refs).where("pinned"), "path") == ["a", "d", "e"]


@pytest.mark.parametrize("seed", [0, 1])
def test_levels(spark, seed):
    rng = random.Random(seed)
    edges = {(a, b) for a, b in ((rng.randrange(14), rng.randrange(16)) for _ in range(16))} | {(1, 1)}
    if seed:
        edges |= {(2, 3), (3, 2)}
    got = {r.node: r.level for r in graph.topo_levels(spark.createDataFrame([(i,) for i in range(14)], "node bigint"), spark.createDataFrame(sorted(edges), "referrer bigint, reference bigint")).collect()}
    assert sorted(got) == list(range(14))
    reach = {a: {b for x, b in edges if x == a} for a in range(16)}
    for _ in range(16):
        reach = {a: r | {c for b in r for c in reach[b]} for a, r in reach.items()}
    for a, b in edges:
        if a != b and b < 14:
            assert got[b] < got[a] or (got[a] == got[b] and any(a in reach[x] and x in reach[b] or x in reach[x] for x in range(14)))
    if not seed:
        assert graph.cyclic_nodes(spark.createDataFrame([(0,), (1,)], "node bigint"), spark.createDataFrame([(0, 1), (1, 1)], "referrer bigint, reference bigint")).count() == 0


def test_closure_and_extras(spark):
    edges = spark.createDataFrame([("o", "a"), ("a", "b"), ("b", "c"), ("c", "a"), ("b", "i"), ("i", "z"), ("o", "p")], "referrer string, reference string")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "path_id string")
    got = graph.extras(ids("a", "i", "p"), ids("i"), ids("o", "p"), edges, ids("a", "b"))
    assert values(got, "path_id", "error") == [("a", False), ("b", False), ("c", True)]
    assert values(graph.closure(ids("a"), edges, ids("i")), "path_id", "depth") == [("a", 0), ("b", 1), ("c", 2)]


def test_staging_audit(spark):
    needs = spark.createDataFrame([(0, "a"), (1, "b"), (1, "a"), (2, "c")], "phase int, path_id string")
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "b"), ("a", "q")], "referrer string, reference string")
    assert values(graph.audit_staging(needs, edges), "referrer", "reference") == [("a", "b"), ("a", "q")]


def test_replay_limit_is_strict_and_for_good(spark):
    rows = [(1, 0, 36), (1, 1, 36), (2, 0, 37), (2, 1, 100), (2, 2, 0)]
    got = ev.replay_accounting(spark.createDataFrame(rows, "build_id int, seq int, bytes bigint"), 200)
    assert values(got, "build_id", "seq", "overflowed", "backlog") == [(1, 0, False, 100), (1, 1, False, 200), (2, 0, False, 101), (2, 1, True, 0), (2, 2, True, 0)]
    late = ev.late_subscribers(spark.createDataFrame([(1, 5), (2, 0), (2, 3)], "build_id int, seq int"), got)
    assert values(late.where("rejected"), "build_id", "seq") == [(2, 3)]


def test_caps(spark):
    rows = [(1, "resend")] * 3 + [(2, "resend")] * 4 + [(1, "attempt")] * 2 + [(2, "attempt")] * 3 + [(1, "reconnect")] * 30 + [(2, "reconnect")] * 31
    assert values(ev.cap_violations(spark.createDataFrame(rows, "id int, kind string")), "id", "kind") == [(2, "attempt"), (2, "reconnect"), (2, "resend")]


def test_size_caps(spark):
    rows = [("nar", "a", 5), ("nar", "a", 5), ("nar", "b", 11), ("tmp_unpacked", "c", 10), ("tmp_unpacked", "d", 9)]
    got = validate.screen_sizes(spark.createDataFrame(rows, "kind string, id string, bytes bigint"), {"nar": 10, "tmp_unpacked": 10})
    assert values(got.where("rejected"), "id") == ["b", "c"]


def test_exit_codes(spark):
    df = validate.check_exit_codes(spark.createDataFrame([(0,), (1,), (255,), (256,), (-1,), (512,)], "exit_code int"))
    assert [(r.valid, r.success) for r in df.collect()] == [(True, True), (True, False), (True, False), (False, False), (False, False), (False, False)]


def test_backoff_and_credit(spark):
    s = spark.createDataFrame([("w", i, x) for i, x in enumerate([1, 1, 60, 61, 1, 1, 1, 1, 1, 1, 1])], "worker string, n int, seconds int")
    assert [d for _, d in values(ev.backoff(s), "n", "delay")] == [1, 2, 4, 1, 2, 4, 8, 16, 32, 60, 60]
    e = spark.createDataFrame([("s", 0, "request_job"), ("s", 1, "assignment"), ("s", 2, "resumed"), ("s", 3, "assignment"), ("s", 4, "request_job")], "session string, seq int, kind string")
    assert values(ev.credit_ledger(e), "seq", "balance", "ok") == [(0, 1, True), (1, 0, True), (2, 0, True), (3, -1, False), (4, 0, False)]


T0 = dt.datetime(2024, 1, 1)


def at(s):
    return T0 + dt.timedelta(seconds=s)


def test_silence_is_strict(spark):
    got = twins.silent_workers(spark.createDataFrame([("a", at(0)), ("a", at(180)), ("a", at(361)), ("b", at(5))], "worker string, ts timestamp"), 180)
    assert values(got, "worker", "messages") == [("a", 1), ("a", 2), ("b", 1)]


def test_abort_precedence(spark):
    schema = "build_id bigint, ts timestamp, seq bigint, bytes bigint, cancelled boolean, deadline timestamp"
    rows = [
        (1, at(0), 0, 10, False, at(99)), (1, at(1), 1, 1, False, at(99)),
        (2, at(0), 0, 10, False, at(50)), (2, at(50), 1, 99, False, at(50)),
        (3, at(0), 0, 1, False, at(99)), (3, at(10), 1, 0, False, at(99)), (3, at(11), 2, 0, False, at(99)),
        (4, at(0), 0, 99, True, at(0)),
        (5, at(0), 0, 10, False, at(99)), (5, at(10), 1, 0, False, at(99)),
    ]
    got = twins.abort_reasons(spark.createDataFrame(rows, schema), 10, 10)
    assert values(got, "build_id", "reason", "ts") == [(1, "log size", at(1)), (2, "timed out", at(50)), (3, "silence", at(11)), (4, "cancelled", at(0))]
    assert twins.abort_reasons(spark.createDataFrame(rows[:2] + rows[4:7], schema), 0, 0).count() == 0


def test_abandoned_expired_admitted(spark):
    subs = spark.createDataFrame([(1, at(0), 0, 1), (1, at(5), 1, -1), (1, at(15), 2, 1), (1, at(20), 3, -1), (1, at(31), 4, 1), (2, at(0), 0, 1)], "build_id int, ts timestamp, seq int, change int")
    assert values(twins.abandoned(subs, 10), "build_id", "abandoned_at") == [(1, at(30))]
    done = spark.createDataFrame([(1, at(0)), (2, at(0)), (3, at(0))], "result_id int, finished_at timestamp")
    acks = spark.createDataFrame([(1, at(300)), (2, at(301))], "result_id int, acked_at timestamp")
    assert values(twins.expired_results(done, acks, 300), "result_id") == [2, 3]
    subm = spark.createDataFrame([(1, "x", at(5)), (2, "x", at(0)), (3, "x", at(12)), (4, "y", at(0))], "job_id int, system string, ts timestamp")
    open_ = spark.createDataFrame([("x", at(4), at(10)), ("x", at(43), at(50))], "system string, opens timestamp, closes timestamp")
    assert values(twins.admissions(subm, open_, 30), "job_id", "decision") == [(1, "now"), (2, "waits"), (3, "declined"), (4, "declined")]
    lost = spark.createDataFrame([(1, at(i), i, "lost") for i in range(4)], "job_id int, ts timestamp, seq int, kind string")
    assert values(twins.requeues(lost, 30), "attempts", "requeued") == [(1, True), (2, True), (3, True), (4, False)]


def test_read_requests(spark, tmp_path):
    doc = {"version": 1, "builder": "/bin/sh", "args": [], "env": {"NIX_OUTPUT_CHECKED": "1"}, "topTmpDir": "/t", "tmpDirInSandbox": "/build", "storeDir": "/nix/store", "system": "x", "inputPaths": [], "outputs": {"out": "p"}, "other": 1}
    lines = [doc, {**doc, "version": 2}, {k: v for k, v in doc.items() if k != "args"}]
    (tmp_path / "r.json").write_text("\n".join([*map(json.dumps, lines), "{broken"]))
    ok, bad = readers.read_requests(spark, str(tmp_path / "r.json"))
    assert [r.fixed_output for r in ok.collect()] == [True]
    assert values(bad, "reason") == ["missing args", "not a request document", "unsupported version"]


def test_build_states_and_latest(spark):
    rows = ['{"phase":"running","dedupe_key":"k","build_id":"b","deadline_unix":7}', '{"phase":"finished","dedupe_key":"k","build_id":"c","exit_code":0,"error":"","outputs":[],"extras":[{"store_path":"p"}]}', "nonsense", '{"phase":"gone","dedupe_key":"k","build_id":"c"}']
    good, bad = readers.read_build_states(spark.createDataFrame([(r,) for r in rows], "value string"))
    assert values(good, "build_id", "phase") == [("b", "running"), ("c", "finished")] and bad.count() == 2
    assert [len(r.extras) for r in good.orderBy("build_id").collect()] == [0, 1] and good.where("build_id = 'c'").first().extras[0].references == []
    late = good.withColumn("updated_at", F.when(F.col("build_id") == "b", 9).otherwise(1))
    assert values(sinks.latest_states(late), "build_id") == ["c"]


def test_path_infos_demux_and_added(spark):
    row = (f"/nix/store/{H}-a", bytes(32), 1, [f"/nix/store/{H}-b", f"/nix/store/{H}-a", f"/nix/store/{H}-b"], ["s", "s"], "", "")
    df = spark.createDataFrame([row, ("x", *row[1:]), (row[0], b"1", *row[2:]), (*row[:5], "bad", "")], PATH_INFO)
    good, bad = readers.normalize_path_infos(df)
    got = good.first()
    assert got.deriver is None and got.references == [f"/nix/store/{H}-a", f"/nix/store/{H}-b"] and got.signatures == ["s"]
    assert values(bad, "field") == ["deriver", "nar hash", "path"]
    none = [None] * len(WORKER_PAYLOADS)
    chunk = list(none)
    chunk[list(WORKER_PAYLOADS).index("log_chunk")] = ("b1", "hello")
    messages = spark.createDataFrame([("w", T0, 1, "heartbeat", *none), ("w", T0, 2, "log_chunk", *chunk)], WORKER_MESSAGE)
    tables = readers.demux(messages)
    assert tables["liveness"].count() == 2 and values(tables["log_chunk"], "build_id", "data") == [("b1", "hello")] and "heartbeat" not in tables
    events = spark.createDataFrame([("b", 0, None, "added_path", 0, p, None) for p in "bab"] + [("b", 3, None, "exit_code", 0, None, 0), ("c", 0, None, "added_path", 0, "x", None), ("c", 1, None, "exit_code", 0, None, 1)], ATTACH_EVENT)
    assert values(sinks.added_paths(events), "build_id", "paths") == [("b", ["a", "b"])]


def test_oom_lines(spark):
    df = spark.createDataFrame([("a", "low 0\noom_kill 0"), ("b", "oom_kill 3\n"), ("c", "xoom_kill 3"), ("d", None)], "build_id string, events string")
    assert {r.build_id: r.oom for r in readers.oom_flags(df).collect()} == {"a": False, "b": True, "c": False, "d": False}


def test_path_conflicts_equal_all_pairs(spark):
    """Short, long, pointlike and reversed holds, some far apart, against every pair."""
    rng = random.Random(8)
    rows = []
    for i in range(150):
        start = rng.choice([rng.randrange(-500, 500), rng.randrange(100_000)])
        rows.append((i, rng.randrange(4), rng.randrange(3), start, start + rng.choice([0, 1, 5, 40, 3000, 90_000, -30])))
    want = sorted(
        (a[2], a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[2] == b[2] and a[1] != b[1] and a[3] < b[4] and b[3] < a[4]
    )
    jobs = spark.createDataFrame(rows + [(900, 9, 0, None, 5), (901, 9, 0, 5, None)], "job_id int, key int, output int, s bigint, f bigint")
    for kind in ("timestamp", "timestamp_ntz"):
        timed = jobs.selectExpr("job_id", "key", "output", f"cast(timestamp_seconds(s) AS {kind}) AS started_at", f"cast(timestamp_seconds(f) AS {kind}) AS finished_at")
        assert sorted(map(tuple, staging.path_conflicts(timed).collect())) == want and want
    assert staging.path_conflicts(timed.limit(0)).count() == 0


def test_scan_texts_of_many_lengths(spark):
    text = "ab cd\nabc  d é𝄞x ab"
    rows = [(1, text), (2, ""), (3, None), (4, "cd"), (5, "xab " * 20_000)]
    tokens = ["ab", "abc", "b", "cd\nabc", " d", "é𝄞x", "é𝄞", "x", "d", "", None, "xab xab"]
    want = {
        (i, k)
        for i, c in rows
        for k, t in enumerate(tokens)
        if c and t and any(c.startswith(t, p) for p in range(len(c)) if p == 0 or c[p - 1] in " \n")
    }
    contents = spark.createDataFrame(rows, "content_id int, content string")
    candidates = spark.createDataFrame(list(enumerate(tokens)), "item_id int, token string")
    assert sorted(map(tuple, staging.scan_texts(contents, candidates).collect())) == sorted(want)
    assert len(want) > 8
    assert staging.scan_texts(contents, candidates.limit(0)).count() == 0


def test_scan_texts_shuffles_what_it_finds_only(spark, capsys):
    contents = spark.createDataFrame([(1, "ab cd ef\nab cd"), (1, "xy"), (2, "abcd"), (3, None), (4, "")], "content_id int, content string")
    candidates = spark.createDataFrame([(7, "ab c"), (8, "ef\nab"), (9, "xy"), (9, "xy"), (10, ""), (11, None), (12, "cde")], "item_id int, token string")
    want = [(1, 7), (1, 8), (1, 9)]
    staging.scan_texts(contents, candidates).explain()
    plan = capsys.readouterr().out
    # texts meet the tokens before anything is shuffled
    assert "BroadcastHashJoin" in plan and plan.count("hashpartitioning") == 1
    assert values(staging.scan_texts(contents, candidates), "content_id", "item_id") == want
    assert values(staging.scan_texts(contents, candidates, most=0), "content_id", "item_id") == want
