"""Flow policies: typed rules and first-match decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buildlens.functions.network import (
    address_key,
    canonical_key,
    in_network,
    in_ports,
    is_private,
    network_bound,
    protocol_fits,
)
from buildlens.sources.shared import written

#: Rules up to this number are tested against every flow, one after another.
BROADCAST_RULES = 1000
RANGE = "array<struct<start:int,end:int>>"


def compile_policy(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC-5: ``df(rule_idx, action, proto, dst, ports)`` to typed rules and rejected rows.

    Typed: rule_idx, action, proto, kind (any, private, cidr), lo, hi (keys), bits, ports.
    Rejected rows keep their columns and get ``reason``.
    """
    # long expressions become columns first, so that the plan holds each of them once
    given = F.substring_index("_dst", "/", -1)
    staged = (
        df.withColumn("_proto", F.coalesce("proto", F.lit("any")))
        .withColumn("_dst", F.coalesce("dst", F.lit("any")))
        .withColumn("_ip", address_key(F.substring_index("_dst", "/", 1)))
        .withColumn("_bits", F.length("_ip") * 4)
        .withColumn(
            "_prefix", F.when(~F.col("_dst").contains("/"), F.col("_bits")).when(given.rlike(r"\A\+?[0-9]{1,3}\z"), given.cast("int"))
        )
    )
    proto, dst, ip, bits, prefix = (F.col(c) for c in ("_proto", "_dst", "_ip", "_bits", "_prefix"))
    kind = F.when(dst.isin("any", "private"), dst).otherwise("cidr")
    one = r"\s*\+?0*[0-9]{1,5}\s*"
    ports = F.coalesce("ports", F.array().cast("array<string>"))
    port = lambda s, i: F.trim(F.substring_index(s, "-", i)).cast("int")
    typed = F.transform(ports, lambda s: F.struct(port(s, 1).alias("start"), port(s, -1).alias("end")))
    good_port = F.forall(ports, lambda s: s.rlike(rf"\A{one}(-{one})?\z")) & F.forall(
        typed, lambda r: (r["start"] <= r["end"]) & (r["end"] <= 65535)
    )
    reason = (
        F.when(~F.coalesce(F.col("action").isin("allow", "deny"), F.lit(False)), "bad action")
        .when(~proto.isin("any", "tcp", "udp"), "bad protocol")
        .when((kind == "cidr") & ip.isNull(), "bad destination")
        .when((kind == "cidr") & ~F.coalesce(prefix <= bits, F.lit(False)), "bad prefix length")
        .when(~F.coalesce(good_port, F.lit(False)), "bad port range")
    )
    judged = staged.withColumn("reason", reason)
    rules = judged.where("reason is null").select(
        F.col("rule_idx").cast("int").alias("rule_idx"),
        "action",
        proto.alias("proto"),
        kind.alias("kind"),
        F.when(kind == "cidr", network_bound(ip, prefix, True)).alias("lo"),
        F.when(kind == "cidr", network_bound(ip, prefix, False)).alias("hi"),
        F.when(kind == "cidr", prefix).alias("bits"),
        typed.cast(RANGE).alias("port_ranges"),
    )
    return rules, judged.where("reason is not null").select(*df.columns, "reason")


def decide_flows(flows: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """JOIN-7: ``flows(flow_id, proto, ip, port, ...)`` with rule_idx and action of the first
    rule that fits, null and the default where none does.

    Few rules become one array, and each flow takes the first of it that fits: no flow is moved.
    Of many, those for any or all private destinations, each shape with its first number only,
    are such an array; the others are joined by prefix: each flow stands for every prefix
    length in use, so it meets no rule of another network.
    """
    keyed = flows.withColumn("_address", address_key(F.col("ip"))).withColumn("ip_key", canonical_key(F.col("_address"))).drop("_address")

    def fits(r: Column) -> Column:
        place = (
            (r["kind"] == "any")
            | ((r["kind"] == "private") & is_private(F.col("ip_key")))
            | ((r["kind"] == "cidr") & in_network(F.col("ip_key"), r["lo"], r["hi"]))
        )
        return F.coalesce(protocol_fits(r["proto"], F.col("proto")) & place & in_ports(F.col("port"), r["port_ranges"]), F.lit(False))

    def first_of(some: DataFrame) -> DataFrame:
        held = some.agg(F.array_sort(F.collect_list(F.struct("rule_idx", "action", "kind", "proto", "lo", "hi", "port_ranges")))).scalar()
        hit = F.get(F.filter("_rules", fits), F.lit(0))
        return keyed.withColumn("_rules", held).withColumn("_hit", F.struct(hit["rule_idx"].alias("rule_idx"), hit["action"].alias("action"))).drop("_rules")

    answer = [F.col("_hit.rule_idx").alias("rule_idx"), F.coalesce("_hit.action", F.lit(default)).alias("action")]
    if rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES:
        return first_of(rules).select(*flows.columns, *answer)
    general = rules.where("kind <> 'cidr'").groupBy("kind", "proto", "port_ranges").agg(F.min(F.struct("rule_idx", "action")).alias("f"))
    general = general.select("kind", "proto", "port_ranges", "f.rule_idx", "f.action", F.lit(None).cast("string").alias("lo"), F.lit(None).cast("string").alias("hi"))
    numbered = written(first_of(general).withColumn("_row", F.monotonically_increasing_id()), "flows")
    head = F.floor(F.col("bits") / 4).cast("int")
    some = rules.where("kind = 'cidr'").select(
        head.alias("n"), F.left("lo", head).alias("head"), *[F.col(c).alias("r_" + c) for c in ("rule_idx", "action", "proto", "lo", "hi", "port_ranges")]
    )
    lengths = sorted(x["n"] for x in some.select("n").distinct().collect())
    asked = numbered.select("_row", "proto", "port", "ip_key", F.explode(F.array(*map(F.lit, lengths))).alias("n")) if lengths else numbered.limit(0).withColumn("n", F.lit(0))
    near = asked.withColumn("head", F.left("ip_key", F.col("n"))).join(some, ["n", "head"]).where(
        protocol_fits(F.col("r_proto"), F.col("proto")) & in_ports(F.col("port"), F.col("r_port_ranges")) & in_network(F.col("ip_key"), F.col("r_lo"), F.col("r_hi"))
    )
    best = near.groupBy("_row").agg(F.min(F.struct(F.col("r_rule_idx").alias("rule_idx"), F.col("r_action").alias("action"))).alias("_net"))
    either = F.when(F.col("_hit.rule_idx").isNull(), F.col("_net")).when(F.col("_net").isNull(), F.col("_hit")).otherwise(F.least("_hit", "_net"))
    return numbered.join(best, "_row", "left").withColumn("_hit", either).select(*flows.columns, *answer)


def ip_scope(flows: DataFrame) -> DataFrame:
    """``flows`` with ``private``: whether the destination is not a public address."""
    staged = flows.withColumn("_address", address_key(F.col("ip"))).withColumn("_key", canonical_key(F.col("_address")))
    return staged.withColumn("private", is_private(F.col("_key"))).drop("_address", "_key")
