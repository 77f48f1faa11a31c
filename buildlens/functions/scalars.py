"""Scalar rules over fleet records, one column expression each."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STORE_DIR = "/nix/store"
#: Hash part in base 32 (without e, o, t, u), a dash, a name in the allowed characters.
STORE_PATH = r"\A/nix/store/[0-9a-df-np-sv-z]{32}-[0-9a-zA-Z+\-._?=]+\z"
#: Exit code of a submission that no worker will serve.
DECLINED = 222
#: Transport status codes that end a submission for good.
FINAL_STATUSES = (
    "FailedPrecondition",
    "InvalidArgument",
    "PermissionDenied",
    "NotFound",
    "AlreadyExists",
    "ResourceExhausted",
    "Unimplemented",
)
LABEL_BYTES = 128
EVENT_OVERHEAD = 64


def is_store_path(path: Column) -> Column:
    """SEL-3: exactly one component below the store, with a hash part and a clean name."""
    return F.coalesce(path.rlike(STORE_PATH), F.lit(False))


def is_retryable(status: Column) -> Column:
    """SEL-5: every status but seven is worth another try."""
    return ~status.isin(*FINAL_STATUSES)


def is_fixed_output(env: Column) -> Column:
    """SEL-6: the output hash was fixed beforehand."""
    return F.try_element_at(env, F.lit("NIX_OUTPUT_CHECKED")).eqNullSafe(F.lit("1"))


def is_plain_absolute(path: Column) -> Column:
    """An absolute path without a parent component."""
    return path.startswith("/") & ~path.rlike(r"(\A|/)\.\.(/|\z)")


def required_features(env: Column) -> Column:
    """FN-1: words of the variable if it is set at all, else the strings of the JSON list, else none."""
    plain = F.try_element_at(env, F.lit("requiredSystemFeatures"))
    blob = F.try_element_at(env, F.lit("__json"))
    listed = F.from_json(F.get_json_object(blob, "$.requiredSystemFeatures"), "array<variant>")
    texts = F.filter(
        F.transform(listed, lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))),
        lambda s: s.isNotNull(),
    )
    return F.when(plain.isNotNull(), F.filter(F.split(plain, r"\s+"), lambda w: w != "")).otherwise(
        F.coalesce(texts, F.array().cast("array<string>"))
    )


def label_value(value: Column) -> Column:
    """FN-2: cut to 128 bytes between characters, then backslash, quote and newline escaped."""
    longest = F.array_max(
        F.filter(
            F.sequence(F.lit(0), F.least(F.length(value), F.lit(LABEL_BYTES))),
            lambda n: F.octet_length(F.substring(value, F.lit(1), n)) <= LABEL_BYTES,
        )
    )
    cut = F.when(F.octet_length(value) <= LABEL_BYTES, value).otherwise(F.substring(value, F.lit(1), longest))
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")):
        cut = F.replace(cut, F.lit(a), F.lit(b))
    return cut


def base_name(path: Column) -> Column:
    """FN-3."""
    return F.substring_index(path, "/", -1)


def short_name(node: Column) -> Column:
    """FN-4: the first label of a node name."""
    return F.substring_index(node, ".", 1)


def exit_code(code: Column, signal: Column) -> Column:
    """FN-10: the code, else 128 and the signal, else 1."""
    return F.coalesce(code, F.lit(128) + signal, F.lit(1))


def outcome(code: Column, oom: Column) -> Column:
    """FN-11."""
    return (
        F.when(code == 0, "ok")
        .when(code == DECLINED, "declined")
        .when((code == 137) & F.coalesce(oom, F.lit(False)), "memory limit")
        .when(code > 128, "signal")
        .otherwise("failed")
    )


def event_cost(payload: Column) -> Column:
    """FN-12: bytes of the payload and a fixed overhead."""
    return F.coalesce(F.octet_length(payload), F.lit(0)).cast("bigint") + EVENT_OVERHEAD


def u64_le(n: Column) -> Column:
    """FN-13: eight bytes, least significant first."""
    h = F.lpad(F.hex(n.cast("bigint")), 16, "0")
    return F.unhex(F.concat(*[F.substring(h, 15 - 2 * i, 2) for i in range(8)]))


def sorted_entries(m: Column) -> Column:
    """FN-14: the entries of a map in order of key."""
    return F.array_sort(F.map_entries(m))


def network_mode(fixed: Column, isolate: Column) -> Column:
    """FN-15: none unless the output is fixed; then isolated or the host's."""
    return F.when(~fixed, "none").when(isolate, "isolated").otherwise("host")


def empty_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))
