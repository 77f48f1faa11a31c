"""Declared schemas of the fleet's records; nothing is inferred."""

from __future__ import annotations

BUILD_REQUEST = (
    "system string, builder string, args array<string>, env map<string,string>, outputs map<string,string>, "
    "input_paths array<string>, tmp_dir_in_sandbox string, store_dir string, fixed_output boolean, submitted_at timestamp"
)
#: The request document as it is written.
REQUEST_DOCUMENT = (
    "version int, builder string, args array<string>, env map<string,string>, topTmpDir string, tmpDirInSandbox string, "
    "storeDir string, system string, inputPaths array<string>, outputs map<string,string>"
)
JOB = "id string, key string, features array<string>, attempts int, requeued_at timestamp"
WORKER_REGISTRATION = (
    "worker_name string, caps array<struct<system:string,features:array<string>>>, signing_public_key string, "
    "resumable_keys array<string>, max_jobs int"
)
HEARTBEAT = "worker string, ts timestamp, running_jobs int, load1 double"
PATH_INFO = (
    "store_path string, nar_sha256 binary, nar_size bigint, references array<string>, signatures array<string>, deriver string, ca string"
)
VALID_PATHS = "id bigint, path string"
REFS = "referrer bigint, reference bigint"
NAR_CHUNK = "build_id string, store_path string, seq bigint, chunk binary, eof boolean"
LOG_CHUNK = "build_id string, seq bigint, ts timestamp, data binary"
BUILD_RESULT = (
    "build_id string, exit_code int, outputs array<struct<store_path:string,nar_sha256:binary,signature:string>>, error string"
)
ATTACH_EVENT = "build_id string, seq bigint, ts timestamp, kind string, size bigint, path string, code int"
#: Kinds of worker messages with a build id, and their payloads.
WORKER_PAYLOADS = {
    "register": "struct<worker_name:string,max_jobs:int>",
    "heartbeat": "struct<running_jobs:int,load1:double>",
    "job_request": "struct<free:int>",
    "missing_paths": "struct<build_id:string,store_paths:array<string>>",
    "log_chunk": "struct<build_id:string,data:string>",
    "build_result": "struct<build_id:string,exit_code:int,error:string>",
    "nar_chunk": "struct<build_id:string,store_path:string,chunk:string,eof:boolean>",
    "resume": "struct<build_id:string,dedupe_key:string>",
}
LIVENESS_ONLY = ("register", "heartbeat", "job_request")
WORKER_MESSAGE = "worker string, ts timestamp, seq bigint, kind string, " + ", ".join(f"{k} {t}" for k, t in WORKER_PAYLOADS.items())
BUILD_STATE = (
    "phase string, dedupe_key string, build_id string, deadline_unix bigint, exit_code int, error string, "
    "outputs array<struct<store_path:string,nar_sha256:string>>, "
    "extras array<struct<store_path:string,references:array<string>>>"
)
