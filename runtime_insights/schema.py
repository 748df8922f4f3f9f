"""Schemas and fixed values shared by every module."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Word lists, names and constants that results depend on.
# ---------------------------------------------------------------------------
PROCESS_RULES = ("process", "proc")
NETWORK_RULES = ("network", "net")
FILE_RULES = ("file",)

PROCESS_SYSCALLS = ("execve", "clone", "fork", "vfork")
NETWORK_SYSCALLS = ("connect", "accept", "send", "recv", "sendto", "recvfrom")
NETWORK_SYSCALLS_METRICS = NETWORK_SYSCALLS + ("listen", "bind")
FILE_SYSCALLS = ("open", "openat", "close", "read", "write", "unlink", "unlinkat")

CATEGORIES = ("process", "network", "file")

PRIORITIES = (
    "emergency", "alert", "critical", "error",
    "warning", "notice", "info", "debug",
)

EVENT_LABELS = (
    "rule", "priority", "container_name", "image_repository",
    "process_name", "k8s_namespace", "k8s_pod", "rule_category",
)

EVENTS_TOTAL = "syscall_events_total"
EVENTS_TOTAL_HELP = "Total number of syscall events observed."
LAST_EVENT = "syscall_last_event_timestamp_seconds"
LAST_EVENT_HELP = "Timestamp (seconds) of the last processed syscall event."
EVENT_RATE_10S = "syscall_event_rate_10s"
ALERTS_TOTAL = "security_alerts_total"

PROCESS_RULE_FIELDS = (
    "evt.num", "evt.type", "container.id", "container.name",
    "container.image.repository", "proc.pid", "proc.ppid", "proc.pname",
    "proc.name", "proc.cmdline", "proc.args", "proc.exepath",
    "fd.num", "fd.type", "fd.name", "evt.args",
)
NETWORK_RULE_FIELDS = (
    "evt.num", "evt.type", "container.id", "container.name",
    "container.image.repository", "proc.pname", "proc.name", "proc.cmdline",
    "proc.exepath", "fd.typechar", "fd.num", "fd.type", "fd.name", "evt.args",
)
FILE_RULE_FIELDS = (
    "evt.num", "evt.type", "container.id", "container.name",
    "container.image.repository", "proc.pid", "proc.ppid", "proc.pname",
    "proc.name", "proc.cmdline", "proc.exepath", "fd.num", "fd.type",
    "fd.name", "fd.filename", "fd.directory", "evt.args",
)
BRACKETED_FIELDS = ("evt.args",)
MISSING_FIELD = "<NA>"

TOKEN_PATTERN = r"(?U)(-{1,2}[^\s\x1c-\x1f-]+)"

QUIET_GAP_MS = 60_000
WARMUP_MS = 45_000
SIMILARITY_THRESHOLD = 0.80
ENCODE_BATCH = 16
ENCODE_MAX_LENGTH = 256
CAPTURE_MS = 5_000
MERGE_WINDOW_MS = 500
DROP_THRESHOLD = 0.1
DROP_RATE_PER_SECOND = 0.03333
DROP_MAX_BURST = 1
QUEUE_SIZE = 10_000

ROOT_TYPE = "root"
BRANCH_TYPE = "branch"
OPERATION_TYPES = {
    "process": "process_operation",
    "network": "network_operation",
    "file": "file_operation",
}
PROCESS_NODE_TYPE = "process_name"
ARGUMENT_TYPE = "cmd_argument"
NETWORK_TYPE = "network_attribute"
DIRECTORY_TYPE = "directory_path"
FILE_TYPE = "file_name"
# ------------------------------------------------------- end of fixed values

FIELDS = T.MapType(T.StringType(), T.StringType())

ENVELOPE = T.StructType([
    T.StructField("hostname", T.StringType()),
    T.StructField("output_fields", FIELDS),
    T.StructField("priority", T.StringType()),
    T.StructField("rule", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("time", T.StringType()),
])

# Flat event rows: what every operator downstream of ingest works on.
EVENT = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("container_name", T.StringType()),
    T.StructField("rule", T.StringType()),
    T.StructField("priority", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("evt_type", T.StringType()),
    T.StructField("proc_name", T.StringType()),
    T.StructField("cmdline", T.StringType()),
    T.StructField("fd_type", T.StringType()),
    T.StructField("fd_name", T.StringType()),
    T.StructField("fd_directory", T.StringType()),
])

PATH = ("container_name", "branch", "evt_type", "proc_name", "attr")
