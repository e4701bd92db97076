"""Settings from an INI file, with the defaults and checks of each section."""

from __future__ import annotations

import configparser
from dataclasses import dataclass, field


@dataclass
class Global:
    debug: bool = False
    auth_token: str = ""
    replication_order: list[int] = field(default_factory=list)
    client_side_modes: list[int] = field(default_factory=lambda: [3])
    replication_factor: int = 3
    minimum_durability: int = 0
    polymorphic: bool = False
    auth_backoff_ms: int = 0
    encryption_key: bytes | None = None
    tenant: str = "default"


@dataclass
class Metrics:
    interval_ms: int = 1000
    low: float = 0.1
    high: float = 0.9
    fallback_ms: int = 30
    port: int = 0


@dataclass
class Node:
    node_id: int
    host: str
    data: str
    drive: str = ""


@dataclass
class Peering:
    enabled: bool = False
    gossip_ms: int = 1000
    suspicion_ms: int = 5000
    fanout: int = 0
    ping_ms: int = 500
    indirect_pings: int = 3
    gather_ms: int = 2000


@dataclass
class Storage:
    backend: str = "local"
    gc_interval_s: int = 300
    tombstone_retention_s: int = 86_400
    root: str = ""


@dataclass
class Settings:
    cluster: Global
    metrics: Metrics
    nodes: list[Node]
    peering: Peering
    storage: Storage


BACKENDS = ("local", "nfs", "s3", "raw")


def ints(text: str) -> list[int]:
    """Comma-separated integers; blanks are skipped, anything else is an error."""
    return [int(x) for x in text.split(",") if x.strip()]


def load(path: str) -> Settings:
    """Reads and checks a file; ValueError names what is wrong."""
    ini = configparser.ConfigParser(inline_comment_prefixes=("#", ";"), interpolation=None)
    if not ini.read(path) or "global" not in ini:
        raise ValueError(f"{path} has no [global] section")
    g, m = ini["global"], ini["metrics"] if "metrics" in ini else {}
    if not g.get("auth_token"):
        raise ValueError("auth_token is missing")
    if len(g["auth_token"].encode()) > 64:
        raise ValueError("auth_token has more than 64 bytes")
    order = ints(g.get("replication_order", ""))
    if not order:
        raise ValueError("replication_order is empty")
    key = g.get("encryption_key", "")
    if g.getboolean("encryption_enabled", False) and len(key) != 64:
        raise ValueError("encryption_key must be 64 hexadecimal digits")
    cluster = Global(
        g.getboolean("debug", False), g["auth_token"], order, ints(g.get("client_side_replication_modes", "3")), int(g.get("replication_factor", 3)), int(g.get("minimum_durability_factor", 0)),
        g.getboolean("polymorphic_system", False), int(g.get("auth_backoff_delay", 0)), bytes.fromhex(key) if g.getboolean("encryption_enabled", False) else None, g.get("encryption_tenant", "default"),
    )
    if cluster.replication_factor < 1:
        raise ValueError("replication_factor must be at least 1")
    if not 0 <= cluster.minimum_durability <= cluster.replication_factor:
        raise ValueError("minimum_durability_factor must be between 0 and replication_factor")
    metrics = Metrics(int(m.get("interval", 1000)), float(m.get("min_threshold", 0.1)), float(m.get("max_threshold", 0.9)), int(m.get("fallback_interval", 30)), int(m.get("prometheus_port", 0)))
    if metrics.low > metrics.high:
        raise ValueError("min_threshold is above max_threshold")
    ids = sorted(int(s.removeprefix("daemon.")) for s in ini.sections() if s.startswith("daemon."))
    nodes = [Node(i, ini[f"daemon.{i}"]["host"], ini[f"daemon.{i}"].get("data", ""), ini[f"daemon.{i}"].get("drive", "")) for i in ids]
    p = ini["p2p"] if "p2p" in ini else {}
    on = str(p.get("enabled", "false")).lower() in ("1", "true", "yes", "on")
    peering = Peering(on, *(int(p.get(k, d)) for k, d in (("gossip_interval", 1000), ("suspicion_timeout", 5000), ("fanout", 0), ("ping_timeout", 500), ("indirect_ping_count", 3), ("scatter_gather_timeout", 2000))))
    s = ini["storage"] if "storage" in ini else {}
    backend = s.get("backend", "") or "local"
    if backend not in BACKENDS:
        raise ValueError(f"unknown storage backend {backend}")
    storage = Storage(backend, int(s.get("gc_interval", 0)) or 300, int(s.get("tombstone_retention", 0)) or 86_400, s.get("s3_bucket", "") or s.get("raw_device_path", "") or (nodes[0].data if nodes else ""))
    return Settings(cluster, metrics, nodes, peering, storage)
