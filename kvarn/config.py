"""Settings: defaults, then a JSON file, then the environment; checked once."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields
from pathlib import Path


@dataclass(frozen=True)
class EngineConfig:
    """Settings of a store. Those of physical structures that Spark has its own of (block size, caches, memtable kind) are accepted and have no effect."""

    block_size: int = 4096
    memtable_size: int = 1000
    memtable_type: str = "hashmap"
    max_immutable_count: int = 4
    lsm_levels: int = 4
    compaction_threshold: int = 4
    cache_capacity: int = 512
    table_cache_size: int = 64
    min_prefix: int = 1
    max_prefix: int = 128
    bloom_fpr: float = 0.01
    bloom_expected: int = 1000
    token_refill_rate: float = 100.0
    max_tokens: int = 10000
    tombstone_literal: str = "<DELETED!>"
    wal_segment_size: int = 67108864
    wal_write_buffer: int = 65536
    wal_mode: str = "group"


@dataclass(frozen=True)
class ClusterConfig:
    node_id: str = "node-1"
    cluster_id: str = "cluster"
    listen_addr: str = "127.0.0.1:7001"
    seeds: tuple[str, ...] = ()
    initial_replicas: tuple[str, ...] = ()
    replication_factor: int = 3
    read_quorum: int = 2
    write_quorum: int = 2
    split_bytes: int = 256 << 20
    merge_bytes: int = 64 << 20
    settle_ticks: int = 2
    fanout: int = 4
    leaf_rows: int = 32
    max_depth: int = 6
    gossip_seconds: float = 1.0
    ping_seconds: float = 0.5
    suspect_seconds: float = 5.0
    dead_seconds: float = 30.0  # checked, but suspicion alone decides death
    indirect_fanout: int = 3
    generation: int = 1
    extra: dict = field(default_factory=dict, compare=False)

    def validate(self) -> ClusterConfig:
        """Raise ValueError for the first rule that fails; a missing replica list becomes this node."""
        rules = [
            (bool(self.node_id), "node_id is required"),
            (bool(self.cluster_id), "cluster_id is required"),
            (self.replication_factor >= 1, "replication_factor must be at least 1"),
            (1 <= self.read_quorum <= self.replication_factor, "read_quorum must be within 1..replication_factor"),
            (1 <= self.write_quorum <= self.replication_factor, "write_quorum must be within 1..replication_factor"),
            (self.read_quorum + self.write_quorum > self.replication_factor, "read and write quorums must overlap"),
            (0 < self.merge_bytes < self.split_bytes, "merge_bytes must be positive and below split_bytes"),
            (self.settle_ticks >= 1, "settle_ticks must be at least 1"),
            (self.fanout >= 2, "fanout must be at least 2"),
            (self.leaf_rows >= 1 and self.max_depth >= 1, "leaf_rows and max_depth must be at least 1"),
            (0 < self.ping_seconds < self.suspect_seconds < self.dead_seconds, "ping, suspect and dead times must rise"),
            (self.generation >= 1, "generation must be at least 1"),
        ]
        for good, message in rules:
            if not good:
                raise ValueError(message)
        if self.initial_replicas:
            return self
        return ClusterConfig(**{f.name: getattr(self, f.name) for f in fields(self)} | {"initial_replicas": (self.node_id,)})


def csv(text: str) -> tuple[str, ...]:
    """Comma-separated parts, trimmed; empty ones dropped."""
    return tuple(p for p in (x.strip() for x in text.split(",")) if p)


def load_cluster(path: str | None = None, env: dict[str, str] | None = None, prefix: str = "KVARN_CLUSTER_") -> ClusterConfig:
    """Defaults, overridden by the JSON file, overridden by ``<prefix><NAME>`` in the environment."""
    env = dict(os.environ) if env is None else env
    known = {f.name: f for f in fields(ClusterConfig)}
    given = json.loads(Path(path).read_text()) if path else {}
    if unknown := set(given) - set(known):
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    values = {k: tuple(v) if isinstance(v, list) else v for k, v in given.items()}
    default = ClusterConfig()
    for name in known:
        if (raw := env.get(prefix + name.upper())) is not None:
            kind = type(getattr(default, name))
            values[name] = csv(raw) if kind is tuple else kind(raw)
    return ClusterConfig(**values).validate()
