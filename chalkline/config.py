"""Settings of the operators.  The values become literals in the plans."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class ChangeConfig:
    # Limits of the change classes.
    quiet_mean: float = 1.2
    quiet_ratio: float = 0.002
    quiet_edge: float = 0.0015
    scene_ratio: float = 0.40
    scene_mean: float = 32.0
    local_ratio: float = 0.06
    local_bbox: float = 0.30
    local_mean: float = 10.0
    pixel_delta: float = 12.0


@dataclass(frozen=True)
class StateConfig:
    # The stable-state machine.
    stable_seconds: float = 1.25
    protection_seconds: float = 0.45
    minimum_gap_seconds: float = 0.5
    strong_ratio: float = 0.12
    strong_score: float = 35.0


@dataclass(frozen=True)
class CandidateConfig:
    # Near-duplicate and content-loss limits.
    max_hash_distance: int = 2
    max_mean_abs_difference: float = 1.75
    recent: int = 5
    min_edge: float = 0.003
    edge_share: float = 0.60
    contrast_floor: float = 0.01
    contrast_share: float = 0.85
    drop_seconds: float = 0.75


@dataclass(frozen=True)
class TopicConfig:
    # Boundary scores and section lengths.
    min_seconds: float = 45.0
    max_seconds: float = 300.0
    threshold: float = 0.9
    long_gap: float = 15.0
    gap: float = 8.0
    lexical_tokens: int = 5
    novelty: float = 0.72
    window: int = 3
    visual_seconds: float = 6.0
    visual_gap: float = 90.0
    before_seconds: float = 6.0
    after_seconds: float = 8.0


@dataclass(frozen=True)
class CoverageConfig:
    # The coverage audit.
    cluster_gap: float = 4.0
    structural_score: float = 30.0
    near_seconds: float = 8.0
    match_seconds: float = 0.75
    gap_seconds: float = 45.0
    long_gap_seconds: float = 75.0
    dense_words: int = 90
    busy_changes: int = 30
    low_confidence: float = 55.0


@dataclass(frozen=True)
class HostRules:
    """Where catalog URLs carry the id: short hosts in the first path part, main hosts in the second."""

    main_hosts: tuple[str, ...] = field(default=("example.com", "m.example.com"))
    short_hosts: tuple[str, ...] = field(default=("example.org",))
    id_pattern: str = "^[A-Za-z0-9_-]{11}$"
