"""Settings of the learners and of the plans, as frozen dataclasses."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class JoinPolicy:
    """When a lookup side may be broadcast, and how a hot key is split otherwise.

    broadcast_bytes: the lookup side is broadcast only if its counted rows times the
        width of a row stay below this.
    hot_share: beyond that, a key with more than this share of the rows is split into
        pieces of at most that share. At most ``1 / hot_share`` keys can be hot.
    """

    broadcast_bytes: int = 256 << 20
    hot_share: float = 0.001


@dataclass(frozen=True)
class TextConfig:
    """Cleaning and featurising choices of a job."""

    separator: str = " "
    cleaners: tuple[str, ...] = ("clear",)
    stop_words: tuple[str, ...] = ()
    featuriser: str = "tfidf"
    hash_buckets: int | None = None
    vector_size: int = 50


@dataclass(frozen=True)
class FtrlConfig:
    """FTRL-proximal settings (L7). One set for all labels."""

    # fixed values: the learner's published defaults
    lambda1: float = 0.01
    lambda2: float = 0.01
    alpha: float = 0.016
    beta: float = 0.01
    passes: int = 3
    drift_drop: float = 0.2
    label_chunk: int = 16
    join: JoinPolicy = field(default_factory=JoinPolicy)


@dataclass(frozen=True)
class SgdConfig:
    """Gradient descent settings."""

    step: float = 1.0
    iterations: int = 100
    reg: float = 0.01
    tolerance: float = 0.001
    batch_fraction: float = 1.0
    seed: int = 42
    loss: str = "logistic"
