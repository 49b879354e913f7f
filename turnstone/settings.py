"""All tunables in one frozen value; every operator takes it as a parameter."""

from __future__ import annotations

from dataclasses import dataclass

# Phrases that open an advertisement.
AD_OPENERS = (
    "brought to you by",
    "this episode is sponsored",
    "sponsored by",
    "thank you to our sponsor",
)
# Phrases that keep an open advertisement going. A show's own
# short link belongs here too; pass it with ``Settings(ad_followers=...)``.
AD_FOLLOWERS = (
    "to sign up",
    "get 25% off",
    "free trial",
    "use code",
    "visit ",
    "head over to",
)


@dataclass(frozen=True)
class Settings:
    # ranking
    top_k: int = 8
    essay_top_k: int = 14
    pool: int = 30
    graph_width: int = 96  # breadth of a search on the neighbour graph
    rrf_k: int = 60
    similarity_floor: float = 0.69
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    closeness_weight: float = 0.0  # how much of a score the terms' closeness can add
    dim: int = 384
    # packing
    target_tokens: int = 400
    overlap_tokens: int = 80
    ad_openers: tuple[str, ...] = AD_OPENERS
    ad_followers: tuple[str, ...] = AD_FOLLOWERS
    # shared source ids
    compare_chars: int = 0  # of each text; 0 compares whole texts
    same_text_ratio: float = 0.9
    # evidence blocks
    context_chars: int = 12_000
    essay_context_chars: int = 20_000
    # conversations
    history_messages: int = 20
    title_chars: int = 60
    # evaluation gates
    min_grounded_rate: float = 0.80
    max_false_ground_rate: float = 0.0
    max_p95_ms: float = 1500.0
    max_failure_ratio: float = 0.01
    # Queries (or filters) one task scores at a time; more go in blocks.
    query_rows: int = 8192
    # A side is broadcast only when a count shows it is under both bounds.
    broadcast_rows: int = 1_000_000
    broadcast_bytes: int = 64 * 1024 * 1024


DEFAULTS = Settings()
