"""Frames of the graph store and the parameters of both engine presets."""

from __future__ import annotations

from dataclasses import dataclass, field

ENTITIES = "text string, embedding array<double>, created_at bigint, synonyms array<string>, community_id bigint"
EVENTS = (
    "text string, embedding array<double>, created_at bigint, last_accessed bigint, is_current boolean, start_date timestamp, end_date timestamp, "
    "synonyms array<string>, source_queries array<string>, community_id bigint"
)
CONTEXTS = "text string, created_at bigint, source string, veracity string, date string"
SOURCE = "entity string, event string, weight double"
TARGET = "event string, entity string, weight double"
DERIVED = "event string, context string"
SIMILAR = "src string, dst string, score double, cost double"
FRAMES = {"entities": ENTITIES, "events": EVENTS, "contexts": CONTEXTS, "edges_source": SOURCE, "edges_target": TARGET, "edges_derived": DERIVED, "edges_similar": SIMILAR}
#: What identifies a row of each frame.
KEYS = {"entities": ["text"], "events": ["text"], "contexts": ["text"], "edges_source": ["entity", "event"], "edges_target": ["event", "entity"], "edges_derived": ["event", "context"], "edges_similar": ["src", "dst"]}

PART = "struct<text:string,original:string,embedding:array<double>>"
BATCH = f"seq bigint, subject {PART}, relation struct<text:string,embedding:array<double>>, object {PART}, context struct<text:string,source:string,veracity:string,date:string>"
LLM_RESULT = "tool_name string, kg_entity array<struct<subject:string,relation:string,object:string>>, reason string"

DAY_MS = 86_400_000


@dataclass(frozen=True)
class Params:
    """Every constant of the engine. ``v1()`` and ``v2()`` are the two published behaviours."""

    dimensions: int = 768
    score_mode: str = "normalized"  # (1 + cosine) / 2, or "raw"
    search_threshold: float = 0.6
    resolve_threshold: float = 0.92
    spelling_threshold: float = 0.85
    damping: float = 0.85
    iterations: int = 20
    decay: float = 0.05
    update_threshold: float = 0.85
    update_candidates: int = 3
    update_score: float = 0.7
    seed_vectors: int = 5
    seed_fuzzy: int = 3
    seed_fuzzy_score: float = 0.8
    min_length: int = 2
    top_nodes: int = 30
    top_rows: int = 15
    min_score: float | None = None
    gamma: float = 1.0
    similar_threshold: float = 0.8
    similar_k: int = 10
    costs: dict[str, float] = field(default_factory=lambda: {"SOURCE": 1.0, "TARGET": 1.0, "SIMILAR_TO": 10.0})
    other_cost: float = 5.0
    same_topic: float = 0.8
    history_window: int = 20
    history_cap: int = 40
    list_limit: int = 100
    keywords: int = 5
    fallback: int = 10
    weighted: bool = True
    embedding_policy: str = "last"  # or "first"
    mention_order: str = "role"  # all subjects, then all objects; or "row"
    synonyms_on_create: bool = True
    events_current: bool = True

    @classmethod
    def v1(cls, **more) -> Params:
        return cls(**more)

    @classmethod
    def v2(cls, **more) -> Params:
        own = {"resolve_threshold": 0.9, "top_nodes": 500, "min_score": 0.0, "weighted": False, "embedding_policy": "first", "synonyms_on_create": False}
        return cls(**own | more)
