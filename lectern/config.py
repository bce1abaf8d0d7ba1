"""Every number, threshold and fixed list the operators use, in one place."""

from __future__ import annotations

from dataclasses import dataclass, field

# The phrases that mark an answer as "the course does not cover this".
FALLBACK_PHRASES = (
    "not covered",
    "haven%t covered",
    "not in the context",
    "pas abordé",
    "pas couvert",
    "je ne sais pas",
)
# The shorter list used by the activity header.
HEADER_FALLBACK_PHRASES = (
    "not covered",
    "haven%t covered",
    "pas abordé",
    "pas couvert",
)

# Reply languages as code -> (name, voice code).
REPLY_LANGUAGES = {
    "fr": ("French", "fr"),
    "en": ("English", "en"),
    "ar": ("Arabic", "ar"),
    "es": ("Spanish", "es"),
    "de": ("German", "de"),
    "it": ("Italian", "it"),
    "pt": ("Portuguese", "pt"),
}

# The closed set of retrieval grades.
GRADES = ("correct", "ambiguous", "incorrect")

# The text fields and score fields a logged source may carry, best first.
SOURCE_TEXT_FIELDS = ("chunk_text", "text", "content", "page_content")
SOURCE_SCORE_FIELDS = ("score",)

# File types the landing area accepts.
DOCUMENT_TYPES = ("pdf", "pptx")

# Fixed value: the rule between passages of one context.
PASSAGE_RULE = "\n\n---\n\n"


@dataclass(frozen=True)
class Settings:
    """Tunable parameters; the defaults are the published behaviour."""

    chunk_size: int = 2000
    chunk_overlap: int = 200
    min_chunk_chars: int = 30

    vector_k: int = 5
    bm25_k: int = 5
    candidates_per_query: int = 10
    probes: int = 8  # cells a query reads when an approximate vector index is given
    rerank_k: int = 5
    # A chunk that several variants find counts once. "chunk_text" compares texts by their first
    # `dedupe_prefix_chars` characters instead, which loses chunks that start alike.
    dedupe_on: str = "chunk_id"
    dedupe_prefix_chars: int | None = 100

    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    bm25_epsilon: float = 0.25

    correct_above: float = 0.25
    incorrect_below: float = 0.01

    compress_threshold: float = 0.55
    compress_min_sentences: int = 2
    # Where too few sentences pass, the best are given best first, or in the order of the text.
    compress_document_order: bool = False

    history_turns: int = 10
    reply_window_seconds: int = 120
    query_chars: int = 500
    logged_chunk_chars: int = 300

    embed_dim: int = 64
    default_language: str = "fr"

    # A query side up to this many rows is sent to every task; beyond it the query side is
    # split into blocks, and the corpus is read once for each (operators/blocks.py).
    broadcast_rows: int = 200_000

    fallback_phrases: tuple[str, ...] = field(default=FALLBACK_PHRASES)


DEFAULTS = Settings()
