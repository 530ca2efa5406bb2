"""Settings with their defaults, from the environment where set."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields


def _env(name: str, default):
    return field(default_factory=lambda: type(default)(os.environ.get(name, default)))


@dataclass(frozen=True)
class Settings:
    """Limits of queries and sizes of segments."""

    # fixed values: environment names and defaults, as users set them

    grep_limit: int = _env("GREP_MATCH_LIMIT", 20)
    snippet_chars: int = _env("GREP_SNIPPET_CHARS", 200)
    page_text_tokens: int = _env("GET_PAGE_TEXT_TOKEN_CAP", 8000)
    plan_tasks: int = _env("PLAN_MAX_TASKS", 10)
    chunk_chars: int = _env("SEGMENT_CHUNK_SIZE", 5000)
    chunk_overlap: int = _env("SEGMENT_CHUNK_OVERLAP", 500)
    toc_pages: int = _env("TOC_PAGE_LIMIT", 10)
    retry_attempts: int = _env("LLM_MAX_ATTEMPTS", 5)
    run_steps: int = _env("GRAPH_RECURSION_LIMIT", 100)
    reasoning_steps: int = _env("GRA_INNER_RECURSION_LIMIT", 25)
    worker_steps: int = _env("WORKER_INNER_RECURSION_LIMIT", 15)
    document_steps: int = _env("DOCUMENT_AGENT_RECURSION_LIMIT", 15)
    lookup_steps: int = _env("LOOKUP_INNER_RECURSION_LIMIT", 20)
    footer_left: str = _env("FOOTER_REGEX_LEFT", r"^\*{0,2}\s*(\d+)\s*\|\s*Report\s*\*{0,2}$")
    footer_right: str = _env("FOOTER_REGEX_RIGHT", r"^\*{0,2}\s*Report\s*\|\s*(\d+)\s*\*{0,2}$")

    def described(self) -> dict[str, object]:
        return {f.name: getattr(self, f.name) for f in fields(self)}


SETTINGS = Settings()
