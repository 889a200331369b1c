"""Options of a run."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..functions.tokens import MODEL_PRESETS, TokenCounter, chars_for_tokens
from ..sinks.document import RenderOptions


@dataclass(frozen=True)
class Options:
    max_tokens: int = MODEL_PRESETS["claude-1m"]
    count_tokens: bool = True
    counter: TokenCounter | None = None
    keywords: tuple[str, ...] = ()
    min_messages: int = 0
    bots: tuple[str, ...] = ()
    drop_system: bool = False
    drop_media_only: bool = False
    users: tuple[str, ...] = ()
    user_ids: tuple[str, ...] = ()
    date_from: str | None = None
    date_to: str | None = None
    tz: str = "UTC"
    txt_timezone: str = "UTC"
    use_real_names: bool = False
    overlap: int = 500
    render: RenderOptions = field(default_factory=RenderOptions)

    @property
    def max_chars(self) -> int:
        return chars_for_tokens(self.max_tokens)
