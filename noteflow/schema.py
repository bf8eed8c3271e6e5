"""Schemas of events, classifier responses and outputs, and the options of a run."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from noteflow.functions import constants as K

TAGS = "array<array<string>>"
EVENT = (
    f"id string, pubkey string, created_at bigint, kind int, tags {TAGS}, "
    "content string, sig string"
)
ENVELOPE = EVENT + ", relay string, arrival_ts timestamp"

LANGUAGES = "array<struct<confidence: double, language: string>>"
TOXICITY = "map<string,double>"
SENTIMENT = "struct<negative: double, neutral: double, positive: double>"
TOPICS = "array<struct<label: string, score: double>>"
NSFW_RESPONSE = "struct<neutral: double, scores: map<string,double>, predictedLabel: string>"
NSFW_SCORES = "url string, ok boolean, data " + NSFW_RESPONSE

# The names of text settings.
SWITCHES = {
    "nsfw": "ENABLE_NSFW_CLASSIFICATION",
    "language": "ENABLE_LANGUAGE_DETECTION",
    "toxicity": "ENABLE_HATE_SPEECH_DETECTION",
    "sentiment": "ENABLE_SENTIMENT_ANALYSIS",
    "topic": "ENABLE_TOPIC_CLASSIFICATION",
}
NUMBERS = {
    "language_limit": "LANGUAGE_DETECTOR_TRUNCATE_LENGTH",
    "toxicity_limit": "HATE_SPEECH_DETECTOR_TRUNCATE_LENGTH",
    "sentiment_limit": "SENTIMENT_ANALYSIS_TRUNCATE_LENGTH",
    "topic_limit": "TOPIC_CLASSIFICATION_TRUNCATE_LENGTH",
    "note_delay_ms": "DELAYS_BEFORE_PUBLISHING_NOTES",
    "fresh_minutes": "ALLOW_EVENTS_NOT_OLDER_THAN_MINUTES",
}
MEDIA_PATTERN_PREFIX = "IMAGE_URL_PATTERN_"


@dataclass(frozen=True)
class FlowOptions:
    """Switches and limits of one run. Every classification task is off by default."""

    nsfw: bool = False
    language: bool = False
    toxicity: bool = False
    sentiment: bool = False
    topic: bool = False
    dedup_ttl_s: int = K.DEDUP_TTL_S
    fresh_minutes: int = K.FRESH_MINUTES
    language_limit: int = K.TEXT_LIMIT
    toxicity_limit: int = K.TEXT_LIMIT
    sentiment_limit: int = K.TEXT_LIMIT
    topic_limit: int = K.TEXT_LIMIT
    media_patterns: tuple[str, ...] = ()
    note_delay_ms: int = K.NOTE_DELAY_MS
    publisher: str = "0" * 64
    compat_greetings: bool = True
    scorers: dict = field(default_factory=dict)

    @classmethod
    def all_tasks(cls, **kw) -> "FlowOptions":
        on = dict(nsfw=True, language=True, toxicity=True, sentiment=True, topic=True)
        return cls(**{**on, **kw})

    @classmethod
    def from_settings(cls, settings: Mapping[str, str], **kw) -> "FlowOptions":
        """Options from text settings such as environment variables; ``kw`` has precedence."""
        values: dict = {
            option: settings.get(name) == "true" for option, name in SWITCHES.items()
        }
        for option, name in NUMBERS.items():
            if settings.get(name):
                digits = re.match(r"\s*([+-]?\d+)", settings[name])
                if not digits:
                    raise ValueError(f"{name} is not a number")
                values[option] = int(digits.group(1))
        values["media_patterns"] = tuple(
            v for k, v in settings.items() if k.startswith(MEDIA_PATTERN_PREFIX)
        )
        return cls(**{**values, **kw})

    def __post_init__(self):
        for name in ("language_limit", "toxicity_limit", "sentiment_limit", "topic_limit"):
            if getattr(self, name) < 0:
                raise ValueError(f"{name} must not be negative")
        if self.nsfw and "nsfw" not in self.scorers:
            raise ValueError("the nsfw task needs a scorer: there is no default without an image model")
