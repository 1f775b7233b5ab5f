"""Thresholds of the engine: one frozen record, checked, readable from TOML.

The script of the records is a parameter.  The defaults are those of Japanese source text translated
into simplified Chinese; ``Script`` values for other languages are made the same way.
"""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields, replace
from pathlib import Path

# Stock phrases that recognisers emit over silence, in two sets that differ by one member.
SILENCE_PHRASES = (
    "ご視聴ありがとうございました",
    "ご視聴ありがとうございます",
    "ありがとうございました",
    "字幕をご覧いただきありがとうございます",
)
RESCUE_PHRASES = (
    "ご視聴ありがとうございました",
    "ご視聴ありがとうございます",
    "ありがとうございました",
    "お疲れ様でした",
)
# Words that need their context, and particles at which a fragment ends.
CONTEXT_WORDS = ("これ", "それ", "あれ", "ここ", "そこ", "あそこ", "彼", "彼女", "こいつ", "そいつ", "あいつ")
FINAL_PARTICLES = ("けど", "から", "ので", "って", "て", "で", "が", "は", "を", "に", "も")
UNCLEAR = "（日语发音不清）"


#: Rules of the stages by number: outputs made by other rules are stale, and approvals of them no longer hold.
REVISIONS = {"transcription": 2, "translation": 1, "prompt": 1}


@dataclass(frozen=True)
class Script:
    """Character classes, as the inside of brackets, that the text rules look at; all are Java and RE2 syntax."""

    left_over: str = r"\x{3040}-\x{30ff}"  # must not remain in a translation
    ideograph: str = r"\x{3400}-\x{9fff}"  # a translation must have one if the source has
    alien_run: str = "[A-Za-z]{4,}"  # must not occur in a source text
    context_words: tuple[str, ...] = CONTEXT_WORDS
    final_particles: tuple[str, ...] = FINAL_PARTICLES
    unclear: str = UNCLEAR


@dataclass(frozen=True)
class Settings:
    chunk_seconds: int = 300
    source_chunk_overlap_seconds: float = 1.0
    decode_window_seconds: int = 30
    window_overlap_seconds: int = 2
    vad_threshold: float = 0.65
    foreground_min_dbfs: float = -36.0
    foreground_confident_min_dbfs: float = -42.0
    foreground_confident_logprob: float = -0.55
    foreground_confident_no_speech_prob: float = 0.35
    rescue_activity_dbfs: float = -28.0
    rescue_flag_logprob: float = -0.85
    rescue_accept_logprob: float = -1.0
    rescue_agreement_threshold: float = 0.30
    rescue_conditional_agreement_threshold: float = 0.25
    rescue_single_logprob: float = -0.55
    translation_context_cues: int = 6
    translation_review_enabled: bool = True
    translation_review_min_length_ratio: float = 0.45
    translation_review_max_length_ratio: float = 2.2
    translation_n_ctx: int = 4096
    translation_gpu_layers: int = -1
    transcription_backend: str = "stub"
    translation_backend: str = "stub"
    device: str = "cpu"
    transcription_model: str = "none"
    specialist_model: str | None = None
    translation_model: str = "none"
    media_dir: str = "media"
    runtime_dir: str = "runtime"
    script: Script = field(default_factory=Script)

    def __post_init__(self) -> None:
        s = self
        checks = (
            (isinstance(s.translation_review_enabled, bool), "translation_review_enabled must be true or false"),
            (s.chunk_seconds > 0, "chunk_seconds must be positive"),
            (0 <= s.source_chunk_overlap_seconds < s.chunk_seconds, "source_chunk_overlap_seconds must be at least 0 and below chunk_seconds"),
            (0 < s.decode_window_seconds <= s.chunk_seconds, "decode_window_seconds must be positive and at most chunk_seconds"),
            (0 <= s.window_overlap_seconds < s.decode_window_seconds, "window_overlap_seconds must be at least 0 and below decode_window_seconds"),
            (0 < s.vad_threshold < 1, "vad_threshold must lie between 0 and 1"),
            (s.foreground_min_dbfs <= 0, "foreground_min_dbfs must not be positive"),
            (s.foreground_confident_min_dbfs <= s.foreground_min_dbfs, "foreground_confident_min_dbfs must be at most foreground_min_dbfs"),
            (s.foreground_confident_logprob <= 0, "foreground_confident_logprob must not be positive"),
            (0 <= s.foreground_confident_no_speech_prob <= 1, "foreground_confident_no_speech_prob must lie in [0, 1]"),
            (s.foreground_min_dbfs <= s.rescue_activity_dbfs <= 0, "rescue_activity_dbfs must lie between foreground_min_dbfs and 0"),
            (s.rescue_accept_logprob <= 0 and s.rescue_flag_logprob <= 0, "rescue log-probabilities must not be positive"),
            (0 <= s.rescue_conditional_agreement_threshold <= s.rescue_agreement_threshold <= 1, "rescue agreement thresholds must be ordered within [0, 1]"),
            (s.translation_context_cues >= 0, "translation_context_cues must not be negative"),
            (0 < s.translation_review_min_length_ratio <= 1, "translation_review_min_length_ratio must lie in (0, 1]"),
            (s.translation_review_max_length_ratio >= 1, "translation_review_max_length_ratio must be at least 1"),
            (s.translation_n_ctx > 0, "translation_n_ctx must be positive"),
            (s.translation_gpu_layers >= -1, "translation_gpu_layers must be -1 or more"),
        )
        for ok, message in checks:
            if not ok:
                raise ValueError(message)


def confined(base: Path, value: str, what: str) -> Path:
    """A path below ``base``, or ValueError."""
    found = (base / value).resolve()
    if not found.is_relative_to(base.resolve()):
        raise ValueError(f"{what} must stay below {base}")
    return found


def load_settings(path: str | Path) -> Settings:
    """Read ``[processing]``, ``[backends]`` and ``[paths]`` of a TOML file; what is absent keeps its default."""
    path = Path(path)
    data = tomllib.loads(path.read_text(encoding="utf-8")) if path.is_file() else {}
    given = {k: v for part in ("processing", "backends", "paths") for k, v in data.get(part, {}).items()}
    kinds = {f.name: type(f.default) for f in fields(Settings) if f.name not in ("script", "specialist_model")}
    known = {}
    for name, value in given.items():
        if name in kinds:
            known[name] = value if kinds[name] is bool else kinds[name](value)
        elif name == "specialist_model":
            known[name] = value
    for name in ("media_dir", "runtime_dir"):
        if name in known:
            known[name] = str(confined(path.parent, known[name], name))
    return replace(Settings(), **known)
