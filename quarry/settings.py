"""Settings from the environment and an optional .env file; an empty value means the default."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields
from pathlib import Path

from quarry.functions.scalar import model_signature

_TRUE = {"1", "true", "yes", "on"}


@dataclass(frozen=True)
class Settings:
    """Each field is read from the upper-case variable of its name."""

    media_dir: str = "media"
    data_dir: str = "data"
    clip_model: str = "clip"
    clip_pretrained: str = "base"
    text_model: str = "text"
    caption_model: str = "captions"
    speech_model: str = "speech"
    enable_captions: bool = True
    enable_speech: bool = True
    max_keyframes: int = 16
    max_captions: int = 6
    speech_seconds: int = 180
    scene_threshold: float = 0.35
    keyframe_gap: float = 4.0
    max_pdf_pages: int = 60
    max_page_images: int = 6
    chunk_chars: int = 900
    transcript_chars: int = 500
    max_attempts: int = 3
    max_file_mb: float = 2048
    top_k: int = 24

    @classmethod
    def load(cls, environ: Mapping[str, str] | None = None, dotenv: str | None = None) -> Settings:
        """The environment wins over the file."""
        given: dict[str, str] = {}
        if dotenv and Path(dotenv).exists():
            for line in Path(dotenv).read_text(encoding="utf-8").splitlines():
                name, eq, value = line.strip().partition("=")
                if eq and not name.startswith("#"):
                    given[name.strip()] = value.strip().strip("'\"")
        given |= dict(os.environ if environ is None else environ)
        values = {}
        for f in fields(cls):
            text = given.get(f.name.upper(), "")
            if text != "":
                kind = type(f.default)
                values[f.name] = text.lower() in _TRUE if kind is bool else kind(text)
        return cls(**values)

    def signature(self) -> str:
        return model_signature(self.clip_model, self.clip_pretrained, self.text_model, self.caption_model if self.enable_captions else None, self.speech_model if self.enable_speech else None)
