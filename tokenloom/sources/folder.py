"""Loading a tokenizer description from a folder, and what stands in where its settings are missing."""

from __future__ import annotations

import os
from dataclasses import dataclass

from tokenloom.functions.strings import glob_pattern
from tokenloom.sources.config import TokenizerError, get, merged, parse

#: Settings of model types that need none of their own; t5 also has its 100 extra ids.
FALLBACK = {
    "gpt2": {"tokenizer_class": "GPT2Tokenizer", "bos_token": "<|endoftext|>", "eos_token": "<|endoftext|>", "unk_token": "<|endoftext|>", "add_prefix_space": False, "model_max_length": 1024},
    "t5": {"tokenizer_class": "T5Tokenizer", "eos_token": "</s>", "pad_token": "<pad>", "unk_token": "<unk>", "extra_ids": 100, "model_max_length": 512, "additional_special_tokens": [f"<extra_id_{i}>" for i in range(100)]},
}


@dataclass
class Description:
    model: dict
    settings: dict | None
    data: dict

    def resolved(self) -> dict | None:
        """The settings with a tokenizer class: their own, the fallback's underneath, or one from the model type's name."""
        kind = get(self.model, "modelType")
        fallback = FALLBACK.get(kind)
        if self.settings is None:
            return fallback
        if get(self.settings, "tokenizerClass"):
            return self.settings
        if fallback:
            return merged(fallback, self.settings)
        return merged(self.settings, {"tokenizer_class": f"{kind[:1].upper()}{kind[1:].lower()}Tokenizer"}) if kind else self.settings


def _read(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return parse(f.read())


def load(folder: str) -> Description:
    """config.json and tokenizer.json are needed; tokenizer_config.json may be missing or broken.  Read on the driver."""
    found = {}
    for name in ("config.json", "tokenizer.json"):
        path = os.path.join(folder, name)
        if not os.path.exists(path):
            raise TokenizerError("missingConfig", path)
        found[name] = _read(path)
    try:
        settings = _read(os.path.join(folder, "tokenizer_config.json"))
    except (OSError, TokenizerError):
        settings = None
    return Description(found["config.json"], settings, found["tokenizer.json"])


__all__ = ["FALLBACK", "Description", "glob_pattern", "load"]
