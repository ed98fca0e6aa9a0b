"""Token ids of whole texts by a public byte-level BPE vocabulary.

The vocabulary is the tokenizers file.  Where it is a plain byte-level BPE, whose
merges come in the order of their ids, the same vocabulary is run by a faster
encoder (the ids are the same); any other file is run by its own library.
"""

from __future__ import annotations

import json
import os
from functools import cached_property

import numpy as np


def _byte_of() -> dict[str, int]:
    """The letters by which a byte-level vocabulary writes bytes: printable bytes
    stand for themselves, the others for the letters from 256 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {chr(b if b in plain else next(others)): b for b in range(256)}


def _fast(path: str):
    """An encoder text -> ids for a plain byte-level BPE file, else None."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not spec.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    if not plain or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
        return None
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    letters = _byte_of()
    ranks = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
    made = [model["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
    if made != sorted(made) or any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
        return None
    import public_tokenizers
    import tiktoken

    core = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return lambda text: core.encode_to_numpy(text, allowed_special="all")


class Encoder:
    """ids(text) gives the ids as little-endian unsigned 32-bit bytes; strings of
    special tokens in a text become their ids, and none are added."""

    def __init__(self, path: str):
        self._path = path
        self._fast = _fast(path)

    @cached_property
    def _own(self):
        """The vocabulary's own library, loaded only where it is needed."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self._path)

    def plain_ids(self, text: str) -> bytes:
        """By the vocabulary's own library."""
        return np.array(self._own.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        if self._fast is None:
            return self.plain_ids(text)
        try:
            return self._fast(text).astype("<u4", copy=False).tobytes()
        except ValueError:  # its pattern gives up on runs of about a million spaces
            return self.plain_ids(text)


_open: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker process and vocabulary."""
    if path not in _open:
        _open[path] = Encoder(path)
    return _open[path]


def default_vocabulary() -> str:
    """The installed public vocabulary; every operator takes another as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
