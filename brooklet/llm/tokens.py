"""Loading a public tokenizer file, and encoding texts with it word by word where that is exact."""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers

from .common import caching, use_cache

#: The default vocabulary; every operator takes another path as a parameter.
VOCABULARY = "word_bpe_49k.json"
#: Words whose ids a Python worker remembers at most. A full memory takes no more words; results stay the same.
MEMORY_WORDS = 700_000
#: The same for encoded_sparingly(); with more than 349,525 a dict doubles its table.
SPARING_WORDS = 340_000
#: Bytes of text that encoded_sparingly() has as words at once, unless a single text is longer.
SPARING_BYTES = 1 << 20


def default_path() -> str:
    return public_tokenizers.path(VOCABULARY)


@lru_cache(maxsize=4)
def loaded(path: str):
    """The library's tokenizer with truncation and padding off; one for each Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@lru_cache(maxsize=4)
def described(path: str) -> tuple[bool, bool, bool]:
    """Whether ids of a text are those of its words (cut at ASCII white space) one after another; whether decoding only joins tokens by a blank; whether texts are put in lower case.

    The first holds if the pre-tokenizer keeps nothing but matches of a pattern that match no white space, no added
    token holds white space or reaches beyond itself, and normalising changes nothing across white space.
    """
    spec = json.loads(open(path, encoding="utf-8").read())
    pre = spec.get("pre_tokenizer") or {}
    first = (pre.get("pretokenizers") or [pre])[0]
    pattern = (first.get("pattern") or {}).get("Regex", " ")
    drops = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True and " " not in pattern and r"\s" not in pattern.replace(r"[^\s", "")
    added = all(not re.search(r"\s", t["content"]) and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in spec.get("added_tokens", []))
    norm = spec.get("normalizer") or {"type": "Sequence", "normalizers": []}
    local = all(n["type"] in ("NFC", "Lowercase") or n["type"] == "Replace" and n["pattern"] == {"Regex": r"\s+"} and n["content"] == " " for n in norm.get("normalizers", [norm]))
    return bool(drops and added and local and not spec.get("post_processor")), spec.get("decoder") is None, any(n["type"] == "Lowercase" for n in norm.get("normalizers", [norm]))


_memory: dict[str, dict[bytes, bytes]] = {}
#: Marks by hash of the words that encoded_sparingly() has met.
_met: dict[str, bytearray] = {}
caching("word ids", lambda: (_memory.clear(), _met.clear()))
_COMBINING = (b"\xcc", b"\xcd")


@lru_cache(maxsize=4)
def _ends(path: str) -> np.ndarray:
    """Whether the token of each id ends a pre-token."""
    vocabulary = loaded(path).get_vocab(with_added_tokens=True)
    out = np.zeros(max(vocabulary.values()) + 1, bool)
    out[[k for name, k in vocabulary.items() if name.endswith("</w>")]] = True
    return out


def _encoded_words(words: list[bytes], path: str) -> dict[bytes, bytes]:
    """Words of letters, with or without a full stop or comma, are encoded as one text and told apart by the tokens that end pre-tokens; others one by one."""
    tokenizer, texts = loaded(path), [w.decode() for w in words]
    counts = [0 if "İ" in t else 1 if t.isalpha() else 2 if t[-1] in ".," and t[:-1].isalpha() else 0 for t in texts]
    plain = [k for k, n in enumerate(counts) if n]
    out, others = {}, [k for k, n in enumerate(counts) if not n]
    if plain:
        ids = np.array(tokenizer.encode_batch_fast([" ".join([texts[k] for k in plain])], add_special_tokens=False)[0].ids, np.uint32)
        at, wanted = np.flatnonzero(_ends(path)[ids]) + 1, np.cumsum([counts[k] for k in plain])
        if len(at) == wanted[-1] and at[-1] == len(ids):
            ends, data = (at[wanted - 1] * 4).tolist(), ids.tobytes()
            out = {words[k]: data[a:b] for k, a, b in zip(plain, [0, *ends], ends, strict=False)}
        else:
            others = range(len(words))
    for k, e in zip(others, tokenizer.encode_batch_fast([texts[k] for k in others], add_special_tokens=False), strict=True):
        out[words[k]] = array("I", e.ids).tobytes()
    return out


def _folded(text: bytes) -> bytes:
    """ASCII letters in lower case, where that can't change what the tokenizer's own lower-casing gives."""
    return text if b"<|" in text or any(x in text for x in _COMBINING) else text.lower()


def _remember(memory: dict[bytes, bytes], new: dict[bytes, bytes], met: bytearray | None) -> None:
    """Without marks, all new words while there is room. With marks, all of them up to half of SPARING_WORDS and then those that come again."""
    if met is None:
        if len(memory) + len(new) <= MEMORY_WORDS:
            memory.update(new)
        return
    mask = len(met) - 1
    for word, ids in new.items():
        if len(memory) >= SPARING_WORDS:
            return
        k = hash(word) & mask
        if met[k] or 2 * len(memory) < SPARING_WORDS:
            memory[word] = ids
        met[k] = 1


def encoded_sparingly(texts: list[bytes], path: str) -> Iterator[bytes]:
    """encoded() for tasks that have much else in memory: fewer words are remembered, and few texts are held as words at once."""
    if path not in _met:
        _met[path] = bytearray(1 << 22)
    met, at, size = _met[path], 0, 0
    for k, text in enumerate(texts):
        if at < k and size + len(text) > SPARING_BYTES:
            yield from encoded(texts[at:k], path, met)
            at, size = k, 0
        size += len(text)
    if texts:
        yield from encoded(texts[at:], path, met)


def encoded(texts: list[bytes], path: str, met: bytearray | None = None) -> list[bytes]:
    """Ids of each UTF-8 text as little-endian unsigned 32-bit integers, as the library's encode gives them without special tokens added."""
    use_cache("word ids", "chunks")
    tokenizer = loaded(path)
    by_words, _, lower = described(path)
    if not by_words:
        return [array("I", e.ids).tobytes() for e in tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
    memory = _memory.setdefault(path, {})
    words = [(_folded(t) if lower else t).split() for t in texts]
    found = [list(map(memory.get, ws)) for ws in words]
    new = _encoded_words(list({w for ws, ids in zip(words, found, strict=True) if None in ids for w, x in zip(ws, ids, strict=True) if x is None}), path)
    _remember(memory, new, met)
    return [b"".join(ids if None not in ids else [new[w] if x is None else x for w, x in zip(ws, ids, strict=True)]) for ws, ids in zip(words, found, strict=True)]
