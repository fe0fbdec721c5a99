"""Exact, cached token ids from files of the tokenizers library."""

from __future__ import annotations

import json
import re
import struct
import unicodedata
from functools import lru_cache
from itertools import groupby

import numpy as np
import tiktoken
from tokenizers import Tokenizer

from docmill.llm.common import worker_cache

#: Characters for which splitting and lower-casing are alike in every library here; longer pieces are left to ``full``.
_PLAIN, LONGEST = re.compile("[!-~À-ÿ]+"), 400
_WORDS = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_WORD_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: The same pieces of a lower-case plain chunk.
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\[-`{-~×÷]+")
_BYTE_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: A text without other characters or very long pieces, and where any text may be cut: before a lone blank or line end.
_PLAIN_TEXT = re.compile(rf"[\n\t\r ]{{0,{LONGEST}}}+(?:[!-~À-ÿ]{{1,{LONGEST}}}+[\n\t\r ]{{1,{LONGEST}}}+)*+[!-~À-ÿ]{{0,{LONGEST}}}+")
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
#: Words looked up at once; a text's further ones follow.
_AT_ONCE = 50_000


def byte_chars() -> dict[int, str]:
    """The printable character that byte-level tokenizers write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def family(tokenizer: Tokenizer) -> str:
    """``word`` or ``byte`` if a chunk's ids may be had from ranks alone, else ``other``.

    Merging by rank any two neighbours whose join is in the vocabulary gives what the file's list of merges gives if ids
    follow that list and every entry's own string is encoded as that entry: the first merge that the list lacks would
    have to split an entry otherwise than the entry's own encoding does. Both are checked here for the whole vocabulary.
    """
    spec = json.loads(tokenizer.to_str())
    pre, model = spec["pre_tokenizer"] or {}, spec["model"]
    steps = pre.get("pretokenizers", [])
    if spec["normalizer"] == _WORDS and [s["type"] for s in steps] == ["Split", "ByteLevel"] and steps[0].get("invert") and steps[0]["pattern"] == {"Regex": _WORD_PATTERN} and not steps[1]["use_regex"] and model.get("end_of_word_suffix") == "</w>":
        kind, first = "word", 512
    elif spec["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not model.get("end_of_word_suffix"):
        kind, first = "byte", 256
    else:
        return "other"
    vocab, special = model["vocab"], {a["content"] for a in spec["added_tokens"]}
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    joined = [a + b for a, b in merges]
    if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "byte_fallback", "ignore_merges", "continuing_subword_prefix")) or [vocab.get(j) for j in joined] != list(range(first, first + len(merges))):
        return "other"
    if len(vocab.keys() - special) != first + len(merges) or any(vocab[c + e] >= 256 * (1 + bool(e)) for c in byte_chars().values() for e in (("", "</w>") if kind == "word" else ("",))):
        return "other"
    whole = (lambda t: t.endswith("</w>")) if kind == "word" else (lambda t: True)  # others stand only inside words
    for t in joined:
        if whole(t) and [x.id for x in tokenizer.model.tokenize(t.removesuffix("</w>") if kind == "word" else t)] != [vocab[t]]:
            return "other"
    inner = [t for t in joined if not whole(t)]
    if inner:  # the same without the word's end: as a word of an unmarked model
        plain = type(tokenizer.model)({k: v for k, v in vocab.items() if not k.endswith("</w>")}, [(a, b) for (a, b), j in zip(merges, joined, strict=True) if not whole(j)])
        if any([x.id for x in plain.tokenize(t)] != [vocab[t]] for t in inner):
            return "other"
    return kind


@lru_cache(maxsize=8)
def family_of(path: str) -> str:
    """Found once, by the driver; workers are told."""
    return family(_load(path))


def _load(path: str) -> Tokenizer:
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


class CachedEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, the same as ``Tokenizer.encode(text, add_special_tokens=False)``.

    Neither supported family lets a token cross white space (but for one leading blank). Of the word family each
    word's ids are cached, and those that a text has and the cache lacks are encoded in one call; texts of the byte
    family are encoded at once. Parts with characters outside printable ASCII and U+00C0-U+00FF, or very long pieces,
    and files of any other family go through ``encode`` itself. Special tokens' strings are ordinary text.
    """

    def __init__(self, path: str, kind: str | None = None, most: int | None = None) -> None:
        self.tokenizer = _load(path)
        self.family = kind or family(self.tokenizer)
        self.cache = worker_cache(most=most)  # also drops what other operators keep
        if self.family == "other":
            return
        own = {c: bytes([b]) for b, c in byte_chars().items()}
        ranks = {}
        for token, i in json.loads(self.tokenizer.to_str())["model"]["vocab"].items():
            body, end = (token[:-4], b"\0") if self.family == "word" and token.endswith("</w>") else (token, b"")
            if all(c in own for c in body):
                ranks[b"".join([own[c] for c in body]) + end] = i
        # a word's end is a byte 0 after it, which joins the last byte before anything else does; alone, it parts words
        ranks = {k: v for k, v in ranks.items() if v < len(ranks)}
        self.ends = ranks[b"\0"]
        self.buffer = tiktoken.Encoding(self.family, pat_str=r"\x00|[^\x00]+\x00" if self.family == "word" else _BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_to_tiktoken_buffer

    def full(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _learn(self, keys: set) -> None:
        """The ids of the words ``keys`` into the cache, the plain ones by one call."""
        plain, odd = [], []
        for k in keys:
            text = k.decode()
            (plain if len(text) <= LONGEST and _PLAIN.fullmatch(text) else odd).append((k, text))
        if plain:
            ids = self._ids("\0".join(["\0".join(_PIECE.findall(t.lower())) + "\0" for _, t in plain]) + "\0")
            data, at = ids.tobytes(), 0
            for (k, _), end in zip(plain, np.flatnonzero(ids == self.ends).tolist(), strict=True):
                self.cache.add(k, data[4 * at : 4 * end])
                at = end + 1
        for k, t in odd:
            self.cache.add(k, self.full(t))

    def _words(self, words: list[bytes]) -> bytes:
        out = []
        for i in range(0, len(words), _AT_ONCE):
            some = words[i : i + _AT_ONCE]
            if missing := self.cache.missing(set(some)):
                self._learn(missing)
            out.append(b"".join(map(self.cache.new.__getitem__, some)))
        return b"".join(out)

    def _ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self.buffer(text, set()), np.uint32).astype("<u4", copy=False)

    def encode(self, text: str) -> bytes:
        if self.family == "word":
            return self._words(text.encode().split())
        if self.family == "other":
            return self.full(text)
        if _PLAIN_TEXT.fullmatch(text):
            return self._ids(text).tobytes()
        pieces = _CUT.split(text)
        if not all(_solid(a[-1]) and _solid(b[1]) for a, b in zip(pieces, pieces[1:])):
            return self.full(text)
        runs = groupby(pieces, key=lambda p: _PLAIN_TEXT.fullmatch(p) is not None)
        return b"".join([self._ids("".join(ps)).tobytes() if plain else self.full("".join(ps)) for plain, ps in runs])


def _solid(c: str) -> bool:
    """Whether no library takes the character for white space."""
    return "!" <= c <= "~" or unicodedata.category(c)[0] in "LNPSM"


@lru_cache(maxsize=1)
def encoder(path: str, kind: str | None = None) -> CachedEncoder:
    """One encoder a worker: that of the file last used; its cache serves all tasks of the worker."""
    return CachedEncoder(path, kind)
