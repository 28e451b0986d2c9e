"""Batch encoding with a public tokenizer file, on executors.

A text is cut into chunks (a run of white space and the word after it)
where a character that is no white space meets white space.  The byte-level
pre-tokenizer never joins characters over such a place, so the tokens of a
text are the tokens of its chunks, in order.  Every distinct chunk is encoded
once by the tokenizer library and kept in a bounded table, which lives as
long as the worker process.
"""

from __future__ import annotations

import json
import os
import re
from functools import cached_property

CHUNK = re.compile(r"\s*\S+|\s+")
# fixed values: characters on which regular-expression engines differ whether they are white space
UNSURE = re.compile("[\x1c-\x1f\x85᠎]")
# fixed values: outside ASCII text, Latin letters, general punctuation and the euro sign
DISPUTED = re.compile("[^\t\n\r -~¡-±´-¸º»¿-ɏ‐-…€]")
SAFE_CUT = re.compile(r"(?<=\S)(?=\s)")
KEEP_LEN = 48            # longer chunks are encoded, but not kept
KEEP = 500_000           # chunks kept in a worker
SEGMENT = 500_000        # characters of a long text that are cut into chunks at once
BATCH_CHARS = 2_000_000  # characters of the texts that are encoded together

_LOADED: dict = {}


def tokenizer_path(name: str) -> str:
    """Path of a public tokenizer file; resolved on the machine that encodes."""
    import public_tokenizers
    return public_tokenizers.path(name)


class Encoder:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, name: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.path = tokenizer_path(name)
        self.known: dict[str, bytes] = {}

    @cached_property
    def tok(self):
        from tokenizers import Tokenizer
        tok = Tokenizer.from_file(self.path)
        tok.no_truncation()
        tok.no_padding()
        return tok

    @classmethod
    def get(cls, name: str) -> "Encoder":
        if (cls, name) not in _LOADED:
            _LOADED[cls, name] = cls(name)
        return _LOADED[cls, name]

    def _encode(self, chunks: list[str]) -> list[bytes]:
        from array import array
        got = self.tok.encode_batch_fast(chunks, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in got]

    def segments(self, text: str):
        """Pieces of about SEGMENT characters, cut at safe places only."""
        start = 0
        while len(text) - start > SEGMENT:
            m = SAFE_CUT.search(text, start + SEGMENT)
            if m is None:
                break
            yield text[start:m.start()]
            start = m.start()
        yield text[start:] if start else text

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; the texts together should stay near BATCH_CHARS."""
        cut = [[text] if UNSURE.search(text) else
               [c for s in self.segments(text) for c in CHUNK.findall(s)] if len(text) > SEGMENT else CHUNK.findall(text)
               for text in texts]
        if len(self.known) > KEEP:
            self.known.clear()
        known = self.known
        new = [*{c for chunks in cut for c in chunks if c not in known}]
        fresh = dict(zip(new, self._encode(new)))
        known.update((c, ids) for c, ids in fresh.items() if len(c) <= KEEP_LEN)
        long = {c: ids for c, ids in fresh.items() if len(c) > KEEP_LEN}
        if long:
            return [b"".join([known[c] if len(c) <= KEEP_LEN else long[c] for c in chunks]) for chunks in cut]
        return [b"".join(map(known.__getitem__, chunks)) for chunks in cut]


class RankEncoder(Encoder):
    """The same ids from the vocabulary's rank file, by the rank-based library.

    Taken only for texts of characters whose classes no regular-expression engine disputes
    (``DISPUTED`` finds the others); the rest goes to the tokenizer file's own library."""

    def __init__(self, name: str):
        super().__init__(name)
        import base64
        import public_tokenizers
        import tiktoken
        with open(tokenizer_path(name.removesuffix(".json") + ".tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        with open(self.path) as f:
            added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        self.ranked = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)

    def encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for text in texts:
            if DISPUTED.search(text):
                out += super().encode([text])
            else:
                out.append(b"".join(self.ranked.encode_to_numpy(s, allowed_special="all").astype("<u4").tobytes()
                                    for s in (self.segments(text) if len(text) > SEGMENT else (text,))))
        return out


def byte_balanced(texts: list[str | None]):
    """Slices of ``texts`` whose characters together stay near BATCH_CHARS (a longer text is alone)."""
    start, chars = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and chars + n > BATCH_CHARS:
            yield start, i
            start, chars = i, 0
        chars += n
    if start < len(texts):
        yield start, len(texts)
