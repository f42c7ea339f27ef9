"""Token ids of texts through tables of distinct chunks: each distinct chunk is tokenised once, ids come back by position."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

#: Distinct chunks that a task remembers at most; the table starts anew beyond it.
MAX_CHUNKS = 250_000
#: Longer chunks are tokenised where they stand and not remembered.
MAX_CHUNK_CHARS = 64


class ChunkTable:
    """Distinct chunks with their ids as little-endian unsigned 32-bit integers.

    ``encode_many`` tokenises a list of chunks. The table keeps the first MAX_CHUNKS distinct chunks of up to MAX_CHUNK_CHARS
    characters that a task meets, which are the frequent ones; others are there for the texts that were learned last alone.
    """

    def __init__(self, encode_many: Callable[[list[str]], list[bytes]]):
        self.encode_many, self.ids, self.fresh = encode_many, {}, []

    def learn(self, texts: Iterable[list[str]]) -> None:
        new = set()
        for chunks in texts:
            new.update(chunks)
        new.difference_update(self.ids)
        self.fresh = list(new)
        if new:
            self.ids.update(zip(self.fresh, self.encode_many(self.fresh), strict=True))

    def forget(self) -> None:
        full = len(self.ids) > MAX_CHUNKS
        for chunk in self.fresh:
            if full or len(chunk) > MAX_CHUNK_CHARS:
                del self.ids[chunk]
        self.fresh = []

    def joined(self, chunks: list[str]) -> bytes:
        return b"".join(map(self.ids.__getitem__, chunks))


#: Byte-level BPE cuts a text before the last blank of a run that a visible character follows, whatever stands around it.
_CUT = re.compile(r" (?=\S)")
_UNSAFE = re.compile(r" \s| $")


def blank_chunks(text: str) -> list[str]:
    """Cuts of a text that byte-level pre-tokenisation never crosses; the first has no leading blank, the others do.

    Python's ``\\s`` also takes U+001C to U+001F, which the tokenizer's pattern does not: those texts stay in one chunk.
    """
    if not text:
        return []
    if _UNSAFE.search(text) is None:
        first, *rest = text.split(" ")
    elif re.search("[\x1c-\x1f]", text):
        return [text]
    else:
        first, *rest = _CUT.split(text)
    # a blank that starts the text belongs to the chunk after it
    return [first, *[" " + x for x in rest]] if first else [" " + x for x in rest]


def byte_bpe(path: str, ranks_path: str | None = None) -> ChunkTable:
    """Chunk table of a byte-level BPE file of the tokenizers library; special strings in a text are special, as by default.

    ``ranks_path``: the same vocabulary as ranks for tiktoken, which has less to do for a short chunk; chunks with a special
    string still go to the tokenizers library. Both give the same ids, as tests confirm.
    """
    import base64
    from array import array

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    whole = lambda chunk: array("I", tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()
    if ranks_path is None:
        return ChunkTable(lambda chunks: [whole(c) for c in chunks])
    import tiktoken
    from public_tokenizers import PATTERN

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode_many(chunks: list[str]) -> list[bytes]:
        return [whole(c) if any(s in c for s in special) else array("I", fast(c)).tobytes() for c in chunks]

    return ChunkTable(encode_many)
