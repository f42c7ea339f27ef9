"""SentencePiece encoding and decoding through distinct marked words."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import ChunkTable

#: The marker that stands for a blank inside pieces.
MARKER = "▁"
#: A marked word starts at a run of markers (blanks) or at a line feed and ends before the next one.
_MARKED = re.compile(r" *[^ \n]+| +|\n[^ \n]*")


def pieces_stay_in_words(processor) -> bool:
    """Whether no piece has a marker after another character, or a line feed: then merges never cross marked words."""
    pieces = (processor.id_to_piece(i) for i in range(processor.get_piece_size()))
    return not any(MARKER in p.lstrip(MARKER) or "\n" in p for p in pieces)


def marked_words(text: str) -> list[str]:
    """The text with its dummy marker, cut into marked words; "" gives none. A marker in the text stands for a blank."""
    if not text:
        return []
    text = text.replace(MARKER, " ")
    if "\n" not in text and "  " not in text and text[-1] != " " and text[0] != " ":
        return [" " + x for x in text.split(" ")]
    return _MARKED.findall(" " + text)


def marked_table(processor) -> ChunkTable:
    """Ids of marked words. The processor adds a marker itself: one blank less is handed over, or its id is cut off."""
    import numpy as np

    def encode_many(words: list[str]) -> list[bytes]:
        given = [w[1:] if w[0] == " " else w for w in words]
        out = []
        for word, ids in zip(words, processor.encode(given, num_threads=1), strict=True):
            if word == " ":  # a marker alone, which the library does not add to an empty text
                ids = [processor.piece_to_id(MARKER)]
            elif word[0] == "\n":
                ids = ids[1:]
            out.append(np.asarray(ids, dtype="<u4").tobytes())
        return out

    return ChunkTable(encode_many)


#: What ``encode_documents`` can return of a document.
COLUMNS = {"ids": "binary", "n_tokens": "long", "ids_sha256": "string", "decoded": "string", "decoded_sha256": "string"}


def encode_documents(docs: DataFrame, model_path: str, text: str = "text", doc_id: str = "doc_id", columns: tuple[str, ...] = tuple(COLUMNS)) -> DataFrame:
    """``doc_id`` and ``columns`` of COLUMNS: the ids as little-endian unsigned 32-bit integers, how many, the SHA-256 of their
    decimal form joined by commas, the text that ``decode(ids)`` gives, and the SHA-256 of that.

    Each Arrow batch of documents makes a table of its distinct marked words, of which every new one is segmented once; a
    document's ids are joined back by position inside its own row. So no word occurrence is shuffled: a join over all
    occurrences would move the corpus twice. Words stay with the task between batches within a fixed bound. If a model has
    pieces that cross marked words, whole texts are handed to the library instead.
    Null or empty texts have no ids and decode to "". Repeated rows give repeated results. Other columns are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=model_path)
        words, cut = marked_table(processor), marked_words
        if not pieces_stay_in_words(processor):
            cut = lambda t: [t] if t else []
            words = ChunkTable(lambda many: [np.asarray(x, dtype="<u4").tobytes() for x in processor.encode(many, num_threads=1)])
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.iloc[start : start + 256]
                chunks = [cut(t or "") for t in part["text"]]
                words.learn(chunks)
                coded = [words.joined(c) for c in chunks]
                words.forget()
                ids = [np.frombuffer(x, dtype="<u4").tolist() for x in coded]
                out = {"doc_id": part["doc_id"], "ids": coded, "n_tokens": [len(x) for x in ids]}
                if "ids_sha256" in columns:
                    out["ids_sha256"] = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in ids]
                out["decoded"] = [processor.decode(x) if x else "" for x in ids]
                out["decoded_sha256"] = [hashlib.sha256(x.encode()).hexdigest() for x in out["decoded"]]
                yield pd.DataFrame({k: out[k] for k in ("doc_id", *columns)})

    schema = "doc_id long, " + ", ".join(f"{c} {COLUMNS[c]}" for c in columns)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInPandas(run, schema)
