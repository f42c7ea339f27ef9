"""Media columns: interleaved sequences of text and media references from HTML, and media that digests resolve."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

WIDTH = 64
SCHEME = "media:sha256-"
_BLOCKS = {"p", "div", "article", "section", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "table", "tr", "td", "br", "figure", "nav", "header", "footer", "blockquote", "pre", "body", "title", "figcaption"}
_SKIPPED = {"script", "style", "template", "noscript"}
_MEDIA = {"img": "image", "video": "video", "audio": "audio", "source": "media", "embed": "media"}
SEQUENCE = "array<struct<pos:int,kind:string,text:string,media_digest:string,caption:string>>"


class _Interleaved(HTMLParser):
    """Collects text blocks and media references in order; a figure's caption belongs to the media inside it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.text: list[str] = []
        self.skipped, self.figure, self.caption = 0, [], None

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.items.append({"kind": "text", "text": text, "media_digest": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        if tag in _SKIPPED:
            self.skipped += 1
        if tag in _BLOCKS:
            self.flush()
        if tag == "figure":
            self.figure.append([])
        if tag == "figcaption":
            self.caption = []
        found = dict(attrs)
        if tag in _MEDIA and found.get("src"):
            self.flush()
            src = found["src"]
            digest = src.removeprefix(SCHEME) if src.startswith(SCHEME) else hashlib.sha256(src.encode("utf-8", "replace")).hexdigest()
            item = {"kind": _MEDIA[tag], "text": None, "media_digest": digest, "caption": found.get("alt") or None}
            self.items.append(item)
            if self.figure:
                self.figure[-1].append(item)

    def handle_endtag(self, tag):
        if tag in _SKIPPED and self.skipped:
            self.skipped -= 1
        if tag == "figcaption" and self.caption is not None:
            caption, self.caption = " ".join("".join(self.caption).split()), None
            for item in self.figure[-1] if self.figure else []:
                item["caption"] = caption or item["caption"]
        elif tag in _BLOCKS:
            self.flush()
        if tag == "figure" and self.figure:
            self.figure.pop()

    def handle_data(self, data):
        if not self.skipped:
            (self.text if self.caption is None else self.caption).append(data)


def interleaved(html: str | None) -> list[dict]:
    """Ordered items of a page; broken markup gives what can be read of it, null or empty pages give none."""
    parser = _Interleaved()
    try:
        parser.feed(html or "")
        parser.close()
    except (AssertionError, ValueError):
        pass  # a declaration that cannot be read ends the page
    parser.flush()
    return [{"pos": i, **x} for i, x in enumerate(parser.items)]


def parse_pages(pages: DataFrame, key: str = "page_id", html: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """``(key, keep..., sequence)``: text and media-reference structs of every whole page in order, one row per page.

    Null and empty pages have an empty sequence, null keys stay, repeated rows are parsed each; other columns are ignored.
    """
    names = [f"c{i}" for i in range(len(keep))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[["key", *names]].assign(sequence=[interleaved(h) for h in batch["html"]])

    # whole numbers go through pandas as text, since a null would turn a column of them into floats
    rows = pages.select(F.col(key).cast("string").alias("key"), F.col(html).cast("string").alias("html"), *[F.col(c).cast("string").alias(n) for c, n in zip(keep, names, strict=True)])
    schema = "key string, " + "".join(f"{n} string, " for n in names) + f"sequence {SEQUENCE}"
    kinds = {f.name: f.dataType for f in pages.schema}
    return rows.mapInPandas(run, schema).select(F.col("key").cast("long").alias(key), *[F.col(n).cast(kinds[c]).alias(c) for c, n in zip(keep, names, strict=True)], "sequence")


def resolve(parsed: DataFrame, media: DataFrame, key: str = "page_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per media reference, ``(key, keep..., pos, n_items, kind, caption, media_digest, resolved, ...)``, with the columns of ``media``.

    ``pos`` is the reference's place among all ``n_items`` items of its page, text too, so text before and after it stays aligned.
    ``media`` has one row per media_digest. References join by digest on a shuffle, which adaptive execution splits where one
    digest is very frequent. References without media stay with ``resolved`` false; pages without references, and an empty
    table, give no rows; rows with null or repeated keys keep a row for each of their references.
    """
    refs = parsed.select(key, *keep, F.size("sequence").alias("n_items"), F.explode("sequence").alias("s")).where("s.media_digest is not null")
    refs = refs.select(key, *keep, "s.pos", "n_items", "s.kind", "s.caption", "s.media_digest")
    return refs.join(media.withColumn("resolved", F.lit(True)), "media_digest", "left").withColumn("resolved", F.coalesce("resolved", F.lit(False)))


def image_of(payload: bytes) -> bytes:
    """A payload, whose length is a multiple of WIDTH, as a binary grey map of 8-bit samples (PGM, P5)."""
    if not payload or len(payload) % WIDTH:
        raise ValueError("payload must be a positive multiple of the width")
    return b"P5\n%d %d\n255\n" % (WIDTH, len(payload) // WIDTH) + payload


def samples_of(image: bytes) -> bytes:
    """The samples of a grey map that ``image_of`` made, checked against its header."""
    magic, size, top, samples = image.split(b"\n", 3)
    width, height = map(int, size.split())
    if magic != b"P5" or top != b"255" or len(samples) != width * height:
        raise ValueError("not a whole 8-bit grey map")
    return samples


def padded(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes with zeros up to a positive multiple of WIDTH, and how many there were before."""
    raw = (text or "").encode("utf-8")
    return raw + b"\0" * (max(1, -(-len(raw) // WIDTH)) * WIDTH - len(raw)), len(raw)


def feature_text(samples: bytes) -> str:
    """Mean, deviation and entropy of the samples, and the difference of neighbouring rows: equal samples, equal text."""
    x = np.frombuffer(samples, dtype=np.uint8)
    share = np.bincount(x, minlength=256) / len(x)
    entropy = -(share[share > 0] * np.log2(share[share > 0])).sum()
    rows = x.reshape(-1, WIDTH).astype(np.int16)
    step = np.abs(np.diff(rows, axis=0)).mean() if len(rows) > 1 else 0.0
    return f"mean={x.mean():.4f};std={x.std():.4f};entropy={entropy:.4f};step={step:.4f}"


def text_page(doc: str | None, text: str, digest: str) -> str:
    """A document as a page: its text in paragraphs with its image after the line in the middle."""
    cut = text.find("\n", len(text) // 2) + 1 or len(text)
    before, after = ("".join(f"<p>{escape(x, quote=False)}</p>" for x in part.split("\n") if x) for part in (text[:cut], text[cut:]))
    return f'{before}<figure><img src="{SCHEME}{digest}"><figcaption>document {doc}</figcaption></figure>{after}'


def text_pages(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, html)`` of documents: pages of their text that refer to the text's image by digest."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                payload, n = padded(text)
                rows.append((doc, n, text_page(doc, text or "", hashlib.sha256(image_of(payload)).hexdigest())))
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "html"])

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, "doc_id string, n_bytes long, html string")
    return rows.withColumn("doc_id", F.col("doc_id").cast("long"))


def text_media(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(pages, media)`` of documents: their ``text_pages``, and their images (media_digest, image), written to the shared folder.

    Null texts count as empty and have an image of zeros. A batch of a task writes equal images once, so repeated rows share one.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            images = [image_of(padded(t)[0]) for t in batch["text"].drop_duplicates()]
            yield pd.DataFrame({"media_digest": [hashlib.sha256(x).hexdigest() for x in images], "image": images})

    return text_pages(docs), materialise(docs.select("text").mapInPandas(run, "media_digest string, image binary"), "media", keep=True)


def media_features(media: DataFrame) -> DataFrame:
    """One row per media_digest, from the stored bytes read back: sizes, digests and features."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for digest, image in zip(batch["media_digest"], batch["image"], strict=True):
                samples = samples_of(image)
                rows.append((digest, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-WIDTH:]), len(image), hashlib.sha256(image).hexdigest(), feature_text(samples)))
            yield pd.DataFrame(rows, columns=["media_digest", *names])

    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    found = media.mapInPandas(run, "media_digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return found.groupBy("media_digest").agg(*[F.min(c).alias(c) for c in names])
