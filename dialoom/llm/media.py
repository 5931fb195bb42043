"""Interleaved documents: ordered text and media references, with payloads resolved by digest.

A page is parsed into items (pos, kind, text, ref, caption): `text` items hold a block's text, `media` items
a reference and the caption that stands with it (figcaption, else alt). References of the form
``urn:sha256:<hex>`` resolve through a content-addressed store, a table (digest, media, ...). The stored form
is a binary PPM picture, 64 pixels wide: each row holds 192 payload bytes as 8-bit RGB samples, so the payload
comes back byte for byte.

Defined results: a null html or text counts as empty; an empty text is stored as one row of blanks; repeated
rows give repeated rows; a reference that the store lacks keeps its item, with null payload columns; an empty
table gives an empty table; only the named columns are read, so further columns can't clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.llm.common import scratch, table, text_of

ROW = 192
ITEMS = "array<struct<pos:int,kind:string,text:string,ref:string,caption:string>>"
_BREAKS = {"p", "div", "br", "h1", "h2", "h3", "h4", "h5", "h6", "li", "tr", "td", "article", "section", "figure", "figcaption", "ul", "ol", "table", "blockquote"}
_MEDIA = {"img", "video", "audio", "source", "embed"}
_SILENT = {"script", "style", "template", "noscript"}


class _Items(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[list] = []
        self.buffer: list[str] = []
        self.silent, self.caption, self.figure = 0, False, []

    def flush(self) -> None:
        text = re.sub(r"\s+", " ", "".join(self.buffer)).strip()
        self.buffer = []
        if not text:
            return
        if self.caption and self.figure:
            for k in self.figure:
                self.items[k][4] = text
        else:
            self.items.append([len(self.items), "text", text, None, None])

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _SILENT:
            self.silent += 1
        if tag in _BREAKS or tag in _MEDIA:
            self.flush()
        if tag == "figure":
            self.figure = []
        if tag == "figcaption":
            self.caption = True
        if tag in _MEDIA:
            got = dict(attrs)
            if got.get("src"):
                self.figure.append(len(self.items))
                self.items.append([len(self.items), "media", None, got["src"], got.get("alt")])

    def handle_endtag(self, tag: str) -> None:
        if tag in _SILENT:
            self.silent = max(0, self.silent - 1)
        if tag in _BREAKS:
            self.flush()
        if tag == "figcaption":
            self.caption = False
        if tag == "figure":
            self.figure = []

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.buffer.append(data)


def parse_items(html: str | None) -> list[dict]:
    parser = _Items()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return [dict(zip(("pos", "kind", "text", "ref", "caption"), x)) for x in parser.items]


def interleave(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, items): the ordered items of each page."""
    kind = pa.list_(pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())]))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(parse_items, b.column(1).to_pylist()), kind)], ["key", "items"])

    picked = pages.select(F.col(key).alias("key"), F.col(html).alias("html"))
    return picked.mapInArrow(parse, f"key {picked.schema['key'].dataType.simpleString()}, items {ITEMS}").withColumnRenamed("key", key)


def resolve(sequences: DataFrame, store: DataFrame, key: str = "page_id") -> DataFrame:
    """One row per item, in its position, with the store's columns for media items whose digest it holds.

    `store` has one row a digest. A digest that very many items share is a join key whose shuffle partition
    adaptive execution splits; nothing is broadcast by hint."""
    items = sequences.select(key, F.explode("items").alias("i")).select(key, "i.*")
    items = items.withColumn("digest", F.regexp_extract("ref", r"^urn:sha256:([0-9a-f]{64})$", 1))
    return items.join(store, "digest", "left")


def text_payloads(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, digest, media): each whole text as a PPM picture; JVM expressions only."""
    raw = docs.select(F.col(key).alias(key), F.encode(text_of(text), "UTF-8").alias("raw"))
    rows = F.greatest(F.lit(1), F.ceil(F.length("raw") / ROW)).cast("int")
    padded = raw.select(key, F.length("raw").cast("long").alias("n_bytes"), rows.alias("h"), F.concat("raw", F.repeat(F.lit(" "), (rows * ROW - F.length("raw")).cast("int")).cast("binary")).alias("payload"))
    media = F.concat(F.concat(F.lit("P6\n64 "), F.col("h").cast("string"), F.lit("\n255\n")).cast("binary"), "payload")
    return padded.select(key, "n_bytes", F.sha2("payload", 256).alias("digest"), media.alias("media"))


def picture_feature(pixels: np.ndarray) -> str:
    """Height, mean of each channel and a 64-bit average hash over an 8 x 8 grid of brightness."""
    h = pixels.shape[0]
    bright = pixels.sum(axis=2, dtype=np.int64).reshape(h, 8, 8).sum(axis=2)
    edge = np.arange(9) * h // 8
    total = np.concatenate([np.zeros((1, 8), np.int64), np.cumsum(bright, axis=0)])
    span = np.maximum(edge[1:] - edge[:-1], 1)
    low = np.minimum(edge[:-1], h - 1)
    cells = (total[low + span] - total[low]) / span[:, None]
    bits = (cells > cells.mean()).ravel()
    mean = pixels.reshape(-1, 3).mean(axis=0)
    return f"{h}:{mean[0]:.3f}:{mean[1]:.3f}:{mean[2]:.3f}:{np.packbits(bits).tobytes().hex()}"


def read_features(store: DataFrame) -> DataFrame:
    """(digest, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature), from the stored bytes.

    A digest stored more than once (by tasks that don't know of each other) gives one row."""
    media_of = F.col("media")
    head = F.length(F.regexp_extract(F.decode(F.substring("media", 1, 24), "ISO-8859-1"), r"^P6\n\d+ \d+\n255\n", 0))
    payload = F.substring(media_of, head + 1, F.length("media"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [picture_feature(np.frombuffer(x, np.uint8).reshape(-1, 64, 3)) for x in (y.as_buffer() for y in b.column(6))]
            yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(out, pa.string())], [*b.schema.names[:6], "feature"])

    picked = store.select("digest", payload.alias("payload"), "media").select(
        "digest", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring(F.col("payload"), F.length("payload") - 15, F.lit(16))).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "payload",
    )
    schema = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    rows = picked.mapInArrow(features, schema)
    return rows.groupBy("digest").agg(*(F.first(c).alias(c) for c in rows.columns if c != "digest"))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store every document's text as a picture, refer to it from a page, parse the page, resolve and read back."""
    path = scratch(spark, "media")
    text_payloads(table(spark, sf_dir, "documents")).write.option("compression", "zstd").parquet(path)
    store = spark.read.parquet(path)
    page = F.format_string('<article><p data-bytes="%d">%d</p><figure><img src="urn:sha256:%s" alt="text"><figcaption>%d bytes</figcaption></figure></article>', "n_bytes", F.coalesce("doc_id", F.lit(-1)), "digest", "n_bytes")
    items = resolve(interleave(store.select("doc_id", page.alias("html")), "doc_id"), read_features(store), "doc_id")
    n = F.regexp_extract("caption", r"^(\d+) bytes$", 1).cast("long")
    return items.where("kind = 'media'").select("doc_id", n.alias("n_bytes"), "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pos", "caption")
