"""Interleaved document sequences: ordered text and media from HTML, payloads by digest.

``sequences`` parses pages into arrays of structs in reading order: text, or a media reference with its source, digest
and caption (the figure's caption, else the alternative text). ``store`` keeps payloads losslessly as grey pictures
of 8-bit samples, 24 wide (PGM: a header and the samples as they are), one row a picture in Parquet; a task stores equal
payloads once. ``features`` reads the pictures back and describes them. ``interleave`` joins references and
descriptions by digest: payloads themselves are never shuffled, only digests and descriptions of some hundred
bytes, and positions and captions stay with their references.

Defined cases: a null or empty text or payload is 576 bytes of 255; null HTML gives an empty sequence; a reference
whose digest is not stored keeps its place with null features; equal payloads give equal values; repeated rows are kept
each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import stored, texts

WIDTH, UNIT, FILL, TAIL = 24, 576, 255, 32
ITEM = "position int, kind string, text string, src string, digest string, caption string"
FEATURES = "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
_BREAKS = {"p", "div", "br", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "table", "tr", "article", "section", "nav", "header", "footer", "figure", "blockquote", "pre"}
_SILENT, _MEDIA = {"script", "style", "template", "noscript", "title"}, {"img", "video", "audio", "source", "embed"}
#: A document's page: name, digest, name, bytes, name, digest.
PAGE = (
    '<article><h1>%s</h1><figure><img data-digest="%s"><figcaption>%s</figcaption></figure><p>%d bytes</p>'
    '<img src="missing.png" alt="none of %s"><p>again</p><img data-digest="%s" alt="again"></article>'
)
#: Digests that a task remembers having stored.
REMEMBERED = 200_000


class _Reader(HTMLParser):
    """Collects text and media in reading order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.words: list[str] = []
        self.silent = 0
        self.figure: list[dict] = []  # of the open figures: where their items begin, and their captions with the place of each
        self.caption: list[tuple[int, str]] | None = None  # the open caption's data, with the items before each
        self.late: list[tuple[int, str]] = []  # texts that belong before the item of that number

    def flush(self) -> None:
        text = " ".join("".join(self.words).split())
        self.words.clear()
        if text:
            self.items.append({"kind": "text", "text": text})

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _SILENT:
            self.silent += 1
        elif tag == "figcaption":
            self.end_caption()
            self.flush()
            self.caption = []
        elif tag in _MEDIA:
            self.flush()
            given = dict(attrs)
            src = given.get("src") or ""
            digest = given.get("data-digest") or hashlib.sha256(src.encode("utf-8", "replace")).hexdigest()
            self.items.append({"kind": "media", "src": src, "digest": digest, "caption": given.get("alt")})
        elif tag in _BREAKS:
            self.flush()
            if tag == "figure":
                self.end_caption()
                self.figure.append({"start": len(self.items), "captions": []})

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag not in _SILENT:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in _SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "figcaption":
            self.end_caption()
        elif tag in _BREAKS:
            self.flush()
            if tag == "figure" and self.figure:
                self.end_figure()

    def end_caption(self) -> None:
        """The open caption waits for its figure's end; outside figures it is the last media's, or text."""
        if self.caption is None:
            return
        text, self.caption = " ".join("".join(d for _, d in self.caption).split()), None
        if text and self.figure:
            self.figure[-1]["captions"].append((len(self.items), text))
        elif text and self.items and self.items[-1]["kind"] == "media":
            self.items[-1]["caption"] = text
        elif text:
            self.items.append({"kind": "text", "text": text})

    def end_figure(self) -> None:
        """Captions go to the figure's media, or in their places as text if it has none."""
        self.end_caption()
        figure = self.figure.pop()
        media = [item for item in self.items[figure["start"] :] if item["kind"] == "media"]
        text = " ".join(t for _, t in figure["captions"])
        for item in media:
            if text and not item.get("captioned"):
                item |= {"caption": text, "captioned": True}
        if not media:
            self.late += figure["captions"]

    def end(self) -> None:
        """What is open at the end of the page is closed; an open caption is text, as the rest of the page is in it."""
        self.flush()
        for at in sorted({at for at, _ in self.caption or ()}):
            self.late.append((at, " ".join("".join(d for k, d in self.caption if k == at).split())))
        self.caption = None
        while self.figure:
            self.end_figure()
        for at, text in reversed(sorted(self.late, key=lambda x: x[0])):
            if text:
                self.items.insert(at, {"kind": "text", "text": text})

    def handle_data(self, data: str) -> None:
        if not self.silent:
            if self.caption is None:
                self.words.append(data)
            else:
                self.caption.append((len(self.items), data))


def read_html(html: str | None) -> list[dict]:
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    reader.end()
    names = [x.split()[0] for x in ITEM.split(", ")]
    return [{n: {"position": k, **item}.get(n) for n in names} for k, item in enumerate(reader.items)]


def sequences(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """key and items, the ordered structs (see ITEM) of every page."""
    kind = pa.list_(pa.struct([(n, pa.int32() if t == "int" else pa.string()) for n, t in (x.split() for x in ITEM.split(", "))]))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([read_html(h.as_py()) for h in batch.column(1)], kind)], names=[key, "items"])

    return pages.select(F.col(key).cast("long").alias(key), "html").mapInArrow(parse, f"{key} long, items array<struct<{ITEM.replace(' ', ':').replace(',:', ',')}>>")


def padded(raw: bytes) -> bytes:
    """The payload: filled up with 255 to a positive multiple of 576 bytes."""
    return raw + bytes([FILL]) * (-len(raw) % UNIT if raw else UNIT)


def store(payloads: DataFrame) -> DataFrame:
    """Of a column of bytes (null: empty): digest, n_bytes and the stored picture, as written and read again by Spark."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            rows = []
            for raw in batch.column(0):
                raw = raw.as_py() or b""
                payload = padded(raw)
                digest = hashlib.sha256(payload)
                if digest.digest() in seen:
                    continue
                if len(seen) < REMEMBERED:
                    seen.add(digest.digest())
                rows.append((digest.hexdigest(), len(raw), b"P5\n%d %d\n255\n" % (WIDTH, len(payload) // WIDTH) + payload))
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.binary()), strict=True)], names=["digest", "n_bytes", "media"])

    return stored(payloads.mapInArrow(draw, "digest string, n_bytes long, media binary"), "media")


def samples(media: bytes) -> np.ndarray:
    """The picture's samples, a row a line."""
    kind, size, depth, rest = media.split(b"\n", 3)
    width, height = map(int, size.split())
    if kind != b"P5" or depth != b"255" or len(rest) != width * height:
        raise ValueError("not an 8-bit PGM picture")
    return np.frombuffer(rest, np.uint8).reshape(height, width)


def describe(picture: np.ndarray) -> str:
    """Average hash and difference hash of an 8 by 8 reduction, and the mean sample."""
    small = picture.reshape(8, picture.shape[0] // 8, 8, picture.shape[1] // 8).mean((1, 3))
    average = np.packbits(small > small.mean()).tobytes().hex()
    return f"{average}:{np.packbits(small > np.roll(small, 1, axis=1)).tobytes().hex()}:{picture.mean():.4f}"


def features(media: DataFrame) -> DataFrame:
    """A row for each stored digest, all from the stored bytes (see FEATURES)."""
    names = [x.split()[0] for x in FEATURES.split(", ")]
    types = [pa.string() if x.endswith("string") else pa.int64() for x in FEATURES.split(", ")]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for digest, n_bytes, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                held = media.as_py()
                picture = samples(held)
                payload = picture.tobytes()
                rows.append((digest, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-TAIL:]), len(held), hashlib.sha256(held).hexdigest(), describe(picture)))
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    found = media.mapInArrow(look, FEATURES)
    # a text that ends in 255 bytes can't occur in UTF-8, but any bytes can: the shortest original is then told
    return found.groupBy("digest").agg(F.min(F.struct(*names[1:])).alias("f")).select("digest", "f.*")


def references(sequence: DataFrame, key: str = "page_id") -> DataFrame:
    """The media references of all sequences, a row each."""
    return sequence.select(key, F.inline("items")).filter("kind = 'media'")


def interleave(pages: DataFrame, payloads: DataFrame, key: str = "page_id") -> DataFrame:
    """key and items of every page row; media items carry the features of their payload, matched by digest.

    The join is by digest over references; each row's sequence, stored with a number of its own, is put together again by
    position.
    """
    return assembled(sequences(pages, key), stored(features(store(payloads)), "features"), key)


def assembled(sequence: DataFrame, known: DataFrame, key: str) -> DataFrame:
    numbered = stored(sequence.withColumn("__row", F.monotonically_increasing_id()), "sequences")
    flat = numbered.select("__row", key, F.explode_outer("items").alias("item"))
    joined = flat.join(known.withColumnRenamed("digest", "__known"), F.col("item.digest") == F.col("__known"), "left")
    media = F.when(F.col("__known").isNotNull(), F.struct(*[c for c in known.columns if c != "digest"])).alias("media")
    item = F.struct("item.position", "item.kind", "item.text", "item.src", "item.digest", "item.caption", media)
    whole = joined.groupBy("__row").agg(F.first(key).alias(key), F.array_sort(F.collect_list(F.when(F.col("item").isNotNull(), item))).alias("items"))
    return whole.select(key, "items")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a page: its name, a figure of its text as payload, a media reference that nothing is stored for,
    and its payload once more. What is told of the payload comes from the figure; the rest shows order and captions."""
    return described(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def described(docs: DataFrame) -> DataFrame:
    docs = texts(docs)
    raw = F.encode("text", "UTF-8")
    known = stored(features(store(docs.select(raw.alias("payload")))), "features")
    n = F.octet_length("text")
    fill = F.when(n == 0, UNIT).otherwise(F.pmod(-n, F.lit(UNIT)))
    digest = F.sha2(F.concat(raw, F.unhex(F.repeat(F.lit("FF"), fill))), 256)
    name = F.concat_ws(" ", F.lit("document"), F.col("doc_id"))
    html = F.format_string(PAGE, name, digest, name, n, name, digest)
    found = assembled(sequences(docs.select("doc_id", html.alias("html")), "doc_id"), known, "doc_id")
    media = F.filter("items", lambda i: i.kind == "media")
    first = F.get(media, 0)
    return found.select(
        "doc_id", *[first.media.getField(c).alias(c) for c in known.columns if c != "digest"], first.position.alias("position"), first.caption.alias("caption"),
        F.size("items").alias("n_items"), F.array_join(F.transform("items", lambda i: i.kind), ",").alias("kinds"),
        F.array_join(F.transform(media, lambda i: F.concat_ws("=", i.caption, F.coalesce(i.media.payload_sha256, F.lit("-")))), ";").alias("aligned"),
    )
