"""Operator 5: interleaved document sequences with media columns.

HTML parsing turns a page into an ordered array of structs: text segments and references to media,
each with its position; a reference carries the digest of its payload, and the caption of the
figure around it. Payloads live in a media table keyed by their digest; a digest join on rows of
fixed size (never on payload bytes) resolves the references.

Media are stored as binary PPM images: 8-bit RGB samples, 64 pixels (192 bytes) to a row, so any
payload padded to a multiple of 192 bytes is stored without loss and read back byte by byte.

A caption belongs to the media of its figure, before or after it; that of a figure without media, or
outside a figure, is text. A caption or figure that isn't closed ends with what it stands in, at the
latest with the page: no words are lost.

Edge cases: null and empty texts give one row of 192 spaces; null html gives an empty
sequence; very long texts are one payload each, in Arrow batches bounded by bytes; a reference
that no medium has keeps its place with a null payload; equal payloads are one medium (ties do not
arise: equal digests have equal rows); repeated rows give repeated rows; empty tables give no rows;
other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ROW = 192
SEGMENT = "struct<position:int,kind:string,text:string,digest:string,caption:string>"
BLOCKS = frozenset("address article aside blockquote dd div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
MEDIA = frozenset("img video audio".split())
SILENT = frozenset("script style template noscript".split())


class Interleaver(HTMLParser):
    """Collects text segments and media references in page order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[dict] = []
        self.text: list[str] = []
        self.silent = 0
        #: Open figures: their media, the captions met before any medium, and the caption so far.
        self.figures: list[dict] = []
        self.caption: list[str] | None = None

    def add(self, kind: str, text: str | None = None, digest: str | None = None, caption: str | None = None) -> dict:
        self.out.append({"kind": kind, "text": text, "digest": digest, "caption": caption})
        return self.out[-1]

    def flush(self) -> None:
        words = " ".join("".join(self.text).split())
        self.text = []
        if words:
            self.add("text", words)

    def end_caption(self) -> None:
        words, self.caption = " ".join("".join(self.caption or []).split()), None
        if not words:
            return
        if not self.figures:
            self.add("text", words)
            return
        figure = self.figures[-1]
        figure["words"] = f"{figure['words']} {words}".strip()
        for medium in figure["media"]:
            medium["caption"] = figure["words"]
        if not figure["media"]:
            figure["early"].append(self.add("text", words))

    def end_figure(self) -> None:
        self.end_caption()
        self.flush()
        if self.figures:
            self.figures.pop()

    def medium(self, tag: str, given: dict[str, str | None]) -> None:
        source, caption = given.get("src") or "", given.get("alt") or None
        digest = source.removeprefix("sha256:") if source.startswith("sha256:") else hashlib.sha256(source.encode("utf-8", "surrogatepass")).hexdigest()
        if self.figures:
            figure = self.figures[-1]
            caption = figure["words"] or caption
            for early in figure["early"]:
                early["kind"] = None
            figure["early"].clear()
            figure["media"].append(self.add(tag, digest=digest, caption=caption))
        else:
            self.add(tag, digest=digest, caption=caption)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in SILENT:
            self.silent += 1
        elif tag in MEDIA and not self.silent:
            self.flush()
            self.medium(tag, dict(attrs))
        elif tag == "figcaption":
            self.end_caption()
            self.flush()
            self.caption = []
        elif tag == "br":
            self.handle_data(" ")
        elif tag in BLOCKS:
            if self.caption is not None and tag != "figure":
                self.caption.append(" ")
            else:
                self.end_caption()
                self.flush()
            if tag == "figure":
                self.figures.append({"media": [], "early": [], "words": ""})

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in SILENT:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "figcaption":
            self.end_caption()
        elif tag == "figure":
            self.end_figure()
        elif tag in BLOCKS:
            if self.caption is not None:
                self.caption.append(" ")
            self.flush()

    def handle_data(self, data: str) -> None:
        if not self.silent:
            (self.text if self.caption is None else self.caption).append(data)


def interleave(html: str | None) -> list[dict]:
    """The sequence of a page."""
    parser = Interleaver()
    parser.feed(html or "")
    parser.close()
    parser.end_caption()
    parser.flush()
    return [{"position": i, **s} for i, s in enumerate(s for s in parser.out if s["kind"])]


def store(payload: bytes) -> bytes:
    """A payload of a multiple of ROW bytes as a binary PPM image."""
    return b"P6\n64 %d\n255\n" % (len(payload) // ROW) + payload


def read_back(media: bytes) -> bytes:
    """The samples of a stored image."""
    kind, size, depth, samples = media.split(b"\n", 3)
    width, height = map(int, size.split())
    if kind != b"P6" or depth != b"255" or len(samples) != 3 * width * height:
        raise ValueError("not an 8-bit PPM image of whole rows")
    return samples


def feature(samples: bytes) -> str:
    """Mean and deviation of each colour, and 64 bits: which of 64 bands of the image are bright."""
    x = np.frombuffer(samples, np.uint8).reshape(-1, 3)
    ends = np.arange(65) * x.size // 64
    means = np.add.reduceat(x.reshape(-1), ends[:-1], dtype=np.int64) / np.diff(ends)
    bits = int.from_bytes(np.packbits(means > np.median(means)).tobytes())
    return " ".join(f"{v:.3f}" for v in (*x.mean(0), *x.std(0))) + f" {bits:016x}"


def sequences(pages: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """keys and seq, the interleaved sequence of each page."""
    common.small_batches(pages.sparkSession)

    def parsed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pages.map(interleave)

    return pages.select(*keys, F.pandas_udf(parsed, f"array<{SEGMENT}>")(F.coalesce(F.col(html), F.lit(""))).alias("seq"))


def media_table(payloads: DataFrame) -> DataFrame:
    """digest and media (the stored form) of each payload, written to the shared folder."""
    common.small_batches(payloads.sparkSession)

    def stored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for payloads in batches:
            yield pd.DataFrame({"digest": [hashlib.sha256(p).hexdigest() for p in payloads], "media": [store(bytes(p)) for p in payloads]})

    rows = payloads.select(F.pandas_udf(stored, "struct<digest:string,media:binary>")("payload").alias("m"))
    return common.write_shared(rows.select("m.*"), "media")


def resolved(media: DataFrame) -> DataFrame:
    """One row per digest, of fixed size: what reading the stored bytes back gives.

    Written, so that the join to come has an exchange of its own, in which Spark can split the
    references of a common digest.
    """
    common.small_batches(media.sparkSession)
    shape = "struct<payload_bytes:long,payload_sha256:string,tail_crc32:long,media_bytes:long,media_sha256:string,feature:string>"

    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for stored in batches:
            rows = []
            for m in stored:
                samples = read_back(bytes(m))
                rows.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature(samples)))
            yield pd.DataFrame(rows, columns=["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    rows = media.select("digest", F.pandas_udf(read, shape)("media").alias("r")).select("digest", "r.*")
    return common.write_shared(rows.dropDuplicates(["digest"]), "resolved")


def references(sequences: DataFrame, keys: list[str]) -> DataFrame:
    """keys, position, kind, digest, caption of the media references, in page order."""
    return sequences.select(*keys, F.explode("seq").alias("s")).where("s.digest is not null").select(*keys, "s.position", "s.kind", "s.digest", "s.caption")


def payload_of(text: Column) -> Column:
    """UTF-8 bytes of a text, padded with spaces to a positive multiple of ROW."""
    n = F.octet_length(text)
    rows = F.greatest(F.ceil(n / ROW), F.lit(1)).cast("int")
    return F.encode(F.concat(text, F.repeat(F.lit(" "), rows * ROW - n)), "UTF-8")


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a page: its text, then a figure whose image is the text's payload."""
    text = common.whole_text()
    docs = common.table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))
    docs = docs.select("doc_id", "text", F.octet_length("text").cast("long").alias("n_bytes"), payload_of(F.col("text")).alias("payload"))
    safe = F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    figure = [F.lit('<figure><img src="sha256:'), F.sha2("payload", 256), F.lit('"><figcaption>payload of '), F.col("n_bytes").cast("string"), F.lit(" bytes</figcaption></figure>")]
    pages = docs.select("doc_id", "n_bytes", F.concat(F.lit("<article><p>"), safe, F.lit("</p>"), *figure, F.lit("</article>")).alias("html"))
    media = resolved(media_table(docs.select("payload")))
    found = references(sequences(pages, ["doc_id", "n_bytes"]), ["doc_id", "n_bytes"]).join(media, "digest", "left")
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")
