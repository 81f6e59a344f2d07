"""Media columns: interleaved document sequences whose media references are resolved by digest.

HTML is parsed into an ordered array of structs: runs of text, and media references with their captions. Payloads
lie in a table of their own, keyed by digest, in a lossless 8-bit form (binary PGM, 64 samples a row). A sequence
carries digests only; joins by digest resolve them, so payloads are not moved with documents, and positions and
captions stay where the parser put them.
"""

from __future__ import annotations

import hashlib
import html
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as C
from tessera.llm.common import materialize

#: Samples in a row; digests that a task remembers.
WIDTH, MEMORY = 64, 1 << 20
SEGMENT = "array<struct<position:int,kind:string,text:string,ref:string,caption:string>>"
_NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)")
_PLAIN = re.compile(r"[^<>\"']*")
_ATTRIBUTE = re.compile(r"(?<![-\w:.])([a-zA-Z_:][-\w:.]*+)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]++))")
_HIDDEN = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style")}
#: Quoted strings that a tag may have.
QUOTED = 256
_MEDIA = {"img", "video", "audio", "source", "embed"}
_BLOCK = {"p", "div", "br", "li", "ul", "ol", "tr", "td", "th", "table", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "figure", "blockquote", "pre", "hr"}


def tags(source: str) -> Iterator[tuple[str, str, bool, str]]:
    """(text before, tag name, whether it closes, its attributes) in order, the last with an empty name for the rest.

    Comments, and scripts and styles with what is in them, are left out; an unclosed one runs to the end. What looks
    like a tag but has no end, or over QUOTED quoted strings, is text. Time is in proportion to the page, or to
    QUOTED times its tags.
    """
    text, at, n = [], 0, len(source)
    open_quote = {'"': True, "'": True}  # whether a further one is to be found
    while True:
        start = source.find("<", at)
        if start < 0:
            break
        text.append(source[at:start])
        if source.startswith("<!--", start):
            end = source.find("-->", start + 4)
            at = n if end < 0 else end + 3
            continue
        name = _NAME.match(source, start)
        end = name.end() if name else -1
        for _ in range(QUOTED + 1) if name else ():
            end = _PLAIN.match(source, end).end()
            quote = source[end : end + 1]
            if quote not in open_quote:
                break
            close = source.find(quote, end + 1) if open_quote[quote] else -1
            if close < 0:
                open_quote[quote], end = False, -1
                break
            end = close + 1
        if end < 0 or source[end : end + 1] != ">":
            text.append("<")
            at = start + 1
            continue
        tag, closes, at = name[2].lower(), bool(name[1]), end + 1
        if tag in _HIDDEN and not closes:
            found = _HIDDEN[tag].search(source, at)
            at = found.end() if found else n
            continue
        yield "".join(text), tag, closes, source[name.end() : end]
        text.clear()
    yield "".join([*text, source[at:]]), "", False, ""


def parse_html(source: str | None) -> list[dict]:
    """Text runs and media references in document order; a figure's caption goes to its last reference."""
    out: list[dict] = []
    text: list[str] = []
    caption: list[str] | None = None
    figure = None  # place in ``out`` of the reference that a caption belongs to

    def flush() -> None:
        run = " ".join(html.unescape("".join(text)).split())
        text.clear()
        if run:
            out.append({"position": len(out), "kind": "text", "text": run, "ref": None, "caption": None})

    for before, name, closes, attributes in tags(source or ""):
        (text if caption is None else caption).append(before)
        if name == "figure":
            flush()
            figure = None
        elif name == "figcaption":
            if not closes:
                flush()
                caption = []
            elif caption is not None:
                said, caption = " ".join(html.unescape("".join(caption)).split()), None
                if figure is not None:
                    out[figure]["caption"] = said
                elif said:
                    out.append({"position": len(out), "kind": "text", "text": said, "ref": None, "caption": None})
        elif name in _MEDIA and not closes:
            has: dict[str, str] = {}
            for k, a, b, c in _ATTRIBUTE.findall(attributes):
                has.setdefault(k.lower(), html.unescape(a or b or c or ""))
            if has.get("src"):
                if caption is None:
                    flush()
                out.append({"position": len(out), "kind": "media", "text": None, "ref": has["src"], "caption": has.get("alt")})
                figure = len(out) - 1
        elif name in _BLOCK and caption is None:
            text.append("\n")
    text.extend(caption or [])
    flush()
    return out


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())]))
    for b in batches:
        yield pa.record_batch({"id": b.column("id"), "segments": pa.array([parse_html(x) for x in b.column("html").to_pylist()], kind)})


def interleave(pages: DataFrame, id_column: str, html_column: str = "html") -> DataFrame:
    """(id, html) -> (id, segments) of every row: ordered structs (position, kind, text, ref, caption).

    kind is ``text`` or ``media``; a reference's caption is its figure's caption, else its alt text, else null.
    Null or empty HTML gives an empty array; broken tags are text. Scripts, styles and comments are left out. Repeated
    and null ids are rows like others.
    """
    rows = pages.select(F.col(id_column).alias("id"), F.col(html_column).cast("string").alias("html"))
    return rows.mapInArrow(_parsed, f"id {rows.schema['id'].dataType.simpleString()}, segments {SEGMENT}").withColumnRenamed("id", id_column)


def page_sequences(pages: DataFrame) -> DataFrame:
    """(page_id, html) -> (page_id, position, kind, text, ref, caption): the sequences of ``interleave``, a row for each segment.

    A page without segments has no row; repeated rows give repeated results; other columns are ignored.
    """
    return interleave(pages, "page_id").select("page_id", F.inline("segments"))


def encode_media(raw: bytes) -> bytes:
    """8-bit gray PGM of rows of WIDTH samples; bytes 0 fill the last row (one row at least)."""
    rows = max(1, -(-len(raw) // WIDTH))
    return b"P5\n%d %d\n255\n" % (WIDTH, rows) + raw.ljust(rows * WIDTH, b"\0")


def decode_media(media: bytes) -> np.ndarray:
    head = re.match(rb"P5\s+(\d+)\s+(\d+)\s+255\s", media)
    if head is None:
        raise ValueError("not an 8-bit PGM")
    width, rows = int(head[1]), int(head[2])
    return np.frombuffer(media, dtype=np.uint8, offset=head.end(), count=width * rows).reshape(rows, width)


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each distinct payload that a task sees."""
    seen: set[str] = set()
    for part, data, offsets in C.text_blocks(batches):
        raw, at = data.tobytes(), offsets.tolist()
        rows = []
        if len(seen) > MEMORY:  # a payload seen again later is stored again, and dropped where features are joined
            seen.clear()
        for i, digest in enumerate(part.column("digest").to_pylist()):
            if digest not in seen:
                seen.add(digest)
                rows.append((digest, encode_media(raw[at[i] : at[i + 1]])))
        yield pa.record_batch({"digest": pa.array([r[0] for r in rows], pa.string()), "media": pa.array([r[1] for r in rows], pa.binary())})


def media_features(media: bytes) -> dict:
    samples = decode_media(media)
    payload = samples.tobytes()
    flat = samples.ravel().astype(np.int64)
    bins = np.bincount(flat >> 5, minlength=8)
    edges = int(np.abs(np.diff(samples.astype(np.int16), axis=1)).sum())
    return {
        "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-64:]),
        "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(),
        "feature": f"{samples.shape[1]}x{samples.shape[0]} sum={int(flat.sum())} edges={edges} hist={','.join(map(str, bins.tolist()))}",
    }


_FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"payload_bytes": pa.int64(), "tail_crc32": pa.int64(), "media_bytes": pa.int64()}
    for b in batches:
        found = [media_features(b.column("media")[i].as_buffer().to_pybytes()) for i in range(b.num_rows)]
        names = [x.split()[0] for x in _FEATURES.split(", ")]
        yield pa.record_batch({"digest": b.column("digest")} | {n: pa.array([f[n] for f in found], kinds.get(n, pa.string())) for n in names})


def resolve_media(sequences: DataFrame, id_column: str, features: DataFrame) -> DataFrame:
    """One row for each media reference of (id, segments), with the columns of ``features`` (digest, ...) it resolves to.

    References are ``sha256:<digest>``. A reference without a payload keeps its row, with nulls.
    """
    refs = sequences.select(id_column, F.explode("segments").alias("s")).where("s.kind = 'media'")
    refs = refs.select(id_column, "s.position", "s.caption", F.regexp_replace("s.ref", "^sha256:", "").alias("ref"))
    return refs.join(features, F.col("ref") == F.col("digest"), "left").drop("digest")


def store_payloads(docs: DataFrame) -> DataFrame:
    """Write the texts of ``docs`` as media to the shared folder and read them back: (digest, media)."""
    text = C.text_column(docs)
    rows = docs.select(text.alias("text"), F.sha2(text.cast("binary"), 256).alias("digest"))
    return materialize(rows.mapInArrow(_stored, "digest string, media binary"), "media")


def document_media(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_bytes, position, caption, ref, payload and media columns) of every row.

    Each row becomes a page with a figure of its text's bytes as 8-bit samples (null: an empty text), which is
    parsed and resolved by digest to what was stored. Equal texts share one payload and all its values. Repeated
    rows stay repeated; a null doc_id stays null. Empty table: empty result. Other columns are ignored.
    """
    store = store_payloads(docs)
    # Written, so that the join below has two exchanges and the copies of a hot text can be split.
    features = materialize(store.mapInArrow(_featured, f"digest string, {_FEATURES}").dropDuplicates(["digest"]), "features")
    text = C.text_column(docs)
    size = F.octet_length(text).cast("long")
    page = F.concat(F.lit('<article><p>Samples of a document.</p><figure><img src="sha256:'), F.sha2(text.cast("binary"), 256), F.lit('" alt="samples"><figcaption>'), size.cast("string"), F.lit(" bytes</figcaption></figure></article>"))
    pages = docs.select(F.struct("doc_id", size.alias("n_bytes")).alias("row"), page.alias("html"))
    found = resolve_media(interleave(pages, "row"), "row", features)
    return found.select("row.*", *(c for c in found.columns if c != "row"))
