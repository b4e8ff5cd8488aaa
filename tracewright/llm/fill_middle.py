"""Fill-in-middle transformation by secondary-sort assembly.

A text is cut into units (runs of A-Z and a-z, and single other code points); hashes of the id choose
two cuts and a form. Each document is emitted as pieces of at most PIECE_UNITS units, keyed by document
and by position in the output. Pieces are partitioned by document and sorted by position within their
partitions (what ``repartitionAndSortWithinPartitions`` does for RDDs, here a DataFrame's
``repartition`` and ``sortWithinPartitions``); one pass streams them into digests of the output and
finds the markers in it again; the parts are sorted once more within the same partitions, by their place in
the text, and a second pass streams them into digests of the restored text. A task never holds more
than one batch of pieces, however long a document is, and texts cross the network once.

Defined results: null and empty texts have no units and are plain; a null id hashes as the empty
string; texts that hold a marker are plain; repeated rows each give a row; rows of one id with
different texts are documents of their own; an empty table gives no rows; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Fixed by the format: the markers, in the order in which the parts stand in each form.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
ORDER = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
#: Where each part stands in the text.
PLACE = {PREFIX: 0, MIDDLE: 1, SUFFIX: 2}
#: Per cent of documents that stay plain, and of the others that have the suffix first.
PLAIN, SUFFIX_FIRST = 10, 20
#: Units of one piece; a piece of longer units is cut by characters too.
PIECE_UNITS, PIECE_CHARS = 4096, 1 << 15


def unit_starts(text: str) -> np.ndarray:
    """The code points at which units start."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = ((cp | 0x20) - np.uint32(97)) < 26
    first = np.ones(len(cp), bool)
    first[1:] = ~(letter[1:] & letter[:-1])
    return np.flatnonzero(first)


def layout(doc_id, text: str, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST) -> tuple[int, str, int, int, list[tuple[str, int, int]], np.ndarray]:
    """(units, form, prefix's end, middle's end, parts, starts): parts are (marker, start, end) in the output's order."""
    starts = unit_starts(text)
    n = len(starts)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(m in text for m in PLACE) or h3 % 100 >= 100 - plain:
        return n, "plain", 0, 0, [("", 0, len(text))], starts
    form = "spm" if h4 % 100 < suffix_first else "psm"
    a, b = (int(starts[c]) if c < n else len(text) for c in sorted((h1 % (n + 1), h2 % (n + 1))))
    span = {PREFIX: (0, a), MIDDLE: (a, b), SUFFIX: (b, len(text))}
    return n, form, a, b, [(m, *span[m]) for m in ORDER[form]], starts


def pieces_of(text: str, parts, starts: np.ndarray, units: int = PIECE_UNITS, chars: int = PIECE_CHARS) -> Iterator[str]:
    """The output in pieces: a marker goes with the first piece of its part."""
    for marker, lo, hi in parts:
        i, j = np.searchsorted(starts, (lo, hi))
        edges = [lo, *starts[i:j:units][1:].tolist(), hi]
        head = marker
        for s, e in zip(edges[:-1], edges[1:], strict=True):
            for k in range(s, max(e, s + 1), chars):
                if (piece := head + text[k : min(k + chars, e)]) or not text:
                    yield piece
                head = ""


def pieces(documents: DataFrame, id_col: str = "doc_id", text: str = "text", plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST, units: int = PIECE_UNITS, chars: int = PIECE_CHARS) -> DataFrame:
    """(doc_id, k1, k2, pos, piece, n, form, prefix_chars, middle_chars): the outputs in pieces. k1 and k2
    are 128 bits of id and text; what follows the piece stands at position 0 alone."""
    body = F.coalesce(F.col(text), F.lit(""))
    own = documents.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col), body).alias("k1"), F.xxhash64(body, F.lit(1), F.col(id_col)).alias("k2"), body.alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, k1 long, k2 long, pos int, piece string, n long, form string, prefix_chars long, middle_chars long"

    def cut(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            ids = b.column("doc_id")
            at, out, size = [], [], 0
            for i, (d, t) in enumerate(zip(ids.to_pylist(), b.column("text"), strict=True)):
                t = t.as_py()
                n, form, x, y, parts, starts = layout(d, t, plain, suffix_first)
                for pos, p in enumerate(pieces_of(t, parts, starts, units, chars)):
                    at.append(i)
                    whole = form != "plain"
                    out.append((pos, p, *((n, form, x if whole else None, y - x if whole else None) if pos == 0 else (None,) * 4)))
                    size += len(p)
                    if size > 4_000_000:
                        yield _rows(b, at, out)
                        at, out, size = [], [], 0
            if at:
                yield _rows(b, at, out)

    return own.mapInArrow(cut, schema)


_OUT = [("pos", pa.int32()), ("piece", pa.string()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64())]


def _rows(batch: pa.RecordBatch, at: list[int], out: list[tuple]) -> pa.RecordBatch:
    keys = batch.select(["doc_id", "k1", "k2"]).take(pa.array(at, pa.int64()))
    cols = [pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), _OUT, strict=True)]
    return pa.RecordBatch.from_arrays([*keys.columns, *cols], ["doc_id", "k1", "k2", *[n for n, _ in _OUT]])


class Parts:
    """Finds the markers of a form in an output that comes in pieces: (place, text) of its parts."""

    def __init__(self, form: str):
        self.expected, self.place, self.rest = list(ORDER.get(form, ())), 1, ""

    def feed(self, piece: str, last: bool = False) -> list[tuple[int, str]]:
        text, out = self.rest + piece, []
        while self.expected and (i := text.find(self.expected[0])) >= 0:
            out.append((self.place, text[:i]))
            marker = self.expected.pop(0)
            self.place, text = PLACE[marker], text[i + len(marker) :]
        hold = 0 if last or not self.expected else min(len(text), len(self.expected[0]) - 1)  # a marker may begin here
        self.rest = text[len(text) - hold :]
        out.append((self.place, text[: len(text) - hold]))
        return [x for x in out if x[1]]


def _sorted(cut: DataFrame) -> DataFrame:
    return cut.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "pos")


def restored(cut: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of ``pieces``: one
    row for each document. The restored text is read from the output and the form alone."""
    kind = cut.schema["doc_id"].dataType.simpleString()
    meta = "n long, form string, prefix_chars long, middle_chars long"

    def assemble(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces in the output's order to parts with their place in the text; a document's last row
        (place 3) has its digest and how many equal rows there are."""
        key, doc = None, None

        def end(out) -> None:
            out.extend((*doc["key"], p, doc["seq"] + i, x, *(None,) * 6) for i, (p, x) in enumerate(doc["parts"].feed("", last=True)))
            out.append((*doc["key"], 3, 0, None, *doc["meta"], doc["sha"].hexdigest(), doc["copies"]))

        for b in frames:
            out: list[tuple] = []
            for d, k1, k2, pos, piece, *m in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (k1, k2) != key:
                    if doc:
                        end(out)
                    key, doc = (k1, k2), {"key": (d, k1, k2), "meta": m, "sha": hashlib.sha256(), "parts": Parts(m[1]), "pos": -1, "copies": 0, "seq": 0}
                doc["copies"] += pos == 0
                if pos == doc["pos"]:
                    continue  # the same piece of an equal row
                doc["pos"] = pos
                doc["sha"].update(piece.encode("utf-8", "surrogatepass"))
                for p, x in doc["parts"].feed(piece):
                    out.append((d, k1, k2, p, doc["seq"], x, *(None,) * 6))
                    doc["seq"] += 1
            yield from _batch(out, b.schema.field("doc_id").type, _MID)
        if doc:
            out = []
            end(out)
            yield from _batch(out, b.schema.field("doc_id").type, _MID)

    def restore(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, hashlib.sha256()
        for b in frames:
            out = []
            for d, k1, k2, place, _, piece, *m, copies in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (k1, k2) != key:
                    key, sha = (k1, k2), hashlib.sha256()
                if place < 3:
                    sha.update(piece.encode("utf-8", "surrogatepass"))
                else:
                    out += [(d, *m, sha.hexdigest())] * copies
            yield from _batch(out, b.schema.field("doc_id").type, _END)

    mid = _sorted(cut).mapInArrow(assemble, f"doc_id {kind}, k1 long, k2 long, place int, seq int, part string, {meta}, output_sha256 string, copies long")
    return mid.sortWithinPartitions("k1", "k2", "place", "seq").mapInArrow(restore, f"doc_id {kind}, {meta}, output_sha256 string, restored_sha256 string")


_META = [("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output_sha256", pa.string())]
_MID = [("k1", pa.int64()), ("k2", pa.int64()), ("place", pa.int32()), ("seq", pa.int32()), ("part", pa.string()), *_META, ("copies", pa.int64())]
_END = [*_META, ("restored_sha256", pa.string())]


def _batch(rows: list[tuple], id_type: pa.DataType, fields) -> Iterator[pa.RecordBatch]:
    if rows:
        kinds = [("doc_id", id_type), *fields]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), kinds, strict=True)], [n for n, _ in kinds])


def outputs(documents: DataFrame, **options) -> DataFrame:
    """(doc_id, form, output): the whole outputs as texts, one row for each document; a text meets in
    its task, as the column needs."""
    cut = pieces(documents, **options)
    kind = cut.schema["doc_id"].dataType.simpleString()

    def join(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, doc, form, copies, last, parts = None, None, None, 0, -1, []
        for b in frames:
            out = []
            for d, k1, k2, pos, piece, f in zip(*(b.column(c).to_pylist() for c in ("doc_id", "k1", "k2", "pos", "piece", "form")), strict=True):
                if (k1, k2) != key:
                    out += [(doc, form, "".join(parts))] * copies
                    key, doc, form, copies, last, parts = (k1, k2), d, f, 0, -1, []
                copies += pos == 0
                if pos != last:
                    parts.append(piece)
                    last = pos
            yield from _batch(out, b.schema.field("doc_id").type, [("form", pa.string()), ("output", pa.string())])
        if copies:
            yield from _batch([(doc, form, "".join(parts))] * copies, b.schema.field("doc_id").type, [("form", pa.string()), ("output", pa.string())])

    return _sorted(cut).mapInArrow(join, f"doc_id {kind}, form string, output string")


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return restored(pieces(table(spark, sf_dir, "documents")))


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
h AS (SELECT *, len(u) AS n, ('0x' || s[1:8])::BIGINT AS h1, ('0x' || s[9:16])::BIGINT AS h2, ('0x' || s[17:24])::BIGINT AS h3, ('0x' || s[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= {100 - PLAIN} THEN 'plain' WHEN h4 % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
