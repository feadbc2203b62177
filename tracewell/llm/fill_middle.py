"""Fill-in-the-middle transformation over seekable compressed frames.

A text is stored as independent zstandard frames of FRAME_BYTES, each with the lines (units), code points and bytes that stand
before it. A cut after k lines is found by a binary search of those counts, and only the frame that it falls in is
decompressed; digests and outputs are streamed frame by frame. So a task holds one text's compressed frames and one open frame.

A unit is a line with its end, or what follows the last one. A document's random numbers are the 8-digit groups of the SHA-256
of "seed:doc_id". Its first two numbers, modulo units + 1, are the cuts: the lesser ends the prefix, the greater the middle.
The third decides if it is transformed (RATE percent are), the fourth between the suffix first (spm, SPM percent) and the
prefix first (psm). An empty text, or one that holds a mark already, stays plain, so each output can be turned back.

Defined results: a null text is empty, thus plain; a null doc_id is written as nothing after the seed; rows that share a doc_id
are cut alike; an empty table gives an empty result. Other columns are carried, unless a new column has their name.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import zstandard as zstd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import map_texts, read_table

SEED, RATE, SPM = 7, 100, 50
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
FRAME_BYTES = 1 << 16
FRAMES = "array<struct<units: bigint, chars: bigint, bytes: bigint, data: binary>>"


def _chars(data: bytes) -> int:
    """Code points of UTF-8 bytes, wherever they are cut."""
    return int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80))


class FrameWriter:
    """Puts what is added into frames of `size` bytes."""

    def __init__(self, size: int = FRAME_BYTES):
        self.size, self.open, self.frames, self.pack = size, bytearray(), [], zstd.ZstdCompressor(level=1)
        self.units = self.chars = self.bytes = 0
        self.ended = True

    def add(self, data: bytes) -> None:
        self.open += data
        while len(self.open) >= self.size:
            self._close(self.size)

    def _close(self, n: int) -> None:
        data = bytes(self.open[:n])
        del self.open[:n]
        self.frames.append({"units": self.units, "chars": self.chars, "bytes": self.bytes, "data": self.pack.compress(data)})
        self.units, self.chars, self.bytes, self.ended = self.units + data.count(b"\n"), self.chars + _chars(data), self.bytes + len(data), data.endswith(b"\n")

    def finish(self) -> list[dict]:
        """The frames; afterwards units, chars and bytes are those of all that was added."""
        if self.open:
            self._close(len(self.open))
        self.units += not self.ended
        return self.frames


def written(pieces: Iterable[bytes], size: int = FRAME_BYTES) -> FrameWriter:
    writer = FrameWriter(size)
    for piece in pieces:
        writer.add(piece)
    writer.finish()
    return writer


class FrameReader:
    """Reads frames by place; one frame is open at a time."""

    def __init__(self, frames: list[dict]):
        self.frames, self.unpack, self.held = frames, zstd.ZstdDecompressor(), (-1, b"")
        self.units, self.bytes = [f["units"] for f in frames], [f["bytes"] for f in frames]

    def frame(self, i: int) -> bytes:
        if self.held[0] != i:
            self.held = (i, self.unpack.decompress(self.frames[i]["data"]))
        return self.held[1]

    def size(self) -> int:
        return self.bytes[-1] + len(self.frame(len(self.frames) - 1)) if self.frames else 0

    def after_unit(self, k: int) -> tuple[int, int]:
        """The bytes and code points of the first k lines, each of which must have its end."""
        if k == 0:
            return 0, 0
        i = bisect_left(self.units, k) - 1
        data = self.frame(i)
        at = int(np.flatnonzero(np.frombuffer(data, np.uint8) == 10)[k - self.units[i] - 1]) + 1
        return self.bytes[i] + at, self.frames[i]["chars"] + _chars(data[:at])

    def stream(self, start: int, end: int | None = None) -> Iterator[bytes]:
        i = max(0, bisect_right(self.bytes, start) - 1)
        while i < len(self.frames) and (end is None or self.bytes[i] < end):
            yield self.frame(i)[max(0, start - self.bytes[i]) : None if end is None else end - self.bytes[i]]
            i += 1

    def find(self, mark: bytes, start: int) -> int:
        """The place of the first mark from start on, which may cross frames; -1 if there is none."""
        at, rest = start, b""
        for data in self.stream(start):
            here = rest + data
            if (k := here.find(mark)) >= 0:
                return at - len(rest) + k
            at, rest = at + len(data), here[-(len(mark) - 1) :]
        return -1


def _numbers(doc_id: Column) -> list[Column]:
    digest = F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)]


def _without(docs: DataFrame, names: Iterable[str]) -> DataFrame:
    gone = {n.lower() for n in names}
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in gone])


def framed(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `frames` in place of the text, n (units), n_chars and marked (holds a mark)."""

    def make():
        def work(texts):
            done = [written([t or b""]) for t in texts]
            return [w.frames for w in done], [w.units for w in done], [w.chars for w in done], [any(m in (t or b"") for m in (PREFIX, SUFFIX, MIDDLE)) for t in texts]

        return work

    rows = _without(docs, ("frames", "n", "marked") + (("n_chars",) if text != "n_chars" else ())).withColumn(text, F.col(f"`{text}`").cast("binary"))
    done = map_texts(rows, text, f"frames {FRAMES}, n bigint, n_chars bigint, marked boolean", make)
    return done.select(*[F.col(f"row.`{c}`") for c in rows.columns if c != text], "frames", "n", "n_chars", "marked")


def planned(docs: DataFrame, doc_id: str = "doc_id", rate: int = RATE, spm: int = SPM) -> DataFrame:
    """Framed documents with form (plain, psm or spm), first and second: the lines before the cuts."""
    one, two, three, four = _numbers(F.col(f"`{doc_id}`"))
    n = F.col("n") + 1
    plain = (F.col("n") == 0) | F.col("marked") | (three % 100 >= rate)
    form = F.when(plain, "plain").when(four % 100 < spm, "spm").otherwise("psm")
    return docs.withColumns({"form": form, "first": F.least(one % n, two % n), "second": F.greatest(one % n, two % n)})


def pieces(frames: list[dict], form: str, cuts: list[int]) -> Iterator[bytes]:
    """The output of a text whose prefix and middle end before the bytes `cuts`."""
    text = FrameReader(frames)
    if form == "plain":
        yield from text.stream(0)
        return
    parts = {PREFIX: (0, cuts[0]), SUFFIX: (cuts[1], None), MIDDLE: tuple(cuts)}
    for mark in (PREFIX, SUFFIX, MIDDLE) if form == "psm" else (SUFFIX, PREFIX, MIDDLE):
        yield mark
        yield from text.stream(*parts[mark])


def restored(frames: list[dict], form: str) -> Iterator[bytes]:
    """The text of an output, by its marks and its form alone."""
    out = FrameReader(frames)
    if form == "plain":
        yield from out.stream(0)
        return
    marks = (PREFIX, SUFFIX, MIDDLE) if form == "psm" else (SUFFIX, PREFIX, MIDDLE)
    second = out.find(marks[1], len(marks[0]))
    third = out.find(marks[2], second + len(marks[1]))
    part = {marks[0]: (len(marks[0]), second), marks[1]: (second + len(marks[1]), third), MIDDLE: (third + len(MIDDLE), None)}
    for mark in (PREFIX, MIDDLE, SUFFIX):
        yield from out.stream(*part[mark])


def _digest(data: Iterable[bytes]) -> str:
    h = hashlib.sha256()
    for piece in data:
        h.update(piece)
    return h.hexdigest()


def transformed(docs: DataFrame) -> DataFrame:
    """Planned documents with their output as frames, prefix_chars and middle_chars (null if plain), and the digests of the
    output and of the text that it turns back into."""

    def one(v: dict) -> tuple:
        form, sizes, cuts = v["form"], (None, None), [0, 0]
        if form != "plain":
            text, found = FrameReader(v["frames"]), []
            for k in (v["first"], v["second"]):
                found.append((text.size(), v["n_chars"]) if k == v["n"] else text.after_unit(k))
            cuts, sizes = [b for b, _ in found], (found[0][1], found[1][1] - found[0][1])
        output = written(pieces(v["frames"], form, cuts)).frames
        return output, *sizes, _digest(FrameReader(output).stream(0)), _digest(restored(output, form))

    def make():
        def work(values):
            return [list(c) for c in zip(*map(one, values), strict=True)] if values else [[]] * 5

        return work

    new = ("output", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")
    docs = _without(docs, new)
    both = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), F.struct("frames", "form", "first", "second", "n", "n_chars").alias("plan"))
    done = map_texts(both, "plan", f"output {FRAMES}, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string", make)
    return done.select(*[F.col(f"row.own.`{c}`") for c in docs.columns], *new)


def fill_in_middle(docs: DataFrame, rate: int = RATE, spm: int = SPM) -> DataFrame:
    return transformed(planned(framed(docs), rate=rate, spm=spm))


def text_of(frames: list[dict]) -> str:
    return b"".join(FrameReader(frames).stream(0)).decode()


def report(docs: DataFrame) -> DataFrame:
    return fill_in_middle(docs.select("doc_id", "text")).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(read_table(spark, sf_dir, "documents"))


_SQL_H = ", ".join(f"CAST('0x' || substr(digest, {1 + 8 * i}, 8) AS BIGINT) AS h{i + 1}" for i in range(4))
ORACLE_SQL = f"""
WITH a AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest FROM documents),
b AS (SELECT *, string_split(t, chr(10)) AS parts, {_SQL_H} FROM a),
c AS (SELECT *, CAST(len(parts) - CASE WHEN t = '' OR ends_with(t, chr(10)) THEN 1 ELSE 0 END AS BIGINT) AS n FROM b),
d AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS i, greatest(h1 % (n + 1), h2 % (n + 1)) AS j,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= {RATE} THEN 'plain' WHEN h4 % 100 < {SPM} THEN 'spm' ELSE 'psm' END AS form FROM c),
e AS (SELECT *, CASE WHEN i = n THEN t WHEN i = 0 THEN '' ELSE array_to_string(parts[1:i], chr(10)) || chr(10) END AS head,
  CASE WHEN j = n THEN t WHEN j = 0 THEN '' ELSE array_to_string(parts[1:j], chr(10)) || chr(10) END AS upto FROM d),
f AS (SELECT *, substr(upto, length(head) + 1) AS mid, substr(t, length(upto) + 1) AS tail FROM e)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(head) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || head || '<S>' || tail || '<M>' || mid ELSE '<S>' || tail || '<P>' || head || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM f
"""
