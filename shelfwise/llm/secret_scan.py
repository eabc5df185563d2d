"""Secret scans: fixed patterns, and dictionary-primed zstandard novelty.

Three fixed kinds are found by pattern. For the fourth, ``novel``, a candidate is a long run of token
characters with a letter and a digit that follows a sensitive word or another secret closely; a name joined to
its value is one run, so where the run as a whole is not novel its parts are judged. The compressor is primed with
common identifiers and with the text on both sides, and a run's marginal bytes are the bytes its compression adds to
that of an empty string. Names, repeated or derived strings cost next to nothing then; a run that stays nearly
incompressible is reported. A run is measured in windows of 32 to 63 characters, each primed with what stands before
it: so short a window is stored as it is but for what it repeats, so the measure depends neither on the run's length nor
on its alphabet. Spans are code points, the end is exclusive. Every candidate is looked at once, in order, and known
spans are looked up by place, so time grows with the length of a text.

Rows: a missing text counts as empty and has no spans; texts are scanned whole, whatever their length;
repeated rows keep a row each; extra columns are dropped by the scan and kept by ``redact``.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import slices, texts_of

KINDS = ("assign", "access", "hex", "novel")

# The base patterns and the least lengths of what they find.
ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # runs are taken whole, so short runs need no match of their own
ASSIGN_HINTS = ("passw", "secret", "token", "api")
LEAST_ASSIGN, LEAST_ACCESS = 8, 16

SENSITIVE = re.compile(
    r"(?i:passw|passphrase|pwd|secret|token|key|credential|auth|bearer|private|session|cert|signature|login)", re.ASCII
)
LEAST_NOVEL = 16
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
VALUE = re.compile(r"[^=]+(?:=+$)?")  # between equals signs; those at the end are padding
PIECE = re.compile(r"[^_/-]+")
LETTER, DIGIT = re.compile(r"[A-Za-z]"), re.compile(r"[0-9]")
REACH = 64  # code points between a sensitive word and a candidate
AROUND = 400  # code points of surrounding text on each side
NOVELTY = 0.8  # marginal bytes a byte
WINDOW = 32  # characters measured at once, and up to twice as many; from 64 on zstandard codes the bytes by their frequency

IDENTIFIERS = b" ".join([
    b"access account address api application argument array async authorization base64 bearer boolean boundary buffer bytes",
    b"cache callback certificate charset class client code config connection const content context cookie count credential",
    b"data database date default delete description device dict document download email enabled encoding endpoint error event",
    b"exception export false field file filename filter float function github group handler hash header host html http https id",
    b"image import index input instance int integer interface json key label length library license list local location login",
    b"message metadata method model module name namespace node null number object option output package page parameter password",
    b"path pattern payload permission port private process project property protocol provider public query queue random read",
    b"record reference region request resource response result return role root schema script search secret self server service",
    b"session signature size source string struct system table tag target template test text time timestamp token true type",
    b"undefined update upload url user username utf-8 uuid value variable version void web width write xml year",
    b"0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 2024-01-01T00:00:00Z",
])


def marginal_bytes(candidate: str, before: str, after: str, identifiers: bytes = IDENTIFIERS) -> int:
    """Bytes that the candidate adds once identifiers and surroundings are known to the compressor."""
    primed = zstandard.ZstdCompressionDict(
        b"\n".join((identifiers, after.encode("utf-8", "replace"), before.encode("utf-8", "replace"))),
        dict_type=zstandard.DICT_TYPE_RAWCONTENT,
    )
    packer = zstandard.ZstdCompressor(level=3, dict_data=primed, write_content_size=False, write_dict_id=False)
    return len(packer.compress(candidate.encode("utf-8", "replace"))) - len(packer.compress(b""))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = []
    lower = text.lower()
    if any(hint in lower for hint in ASSIGN_HINTS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m.group()) >= LEAST_ACCESS]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return in_order(found)


def cost(text: str, start: int, end: int) -> int:
    """Marginal bytes of a run, window by window."""
    after = text[end : end + AROUND]
    parts = max(1, (end - start) // WINDOW)
    edges = [start + (end - start) * i // parts for i in range(parts + 1)]
    return sum(marginal_bytes(text[a:b], text[max(0, a - AROUND) : a], after) for a, b in zip(edges, edges[1:]))


def is_novel(text: str, start: int, end: int) -> bool:
    """Whether a run of token characters is long and mixed enough to be a secret, and nearly incompressible here."""
    if end - start < LEAST_NOVEL or not LETTER.search(text, start, end) or not DIGIT.search(text, start, end):
        return False
    return cost(text, start, end) >= NOVELTY * (end - start)


class Spans:
    """Known spans by place."""

    def __init__(self, spans: list[tuple[str, int, int]]) -> None:
        self.starts = sorted(s for _, s, _ in spans)
        self.reach = list(accumulate((e for _, _, e in sorted(spans, key=lambda s: s[1])), max))

    def touch(self, start: int, end: int) -> bool:
        """Whether one of them overlaps a stretch."""
        before = bisect_left(self.starts, end)
        return before > 0 and self.reach[before - 1] > start


def novel_parts(text: str, start: int, end: int, known: Spans) -> Iterator[tuple[int, int]]:
    """The novel parts of a candidate: all of it, or what is novel between its ``=`` signs, or between its joints.

    Between joints the shortest run of pieces that is long enough is judged from each joint on, and a novel one is
    prolonged by further pieces as long as its last pieces, so many as are long enough, are novel.
    """
    if not known.touch(start, end) and is_novel(text, start, end):
        yield start, end
        return
    for value in VALUE.finditer(text, start, end):
        if known.touch(*value.span()):
            continue
        if value.span() != (start, end) and is_novel(text, *value.span()):
            yield value.span()
            continue
        pieces = [m.span() for m in PIECE.finditer(text, *value.span())]
        i = 0
        while len(pieces) > 1 and i < len(pieces):
            first, j = i, i
            while j < len(pieces) and pieces[j][1] - pieces[first][0] < LEAST_NOVEL:
                j += 1
            i += 1
            if j < len(pieces) and is_novel(text, pieces[first][0], pieces[j][1]):
                while j + 1 < len(pieces):
                    back = j + 1
                    while pieces[j + 1][1] - pieces[back][0] < LEAST_NOVEL:
                        back -= 1
                    if not is_novel(text, pieces[back][0], pieces[j + 1][1]):
                        break
                    j += 1
                yield pieces[first][0], pieces[j][1]
                i = j + 1


def novel_spans(text: str, known: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Incompressible strings in a sensitive context that no span of ``known`` touches.

    A context is what follows a sensitive word, a known span or a found one. A found span reaches further by its
    own length, so that in a block of lines one that passes for a name does not end the block.
    """
    contexts = sorted([*(m.end() for m in SENSITIVE.finditer(text)), *(e for _, _, e in known)])
    if not contexts:
        return []
    found, places, at, limit, turn = [], Spans(known), 0, -1, 0
    for run in CANDIDATE.finditer(text):
        at = max(at, run.start())
        while run.end() - at >= LEAST_NOVEL:
            if at > limit:  # the next context that ends late enough to reach this place
                while turn < len(contexts) and contexts[turn] + REACH < at:
                    turn += 1
                if turn == len(contexts):
                    return found
                limit = contexts[turn] + REACH
                at = max(at, contexts[turn])
                continue
            for start, stop in novel_parts(text, at, run.end(), places):
                found.append(("novel", start, stop))
                limit = max(limit, stop + REACH + stop - start)
            at = run.end()
    return found


def in_order(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def scan_text(text: str) -> list[tuple[str, int, int]]:
    """All spans ``(kind, start, end)`` of a text, by start, then kind."""
    base = base_spans(text)
    return in_order(base + novel_spans(text, base))


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every run of overlapping spans replaced by the kind of its first span."""
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:] if spans else text


def scan(docs: DataFrame) -> DataFrame:
    """``(doc_id, spans)`` with an array of ``(kind, start, end)`` per row."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            spans = [[dict(zip(("kind", "start", "end"), s)) for s in scan_text(t)] for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], ["doc_id", "spans"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:bigint,end:bigint>>")


def redact(docs: DataFrame) -> DataFrame:
    """All rows with the secrets in ``text`` replaced; a missing text stays missing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            at = batch.schema.get_field_index("text")
            clean = [None if t is None else redacted(t, scan_text(t)) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, "text", pa.array(clean, pa.string()))

    return docs.mapInArrow(run, docs.schema)


def op1_secret_scan(docs: DataFrame) -> DataFrame:
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"] != "novel")

    def digits(found):
        return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return scan(docs).select(
        "doc_id", number("assign"), number("access"), number("hex"),
        F.sha2(digits(base), 256).alias("base_sha256"), digits(spans).alias("spans"), number("novel"),
    )
