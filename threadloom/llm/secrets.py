"""Secret scans: fixed patterns, and candidates whose bytes a primed compressor cannot shorten.

A candidate is a long run of key-like characters with letters and digits, close to a sensitive word on either side or
to another secret that is.  Its novelty is what it adds to the compressed size of the text around it, other copies of
it left out, with a dictionary of ordinary identifiers and placeholder values in front: known words and runs cost a
few bytes, random keys nearly their entropy.  A last, shorter line of a key written in lines goes with these.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

KINDS = ("assign", "access", "hex", "novel")
NOVELTY = 0.5  # added compressed bytes per character from which a candidate is reported
NEAR = 80  # characters between a sensitive word, or a secret found, and a candidate
AROUND = 256  # characters of context on either side that count as known
LINE = 40  # characters of a line from which, if it is a secret, the line after it can be its rest
MASK = "[secret]"

# fixed values: the three base patterns
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_WORDS = ("passw", "secret", "token", "api")
IS_HEX = np.isin(np.arange(256), np.frombuffer(b"0123456789abcdef", np.uint8))
SENSITIVE_WORDS = ("pass", "pwd", "secret", "token", "key", "credential", "bearer", "authorization", "jwt")
SENSITIVE = re.compile(
    r"pass[-_ ]?(?:word|wd|phrase|code)|pwd|secret|token|credential|bearer|authorization|jwt"
    r"|(?:api|private|access|encryption|signing|account|auth|master|ssh)[-_ ]?key",
    re.I | re.A,
)
LETTERS, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "0123456789"
KEY_RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
KEY_PART = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
KEY_LINE = re.compile(r"[\x20\t]*\r?\n[\x20\t]*([A-Za-z0-9+/_-]+={0,2})[\x20\t]*(?=\r?\n|$)")

IDENTIFIERS = """
0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789abcdef 1234567890 qwertyuiop
00000000000000000000000000000000 ffffffffffffffffffffffffffffffff xxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxx
your_api_key_here your-secret-here example_token change_me_please placeholder_value insert_token_here not_a_real_key
password passwd secret token api_key apikey access_key private_key public_key client_id client_secret session_id
credential authorization bearer username account service_account endpoint hostname localhost database connection
request_timeout max_connections default_value configuration environment production development staging testing
version revision commit branch release build number_of_rows column_name table_name file_name directory_path
get_value set_value to_string from_string create_instance initialize_component handler listener callback controller
http:// https:// www. .com .org .net /api/v1/ /api/v2/ /users/ /static/ /index.html ?id= &page= utf-8 base64 sha256
2020-01-01T00:00:00Z 2021 2022 2023 2024 2025 00000000-0000-0000-0000-000000000000
"""


class Novelty:
    """Bytes that a string adds to its compressed surroundings."""

    def __init__(self, identifiers: str = IDENTIFIERS):
        primed = zstandard.ZstdCompressionDict(identifiers.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compressor = zstandard.ZstdCompressor(level=9, dict_data=primed, write_content_size=False)

    def added_bytes(self, before: str, candidate: str, after: str) -> int:
        known = (before + after).encode("utf-8", "replace")
        return len(self.compressor.compress(known + candidate.encode("utf-8", "replace"))) - len(self.compressor.compress(known))


def may_hold_hex(raw: bytes) -> bool:
    """False only if there is no run of 24 hex digits: such a run covers 8 positions in a row of every third one."""
    run = IS_HEX[np.frombuffer(raw, np.uint8)[::3]]
    for step in (1, 2, 4):
        run = run[step:] & run[:-step]
    return bool(run.any())


def base_spans(text: str, lowered: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, in order of start, then kind."""
    out = []
    if any(w in lowered for w in ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if may_hold_hex(text.encode("utf-8", "replace")):
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def around(text: str, start: int, end: int) -> tuple[str, str]:
    """The characters before and after a candidate, with other copies of it blanked."""
    core = text[start:end].rstrip("=")
    blank = lambda part: part.replace(core, " " * len(core))
    before = blank(text[max(0, start - AROUND - len(core)) : start])  # so much more that no copy is cut off
    return before[-AROUND:], blank(text[end : end + AROUND + len(core)])[:AROUND]


def near_spans(starts: list[int], ends: list[int], items: list[tuple[int, int]], is_hit) -> set[int]:
    """Numbers of the items within NEAR of a word or of a hit that is; words are given by sorted starts and ends."""
    found = set()
    for numbers, forwards in ((range(len(items)), True), (range(len(items) - 1, -1, -1), False)):
        reach = None  # the edge of the last word or hit
        at = 0 if forwards else len(starts) - 1
        for i in numbers:
            start, end = items[i]
            while forwards and at < len(starts) and starts[at] < end:
                reach, at = ends[at] if reach is None else max(reach, ends[at]), at + 1
            while not forwards and at >= 0 and ends[at] > start:
                reach, at = starts[at] if reach is None else min(reach, starts[at]), at - 1
            if reach is None or (start - reach if forwards else reach - end) > NEAR:
                continue
            if i in found or is_hit(i):
                found.add(i)
                reach = max(reach, end) if forwards else min(reach, start)
    return found


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """Runs of key characters with a letter and a digit from their start on; each run is read a fixed number of times."""
    for run in KEY_RUN.finditer(text):
        last_letter, last_digit = len(run[0].rstrip(DIGITS + "+/_=-")), len(run[0].rstrip(LETTERS + "+/_=-"))
        for part in KEY_PART.finditer(run[0]):
            if part.start() < min(last_letter, last_digit):
                yield run.start() + part.start(), run.start() + part.end()


def rest_lines(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Lines of key characters right behind a line that is a secret: as long ones go on, a shorter one is the last."""
    size = end - start
    if size < LINE or text[max(0, start - NEAR) : start].rpartition("\n")[2].strip():
        return
    while (line := KEY_LINE.match(text, end)) and len(line[1]) <= size:
        word = line[1]
        if word.isalpha() and (word.islower() or word.isupper() or word.istitle()):
            return
        yield line.span(1)
        if len(word) < size:
            return
        end = line.end(1)


def novel_spans(text: str, base: list[tuple[int, int, int]], novelty: Novelty, least: float) -> list[tuple[int, int, int]]:
    """Candidates near sensitive words that no base span touches and that stay incompressible."""
    words = [m.span() for m in SENSITIVE.finditer(text)]
    if not words:
        return []
    items, at = [], 0
    merged: list[tuple[int, int]] = []  # base spans, overlapping ones as one
    for start, _, end in base:
        if merged and start < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((start, end))
    for start, end in candidates(text):
        while at < len(merged) and merged[at][1] <= start:
            at += 1
        if at == len(merged) or merged[at][0] >= end:
            items.append((start, end, False))
    items = sorted([*items, *((s, e, True) for s, e in merged)])  # base spans are hits as they are
    known: dict[int, bool] = {}

    def is_hit(i: int) -> bool:
        if i not in known:
            start, end, of_base = items[i]
            before, after = ("", "") if of_base else around(text, start, end)
            known[i] = of_base or novelty.added_bytes(before, text[start:end], after) >= least * (end - start)
        return known[i]

    near = near_spans([s for s, _ in words], [e for _, e in words], [(s, e) for s, e, _ in items], is_hit)
    found = [items[i][:2] for i in sorted(near) if not items[i][2]]
    rest: set[tuple[int, int]] = set()
    followed: set[tuple[int, int]] = set()  # lines as long as the one they follow: what comes behind them is known
    for start, end in found:
        if (start, end) not in followed:
            for span in rest_lines(text, start, end):
                rest.add(span)
                if span[1] - span[0] == end - start:
                    followed.add(span)
    return [(start, 3, end) for start, end in sorted({*found, *rest})]


def joined(spans: Iterable[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


def masked(text: str, spans: Iterable[tuple[int, int, int]], mask: str) -> str:
    """The text with every span, overlapping ones as one, replaced."""
    out, at = [], 0
    for start, _, end in sorted(spans):
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])


class Scanner:
    def __init__(self, least: float, identifiers: str):
        self.least, self.novelty = least, Novelty(identifiers)

    def spans(self, text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """Base spans, and all spans."""
        if not text:
            return [], []
        lowered = text.lower()
        base = base_spans(text, lowered)
        if not any(w in lowered for w in SENSITIVE_WORDS):
            return base, base
        return base, base + novel_spans(text, base, self.novelty, self.least)


def _scan(least: float, identifiers: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(least, identifiers)
        for batch in batches:
            found = [scanner.spans(text) for text in batch.column(1).to_pylist()]
            counts = [pa.array([sum(s[1] == kind for s in base) for base, _ in found], pa.int64()) for kind in range(3)]
            digests = [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found]
            spans = [joined(every) for _, every in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, pa.array(digests, pa.string()), pa.array(spans, pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return run


def _mask(least: float, identifiers: str, with_mask: str, column: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(least, identifiers)
        for batch in batches:
            clean = []
            for text in batch.column(column).to_pylist():
                every = scanner.spans(text)[1]
                clean.append(masked(text, every, with_mask) if every else text)
            yield batch.set_column(column, "text", pa.array(clean, pa.string()))

    return run


def scan(docs: DataFrame, least: float = NOVELTY, identifiers: str = IDENTIFIERS) -> DataFrame:
    """doc_id, counts of the base patterns, the digest of their spans, and all spans as kind:start:end.

    Takes doc_id and text of `docs`; other columns are not read.  A NULL text is an empty one and has no spans; a NULL
    doc_id stays NULL; every row gives one row; an empty table gives none.  Texts are searched whole, positions are
    code points.
    """
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(
        _scan(least, identifiers), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    )


def mask(docs: DataFrame, least: float = NOVELTY, identifiers: str = IDENTIFIERS, with_mask: str = MASK) -> DataFrame:
    """`docs` with every found span replaced in text; all rows and columns stay, NULL texts stay NULL."""
    return docs.mapInArrow(_mask(least, identifiers, with_mask, docs.columns.index("text")), docs.schema)
