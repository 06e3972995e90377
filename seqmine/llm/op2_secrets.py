"""Secret scans with multipart credential linking.

Three strong kinds are reported wherever they match: assignments of a password or token, access-key identifiers
and long hexadecimal strings. Weak candidates are parts that mean little alone: account identifiers (`identifier`),
strings that look random (`secret`) and addresses of services (`endpoint`). Each part has an interval, its span
widened by ``reach`` code points, within its scope, which is a paragraph (up to an empty line). An interval join
within the scope, done by searching sorted positions, finds whether the parts that complete a candidate occur: an
identifier needs a secret, a secret an identifier or an endpoint, an endpoint a secret. Strong parts count: an
access key is an identifier, an assignment or hexadecimal string a secret. Candidates without their complement
and those wholly inside a strong span are not reported; one that reaches beyond a strong span may be completed by it.

Defined results: a null text is an empty one without spans; ids are passed on, null or not; repeated rows are
scanned each; equal starts are ordered by kind as listed; an empty table gives no rows; other columns of the
input are not read.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import keyed_texts, text_slices

KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
STRONG = KINDS[:3]
#: role of each kind in a credential
ROLE = {"assign": "secret", "access": "identifier", "hex": "secret", "identifier": "identifier", "secret": "secret", "endpoint": "endpoint"}
NEEDS = {"identifier": ("secret",), "secret": ("identifier", "endpoint"), "endpoint": ("secret",)}

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # a run is taken whole, so its length can be asked for at once
_HEX = re.compile(r"[0-9a-f]{16,}")
_IDENTIFIER = re.compile(
    r"""\b(?:access_?key(?:_?id)?|key_?id|client_?id|app_?id|account(?:_?id)?|user(?:_?name|_?id)?|login)["']?\x20*[:=]\x20*["']?[\w.@+-]{3,64}|AKIA[A-Z0-9]{6,13}(?![A-Z0-9])""", re.I | re.A
)
_ENDPOINT = re.compile(
    r"""\b(?:https?|ftps?|s3|gs|jdbc:\w+|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqps?|ssh)://[^\s"'<>]{3,}|\b(?:host(?:name)?|endpoint|server|url)["']?\x20*[:=]\x20*["']?[\w.-]{3,}(?::\d{1,5})?|\b(?:\d{1,3}\.){3}\d{1,3}:\d{2,5}\b""", re.I | re.A
)
_RANDOM = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}", re.A)
_SCOPE = re.compile(r"\n[ \t\r]*\n")


def looks_random(s: str) -> bool:
    """Lower case, upper case and digits, and at least 3.5 bits a character."""
    if not (any(map(str.isdigit, s)) and any(map(str.isupper, s)) and any(map(str.islower, s))):
        return False
    n = len(s)
    return -sum(k / n * math.log2(k / n) for k in Counter(s).values()) >= 3.5


def strong_spans(text: str) -> list[tuple[int, int, str]]:
    out = []
    if "=" in text or ":" in text:
        out += [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in _ACCESS.finditer(text)]
    out += [(*m.span(), "hex") for m in _HEX.finditer(text)]
    return out


def weak_parts(text: str) -> list[tuple[int, int, str]]:
    """Candidates, before any complement is asked for."""
    marked = "=" in text or ":" in text
    out = [(*m.span(), "identifier") for m in _IDENTIFIER.finditer(text)] if marked or "AKIA" in text else []
    out += [(*m.span(), "endpoint") for m in _ENDPOINT.finditer(text)] if marked else []
    out += [(*m.span(), "secret") for m in _RANDOM.finditer(text) if looks_random(m[0])]
    return out


class _Reached:
    """Spans by their starts, with the furthest end so far: whether one reaches somewhere takes a search."""

    def __init__(self, spans: Iterable[tuple[int, int]]):
        spans = sorted(spans)
        self.starts = [a for a, _ in spans]
        self.ends = list(accumulate((b for _, b in spans), max))

    def furthest(self, before: int) -> int:
        """The greatest end of the spans that start before; -1 for none."""
        i = bisect_left(self.starts, before)
        return self.ends[i - 1] if i else -1


def linked(text: str, strong: list[tuple[int, int, str]], weak: list[tuple[int, int, str]], reach: int) -> list[tuple[int, int, str]]:
    """The weak candidates whose complement occurs within reach and in their scope."""
    if not weak or len({ROLE[k] for _, _, k in strong} | {k for _, _, k in weak}) < 2:
        return []
    cuts = [m.start() for m in _SCOPE.finditer(text)]
    taken = _Reached((a, b) for a, b, _ in strong)
    weak = [w for w in weak if taken.furthest(w[0] + 1) < w[1]]
    sure = {role: _Reached((a, b) for a, b, k in strong if ROLE[k] == role) for role in ("identifier", "secret")}
    starts: dict[str, list[int]] = {}
    ends: dict[str, list[int]] = {}
    for a, b, kind in weak:
        starts.setdefault(ROLE[kind], []).append(a)
        ends.setdefault(ROLE[kind], []).append(b)
    for x in (*starts.values(), *ends.values()):
        x.sort()

    def completed(a: int, b: int, kind: str) -> bool:
        scope = bisect_left(cuts, a)
        low = max(a - reach, cuts[scope - 1] if scope else 0)
        high = min(b + reach, cuts[scope] if scope < len(cuts) else len(text))
        for role in NEEDS[kind]:
            if role in sure and sure[role].furthest(high) > low:
                return True
            if role in starts:  # a weak one only beside the candidate: it begins from b on, or ends by a
                i, j = bisect_left(starts[role], b), bisect_right(ends[role], low)
                if (i < len(starts[role]) and starts[role][i] < high) or (j < len(ends[role]) and ends[role][j] <= a):
                    return True
        return False

    return [w for w in weak if completed(*w)]


def find(text: str | None, reach: int = 200) -> list[tuple[int, int, str]]:
    """All spans (start, end, kind) by start, then kind as listed; code points, end exclusive."""
    if not text:
        return []
    strong = strong_spans(text)
    return sorted(strong + linked(text, strong, weak_parts(text), reach), key=lambda s: (s[0], KINDS.index(s[2])))


def scan(df: DataFrame, reach: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans array<struct<kind, start, stop, strong>>."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("strong", pa.bool_())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            spans = [[{"kind": k, "start": a, "stop": b, "strong": k in STRONG} for a, b, k in find(t, reach)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=["doc_id", "spans"])

    return keyed_texts(df, id_col, text_col).mapInArrow(work, "doc_id long, spans array<struct<kind:string,start:long,stop:long,strong:boolean>>")
