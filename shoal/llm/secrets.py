"""Secret scans: fixed patterns, and novelty against a dictionary-primed zstandard compressor.

A string in a sensitive context counts as a secret if, given the text around it and
a list of identifiers as dictionary, it still costs nearly all its bytes.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from shoal.llm._words import text_column

# The patterns of the base kinds, in the order in which they are listed.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+", re.A)
HEX = re.compile(r"[0-9a-f]{32,}", re.A)  # the runs of [0-9a-f]+ that are long enough
KINDS = ("assign", "access", "hex", "novel")
LEAST = {"assign": 8, "access": 16}

#: Words near which a string is looked at, and the form of such strings.
CONTEXT = re.compile(r"(?i:passw|pwd|secret|token|api_?key|access_?key|private[_\x20]?key|credential|bearer|authorization|signature)", re.A)
ASSIGN_WORD = re.compile(r"(?i:password|passwd|secret|token|api_?key)", re.A)
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{8,}", re.A)
ASSIGNED = re.compile(r"""\w*["']?\s*[:=]\s*["']?""")
#: Length of a string that may stand anywhere near, and of one that the word is set to; how far off it may be; text that primes the compressor; least bytes a byte.
LONG, SHORT, REACH, AROUND, RATIO = 16, 8, 80, 2048, 0.85

#: What code is full of; primes the compressor along with the text around.
IDENTIFIERS = (
    b"abstract access account address algorithm application argument array async authorization await boolean buffer callback "
    b"certificate class client column config configuration connection constructor container content context controller "
    b"credential database default delete description destination development directory document element encoding endpoint "
    b"environment exception execute export extends false filename function getElementById github handler header hostname http "
    b"https identifier implements import include index initialize instance integer interface iterator javascript length library "
    b"license localhost logging manager message method module namespace null number object operation option output override "
    b"package parameter password path pattern permission pointer position private process production property protected "
    b"protocol provider public python query random receive reference register repository request resource response result "
    b"return schema secret security select sequence server service session setting signature source static status storage "
    b"string struct subject template test text thread timeout timestamp token transaction transform true type undefined "
    b"update upload username utf-8 validate value variable version vector virtual void volatile window worker example.com "
    b"www. .com/ ://  = \" ': \" api_key= API_KEY access_key secret_key private_key client_secret "
)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns' matches."""
    out = []
    if ASSIGN_WORD.search(text):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def marginal_ratio(candidate: str, before: str, after: str) -> float:
    """Compressed bytes that the candidate adds, per byte, given its surroundings."""
    import zstandard

    around = IDENTIFIERS + f"{before}\n{after}".encode("utf-8", "surrogatepass")
    zd = zstandard.ZstdCompressionDict(around, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    params = zstandard.ZstdCompressionParameters.from_level(19, write_content_size=False, write_checksum=False, write_dict_id=False)
    z = zstandard.ZstdCompressor(dict_data=zd, compression_params=params)
    empty = len(z.compress(b""))
    # Names in capitals or camel case are made of the same identifiers.
    return min(len(z.compress(x.encode())) - empty for x in {candidate, candidate.lower()}) / len(candidate)


def _mixed(s: str) -> bool:
    """Digits among letters, or capitals all over: not the shape of a word of prose or of a name in camel case."""
    if any(c.isdigit() for c in s):
        return any(c.isalpha() for c in s)
    return s != s.upper() and 6 * sum(a.islower() and b.isupper() for a, b in zip(s, s[1:])) >= len(s)


def novel_spans(text: str, taken: list[tuple[int, int, int]], ratio: float = RATIO) -> list[tuple[int, int, int]]:
    """Incompressible strings near a sensitive word, apart from the base spans.

    A string of LONG characters or more may begin up to REACH after the word, over
    line ends too, or end as near before it on its line; one of SHORT characters
    only if the word is set to it. Lines that go on with such a string right after
    one that was found (the body of a key) count as near. Each string is looked at
    once and compressed once, so the work is linear in the text.
    """
    words = [(m.start(), m.end()) for m in CONTEXT.finditer(text)]
    if not words:
        return []
    starts, reach = [s for s, _, _ in taken], list(accumulate((e for _, _, e in taken), max))
    begins, out, last, w = [s for s, _ in words], [], -1, 0
    ends = [e for _, e in words]
    for run in RUN.finditer(text):
        # A run may hold the word it belongs to (token=...): what follows the last word within it is the string.
        w = bisect_right(begins, run.end() - SHORT, w) if w < len(begins) else w
        start = max(run.start(), ends[w - 1]) if w and ends[w - 1] <= run.end() else run.start()
        body = text[start : run.end()]
        s = body.strip(".=-")
        start += body.index(s)
        end = start + len(s)
        if len(s) < SHORT or not _mixed(s):
            continue
        behind = start - ends[w - 1] if w and ends[w - 1] <= start else None
        near = behind is not None and (behind <= REACH and len(s) >= LONG or behind <= 24 and any(map(str.isdigit, s)) and ASSIGNED.fullmatch(text, ends[w - 1], start) is not None)
        if not near and len(s) >= LONG:
            ahead = w < len(begins) and begins[w] - end <= REACH and "\n" not in text[end : begins[w]]
            near = ahead or (last >= 0 and start - last <= 8 and text[last:start].strip(".=-").isspace())
        if not near:
            continue
        k = bisect_right(starts, start)
        if (k and reach[k - 1] > start) or (k < len(starts) and starts[k] < end):
            continue
        if marginal_ratio(s, text[max(0, start - AROUND) : start], text[end : end + AROUND]) >= ratio:
            out.append((start, 3, end))
            last = end
    return out


def join_spans(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan_text(text: str, ratio: float = RATIO) -> tuple[int, int, int, str, str, int]:
    """n_assign, n_access, n_hex, base_sha256, spans, n_novel of a text."""
    base = base_spans(text)
    novel = novel_spans(text, base, ratio)
    n = [sum(k == kind for _, k, _ in base) for kind in range(3)]
    return (*n, hashlib.sha256(join_spans(base).encode()).hexdigest(), join_spans(sorted(base + novel)), len(novel))


def scan_secrets(docs: DataFrame, ratio: float = RATIO) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_novel: a row per row, whole texts.

    Spans are code points of the whole match, end exclusive. Null counts as empty; a
    text without spans has empty ``spans`` and the hash of an empty string; spans of
    one start come in the order of their kinds. Time is linear in a text's length, and
    a text's surroundings are all that is compressed with a string. Rows without doc_id and repeated rows are scanned like others, other columns are
    ignored, an empty table gives an empty result.
    """
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel"]
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [scan_text(t.as_py(), ratio) for t in text_column(b.column(1))]
            yield pa.record_batch([b.column(0).cast(pa.int64()), *(pa.array([r[i] for r in rows], type=t) for i, t in enumerate(types[1:]))], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long")
