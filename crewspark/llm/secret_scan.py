"""Secret scans by token efficiency.

A random string costs many tokens for its length, because a vocabulary made from language has no
long pieces for it.  Runs of credential characters whose characters-per-token ratio is low are
reported, unless they are known digests or numbers.  Three fixed patterns are reported always; what
they leave of a run is judged by itself.
"""

from __future__ import annotations

import base64
import re

from pyspark.sql import DataFrame

from crewspark.llm.common import map_rows, pick

#: Kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(
    r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
#: Known digests (by length, either case), UUIDs, dates, versions and other numbers.
KNOWN = re.compile(
    r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}"
    r"|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{56}|[0-9A-F]{64}|[0-9A-F]{96}|[0-9A-F]{128}"
    r"|[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}|[0-9.+/_=-]+)"
)


def encoder(ranks_path: str | None = None):
    """The tiktoken encoder of a rank file; by default that of the public 50k vocabulary."""
    import public_tokenizers
    import tiktoken

    path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("secrets", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def spans_of(text: str | None, enc, max_ratio: float = 2.2, min_chars: int = 20) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all secrets, sorted; code points, end exclusive; kind as in KINDS."""
    if not text:
        return []
    found = []
    if "=" in text or ":" in text:
        found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    runs = []
    for run in RUN.finditer(text):
        at, s = run.start(), run[0]
        if "AKIA" in s:
            found += [(at + m.start(), 1, at + m.end()) for m in ACCESS.finditer(s) if m.end() - m.start() >= 16]
        if len(s) >= 32:
            found += [(at + m.start(), 2, at + m.end()) for m in HEX.finditer(s) if m.end() - m.start() >= 32]
        if len(s) >= min_chars:
            runs.append((at, run.end()))
    base, k = sorted(found), 0
    for at, end in runs:
        while k < len(base) and base[k][2] <= at:  # sorted by start; runs are disjoint and in order
            k += 1
        j = k
        while at < end:  # up to the next base span, and on behind it
            stop = min(base[j][0], end) if j < len(base) else end
            own = text[at:stop].strip("+/_.=-") if stop > at else ""
            if len(own) >= min_chars and not KNOWN.fullmatch(own) and len(own) < max_ratio * len(enc.encode_ordinary(own)):
                start = text.index(own, at)
                found.append((start, 3, start + len(own)))
            at = max(at, base[j][2]) if stop < end else end
            j += 1
    return sorted(found)


def scan_secrets(docs: DataFrame, max_ratio: float = 2.2, min_chars: int = 20, ranks_path: str | None = None) -> DataFrame:
    """doc_id, counts by kind, and all spans ("kind:start:end", comma-joined) of each document.

    Null and empty texts have no spans; repeated rows give repeated rows; an empty table gives an
    empty one; other columns are not read.
    """

    def rows(columns, enc):
        ids, texts = columns
        each = [spans_of(t, enc, max_ratio, min_chars) for t in texts]
        counts = [[sum(k == kind for _, k, _ in x) for x in each] for kind in range(4)]
        joined = [",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in x) for x in each]
        base = [",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in x if k < 3) for x in each]
        return [ids, *counts, base, joined]

    return map_rows(
        pick(docs, "doc_id", "text"),
        "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_spans string, spans string",
        rows,
        lambda: encoder(ranks_path),
    )


def redact(text: str | None, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str | None:
    """The text with every span (overlapping ones joined) replaced by a mark."""
    if not spans:
        return text
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])
