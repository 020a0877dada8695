"""Secret scans: fixed patterns plus a token-efficiency test under a tiktoken vocabulary.

Random strings need many tokens: a candidate run of key characters whose characters-per-token
ratio is low is reported, unless it is a digest, a UUID or without letters.

Defined cases: a null text counts as empty and has no spans; offsets are code points, end
exclusive; spans of different kinds may overlap, and ties at one start are ordered by kind as in
KINDS; every row, repeated or without id, gives one row; an empty table gives an empty result;
columns other than doc_id and text are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches
from .textbatch import tidy

KINDS = ("assign", "access", "hex", "random")

# The base patterns.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}", re.A)
UUID = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}")
NUMBER = re.compile(r"[0-9+/_=-]*", re.A)
DIGEST_LENGTHS = frozenset((32, 40, 56, 64, 96, 128))

SCHEMA = (
    "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long"
)


def known_identifier(run: str) -> bool:
    """Digests in hex, UUIDs and runs without letters are not secrets by themselves."""
    plain = run.strip("=-_/+")
    if len(plain) in DIGEST_LENGTHS and re.fullmatch("[0-9a-f]+|[0-9A-F]+", plain):
        return True
    return bool(UUID.fullmatch(plain) or NUMBER.fullmatch(plain))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the three fixed patterns."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def random_spans(text: str, tokens_in, most_ratio: float) -> list[tuple[int, int, int]]:
    """Runs that have few characters a token."""
    out = []
    for m in CANDIDATE.finditer(text):
        run = m[0]
        if not known_identifier(run) and len(run) <= most_ratio * tokens_in(run):
            out.append((m.start(), 3, m.end()))
    return out


def said(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


_ENCODERS: dict = {}


def token_counter(path: str):
    """Number of tokens of a run under the vocabulary at `path`; the ranks load once a worker."""
    if path not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding(
            "scan", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
    encode = _ENCODERS[path].encode_ordinary
    piece = 4096  # long runs are counted in pieces: the encoder's time grows faster than its input

    def count(run: str) -> int:
        return sum(len(encode(run[i : i + piece])) for i in range(0, len(run), piece))

    return count


def scan_secrets(docs: DataFrame, vocabulary: str, most_ratio: float = 2.2) -> DataFrame:
    """Per row of `docs`: counts, the digest of the base spans and all spans.

    `vocabulary`: path of a .tiktoken file on every executor. `most_ratio`: characters a token up
    to which a run counts as random; prose has above 3.
    """

    def scan(batches):
        tokens_in = token_counter(vocabulary)
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                text = text or ""
                base = base_spans(text)
                more = random_spans(text, tokens_in, most_ratio)
                n = [sum(k == i for _, k, _ in base) for i in range(3)]
                digest = hashlib.sha256(said(base).encode()).hexdigest()
                rows.append((*n, digest, said(sorted(base + more)), len(more)))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            columns = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"],
            )

    return small_batches(docs).select("doc_id", "text").mapInArrow(tidy(scan), SCHEMA)
