"""Secret scan: fixed patterns plus strings that a public vocabulary cannot compress.

Ordinary words and identifiers are made of long vocabulary entries; random keys fall apart into one to two characters a
token. Candidates are unbroken runs that mix character classes; those with few characters per token are reported unless
they are known digests or identifiers.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terradrift.llm.common import text_or_empty

# Fixed values of the base scan.
ASSIGN = re.compile(r"(?ai:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a maximal run of 32 or more: a shorter run cannot start a match
MIN_ASSIGNED, MIN_ACCESS = 8, 16
KINDS = ("assign", "access", "hex", "random")

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Digests by length (MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512) and identifiers that look random but are no secrets.
DIGEST = re.compile(r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128})")
IDENTIFIER = re.compile(
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"  # UUID
    r"|[0-9+/_=-]+"  # dates, numbers, rules of dashes
    r"|sha(?:1|256|384|512)-[A-Za-z0-9+/=]+"  # integrity attribute
)
#: Words and short numbers joined by separators; identifiers only if the vocabulary compresses their letters.
WORDS = re.compile(r"(?:[A-Za-z]+|[0-9]{1,8})(?:[_/=+-](?:[A-Za-z]+|[0-9]{1,8}|))*")
LETTERS = re.compile(r"[A-Za-z]+")
OUTPUT = "n_assign bigint, n_access bigint, n_hex bigint, n_random bigint, base_sha256 string, spans string"


def encoder(vocabulary: str):
    """tiktoken encoding of a rank file; the pattern splits at changes between letters, digits and the rest."""
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("scan", pat_str=r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9]+", mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind index, end)`` of the fixed patterns, leftmost and non-overlapping per kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= MIN_ASSIGNED]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _mixed(run: str) -> bool:
    digit = any(c.isdigit() for c in run)
    upper_inside = any(c.isupper() for c in run[1:])
    lower = any(c.islower() for c in run)
    return (digit and (lower or upper_inside)) or (upper_inside and lower)


def _words(run: str, encode, max_ratio: float) -> bool:
    """Whether a run is words and short numbers, and the words have more than ``max_ratio`` characters per token."""
    words = LETTERS.findall(run) if WORDS.fullmatch(run) else []
    return sum(map(len, words)) > max_ratio * sum(len(encode(w)) for w in words)


def random_spans(text: str, taken: list[tuple[int, int, int]], encode, max_ratio: float) -> list[tuple[int, int, int]]:
    """Runs of at most ``max_ratio`` characters per token that no base span touches."""
    found = []
    for m in RUN.finditer(text):
        run = m[0].strip("=-_/+")
        if len(run) < 16 or not _mixed(run) or DIGEST.fullmatch(run) or IDENTIFIER.fullmatch(run):
            continue
        start = m.start() + m[0].index(run)
        end = start + len(run)
        if any(a < end and start < b for a, _, b in taken):
            continue
        if len(run) <= max_ratio * len(encode(run)) and not _words(run, encode, max_ratio):
            found.append((start, 3, end))
    return found


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY,
                 max_ratio: float = 2.0) -> DataFrame:
    """One row per document: counts by kind, SHA-256 of the base spans and all spans in order.

    Offsets count code points, ends are exclusive. Null text is empty; an empty text has no spans and the digest of the
    empty string. Repeated rows give repeated rows, a null key is kept, other columns are not read. Whole texts are scanned.
    """
    id_type = docs.select(F.col(key)).schema[0].dataType.simpleString()
    rows = docs.select(F.col(key).cast("string").alias("doc_id"), text_or_empty(text).alias("body"))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(vocabulary).encode_ordinary
        for batch in batches:
            out = []
            for body in batch["body"]:
                base = base_spans(body)
                extra = random_spans(body, base, encode, max_ratio)
                count = [sum(k == i for _, k, _ in base) for i in range(3)]
                out.append((*count, len(extra), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + extra)))
            frame = pd.DataFrame(out, columns=[x.split()[0] for x in OUTPUT.split(", ")])
            frame.insert(0, "doc_id", batch["doc_id"].array)
            yield frame

    # The key travels as text: pandas would turn long integers beside a null into floats.
    return rows.mapInPandas(scan, f"doc_id string, {OUTPUT}").withColumn("doc_id", F.col("doc_id").cast(id_type))
