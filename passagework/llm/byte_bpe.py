"""Byte-level byte-pair encoding and decoding with the ranks of a public vocabulary file.

Pre-tokens are merged through a rank queue: a bucket for each merge rank holds positions of a linked
list, a bitmap of two levels (words of 64 ranks, and a summary of the words in use) tells which buckets hold
any, and find-first-set on the two gives the least rank. A position whose pair has changed since it was queued is stale and skipped. A merge costs constant
time plus the order of positions within its bucket, so a pre-token of any length takes close to linear time.

A null or empty text has no ids and decodes to no bytes; special tokens are ordinary text; rows and ids
repeat as they come; columns other than id and text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.llm.textbytes import cached, chunks, column_bytes

CHUNK = 4_000_000
#: Pre-tokens whose ids a worker remembers, in each of two generations, and the length up to which it does.
REMEMBERED, SHORT = 500_000, 64
#: What \s stands for in the vocabulary's pattern, whatever the regular-expression library.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


class Coder:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
        self.bytes_of = {str(rank): token for token, rank in self.ranks.items()}
        self.single = [self.ranks[bytes([b])] for b in range(256)]
        self.shift = max(self.ranks.values()).bit_length()
        self.pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left << self.shift | right] = rank
        words = (1 << self.shift >> 6) + 1
        self.low, self.bits, self.wide = [0] * words, [1 << b for b in range(64)], [1 << w for w in range(words)]
        inner = pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")
        self.find = regex.compile(inner).findall
        self.young: dict[str, str] = {}
        self.old: dict[str, str] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: always the leftmost pair of the least rank is merged."""
        if (known := self.ranks.get(piece)) is not None:
            return [known]
        pairs, shift, low, bits, wide = self.pairs.get, self.shift, self.low, self.bits, self.wide
        token = list(map(self.single.__getitem__, piece))
        n = len(token)
        rank = [pairs(a << shift | b, -1) for a, b in zip(token, token[1:])]
        rank.append(-1)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        buckets: dict[int, list[int]] = {}
        top = 0
        for at, r in enumerate(rank):
            if r >= 0:
                if r in buckets:
                    buckets[r].append(at)
                else:
                    buckets[r] = [at]
                    low[r >> 6] |= bits[r & 63]
                    top |= wide[r >> 6]
        while top:
            word = (top & -top).bit_length() - 1
            some = low[word]
            r = (word << 6) + (some & -some).bit_length() - 1
            bucket = buckets[r]
            if len(bucket) == 1:
                at = bucket[0]
                del buckets[r]
                some ^= bits[r & 63]
                low[word] = some
                if not some:
                    top ^= wide[word]
            else:
                at = heappop(bucket)
            if rank[at] != r:
                continue
            gone = after[at]
            token[at] = r
            token[gone] = rank[gone] = -1
            right = after[at] = after[gone]
            if right < n:
                before[right] = at
                new = rank[at] = pairs(r << shift | token[right], -1)
                if new >= 0:
                    if new in buckets:
                        heappush(buckets[new], at)
                    else:
                        buckets[new] = [at]
                        low[new >> 6] |= bits[new & 63]
                        top |= wide[new >> 6]
            else:
                rank[at] = -1
            left = before[at]
            if left >= 0:
                new = rank[left] = pairs(token[left] << shift | r, -1)
                if new >= 0:
                    if new in buckets:
                        heappush(buckets[new], left)
                    else:
                        buckets[new] = [left]
                        low[new >> 6] |= bits[new & 63]
                        top |= wide[new >> 6]
        return [x for x in token if x >= 0]

    def piece(self, text: str) -> str:
        """Decimal ids of a pre-token, joined by commas; short ones are remembered."""
        found = self.old.get(text)
        if found is None:
            found = ",".join(map(str, self.merge(text.encode("utf-8", "surrogatepass"))))
        if len(text) <= SHORT:
            if len(self.young) >= REMEMBERED:
                self.old, self.young = self.young, {}
            self.young[text] = found
        return found

    def encode(self, text: str) -> str:
        known = self.young.get
        piece = self.piece
        return ",".join([known(x) or piece(x) for x in self.find(text)])

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.split(","))) if ids else b""


def coder(path: str, pattern: str) -> Coder:
    """A worker keeps it, and with it the pre-tokens that it remembers."""
    return cached(("byte_bpe", path, pattern), lambda: Coder(path, pattern))


def byte_bpe(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_tokens, ids (decimal, joined by commas), decoded (bytes of these ids)."""
    few = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))

    def run(batches):
        own = coder(path, pattern)
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            for i, j in chunks(offsets, CHUNK):
                ids = [own.encode(data[a:b].tobytes().decode("utf-8", "replace")) for a, b in zip(offsets[i:j], offsets[i + 1 : j + 1])]
                count = np.fromiter((x.count(",") + 1 if x else 0 for x in ids), np.int64, len(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(count), pa.array(ids, pa.string()), pa.array([own.decode(x) for x in ids], pa.binary())], ["_id", "n_tokens", "ids", "decoded"])

    made = few.mapInArrow(run, f"_id {dict(few.dtypes)['_id']}, n_tokens bigint, ids string, decoded binary")
    return made.withColumnRenamed("_id", id_col)
