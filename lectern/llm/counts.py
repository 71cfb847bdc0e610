"""Token counts of whole texts by a map-side two-tier lookup of pre-token lengths.

A piece model never merges across the left edge of a space or of a line feed when no piece
holds one further in, so a text's count is the sum over its pre-tokens: the spaces before a
word with the word, or a line feed with what follows. Lengths of frequent pre-tokens come in a
broadcast hash table, two flat arrays with one slot for each hash prefix; the others, and those
whose slot a more frequent one took, are encoded once per worker and cached there. Pre-tokens
themselves are never shuffled: bounded summaries of the tasks are merged level by level to
choose the table, which steers speed alone.

Pre-tokens are told apart by 64-bit hashes. Among 1e10 different ones the chance that any takes
the slot of another of the table is 4e-5.

Defined results: null and empty texts count 0 tokens; repeated rows are counted each; columns
other than the id and the text are neither read nor returned.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_array, bound_batches, merge_tree, slices, utf8_parts
from .kernel import word_hashes

#: Pre-tokens of the broadcast tier; of one task's summary; of a worker's cache.
FREQUENT, SUMMARY, CACHE = 1 << 16, 1 << 13, 1 << 18
#: Bits of a slot number of the broadcast table; different pre-tokens that one batch adds to a summary.
SLOT_BITS, PER_BATCH = 19, 4096
_SPACE, _FEED = 32, 10
_SEGMENT = re.compile(r" +[^ \n]*|\n[^ \n]*")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def pretokens(text: str) -> list[str]:
    """Pre-tokens without their one leading space; a line feed starts a pre-token of its own."""
    if not text:
        return []
    if "▁" in text:
        text = text.replace("▁", " ")
    parts = text.replace("\n", " \n").split(" ")
    if "" in parts:  # runs of spaces, or spaces at an edge
        parts = [x[1:] if x[0] == " " else x for x in _SEGMENT.findall(" " + text)]
    return parts


def splits_safely(pieces: list[str]) -> bool:
    """Whether no piece holds a line feed with other text, or a space after something else."""
    return not any(("\n" in x and x != "\n") or re.search("[^▁]▁", x) for x in pieces)


def measure(encode: Callable[[str], list[int]], key: str) -> int:
    if not key:
        return 1  # a space with nothing after it
    # Encoding puts a space first; before a line feed it stands alone and is one token.
    return len(encode(key)) - (key[0] == "\n")


def pretoken_spans(col: pa.Array) -> tuple[np.ndarray, ...]:
    """Bytes of a text column, starts, ends and rows of its pre-tokens, rows with one empty one more, and byte sizes.

    As pretokens(), without their one leading space; an empty one stands for a single space.
    """
    _, offsets = utf8_parts(col)
    size = np.diff(offsets)
    if pc.any(pc.match_substring(col, "▁")).as_py():
        col = pc.replace_substring(col, "▁", " ")
    data, offsets = utf8_parts(col)
    space, feed = data == _SPACE, data == _FEED
    begin = feed | space
    begin[1:] &= ~(space[1:] & space[:-1])
    full = offsets[:-1] < offsets[1:]
    first = offsets[:-1][full]
    begin[first] = True
    at = np.flatnonzero(begin)
    end = np.append(at[1:], len(data))[: len(at)]
    lead = np.zeros(len(data), bool)
    lead[first] = True
    start = at + (space[at] & ~lead[at])
    row = np.searchsorted(offsets, at, "right") - 1
    # The space that encoding puts first stands alone before a line feed.
    alone = np.flatnonzero(full)[feed[first]]
    return data, start, end, row, alone, size


class Table:
    """Lengths of frequent pre-tokens by hash: a slot holds a whole hash and a length, or nothing."""

    def __init__(self, hashes: np.ndarray, lengths: np.ndarray, bits: int = SLOT_BITS):
        self.bits = bits
        self.keys, self.sizes = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint16)
        slot = self._slot(hashes)
        kept, at = np.unique(slot, return_index=True)  # the first of a slot, in order of frequency
        fits = lengths[at] < 1 << 16
        self.keys[kept[fits]], self.sizes[kept[fits]] = hashes[at][fits], lengths[at][fits]

    def _slot(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.bits)).astype(np.int64)

    def look(self, hashes: np.ndarray) -> np.ndarray:
        """Lengths, 0 where the table has none."""
        slot = self._slot(hashes)
        return np.where(self.keys[slot] == hashes, self.sizes[slot], 0).astype(np.int64)


class Counting:
    """Token counts of text columns in one worker."""

    def __init__(self, encode: Callable[[str], list[int]], table: Table, limit: int = CACHE):
        self.encode, self.table, self.limit = encode, table, limit
        self.cache: dict[int, int] = {}

    def counts(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Tokens and bytes of each row."""
        data, start, end, row, alone, size = pretoken_spans(col)
        h = word_hashes(data, start, end, False)
        n = self.table.look(h)
        miss = np.flatnonzero(n == 0)
        if len(miss):
            new, at, back = np.unique(h[miss], return_index=True, return_inverse=True)
            view, found = memoryview(data), np.empty(len(new), np.int64)
            for k, (key, m) in enumerate(zip(new.tolist(), miss[at].tolist())):
                got = self.cache.get(key)
                if got is None:
                    got = measure(self.encode, bytes(view[start[m] : end[m]]).decode("utf-8", "replace"))
                    if len(self.cache) >= self.limit:
                        self.cache.clear()
                    self.cache[key] = got
                found[k] = got
            n[miss] = found[back]
        total = np.bincount(row, n, len(size)).astype(np.int64)
        total[alone] += 1
        return total, size


_workers: dict[str, tuple[str, Counting]] = {}


def _encoder(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda text: model.encode(text, num_threads=1)


def _packed(top: list[tuple[bytes, int]]) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.table({"k": pa.array([k for k, _ in top], pa.binary()), "n": pa.array([n for _, n in top], pa.int64())})
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(part: bytes) -> dict[bytes, int]:
    table = pa.ipc.open_stream(pa.py_buffer(part)).read_all()
    return dict(zip(table.column("k").to_pylist(), table.column("n").to_pylist()))


def _leading(seen: Counter, limit: int) -> list[tuple[bytes, int]]:
    return sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:limit]


def frequent_pretokens(docs: DataFrame, text_col: str = "text", limit: int = FREQUENT, summary: int = SUMMARY) -> list[tuple[bytes, int]]:
    """The pre-tokens that lead the counts over all texts, most frequent first.

    Every batch adds its PER_BATCH most frequent ones to its task's summary, and a summary that
    grows beyond 2**18 entries forgets those seen least; memory and what is sent stay bounded.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in slices(batches, "text", 2 << 20):
            data, start, end, *_ = pretoken_spans(batch.column(batch.schema.get_field_index("text")))
            _, at, n = np.unique(word_hashes(data, start, end, False), return_index=True, return_counts=True)
            best = np.argsort(-n, kind="stable")[:PER_BATCH]
            view = memoryview(data)
            for m, k in zip(at[best].tolist(), n[best].tolist()):
                if end[m] - start[m] <= 64:
                    seen[bytes(view[start[m] : end[m]])] += k
            if len(seen) > 1 << 18:
                seen = Counter(dict(_leading(seen, 1 << 17)))
        if seen:
            yield pa.RecordBatch.from_arrays([binary_array([_packed(_leading(seen, summary))])], ["part"])

    def merge(parts: Iterator[bytes]) -> bytes:
        seen: Counter = Counter()
        for p in parts:
            seen.update(_unpacked(p))
            if len(seen) > 4 * limit + summary:
                seen = Counter(dict(_leading(seen, 2 * limit)))
        return _packed(_leading(seen, limit))

    bound_batches(docs.sparkSession)
    found = merge_tree(docs.select(F.col(text_col).alias("text")).mapInArrow(count, "part binary"), merge)
    return list(_unpacked(found).items()) if found else []


def token_counts(docs: DataFrame, model: str | None = None, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) for every whole text.

    Raises for models whose pieces cross pre-tokens, and for those without a dummy prefix or with
    a normalisation: their counts aren't sums over pre-tokens.
    """
    spark, path = docs.sparkSession, model or default_model()
    bound_batches(spark)
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    spec = proto.normalizer_spec
    if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not spec.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("only models without normalisation, and with a dummy prefix, are supported")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    if not splits_safely([sp.id_to_piece(k) for k in range(sp.get_piece_size())]):
        raise ValueError("a piece of this model crosses pre-tokens; its counts aren't sums over them")
    encode = _encoder(path)
    top = [k.decode() for k, _ in frequent_pretokens(docs, text_col)]
    raw, offsets = utf8_parts(pa.array(top, pa.string()))
    lengths = np.array([measure(encode, k) for k in top], np.int64)
    key, table = uuid.uuid4().hex, spark.sparkContext.broadcast(Table(word_hashes(raw, offsets[:-1], offsets[1:], False), lengths))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _workers or _workers[path][0] != key:
            _workers[path] = (key, Counting(_encoder(path), table.value))
        for batch in slices(batches, "text", 2 << 20):
            n, size = _workers[path][1].counts(batch.column(batch.schema.get_field_index("text")))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), pa.array(size), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
