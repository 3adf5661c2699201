"""Packing by power-of-two decomposition.

A document's ids are cut into pieces whose lengths are the powers of two of its length's binary
form, after as many whole sequences as it fills.  Pieces of equal length form a bucket, and every
piece is a sequence of its own: none crosses documents and none needs padding."""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonecraft.llm import arrow_text as T
from zonecraft.llm.numbering import numbered
from zonecraft.session import store

MAX_LENGTH, END_ID, CACHED_CHUNKS = 4096, 2, 500_000

# Fixed value: the split pattern of the tokenizer file that the short way below stands for.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class ChunkTokenizer:
    """Ids of chunks between ASCII white space, each chunk once per worker while the cache lasts.

    For tokenizers that drop white space and never join across it, the ids of a text are those of
    its chunks in a row.  Chunks of ASCII and the precomposed letters of Latin-1 are lower-cased and
    split here and go straight to the tokenizer's model, since normalising and splitting take
    most of its time; all others go through the whole tokenizer."""

    SIMPLE = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
    PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        steps = [n["type"] for n in (parts["normalizer"] or {}).get("normalizers", [])]
        split = (parts["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        if not any(n.get("content") == " " and n.get("pattern") == {"Regex": "\\s+"} for n in (parts["normalizer"] or {}).get("normalizers", [])) or not split[0].get("invert"):
            raise ValueError("the tokenizer must drop white space: " + path)
        self.short = steps == ["NFC", "Replace", "Lowercase"] and split[0].get("pattern") == {"Regex": SPLIT} and [s["type"] for s in split] == ["Split", "ByteLevel"]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in plain]
        added = [t["content"].lower() for t in parts["added_tokens"]]
        if any(T.SPACE[b] for content in added for b in content.encode()):
            raise ValueError("an added token must not hold white space: " + path)
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)")
        self.alphabet = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}
        self.chunks: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            shown = piece if piece.isascii() else "".join(map(self.alphabet.__getitem__, piece.encode()))
            found = self.pieces[piece] = np.array([t.id for t in self.tokenizer.model.tokenize(shown)], dtype="<u4").tobytes()
        return found

    def chunk(self, chunk: bytes) -> bytes:
        found = self.chunks.get(chunk)
        if found is None:
            text = chunk.decode()
            if self.short and self.SIMPLE.fullmatch(text) and not self.added.search(lower := text.lower()):
                found = b"".join([self._piece(p) for p in self.PIECE.findall(lower)])
            else:
                found = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
            self.chunks[chunk] = found
        return found

    def block(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a block in a row, and where each text's end."""
        for cache in (self.chunks, self.pieces):
            if len(cache) > CACHED_CHUNKS:
                cache.clear()
        start, end, row = T.spans(buf, offsets, T.SPACE)
        _, first, which = np.unique(T.span_hash(buf, start, end), return_index=True, return_inverse=True)
        raw = buf.tobytes()
        ids = [self.chunk(raw[s:e]) for s, e in zip(start[first].tolist(), end[first].tolist())]
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), dtype="<u4")
        begins = np.cumsum(sizes) - sizes
        lengths = sizes[which] if len(which) else np.zeros(0, np.int64)
        upto = np.cumsum(lengths)
        out = flat[np.repeat(begins[which] - (upto - lengths), lengths) + np.arange(upto[-1])] if len(upto) else flat
        counts = np.bincount(row, weights=lengths, minlength=len(offsets) - 1).astype(np.int64)
        return out, np.cumsum(counts)


def tokenizer_of(path: str) -> ChunkTokenizer:
    state = T.worker_state()
    if getattr(state, "tokenizer", (None,))[0] != path:
        state.tokenizer = (path, ChunkTokenizer(path))
    return state.tokenizer[1]


def cut(tokens: int, longest: int) -> list[int]:
    """Lengths of the pieces, longest first."""
    return [longest] * (tokens // longest) + [1 << i for i in range(longest.bit_length() - 2, -1, -1) if (tokens % longest) >> i & 1]


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", longest: int = MAX_LENGTH, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """(`id_col`, start, length, ids, ids_crc32, doc_tokens) for every piece of every row; a null text is
    empty and has the end id alone.  `path` names the tokenizer file on the executors."""
    if longest & (longest - 1):
        raise ValueError("the longest sequence must be a power of two")

    def work(batches):
        tokenizer = tokenizer_of(path)
        for batch in batches:
            for lo, hi, buf, offsets in T.blocks(batch.column(1)):
                body, upto = tokenizer.block(buf, offsets)
                ids = np.insert(body, upto, end_id).astype("<u4")
                begin, owner, start, length, whole = 0, [], [], [], []
                for i, end in enumerate((upto + np.arange(1, hi - lo + 1)).tolist()):
                    sizes = cut(end - begin, longest)
                    at = 0
                    for size in sizes:
                        owner.append(lo + i)
                        start.append(at)
                        length.append(size)
                        whole.append(end - begin)
                        at += size
                    begin = end
                bounds = np.concatenate([[0], np.cumsum(length)])
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                columns = [batch.column(0).take(pa.array(owner)), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(whole, pa.int64())]
                names = [id_col, "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.view("<i4"))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + ", ids array<int>" * with_ids
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(work, schema)


def packed(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", longest: int = MAX_LENGTH, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """`pieces` with sequence_id and offset: a sequence is one piece at offset 0.

    Sequences of a length are numbered by a class of the id's MD5, id, start and checksum, and the
    numbers of the lengths interleave, so ids are unique, say the length, and depend on the rows alone.
    Pieces are stored before they are numbered, so texts are tokenized once.
    Repeated rows give equal pieces in sequences of their own; a null id is a value like any other;
    an empty table gives no rows."""
    lengths = longest.bit_length()
    rows = store(pieces(docs, path, id_col, text_col, longest, end_id, with_ids)).withColumn("__spread", F.coalesce(F.substring(F.md5(F.col(id_col).cast("string")), 1, 3), F.lit("")))
    numbers = numbered(rows, ["length"], ["__spread"], [id_col, "start", "ids_crc32"], "__number").drop("__spread")
    power = F.length(F.bin("length")) - 1
    return numbers.withColumn("sequence_id", (F.col("__number") - 1) * lengths + power).withColumn("offset", F.lit(0).cast("long")).drop("__number")
