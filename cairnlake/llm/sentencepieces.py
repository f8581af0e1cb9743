"""SentencePiece encoding and decoding over a table of distinct chunks.

No piece of such a model crosses from a character into a following whitespace marker, so a text is the chain of its
chunks: a run of markers and the characters up to the next marker. Each task keeps a table of the distinct chunks that
it has met, segments a chunk once, and joins the ids back by the position of the chunks in the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake.llm.common import enclosed, opened, ragged, read, schema_with, slices, text_bytes, tidy, with_columns

MARK = "▁"
MODEL = "piece_bpe_32k.model"
#: Ids held by a task's table of chunks before it is begun anew.
TABLE_IDS = 600_000


class Chunks:
    """Distinct chunks and their ids, segmented by the model as they first appear."""

    def __init__(self, model: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        crossing = next((p for i in range(self.sp.get_piece_size()) if MARK in (p := self.sp.id_to_piece(i)).lstrip(MARK)), None)
        if crossing:
            raise ValueError(f"the piece {crossing!r} crosses a whitespace marker: chunks can't be segmented alone")
        self.lone = self.sp.piece_to_id(MARK)
        self.clear()

    def clear(self) -> None:
        self.where: dict[str, int] = {}
        self.flat, self.starts, self.lens = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def rows(self, chunks: list[str]) -> np.ndarray:
        """The table rows of the chunks; new ones are segmented and added."""
        if len(self.flat) > TABLE_IDS:
            self.clear()
        new = [c for c in chunks if c not in self.where]
        if new:
            found = self.sp.encode(new, num_threads=1)
            found = [x or [self.lone] for x in found]
            lens = np.fromiter(map(len, found), np.int64, len(found))
            flat = np.fromiter((i for x in found for i in x), np.uint32, int(lens.sum()))
            base = len(self.where)
            self.where.update((c, base + k) for k, c in enumerate(new))
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lens) - lens])
            self.lens = np.concatenate([self.lens, lens])
            self.flat = np.concatenate([self.flat, flat])
        return np.fromiter(map(self.where.__getitem__, chunks), np.int64, len(chunks))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts with begin and end, offsets of n + 1)."""
        data, off = text_bytes(pc.replace_substring(pc.fill_null(texts, ""), MARK, " "))
        n = len(off) - 1
        full = off[:-1] < off[1:]
        space = data == 32
        cut = space.copy()
        cut[1:] &= ~space[:-1]
        cut[off[:-1][full]] = False
        drop = cut.copy()  # the marker that encode() puts before a chunk by itself
        cut[off[:-1][full]] = True
        begins = np.flatnonzero(cut)
        kept = np.cumsum(~drop)
        at = np.concatenate([kept[begins] - ~drop[begins], kept[-1:] if len(kept) else np.zeros(1, np.int64)])
        lean = np.ascontiguousarray(data[~drop])
        words = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(lean))
        table = words.dictionary_encode()
        rows = self.rows(table.dictionary.to_pylist())[table.indices.to_numpy()] if len(begins) else np.zeros(0, np.int64)
        lens = self.lens[rows]
        ids = self.flat[ragged(self.starts[rows], lens)] if len(rows) else np.zeros(0, np.uint32)
        first = np.searchsorted(begins, off)  # chunks before each text
        before = np.concatenate([[0], np.cumsum(lens)])[first]
        out_off = before + 2 * np.arange(n + 1)
        out = np.empty(int(out_off[-1]), np.uint32)
        inner = np.ones(len(out), bool)
        inner[out_off[:-1]] = False
        inner[out_off[1:] - 1] = False
        out[out_off[:-1]], out[out_off[1:] - 1] = self.sp.bos_id(), self.sp.eos_id()
        out[inner] = ids
        return out, out_off


def encode_decode(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``piece_ids`` (ids with begin and end, little-endian unsigned 32-bit) and ``decoded`` (their text).

    A null or empty text has the begin and end ids only and decodes to an empty text; long texts are encoded whole.
    Repeated rows each keep their row, an empty table gives an empty table, and own columns named like the new ones, in
    any case, are replaced.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = Chunks(model_path)
        for batch in batches:
            for part in slices(batch, "_text", 1 << 20):
                ids, off = chunks.encode(part.column("_text"))
                decoded = chunks.sp.decode([ids[a:b].tolist() for a, b in zip(off, off[1:], strict=False)], num_threads=1)
                packed = pa.BinaryArray.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer((off * 4).astype(np.int32)), pa.py_buffer(ids.astype("<u4"))])
                yield with_columns(part, {"piece_ids": packed, "decoded": pa.array(decoded, pa.string())})
            tidy()
        chunks.clear()
        tidy()

    own = enclosed(docs, _text=text)
    return opened(own.mapInArrow(run, schema_with(own, "piece_ids binary, decoded string")), docs, ("piece_ids", "decoded"), _text=text)


def digest(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        (F.octet_length("piece_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("piece_ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op2_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Ids and decoded texts of all documents, as digests."""
    import public_tokenizers

    return digest(encode_decode(read(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(MODEL)))
