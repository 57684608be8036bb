"""Alignment of the tokens of two tokenizers over the same text, and counts of the token pairs that end together.

Tokenizer A is a byte-level BPE file of the tokenizers library, which reads a space and the text; B is a
sentencepiece model, which adds that space. Coarse cuts come from the libraries' own spans: A's
character offsets and the spans of B's proto. Where several tokens share a cut, because a character has
more bytes than a token, or falls back to bytes, the decoded bytes of the tokens place their ends.

Both tokenizers have a boundary at every single space between characters that are not white space:
A's pre-tokenizer begins a word there, and no piece of B goes on into the next word. Texts are cut there,
and each distinct piece is aligned once per cache generation of a Python worker.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from covermill.llm.library_tokens import tokenizer_path
from covermill.llm.pieces import RecentCache, one_per_worker, safe_chunks, safe_pieces, slices_by_bytes
from covermill.llm.token_files import new_folder

A_VOCABULARY, B_MODEL = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Pairs of ids up to which their counts are broadcast, at about 50 bytes each; beyond, links are shuffled to them.
BROADCAST_PAIRS = 1_000_000
#: Pieces given to the libraries as one text.
_TOGETHER = 256
_SPACE = "▁"
#: tokens of A, of B, groups, groups as text, links (A's id in the upper half, B's in the lower)
Aligned = tuple[int, int, int, str, bytes]


def byte_letters() -> dict[str, int]:
    """The bytes that the characters of a byte-level vocabulary stand for.

    Printable bytes stand for themselves, the others are numbered from 256 on.
    """
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


def refined_ends(sizes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray | None:
    """The byte offset after each token, from the tokens' sizes and their coarse spans in bytes.

    Tokens whose spans overlap or are empty share a cell up to the next coarse cut, and their sizes
    place them inside. None if the sizes don't fill a cell exactly.
    """
    found = np.cumsum(sizes)
    # a cell is closed where the next token begins at or after this one's end
    closed = np.append(starts[1:] >= ends[:-1], True) & (ends > starts)
    return found if np.array_equal(found[closed], ends[closed]) else None


class Aligner:
    """Aligns pieces of text, each read with one space before it."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.no_truncation()
        self.a.no_padding()
        # strings of special tokens in a text are plain text
        self.a.encode_special_tokens = True
        letters, vocabulary = byte_letters(), self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(map(letters.__getitem__, token)) if all(c in letters for c in token) else token.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.b_bytes = []
        self.whole_words = True
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(_SPACE, " ").encode())
            self.whole_words &= _SPACE not in piece.lstrip(_SPACE)
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in names], dtype=np.int64) for names in (self.a_bytes, self.b_bytes))
        self.names = [str(i) for i in range(max(len(self.a_bytes), len(self.b_bytes)))]
        self.cache = RecentCache(150_000)

    def _joined(self, pieces: list[str], e, proto) -> list[Aligned] | None:
        """The pieces' results from the encodings of all of them, joined by single spaces, or None if these don't spell it back."""
        text = " " + " ".join(pieces)
        data = text.encode()
        a_list, b_list, spans = e.ids, [], []
        for p in proto.pieces:
            b_list.append(p.id)
            spans += p.begin, p.end
        if b"".join(map(self.a_bytes.__getitem__, a_list)) != data or b"".join(map(self.b_bytes.__getitem__, b_list)) != data:
            return None
        ids, b_ids = np.array(a_list, dtype=np.int64), np.array(b_list, dtype=np.int64)
        offsets = np.fromiter(chain.from_iterable(e.offsets), dtype=np.int64, count=2 * len(a_list)).reshape(-1, 2)
        if len(data) != len(text):
            # characters to bytes: every byte but the later ones of a character begins one
            begins = np.flatnonzero(np.frombuffer(data, dtype=np.uint8) & 0xC0 != 0x80)
            offsets = np.append(begins, len(data))[offsets]
        a_ends = refined_ends(self.a_sizes[ids], offsets[:, 0], offsets[:, 1])
        # B's spans are bytes of what it was given, without the space before it, which its first token holds
        spans = np.array(spans, dtype=np.int64).reshape(-1, 2) + 1
        spans[0, 0] = 0
        b_ends = refined_ends(self.b_sizes[b_ids], spans[:, 0], spans[:, 1])
        if a_ends is None or b_ends is None:
            return None
        together, a_cuts, b_cuts = np.intersect1d(a_ends, b_ends, assume_unique=True, return_indices=True)
        a_cuts, b_cuts = a_cuts + 1, b_cuts + 1
        links = (ids[a_cuts - 1] << 32 | b_ids[b_cuts - 1]).astype("<i8").tobytes()
        a_names, b_names = list(map(self.names.__getitem__, a_list)), list(map(self.names.__getitem__, b_list))
        to_a, to_b = a_cuts.tolist(), b_cuts.tolist()
        groups = [
            a_names[x] + "|" + b_names[y] if u == x + 1 and v == y + 1 else ",".join(a_names[x:u]) + "|" + ",".join(b_names[y:v])
            for x, u, y, v in zip([0, *to_a], to_a, [0, *to_b], to_b)
        ]
        if len(pieces) == 1:
            return [(len(ids), len(b_ids), len(groups), ";".join(groups), links)]
        bounds = np.cumsum([len(p.encode()) + 1 for p in pieces])
        last = np.searchsorted(together, bounds)
        if not np.array_equal(together[last], bounds):
            return None
        to, n_a, n_b = [0, *(last + 1).tolist()], np.diff(a_cuts[last], prepend=0).tolist(), np.diff(b_cuts[last], prepend=0).tolist()
        return [(na, nb, j - i, ";".join(groups[i:j]), links[8 * i : 8 * j]) for i, j, na, nb in zip(to, to[1:], n_a, n_b)]

    def _align(self, pieces: list[str]) -> list[Aligned | None]:
        """Many pieces as one text, where each is sure to be cut off; those of a text not spelled back one by one."""
        joined = [p for p in pieces if " " not in p and p == p.strip()]
        known: dict[str, Aligned | None] = {}
        for rows in ([joined[k : k + _TOGETHER] for k in range(0, len(joined), _TOGETHER)], None):
            rows = [[p] for p in pieces if p not in known] if rows is None else rows
            texts = [" ".join(row) for row in rows]
            encoded = self.a.encode_batch([" " + x for x in texts], add_special_tokens=False)
            protos = self.b.encode(texts, return_type="proto", num_threads=1)
            for row, e, proto in zip(rows, encoded, protos, strict=True):
                found = self._joined(row, e, proto)
                if found is not None or len(row) == 1:
                    known.update(zip(row, found or [None], strict=True))
        return [known[p] for p in pieces]

    def align(self, texts: list[str | None]) -> list[Aligned]:
        """One result per text; a text that one of the tokenizers doesn't spell back has no tokens."""
        cut = [[p for part, _ in safe_chunks(text) for p in safe_pieces(part)] if text and self.whole_words else [text] if text else [] for text in texts]
        self.cache.fill({p for pieces in cut for p in pieces}, self._align)
        out: list[Aligned] = []
        for pieces in cut:
            parts = [self.cache[p] for p in pieces]
            if not parts or None in parts:
                out.append((0, 0, 0, "", b""))
            else:
                a, b, n, groups, links = zip(*parts)
                out.append((sum(a), sum(b), sum(n), ";".join(groups), b"".join(links)))
        return out


def _aligned_batches(column: int, a: str, b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_path, b_path = tokenizer_path(a), tokenizer_path(b)
        aligner = one_per_worker(("aligner", a_path, b_path), lambda: Aligner(a_path, b_path))
        for batch in batches:
            at = 0
            for texts in slices_by_bytes(batch.column(column), 2 << 20):
                found = aligner.align(texts.to_pylist())
                n_a, n_b, n_groups, groups, links = zip(*found)
                offsets = np.zeros(len(found) + 1, dtype=np.int32)
                np.cumsum([len(x) // 8 for x in links], out=offsets[1:])
                values = pa.array(np.frombuffer(b"".join(links), dtype="<i8"))
                new = [pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()), pa.array(n_groups, pa.int64()), pa.array(groups, pa.string()), pa.ListArray.from_arrays(pa.array(offsets), values)]
                rows = batch.slice(at, len(found))
                at += len(found)
                yield pa.RecordBatch.from_arrays([*rows.columns, *new], names=[str(k) for k in range(rows.num_columns + 5)])

    return run


NEW = ["n_a", "n_b", "n_groups", "groups", "links"]


def with_alignment(docs: DataFrame, text: str = "text", a: str = A_VOCABULARY, b: str = B_MODEL) -> DataFrame:
    """Adds the alignment of each whole text, read after one space.

    ``n_a`` and ``n_b`` are the numbers of tokens, ``n_groups`` that of the groups between byte offsets where
    tokens of both end, ``groups`` their ids (``a1,a2|b1;a3|b2,b3``), and ``links`` the pairs of tokens that
    end together, as A's id times 2**32 plus B's. Null and empty texts, and those whose tokens don't
    spell the text back, have zeros and empty values. Every row is kept, repeated ones too, and every
    column but those of these names. No text is cut. ``groups`` and ``links`` are a few times as large as
    the text, in batches of about 2 MB of text.
    """
    docs = docs.drop(*NEW)
    # positions for names, so that names that repeat or clash don't matter on the way
    schema = StructType([*docs.schema.fields, *docs.sparkSession.createDataFrame([], "n_a long, n_b long, n_groups long, groups string, links array<long>").schema.fields])
    numbered = docs.toDF(*[str(k) for k in range(len(docs.columns))])
    positions = StructType([type(f)(str(k), f.dataType, f.nullable) for k, f in enumerate(schema.fields)])
    return numbered.mapInArrow(_aligned_batches(docs.columns.index(text), a, b), positions).toDF(*schema.names)


def with_link_counts(aligned: DataFrame, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """Adds ``n_links``, ``n_best`` and ``count_sum`` for ``links``, which goes, as does ``groups``.

    A pair's count is the number of links of all rows that hold it. ``count_sum`` sums the counts of a
    row's links; ``n_best`` counts the links whose pair has the highest count of all pairs of its id of B,
    ties included. Rows without links have zeros; columns of the three names are replaced.

    The rows are written once, then their links are counted, merged before the shuffle. The table of pairs is bounded
    by the vocabularies, not the texts: up to ``broadcast_pairs`` of them are sent to all tasks, more are
    joined by shuffling each row's distinct pairs, which adaptive execution splits where a pair is frequent.
    """
    spark, folder = aligned.sparkSession, new_folder(aligned.sparkSession, "alignment")
    names = [c for c in aligned.columns if c not in ("links", "groups", "n_links", "n_best", "count_sum")]
    held = F.struct(*[F.col(c) for c in names]).alias("held")
    stored = aligned.select(F.monotonically_increasing_id().alias("row"), held, "links")
    stored.write.option("compression", "zstd").parquet(f"{folder}/rows")
    rows = spark.read.schema(stored.schema).parquet(f"{folder}/rows")

    b_id = F.col("pair").bitwiseAND((1 << 32) - 1)
    rows.select(F.explode("links").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")).write.parquet(f"{folder}/pairs")
    pairs = spark.read.schema("pair long, n long").parquet(f"{folder}/pairs")
    best = pairs.groupBy(b_id.alias("b")).agg(F.max("n").alias("most"))
    pairs.withColumn("b", b_id).join(best, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")).write.parquet(f"{folder}/counts")
    counts = spark.read.schema("pair long, n long, best boolean").parquet(f"{folder}/counts")

    sums = [F.sum("w").alias("n_links"), F.sum(F.when(F.col("best"), F.col("w")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("w")).alias("count_sum")]
    if counts.count() <= broadcast_pairs:
        # a row's links stay in its task, so they are summed there and one row is sent
        links = rows.select("row", F.explode("links").alias("pair")).withColumn("w", F.lit(1).cast("long"))
        summed = links.join(F.broadcast(counts), "pair").groupBy("row").agg(*sums)
    else:
        links = rows.select("row", F.explode("links").alias("pair")).groupBy("row", "pair").agg(F.count(F.lit(1)).alias("w"))
        summed = links.join(counts.hint("merge"), "pair").groupBy("row").agg(*sums)
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_links", "n_best", "count_sum")]
    return rows.select("row", "held").join(summed, "row", "left").select("held.*", *zero)
