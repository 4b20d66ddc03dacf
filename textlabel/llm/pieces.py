"""SentencePiece encoding and decoding through a table of distinct marked words."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "▁"
# A chunk is a run of word marks and what follows up to the next mark.
_CHUNK = re.compile(rf"{MARK}*[^{MARK}]+|{MARK}+")
# Texts are worked on in pages of about this many characters, each with its own table of distinct chunks.
PAGE_CHARS = 1 << 24
# Texts travel in compressed blocks of about this many characters.
BLOCK_CHARS = 1 << 20
# Distinct chunks are segmented in groups; one group for each so many characters of the corpus, at least one a task.
CHARS_PER_GROUP = 1 << 24


@cache
def processor(model: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=model)


@cache
def _plan(model: str) -> str:
    """How chunks of normalised text can be given back to `encode`; raises if chunks of this model interact."""
    sp = processor(model)
    inner = [i for i in range(sp.get_piece_size()) if MARK in sp.id_to_piece(i).lstrip(MARK)]
    if inner:
        raise ValueError(f"pieces of {model} cross word marks, such as {sp.id_to_piece(inner[0])!r}")
    if sp.piece_to_id(MARK) == sp.unk_id():
        raise ValueError(f"{model} has no piece for a mark alone")
    if sp.normalize("a") != f"{MARK}a" or sp.normalize("  a ") != MARK * 3 + "a" + MARK:
        raise ValueError(f"{model} does not keep blanks or adds no mark before a text")
    return "marked"


def chunks(model: str, text: str) -> list[str]:
    """Marked words of the normalised text; concatenated they are the normalised text."""
    return _CHUNK.findall(processor(model).normalize(text)) if text else []


def segment(model: str, words: list[str]) -> list[list[int]]:
    """Ids of each marked word: its first mark is the one that `encode` adds to a text. A mark alone is its own piece, as
    the library adds none to an empty text."""
    sp = processor(model)
    found = sp.encode([w[1:] for w in words], num_threads=1)
    return [[sp.piece_to_id(MARK)] if w == MARK else ids for w, ids in zip(words, found)]


def _pages(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, list[str]]]:
    """(page key, ids, texts) in pieces of at most a block. The key is a hash of the page's first row, so it is the same in
    every pass over a partition, wherever its task stands in a plan; pages that share a key share their tables."""
    page, in_page, held, ids, texts = 0, PAGE_CHARS, 0, [], []
    for batch in rows:
        for key, text in zip(batch.column(0), batch.column(1)):
            key, text = key.as_py(), text.as_py() or ""
            if in_page >= PAGE_CHARS:
                if ids:
                    yield page, ids, texts
                page = xxhash.xxh3_64_intdigest(text.encode(), xxhash.xxh32_intdigest(repr(key))) - (1 << 63)
                in_page, held, ids, texts = 0, 0, [], []
            ids.append(key)
            texts.append(text)
            in_page += len(text) + 1
            held += len(text) + 1
            if held >= BLOCK_CHARS:
                yield page, ids, texts
                held, ids, texts = 0, [], []
    if ids:
        yield page, ids, texts


def _packed(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def _unpacked(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _word_groups(model: str, groups: int):
    """Per page and group of words (by digest), its distinct chunks as one packed value."""

    def each(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _plan(model)

        def batch(page: int, words: set[str]) -> pa.RecordBatch:
            by_group: dict[int, list[str]] = {}
            for w in words:
                group = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little") % groups
                by_group.setdefault(group, []).append(w)
            keys = sorted(by_group)
            packed = [_packed("\0".join(sorted(by_group[k])).encode()) for k in keys]
            return pa.RecordBatch.from_arrays(
                [pa.array([page] * len(keys), pa.int64()), pa.array(keys, pa.int64()), pa.array(packed, pa.binary())],
                names=["page", "grp", "words"],
            )

        current, words = None, set()
        for page, _, texts in _pages(rows):
            if page != current and current is not None:
                yield batch(current, words)
                words = set()
            current = page
            for text in texts:
                # A chunk with the separator is segmented where it stands.
                words.update(w for w in chunks(model, text) if "\0" not in w)
        if current is not None and words:
            yield batch(current, words)

    return each


def _segment_groups(model: str):
    """Rows sorted by group: each distinct chunk of a group is segmented once, all pages get its ids."""

    def each(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, known = None, {}
        for batch in rows:
            pages, sizes, ids = [], [], []
            for page, group, packed in zip(*(c.to_pylist() for c in batch.columns)):
                if group != current:
                    current, known = group, {}
                words = _unpacked(packed).decode().split("\0")
                new = [w for w in words if w not in known]
                for w, found in zip(new, segment(model, new)):
                    known[w] = np.array(found, np.int32)
                found = [known[w] for w in words]
                pages.append(page)
                sizes.append(_packed(np.array([len(x) for x in found], np.int32).tobytes()))
                ids.append(_packed(np.concatenate(found).tobytes()))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(pages, pa.int64()),
                    batch.column(1),
                    batch.column(2),
                    pa.array(sizes, pa.binary()),
                    pa.array(ids, pa.binary()),
                ],
                names=["page", "grp", "words", "sizes", "pieces"],
            )

    return each


def _blocks(schema: pa.DataType):
    """Texts as packed blocks, in the same pages as the words."""

    def each(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for page, ids, texts in _pages(rows):
            data = [t.encode() for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([page], pa.int64()),
                    pa.array([ids], pa.list_(schema)),
                    pa.array([[len(d) for d in data]], pa.list_(pa.int32())),
                    pa.array([_packed(b"".join(data))], pa.binary()),
                ],
                names=["page", "ids", "lens", "texts"],
            )

    return each


def _join_back(model: str, key_type: pa.DataType, end: int | None):
    """Rows sorted by page, its segmented words before its blocks: ids by position, and their decoding."""

    def each(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = processor(model)
        current, table = None, {}

        def encode(text: str) -> list[int]:
            words = chunks(model, text)
            missing = [w for w in dict.fromkeys(words) if w not in table]
            if missing:  # not in the table of its page: segmented here
                table.update(zip(missing, segment(model, missing)))
            ids = list(chain.from_iterable(map(table.__getitem__, words)))
            return ids if end is None else [*ids, end]

        for batch in rows:
            for r, page in enumerate(batch.column(0).to_pylist()):
                if page != current:
                    current, table = page, {}
                if batch.column(2)[r].is_valid:
                    packed, sizes, ids = (batch.column(c)[r].as_py() for c in (2, 3, 4))
                    ends = np.cumsum(np.frombuffer(_unpacked(sizes), np.int32)).tolist()
                    ids = np.frombuffer(_unpacked(ids), np.int32).tolist()
                    words = _unpacked(packed).decode().split("\0")
                    table.update((w, ids[a:b]) for w, a, b in zip(words, [0, *ends], ends))
                    continue
                keys, lens = batch.column(5)[r].as_py(), batch.column(6)[r].as_py()
                data, done, found, decoded = _unpacked(batch.column(7)[r].as_py()), 0, [], []
                for size in lens:
                    ids = encode(data[done : done + size].decode())
                    done += size
                    found.append(np.array(ids, np.int32))
                    decoded.append(sp.decode(ids))
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys, key_type),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found))),
                        pa.array(decoded, pa.string()),
                    ],
                    names=["id", "ids", "decoded"],
                )

    return each


def encode_decode(
    docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", end: bool = True
) -> DataFrame:
    """(id_col, ids array<int>, decoded string): each text as the sentencepiece library encodes it, and decoded back.

    Pieces of the model must not cross word marks other than runs of them (checked when a task starts), so a chunk,
    that is marks and what follows up to the next mark, is segmented alike wherever it stands. Texts are cut into pages
    of about 16 million characters. The distinct chunks of each page go to their group, are segmented there once for all
    pages, and come back with their ids; then each text looks its chunks up in the table of its page and puts
    the ids in order of position. So a word that a third of all texts hold is one entry for each page, and only
    compressed blocks and word lists are shuffled. A chunk that its page's table lacks (which a change of input between the
    two passes over it would need) is segmented in place, so results never depend on how rows are dealt.

    `model` is a path that all executors can read. With `end` the end id follows. NULL and empty texts have
    no ids but the end id and decode to the empty text. Repeated rows, repeated and NULL ids are encoded each by
    itself. An empty table gives no rows. Other columns are not read.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    key = rows.schema["id"].dataType
    key_type = to_arrow_type(key)
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // CHARS_PER_GROUP))
    words = rows.mapInArrow(_word_groups(model, groups), "page long, grp long, words binary")
    words = words.repartition("grp").sortWithinPartitions("grp")
    table = words.mapInArrow(_segment_groups(model), "page long, grp long, words binary, sizes binary, pieces binary")
    block_schema = T.StructType(
        [
            T.StructField("page", T.LongType()),
            T.StructField("ids", T.ArrayType(key)),
            T.StructField("lens", T.ArrayType(T.IntegerType())),
            T.StructField("texts", T.BinaryType()),
        ]
    )
    blocks = rows.mapInArrow(_blocks(key_type), block_schema)
    both = table.unionByName(blocks, allowMissingColumns=True)
    both = both.select("page", "grp", "words", "sizes", "pieces", "ids", "lens", "texts")
    dealt = both.repartition("page").sortWithinPartitions("page", F.col("grp").asc_nulls_last())
    end_id = processor(model).eos_id() if end else None
    schema = T.StructType(
        [T.StructField("id", key), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    )
    out = dealt.mapInArrow(_join_back(model, key_type, end_id), schema)
    return out.withColumnRenamed("id", id_col)
