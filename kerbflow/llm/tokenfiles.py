"""Token ids as Parquet list columns, written in document order and read in part."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

END = 0
ENCODED = ("doc_id long, part int, start_in_part long, n_tokens long, ids array<int>")
#: Row groups and pages are kept small enough for selective reads; ids repeat, so they
#: get a dictionary, and the ascending columns get deltas.
LAYOUT = {
    "parquet.block.size": str(8 << 20),
    "parquet.page.size": str(64 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.writer.version": "v2",
    "parquet.enable.dictionary": "false",
    "parquet.enable.dictionary#ids.list.element": "true",
    "compression": "zstd",
}


#: Letters of the blocks up to Latin Extended-B, which all versions of Unicode agree on.
_LETTERS = re.compile("[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]++(?![^\x00-\u024f])")


class ChunkCache:
    """Ids of stretches of text between two cuts, as little-endian bytes.

    The pre-tokenizer never joins a blank that stands before a non-space to what is
    before it, so a text is encoded stretch by stretch, and a stretch that was met
    before costs a look-up. A new stretch is cut once more, behind its first run of
    letters, where a token always ends; the tokenizers library encodes the words and
    ends that are new of a batch, words in one string (the tokens' lengths tell them apart
    again). At most ``most`` stretches and ``most_parts`` words and ends each are kept; the
    first ones met are the frequent ones. A text with an added token in it is encoded whole.
    """

    def __init__(self, path: str, most: int = 450_000, most_parts: int = 800_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most, self.most_parts = most, most_parts
        self.known, self.words, self.ends = {}, {}, {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)")
        self.bytes_of = np.zeros(self.tokenizer.get_vocab_size() + 1, np.int64)
        for token, k in vocabulary.items():  # one character stands for one byte
            self.bytes_of[k] = len(token)

    def _ids(self, texts: list[str]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<i4").tobytes() for e in encoded]

    def _after_blank(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece with a blank before it."""
        body = self._ids([" " + " ".join(pieces)])[0]
        sizes = np.fromiter((len(p.encode()) + 1 for p in pieces), np.int64, len(pieces))
        lengths = self.bytes_of[np.frombuffer(body, "<i4")]
        cuts = (4 * np.searchsorted(np.cumsum(lengths), np.cumsum(sizes), "right")).tolist()
        return [body[a:b] for a, b in zip([0, *cuts], cuts)]

    def _look_up(self, known: dict[str, bytes], parts: set[str], encode) -> dict[str, bytes]:
        """Ids of ``parts``, kept in ``known`` as long as there is room."""
        new = list(parts.difference(known))
        fresh = dict(zip(new, encode(new))) if new else {}
        if len(known) + len(fresh) <= self.most_parts:
            known.update(fresh)
            return known
        return {p: fresh[p] if p in fresh else known[p] for p in parts}

    def _new(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids of each piece with a blank before it."""
        out, todo, match = {}, [], _LETTERS.match
        word, end = self.words.get, self.ends.get
        for piece in pieces:
            found = match(piece)
            a = found.group() if found else piece
            b = piece[len(a):]
            x, y = word(a), end(b)
            if x is None or y is None:
                todo.append((piece, a, b))
            else:
                out[piece] = x + y
        if todo:
            words = self._look_up(self.words, {a for _, a, _ in todo}, self._after_blank)
            ends = self._look_up(self.ends, {b for _, _, b in todo}, self._ids)
            out.update([(piece, words[a] + ends[b]) for piece, a, b in todo])
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text and the end id."""
        whole = {i for i, t in enumerate(texts) if self.added.search(t)}
        cut = [stretches("" if i in whole else t) for i, t in enumerate(texts)]
        get, missing = self.known.get, set()
        found = [list(map(get, rest)) for _, rest in cut]
        for (_, rest), ids in zip(cut, found):
            if None in ids:
                missing.update([c for c, x in zip(rest, ids) if x is None])
        if missing:
            fresh = self._new(missing)
            if len(self.known) + len(fresh) <= self.most:
                self.known.update(fresh)
            found = [[fresh[c] if x is None else x for c, x in zip(rest, ids)] if None in ids else ids
                     for (_, rest), ids in zip(cut, found)]
        heads = self._look_up(self.ends, {head for head, _ in cut}, self._ids)
        end = np.array([END], "<i4").tobytes()
        return [
            (self._ids([texts[i]])[0] if i in whole else
             heads[head] + b"".join(ids)) + end
            for i, ((head, _), ids) in enumerate(zip(cut, found))
        ]


_ODD = re.compile(r" (?:\s|\Z)")


def stretches(text: str) -> tuple[str, list[str]]:
    """The head of a text, and what follows each blank that stands before something
    other than white space."""
    if not _ODD.search(text):
        head, *rest = text.split(" ")
        return head, rest
    head, *pieces = text.split(" ")
    rest: list[str] = []
    for piece in pieces:
        if piece and not piece[0].isspace():
            rest.append(piece)
        elif rest:
            rest[-1] += " " + piece
        else:
            head += " " + piece
    return head, rest


_caches: dict[str, ChunkCache] = {}


def _cache(path: str) -> ChunkCache:
    if path not in _caches:
        _caches[path] = ChunkCache(path)
    return _caches[path]


def encode_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Documents in ascending doc_id order with their ids; ranges of doc_id make the
    partitions, and places are counted from the start of the partition."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions(
        "doc_id", F.xxhash64("text"), "text"
    ).select("doc_id", F.spark_partition_id().alias("part"), "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, place = _cache(tokenizer), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                ids = cache.encode(some.column(2).to_pylist())
                counts = np.array([len(x) // 4 for x in ids], np.int64)
                ends = place + np.cumsum(counts)
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    some.column(0), some.column(1), pa.array(ends - counts), pa.array(counts),
                    pa.ListArray.from_arrays(
                        pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<i4"))),
                ], names=["doc_id", "part", "start_in_part", "n_tokens", "ids"])
                place = int(ends[-1])

    return ordered.mapInArrow(encode, ENCODED)


def write_tokens(docs: DataFrame, path: str, tokenizer: str) -> None:
    """Token ids of every document, each followed by the end id, as Parquet files.

    A null text is empty and has the end id alone; null doc_ids come first; rows equal
    in doc_id go by their text; other columns are not read; no rows give no tokens.
    """
    encode_documents(docs, tokenizer).write.options(**LAYOUT).parquet(path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ENCODED).parquet(path)


def part_starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, part_start): tokens in all files before, one row for each file; reads one
    short column."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return stored(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start")
    )


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens) without reading any id."""
    rows = stored(spark, path).select("doc_id", "part", "start_in_part", "n_tokens")
    return rows.join(part_starts(spark, path), "part").select(
        "doc_id", (F.col("part_start") + F.col("start_in_part")).alias("start"), "n_tokens"
    )


def read_tokens(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """Ids of the documents from ``first`` to ``last``: the files' statistics and page
    indexes leave the other pages unread."""
    return stored(spark, path).filter(F.col("doc_id").between(first, last)).select("doc_id", "ids")


def checked_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every stored document, from its ids."""
    schema = "doc_id long, part int, start_in_part long, n_tokens long, ids_crc32 long"

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            ends = ids.offsets.to_numpy()
            body = ids.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes()
            sums = [zlib.crc32(body[4 * a : 4 * b]) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), batch.column(2),
                pa.array(np.diff(ends).astype(np.int64)), pa.array(sums, pa.int64()),
            ], names=["doc_id", "part", "start_in_part", "n_tokens", "ids_crc32"])

    rows = stored(spark, path).select("doc_id", "part", "start_in_part", "ids").mapInArrow(check, schema)
    return rows.join(part_starts(spark, path), "part").select(
        "doc_id", (F.col("part_start") + F.col("start_in_part")).alias("start"),
        "n_tokens", "ids_crc32",
    )
