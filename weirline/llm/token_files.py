"""Token ids in binary files: Simple-8b words, with block offsets and a table of documents.

A file is a sequence of little-endian 64-bit words, in three sections:

* packed ids: each word has a 4-bit selector in its top bits and as many ids of
  equal width as fit in the other 60 (``SELECTORS``); selector 15 is an escape, the
  next word is one id as it stands. Ids are packed in blocks of ``BLOCK`` ids, which
  start at a word of their own and can be decoded alone, all words of a selector
  at a time;
* the word at which each block starts, then for each document its id, whether the id
  is null, and its number of ids;
* a trailer: blocks, documents, ids, ids per block, first word of the second
  section, magic number.

Documents are dealt out by ranges of their id, so that files in order hold documents
in ascending order; a text's hash splits even one id that a third of all rows share.
Tasks write files of at most ``file_ids`` ids below the shared folder, under names
of their own; the manifest, a table that Spark commits, lists those of tasks that
succeeded. Only the manifest is ordered in one place: one row for each file.

Defined cases: a null text is empty and has only the end id; null document ids come
first; repeated rows are written each; equal ids are in the order of their texts'
hash; an empty table gives no files and no rows; a text may span any number of
blocks; other columns are neither read nor written.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weirline.scratch import new_workspace
from weirline.sources import file_access

from .common import CHUNK_BYTES, kept, materialise, spread, table, text_chunks, utf8

BLOCK = 16384
FILE_IDS = 1 << 26
END_ID = 2

#: Ids a word and bits an id, by selector.
SELECTORS = (
    (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7),
    (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60),
)
ESCAPE = 15
MAGIC = 0x3142_3853_4C57_0001
_TRAILER = 6
_WORD = np.dtype("<u8")
_SHIFT = np.uint64(60)


def _bits(ids: np.ndarray) -> np.ndarray:
    """Bits of each id; may be one too many from 2**53 on, which costs space only."""
    return np.maximum(np.frexp(ids.astype(np.float64))[1], 1).astype(np.uint8)


def pack_block(ids: np.ndarray) -> np.ndarray:
    """The words of one block. Beyond its end stand zeros, which the decoder cuts off."""
    n = len(ids)
    padded = np.zeros(n + 60, np.uint64)
    padded[:n] = ids
    bits = np.ones(n + 60, np.uint8)
    bits[:n] = _bits(padded[:n])
    # Widest id among the next 1, 2, 4, … ids; two such runs cover any count.
    widest = {1: bits}
    for size in (2, 4, 8, 16, 32):
        half = widest[size // 2]
        widest[size] = half.copy()
        widest[size][: -(size // 2)] = np.maximum(half[: -(size // 2)], half[size // 2 :])
    code = np.full(n, ESCAPE, np.uint8)
    for selector in range(len(SELECTORS) - 1, -1, -1):
        count, width = SELECTORS[selector]
        size = 1 << (count.bit_length() - 1)
        run = np.maximum(widest[size][:n], widest[size][count - size : count - size + n])
        code[run <= width] = selector
    steps = np.array([c for c, _ in SELECTORS] + [0, 1], np.uint8)[code].tobytes()
    heads, at = [], 0
    while at < n:
        heads.append(at)
        at += steps[at]
    head = np.array(heads, np.int64)
    code = code[head]
    place = np.arange(len(head)) + np.concatenate([[0], np.cumsum(code == ESCAPE)[:-1]]) if len(head) else head
    words = np.zeros(len(head) + int((code == ESCAPE).sum()), np.uint64)
    words[place] = code.astype(np.uint64) << _SHIFT
    for selector, (count, width) in enumerate(SELECTORS):
        mine = np.flatnonzero(code == selector)
        if len(mine):
            values = padded[head[mine][:, None] + np.arange(count)]
            words[place[mine]] |= np.bitwise_or.reduce(values << (np.arange(count) * width).astype(np.uint64), axis=1)
    raw = code == ESCAPE
    words[place[raw] + 1] = padded[head[raw]]
    return words


def unpack_block(words: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids of a block."""
    selector = (words >> _SHIFT).astype(np.int64)
    own = np.ones(len(words), bool)
    if (selector == ESCAPE).any():  # a raw word may look like anything
        at = 0
        while at < len(words):
            if selector[at] == ESCAPE:
                own[at + 1] = False
                at += 1
            at += 1
    place = np.flatnonzero(own)
    selector = selector[place]
    counts = np.array([c for c, _ in SELECTORS] + [0, 1])[selector]
    first = np.concatenate([[0], np.cumsum(counts)])
    ids = np.zeros(int(first[-1]), np.uint64)
    for s, (count, width) in enumerate(SELECTORS):
        mine = np.flatnonzero(selector == s)
        if len(mine):
            steps = np.arange(count)
            values = words[place[mine]][:, None] >> (steps * width).astype(np.uint64)
            ids[first[mine][:, None] + steps] = values & np.uint64((1 << width) - 1)
    raw = np.flatnonzero(selector == ESCAPE)
    ids[first[raw]] = words[place[raw] + 1]
    return ids[:n]


class FileWriter:
    """Writes one file; documents one after the other."""

    def __init__(self, stream) -> None:
        self.stream = stream
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.n_ids = self.n_words = 0
        self.blocks: list[int] = []
        self.documents: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []
        self._put(np.array([MAGIC], np.uint64))

    def _put(self, words: np.ndarray) -> None:
        self.stream.write(np.ascontiguousarray(words, _WORD).tobytes())
        self.n_words += len(words)

    def add(self, doc_ids: pa.Array, lengths: np.ndarray, ids: np.ndarray) -> None:
        missing = np.asarray(doc_ids.is_null()).astype(np.uint64)
        numbers = np.asarray(doc_ids.cast(pa.int64()).fill_null(0)).astype(np.int64)
        self.documents.append(np.stack([numbers.view(np.uint64), missing, lengths.astype(np.uint64)], axis=1))
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        self.n_ids += len(ids)
        if self.n_waiting >= BLOCK:
            self._pack(False)

    def _pack(self, last: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint64)
        stop = len(ids) if last else len(ids) - len(ids) % BLOCK
        for start in range(0, stop, BLOCK):
            self.blocks.append(self.n_words)
            self._put(pack_block(ids[start : min(start + BLOCK, stop)]))
        self.waiting = [ids[stop:]]
        self.n_waiting = len(ids) - stop

    def close(self) -> tuple[int, int]:
        """Documents and ids in the file."""
        self._pack(True)
        footer = self.n_words
        documents = np.concatenate(self.documents) if self.documents else np.zeros((0, 3), np.uint64)
        self._put(np.array(self.blocks, np.uint64))
        self._put(documents.T.ravel())
        self._put(np.array([len(self.blocks), len(documents), self.n_ids, BLOCK, footer, MAGIC], np.uint64))
        self.stream.close()
        return len(documents), self.n_ids


class FileReader:
    """Random access to one file."""

    def __init__(self, path: str, located: Callable | None = None) -> None:
        system, name = (located or pa.fs.FileSystem.from_uri)(path)
        self.file = system.open_input_file(name)
        size = self.file.size() // 8
        trailer = self._words(size - _TRAILER, size)
        if trailer[-1] != MAGIC or self._words(0, 1)[0] != MAGIC:
            raise ValueError(f"{path} is not a token file")
        n_blocks, n_docs, self.n_ids, self.block, footer = (int(x) for x in trailer[:5])
        section = self._words(footer, size - _TRAILER)
        self.starts = np.append(section[:n_blocks].astype(np.int64), footer)
        columns = section[n_blocks:].reshape(3, n_docs)
        self.doc_ids = pa.array(columns[0].view(np.int64), mask=columns[1] != 0)
        self.lengths = columns[2].astype(np.int64)

    def _words(self, start: int, stop: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at((stop - start) * 8, start * 8), _WORD)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids from ``start`` to before ``stop``, reading only the blocks that hold them."""
        if start >= stop:
            return np.zeros(0, np.uint64)
        first, last = start // self.block, (stop - 1) // self.block
        words = self._words(int(self.starts[first]), int(self.starts[last + 1]))
        at = self.starts[first : last + 2] - self.starts[first]
        parts = [
            unpack_block(words[at[k] : at[k + 1]], min(self.block, self.n_ids - (first + k) * self.block))
            for k in range(last - first + 1)
        ]
        return np.concatenate(parts)[start - first * self.block : stop - first * self.block]


#: Words that a worker remembers the ids of.
_REMEMBERED = 400_000
#: Stands after each of the words that are encoded together; words that hold it are encoded alone.
_BETWEEN = "\x00"
#: Begins the special tokens; texts that hold it are not cut within words.
_SPECIAL = b"<|"

_KIND = np.zeros(256, np.uint8)
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
_KIND[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) != "'"]] = 2
_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def _loosened(texts: pa.Array) -> pa.Array:
    """Texts in lower ASCII case, with a space where ASCII letters meet punctuation other than an apostrophe."""
    offsets, data = utf8(texts)
    if _SPECIAL in data.tobytes():
        return texts.cast(pa.string()).fill_null("")
    kind = _KIND[data]
    meets = np.zeros(len(data), bool)
    meets[1:] = kind[1:] + kind[:-1] == 3
    meets[1:] &= kind[1:] != 0
    meets[1:] &= kind[:-1] != 0
    moved = np.cumsum(meets)
    wide = np.full(len(data) + int(meets.sum()), 0x20, np.uint8)
    wide[np.arange(len(data)) + moved] = np.frombuffer(data.tobytes().translate(_LOWER), np.uint8)
    ends = (offsets + np.concatenate([[0], moved])[offsets]).astype(np.int32)
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(ends), pa.py_buffer(wide))


class WordEncoder:
    """Ids of texts, for a tokenizer that lowers case and to which white space only separates.

    It must also part letters from punctuation, except at apostrophes. Words are then
    encoded each for itself, in lower case and without the punctuation at their ends,
    and one that comes again costs a look-up. The memory is emptied when full.
    """

    def __init__(self, path: str, end_id: int) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end_id = end_id
        between = self._encode([_BETWEEN])
        if len(between) != 1:
            raise ValueError("this tokenizer has no id of its own for the separator")
        self.between = between[0]
        self._forget()

    def _forget(self) -> None:
        self.slots: dict[str, int] = {"": 1}
        self.pool = np.array([self.end_id], np.uint32)
        self.first, self.size = np.array([0, 1]), np.array([1, 0])

    def _encode(self, texts: list[str]) -> np.ndarray:
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return np.concatenate([np.array(e.ids, np.uint32) for e in encoded]) if encoded else np.zeros(0, np.uint32)

    def _remember(self, words: list[str]) -> None:
        plain = [w for w in words if _BETWEEN not in w]
        ids = self._encode([f" {_BETWEEN} ".join([*plain[i : i + 512], ""]) for i in range(0, len(plain), 512)])
        cuts = np.flatnonzero(ids == self.between)
        sizes = [np.diff(cuts, prepend=-1) - 1]
        pools = [self.pool, ids[ids != self.between]]
        odd = [w for w in words if _BETWEEN in w]
        for word in odd:
            pools.append(self._encode([word]))
            sizes.append(np.array([len(pools[-1])]))
        size = np.concatenate(sizes)
        self.slots.update(zip([*plain, *odd], range(len(self.first), len(self.first) + len(size))))
        self.first = np.append(self.first, len(self.pool) + np.cumsum(size) - size)
        self.size = np.append(self.size, size)
        self.pool = np.concatenate(pools)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each text with the end id: how many, and all in order."""
        if len(self.slots) > _REMEMBERED:
            self._forget()
        split = pc.ascii_split_whitespace(_loosened(texts))
        offsets = np.asarray(split.offsets) - split.offsets[0].as_py()
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        self._remember([w for w in words if w not in self.slots])
        slot = np.array([self.slots[w] for w in words], np.int64)
        used = np.insert(slot[np.asarray(coded.indices)], offsets[1:], 0)
        size = self.size[used]
        ends = offsets[1:] + np.arange(1, len(texts) + 1)
        total = np.concatenate([[0], np.cumsum(size)])
        return np.diff(np.concatenate([[0], total[ends]])), self.pool[spread(self.first[used], size)]


class TextEncoder:
    """Ids of texts, for any tokenizer of the library."""

    def __init__(self, path: str, end_id: int) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end_id = end_id

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        encoded = self.tokenizer.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)
        ids = [np.array([*e.ids, self.end_id], np.uint32) for e in encoded]
        return np.array([len(i) for i in ids]), np.concatenate(ids)


def _encoder(path: str, end_id: int, by_word: bool) -> Callable:
    key = ("encoder", path, end_id, by_word)
    if key not in kept():
        kept()[key] = (WordEncoder if by_word else TextEncoder)(path, end_id)
    return kept()[key]


def write_ids(
    docs: DataFrame,
    tokenizer: str,
    folder: str | None = None,
    end_id: int = END_ID,
    by_word: bool = True,
    doc_id: str = "doc_id",
    text: str = "text",
    file_ids: int = FILE_IDS,
) -> DataFrame:
    """Encode texts into files in ascending order of document; returns the manifest.

    The manifest has a row for each file: place in the order (``part``, ``file``),
    ``path``, ``n_docs``, ``n_ids`` and ``start``, the ids of all files before it.
    ``by_word`` is for tokenizers as :class:`WordEncoder` describes.
    """
    spark = docs.sparkSession
    folder = folder or new_workspace(spark, "llm-tokens")
    located = file_access()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = _encoder(tokenizer, end_id, by_word)
        system, base = located(folder)
        system.create_dir(base, recursive=True)
        part, rows = TaskContext.get().partitionId(), []
        open_file: FileWriter | None = None

        def finish() -> None:
            rows.append((part, len(rows), f"{folder}/{name}", *open_file.close()))

        # A text has no more ids than bytes, but for its end id.
        for batch in text_chunks(batches, "text", min(2 * CHUNK_BYTES, file_ids)):
            lengths, ids = encode(batch["text"])
            if open_file and open_file.n_ids + len(ids) > file_ids:
                finish()
                open_file = None
            if open_file is None:
                name = f"part-{part:06d}-{len(rows):04d}-{uuid.uuid4().hex}.ids"
                open_file = FileWriter(system.open_output_stream(f"{base}/{name}"))
            open_file.add(batch["doc_id"], lengths, ids)
        if open_file:
            finish()
        columns = list(zip(*rows)) or [[]] * 5
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], names=["part", "file", "path", "n_docs", "n_ids"]
        )

    ordered = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    tie = F.xxhash64("text")
    ordered = ordered.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    files = ordered.mapInArrow(write, "part int, file int, path string, n_docs bigint, n_ids bigint")
    files = materialise(files, "manifest")
    before = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


#: Ids that a reading task holds at a time, unless one document alone has more.
_READ_IDS = 1 << 22


def read_ids(manifest: DataFrame) -> DataFrame:
    """A row for each document of the files: doc_id, start, n_tokens, ids_crc32, path and place in the file."""
    located = file_access()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch["path"].to_pylist(), batch["start"].to_pylist()):
                file = FileReader(path, located)
                ends = np.cumsum(file.lengths)
                at = 0
                while at < len(ends):
                    base = int(ends[at - 1]) if at else 0
                    stop = max(at + 1, int(np.searchsorted(ends, base + _READ_IDS, side="right")))
                    ids = file.ids(base, int(ends[stop - 1])).astype("<u4")
                    local = np.concatenate([[0], ends[at:stop] - base])
                    sums = [zlib.crc32(ids[a:b].data) for a, b in zip(local[:-1].tolist(), local[1:].tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [
                            file.doc_ids.slice(at, stop - at),
                            pa.array(local[:-1] + base + start),
                            pa.array(file.lengths[at:stop]),
                            pa.array(sums, pa.int64()),
                            pa.array([path] * (stop - at), pa.string()),
                            pa.array(local[:-1] + base),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids_crc32", "path", "place"],
                    )
                    at = stop

    n_files = max(1, manifest.count())
    dealt = manifest.select("path", "start").repartition(min(n_files, 10_000), "path")
    return dealt.mapInArrow(
        read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, path string, place bigint"
    )


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op5: each document's place among all ids, as read back from the files."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    manifest = write_ids(docs, public_tokenizers.path("word_bpe_49k.json"))
    return read_ids(manifest).select("doc_id", "start", "n_tokens", "ids_crc32")
