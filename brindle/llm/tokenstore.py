"""Token ids in bit-plane files.

``write`` encodes every whole text, appends the end id, and writes the ids of all
documents in ascending document order into shard files; ``read`` and
``documents`` give them back.

A shard file holds fixed-size blocks of ids (the last one may be shorter). A
block is transposed into byte or bit planes - plane *i* holds byte or bit *i* of
every id - and each plane is compressed by itself with zstandard; planes that are
all zero take no room. Then follow the documents (ids and lengths), the chunk
index (for each block: first id, ids, offset, sizes of the planes), the index's
length, and the format's name::

    "BRNDPLN1" | planes ... | documents | index (JSON, zstandard) | u64 length | "BRNDPLN1"

so any range of ids can be read with two seeks. Files are written under names of
their own by each task attempt and count only once the manifest names them; what
a lost or repeated attempt leaves is never read.

Edge cases: a null or empty text is one end id; a null document id comes first;
equal ids are ordered by a hash of the text and then by the text, so the rows of one
id are dealt to several tasks; an empty table writes no file.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut_at_blanks, filesystem, mix64, small_batches, stored, work_dir

MAGIC = b"BRNDPLN1"
BLOCK_IDS = 1 << 16
#: A task begins another file after this many ids.
SHARD_IDS = 1 << 26
#: Pieces of text whose ids a worker keeps; those of one batch may come on top.
CACHE_WORDS = 1 << 20
#: Bytes of longer pieces that a worker keeps with their ids.
CACHE_LONG_BYTES = 8 << 20
#: Text that is cut into pieces at once, and pieces that are looked up at once, which bounds memory.
BATCH_BYTES = 1 << 20
PIECES = 1 << 17


# ------------------------------------------------------------------ encoding


def _kind(byte: int) -> int:
    """0 blank, 1 ASCII letter, 2 apostrophe, 3 other ASCII, 4 beyond ASCII."""
    if byte in b"\x20\x09\x0a\x0b\x0c\x0d":
        return 0
    return 4 if byte > 127 else 1 if chr(byte).isalpha() else 2 if byte == 39 else 3


_KINDS = bytes(map(_kind, range(256)))
#: Kinds side by side, as 8 * left + right, that are always cut: a letter and what is
#: none, but not behind an apostrophe ('s is one piece).
_CUTS = {8 + 2, 8 + 3, 24 + 1}


def _edges(cuts: set[int]) -> tuple[bytes, bytes]:
    """For pairs of kinds: whether a piece begins, or ends, between them."""
    begins = bytes(bool(p & 7 and (not p >> 3 or p in cuts)) for p in range(256))
    return begins, bytes(bool(p >> 3 and (not p & 7 or p in cuts)) for p in range(256))


_WORD_EDGES, _PIECE_EDGES = _edges(set()), _edges(_CUTS)
#: The lowest bytes of a long, by their number.
_LOW = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
#: Longer pieces are kept by themselves.
SHORT = 15


def _each_byte(value: int) -> np.uint64:
    return np.uint64(value * 0x0101010101010101)


def _lower(x: np.ndarray) -> np.ndarray:
    """Longs of eight ASCII characters with A-Z lower-cased."""
    return x | (((x + _each_byte(128 - 65)) & ~(x + _each_byte(128 - 91)) & _each_byte(128)) >> np.uint64(2))


class IdTable:
    """Ids by key: two longs that hold a piece's bytes and length, so that none is mistaken for another.

    Open addressing in arrays, some 60 bytes a piece.
    """

    def __init__(self):
        self.n = self.n_ids = 0
        self.slots = np.full(1 << 12, -1, np.int32)
        self.first, self.second = np.empty(0, np.uint64), np.empty(0, np.uint64)
        self.start, self.count = np.empty(0, np.int64), np.empty(0, np.int32)
        self.again = np.empty(0, bool)
        self.ids = np.empty(0, "<u4")

    def _home(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        return (mix64(first ^ (second * np.uint64(0x9E3779B97F4A7C15))) & np.uint64(len(self.slots) - 1)).astype(np.int64)

    def find(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The numbers of the keys' entries, -1 for those that are not there."""
        if not self.n:
            return np.full(len(first), -1, np.int32)
        at = self._home(first, second)
        entry = self.slots[at]
        left = np.flatnonzero((entry >= 0) & ((self.first[entry] != first) | (self.second[entry] != second)))
        at = at[left]
        while len(left):
            at = (at + 1) & (len(self.slots) - 1)
            entry[left] = e = self.slots[at]
            on = (e >= 0) & ((self.first[e] != first[left]) | (self.second[e] != second[left]))
            left, at = left[on], at[on]
        return entry

    def room(self, n_ids: int) -> np.ndarray:
        """The ids, with space behind those in use."""
        if self.n_ids + n_ids > len(self.ids):
            self.ids = np.append(self.ids[: self.n_ids], np.empty((self.n_ids + n_ids) // 4 + n_ids, "<u4"))
        return self.ids

    def add(self, first: np.ndarray, second: np.ndarray, ids: list[bytes]) -> None:
        """Different keys that are not there yet, with their ids."""
        n = self.n + len(first)
        if n > len(self.first):
            more = n + n // 4 - self.n
            for name in ("first", "second", "start", "count", "again"):
                old = getattr(self, name)[: self.n]
                setattr(self, name, np.append(old, np.zeros(more, old.dtype)))
        count = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        total = int(count.sum())
        self.room(total)[self.n_ids : self.n_ids + total] = np.frombuffer(b"".join(ids), "<u4")
        self.first[self.n : n], self.second[self.n : n], self.count[self.n : n] = first, second, count
        self.start[self.n : n] = self.n_ids + np.cumsum(count) - count
        self.again[self.n : n] = False
        begin, self.n, self.n_ids = self.n, n, self.n_ids + total
        if 2 * n > len(self.slots):
            self.slots = np.full(1 << (2 * n).bit_length(), -1, np.int32)
            begin = 0
        self._place(begin)

    def _place(self, begin: int) -> None:
        left = np.arange(begin, self.n, dtype=np.int32)
        at = self._home(self.first[begin : self.n], self.second[begin : self.n])
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]  # of several one stays
            on = self.slots[at] != left
            left, at = left[on], (at[on] + 1) & (len(self.slots) - 1)

    def forget(self, most: int) -> None:
        """Keep entries that were met again since the last time, *most* at most."""
        kept = np.flatnonzero(self.again[: self.n])[:most]
        ids = [self.ids[a : a + n].tobytes() for a, n in zip(self.start[kept].tolist(), self.count[kept].tolist(), strict=True)]
        first, second = self.first[kept], self.second[kept]
        self.n = self.n_ids = 0
        self.slots[:] = -1
        self.add(first, second, ids)


class WordEncoder:
    """Encodes texts with the tokenizers library, each different piece once while it is kept.

    For tokenizers whose normaliser and pre-tokeniser act within words and drop
    white space (as ``word_bpe_49k.json``): the ids of a text are then the ids of
    its words, one after the other. Others are refused. With that file's own
    normaliser and pre-tokeniser, words are cut further between an ASCII letter
    and another ASCII character, where each of them cuts, and pieces of ASCII
    alone are kept in lower case; not in a batch that holds an added token, in
    whatever case, which is found before them.
    """

    PROBES = ("ab cd", " ab\t cd. Ef\n", "a,b 12 don't", "É x")
    NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
    PIECES = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
    PRE_TOKENIZER = {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": PIECES}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    }

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.bytes = np.zeros(len(self.ends_word), np.int64)
        for t, i in vocabulary.items():
            self.bytes[i] = len(t.removesuffix("</w>"))  # a character of a token is a byte
        for text in self.PROBES:
            parts = [self.tokenizer.encode(w, add_special_tokens=False).ids for w in text.split()]
            if self.tokenizer.encode(text, add_special_tokens=False).ids != [i for ids in parts for i in ids]:
                raise ValueError(f"{path}: the ids of a text are not those of its words")
        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        added = made.get("added_tokens") or []
        self.added = [t["content"].encode().lower() for t in added]
        self.cuts = made.get("normalizer") == self.NORMALIZER and made.get("pre_tokenizer") == self.PRE_TOKENIZER and not any(t["normalized"] for t in added)
        self.table = IdTable()
        self.long: dict[bytes, bytes] = {}
        self.long_bytes = 0

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        out, held, size = [], [], 0
        for text in [t.encode("utf-8", "surrogatepass") for t in texts]:
            if held and size + len(text) > BATCH_BYTES:
                out += self._encode(held)
                held, size = [], 0
            if len(text) > BATCH_BYTES:
                out.append(np.concatenate([self._encode([piece])[0] for piece in cut_at_blanks(text)]))
            else:
                held.append(text)
                size += len(text)
        return out + self._encode(held) if held else out

    def _encode(self, texts: list[bytes]) -> list[np.ndarray]:
        joined = b"\n" + b"\n".join(texts) + b"\n" * 17  # a long can be read from each piece's ninth byte on
        low = joined.lower()
        cuts = self.cuts and not any(t in low for t in self.added)
        kinds = np.frombuffer(joined.translate(_KINDS), np.uint8)
        sides = (kinds[:-1] * np.uint8(8) + kinds[1:]).tobytes()
        begins, ends = (np.flatnonzero(np.frombuffer(sides.translate(t), bool)) + 1 for t in (_PIECE_EDGES if cuts else _WORD_EDGES))
        if not len(begins):
            return [np.empty(0, "<u4")] * len(texts)
        parts = [self._ids(joined, begins[i : i + PIECES], ends[i : i + PIECES], cuts) for i in range(0, len(begins), PIECES)]
        upto = np.append(0, np.cumsum(np.concatenate([each for _, each in parts])))
        bounds = np.cumsum([len(t) + 1 for t in texts[:-1]]) + 1
        return np.split(np.concatenate([ids for ids, _ in parts]), upto[np.searchsorted(begins, bounds)])

    def _ids(self, joined: bytes, begins: np.ndarray, ends: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces, and the number of each one's."""
        table, sizes = self.table, ends - begins
        if table.n > CACHE_WORDS:
            table.forget(CACHE_WORDS // 2)
        start, each = np.empty(len(begins), np.int64), np.empty(len(begins), np.int64)
        short, long = np.flatnonzero(sizes <= SHORT), np.flatnonzero(sizes > SHORT)
        start[short], each[short] = self._short(joined, begins[short], sizes[short], fold)
        if len(long):
            found = self._long([joined[a:b] for a, b in zip(begins[long].tolist(), ends[long].tolist(), strict=True)])
            each[long] = n = np.fromiter(map(len, found), np.int64, len(found)) // 4
            upto = table.n_ids + np.cumsum(n)  # behind the kept ids, for now
            start[long] = upto - n
            table.room(int(n.sum()))[table.n_ids : upto[-1]] = np.frombuffer(b"".join(found), "<u4")
        upto = np.cumsum(each)
        return table.ids[np.arange(upto[-1]) + np.repeat(start - (upto - each), each)], each

    def _short(self, joined: bytes, begins: np.ndarray, sizes: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray]:
        """Where in the table's ids those of the pieces are, and how many."""
        longs = np.ndarray(len(joined) - 7, "<u8", joined, strides=(1,))
        first = longs[begins] & _LOW[np.minimum(sizes, 8)]
        second = np.zeros(len(begins), np.uint64)
        more = np.flatnonzero(sizes > 8)
        second[more] = longs[begins[more] + 8] & _LOW[sizes[more] - 8]
        if fold:
            ascii_only = (first | second) & _each_byte(128) == 0
            first, second = np.where(ascii_only, _lower(first), first), np.where(ascii_only, _lower(second), second)
        second |= sizes.astype(np.uint64) << np.uint64(56)
        entry = self.table.find(first, second)
        known = entry >= 0
        self.table.again[entry[known]] = True
        missing = np.flatnonzero(~known)
        if len(missing):
            order = missing[np.lexsort((second[missing], first[missing]))]
            a, b = first[order], second[order]
            new = order[np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))]
            words = [joined[x : x + n] for x, n in zip(begins[new].tolist(), sizes[new].tolist(), strict=True)]
            self.table.add(first[new], second[new], self._learn(words))
            entry[missing] = self.table.find(first[missing], second[missing])
        return self.table.start[entry], self.table.count[entry].astype(np.int64)

    def _long(self, words: list[bytes]) -> list[bytes]:
        if self.long_bytes > CACHE_LONG_BYTES:
            self.long, self.long_bytes = {}, 0
        missing = [w for w in dict.fromkeys(words) if w not in self.long]
        self.long |= zip(missing, found := self._learn(missing), strict=True)
        self.long_bytes += sum(map(len, missing)) + sum(map(len, found)) + 200 * len(missing)
        return list(map(self.long.__getitem__, words))

    def _learn(self, words: list[bytes]) -> list[bytes]:
        """The ids of words: those of letters, with a mark behind or not, many in one text,
        which is cut where ids end words; all others, texts whose cuts don't add up, and
        words whose ids don't stand for as many bytes, word by word."""
        found = [b""] * len(words)
        texts = [w.decode("utf-8", "surrogatepass") for w in words]
        ends = [1 if t.isalpha() else 2 if t[-1] in ".,;:!?" and t[:-1].isalpha() else 0 for t in texts]
        plain = [i for i, n in enumerate(ends) if n]
        single = [i for i, n in enumerate(ends) if not n]
        chunks = [plain[i : i + 2000] for i in range(0, len(plain), 2000)]
        for chunk, e in zip(chunks, self.tokenizer.encode_batch_fast([" ".join([texts[i] for i in c]) for c in chunks], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            stops = np.flatnonzero(self.ends_word[ids]) + 1
            upto = np.cumsum([ends[i] for i in chunk])
            if len(stops) != upto[-1]:
                single += chunk
                continue
            cut = stops[upto - 1]
            sizes = np.diff(np.append(0, np.cumsum(self.bytes[ids])[cut - 1]))
            cuts, raw, at = (cut * 4).tolist(), ids.tobytes(), 0
            for i, cut, n in zip(chunk, cuts, sizes.tolist(), strict=True):
                if n == len(words[i]):
                    found[i] = raw[at:cut]
                else:
                    single.append(i)
                at = cut
        for begin in range(0, len(single), 4096):
            part = single[begin : begin + 4096]
            for i, e in zip(part, self.tokenizer.encode_batch_fast([texts[i] for i in part], add_special_tokens=False), strict=True):
                found[i] = np.array(e.ids, "<u4").tobytes()
        return found


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


# ------------------------------------------------------------------ the format


def to_planes(ids: np.ndarray, unit: str) -> list[bytes]:
    """The planes of a block, least significant first, up to the highest in use."""
    top = int(ids.max(initial=0)).bit_length()
    if unit == "byte":
        rows = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
        return [rows[:, i].tobytes() for i in range((top + 7) // 8)]
    return [np.packbits((ids >> np.uint32(i)).astype(np.uint8) & 1).tobytes() for i in range(top)]


def from_planes(planes: list[bytes], n: int, unit: str) -> np.ndarray:
    ids = np.zeros(n, np.uint32)
    for i, plane in enumerate(planes):
        raw = np.frombuffer(plane, np.uint8)
        if unit == "byte":
            ids |= raw.astype(np.uint32) << np.uint32(8 * i)
        else:
            ids |= np.unpackbits(raw, count=n).astype(np.uint32) << np.uint32(i)
    return ids


class ShardWriter:
    def __init__(self, folder: str, unit: str = "byte", level: int = 3):
        self.fs, base = filesystem(folder)
        self.fs.create_dir(base, recursive=True)
        self.name = f"shard-{uuid.uuid4().hex}.planes"
        self.out = self.fs.open_output_stream(f"{base}/{self.name}")
        self.unit, self.zip = unit, zstandard.ZstdCompressor(level=level)
        self.at = self.out.write(MAGIC)
        self.index: list[list] = []
        self.docs: list[tuple[int | None, int]] = []
        self.parts: list[np.ndarray] = []
        self.waiting = self.n_ids = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        self.parts.append(ids)
        self.waiting += len(ids)
        if self.waiting >= BLOCK_IDS:
            ids = np.concatenate(self.parts)
            whole = len(ids) // BLOCK_IDS * BLOCK_IDS
            for i in range(0, whole, BLOCK_IDS):
                self._block(ids[i : i + BLOCK_IDS])
            self.parts, self.waiting = [ids[whole:]], len(ids) - whole

    def _put(self, data: bytes) -> int:
        self.out.write(data)
        self.at += len(data)
        return len(data)

    def _block(self, ids: np.ndarray) -> None:
        start, sizes = self.at, []
        for plane in to_planes(ids, self.unit):
            sizes.append(self._put(self.zip.compress(plane)))
        self.index.append([self.n_ids, len(ids), start, sizes])
        self.n_ids += len(ids)

    def close(self) -> dict:
        if self.waiting:
            self._block(np.concatenate(self.parts))
        null = np.array([d is None for d, _ in self.docs])
        table = np.array([0 if d is None else d for d, _ in self.docs], "<i8").tobytes() + np.array([n for _, n in self.docs], "<i8").tobytes() + null.astype(np.uint8).tobytes()
        docs = [self.at, self._put(self.zip.compress(table)), len(self.docs)]
        foot = self.zip.compress(json.dumps({"unit": self.unit, "n_ids": self.n_ids, "documents": docs, "blocks": self.index}).encode())
        self._put(foot)
        self._put(struct.pack("<Q", len(foot)) + MAGIC)
        self.out.close()
        return {"name": self.name, "n_docs": len(self.docs), "n_ids": self.n_ids, "bytes": self.at}


class ShardReader:
    def __init__(self, folder: str, name: str):
        fs, base = filesystem(folder)
        self.file = fs.open_input_file(f"{base}/{name}")
        self.unzip = zstandard.ZstdDecompressor()
        size = self.file.size()
        length, magic = struct.unpack("<Q8s", self._at(size - 16, 16))
        if magic != MAGIC or self._at(0, 8) != MAGIC:
            raise ValueError(f"{name} is not a bit-plane file")
        foot = json.loads(self.unzip.decompress(self._at(size - 16 - length, length)))
        self.unit, self.n_ids, self.blocks, self._docs = foot["unit"], foot["n_ids"], foot["blocks"], foot["documents"]

    def _at(self, offset: int, length: int) -> bytes:
        return self.file.read_at(length, offset)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids from *start* to *stop*; reads the blocks that hold them, no others."""
        found = [np.empty(0, np.uint32)]
        for first, n, offset, sizes in self.blocks[start // BLOCK_IDS : -(-stop // BLOCK_IDS)]:
            raw, planes = self._at(offset, sum(sizes)), []
            for size in sizes:
                planes.append(self.unzip.decompress(raw[:size]))
                raw = raw[size:]
            block = from_planes(planes, n, self.unit)
            found.append(block[max(0, start - first) : stop - first])
        return np.concatenate(found)

    def documents(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document ids, numbers of ids, and which document ids are null."""
        offset, size, n = self._docs
        raw = self.unzip.decompress(self._at(offset, size))
        return np.frombuffer(raw, "<i8", n), np.frombuffer(raw, "<i8", n, 8 * n), np.frombuffer(raw, np.uint8, n, 16 * n).astype(bool)

    def close(self) -> None:
        self.file.close()


# ------------------------------------------------------------------ on Spark


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int, unit: str = "byte", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Encode *docs* into shard files in *folder*; returns the manifest.

    The manifest has a row per file, in document order by ``shard``: name,
    n_docs, n_ids, bytes, and start, the number of ids in all files before it.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, writer, made = TaskContext.get().partitionId(), None, []
        for batch in batches:
            for begin in range(0, len(batch), 1024):
                part = batch.iloc[begin : begin + 1024]
                for doc_id, none, ids in zip(part["id"].tolist(), part["none"].tolist(), encoder(tokenizer).encode(part["text"].tolist()), strict=True):
                    writer = writer or ShardWriter(folder, unit)
                    writer.add(None if none else doc_id, np.append(ids, np.uint32(end_id)))
                    if writer.n_ids >= SHARD_IDS:
                        made.append(writer.close())
                        writer = None
        if writer:
            made.append(writer.close())
        if made:
            yield pd.DataFrame(made).assign(shard=[(task << 24) + i for i in range(len(made))])

    key = docs[id_col].cast("long")
    rows = docs.select(key.isNull().alias("none"), F.coalesce(key, F.lit(-(1 << 63))).alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    order = [F.col("id"), F.desc("none"), F.xxhash64("text")]  # a null id is the least of all longs
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    manifest = ordered.mapInPandas(run, "name string, n_docs long, n_ids long, bytes long, shard long")
    with small_batches(docs.sparkSession):
        manifest = stored(manifest, f"{work_dir(docs.sparkSession)}/manifest")
    return manifest.withColumn("start", _running_start())


def _running_start() -> Column:
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("n_ids").over(before), F.lit(0))


def documents(manifest: DataFrame, folder: str) -> DataFrame:
    """Read the files back: per document its id, start, n_tokens and crc32 of its ids."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard in batch.itertuples():
                reader = ShardReader(folder, shard.name)
                doc_ids, lengths, null = reader.documents()
                bounds = np.concatenate([[0], np.cumsum(lengths)])
                at = 0
                while at < len(lengths):  # some blocks at a time
                    upto = max(at + 1, int(np.searchsorted(bounds, bounds[at] + 16 * BLOCK_IDS, "right")) - 1)
                    ids = reader.ids(int(bounds[at]), int(bounds[upto])).astype("<u4")
                    cuts = bounds[at : upto + 1] - bounds[at]
                    crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                    found = pd.Series(doc_ids[at:upto]).astype("Int64")
                    found[null[at:upto]] = pd.NA
                    yield pd.DataFrame({"doc_id": found, "start": shard.start + bounds[at:upto], "n_tokens": lengths[at:upto], "ids_crc32": crc})
                    at = upto
                reader.close()

    files = manifest.select("name", "start", "shard")
    files = files.repartition(max(1, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "shard")
    return files.mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """Read the files back: per document its id and its ids."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name in batch["name"]:
                reader = ShardReader(folder, name)
                doc_ids, lengths, null = reader.documents()
                at = 0
                for doc_id, n, none in zip(doc_ids, lengths, null, strict=True):
                    yield pd.DataFrame({"doc_id": pd.array([None if none else doc_id], "Int64"), "ids": [reader.ids(at, at + n).astype(np.int64)]})
                    at += n
                reader.close()

    return manifest.select("name").mapInPandas(run, "doc_id long, ids array<long>")


def new_folder(spark: SparkSession) -> str:
    """A folder for shard files, which stay: they are what the caller wants."""
    return f"{work_dir(spark, keep=True)}/tokens"
