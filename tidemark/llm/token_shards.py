"""Token ids in raw files, with a minimal perfect hash index from document keys to their places.

Files of a store, all written by tasks into one shared folder:

* ``ids-*``: the ids of whole documents one after the other, raw little-endian unsigned numbers,
  2 bytes each if every id of the vocabulary fits and 4 otherwise; documents in ascending
  doc_id over all shards.
* ``index-*``: per range of key hashes a minimal perfect hash function (bit arrays by level, as
  many levels as it takes until no two keys share a bit) and, per slot, a fingerprint of the
  key, shard, first id and number of ids. A key is found by one hash, a few bits, a rank and one slot.
* ``rows`` and ``index`` (Parquet): the rows that the writing tasks returned. Only files named
  there count, so that files of failed or repeated attempts are never read.

A key is (doc_id, copy): rows that share a doc_id are copies 0, 1, ... in the order stored, by
the hash of their text. A null doc_id is a key too and comes first; a null or empty text has the
end id alone. Texts may have any length. Pieces of texts are encoded once each and remembered,
where the tokenizer splits in any case, so the ids are those of the whole text. Empty table: a store without documents. Other columns are ignored.
"""

from __future__ import annotations

import functools
import json
import os
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: Keys of one index file, on average.
KEYS_PER_FILE = 1 << 16
#: Bits per key left on a level of the hash function; more bits, fewer levels.
GAMMA = 2
#: Pieces remembered by a process, and the longest of them.
_PIECES, _PIECE = 1 << 20, 64
#: Characters that are split into pieces at a time.
_CHARS = 1 << 20
_LEVELS = 64
_SLOT = np.dtype([("fingerprint", "<u4"), ("shard", "<u4"), ("first", "<u8"), ("n", "<u8")])
_PRIME, _MIX, _64 = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93), (1 << 64) - 1


@dataclass(frozen=True)
class Store:
    """A written store: its folder and the bytes per id."""

    path: str
    width: int

    def rows(self, spark: SparkSession) -> DataFrame:
        """Per document: shard, file, place in the shard, first id, number of ids, copies before it in the shard."""
        return spark.read.parquet(f"{self.path}/rows")

    def index(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/index")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme that Hadoop's settings give it, so that tasks open the same place."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()


def _files(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return pyarrow.fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return pyarrow.fs.FileSystem.from_uri("s3:" + rest if scheme == "s3a" else path)


def _read(path: str, offset: int = 0, size: int | None = None) -> bytes:
    system, place = _files(path)
    with system.open_input_file(place) as file:
        return file.read_at(file.size() if size is None else size, offset)


class Encoder:
    """The ids of texts as raw bytes, each different piece encoded once.

    Pieces stand between spaces and line feeds; one that ends with a letter and one mark is two,
    and a capital before a letter is taken as small. A tokenizer that does not split there, drop
    the space and lower the case, as probes show, gets whole texts. New words of letters are
    encoded in one text between spaces where the tokenizer marks the ends of words.
    """

    def __init__(self, path: str, width: int) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer, self.kind, self.width = _tokenizer(path), f"<u{width}", width
        self.known: dict[str, bytes] = {}
        self.end = np.array([END_ID], self.kind).tobytes()
        special = [(i, t.content) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and not (t.normalized or t.lstrip or t.rstrip or t.single_word)]
        self.bar_id, self.bar = special[0] if special else (None, None)
        probes = [" Ab  c.\nDe,\n\n", "ab c. de,", "ab", "c", ".", "de", ","]
        ids = [self._ids(probe).tolist() for probe in probes]
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith(suffix) for i in range(size)]) if suffix else None
        self.by_piece = bool(special) and ids[0] == ids[1] == sum(ids[2:], [])

    def _ids(self, text: str) -> np.ndarray:
        # The same ids as those of encode, without the offsets into the text.
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)

    def _apart(self, words: list[str]) -> dict[str, bytes] | None:
        """The ids of words of letters, encoded as one text: each ends with its only id that ends a word.

        None if the tokenizer has no such ids or makes more than one word of one of them.
        """
        if self.ends is None:
            return None
        ids = self._ids(" ".join(words))
        stops = ((np.flatnonzero(self.ends[ids]) + 1) * self.width).tolist()
        if len(stops) != len(words):
            return None
        data = ids.tobytes()
        return {word: data[a:b] for word, a, b in zip(words, [0, *stops], stops, strict=False)}

    def _between_bars(self, parts: list[str]) -> dict[str, bytes]:
        ids = self._ids(self.bar.join(parts))
        bars = np.flatnonzero(ids == self.bar_id) * self.width
        data = ids.tobytes()
        starts = [0, *(bars + self.width).tolist()]
        return {part: data[a:b] for part, a, b in zip(parts, starts, [*bars.tolist(), len(data)], strict=True)}

    def _learn(self, pieces: set[str]) -> None:
        # Small letters alone have no parts.
        words = [piece for piece in pieces if piece.isalpha() and piece[0] > "Z"]
        parts = {piece: _parts(piece) for piece in pieces.difference(words)}
        others = {part for split in parts.values() for part in split}.difference(self.known, words)
        words += [part for part in others if part.isalpha()]
        for low in range(0, len(words), 1000):
            some = words[low : low + 1000]
            self.known.update(self._apart(some) or self._between_bars(some))
        plain = [part for part in others if not part.isalpha() and self.bar not in part]
        for low in range(0, len(plain), 1000):
            self.known.update(self._between_bars(plain[low : low + 1000]))
        for part in others:
            if self.bar in part:
                self.known[part] = self._ids(part).tobytes()
        self.known.update((piece, b"".join(map(self.known.__getitem__, split))) for piece, split in parts.items() if len(split) != 1 or split[0] != piece)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text and the end id."""
        if not self.by_piece:
            return [self._ids(text).tobytes() + self.end for text in texts]
        split = [text.replace("\n", " ").split(" ") for text in texts]
        if len(self.known) > _PIECES:
            self.known = {}
        new = set().union(*split).difference(self.known)
        self._learn(new)
        found = [b"".join(map(self.known.__getitem__, pieces)) + self.end for pieces in split]
        for piece in new:
            if len(piece) > _PIECE:
                self.known.pop(piece, None)
                for part in _parts(piece):
                    self.known.pop(part, None)
        return found


@functools.lru_cache(maxsize=1)
def _encoder(path: str, width: int) -> Encoder:
    """One for all tasks that a worker process runs after each other, with what it remembers."""
    return Encoder(path, width)


def _parts(piece: str) -> list[str]:
    """The piece without a mark behind its last letter, and the mark."""
    mark = []
    if len(piece) > 1 and piece[-1] in ".,;:!?" and piece[-2].isalpha():
        piece, mark = piece[:-1], [piece[-1]]
    if len(piece) > 1 and "A" <= piece[0] <= "Z" and piece[1].isalpha():
        piece = piece[0].lower() + piece[1:]
    return [piece, *mark] if piece else []


def _some(texts: pa.Array) -> Iterator[list[str]]:
    """The texts in order, in lists of about ``_CHARS`` bytes or one text."""
    some, size = [], 0
    for text in texts:
        some.append(text.as_py() or "")
        size += len(some[-1])
        if size > _CHARS:
            yield some
            some, size = [], 0
    yield some


# The hash function


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(32))


def _bit(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
    spread = _mixed(hashes + np.uint64((level + 1) * _PRIME & _64))
    return ((spread >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)


def _fingerprint(hashes: np.ndarray) -> np.ndarray:
    return (_mixed(hashes ^ np.uint64(_PRIME)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


class Index:
    """A minimal perfect hash function over the keys of one file, and a slot for each key.

    A level has ``GAMMA`` bits for each key that is left. A key that is alone on its bit owns
    it; the others go to the next level. The slot of a key is the number of bits set before
    its own. Keys that no level parts (two of one hash) stand by name in ``rest``.
    """

    def __init__(self, words: np.ndarray, levels: list[int], slots: np.ndarray, rest: list[str]) -> None:
        self.words, self.levels, self.slots, self.rest = words, levels, slots, rest
        ones = np.bitwise_count(words).astype(np.int64)
        self.before = np.cumsum(ones) - ones

    @staticmethod
    def built(hashes: np.ndarray, names: list[str], slots: np.ndarray) -> Index:
        left, words, levels = hashes, [np.zeros(0, np.uint64)], []
        at = np.arange(len(hashes))
        while len(left) and len(levels) < _LEVELS:
            size = max(64, -(-GAMMA * len(left) // 64) * 64)
            bit = _bit(left, len(levels), size).astype(np.int64)
            alone = np.bincount(bit, minlength=size)[bit] == 1
            bits = np.zeros(size, np.uint8)
            bits[bit[alone]] = 1
            words.append(np.packbits(bits, bitorder="little").view(np.uint64))
            levels.append(size)
            left, at = left[~alone], at[~alone]
        index = Index(np.concatenate(words), levels, np.zeros(len(hashes), _SLOT), [names[i] for i in at])
        own = index.slot(hashes, names)
        index.slots[own] = slots
        index.slots["fingerprint"][own] = _fingerprint(hashes)
        return index

    def slot(self, hashes: np.ndarray, names: list[str]) -> np.ndarray:
        """The slot of each key; any slot or -1 for a key that was not there when it was built."""
        slots = np.full(len(hashes), -1, np.int64)
        todo, start = np.arange(len(hashes)), 0
        for level, size in enumerate(self.levels):
            bit = _bit(hashes[todo], level, size)
            at = start + (bit >> np.uint64(6)).astype(np.int64)
            low = bit & np.uint64(63)
            hit = (self.words[at] >> low) & np.uint64(1) == 1
            below = self.words[at] & ((np.uint64(1) << low) - np.uint64(1))
            slots[todo[hit]] = (self.before[at] + np.bitwise_count(below))[hit]
            todo, start = todo[~hit], start + size // 64
        if self.rest:
            named = {name: len(self.slots) - len(self.rest) + i for i, name in enumerate(self.rest)}
            for i in todo:
                slots[i] = named.get(names[i], -1)
        return slots

    def find(self, hashes: np.ndarray, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is known by its fingerprint, and its slot's content."""
        slots = self.slot(hashes, names)
        if not len(self.slots):
            return np.zeros(len(hashes), bool), np.zeros(len(hashes), _SLOT)
        found = self.slots[slots]
        return (slots >= 0) & (found["fingerprint"] == _fingerprint(hashes)), found

    def to_bytes(self) -> bytes:
        head = json.dumps({"levels": self.levels, "rest": self.rest, "keys": len(self.slots)}).encode()
        return struct.pack("<q", len(head)) + head + self.words.astype("<u8").tobytes() + self.slots.tobytes()

    @staticmethod
    def from_bytes(data: bytes) -> Index:
        end = 8 + struct.unpack_from("<q", data)[0]
        head = json.loads(data[8:end])
        n = sum(head["levels"]) // 64
        words = np.frombuffer(data, "<u8", n, end)
        return Index(words, head["levels"], np.frombuffer(data, _SLOT, head["keys"], end + 8 * n), head["rest"])


def key_hash(doc_id: Column, copy: Column) -> Column:
    return F.xxhash64(doc_id, copy)


def key_hash_of(doc_id: int | None, copy: int = 0) -> int:
    """The same outside of Spark, as a signed number."""
    seed = 42 if doc_id is None else xxhash.xxh64_intdigest(struct.pack("<q", doc_id), seed=42)
    found = xxhash.xxh64_intdigest(struct.pack("<q", copy), seed=seed)
    return found - (1 << 64) if found >> 63 else found


# Writing


def _write_shards(path: str, tokenizer: str, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, encoder = TaskContext.get().partitionId(), _encoder(tokenizer, width)
        # Each attempt has a file of its own; the rows of the one that counts name it.
        file = f"ids-{shard:06d}-{uuid.uuid4().hex}"
        system, folder = _files(path)
        out, first, place, run, last = None, 0, 0, 0, object()
        for batch in batches:
            out = out or system.open_output_stream(f"{folder}/{file}")
            firsts, counts, runs = [], [], []
            encoded = chain.from_iterable(map(encoder.encode, _some(batch.column(1))))
            for doc_id, data in zip(batch.column(0).to_pylist(), encoded, strict=True):
                out.write(data)
                firsts.append(first)
                counts.append(len(data) // width)
                first += counts[-1]
                run, last = (run + 1 if doc_id == last else 0), doc_id
                runs.append(run)
            n = len(batch)
            columns = [batch.column(0), pa.array([shard] * n, pa.int32()), pa.array([file] * n, pa.string())]
            columns += [pa.array(c, pa.int64()) for c in (range(place, place + n), firsts, counts, runs)]
            place += n
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "shard", "file", "place", "first", "n_tokens", "run"])
        if out is not None:
            out.close()

    return of_batches


def _with_copies(rows: DataFrame) -> DataFrame:
    """Adds ``copy``, the number of earlier rows of the same doc_id.

    Rows of one doc_id stand together, so a shard counts its own, and only its first doc_id
    can have rows in earlier shards; those are counted for it, one row per shard at most.
    """
    heads = rows.filter("place = 0").select(F.col("doc_id").alias("_id")).distinct()
    spread = rows.join(F.broadcast(heads), rows["doc_id"].eqNullSafe(heads["_id"]), "left_semi")
    before = Window.partitionBy("doc_id").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        spread.groupBy("doc_id", "shard").agg(F.count(F.lit(1)).alias("_n"))
        .select(F.col("doc_id").alias("_id"), F.col("shard").alias("_shard"), F.sum("_n").over(before).alias("_carry"))
        .filter("_carry > 0")
    )
    same = rows["doc_id"].eqNullSafe(carried["_id"]) & (rows["shard"] == carried["_shard"])
    copy = F.col("run") + F.coalesce("_carry", F.lit(0))
    return rows.join(F.broadcast(carried), same, "left").select(*rows.columns, copy.alias("copy"))


def _name(doc_id: Column, copy: Column) -> Column:
    return F.concat_ws(":", doc_id.cast("string"), copy.cast("string"))


def _write_index(path: str) -> Callable[[pa.Table], pa.Table]:
    def of_file(rows: pa.Table) -> pa.Table:
        slots = np.zeros(len(rows), _SLOT)
        for field, column in (("shard", "shard"), ("first", "first"), ("n", "n_tokens")):
            slots[field] = rows[column].to_numpy()
        index = Index.built(rows["hash"].to_numpy().view(np.uint64), rows["name"].to_pylist(), slots)
        number = rows["number"][0].as_py()
        file = f"index-{number:06d}-{uuid.uuid4().hex}"
        system, folder = _files(path)
        with system.open_output_stream(f"{folder}/{file}") as out:
            out.write(index.to_bytes())
        return pa.table({"number": pa.array([number], pa.int64()), "file": [file], "keys": pa.array([len(rows)], pa.int64())})

    return of_file


def written(docs: DataFrame, path: str, tokenizer: str | None = None, keys_per_file: int = KEYS_PER_FILE) -> Store:
    """Writes the ids of all documents and their index to a new folder."""
    spark, tokenizer = docs.sparkSession, tokenizer or tokenizer_path()
    path = _qualified(spark, path)
    system, folder = _files(path)
    system.create_dir(folder, recursive=True)
    size = _tokenizer(tokenizer).get_vocab_size(with_added_tokens=True)
    store = Store(path, 2 if max(size, END_ID + 1) <= 1 << 16 else 4)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    # Rows alike in doc_id and text are dealt out by where they were read, so no group is too large for a task.
    order = [F.col("doc_id"), F.xxhash64("text")]
    placed = docs.select("doc_id", "text").withColumn("_read", F.monotonically_increasing_id())
    rows = placed.repartitionByRange(*order, "_read").sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(
        _write_shards(path, tokenizer, store.width),
        f"doc_id {id_type}, shard int, file string, place bigint, first bigint, n_tokens bigint, run bigint",
    )
    rows.write.parquet(f"{path}/rows")
    rows = spark.read.schema(rows.schema).parquet(f"{path}/rows")
    hashed = key_hash(F.col("doc_id"), F.col("copy"))
    n_files = max(1, -(-rows.count() // keys_per_file))
    keys = _with_copies(rows).select(
        "shard", "first", "n_tokens", hashed.alias("hash"), F.pmod(hashed, F.lit(n_files)).alias("number"), _name(F.col("doc_id"), F.col("copy")).alias("name")
    )
    keys.groupBy("number").applyInArrow(_write_index(path), "number bigint, file string, keys bigint").write.parquet(f"{path}/index")
    return store


# Reading


def _shards(spark: SparkSession, store: Store) -> DataFrame:
    """(shard, file, base): as many rows as tasks have written; ``base`` counts the ids before a shard."""
    shards = store.rows(spark).groupBy("shard", "file").agg(F.sum("n_tokens").alias("n")).collect()
    bases, total = [], 0
    for shard, file, n in sorted(map(tuple, shards)):
        bases.append((shard, file, total))
        total += n
    return spark.createDataFrame(bases, "shard int, file string, base bigint")


def _find(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: tuple[str, Index] | None = None
        for batch in batches:
            files = batch.column("file").to_pylist()
            cuts = [0, *(k for k in range(1, len(files)) if files[k] != files[k - 1]), len(files)]
            for low, high in zip(cuts, cuts[1:], strict=False):
                if low == high:
                    continue
                if opened is None or opened[0] != files[low]:
                    opened = (files[low], Index.from_bytes(_read(f"{path}/{files[low]}")))
                part = batch.slice(low, high - low)
                known, slots = opened[1].find(part.column("hash").to_numpy().view(np.uint64), part.column("name").to_pylist())
                columns = [part.column("doc_id"), part.column("copy"), pa.array(slots["shard"].astype(np.int32))]
                columns += [pa.array(slots[c].astype(np.int64)) for c in ("first", "n")]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "copy", "shard", "first", "n_tokens"]).filter(pa.array(known))

    return of_batches


def _fetch(path: str, width: int, with_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, name = None, None
        for batch in batches:
            sums, ids = [], []
            for file, first, n in zip(*(batch.column(c).to_pylist() for c in ("file", "first", "n_tokens")), strict=True):
                if file != name:
                    system, folder = _files(path)
                    opened, name = system.open_input_file(f"{folder}/{file}"), file
                found = np.frombuffer(opened.read_at(n * width, first * width), f"<u{width}").astype("<u4")
                sums.append(zlib.crc32(found.tobytes()))
                if with_ids:
                    ids.append(found.astype(np.int64))
            columns = [batch.column(c) for c in ("doc_id", "copy", "start", "n_tokens")] + [pa.array(sums, pa.int64())]
            names = ["doc_id", "copy", "start", "n_tokens", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return of_batches


def fetched(store: Store, keys: DataFrame, with_ids: bool = False) -> DataFrame:
    """Per row of ``keys`` (doc_id): copy, start, n_tokens, ids_crc32 and, if wanted, ids.

    Rows that share a doc_id ask for its copies in order. Unknown keys give no row. Each key is
    looked up in the index; the places found are then read in order, shard by shard.
    """
    spark = keys.sparkSession
    id_type = keys.schema["doc_id"].dataType.simpleString()
    index = store.index(spark).select("number", "file")
    n_files = max(1, index.count())
    asked = keys.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"))
    asked = asked.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("copy"))
    hashed = key_hash(F.col("doc_id"), F.col("copy"))
    found = (
        asked.select("doc_id", "copy", hashed.alias("hash"), _name(F.col("doc_id"), F.col("copy")).alias("name"), F.pmod(hashed, F.lit(n_files)).alias("number"))
        .join(index, "number").repartition("number").sortWithinPartitions("number")
        .mapInArrow(_find(store.path), f"doc_id {id_type}, copy bigint, shard int, first bigint, n_tokens bigint")
    )
    placed = found.join(F.broadcast(_shards(spark, store)), "shard").withColumn("start", F.col("base") + F.col("first"))
    # Stretches of a shard go to tasks as a whole, so that they are read in order.
    stretch = F.shiftright("first", 18)
    ids = ", ids array<bigint>" if with_ids else ""
    return (
        placed.repartition("shard", stretch).sortWithinPartitions("shard", "first")
        .mapInArrow(_fetch(store.path, store.width, with_ids), f"doc_id {id_type}, copy bigint, start bigint, n_tokens bigint, ids_crc32 bigint{ids}")
    )


class Client:
    """Keyed access to a store without a Spark job per key: one index file and one range of ids are read."""

    def __init__(self, spark: SparkSession, store: Store) -> None:
        self.store = store
        self.indexes: dict[int, str] = dict(store.index(spark).select("number", "file").collect())
        self.shards: dict[int, Row] = {row["shard"]: row for row in _shards(spark, store).collect()}

    @functools.lru_cache(maxsize=16)  # noqa: B019
    def _index(self, file: str) -> Index:
        return Index.from_bytes(_read(f"{self.store.path}/{file}"))

    def ids(self, doc_id: int | None, copy: int = 0) -> list[int] | None:
        """The ids of a document, or None for an unknown key."""
        if not self.indexes:
            return None
        key = key_hash_of(doc_id, copy)
        name = ":".join(str(x) for x in (doc_id, copy) if x is not None)
        known, slots = self._index(self.indexes[key % len(self.indexes)]).find(np.array([key], np.int64).view(np.uint64), [name])
        if not known[0]:
            return None
        shard, width = self.shards[int(slots["shard"][0])], self.store.width
        data = _read(f"{self.store.path}/{shard['file']}", int(slots["first"][0]) * width, int(slots["n"][0]) * width)
        return np.frombuffer(data, f"<u{width}").tolist()
