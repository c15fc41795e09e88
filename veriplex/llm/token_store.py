"""Operator 2, token ids in Arrow files of fixed-size lists.

Documents are dealt by ranges of doc_id; each task encodes its documents in ascending doc_id order, appends the end id,
and cuts the ids into sequences of LENGTH. Its file is an Arrow IPC file whose batches hold ``ids`` and ``mask`` as
fixed-size lists, so that any sequence is found by arithmetic and mapped without a copy; the last sequence is padded,
mask false. The index, written by Spark, has the part, file, place in the file and number of ids of every document.

The tokenizer splits only within runs of white space and the words that follow, so equal pieces have equal ids
wherever they stand. Arrow splits a slice of texts and numbers its distinct pieces; each is looked up once, new ones are split
further and only new parts go to the library's model (a worker remembers MEMO of them), and NumPy gathers the ids. Texts
with white space of which a space is not the first character are encoded whole.

Defined cases: null text is the empty text and has only the end id; a null doc_id comes before all others; rows of one
doc_id follow each other in the order of their texts; texts that spell a special token are ordinary text; other columns
are ignored; an empty table makes no file and no rows.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Callable
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import filesystem, new_folder, partitions, slices, stage, table, text_of
from .windows import gathered

LENGTH = 2048
#: Sequences of a record batch.
BATCH = 256
#: Pieces, and parts of pieces, whose ids a worker remembers.
MEMO = 100_000
#: Bytes of the texts that are encoded at a time, about; a longer text is encoded alone.
SLICE = 4 << 20
#: Strings that are given to the library at once: what it returns takes far more room than the ids.
CALL = 1 << 14
INDEX = "doc_id long, part int, file string, at long, n_tokens long"

#: White space other than the usual six characters: definitions of it differ.
_ODD = "".join(map(chr, (*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF)))
_UNSAFE = rf"[\t\n\v\f\r ] |[{_ODD}]"
#: Pieces that only the whole library splits: the class of a character after U+024F may depend on the version of Unicode, and white space at the end runs into what follows.
_ALONE = r"^$|[^\x{00}-\x{24F}]|[\t\n\v\f\r ]$"
#: The split of byte-level vocabularies that name no other.
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: A character that no plain piece has.
_BETWEEN = "\ue000"
_loaded: dict[str, tuple] = {}


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, the others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Memo:
    """The ids of MEMO strings at most."""

    def __init__(self, kind: np.dtype) -> None:
        self.slots: dict[str, int] = {}
        self.pool, self.at, self.sizes = np.zeros(0, kind), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def ids(self, names: list[str], work: Callable, often: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pool, at, sizes) of distinct names; work gives (ids, sizes) of new ones, and those that are ``often`` are remembered while there is room."""
        slots = np.fromiter(map(self.slots.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(slots < 0)
        fresh = [names[i] for i in new.tolist()]
        ids, sizes = work(fresh) if fresh else (self.pool[:0], self.sizes[:0])
        at = np.cumsum(sizes) - sizes
        slots[new] = len(self.at) + np.arange(len(new))
        out = np.concatenate([self.pool, ids]), np.concatenate([self.at, len(self.pool) + at])[slots], np.concatenate([self.sizes, sizes])[slots]
        room = MEMO - len(self.slots)
        kept = (np.arange(len(new)) if often is None else np.flatnonzero(often[new]))[:max(room, 0)]
        if len(kept):
            self.slots.update(zip([fresh[i] for i in kept.tolist()], range(len(self.at), len(self.at) + len(kept)), strict=True))
            self.at = np.concatenate([self.at, len(self.pool) + np.cumsum(sizes[kept]) - sizes[kept]])
            self.pool = np.concatenate([self.pool, gathered(ids, at[kept], sizes[kept])])
            self.sizes = np.concatenate([self.sizes, sizes[kept]])
        return out


class Encoder:
    """ids of texts, each with the end id, with a bounded memo of pieces and of their parts."""

    def __init__(self, path: str, width: int, end_id: int = 0) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library, self.kind, self.end = Tokenizer.from_file(path), np.dtype(f"<u{width}"), end_id
        self.library.encode_special_tokens = True
        self.model = Tokenizer(self.library.model)
        self.letters = _byte_letters()
        self.pieces, self.parts = Memo(self.kind), Memo(self.kind)
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        first = kind.get("pre_tokenizer") or {}
        # Only where the file asks for the usual split and nothing before it may texts be taken apart at spaces.
        self.apart = kind.get("normalizer") is None and (first.get("type"), first.get("add_prefix_space"), first.get("use_regex", True)) == ("ByteLevel", False, True)

    def _ids(self, library, texts: list[str], call: int) -> tuple[np.ndarray, np.ndarray]:
        ids, sizes = [np.zeros(0, self.kind)], [np.zeros(0, np.int64)]
        for at in range(0, len(texts), call):
            lists = [e.ids for e in library.encode_batch_fast(texts[at:at + call], add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, lists), np.int64, len(lists)))
            ids.append(np.fromiter(chain.from_iterable(lists), self.kind, int(sizes[-1].sum())))
        return np.concatenate(ids), np.concatenate(sizes)

    def whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the texts, one after another, how many each has), by the whole library."""
        return self._ids(self.library, texts, max(1, min(CALL, CALL * len(texts) // max(1, sum(map(len, texts))))))

    def of_parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of parts as the split gives them, in the letters of the vocabulary, by the library's model."""
        between, mapped = (x.encode().decode("latin-1").translate(self.letters) for x in (_BETWEEN, _BETWEEN.join(parts)))
        return self._ids(self.model, mapped.split(between), CALL)

    def of_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of distinct pieces that begin with a space. Parts are split off, and numbered, all together."""
        if not pieces:
            return np.zeros(0, self.kind), np.zeros(0, np.int64)
        parts = pa.array(_SPLIT.findall("".join(pieces)))
        begin = np.flatnonzero(pc.starts_with(parts, " ").to_numpy(zero_copy_only=False))
        if len(begin) != len(pieces):
            raise ValueError("the split joins pieces")
        parts = parts.dictionary_encode()
        codes = parts.indices.to_numpy()
        pool, at, sizes = self.parts.ids(parts.dictionary.to_pylist(), self.of_parts)
        ids = gathered(pool, at[codes], sizes[codes])
        return ids, np.add.reduceat(sizes[codes], begin)

    def of_all(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        alone = pc.match_substring_regex(pa.array(pieces, pa.string()), _ALONE).to_numpy(zero_copy_only=False) | ~np.fromiter((p[:1] == " " for p in pieces), bool, len(pieces))
        usual, odd = self.of_pieces([p for p, x in zip(pieces, alone, strict=True) if not x]), self.whole([p for p, x in zip(pieces, alone, strict=True) if x])
        sizes, at = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        for own, (ids, n), base in ((~alone, usual, 0), (alone, odd, len(usual[0]))):
            sizes[own], at[own] = n, base + np.cumsum(n) - n
        return gathered(np.concatenate([usual[0], odd[0]]), at, sizes), sizes

    def many(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all texts, where each text's ids end). Every distinct piece is looked up once."""
        if not len(texts):
            return np.zeros(0, self.kind), np.zeros(0, np.int64)
        safe = pc.invert(pc.match_substring_regex(texts, _UNSAFE)) if self.apart else pa.array(np.zeros(len(texts), bool))
        lists = pc.split_pattern(pc.if_else(safe, texts, ""), " ")
        begin = lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
        flat = lists.flatten().dictionary_encode()
        codes, names = flat.indices.to_numpy().astype(np.int64), flat.dictionary
        del lists, flat
        # The first piece of a text has no space before it; a text that can't be taken apart is a piece of its own.
        heads = names.take(pa.array(codes[begin])).dictionary_encode()
        odd = np.flatnonzero(~safe.to_numpy(zero_copy_only=False))
        codes[begin] = len(names) + heads.indices.to_numpy()
        codes[begin[odd]] = len(names) + len(heads.dictionary) + np.arange(len(odd))
        counts = np.bincount(codes, minlength=len(names))[:len(names)]
        used = np.flatnonzero(counts)
        slot = np.concatenate([np.cumsum(counts > 0) - 1, len(used) + np.arange(len(heads.dictionary) + len(odd))])
        pieces = [f" {p}" for p in names.take(pa.array(used)).to_pylist()] + heads.dictionary.to_pylist()
        pool, at, sizes = self.pieces.ids(pieces, self.of_all, np.append(counts[used] > 1, np.ones(len(heads.dictionary), bool)))
        ids, n = self.whole(texts.take(pa.array(odd)).to_pylist())
        at = np.concatenate([at, len(pool) + np.cumsum(n) - n, [len(pool) + len(ids)]])
        sizes, pool = np.concatenate([sizes, n, [1]]), np.concatenate([pool, ids, np.array([self.end], self.kind)])
        after = np.append(begin[1:], len(codes))
        order = np.insert(slot[codes], after, len(sizes) - 1)
        n = sizes[order]
        return gathered(pool, at[order], n), np.cumsum(n)[after + np.arange(len(texts))]

    def __call__(self, text: str) -> np.ndarray:
        return self.many(pa.array([text]))[0]


def encoder(path: str, width: int, end_id: int) -> Encoder:
    """One a worker process, kept from task to task."""
    key = (path, width, end_id)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Encoder(path, width, end_id)
    return _loaded[key]


class Store:
    """Writes one file of sequences; at is the place of the next id."""

    def __init__(self, folder: str, length: int, width: int) -> None:
        self.name, self.length, self.kind = f"{folder}/{uuid.uuid4().hex}.arrow", length, np.dtype(f"<u{width}")
        self.fields = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(self.kind), length)), ("mask", pa.list_(pa.bool_(), length))])
        fs, path = filesystem(self.name)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.sink = fs.open_output_stream(path, compression=None)
        self.out, self.at, self.parts, self.held = pa.ipc.new_file(self.sink, self.fields), 0, [], 0

    def add(self, ids: np.ndarray) -> None:
        self.parts.append(ids)
        self.held += ids.nbytes
        self.at += len(ids)
        if self.held >= self.length * BATCH * self.kind.itemsize:
            self._write(False)

    def _write(self, last: bool) -> None:
        ids = np.concatenate([np.zeros(0, self.kind), *self.parts])
        step = self.length * BATCH
        full = len(ids) - len(ids) % step
        for i in range(0, full, step):
            self._batch(ids[i:i + step], step)
        rest = ids[full:]
        if last and len(rest):
            n = -(-len(rest) // self.length) * self.length
            self._batch(np.concatenate([rest, np.zeros(n - len(rest), self.kind)]), len(rest))
            rest = rest[:0]
        self.parts, self.held = [rest.copy()], rest.nbytes

    def _batch(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        self.out.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)], schema=self.fields))

    def close(self) -> None:
        self._write(True)
        self.out.close()
        self.sink.close()


def _writer(folder: str, path: str, length: int, end_id: int, width: int):
    def run(batches):
        encode, store = encoder(path, width, end_id), None
        part = TaskContext.get().partitionId()
        for batch in batches:
            for own in slices(batch, size=SLICE):
                store = store or Store(folder, length, width)
                ids, ends = encode.many(own.column("text"))
                starts = np.concatenate([[0], ends[:-1]])
                n = own.num_rows
                yield pa.record_batch([own.column("doc_id"), pa.array(np.full(n, part, np.int32)), pa.array([store.name] * n), pa.array(store.at + starts), pa.array(ends - starts)], ["doc_id", "part", "file", "at", "n_tokens"])
                store.add(ids)
        if store:
            store.close()
    return run


def write_tokens(docs: DataFrame, path: str | None = None, length: int = LENGTH, end_id: int = 0, width: int = 2, folder: str | None = None) -> DataFrame:
    """Writes the ids of docs (doc_id, text) and returns the index. width: bytes of an id, 2 for up to 65,536 ids."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    rows = rows.repartitionByRange(partitions(spark), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    run = _writer(folder or new_folder(spark, "tokens"), path or vocabulary(), length, end_id, width)
    return stage(rows.mapInArrow(run, INDEX), "token-index")


class View:
    """Random access to one file: ids(at, n) of its stream, sequence(i) without a copy (of the mask too: Arrow's bits, as they are mapped)."""

    def __init__(self, name: str) -> None:
        fs, path = filesystem(name)
        self.source = pa.memory_map(path) if fs.type_name == "local" else fs.open_input_file(path)
        self.reader = pa.ipc.open_file(self.source)
        self.length = self.reader.schema.field("ids").type.list_size
        self.held: dict[int, np.ndarray] = {}

    def batch(self, i: int) -> np.ndarray:
        if i not in self.held:
            self.held = {k: v for k, v in self.held.items() if k == i - 1}
            self.held[i] = self.reader.get_batch(i).column("ids").values.to_numpy(zero_copy_only=True)
        return self.held[i]

    def sequence(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        own, at = self.reader.get_batch(i // BATCH), i % BATCH
        cut = slice(at * self.length, (at + 1) * self.length)
        return own.column("ids").values.to_numpy(zero_copy_only=True)[cut], own.column("mask").values[cut]

    def ids(self, at: int, n: int) -> np.ndarray:
        step, out = self.length * BATCH, []
        while n:
            part = self.batch(at // step)[at % step:at % step + n]
            if not len(part):
                raise ValueError("the file ends before the document does")
            out.append(part)
            at, n = at + len(part), n - len(part)
        return out[0] if len(out) == 1 else np.concatenate(out)

    def close(self) -> None:
        self.held = {}
        self.source.close()


def _reader(batches):
    view, name = None, None
    for batch in batches:
        sums = []
        for file, at, n in zip(*[batch.column(c).to_pylist() for c in ("file", "at", "n_tokens")], strict=True):
            if file != name:
                if view:
                    view.close()
                view, name = View(file), file
            sums.append(zlib.crc32(view.ids(at, n).astype("<u4").tobytes()))
        yield pa.record_batch([*[batch.column(c) for c in ("doc_id", "part", "at", "n_tokens")], pa.array(sums, pa.int64())], ["doc_id", "part", "at", "n_tokens", "ids_crc32"])


def read_tokens(index: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    index = index.select("doc_id", "part", "file", "at", "n_tokens")
    parts = index.groupBy("part").agg(F.sum("n_tokens").alias("all"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("part").alias("__p"), F.coalesce(F.sum("all").over(before), F.lit(0)).alias("base"))
    rows = index.mapInArrow(_reader, "doc_id long, part int, at long, n_tokens long, ids_crc32 long")
    rows = rows.join(F.broadcast(parts), F.col("part") == F.col("__p"))  # a row a part of the shuffle
    return rows.select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op2_token_store(spark, sf_dir: str) -> DataFrame:
    return read_tokens(write_tokens(table(spark, sf_dir, "documents").select("doc_id", "text")))
