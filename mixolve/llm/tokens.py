"""Token-ID output: encode texts, write Parquet token files in document order, read them selectively."""

from __future__ import annotations

import os
import re
import string
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from mixolve.llm.common import scratch_path

#: Parquet layout (writer v2): token IDs dictionary-coded (a vocabulary fits one dictionary page), id and
#: start_in_part delta-coded, n_tokens dictionary-coded where it repeats, row groups and pages small enough to skip by the page index.
LAYOUT = {
    "parquet.writer.version": "v2",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.dictionary.page.size": str(2 << 20),
    "compression": "zstd",
    "parquet.compression.codec.zstd.level": "1",
}


#: Stands for the IDs of a piece that can't stand alone; told apart by identity, and not a multiple of four bytes long.
UNSAFE = bytes(1)


def spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of every span, one span after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)


def _lengths(words: pa.Array) -> np.ndarray:
    return pc.binary_length(words).to_numpy().astype(np.int64)


class Memory:
    """IDs of pieces that were encoded before, as columns. Of more than `entries`, the half that most batches held stays."""

    def __init__(self, entries: int, longest: int):
        self.entries, self.longest = entries, longest
        self.pieces = pa.array([], pa.string())
        self.flat, self.size, self.met = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def find(self, pieces: pa.Array) -> np.ndarray:
        """The number of each distinct piece here, -1 for those that aren't."""
        at = pc.fill_null(pc.index_in(pieces, value_set=self.pieces), -1).to_numpy().astype(np.int64)
        self.met[at[at >= 0]] += 1
        return at

    def add(self, pieces: pa.Array, flat: np.ndarray, size: np.ndarray) -> None:
        """Distinct pieces that aren't here, with their IDs; long ones are left out."""
        begin = np.cumsum(size) - size
        fit = np.flatnonzero(_lengths(pieces) <= self.longest)[: self.entries // 2]
        if len(self.size) + len(fit) > self.entries:
            kept = np.sort(np.argsort(-self.met, kind="stable")[: self.entries // 2])
            self.flat, self.pieces = self.ids(kept), self.pieces.take(pa.array(kept))
            self.size, self.met = self.size[kept], self.met[kept] // 2
        self.flat = np.concatenate([self.flat, flat[spans(begin[fit], size[fit])]])
        self.pieces = pa.concat_arrays([self.pieces, pieces.take(pa.array(fit))])
        self.size, self.met = np.concatenate([self.size, size[fit]]), np.concatenate([self.met, np.ones(len(fit), np.int64)])

    def ids(self, at: np.ndarray) -> np.ndarray:
        """IDs of the pieces of these numbers, one piece after the other."""
        return self.flat[spans((np.cumsum(self.size) - self.size)[at], self.size[at])]


class Encoder:
    """Encodes texts with a `tokenizers` file, remembering what single words became.

    A text is cut where no pre-token can cross: at a space or line end between two other
    characters. With `spaced`, the space or line end stays with the word behind it (byte-level
    vocabularies); without, white space is dropped by the tokenizer itself. A word that ends in ASCII punctuation after a letter
    or digit is cut there too. Each distinct piece is encoded by the library and kept in a cache of
    bounded size (see Memory), columns looked up a batch at a time; texts that hold a special token's string, or white space of
    several characters, take the slower exact way. Results equal those of encode() on the whole text.
    """

    LONGEST = 64
    PUNCTUATION = string.punctuation
    SPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())  # what str.strip takes; none lies beyond

    def __init__(self, path: str, spaced: bool, entries: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.marks = tuple({s[:2] for s in special if s})
        self.border, self.border_id = next(iter(special.items()), (None, None))
        self.lead = " " if spaced else ""
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values(), default=0) + 1, bool)  # tokens that begin with a space
        self.opens[[i for t, i in vocabulary.items() if t[:1] == "\u0120"]] = True
        # where the tokenizer lower-cases anyway, words that differ in the case of A-Z are one
        self.folds = all(self._ids([a]) == self._ids([a.lower()]) and self._ids([f"x{a}x"]) == self._ids([f"x{a.lower()}x"]) for a in string.ascii_uppercase)
        self.memory = Memory(entries, self.LONGEST)
        self.tails: dict[str, bytes] = {}
        self.cuts = re.compile(r"(?<=\S)(?= \S)")

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _each(self, words: list[str], lead: str) -> list[bytes]:
        """IDs of many short words, encoded some hundred to a text and told apart by the leading space or a special token."""
        if not lead and not self.border:
            return self._ids(words)
        join = lead or self.border
        out: list[bytes] = []
        for i in range(0, len(words), 10_000):
            some = [words[j : j + 100] for j in range(i, min(i + 10_000, len(words)), 100)]
            made = self.tokenizer.encode_batch_fast([join.join(["", *few]) for few in some], add_special_tokens=False)
            for few, e in zip(some, made):
                ids = np.asarray(e.ids, "<u4")
                at = np.flatnonzero(self.opens[ids] if lead else ids == self.border_id)
                if len(at) != len(few):
                    out += self._ids([lead + w for w in few])
                    continue
                begin, end = (4 * (at + (not lead))).tolist(), [*(4 * at[1:]).tolist(), 4 * len(ids)]
                flat = ids.tobytes()
                out += [flat[x:y] for x, y in zip(begin, end)]
        return out

    def _learn(self, words: list[str], lead: str) -> dict[str, bytes]:
        """IDs of words, whatever is remembered; UNSAFE marks those that can't stand alone because of white space."""
        if len(self.tails) > 10_000:
            self.tails = {}
        odd: list[str] = []
        cut: list[tuple[str, str, str]] = []
        whole: dict[str, None] = {}
        for w in words:
            if lead and (w.strip() is not w or not w) and not (w[:1] == "\n" and w[1:] and w[1:].strip() == w[1:]):
                odd.append(w)
                continue
            base = w.rstrip(self.PUNCTUATION)
            if base is not w and base and base[-1].isalnum():
                cut.append((w, base, w[len(base) :]))
            else:
                whole[w] = None
        whole |= dict.fromkeys(c[1] for c in cut)
        lines = [w for w in whole if w[:1] == "\n"] if lead else []  # nothing stands between a line's end and its next word
        made = dict(zip(lines, self._each(lines, "")))
        rest = [w for w in whole if w not in made]
        made.update(zip(rest, self._each(rest, lead)))
        new = list({c[2] for c in cut}.difference(self.tails))
        self.tails.update(zip(new, self._each(new, "")))
        made.update([(w, made[base] + self.tails[tail]) for w, base, tail in cut])
        made.update(dict.fromkeys(odd, UNSAFE))
        return made

    def _cut(self, words: pa.Array, lead: str) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """The rule of _learn for a column of words: which can't stand alone, each up to the punctuation at its end (those: nothing), and that."""
        size = _lengths(words)
        odd = np.zeros(len(words), bool)
        if lead:
            core = _lengths(pc.utf8_trim(words, characters=self.SPACE))
            line = pc.starts_with(words, "\n").to_numpy(zero_copy_only=False) & (core > 0) & (size - core == 1)
            odd = ((core < size) | (size == 0)) & ~line
        base = pc.utf8_rtrim(words, characters=self.PUNCTUATION)
        last = pc.utf8_slice_codeunits(base, -1).dictionary_encode()
        ends = np.array([c.isalnum() for c in last.dictionary.to_pylist()], bool)[last.indices.to_numpy()]
        short = _lengths(base)
        tail = np.where(ends & ~odd, size - short, 0)
        base = pc.if_else(pa.array(odd), "", pc.if_else(pa.array(tail > 0), base, words))
        at = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words)].astype(np.int64) + short
        some = np.frombuffer(words.buffers()[2] or b"", np.uint8)[spans(at, tail)]
        offsets = np.concatenate([[0], np.cumsum(tail)]).astype(np.int32)
        return odd, base, pa.StringArray.from_buffers(len(words), pa.py_buffer(offsets), pa.py_buffer(some))

    def _lookup(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """IDs of distinct pieces: a flat array, and where in it each begins and how many it has. Those not remembered are encoded."""
        place = self.memory.find(pieces)
        absent = np.flatnonzero(place < 0)
        words = pieces.take(pa.array(absent)).to_numpy(zero_copy_only=False).tolist()
        lines = [bool(self.lead) and w[:1] == "\n" for w in words]  # nothing stands between a line's end and its next word
        made = dict.fromkeys(words, b"")
        for some, lead in (([w for w, x in zip(words, lines) if x], ""), ([w for w, x in zip(words, lines) if w and not x], self.lead)):
            made.update(zip(some, self._each(some, lead)))
        found = np.flatnonzero(place >= 0)
        fresh = np.fromiter(map(len, made.values()), np.int64, len(made)) // 4
        new = np.frombuffer(b"".join(made.values()), "<u4")
        size, at, order = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64), np.concatenate([found, absent])
        size[found], size[absent] = self.memory.size[place[found]], fresh
        at[order] = np.cumsum(size[order]) - size[order]
        flat = np.concatenate([self.memory.ids(place[found]), new])  # of what this batch holds, not of all that is remembered
        self.memory.add(pieces.take(pa.array(absent)), new, fresh)
        return flat, at, size

    def _whole(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, "<u4")
        if any(m in text for m in self.marks) or not self.lead:
            return np.frombuffer(self._ids([text])[0], "<u4")
        return np.frombuffer(b"".join(self._ids(self.cuts.split(text))), "<u4")

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(flat IDs of all texts, offsets of each text in them). Texts must not be null."""
        lists = pc.split_pattern(pc.replace_substring(pc.ascii_lower(texts) if self.folds else texts, "\n", " \n" if self.lead else " "), " ")
        bounds = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        bounds = bounds - bounds[0]
        place, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary.cast(pa.string())
        odd, base, tail = self._cut(words, self.lead)
        base, tail = base.dictionary_encode(), tail.dictionary_encode()
        flat, at, size = self._lookup(base.dictionary)
        tails = self._each(tail.dictionary.to_pylist(), "")
        apart = [tails]
        if self.lead:  # the first piece of each text has no space before it
            firsts, which = np.unique(place[bounds[:-1]], return_inverse=True)
            heads = words.take(pa.array(firsts)).to_pylist()
            made = self._learn(heads, "")
            apart.append([made[w] for w in heads])
            place[bounds[:-1]] = len(words) + which
        more = np.fromiter((len(x) // 4 for few in apart for x in few), np.int64)
        at, size = np.concatenate([at, len(flat) + np.cumsum(more) - more]), np.concatenate([size, more])
        flat = np.concatenate([flat, np.frombuffer(b"".join(x for few in apart for x in few), "<u4")])
        # a word is two of these, what comes before the punctuation and that; a first piece is one
        two = np.stack([base.indices.to_numpy(), len(base.dictionary) + tail.indices.to_numpy()], 1).ravel()
        start = len(base.dictionary) + len(tails)
        flat = flat[spans(np.concatenate([at[two], at[start:]]), np.concatenate([size[two], size[start:]]))]
        size = np.concatenate([size[two[::2]] + size[two[1::2]], size[start:]])
        hard = np.zeros(len(texts), bool)
        for m in self.marks:
            hard |= pc.match_substring(texts, m).to_numpy(zero_copy_only=False)
        if odd.any():
            unsafe = np.concatenate([odd, np.zeros(len(size) - len(odd), bool)])[place]
            hard |= np.diff(np.concatenate([[0], np.cumsum(unsafe)])[bounds]) > 0
        at, sizes = np.cumsum(size) - size, size[place]
        out, offsets = flat[spans(at[place], sizes)], np.concatenate([[0], np.cumsum(sizes)])[bounds]
        if hard.any():
            each = [self._whole(texts[i].as_py()) if hard[i] else out[offsets[i] : offsets[i + 1]] for i in range(len(texts))]
            out, offsets = np.concatenate(each), np.cumsum([0, *map(len, each)])
        return out, offsets


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, spaced: bool, entries: int = 500_000) -> Encoder:
    """This worker's encoder, one at a time; it lives as long as the worker, so that tasks share its cache."""
    if (path, spaced, entries) not in _encoders:
        _encoders.clear()
        _encoders[path, spaced, entries] = Encoder(path, spaced, entries)
    return _encoders[path, spaced, entries]


def slices(batch: pa.RecordBatch, column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about `most` characters in a column, so that a slice's results stay small."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def write_tokens(docs: DataFrame, path: str, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, spaced: bool = True) -> None:
    """Encode docs and write Parquet token files in ascending order of id_col.

    Columns: id, part (number of the file's range), start_in_part, n_tokens, tokens LIST<INT>. Texts
    are dealt into ranges of the ID before they are encoded; rows with equal IDs may part at a range
    border, so one ID can't overload a range. Null texts are empty (only end_id is written), null
    IDs come first, repeated rows are all written, an empty input gives an empty table, other
    columns are ignored.
    """
    kept = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ordered = kept.withColumn("tie", F.xxhash64("text")).repartitionByRange("id", "tie").sortWithinPartitions("id", "tie")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, at = encoder(tokenizer, spaced), TaskContext.get().partitionId(), 0
        for batch in batches:
            for few in slices(batch, "text"):
                ids, ends = enc.encode(few.column("text"))
                ids = np.insert(ids, ends[1:], end_id)
                offsets = ends + np.arange(len(ends))
                n = np.diff(offsets)
                yield pa.RecordBatch.from_arrays(
                    [few.column("id"), pa.array(np.full(len(n), part, np.int32)), pa.array(at + offsets[:-1]), pa.array(n), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.view("<i4")))],
                    names=["id", "part", "start_in_part", "n_tokens", "tokens"],
                )
                at += int(offsets[-1])
        pa.default_memory_pool().release_unused()  # the worker stays, and shares its executor's memory

    ordered.select("id", "text").mapInArrow(run, "id long, part int, start_in_part long, n_tokens long, tokens array<int>").write.options(**LAYOUT).parquet(path)


def read_tokens(spark: SparkSession, path: str, *, tokens: bool = True) -> DataFrame:
    """Rows of token files: id, start (IDs of all documents before it), n_tokens and, if asked, tokens.

    Without tokens only the counters' column chunks are read.
    """
    rows = spark.read.schema("id long, part int, start_in_part long, n_tokens long, tokens array<int>").parquet(path)
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select(F.col("part"), F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    out = rows.join(F.broadcast(before), "part")  # one row a file
    return out.select("id", (F.col("before") + F.col("start_in_part")).alias("start"), "n_tokens", *(["tokens"] if tokens else []))


def with_crc(rows: DataFrame) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) from rows with tokens, counted from the tokens themselves."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("tokens")
            flat, offsets = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), lists.offsets.to_numpy()
            crc = [zlib.crc32(flat[i:j]) for i, j in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("start"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())], names=["id", "start", "n_tokens", "ids_crc32"])

    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("id", "start", "n_tokens", "ids_crc32")])
    return rows.mapInArrow(run, schema)


def token_output(spark: SparkSession, docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write docs as token files into the shared folder and return what the files say of each document."""
    path = scratch_path(spark, "tokens")
    write_tokens(docs, path, tokenizer)
    return with_crc(read_tokens(spark, path)).withColumnRenamed("id", "doc_id")
