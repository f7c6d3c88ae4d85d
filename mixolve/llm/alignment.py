"""Alignment of two tokenizers over a corpus: which tokens of one cover the bytes of which tokens of the other."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixolve.llm.common import scratch
from mixolve.llm.tokens import UNSAFE, Encoder, slices, spans


def _byte_of() -> dict[str, int]:
    """The character that a byte-level vocabulary writes for each byte: printable ones stand for themselves, the others follow from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """The bytes of all tokens, in one array."""

    def __init__(self, entries: list[bytes]):
        self.size = np.array([len(e) for e in entries], np.int32)
        self.start = np.cumsum(self.size, dtype=np.int32) - self.size
        self.flat = np.frombuffer(b"".join(entries), np.uint8)
        # decimal digits of each ID, left-aligned, and zeros
        self.digits = np.zeros((len(entries), len(str(len(entries)))), np.uint8)
        for i in range(len(entries)):
            said = str(i).encode()
            self.digits[i, : len(said)] = np.frombuffer(said, np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        ends = np.cumsum(size, dtype=np.int32)
        return self.flat[np.arange(ends[-1] if len(ends) else 0, dtype=np.int32) + np.repeat(self.start[ids] - (ends - size), size)]


class ByteTokens(Encoder):
    """A byte-level `tokenizers` file in which special tokens' strings are plain text; texts come with a leading space."""

    def __init__(self, path: str):
        super().__init__(path, True)
        self.tokenizer.encode_special_tokens = True
        self.marks, self.border = (), None
        byte = _byte_of()
        held = {i: t for t, i in self.tokenizer.get_vocab().items()}
        self.vocabulary = Vocabulary([bytes(byte.get(c, 0) for c in held.get(i, "")) for i in range(max(held) + 1)])


class Pieces(Encoder):
    """A `sentencepiece` model, words remembered as in Encoder.

    That needs a vocabulary in which no piece goes on over a space or a line's end; with any other, texts are encoded whole.
    """

    PUNCTUATION = ""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        self.marks, self.lead = (), " "
        self.tails = {}
        self.apart = not any("▁" in p.lstrip("▁") or "\n" in p for p in pieces)
        self.vocabulary = Vocabulary([bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])
        self.space = self.model.piece_to_id("▁")

    def _each(self, words: list[str], lead: str) -> list[bytes]:
        out = []
        for word, ids in zip(words, self.model.encode(words, num_threads=1)):
            ids = np.asarray(ids, "<u4")
            if word[:1] == "\n":  # no space stands before it
                out.append(ids[1:].tobytes() if len(ids) and ids[0] == self.space else UNSAFE)
            else:
                out.append(ids.tobytes())
        return out

    def _learn(self, words: list[str], lead: str) -> dict[str, bytes]:
        return super()._learn(words, lead) if self.apart else dict.fromkeys(words, UNSAFE)

    def _whole(self, text: str) -> np.ndarray:
        return np.asarray(self.model.encode(text), "<u4")


class Pair:
    """Both tokenizers, with one memory of what single words became: bounded, of two generations.

    A text is cut at single spaces and line ends. To both tokenizers a word in it is that with a space (or line end) before it, the
    first one too, as the first tokenizer is given a space and the text and the second puts one there itself. Texts with other
    white space at a cut are encoded whole. Results equal those of whole texts.
    """

    #: The code of a word that can't stand alone.
    ALONE = b"\xff\xff\xff\xff"

    def __init__(self, a: str, b: str, entries: int = 100_000):
        self.first, self.second, self.entries = ByteTokens(a), Pieces(b), entries
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _codes(self, words: list[str]) -> list[bytes]:
        """Of each word: how many tokens of the first kind, those, and those of the second kind."""
        if len(self.young) > self.entries:
            self.old, self.young = self.young, {}
        out = list(map(self.young.get, words))
        absent = [i for i, x in enumerate(out) if x is None]
        asked = [words[i] for i in absent]
        made = {w: x for w, x in zip(asked, map(self.old.get, asked)) if x is not None}
        new = [w for w in asked if w not in made]
        one, two = self.first._learn(new, " "), self.second._learn(new, " ")
        for w in new:
            x, y = one[w], two[w]
            made[w] = self.ALONE if x is UNSAFE or y is UNSAFE else (len(x) // 4).to_bytes(4, "little") + x + y
        for i, w in zip(absent, asked):
            out[i] = made[w]
        self.young.update([(w, x) for w, x in made.items() if len(w) <= Encoder.LONGEST])
        return out

    def encode(self, texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each tokenizer (flat IDs of all texts, offsets of each text in them). Texts must not be null."""
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        bounds = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        bounds, place = bounds - bounds[0], coded.indices.to_numpy()
        codes = self._codes(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        size = np.fromiter(map(len, codes), np.int64, len(codes)) // 4
        flat = np.frombuffer(b"".join(codes), "<u4")
        at = np.cumsum(size) - size
        count = flat[at].astype(np.int64)
        alone = count == 0xFFFFFFFF
        count[alone] = 0
        hard = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(alone[place])])[bounds]))
        out = []
        for start, sizes, whole in ((at + 1, count, lambda t: self.first._whole(" " + t)), (at + 1 + count, size - 1 - count, self.second._whole)):
            sizes = sizes[place]
            ids, offsets = flat[spans(start[place], sizes)], np.concatenate([[0], np.cumsum(sizes)])[bounds]
            if len(hard):
                each = [ids[x:y] for x, y in zip(offsets[:-1], offsets[1:])]
                for i in hard.tolist():
                    text = texts[i].as_py()
                    each[i] = whole(text) if text else ids[:0]
                ids, offsets = np.concatenate(each), np.cumsum([0, *map(len, each)])
            out.append((ids, offsets))
        return out


_held: dict[tuple[str, str], Pair] = {}


def pair(a: str, b: str) -> Pair:
    """This worker's pair of encoders; it lives as long as the worker."""
    if (a, b) not in _held:
        _held.clear()
        _held[a, b] = Pair(a, b)
    return _held[a, b]


def _only(keep: np.ndarray, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """IDs and offsets of the kept documents; the others have none."""
    sizes = np.where(keep, np.diff(offsets), 0)
    return ids[spans(offsets[:-1], sizes)], np.concatenate([[0], np.cumsum(sizes)])


def _weighed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their weights."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1)) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(weights[order], first) if len(first) else np.zeros(0, np.int64)


def linked(group_a: np.ndarray, a: np.ndarray, group_b: np.ndarray, b: np.ndarray, doc: np.ndarray, size_b: int, span: int, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, pair) keys, doc * span + a * size_b + b, and how many links each stands for.

    Tokens of both sides are in order of their group; doc is each group's document. Links are expanded by
    repeats, about `most` at a time; a group of many links has equal tokens joined first.
    """
    n = len(doc)
    count_a, count_b = np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n)
    many = count_a * count_b > 1024
    weight_a = weight_b = None
    if many.any():

        def joined(group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            big = many[group]
            keys, weights = _weighed(group[big] * (1 << 32) + ids[big], np.ones(big.sum(), np.int64))
            group, ids, weights = np.concatenate([group[~big], keys >> 32]), np.concatenate([ids[~big], keys & 0xFFFFFFFF]), np.concatenate([np.ones((~big).sum(), np.int64), weights])
            order = np.argsort(group, kind="stable")
            return group[order], ids[order], weights[order]

        group_a, a, weight_a = joined(group_a, a)
        group_b, b, weight_b = joined(group_b, b)
        count_b = np.bincount(group_b, minlength=n)
    first_b = np.cumsum(count_b) - count_b
    times = count_b[group_a]
    ends = np.cumsum(times)
    found, at = [], 0
    while at < len(a):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        some = slice(at, end)
        right = spans(first_b[group_a[some]], times[some])
        keys = np.repeat(doc[group_a[some]] * span + a[some] * size_b, times[some]) + b[right]
        if weight_a is None:
            found.append(np.unique(keys, return_counts=True))
        else:
            found.append(_weighed(keys, np.repeat(weight_a[some], times[some]) * weight_b[right]))
        at = end
    if len(found) == 1:
        return found[0]
    return _weighed(np.concatenate([np.zeros(0, np.int64), *[k for k, _ in found]]), np.concatenate([np.zeros(0, np.int64), *[w for _, w in found]]))


def align(texts: pa.Array, both: Pair) -> dict[str, np.ndarray | list]:
    """The alignment of some texts (strings, not null).

    n_a, n_b, n_groups, n_links and groups_sha256 of each; keys, the distinct pairs a * (size of the
    second vocabulary) + b of all; and for each text, from offsets[i] to offsets[i + 1], the places of its pairs among
    keys and how many links (times) each stands for.
    """
    spaced = pc.binary_join_element_wise("", texts, " ")
    (ids_a, at_a), (ids_b, at_b) = both.encode(texts)
    va, vb = both.first.vocabulary, both.second.vocabulary
    raw = pc.cast(spaced, pa.large_binary())
    ends = np.concatenate([[0], np.cumsum(pc.binary_length(raw).to_numpy())])
    flat = np.frombuffer(b"".join(raw.to_pylist()), np.uint8)
    total = lambda values, at: np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[at])
    keep = np.diff(ends) > 1
    for vocabulary, ids, at in ((va, ids_a, at_a), (vb, ids_b, at_b)):
        keep &= total(vocabulary.size[ids], at) == np.diff(ends)
    sized = keep.copy()
    expected, inside = _only(sized, flat, ends)
    for vocabulary, ids, at in ((va, ids_a, at_a), (vb, ids_b, at_b)):
        keep &= total(vocabulary.joined(_only(sized, ids, at)[0]) != expected, inside) == 0
    (ids_a, at_a), (ids_b, at_b) = _only(keep, ids_a, at_a), _only(keep, ids_b, at_b)
    ids_a, ids_b = ids_a.astype(np.int64), ids_b.astype(np.int64)

    ends_a, ends_b = np.cumsum(va.size[ids_a], dtype=np.int64), np.cumsum(vb.size[ids_b], dtype=np.int64)
    cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
    group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
    count_a, count_b = np.bincount(group_a, minlength=len(cuts)), np.bincount(group_b, minlength=len(cuts))
    doc = np.searchsorted(np.cumsum(np.where(keep, np.diff(ends), 0)), cuts)
    n_groups = np.bincount(doc, minlength=len(texts))
    n_links = total(count_a * count_b, np.concatenate([[0], np.cumsum(n_groups)]))

    # a token's place where a group's tokens of the first kind stand before those of the second
    before_a, before_b = np.cumsum(count_a), np.cumsum(count_b) - count_b
    place_a, place_b = np.arange(len(ids_a)) + before_b[group_a], np.arange(len(ids_b)) + before_a[group_b]
    width = max(va.digits.shape[1], vb.digits.shape[1])
    said = np.zeros((len(ids_a) + len(ids_b), width + 1), np.uint8)
    for vocabulary, ids, place, group, end in ((va, ids_a, place_a, group_a, b"|"), (vb, ids_b, place_b, group_b, b";")):
        said[place, : vocabulary.digits.shape[1]] = vocabulary.digits[ids]
        said[place, width] = np.where(np.diff(group, append=len(cuts)) > 0, end[0], ord(","))
    bounds = at_a + at_b
    last = bounds[1:][keep] - 1
    said[last, width] = 0
    ends_said = np.concatenate([[0], np.cumsum((said > 0).sum(axis=1))])[bounds]
    out = said[said > 0].tobytes()
    digests = [hashlib.sha256(out[x:y]).hexdigest() if y > x else "" for x, y in zip(ends_said[:-1].tolist(), ends_said[1:].tolist())]

    span = len(va.size) * len(vb.size)
    if len(texts) * span >= 1 << 63:
        raise ValueError("vocabularies too large for 64-bit keys")
    found, times = linked(group_a, ids_a, group_b, ids_b, doc, len(vb.size), span)
    keys, where = np.unique(found % span, return_inverse=True)
    return {
        "n_a": np.diff(at_a), "n_b": np.diff(at_b), "n_groups": n_groups, "n_links": n_links, "groups_sha256": digests, "keys": keys, "docs": np.bincount(where, minlength=len(keys)),
        "places": where.astype(np.int32), "times": times.astype(np.int32), "offsets": np.searchsorted(found // span, np.arange(len(texts) + 1)),
    }


NUMBERS = ["n_a", "n_b", "n_groups", "n_links"]


def chunked(docs: DataFrame, a: str, b: str, *, id_col: str = "doc_id", text_col: str = "text", page: int = 10_000) -> DataFrame:
    """Alignments of docs in chunks of neighbouring rows, of two kinds of rows: documents, and pages of their chunk's distinct pairs.

    Columns: chunk; of a document doc_id, n_a, n_b, n_groups, n_links, groups_sha256, places (of its pairs in the chunk)
    and times; of a page first (its first pair's place), keys and docs (in how many of the chunk's documents).
    """
    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = "chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, places array<int>, times array<int>, first long, keys array<long>, docs array<int>"
    kinds = [pa.int64()] * 6 + [pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32())]
    names = [c.split()[0] for c in schema.split(", ")]

    def batch(n: int, **columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, t) for c, t in zip(names, kinds)], names=names)

    def lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for whole in batches:
            for few in slices(whole, "text", 2 << 20):
                got, n = align(few.column("text"), pair(a, b)), few.num_rows
                yield batch(
                    n, chunk=pa.repeat(chunk, n), doc_id=few.column("doc_id"), groups_sha256=pa.array(got["groups_sha256"], pa.string()), places=lists(got["places"], got["offsets"], pa.int32()),
                    times=lists(got["times"], got["offsets"], pa.int32()), **{c: pa.array(got[c], pa.int64()) for c in NUMBERS},
                )
                cuts = np.append(np.arange(0, len(got["keys"]), page), len(got["keys"]))
                n = len(cuts) - 1
                yield batch(n, chunk=pa.repeat(chunk, n), first=pa.array(cuts[:-1], pa.int64()), keys=lists(got["keys"], cuts, pa.int64()), docs=lists(got["docs"], cuts, pa.int32()))
                chunk += 1
        pa.default_memory_pool().release_unused()  # the worker stays, and shares its executor's memory

    return kept.mapInArrow(run, schema)


def pair_counts(pairs: DataFrame, second_size: int, *, salts: int = 16) -> DataFrame:
    """(key, count, best): documents that hold each pair linked, and whether no pair of the same first token is in more.

    pairs: chunk, key, docs. Sums are made by pair and salt, then by pair.
    """
    some = pairs.groupBy("key", F.pmod(F.xxhash64("chunk"), F.lit(salts)).alias("salt")).agg(F.sum("docs").alias("docs"))
    counts = scratch(some.groupBy("key").agg(F.sum("docs").alias("count")), "pair-counts")
    first = F.expr(f"key div {second_size}")
    most = counts.groupBy(first.alias("first")).agg(F.max("count").alias("most"))
    # a row for each token of the first vocabulary at most
    return counts.join(F.broadcast(most), first == F.col("first")).select("key", "count", (F.col("count") == F.col("most")).alias("best"))


def _scored(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """A chunk's documents with sums over their pairs' counts."""
    count, best = np.zeros(pairs.num_rows, np.int64), np.zeros(pairs.num_rows, np.int64)
    place = pairs.column("place").to_numpy()
    count[place], best[place] = pairs.column("count").to_numpy(), pairs.column("best").to_numpy()
    docs = docs.combine_chunks()
    sizes = pc.list_value_length(docs.column("places")).to_numpy()
    at, times = (pc.list_flatten(docs.column(c)).to_numpy() for c in ("places", "times"))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    sums = [np.diff(np.concatenate([[0], np.cumsum(times * values[at])])[bounds]) for values in (best, count)]
    return docs.select(["doc_id", *NUMBERS, "groups_sha256"]).append_column("n_best", pa.array(sums[0], pa.int64())).append_column("count_sum", pa.array(sums[1], pa.int64()))


def token_alignment(docs: DataFrame, a: str, b: str, **columns: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document.

    a: a byte-level `tokenizers` file, given a space and the text; b: a `sentencepiece` model, given the text. Byte
    offsets where tokens of both end cut a text into groups; all pairs of a token of a and one of b in a
    group are links. A pair's count is the number of documents that hold it linked; n_best counts links
    whose pair no other of the same token of a surpasses, count_sum adds the counts of all links.
    Texts that are null or empty, or that either tokenizer doesn't give back byte by byte, have no
    tokens: zeros and ''. Repeated rows count each; IDs may be null; an empty table stays empty;
    other columns are ignored.

    Chunks of neighbouring rows are aligned at once, and only a chunk's distinct pairs go to the corpus-wide table and back.
    """
    chunks = scratch(chunked(docs, a, b, **columns), "alignments", compression="zstd")
    pairs = chunks.where("keys is not null").select("chunk", "first", F.posexplode(F.arrays_zip("keys", "docs")).alias("i", "x")).select("chunk", (F.col("first") + F.col("i")).alias("place"), F.col("x.keys").alias("key"), F.col("x.docs").alias("docs"))
    counts = scratch(pair_counts(pairs, pair(a, b).second.model.vocab_size()), "pair-table")
    found = pairs.select("chunk", "place", "key").join(counts, "key").select(F.col("chunk").alias("of"), "place", "count", "best")
    told = chunks.where("keys is null").select("chunk", "doc_id", *NUMBERS, "groups_sha256", "places", "times")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    return told.groupBy("chunk").cogroup(found.groupBy("of")).applyInArrow(_scored, schema).select("doc_id", *NUMBERS, "n_best", "count_sum", "groups_sha256")
