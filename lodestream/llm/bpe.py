"""Encoding of a corpus with a public byte-level BPE vocabulary, in Spark expressions.

A text is cut into words by the vocabulary's pattern (JVM regular expression). Words that are pieces of the vocabulary,
which is most of a text, have their id at once, by a hash look-up over Arrow columns. The distinct other words are merged once each, so
the merges run over a dictionary and not over the corpus. The words that occur most get their ids without a shuffle, from a table of
at most `frequent` of them; only the occurrences of the others, none of which can be frequent, are joined with the dictionary.

A word's merges are a fold over its byte array. All stretches of the word that are pieces are looked up in the rank map (a
literal: an array of small maps by CRC-32, since Spark searches a map linearly) and folded in the order of rank and place. The state
is the set of borders between parts, at first between all bytes; a piece whose two ends are borders is merged: the
borders within it go. This is the usual rule (merge the pair of least rank, the leftmost first): when the turn of a
piece comes and both its ends are still borders, nothing has crossed them, so what has happened between them is what happens to the piece on
its own before its last merge; every piece of the vocabulary merges to itself (a test makes sure), so it is two
parts then. And if one of its ends is no border any more, it never will be again.

Borders are the bits of an integer for words of up to 60 bytes, else the characters of a string. The fold over a string is
quadratic in the word's length with a small factor, so words of more than FOLD_BYTES bytes (16 KiB without a space)
are merged by the same rule with a heap, in an Arrow UDF.
"""

from __future__ import annotations

import base64
import functools
import heapq
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.runtime import staged

#: Where the vocabulary lies unless a path is given.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
FOLD_BYTES = 1 << 14
BUCKETS = 1 << 14
#: Words of up to so many bytes have their borders in one integer.
BITS = 60

#: The public pattern that splits text before the merges, and the Unicode white space that its \s stands for.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
JVM_PATTERN = PATTERN.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")


@functools.lru_cache(4)
def load_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in lines if line.strip())}


@functools.lru_cache(4)
def _rank_json(path: str) -> tuple[str, str]:
    buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    reach = [1] * 65_536
    for piece, rank in load_ranks(path).items():
        key = piece.decode("latin-1")
        buckets[zlib.crc32(key.encode()) % BUCKETS][key] = rank
        if len(piece) > 1:
            pair = piece[0] * 256 + piece[1]
            reach[pair] = max(reach[pair], len(piece))
    return json.dumps(buckets), json.dumps(reach)


def rank_literal(path: str) -> Column:
    """A struct of ranks, array<map<string, int>>, in which bucket b has the pieces (one character per byte) whose CRC-32 is b
    modulo BUCKETS; and of reach, array<int>, the length of the longest piece that begins with two bytes."""
    ranks, reach = _rank_json(path)
    return F.struct(F.from_json(F.lit(ranks), "array<map<string,int>>").alias("ranks"), F.from_json(F.lit(reach), "array<int>").alias("reach"))


def _bind(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _rank_of(ranks: Column, piece: Column) -> Column:
    """The rank of a piece given as one character per byte, or null."""
    return F.try_element_at(F.element_at(ranks, (F.crc32(piece.cast("binary")) % BUCKETS + 1).cast("int")), piece)


def _shift(left: bool, value: Column, by: Column) -> Column:
    return F.call_function("shiftleft" if left else "shiftright", value, by)


def _stretches(vocabulary: Column, word: Column, size: Column, codes: Column) -> Column:
    """All stretches of a word that are pieces, in order of rank and place: rank, start and length packed into a number."""
    none = F.array().cast("array<bigint>")

    def at(start: Column) -> Column:
        pair = F.element_at(codes, start) * 256 + F.element_at(codes, start + 1)
        longest = F.least(F.element_at(vocabulary["reach"], pair + 1), size - start + 1)
        packed = lambda n: _rank_of(vocabulary["ranks"], F.substring(word, start, n)).cast("bigint") * F.lit(1 << 40) + start.cast("bigint") * F.lit(1 << 20) + n
        return F.when(longest >= 2, F.transform(F.sequence(F.lit(2), F.greatest(longest, F.lit(2))), packed)).otherwise(none)

    found = F.transform(F.sequence(F.lit(1), F.greatest(size - 1, F.lit(1))), at)
    return F.when(size > 1, F.sort_array(F.array_compact(F.flatten(found)))).otherwise(none)


def _place(stretch: Column) -> tuple[Column, Column]:
    """Start (from 0) and length of a packed stretch."""
    low = F.lit((1 << 20) - 1)
    return _shift(False, stretch, F.lit(20)).bitwiseAND(low).cast("int") - 1, stretch.bitwiseAND(low).cast("int")


def _borders_in_bits(stretches: Column, size: Column) -> Column:
    """Starts of the parts of a word of at most BITS bytes."""
    one = F.lit(1).cast("bigint")

    def step(borders: Column, stretch: Column) -> Column:
        start, n = _place(stretch)
        here = _shift(False, borders, start)
        whole = (here.bitwiseAND(F.lit(1)) == 1) & (_shift(False, here, n).bitwiseAND(F.lit(1)) == 1)
        within = _shift(True, _shift(True, one, n - 1) - 1, start + 1)
        return F.when(whole, borders.bitwiseAND(F.bitwise_not(within))).otherwise(borders)

    folded = F.aggregate(stretches, _shift(True, one, size + 1) - 1, step)
    return _bind(folded, lambda borders: F.filter(F.sequence(F.lit(0), size - 1), lambda i: _shift(False, borders, i).bitwiseAND(F.lit(1)) == 1))


def _borders_in_text(stretches: Column, size: Column) -> Column:
    """Starts of the parts of a word of any length."""

    def step(borders: Column, stretch: Column) -> Column:
        start, n = _place(stretch)
        whole = (F.substring(borders, start + 1, F.lit(1)) == "1") & (F.substring(borders, start + n + 1, F.lit(1)) == "1")
        return F.when(whole, F.overlay(borders, F.repeat(F.lit("0"), n - 1), start + 2)).otherwise(borders)

    folded = F.aggregate(stretches, F.repeat(F.lit("1"), size + 1), step)
    return _bind(folded, lambda borders: F.filter(F.sequence(F.lit(0), size - 1), lambda i: F.substring(borders, i + 1, F.lit(1)) == "1"))


def fold_ids(word: Column, vocabulary: Column) -> Column:
    """Ids of a word (binary, not empty) by folding ranked merges over its byte array."""

    def whole(v: Column) -> Column:
        def of(w: Column) -> Column:
            size = F.length(w)
            codes = F.transform(F.sequence(F.lit(1), size), lambda i: F.ascii(F.substring(w, i, F.lit(1))))

            def parts(found: Column) -> Column:
                starts = F.when(size <= BITS, _borders_in_bits(found, size)).otherwise(_borders_in_text(found, size))
                return _bind(starts, lambda s: F.transform(s, lambda x, k: _rank_of(v["ranks"], F.substring(w, x + 1, F.coalesce(F.get(s, k + 1), size) - x))))

            return _bind(_bind(codes, lambda c: _stretches(v, w, size, c)), parts)

        return F.when(word.isNotNull(), _bind(F.decode(word, "ISO-8859-1"), of))

    return _bind(vocabulary, whole)


def heap_ids(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word by the same rule, in time n log n: a heap of pairs over a linked list of parts."""
    n = len(word)
    ends = list(range(1, n + 1))  # part i is word[i:ends[i]]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(ranks[word[i : i + 2]], i, i + 2) for i in range(n - 1) if word[i : i + 2] in ranks]
    heapq.heapify(heap)
    alive = bytearray(b"\1") * n

    def push(i: int) -> None:
        j = after[i]
        if j < n and (rank := ranks.get(word[i : ends[j]])) is not None:
            heapq.heappush(heap, (rank, i, ends[j]))

    while heap:
        _, i, end = heapq.heappop(heap)
        if not alive[i] or after[i] >= n or ends[after[i]] != end:
            continue
        j = after[i]
        alive[j], ends[i], after[i] = 0, end, after[j]
        if after[i] < n:
            before[after[i]] = i
        push(i)
        if before[i] >= 0:
            push(before[i])
    return [ranks[word[i : ends[i]]] for i in range(n) if alive[i]]


def _long_ids(ranks: dict[bytes, int]):
    @F.pandas_udf("array<int>")
    def encode(words: pd.Series) -> pd.Series:
        return pd.Series([None if w is None else heap_ids(bytes(w), ranks) for w in words])

    return encode


def dictionary(words: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """word, ids and n (occurrences) of each distinct word."""
    spark = words.sparkSession
    # a small table of costly rows: spread over all cores, which its size in bytes would not do
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).repartition(tasks, "word")
    piece, size = F.col("word").cast("binary"), F.octet_length("word")
    folded = fold_ids(F.when(size <= FOLD_BYTES, piece), rank_literal(path))
    found = counted.select("word", "n", folded.alias("ids"))
    # the few words beyond the fold's length, if any: their ids, else null
    return found.withColumn("ids", F.coalesce("ids", _long_ids(load_ranks(path))(F.when(size > FOLD_BYTES, piece)))) if _has_long(words) else found


def _has_long(words: DataFrame) -> bool:
    return not words.where(F.octet_length("word") > FOLD_BYTES).isEmpty()


def _lists(counts: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())


def _looked_up(documents: DataFrame, doc_id: str, text: str, path: str, keep: list[str]) -> DataFrame:
    """Written once: _doc, _key (the text's hash), keep columns, base (a word's id, or -1) and pending (pos and word of those)."""
    words = F.regexp_extract_all(F.col(f"`{text}`"), F.lit(JVM_PATTERN), F.lit(0))
    rows = documents.select(F.col(f"`{doc_id}`").alias("_doc"), F.xxhash64(F.col(f"`{text}`")).alias("_key"), *(F.col(f"`{c}`") for c in keep), words.alias("_words"))
    pieces: dict[str, int] = {}
    for piece, rank in load_ranks(path).items():  # goes to the executors with the job: its size is the vocabulary's
        try:
            pieces[piece.decode()] = rank
        except UnicodeDecodeError:  # no word is part of a character
            pass

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, ids = pa.array(list(pieces), pa.string()), np.fromiter(pieces.values(), np.int32)
        for batch in batches:
            listed = batch.column(batch.num_columns - 1)
            counts = pc.list_value_length(listed).fill_null(0).to_numpy(zero_copy_only=False)
            flat = listed.flatten()
            at = pc.index_in(flat, value_set=names)
            missing = np.flatnonzero(at.is_null().to_numpy(zero_copy_only=False))
            base = ids[at.fill_null(0).to_numpy(zero_copy_only=False)] if len(flat) else np.empty(0, np.int32)
            base[missing] = -1
            row = np.repeat(np.arange(len(counts)), counts)[missing]
            starts = np.cumsum(counts) - counts
            pending = pa.StructArray.from_arrays([pa.array((missing - starts[row]).astype(np.int32)), flat.take(pa.array(missing)).cast(pa.string())], ["pos", "word"])
            lists = [pa.ListArray.from_arrays(_lists(counts), pa.array(base)), pa.ListArray.from_arrays(_lists(np.bincount(row, minlength=len(counts))), pending)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *lists], names=[*batch.schema.names[:-1], "base", "pending"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return staged(rows.mapInArrow(over, f"{kept}, base array<int>, pending array<struct<pos: int, word: string>>"), "words")


def _put_together(batch: pa.RecordBatch, words: pa.Array, known: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of ids per row, and all ids, from base, pending (looked up in words, whose ids are known) and parts."""
    base, pending, parts = (batch.column(batch.schema.get_field_index(c)) for c in ("base", "pending", "parts"))
    length = lambda c: pc.list_value_length(c).fill_null(0).to_numpy(zero_copy_only=False)
    counts = length(base)
    starts = np.cumsum(counts) - counts
    flat = base.flatten().to_numpy(zero_copy_only=False)
    lengths = (flat >= 0).astype(np.int64)
    sources = []

    def place(column: pa.Array, of: pa.ListArray, which: np.ndarray, chosen: np.ndarray) -> None:
        rows = np.repeat(np.arange(len(counts)), length(column))[chosen]
        spots = starts[rows] + column.flatten().field("pos").to_numpy(zero_copy_only=False)[chosen]
        sizes = length(of)[which]
        lengths[spots] = sizes
        sources.append((spots, of.flatten().to_numpy(zero_copy_only=False), (np.cumsum(length(of)) - length(of))[which], sizes))

    at = pc.index_in(pending.flatten().field("word"), value_set=words)
    hit = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
    if len(hit):
        place(pending, known, at.fill_null(0).to_numpy(zero_copy_only=False)[hit], hit)
    if len(parts.flatten()):
        ids = parts.flatten().field("ids")
        place(parts, ids, np.arange(len(ids)), np.arange(len(ids)))
    if len(lengths) and not lengths.all():
        raise ValueError("a word without ids")
    ends = np.cumsum(lengths)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
    out[(ends - lengths)[flat >= 0]] = flat[flat >= 0]
    for spots, values, begins, sizes in sources:
        step = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        out[np.repeat((ends - lengths)[spots], sizes) + step] = values[np.repeat(begins, sizes) + step]
    per_row = np.concatenate([[0], ends])[np.cumsum(counts)] - np.concatenate([[0], ends])[starts]
    return per_row, out


def _encoded(documents: DataFrame, doc_id: str, text: str, path: str, frequent: int, keep: list[str], count_only: bool) -> DataFrame:
    """_doc, keep columns, and ids or n_tokens."""
    rows = _looked_up(documents, doc_id, text, path, keep)
    known = staged(dictionary(rows.select(F.inline("pending")).select("word"), path), "dictionary")
    top = known.where(F.octet_length("word") <= 128).orderBy(F.desc("n"), "word").limit(frequent)  # at most 128 bytes each
    table = [(r.word, list(r.ids)) for r in top.select("word", "ids").collect()]
    often = documents.sparkSession.createDataFrame([(w,) for w, _ in table], "word string")
    occurrences = rows.select("_doc", "_key", F.inline("pending")).join(F.broadcast(often), "word", "left_anti")
    parts = occurrences.join(known.select("word", "ids"), "word").groupBy("_doc", "_key").agg(F.collect_set(F.struct("pos", "ids")).alias("parts"))
    parts = parts.withColumnsRenamed({"_doc": "_d", "_key": "_k"})
    once = rows.dropDuplicates(["_doc", "_key"])
    whole = once.join(parts, F.col("_doc").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_k")), "left").select("_doc", *(F.col(f"`{c}`") for c in keep), "base", "pending", "parts")

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, ids = pa.array([w for w, _ in table], pa.string()), pa.array([i for _, i in table], pa.list_(pa.int32()))
        for batch in batches:
            per_row, out = _put_together(batch, words, ids)
            made = pa.array(per_row, pa.int64()) if count_only else pa.ListArray.from_arrays(_lists(per_row), pa.array(out))
            yield pa.RecordBatch.from_arrays([*batch.columns[: 1 + len(keep)], made], names=[*batch.schema.names[: 1 + len(keep)], "n_tokens" if count_only else "ids"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in whole.schema.fields[: 1 + len(keep)])
    return whole.mapInArrow(over, f"{kept}, {'n_tokens bigint' if count_only else 'ids array<int>'}")


def encode(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = VOCABULARY, frequent: int = 20_000) -> DataFrame:
    """doc_id and ids (array<int>), one row per document; special tokens' strings are ordinary text.

    Defined results: null and empty texts get an empty list; any other text, however long, gets the ids of its
    whole; doc_id should be unique: repeated rows give one row, different texts of one doc_id (or of null) a row each;
    other columns are ignored, whatever their names. An empty table gives an empty result. frequent: how many of the
    words that are no pieces are looked up without a shuffle (a matter of speed, not of results).
    """
    return _encoded(documents, doc_id, text, path, frequent, [], False).withColumnRenamed("_doc", doc_id)


def count_tokens(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = VOCABULARY, frequent: int = 20_000, keep: list[str] | None = None) -> DataFrame:
    """doc_id, the columns to keep and n_tokens of each document with a text; repeated rows give one row, as in encode()."""
    return _encoded(documents, doc_id, text, path, frequent, keep or [], True).where("n_tokens > 0").withColumnRenamed("_doc", doc_id)


def decode(encoded: DataFrame, ids: str = "ids", path: str = VOCABULARY, into: str = "text") -> DataFrame:
    """encoded with the column into: the text of the pieces of ids, put together as bytes. Null ids give null."""
    pieces = {rank: piece.hex() for piece, rank in load_ranks(path).items()}
    literal = F.from_json(F.lit(json.dumps([pieces.get(i, "") for i in range(max(pieces) + 1)])), "array<string>")
    joined = _bind(literal, lambda p: F.array_join(F.transform(F.col(f"`{ids}`"), lambda i: F.element_at(p, i + 1)), ""))
    return encoded.withColumn(into, F.decode(F.unhex(joined), "UTF-8"))
