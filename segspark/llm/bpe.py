"""Byte-pair encoding and decoding with a given vocabulary."""

from __future__ import annotations

import heapq
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segspark.llm.common import BoundedDict, documents, pieces, worker_cache

TOKENIZER = "word_bpe_49k.json"
#: The steps of the supported kind of tokenizer file.
NORMALIZERS = [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
#: A plain word: letters that every step leaves alone but for their case. Final ASCII marks after it are cut off.
LETTERS, MARKS = "[A-Za-zÀ-ÖØ-öø-ÿ]+", "[!-/:-@\\[-`{-~]+"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def splits_words(spec: dict) -> bool:
    """Whether the tokenizer file lower-cases, and cuts at white space and at the ends of letter runs."""
    steps = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}, {}])
    return (
        (spec.get("normalizer") or {}).get("normalizers") == NORMALIZERS
        and steps[0].get("pattern") == {"Regex": PATTERN} and steps[0].get("behavior") == "Removed" and steps[0].get("invert")
        and steps[-1].get("type") == "ByteLevel" and not steps[-1].get("add_prefix_space") and not steps[-1].get("use_regex")
        and not any(t[k] for t in spec["added_tokens"] for k in ("normalized", "single_word", "lstrip", "rstrip"))
    )


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


def merge_symbols(symbols: list[int], ranks: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Merges the neighbouring pair of least rank, leftmost first, until none is left.

    ``ranks``: pair of ids -> (rank, id of the merged symbol). The symbols are a doubly linked list; a queue
    holds each pair that was ever formed, and an entry whose symbols have changed since is skipped.
    """
    symbols, n = list(symbols), len(symbols)
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    queue = [(found[0], i, *pair, found[1]) for i, pair in enumerate(zip(symbols, symbols[1:])) if (found := ranks.get(pair))]
    heapq.heapify(queue)
    while queue:
        _, i, left, right, merged = heapq.heappop(queue)
        j = after[i]
        if symbols[i] != left or j < 0 or symbols[j] != right:
            continue
        symbols[i], symbols[j] = merged, -1
        after[i] = k = after[j]
        if k >= 0:
            before[k] = i
            if found := ranks.get((merged, symbols[k])):
                heapq.heappush(queue, (found[0], i, merged, symbols[k], found[1]))
        if (h := before[i]) >= 0 and (found := ranks.get((symbols[h], merged))):
            heapq.heappush(queue, (found[0], h, symbols[h], merged, found[1]))
    return [s for s in symbols if s >= 0]


class Vocabulary:
    """Encodes and decodes as the tokenizer file says; raises on a file of another kind."""

    def __init__(self, file: str):
        import regex

        with open(file) as f:
            spec = json.load(f)
        model = spec["model"]
        if not splits_words(spec) or model.get("end_of_word_suffix") != "</w>" or spec["decoder"] or spec["post_processor"]:
            raise ValueError(f"{file}: not a word-end BPE file")
        ids = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.ranks = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.inner = [ids.get(s) for s in byte_symbols()]
        self.final = [ids.get(s + "</w>") for s in byte_symbols()]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")" if self.added else "(?!)")
        self.cut = regex.compile(PATTERN)
        self.tokens = {i: t for t, i in (ids | self.added).items()}
        self.plain, self.marked = re.compile(LETTERS), re.compile(f"({LETTERS})({MARKS})")
        self.pieces = BoundedDict(self.encode_piece, 150_000)
        # Words in lower case: many more than pieces that come again, and each costs its merges.
        self.words = BoundedDict(self.encode_word, 400_000)

    def encode_word(self, word: str) -> bytes:
        data = word.encode()
        symbols = [self.inner[b] for b in data[:-1]] + [self.final[data[-1]]]
        return np.array(merge_symbols([s for s in symbols if s is not None], self.ranks), "<i4").tobytes()

    def encode_piece(self, piece: str) -> bytes:
        if found := self.marked.fullmatch(piece):
            return self.words[found[1].lower()] + self.pieces[found[2]]
        if self.plain.fullmatch(piece):
            return self.words[piece.lower()]
        out: list[bytes] = []
        for part in self.marks.split(piece):
            if part in self.added:
                out.append(np.array([self.added[part]], "<i4").tobytes())
            elif part:
                # Lower case character by character: no rule that looks at neighbours.
                plain = "".join(map(str.lower, unicodedata.normalize("NFC", part))) if not part.isascii() else part.lower()
                # Characters newer than Python's Unicode tables count as no letters; the tokenizers library differs
                # only for the letters and capitals of scripts that were added in the version after them.
                shape = plain if plain.isascii() else "".join("\ue000" if unicodedata.category(c) == "Cn" else c for c in plain)
                for found in self.cut.finditer(shape):
                    out.append(self.words[plain[found.start():found.end()]])
        return b"".join(out)

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian 32-bit integers. White space ends every token, so the text is encoded piece by piece."""
        return b"".join(map(self.pieces.__getitem__, pieces(text)))

    def decode(self, ids: list[int]) -> str:
        """The vocabulary's strings in order, one space between; ids that it lacks are left out."""
        get = self.tokens.get
        return " ".join([t for t in map(get, ids) if t is not None])


def _of_worker(file: str) -> Vocabulary:
    return worker_cache(f"vocabulary {file}", lambda: Vocabulary(file))


def bpe_encode(text: Column | str, file: str) -> Column:
    """Ids of a text as array<int>, as the tokenizer file gives them without special tokens added; null or empty: no ids."""

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        vocabulary = _of_worker(file)
        rows = [vocabulary.encode(t.as_py()) for t in texts]
        ends = np.cumsum([0, *(len(r) // 4 for r in rows)], dtype="<i8")
        values = pa.array(np.frombuffer(b"".join(rows), "<i4"))
        return pa.ListArray.from_arrays(pa.array(ends.astype("<i4")), values)

    return encode(text)


def bpe_decode(ids: Column | str, file: str) -> Column:
    """Text of ids: their vocabulary strings joined by spaces; null or no ids: empty; unknown ids and nulls are left out."""

    @F.arrow_udf("string")
    def decode(rows: pa.Array) -> pa.Array:
        vocabulary = _of_worker(file)
        return pa.array([vocabulary.decode(r.values.to_numpy(zero_copy_only=False).tolist() if r.is_valid else []) for r in rows], pa.string())

    return decode(ids)


def encode_documents(docs: DataFrame, file: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds (or replaces) column ``ids``; all other columns stay. No shuffle, one text in memory beside its batch."""
    return docs.withColumn(ids, bpe_encode(F.col(text), file))


def q_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    file = tokenizer_path(TOKENIZER)
    coded = encode_documents(documents(spark, sf_dir).select("doc_id", "text"), file)
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(bpe_decode("ids", file).cast("binary"), 256).alias("decoded_sha256"))


QUERIES = {"op2_bpe_round_trip": (q_bpe, None)}
