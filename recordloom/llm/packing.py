"""Hierarchical multi-length packing: documents are routed to context-size tiers, each tier is packed, gaps of long windows
are filled from shorter tiers, and equal token counts make up a step group."""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, pick, table, text_bytes

CONTEXT = 2048
TIERS = (256, 512, 1024, 2048)
#: A tier is packed when it holds so many windows' worth of tokens.
WAITING = 32
#: Tokens of a step group, a multiple of the longest context.
STEP_TOKENS = 16 * CONTEXT
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
#: Words whose ids a worker remembers at most, and their characters; bytes of text worked on at once.
MOST_WORDS, MOST_CHARS, BLOCK = 500_000, 1 << 24, 1 << 19
FIELDS = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, context int, step_group long"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordIds:
    """Token ids as little-endian unsigned 32-bit bytes. The vocabulary drops white space and never joins over it, so the
    ids of a text are those of its words, and words that come again are looked up.

    A new word of printable Latin-1 characters goes to the tokenizer's model alone: for these, normalizing is
    lower-casing, and splitting takes runs of letters, single digits and runs of the rest. All others take the whole
    tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread: Spark's tasks are the parallelism
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the rest follow from 256 on
        self.letter = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in plain)}
        self.forget()

    def forget(self) -> None:
        self.words: dict[str, bytes] = {"": b""}
        self.chars = 0

    def part(self, part: str) -> bytes:
        """ids of what splitting leaves whole; a word of it alone has the same, so both are remembered together."""
        found = self.words.get(part)
        if found is None:
            spelled = part if part.isascii() else "".join(map(self.letter.__getitem__, part.encode()))
            found = self.words[part] = array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()
        return found

    def word(self, word: str) -> bytes:
        if not word.isprintable() or max(word) > "\xff" or "<|" in word:
            return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        word = word.lower()
        return self.part(word) if word.isalpha() else b"".join(map(self.part, self.split(word)))

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [t.replace("\n", " ").split(" ") for t in texts]
        if len(self.words) > MOST_WORDS or self.chars > MOST_CHARS:
            self.forget()
        for word in set().union(*split) - self.words.keys():
            self.words[word] = self.word(word)
            self.chars += len(word)
        return [b"".join(map(self.words.__getitem__, words)) for words in split]


_loaded: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    return _loaded[path]


class Packer:
    """Packs pieces (doc_id, doc_tokens, start, ids as bytes) into sequences whose lengths are tiers, or at the end powers
    of two: no padding is needed. Memory: WAITING windows of each tier."""

    def __init__(self, first_id: int):
        self.next_id, self.first_id = first_id, first_id
        self.waiting: dict[int, list] = {t: [] for t in TIERS}
        self.tokens = dict.fromkeys(TIERS, 0)
        self.groups: dict[int, list[int]] = {}
        self.group_id = first_id

    def sequence(self, pieces: list) -> list[tuple]:
        length = sum(len(p[3]) // 4 for p in pieces)
        group = self.groups.setdefault(length, [self.group_id, 0])
        if group[1] == 0:
            group[0], self.group_id = self.group_id, self.group_id + 1
        group[1] = (group[1] + length) % STEP_TOKENS
        rows, at = [], 0
        for doc, total, start, ids in pieces:
            rows.append((doc, start, len(ids) // 4, ids, total, self.next_id, at, length, group[0]))
            at += len(ids) // 4
        self.next_id += 1
        return rows

    def wait(self, piece) -> None:
        n = len(piece[3]) // 4
        tier = next(t for t in TIERS if n <= t)
        self.waiting[tier].append(piece)
        self.tokens[tier] += n

    def add(self, doc, ids: bytes) -> Iterator[list[tuple]]:
        total, at, size = len(ids) // 4, 0, 4 * CONTEXT
        while len(ids) - at >= size:  # whole windows need no packing
            yield self.sequence([(doc, total, at // 4, ids[at : at + size])])
            at += size
        if at < len(ids):
            self.wait((doc, total, at // 4, ids[at:]))
        for tier in TIERS:
            if self.tokens[tier] >= WAITING * tier:
                yield from self.pack(tier)

    def pack(self, tier: int) -> Iterator[list[tuple]]:
        """Best fit, longest first; then gaps are filled from shorter tiers, cutting the last filler; the shortest tier fills its own."""
        pieces = sorted(self.waiting[tier], key=lambda p: -len(p[3]))
        self.waiting[tier], self.tokens[tier] = [], 0
        bins: list[list] = []  # [gap, pieces]
        for p in pieces:
            n = len(p[3]) // 4
            fits = [b for b in bins if b[0] >= n]
            b = min(fits, key=lambda b: b[0]) if fits else None
            if b is None:
                bins.append(b := [tier, []])
            b[0] -= n
            b[1].append(p)
        bins.sort(key=lambda b: b[0])
        while bins:
            gap, own = bins.pop(0)
            while gap:
                source = next((t for t in reversed(TIERS) if t < tier and self.waiting[t]), None)
                if source:
                    p = self.waiting[source].pop()
                    self.tokens[source] -= len(p[3]) // 4
                elif bins:  # no shorter piece waits: the emptiest window gives its pieces
                    p = bins[-1][1].pop()
                    bins[-1][0] += len(p[3]) // 4
                    if not bins[-1][1]:
                        bins.pop()
                else:
                    break
                doc, total, start, ids = p
                n = min(gap, len(ids) // 4)
                own.append((doc, total, start, ids[: 4 * n]))
                gap -= n
                if 4 * n < len(ids):
                    self.wait((doc, total, start + n, ids[4 * n :]))
            if gap:
                for p in own:
                    self.wait(p)
            else:
                yield self.sequence(own)

    def finish(self) -> Iterator[list[tuple]]:
        """What waits still, longest tier first, in whole windows and then in powers of two."""
        left = [p for t in reversed(TIERS) for p in self.waiting[t]]
        self.waiting = {t: [] for t in TIERS}
        total = sum(len(p[3]) // 4 for p in left)
        while total:
            need = size = min(CONTEXT, 1 << (total.bit_length() - 1))
            own = []
            while need:
                doc, tokens, start, ids = left.pop(0)
                n = min(need, len(ids) // 4)
                own.append((doc, tokens, start, ids[: 4 * n]))
                if 4 * n < len(ids):
                    left.insert(0, (doc, tokens, start + n, ids[4 * n :]))
                need -= n
            total -= size
            yield self.sequence(own)


def pack_documents(docs: DataFrame, *, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset,
    context (the sequence's length) and step_group.

    A document is its ids and the end id; a null or empty text is the end id alone. Every id lies in one piece. Pieces of
    a sequence follow each other without a gap, and every sequence is as long as a tier or a power of two, so none is
    padded. Step groups hold sequences of one length and STEP_TOKENS tokens, but for the last ones of a task.
    Each task packs its own input rows as they stream by, so no row is shuffled and a lost task is packed again
    alike. Null and repeated ids are documents like any other; other columns are not read, whatever their names; no rows give no rows.
    Pieces of equal lengths are packed in the order in which they come. A very long text is cut into whole windows. Memory: BLOCK
    bytes of text or one longer text, WAITING windows of each tier, and words remembered up to MOST_WORDS and MOST_CHARS.
    """
    path = path or vocabulary_path()
    schema = pa.schema([(f.split()[0], {"long": pa.int64(), "binary": pa.binary(), "int": pa.int32()}[f.split()[1]]) for f in FIELDS.split(", ")])

    def run(batches):
        ids, packer, rows, held = word_ids(path), Packer((TaskContext.get().partitionId() if TaskContext.get() else 0) << 33), [], 0
        end = np.array([END_ID], "<u4").tobytes()

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            docs_ = batch.column(0).to_pylist()
            _, off = text_bytes(batch.column(1))
            for at, to in blocks(off, BLOCK):
                texts = [x or "" for x in batch.column(1).slice(at, to - at).to_pylist()]
                for doc, got in zip(docs_[at:to], ids.encode(texts)):
                    for sequence in packer.add(doc, got + end):
                        rows += sequence
                        held += sequence[-1][6] + sequence[-1][2]
                    if held > 1 << 20:
                        yield flush()
                        rows.clear()
                        held = 0
        for sequence in packer.finish():
            rows += sequence
        if rows:
            yield flush()

    return pick(docs, doc_id=(id_col, "long"), text=text_col).mapInArrow(run, FIELDS)


def digest(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "context", "step_group")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack_documents(table(spark, sf_dir, "documents")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of every document."""
    return digest(pack_documents(docs))
