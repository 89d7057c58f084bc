"""SentencePiece encoding and decoding: the N best segmentations over the piece lattice, by a forward Viterbi pass whose
scores are exact heuristics for a backward A-star search.

A text is "▁" + text with each space as "▁", and the score of a segmentation is the sum of its pieces' scores. No piece joins
"▁" to something before it, or holds a line end, so the lattice falls apart into words: the best segmentations of a text are those of its words,
and the next best change the few words that lose least.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, pick, table, text_bytes

MODEL = "piece_bpe_32k.model"
#: Segmentations of each text.
N_BEST = 4
SPACE = "▁"
#: Words that a worker remembers at most.
MOST_WORDS = 200_000
#: Characters of remembered words at most; bytes of text worked on at once.
MOST_CHARS, BLOCK = 1 << 24, 1 << 19
#: Characters of a word that is worked on together with others.
LONG = 32
#: What the lattice falls apart into: words, and line ends, which have no piece.
WORD = re.compile("▁+[^▁\n]*|\n|[^▁\n]+")


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Numbers(dict):
    """Numbers words in the order of their first look-up; new are those looked up since it was emptied."""

    def __init__(self):
        super().__init__()
        self.chars, self.new = 0, []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.chars += len(word)
        self.new.append(word)
        return n


def ragged(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Places start, start + 1, ... of each run of count, one run after the other."""
    end = np.cumsum(count)
    return np.arange(end[-1] if len(end) else 0) + np.repeat(start - (end - count), count)


class Pieces:
    """The pieces of a model file with their scores. A character without a piece is its UTF-8 bytes, at a score ten below the worst."""

    def __init__(self, path: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        rows = [(k, m.id_to_piece(k), m.get_score(k)) for k in range(m.get_piece_size()) if not (m.is_control(k) or m.is_unknown(k) or m.is_byte(k) or m.is_unused(k))]
        bytes_of = {k: int(m.id_to_piece(k)[3:-1], 16) for k in range(m.get_piece_size()) if m.is_byte(k)}
        self.setup([(k, p, s) for k, p, s in rows], bytes_of)

    @classmethod
    def of(cls, rows: list[tuple[int, str, float]], bytes_of: dict[int, int]) -> Pieces:
        """From (id, piece, score) and the bytes of byte ids, without a model file."""
        self = cls.__new__(cls)
        self.setup(rows, bytes_of)
        return self

    def setup(self, rows, bytes_of) -> None:
        if any(re.search("[^▁]▁|\n", p) for _, p, _ in rows):
            raise ValueError("a piece joins words or lines: the lattice does not fall apart there")
        #: (score, ids) of a piece, None for what only begins one.
        self.entry: dict[str, tuple | None] = {}
        for _, p, _ in rows:
            for k in range(1, len(p)):
                self.entry.setdefault(p[:k], None)
        for k, p, s in rows:
            self.entry[p] = (float(s), (k,))
        self.byte_id = {b: k for k, b in bytes_of.items()}
        self.unknown = min((s for _, _, s in rows if s > -1e8), default=0.0) - 10
        raw = {k: p.replace(SPACE, " ").encode() for k, p, _ in rows} | {k: bytes([b]) for k, b in bytes_of.items()}
        spelled = [raw.get(k, b"") for k in range(max(raw, default=-1) + 1)]
        self.raw = np.frombuffer(b"".join(spelled), np.uint8)
        self.raw_size = np.fromiter(map(len, spelled), np.int64, len(spelled))
        self.raw_start = np.cumsum(self.raw_size) - self.raw_size
        self.forget()
        self.tables()

    def forget(self) -> None:
        """Words are numbered as they come; by number: where their ids are in flat, score, loss of the next best."""
        self.number = Numbers()
        self.flat = np.zeros(0, np.uint32)
        self.start, self.count, self.score, self.loss = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
        self.options: dict[str, list] = {}
        self.option_chars = 0

    def tables(self) -> None:
        """The pieces as a trie in arrays: a character's class, and for a sorted key of node and class the next node."""
        alphabet = sorted({c for p in self.entry for c in p if ord(c) < 1 << 16})
        self.kind = np.zeros(1 << 16, np.int64)
        for k, c in enumerate(alphabet, 1):
            self.kind[ord(c)] = k if self.entry.get(c) else 0  # without a piece of its own it needs bytes: the plain way
        self.spelled = re.compile("[" + "".join(map(re.escape, (c for c in alphabet if self.kind[ord(c)]))) + "]+").fullmatch
        self.kinds = len(alphabet) + 1
        node, steps = {"": 0}, []
        for p in sorted(self.entry, key=len):
            if all(ord(c) < 1 << 16 and self.kind[ord(c)] for c in p):
                node[p] = len(node)
                steps.append((node[p[:-1]] * self.kinds + int(self.kind[ord(p[-1])]), node[p]))
        steps.sort()
        self.step_key = np.array([k for k, _ in steps] + [2**62], np.int64)
        self.step_to = np.array([v for _, v in steps] + [0], np.int64)
        self.node_score, self.node_id = np.full(len(node), -np.inf), np.zeros(len(node), np.int64)
        for p, k in node.items():
            if p and self.entry[p]:
                self.node_score[k], (self.node_id[k],) = self.entry[p]
        self.longest = max(map(len, self.entry), default=1)

    def many(self, words: list[str]):
        """(places in words, ids one word after the other, their numbers, scores, losses): word() of words of at most LONG
        characters that all have pieces, position by position for many words at once."""
        order = sorted(range(len(words)), key=lambda k: len(words[k]))
        words = [words[k] for k in order]
        for lo in range(0, len(words), 4096):
            part = words[lo : lo + 4096]
            w, size = len(part), np.fromiter(map(len, part), np.int64, min(4096, len(words) - lo))
            n, longest = int(size[-1]), min(self.longest, int(size[-1]))
            kind = np.zeros((w, n), np.int64)
            kind[np.arange(n) < size[:, None]] = self.kind[np.frombuffer("".join(part).encode("utf-16-le"), np.uint16)]
            # score and node of the piece that ends at t and has k + 1 characters less than the longest
            score = np.full((n + 1, longest, w), -np.inf)
            named = np.zeros((n + 1, longest, w), np.int32)
            row, at = np.nonzero(kind)
            node = np.zeros(len(row), np.int64)
            for k in range(longest):
                inside = at + k < n
                row, at, node = row[inside], at[inside], node[inside]
                key = node * self.kinds + kind[row, at + k]
                found = np.searchsorted(self.step_key, key)
                hit = self.step_key[found] == key
                row, at, node = row[hit], at[hit], self.step_to[found[hit]]
                score[at + k + 1, longest - 1 - k, row] = self.node_score[node]
                named[at + k + 1, longest - 1 - k, row] = node
            best = np.full((n + 1 + longest, w), -np.inf)  # position t is at t + longest
            best[longest] = 0
            chosen, gap = np.zeros((n + 1, w), np.int64), np.full((n + 1, w), np.inf)
            every = np.arange(w)
            for t in range(1, n + 1):
                value = best[t : t + longest] + score[t]
                pick_ = value.argmax(axis=0)  # of equal ones the longest piece, the smallest start
                top = value[pick_, every]
                value[pick_, every] = -np.inf
                with np.errstate(invalid="ignore"):
                    gap[t] = top - value.max(axis=0)
                best[t + longest], chosen[t] = top, pick_
            total, loss = best[size + longest, every], np.full(w, np.inf)
            where, ids, piece_of = size.copy(), [], []
            live = every
            while len(live):
                t = where[live]
                loss[live] = np.fmin(loss[live], gap[t, live])
                k = chosen[t, live]
                ids.append(self.node_id[named[t, k, live]])
                piece_of.append(live)
                where[live] = t - (longest - k)
                live = live[where[live] > 0]
            count = np.bincount(np.concatenate(piece_of), minlength=w)
            flat, end = np.zeros(int(count.sum()), np.uint32), np.cumsum(count)
            for k, (own, got) in enumerate(zip(piece_of, ids)):  # from the last piece back
                flat[end[own] - 1 - k] = got
            yield order[lo : lo + 4096], flat, count, total, loss

    def lattice(self, s: str) -> tuple[list[float], list[list]]:
        """The forward Viterbi score of each position, and the edges (start, score, ids) that end there."""
        entry, n = self.entry, len(s)
        best, into = [0.0] + [-np.inf] * n, [[] for _ in range(n + 1)]
        for i in range(n):
            b, j = best[i], i + 1
            e = entry.get(s[i:j], 0)
            if not e:  # no piece of one character: bytes
                into[j].append((i, self.unknown, tuple(self.byte_id[x] for x in s[i].encode("utf-8", "surrogatepass"))))
                best[j] = max(best[j], b + self.unknown)
            while e != 0:
                if e:
                    into[j].append((i, e[0], e[1]))
                    v = b + e[0]
                    if v > best[j]:
                        best[j] = v
                j += 1
                if j > n:
                    break
                e = entry.get(s[i:j], 0)
        return best, into

    def n_best(self, s: str, n: int) -> list[tuple[float, tuple]]:
        """The n best segmentations (score, ids) of a string, best first. Ties: that of the longer last differing piece first."""
        best, into = self.lattice(s)
        heap, count, out = [(-best[-1], len(s), 0, 0.0, ())], 0, []
        while heap and len(out) < n:
            f, at, _, done, tail = heapq.heappop(heap)
            if at == 0:
                ids, link = [], tail
                while link:
                    ids += link[0]
                    link = link[1]
                out.append((-f, tuple(ids)))
                continue
            for i, score, ids in into[at]:
                count += 1
                g = done + score
                heapq.heappush(heap, (-(g + best[i]), i, count, g, (ids, tail)))
        return out

    def word(self, s: str) -> tuple[list[int], float, float]:
        """ids of the best segmentation, its score, and how much less the next best has: the best entry that A-star's
        first descent leaves in its queue."""
        best, into = self.lattice(s)
        at, ids, done, second = len(s), [], 0.0, -np.inf
        while at:
            edges = into[at]
            values = [done + e[1] + best[e[0]] for e in edges]
            top = values.index(max(values)) if len(values) > 1 else 0
            # of equal values the search takes the smallest start
            for k, v in enumerate(values):
                if k != top and v == values[top] and edges[k][0] < edges[top][0]:
                    top = k
            for k, v in enumerate(values):
                if k != top and v > second:
                    second = v
            i, score, piece = edges[top]
            ids.append(piece)
            done += score
            at = i
        return [x for piece in reversed(ids) for x in piece], best[-1], best[-1] - second

    def numbers(self, words: list[str]) -> np.ndarray:
        """The numbers of words; what is new is segmented. More than MOST_WORDS or MOST_CHARS are forgotten before the next call."""
        if len(self.number) > MOST_WORDS or self.number.chars > MOST_CHARS:
            self.forget()
        out = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        new, self.number.new = self.number.new, []
        if new:
            done = len(self.number) - len(new)
            start, count, score, loss = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64), np.zeros(len(new)), np.zeros(len(new))
            flats, size = [self.flat], len(self.flat)
            together = [k for k, w in enumerate(new) if len(w) <= LONG and self.spelled(w)]
            for at, flat, n, total, lost in self.many([new[k] for k in together]):
                k = np.array(together)[at]
                start[k], count[k], score[k], loss[k] = size + np.cumsum(n) - n, n, total, lost
                flats.append(flat)
                size += len(flat)
            for k in sorted(set(range(len(new))) - set(together)):
                ids, score[k], loss[k] = self.word(new[k])
                start[k], count[k] = size, len(ids)
                flats.append(np.array(ids, np.uint32))
                size += len(ids)
            self.flat = np.concatenate(flats)
            self.start, self.count, self.score, self.loss = (np.concatenate([old[:done], x]) for old, x in ((self.start, start), (self.count, count), (self.score, score), (self.loss, loss)))
        return out

    def choices(self, w: str, n: int) -> list:
        if len(self.options) > MOST_WORDS // 10 or self.option_chars > MOST_CHARS:
            self.options, self.option_chars = {}, 0
        if (w, n) not in self.options:
            self.options[w, n] = self.n_best(w, n)
            self.option_chars += len(w)
        return self.options[w, n]

    def segmentations(self, texts: list[str], n: int = N_BEST) -> tuple[np.ndarray, np.ndarray, list[list]]:
        """The ids of the best segmentations of texts one after the other, how many each has, and (score, edits) of the n best
        of each. An edit (at, drop, ids) replaces drop ids of the best from at on. Ties go to the change that comes earlier in the text."""
        split = [WORD.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        number = self.numbers([w for words in split for w in words])
        count, loss, score = self.count[number], self.loss[number], self.score[number]
        ids = self.flat[ragged(self.start[number], count)]
        sizes, out, at = [], [], 0
        for words in split:
            own = slice(at, at + len(words))
            at += len(words)
            end = np.cumsum(count[own])
            sizes.append(int(end[-1]) if words else 0)
            if not words:
                out.append([])
                continue
            lost = loss[own]
            near = np.flatnonzero(lost <= (np.partition(lost, n - 2)[n - 2] if len(lost) > n - 1 > 0 else np.inf))
            near = near[np.isfinite(lost[near])]
            near = np.sort(near[np.argsort(lost[near], kind="stable")[: n - 1]]).tolist()
            best, combined = float(score[own].sum()), [(0.0, ())]
            for k in near:
                options = self.choices(words[k], n)
                combined = sorted(((less + options[0][0] - s, edits + ((k, o),) if o else edits) for less, edits in combined for o, (s, _) in enumerate(options)), key=lambda x: x[0])[:n]
            size = count[own]
            out.append([(best - less, [(int(end[k] - size[k]), int(size[k]), list(self.choices(words[k], n)[o][1])) for k, o in edits]) for less, edits in combined])
        return ids, np.array(sizes, np.int64), out

    def bytes_of(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of runs of ids, sizes of them each, and the ends of the runs' bytes."""
        if len(ids) and (ids.max() >= len(self.raw_size) or ids.min() < 0):
            raise ValueError("an id that the model lacks")
        width = self.raw_size[ids]
        ends = np.concatenate([[0], np.cumsum(width)])[np.cumsum(sizes)]
        return self.raw[ragged(self.raw_start[ids], width)], ends

    def decode(self, ids) -> str:
        """The text of ids: pieces and bytes in a row, without the space before the first word."""
        return self.bytes_of(np.asarray(ids, np.int64), np.array([len(ids)]))[0].tobytes().decode("utf-8", "replace")[1:]


def edited(ids: list[int], edits: list[tuple]) -> list[int]:
    """The ids of a segmentation from those of the best and its edits."""
    out, at = [], 0
    for start, drop, new in sorted(edits):
        out += ids[at:start] + list(new)
        at = start + drop
    return out + ids[at:]


_loaded: dict[str, Pieces] = {}


def loaded(path: str) -> Pieces:
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


EDIT = pa.struct([("at", pa.int32()), ("drop", pa.int32()), ("ids", pa.list_(pa.int32()))])
SEGMENTATION = pa.struct([("score", pa.float64()), ("edits", pa.list_(EDIT))])


def encode(docs: DataFrame, *, path: str | None = None, n: int = N_BEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_pieces, score, ids (the best segmentation), nbest (score and edits of the n best, best first) and
    round_trip (whether decoding gives the text) for each row of docs.

    Null and empty texts have no pieces, no score and no segmentations, and decode to the empty text. A text with fewer
    than n segmentations has them all. Of segmentations with equal scores that with the longer last differing piece comes first, and of changes with equal
    losses the earlier in the text. A literal "▁" decodes as a space, so its round trip fails. Repeated rows and ids each give their row;
    other columns are not read, whatever their names; an empty table gives no rows. Memory: BLOCK bytes of text or one longer text, and
    words remembered up to MOST_WORDS and MOST_CHARS.
    """
    path = path or model_path()
    names = ["doc_id", "n_pieces", "score", "ids", "nbest", "round_trip"]

    def run(batches):
        pieces = loaded(path)
        for batch in batches:
            _, off = text_bytes(batch.column(1))
            for lo, hi in blocks(off, BLOCK):
                part = batch.slice(lo, hi - lo)
                texts = [x or "" for x in part.column(1).to_pylist()]
                ids, sizes, best = pieces.segmentations(texts, n)
                raw, ends = pieces.bytes_of(ids.astype(np.int64), sizes)
                same = [raw[a:b].tobytes()[1:] == t.encode() for a, b, t in zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), texts)]
                nbest = [[{"score": s, "edits": [{"at": a, "drop": d, "ids": i} for a, d, i in e]} for s, e in rows] for rows in best]
                cuts = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes), pa.array([b[0][0] if b else None for b in best], pa.float64()), pa.ListArray.from_arrays(cuts, pa.array(ids.view(np.int32))), pa.array(nbest, pa.list_(SEGMENTATION)), pa.array(same, pa.bool_())], names=names
                )

    schema = "doc_id long, n_pieces long, score double, ids array<int>, nbest array<struct<score: double, edits: array<struct<at: int, drop: int, ids: array<int>>>>>, round_trip boolean"
    return pick(docs, doc_id=(id_col, "long"), text=text_col).mapInArrow(run, schema)


def decode(rows: DataFrame, *, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text of each row's ids; null or no ids: the empty text. An id that the model lacks raises."""
    path = path or model_path()

    def run(batches):
        pieces = loaded(path)
        for batch in batches:
            texts = [pieces.decode(ids) if ids else "" for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return pick(rows, doc_id=(id_col, "long"), ids=ids_col).mapInArrow(run, "doc_id long, text string")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
