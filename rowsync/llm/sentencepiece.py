"""Unigram encoding and decoding: Viterbi over a double-array trie of pieces with log scores, with byte fallback.

The trie runs over Unicode characters, renumbered; the Viterbi search advances over many distinct words at once in
numpy. No piece goes on past the beginning of a run of word marks, so the best path of a text is the best paths of its
words (each with the marks before it) one after the other; that is verified when a model is loaded.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, table, text_or_empty
from .words import gather, slices, spread

MARK = "▁"
#: How much worse than the worst piece a character outside the vocabulary scores.
UNKNOWN_PENALTY = 10.0
#: Cells (longest word times number of words) of a group of words searched at once, and characters beyond which a word
#: is searched on its own.
GROUP, LONG = 1 << 18, 1024


class DoubleArray:
    """A trie as two arrays: the child of state s by character c is base[s] + c if check[base[s] + c] == s."""

    def __init__(self, words: list[list[int]], values: list[int], alphabet: int):
        children: list[dict[int, int]] = [{}]
        value = [-1]
        for w, v in zip(words, values, strict=True):
            at = 0
            for c in w:
                if c not in children[at]:
                    children[at][c] = len(children)
                    children.append({})
                    value.append(-1)
                at = children[at][c]
            value[at] = v
        size = 2 * len(children) + 2 * alphabet + 2
        self.base, self.check, self.value = np.zeros(size, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        free = np.ones(size, bool)
        free[0] = False
        place, lowest = {0: 0}, 1
        queue = [0]
        for s in queue:
            at, kids = place[s], sorted(children[s])
            self.value[at] = value[s]
            if not kids:
                continue
            while not free[lowest]:
                lowest += 1
            b = max(1, lowest - kids[0])
            offsets = np.array(kids)
            while not free[b + offsets].all():
                b += 1
                if b + alphabet + 1 >= len(free):
                    grow = len(free)
                    free = np.concatenate((free, np.ones(grow, bool)))
                    self.base, self.check, self.value = (np.concatenate((x, np.full(grow, y, np.int64))) for x, y in ((self.base, 0), (self.check, -1), (self.value, -1)))
            self.base[at] = b
            for c in kids:
                place[children[s][c]] = b + c
                self.check[b + c], free[b + c] = at, False
                queue.append(children[s][c])

    def step(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Next states; -1 where there is none. Characters that no word has are negative."""
        to = np.where(c >= 0, self.base[state] + c, 0)
        return np.where((c >= 0) & (to > 0) & (self.check[to] == state) & (self.base[state] > 0), to, -1)


class Unigram:
    def __init__(self, pieces: list[str], scores: list[float], kinds: list[str]):
        """``kinds``: "piece", "byte" (named <0xNN>) or "control" (never produced from text)."""
        self.pieces, plain = pieces, [k for k, x in enumerate(kinds) if x == "piece"]
        letters = sorted({c for k in plain for c in pieces[k]})
        self.letters = np.array([ord(c) for c in letters], np.int64)
        number = {c: k for k, c in enumerate(letters)}
        if any(MARK in pieces[k].lstrip(MARK) for k in plain):
            raise ValueError("a piece has a word mark after another character: words can't be taken apart")
        self.trie = DoubleArray([[number[c] for c in pieces[k]] for k in plain], plain, len(letters))
        self.scores = np.array(scores, float)
        self.longest = max((len(pieces[k]) for k in plain), default=1)
        self.unknown = min((scores[k] for k in plain), default=0.0) - UNKNOWN_PENALTY
        self.byte_id = np.full(256, -1, np.int64)
        for k, x in enumerate(kinds):
            if x == "byte":
                self.byte_id[int(pieces[k][3:5], 16)] = k
        raw = [bytes([int(p[3:5], 16)]) if x == "byte" else p.replace(MARK, " ").encode() if x == "piece" else b"" for p, x in zip(pieces, kinds, strict=True)]
        self.raw_len = np.array([len(r) for r in raw], np.int64)
        self.raw_at = np.cumsum(self.raw_len) - self.raw_len
        self.raw = np.frombuffer(b"".join(raw), np.uint8)

    @classmethod
    def load(cls, path: str) -> Unigram:
        """Pieces and scores of a SentencePiece model file."""
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(p.get_piece_size())
        kind = ["byte" if p.is_byte(k) else "control" if p.is_control(k) or p.is_unknown(k) or p.is_unused(k) else "piece" for k in ids]
        return cls([p.id_to_piece(k) for k in ids], [p.get_score(k) for k in ids], kind)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and the number of each word's. Words of like length are searched together."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(size, kind="stable")
        found: list = [None] * len(words)
        at, end = 0, int(np.searchsorted(size[order], LONG, side="right"))
        while at < end:
            cells = (size[order[at:end]] + 1) * np.arange(1, end - at + 1)
            n = max(1, int(np.searchsorted(cells, GROUP, side="right")))
            group = order[at : at + n]
            for k, ids in zip(group.tolist(), self._search([words[k] for k in group]), strict=True):
                found[k] = ids
            at += n
        for k in order[end:].tolist():
            found[k] = self._search_long(words[k])
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return np.concatenate(found), lengths

    def _search_long(self, word: str) -> np.ndarray:
        """Viterbi over one word: the trie goes over all places at once, then the best way is found place by place."""
        flat = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        at = np.searchsorted(self.letters, flat)
        c = np.where(self.letters[np.minimum(at, len(self.letters) - 1)] == flat, at, -1)
        starts, ends, values = [], [], []
        state, here = np.zeros(len(c), np.int64), np.arange(len(c))
        for n in range(1, self.longest + 1):
            inside = here + n <= len(c)
            here = here[inside]
            state = self.trie.step(state[inside], c[here + n - 1])
            here, state = here[state >= 0], state[state >= 0]
            if not len(here):
                break
            v = self.trie.value[state]
            starts.append(here[v >= 0])
            ends.append(here[v >= 0] + n)
            values.append(v[v >= 0])
        start, end, value = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, ends, values))
        order = np.lexsort((end, start))
        end, value, worth = end[order].tolist(), value[order].tolist(), self.scores[value[order]].tolist()
        bound = np.searchsorted(start[order], np.arange(len(c) + 1)).tolist()
        best, piece, back = [0.0] + [-np.inf] * len(c), [-1] * (len(c) + 1), [0] * (len(c) + 1)
        for i in range(len(c)):
            single, here_best = False, best[i]
            for k in range(bound[i], bound[i + 1]):
                j, score = end[k], here_best + worth[k]
                single |= j == i + 1
                if score > best[j]:
                    best[j], piece[j], back[j] = score, value[k], i
            if not single and here_best + self.unknown > best[i + 1]:
                best[i + 1], piece[i + 1], back[i + 1] = here_best + self.unknown, -1, i
        out, j = [], len(c)
        while j:
            i = back[j]
            out.append([piece[j]] if piece[j] >= 0 else self.byte_id[list(word[i:j].encode("utf-8", "surrogatepass"))].tolist())
            j = i
        return np.array([x for ids in reversed(out) for x in ids], np.int64)

    def _search(self, words: list[str]) -> list[np.ndarray]:
        """Viterbi over words sorted by length, position by position for all of them."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        longest = int(size[-1])
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        at = np.searchsorted(self.letters, flat)
        coded = np.where(self.letters[np.minimum(at, len(self.letters) - 1)] == flat, at, -1)
        rows = np.repeat(np.arange(len(words)), size)
        cols = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        c = np.full((longest, len(words)), -2, np.int64)
        c[cols, rows] = coded
        best = np.full((longest + 1, len(words)), -np.inf)
        best[0] = 0
        piece, back = np.full((longest + 1, len(words)), -1, np.int64), np.zeros((longest + 1, len(words)), np.int64)
        for i in range(longest):
            live = np.arange(int(np.searchsorted(size, i, side="right")), len(words))
            state, here, single = np.zeros(len(live), np.int64), live, np.zeros(len(live), bool)
            for n in range(1, min(self.longest, longest - i) + 1):
                state = self.trie.step(state, c[i + n - 1, here])
                on = state >= 0
                state, here = state[on], here[on]
                if not len(here):
                    break
                v = self.trie.value[state]
                ends = v >= 0
                w, v = here[ends], v[ends]
                score = best[i, w] + self.scores[v]
                if n == 1:
                    single[w - live[0]] = True
                better = score > best[i + n, w]
                w, v = w[better], v[better]
                best[i + n, w], piece[i + n, w], back[i + n, w] = score[better], v, i
            w = live[~single]
            score = best[i, w] + self.unknown
            better = score > best[i + 1, w]
            w = w[better]
            best[i + 1, w], piece[i + 1, w], back[i + 1, w] = score[better], -1, i
        end, all_words = size.copy(), np.arange(len(words))
        steps: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while (going := end > 0).any():
            w = all_words[going]
            steps.append((w, piece[end[w], w], back[end[w], w]))
            end[w] = back[end[w], w]
        owner, ids, start = (np.concatenate([s[k] for s in reversed(steps)]) if steps else np.zeros(0, np.int64) for k in range(3))
        order = np.argsort(owner, kind="stable")
        owner, ids, start = owner[order], ids[order], start[order]
        if (ids < 0).any():  # bytes instead of characters that no piece has
            wide, reps = [], np.ones(len(ids), np.int64)
            for k in np.nonzero(ids < 0)[0]:
                raw = words[owner[k]][start[k]].encode("utf-8", "surrogatepass")
                wide.append(self.byte_id[list(raw)])
                reps[k] = len(raw)
            unknown = np.repeat(ids < 0, reps)
            owner, ids = np.repeat(owner, reps), np.repeat(ids, reps)
            ids[unknown] = np.concatenate(wide)
        return np.split(ids, np.cumsum(np.bincount(owner, minlength=len(words)))[:-1])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and n+1 offsets. A text begins with a word mark that stands for no space; empty text has no ids."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        empty = pc.equal(texts, "").to_numpy(zero_copy_only=False)
        odd = pc.or_(pc.match_substring(texts, "  "), pc.or_(pc.match_substring(texts, MARK), pc.or_(pc.starts_with(texts, " "), pc.ends_with(texts, " ")))).to_numpy(zero_copy_only=False)
        doc, parts = spread(pc.split_pattern(texts.filter(pa.array(~odd & ~empty)), " "))
        doc = np.nonzero(~odd & ~empty)[0][doc]
        coded = parts.dictionary_encode()
        code, words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), [MARK + w for w in coded.dictionary.to_pylist()]
        more_doc, more = [], []
        for k in np.nonzero(odd)[0].tolist():
            runs = re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", MARK + texts[k].as_py().replace(" ", MARK))
            more_doc += [k] * len(runs)
            more += runs
        ids, lengths = self.encode_words(words + more)
        doc, code = np.concatenate((doc, np.array(more_doc, np.int64))), np.concatenate((code, len(words) + np.arange(len(more))))
        order = np.argsort(doc, kind="stable")
        code, runs = code[order], lengths[code[order]]
        sizes = np.bincount(doc[order], weights=runs, minlength=len(texts)).astype(np.int64)
        return ids[gather((np.cumsum(lengths) - lengths)[code], runs)], np.concatenate(([0], np.cumsum(sizes)))

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """UTF-8 bytes of each text; the first space, which stands for the beginning, is left out."""
        ends = np.concatenate(([0], np.cumsum(self.raw_len[ids])))[offsets]
        data = self.raw[gather(self.raw_at[ids], self.raw_len[ids])].tobytes()
        return [data[a:b].removeprefix(b" ") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


@lru_cache(2)
def loaded(path: str) -> Unigram:
    """The model of a file, kept while a Python worker lives."""
    return Unigram.load(path)


FIELDS = "n_ids long, n_bytes long, ids_crc32 long, decoded_sha256 string, round_trip boolean"


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, with_ids: bool = False) -> DataFrame:
    """Encode and decode each text: its id and FIELDS, and ``ids array<int>`` if asked for.

    ``round_trip`` says whether the decoded text is the text. Null text counts as empty and has no ids. Characters
    outside the vocabulary become byte pieces; a word mark in the text itself decodes to a space, which ``round_trip``
    shows. Repeated rows stay. An empty table gives an empty one.
    """
    from .packing import tokenizer_path

    prepare(df.sparkSession)
    path = model or tokenizer_path("piece_bpe_32k.model")
    id_type = df.schema[id_col].dataType.simpleString()
    schema = f"doc_id {id_type}, {FIELDS}" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        m = loaded(path)
        is_byte = np.isin(np.arange(len(m.pieces)), m.byte_id)
        for b in batches:
            for s in slices(b, "text"):
                ids, offsets = m.encode(s["text"])
                decoded, little = m.decode(ids, offsets), ids.astype("<u4")
                raw = [x.encode("utf-8", "surrogatepass") for x in s["text"].to_pylist()]
                cols = [
                    s["doc_id"],
                    pa.array(np.diff(offsets)),
                    pa.array(np.diff(np.concatenate(([0], np.cumsum(is_byte[ids])))[offsets]), pa.int64()),
                    pa.array([zlib.crc32(little[x:y].tobytes()) for x, y in zip(offsets[:-1], offsets[1:], strict=True)], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string()),
                    pa.array([x == y for x, y in zip(decoded, raw, strict=True)], pa.bool_()),
                ]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, [f.split()[0] for f in ["doc_id", *FIELDS.split(", "), *["ids"] * with_ids]])

    return df.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(run, schema)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
