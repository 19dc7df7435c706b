"""N-best segmentation into the pieces of a SentencePiece model, and its inverse.

A text is a lattice of pieces. A forward Viterbi pass gives every position the best score of its prefix; a backward
A-star search then extends suffixes towards the start, and since those scores are the exact cost to go, the n-th
complete suffix it pops is the n-th best segmentation. No piece runs over the start of a word, the end of its
letters or a line, so the lattice falls apart into units that are solved once and kept (a bounded store in each Python worker); the n best of
a document come from the n - 1 units whose second best loses least, by the same kind of search over their lists.

Characters that no single-character piece covers cost the least score minus ten and are written as byte pieces.

Defined results: a null or empty text has no pieces and one segmentation with score 0. Ties keep a fixed order.
A literal U+2581 decodes as a space, which is what the model writes for it, so such a text is not `restored`. Ids that come from elsewhere decode as in
the library: an unknown piece is " ⁇ ", a byte that no character takes is U+FFFD, and only the mark that a piece at the
start brings is dropped. Repeated rows give equal rows, other columns are left alone.
"""

from __future__ import annotations

import codecs
import heapq
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from barwright.llm.shared import own_columns, text_slices, worker_store

MARK = "▁"
UNKNOWN_PENALTY = 10.0
MODEL = "piece_bpe_32k.model"
NBEST = 4
KEPT_UNITS = 250_000
NONE = float("-inf")
LETTER = r"[^\W\d_²³¹]"
# ways to cut a text into units, finest first; a vocabulary takes the first that none of its pieces runs across
UNITS = [re.compile(u) for u in (f"{MARK}*{LETTER}+|{MARK}*(?:(?!{LETTER})[^{MARK}\n])+|{MARK}+|\n", f"{MARK}*[^{MARK}\n]+|{MARK}+|\n", "(?s:.)+")]


def _stray(error: UnicodeDecodeError) -> tuple[str, int]:
    """One U+FFFD for each byte that no character takes; a lone surrogate, which `encode` writes as three bytes, comes back."""
    three = error.object[error.start : error.start + 3]
    if len(three) == 3 and three[0] == 0xED and three[1] >= 0xA0 and three[1] < 0xC0 and 0x80 <= three[2] < 0xC0:
        return three.decode("utf-8", "surrogatepass"), error.start + 3
    return "\ufffd", error.start + 1


class Kept(dict):
    """Solutions by unit; a unit that is looked up for the first time is solved."""

    def __init__(self, solve, known=()):
        super().__init__(known)
        self.solve = solve

    def __missing__(self, unit: str) -> tuple[bytes, float, float]:
        found = self[unit] = self.solve(unit)
        return found


class Vocabulary:
    """Pieces and scores of a model file, with the search over its lattice."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in ids if model.is_byte(i)}
        self.unknown = model.unk_id()
        special = [i for i in ids if model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)]
        normal = sorted(set(ids) - set(special))
        self.pieces = {model.id_to_piece(i): (model.get_score(i), i) for i in normal}
        self.raw = [b"" if model.is_control(i) else model.id_to_piece(i).replace(MARK, " ").encode("utf-8", "surrogatepass") for i in ids]
        for b, i in self.bytes.items():
            self.raw[i] = bytes([b])
        self.raw[self.unknown] = " ⁇ ".encode()
        self.control = {i for i in ids if model.is_control(i)}
        self.opening = {i for p, (_, i) in self.pieces.items() if p.startswith(MARK)}
        codecs.register_error("stray-bytes", _stray)  # here, as a Python worker has the class but not the module
        self.trie: dict = {}
        for piece, entry in self.pieces.items():
            node = self.trie
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = entry
        self.worst = min((s for s, _ in self.pieces.values()), default=0.0) - UNKNOWN_PENALTY
        self.units = next(u.findall for u in UNITS if all(u.fullmatch(p) for p in self.pieces))
        self.kept = Kept(self.solve)

    def lattice(self, unit: str) -> tuple[list[tuple[int, int, float, int | str]], list[float], list]:
        """Edges (start, end, score, id or uncovered character) by start, the best score of each prefix, and the
        last edge of the best way to each position."""
        n = len(unit)
        edges: list[tuple[int, int, float, int | str]] = []
        best, back = [NONE] * (n + 1), [None] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            node, j, here = self.trie, i, best[i]
            single = False
            while j < n:
                node = node.get(unit[j])
                if node is None:
                    break
                j += 1
                hit = node.get("")
                if hit is not None:
                    single = single or j == i + 1
                    edge = (i, j, hit[0], hit[1])
                    edges.append(edge)
                    if here + hit[0] > best[j]:
                        best[j], back[j] = here + hit[0], edge
            if not single:
                edge = (i, i + 1, self.worst, unit[i])
                edges.append(edge)
                if here + self.worst > best[i + 1]:
                    best[i + 1], back[i + 1] = here + self.worst, edge
        return edges, best, back

    def search(self, unit: str, n: int) -> list[tuple[float, bytes]]:
        """The n best segmentations as (score, ids), best first: backward A-star with forward scores."""
        edges, best, _ = self.lattice(unit)
        ends: list[list] = [[] for _ in best]
        for i, j, s, piece in edges:
            ends[j].append((i, s, piece))
        open_, made, found = [(-best[-1], 0, len(unit), 0.0, None)], 0, []
        while open_ and len(found) < n:
            _, _, at, behind, chain = heapq.heappop(open_)
            if at == 0:
                found.append((behind, self._ids(chain)))
                continue
            for i, s, piece in ends[at]:
                made += 1
                heapq.heappush(open_, (-(best[i] + s + behind), made, i, s + behind, (piece, chain)))
        return found

    def _ids(self, chain) -> bytes:
        out = []
        while chain is not None:
            piece, chain = chain
            out += [piece] if isinstance(piece, int) else self._bytes(piece)
        return np.array(out, "<u4").tobytes()

    def _bytes(self, c: str) -> list[int]:
        return [self.bytes.get(b, self.unknown) for b in c.encode("utf-8", "surrogatepass")]

    def solve(self, unit: str) -> tuple[bytes, float, float]:
        """Best ids, their score, and what the second best loses (infinite without one).

        Any other segmentation leaves the best one by some edge, and the best path through an edge is forward score
        plus edge plus backward score."""
        edges, best, back = self.lattice(unit)
        n = len(unit)
        chain, path, at = [], [None] * (n + 1), n
        while at:
            edge = path[at] = back[at]
            chain.append(edge[3])
            at = edge[0]
        behind, second = [NONE] * n + [0.0], NONE
        for edge in reversed(edges):  # all edges from later places come first, so behind[j] is final
            i, j, s, _ = edge
            after = behind[j]
            if s + after > behind[i]:
                behind[i] = s + after
            if best[i] + s + after > second and path[j] is not edge:
                second = best[i] + s + after
        ids: list[int] = []
        for piece in reversed(chain):
            ids += [piece] if isinstance(piece, int) else self._bytes(piece)
        return struct.pack(f"<{len(ids)}I", *ids), best[n], best[n] - second

    def parts(self, text: str) -> tuple[list[str], list[tuple[bytes, float, float]]]:
        """Units of a text and their solutions."""
        units = self.units(MARK + text.replace(" ", MARK)) if text else []
        kept = self.kept
        if len(kept) > KEPT_UNITS:  # what came first is what comes often: the later half goes
            kept = self.kept = Kept(self.solve, islice(kept.items(), KEPT_UNITS // 2))
        return units, list(map(kept.__getitem__, units))

    def encode(self, text: str) -> tuple[np.ndarray, float]:
        _, parts = self.parts(text)
        return np.frombuffer(b"".join([p[0] for p in parts]), "<u4"), sum([p[1] for p in parts])

    def nbest(self, text: str, n: int) -> list[tuple[float, np.ndarray]]:
        """The n best segmentations of a whole text (fewer, if there are fewer), best first."""
        units, parts = self.parts(text)
        ids, total = [p[0] for p in parts], sum([p[1] for p in parts])
        loss = np.array([p[2] for p in parts], float)
        turn = np.lexsort((np.arange(len(loss)), loss))[: n - 1] if len(loss) <= n else np.sort(np.argpartition(loss, n - 2)[: n - 1]) if n > 1 else []
        free = []
        for k in turn:
            if loss[k] < float("inf"):  # the kept best first; among ties the search may pop another one before it
                others = [o for o in self.search(units[k], n) if o[1] != ids[k]]
                free.append((int(k), [(parts[k][1], ids[k]), *others[: n - 1]]))
        # the text's ids with gaps at the free units: segmentations differ there only
        turn, spans, last = sorted(range(len(free)), key=lambda x: free[x][0]), [], 0
        for x in turn:
            spans += [b"".join(ids[last : free[x][0]]), b""]
            last = free[x][0] + 1
        spans.append(b"".join(ids[last:]))
        out, seen, made = [], {(0,) * len(free)}, 0
        open_ = [(0.0, 0, (0,) * len(free))]
        while open_ and len(out) < n:
            lost, _, choice = heapq.heappop(open_)
            for at, x in enumerate(turn):
                spans[2 * at + 1] = free[x][1][choice[x]][1]
            out.append((total - lost, np.frombuffer(b"".join(spans), "<u4")))
            for x, (_, options) in enumerate(free):
                if choice[x] + 1 < len(options):
                    step = (*choice[:x], choice[x] + 1, *choice[x + 1 :])
                    if step not in seen:
                        seen.add(step)
                        made += 1
                        heapq.heappush(open_, (lost + options[choice[x]][0] - options[choice[x] + 1][0], made, step))
        return out

    def decode(self, ids: np.ndarray) -> str:
        ids = ids.tolist()
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "stray-bytes")
        first = next((i for i in ids if i not in self.control), None)
        return text[1:] if first in self.opening else text


def vocabulary(path: str) -> Vocabulary:
    """The model at `path`, loaded once in a Python worker."""
    store = worker_store("pieces")
    if path not in store:
        store[path] = Vocabulary(path)
    return store[path]


def encoded(path: str, n: int = NBEST):
    """Column function: text to a struct of the n best segmentations' digests and whether the best decodes to the text."""

    @F.pandas_udf("n_pieces long, score double, nbest_scores array<double>, nbest_crc32 array<long>, restored boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        vocab = vocabulary(path)
        for batch in batches:
            rows = []
            for text in batch:
                text = text or ""
                best = vocab.nbest(text, n)
                rows.append((len(best[0][1]), best[0][0], [s for s, _ in best], [zlib.crc32(i.tobytes()) for _, i in best], vocab.decode(best[0][1]) == text))
            yield pd.DataFrame(rows, columns=["n_pieces", "score", "nbest_scores", "nbest_crc32", "restored"])

    return run


def segmented(path: str, n: int = NBEST):
    """Column function: text to an array of its n best segmentations, each a struct of score and piece ids."""

    @F.pandas_udf("array<struct<score:double,ids:array<int>>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocab = vocabulary(path)
        for batch in batches:
            yield pd.Series([[{"score": s, "ids": ids.astype(np.int32)} for s, ids in vocab.nbest(t or "", n)] for t in batch])

    return run


def restored(path: str):
    """Column function: piece ids back to text."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocab = vocabulary(path)
        for batch in batches:
            yield pd.Series([None if ids is None else vocab.decode(np.asarray(ids, np.uint32)) for ids in batch])

    return run


def op3_sentencepiece(spark, folder: str, path: str | None = None) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    found = docs.select("doc_id", encoded(path or public_tokenizers.path(MODEL))("text").alias("e"))
    return found.select("doc_id", "e.n_pieces", "e.score", "e.nbest_scores", "e.nbest_crc32", "e.restored")


@own_columns
def stage(spark, docs: DataFrame, folder: str) -> DataFrame:
    """Last pipeline stage: each document with the ids of its best segmentation, their number and score, and
    whether they decode to its text."""
    path = public_tokenizers.path(MODEL)
    added = StructType.fromDDL("pieces array<int>, n_pieces long, score double, restored boolean")
    kept = [c for c in docs.columns if c not in added.names]

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            for part, texts in text_slices(batch, "text"):
                found = [vocab.encode(t) for t in texts]
                sizes = np.array([len(ids) for ids, _ in found])
                flat = np.concatenate([ids for ids, _ in found]).astype(np.int32)
                pieces = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))
                whole = [vocab.decode(ids) == t for (ids, _), t in zip(found, texts)]
                more = [pieces, pa.array(sizes.astype(np.int64)), pa.array([float(s) for _, s in found]), pa.array(whole)]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(part.num_columns)), *more], names=[*kept, *added.names])

    return docs.select(*kept).mapInArrow(best, StructType([*docs.select(*kept).schema.fields, *added.fields]))
