"""The tokenizers library's ids of whole texts, for many texts at once.

Texts are cut where the tokenizer's own pre-tokenizer always cuts, a batch is turned into a dictionary of distinct
units by Arrow, and the library encodes each distinct word once; the ids are then gathered back by numpy. So each id
comes from the library, but a word that comes often costs one look-up a batch. Words of up to `LONGEST` characters are
kept by the Python worker, at most `KEPT` of them.

Two kinds of tokenizer are known. `spaced`: byte-level units that hold the one space before them. Texts with other
white space than single spaces and line ends between words, or with uncommon characters, go to the library whole. Not
`spaced`: white space is dropped, so every text is cut at ASCII white space.
"""

from __future__ import annotations

import os
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from barwright.llm.shared import worker_store

KEPT = 500_000
LONGEST = 64
#: letters that neither the normalizer (but for their case) nor the pre-tokenizer of either kind treats in a special way
WORD = r"[A-Za-zÀ-ÖØ-öø-ÿ]*"
MARKS = r"[!-/:-@\[-`{-~]*"
PARTS = rf"^(?P<line>\n?)(?P<word>{WORD})(?P<marks>{MARKS})$"


def gathered(ids: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of lists laid end to end in `ids`: those numbered `which` end to end, and their sizes."""
    starts = np.cumsum(sizes) - sizes
    n = sizes[which]
    ends = np.cumsum(n)
    places = np.repeat(starts[which] - ends + n, n)
    places += np.arange(len(places))
    return ids[places], n


def sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches that end before `ends`."""
    total = np.concatenate([[0], np.cumsum(values)])
    return np.diff(total[ends], prepend=0)


class Units:
    def __init__(self, path: str, spaced: bool):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library, self.spaced = Tokenizer.from_file(path), spaced
        added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        marks = "|".join("".join(c if c.isalnum() else f"[{c}]" if c != "^" else r"\^" for c in a) for a in added)
        self.other = "|".join(filter(None, [r"[^\n\x20-\x7e\xa1-\x{24f}]", "  | \n|\n |\n\n|^ | $|^\n|\n$", marks]))
        self.known: dict[str, bytes] = {}

    def plain(self, texts: list[str]) -> list[bytes]:
        """Ids as unsigned 32-bit integers in the machine's byte order, by the library alone."""
        encode = getattr(self.library, "encode_batch_fast", self.library.encode_batch)
        return [np.array(e.ids, np.uint32).tobytes() for e in encode(texts, add_special_tokens=False)]

    def looked_up(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct keys laid end to end, and how many each has."""
        found = list(map(self.known.get, keys))
        gaps = [i for i, x in enumerate(found) if x is None]
        for i, x in zip(gaps, self.plain([keys[i] for i in gaps])):
            found[i] = x
            if len(keys[i]) <= LONGEST:
                self.known[keys[i]] = x
        if len(self.known) > KEPT:  # what came first is what comes often: the later part goes
            self.known = dict(islice(self.known.items(), KEPT // 2))
        sizes = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        return np.frombuffer(b"".join(found), np.uint32), sizes

    def of_units(self, units: pa.Array, bare: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct units; `bare` marks those without a space before them."""
        parts = pc.extract_regex(units, PARTS)
        whole = pc.is_null(parts).to_numpy(zero_copy_only=False)
        line, word, marks = (pc.struct_field(parts, i) for i in range(3))
        bare = bare | pc.starts_with(units, "\n").to_numpy(zero_copy_only=False)
        if not self.spaced:
            word = pc.utf8_lower(word)
        no_word = pc.equal(pc.fill_null(word, ""), "").to_numpy(zero_copy_only=False)
        space = lambda no: pc.if_else(pa.array(no), "", " ")
        if self.spaced:  # the space belongs to what comes first: the word, or the marks
            word = pc.binary_join_element_wise(space(bare | no_word), word, "")
            marks = pc.binary_join_element_wise(space(bare | ~no_word), marks, "")
        word = pc.if_else(pa.array(whole), pc.binary_join_element_wise(space(bare | (not self.spaced)), units, ""), word)
        columns = [pc.fill_null(c, "") for c in (line, word, marks)]
        table = pa.concat_arrays(columns).dictionary_encode()
        ids, sizes = self.looked_up(table.dictionary.to_pylist())
        which = table.indices.to_numpy().reshape(3, -1).T.ravel()
        flat, n = gathered(ids, sizes, which)
        return flat, n.reshape(-1, 3).sum(1)

    def common(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.spaced:
            lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        else:
            lists = pc.ascii_split_whitespace(texts)
        ends = lists.offsets.to_numpy()
        ends = ends[1:] - ends[0]
        coded = lists.flatten().dictionary_encode()
        which = coded.indices.to_numpy().astype(np.int64)
        n = len(coded.dictionary)
        bare = np.zeros(n, bool)
        units = coded.dictionary
        if self.spaced and len(which):  # first units of texts are entries of their own
            heads = np.concatenate([[0], ends[:-1]])[np.diff(ends, prepend=0) > 0]
            first, place = np.unique(which[heads], return_inverse=True)
            which[heads] = n + place
            units, bare = pa.concat_arrays([units, units.take(pa.array(first))]), np.concatenate([bare, np.ones(len(first), bool)])
        flat, sizes = gathered(*self.of_units(units, bare), which)
        return flat, sums(sizes, ends)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: empty) end to end, and how many each has."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if not self.spaced:
            return self.common(texts)
        odd = pc.match_substring_regex(texts, self.other).to_numpy(zero_copy_only=False)
        if not odd.any():
            return self.common(texts)
        flat, sizes = self.common(texts.filter(pa.array(~odd)))
        whole = self.plain(texts.filter(pa.array(odd)).to_pylist())
        all_sizes = np.concatenate([sizes, np.fromiter(map(len, whole), np.int64, len(whole)) >> 2])
        place = np.empty(len(odd), np.int64)
        place[~odd], place[odd] = np.arange(len(sizes)), len(sizes) + np.arange(len(whole))
        return gathered(np.concatenate([flat, np.frombuffer(b"".join(whole), np.uint32)]), all_sizes, place)


def units(path: str, spaced: bool) -> Units:
    store = worker_store("units")
    if (path, spaced) not in store:
        store[path, spaced] = Units(path, spaced)
    return store[path, spaced]
