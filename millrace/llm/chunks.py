"""Cutting text at places where byte-level BPE never joins, so that each distinct part is encoded once.

The pre-tokenizer gives a single space between two visible characters to what follows it, keeps a
single line end apart, and starts anew at closing punctuation behind a letter. Columns of texts are cut
there by Arrow kernels, so Python sees each distinct part of a batch only once. Texts with other
white space than single spaces and line ends are cut at safe spaces only.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: Marks a part that has no space before it; texts that hold it themselves are cut the other way.
BARE = "\x01"
#: Punctuation that is cut off behind a letter.
ENDS = ".,;:!?"
#: Longer parts are encoded but not remembered.
LONGEST = 64
_BLANKS = "\\t-\\r\\x1c- \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
#: Texts of one space and visible characters behind it, and of visible characters alone.
BEHIND, VISIBLE = f"^ (?:[^ ]*[^{_BLANKS}])$", f"^[^{_BLANKS}]+$"
_NOTHING = pa.array([b""], pa.large_binary())
_ODD = f"^\\x01?$|^\\x01?[{_BLANKS}]|[{_BLANKS}]$"


class Recent:
    """What was used last, of a bounded size: of two halves the older goes when the younger is full, so frequent keys stay."""

    def __init__(self, bound: int):
        self.half, self.young, self.old = bound // 2, {}, {}

    def get(self, key):
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key, value) -> None:
        self.update({key: value})

    def update(self, found: dict) -> None:
        if len(self.young) >= self.half:
            self.old, self.young = self.young, {}
        self.young.update(found)


class RecentParts:
    """Ids of the parts that were used last, of a bounded number: two halves as in Recent, held as Arrow columns (part, ids)."""

    def __init__(self, bound: int):
        self.half = bound // 2
        self.young = self.old = pa.table({"part": pa.array([], pa.string()), "ids": pa.array([], pa.large_binary())})

    def ids(self, parts: pa.Array, encode: Callable[[pa.Array], pa.Array]) -> pa.Array:
        """The ids of parts; encode gives those that are not held."""
        held = pa.concat_tables([self.young, self.old]).combine_chunks()
        at = pc.index_in(parts, held.column("part"))
        new = parts.filter(pc.is_null(at))
        found = encode(new)
        short = pc.less_equal(pc.binary_length(new), LONGEST)
        again = held.take(at.filter(pc.fill_null(pc.greater_equal(at, self.young.num_rows), False)))
        fresh = pa.table({"part": new.filter(short), "ids": found.filter(short)})
        if self.young.num_rows >= self.half:
            self.old, self.young = self.young, self.young.slice(0, 0)
        self.young = pa.concat_tables([self.young, again, fresh]).combine_chunks()
        every = pa.chunked_array([*held.column("ids").chunks, found], pa.large_binary()).combine_chunks()
        places = at.to_numpy(zero_copy_only=False).astype("f8")
        places[np.isnan(places)] = held.num_rows + np.arange(len(new))
        return every.take(pa.array(places.astype("i8")))


class PieceEncoder:
    """Encodes columns of texts to ids. encode_many gives the ids, as bytes, of texts not seen lately.

    bound: parts that are remembered between batches.
    """

    def __init__(self, encode_many: Callable[[pa.Array], pa.Array], bound: int = 400_000):
        self.encode_many, self.known = encode_many, RecentParts(bound)

    def _ids(self, parts: pa.Array) -> pa.Array:
        """Of parts; those without the mark have a space before them."""

        def encode(new: pa.Array) -> pa.Array:
            bare = pc.starts_with(new, BARE)
            return self.encode_many(pc.if_else(bare, pc.utf8_slice_codeunits(new, 1), pc.binary_join_element_wise("", new, " ")))

        return self.known.ids(parts, encode)

    def _odd(self, texts: list[str]) -> list[bytes]:
        cut = []
        for text in texts:
            first, *rest = _SAFE_SPACE.split(text)
            cut.append([BARE + first, *[BARE + " " + x if x[:1] == BARE else x for x in rest]])
        kinds = list(dict.fromkeys(x for own in cut for x in own))
        ids = dict(zip(kinds, self._ids(pa.array(kinds, pa.string())).to_pylist()))
        return [b"".join([ids[x] for x in own]) for own in cut]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the number of ids of each text; null counts as empty."""
        n = len(texts)
        if not n:
            return np.zeros(0, "<u4"), np.zeros(0, "i8")
        texts = pc.fill_null(texts, "")
        lines = pc.replace_substring(texts, "\n", f" {BARE}\n {BARE}")
        cut = pc.split_pattern(pc.binary_join_element_wise(pa.scalar(BARE), lines, ""), " ")
        bounds = cut.offsets.to_numpy().astype("i8")
        coded = cut.flatten().dictionary_encode()
        codes, bounds = coded.indices.to_numpy(), bounds - bounds[0]
        first, pieces = bounds[:-1], coded.dictionary

        odd = np.array(pc.match_substring_regex(pieces, _ODD))
        newline = pc.index(pieces, BARE + "\n").as_py()
        if newline >= 0:
            odd[newline] = False
        again = np.logical_or.reduceat(odd[codes], first) | np.array(pc.match_substring(texts, BARE))

        core = pc.utf8_rtrim(pieces, ENDS)
        tailed = pc.and_(pc.utf8_is_alpha(pc.utf8_slice_codeunits(core, -1)), pc.not_equal(core, pieces))
        tails = pc.struct_field(pc.extract_regex(pieces, f"(?P<tail>[{ENDS}]*)$"), [0])
        core, tails = pc.if_else(tailed, core, pieces).dictionary_encode(), pc.if_else(tailed, tails, "").dictionary_encode()
        used = np.zeros(len(pieces), bool)
        used[codes[~np.repeat(again, np.diff(bounds))]] = True
        core_of = core.indices.to_numpy()
        wanted = np.zeros(len(core.dictionary), bool)
        wanted[core_of[used]] = True
        at, place = np.flatnonzero(wanted), np.cumsum(wanted) - 1
        place[~wanted] = len(at)
        known = self._ids(pa.concat_arrays([core.dictionary.take(pa.array(at)), pc.binary_join_element_wise(BARE, tails.dictionary, "")]))
        cores, ends = pa.concat_arrays([known.slice(0, len(at)), _NOTHING]), known.slice(len(at))
        whole = pc.binary_join_element_wise(cores.take(pa.array(place[core_of])), ends.take(tails.indices), pa.scalar(b"", pa.large_binary()))
        whole = pa.concat_arrays([whole, _NOTHING])
        if again.any():
            codes = np.where(np.repeat(again, np.diff(bounds)), len(pieces), codes)
        found = whole.take(pa.array(codes))
        stop = np.frombuffer(found.buffers()[1], "i8", len(codes) + 1) >> 2
        ids = np.frombuffer(found.buffers()[2] or b"", "<u4", stop[-1])
        counts = np.diff(stop[bounds])
        if again.any():
            places = np.flatnonzero(again)
            extra = [np.frombuffer(x, "<u4") for x in self._odd([texts[i].as_py() for i in places.tolist()])]
            sizes = np.array([len(x) for x in extra])
            ids = np.insert(ids, np.repeat((np.cumsum(counts) - counts)[places], sizes), np.concatenate(extra))
            counts[places] = sizes
        return ids, counts
