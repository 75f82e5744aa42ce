"""Byte-level BPE encoding by a prefix-sharing trie walk, and decoding.

The encoding of every prefix of a word is fixed by one token: its last. That token is the only
vocabulary entry that ends the prefix and stands validly after the last token of the prefix before
it (a pair is valid if merging its two byte strings gives the same two tokens back). The distinct
words of a batch form a trie; their sorted order is its depth-first order, so a stack of last tokens
along the current path is all the state that is kept, and what two words share is computed once.

Defined results: null and empty texts give no ids; the end-of-text marker in a text becomes its
special id, as in the file; a lone surrogate cannot occur in a Spark string; a null doc_id stays null; rows
that repeat are each encoded; other columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from millrace.llm.chunks import PieceEncoder, Recent
from millrace.llm.common import lean, ship, small_batches

#: Pre-token pattern of the byte-level family (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Below this code point all Unicode versions agree on letters, digits and white space.
SETTLED = 0x250


def byte_symbols() -> dict[str, int]:
    """Printable stand-ins of the byte-level family: printable Latin-1 bytes stand for themselves, the others for 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    return table | {chr(256 + i): b for i, b in enumerate(rest)}


class TrieBPE:
    """The tokenizer of one file."""

    def __init__(self, tokenizer_path: str, pairs_bound: int = 800_000):
        with open(tokenizer_path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path, symbols = tokenizer_path, byte_symbols()
        self.bytes_of: dict[int, bytes] = {}
        self.id_of: dict[bytes, int] = {}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        vocab = spec["model"]["vocab"]
        for token, i in vocab.items():
            if token not in self.special:
                self.bytes_of[i] = b = bytes(symbols[c] for c in token)
                self.id_of[b] = i
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.merge[vocab[a], vocab[b]] = rank, vocab[a + b]
        self.single = [self.id_of[bytes([b])] for b in range(256)]
        self.longest = max(map(len, self.id_of))
        self.valid, self.find = Recent(pairs_bound), regex.compile(PATTERN).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else lambda x: [x]
        self.library = None

    def _merged(self, text: bytes) -> list[int]:
        """Merges by rank, for a short byte string."""
        ids, merge = [self.single[b] for b in text], self.merge
        while len(ids) > 1:
            best = min((merge[p] + (k,) for k, p in enumerate(zip(ids, ids[1:])) if p in merge), default=None)
            if best is None:
                break
            _, new, _ = best
            out, k, pair = [], 0, None
            pair = (ids[best[2]], ids[best[2] + 1])
            while k < len(ids):
                if k + 1 < len(ids) and (ids[k], ids[k + 1]) == pair:
                    out.append(new)
                    k += 2
                else:
                    out.append(ids[k])
                    k += 1
            ids = out
        return ids

    def _fits(self, left: int, right: int) -> bool:
        """Whether right may follow left (left -1: nothing before)."""
        key = left * 65536 * 16 + right
        known = self.valid.get(key)
        if known is None:
            if left >= 0 and (left, right) in self.merge:
                known = False
            else:
                known = self._merged((self.bytes_of[left] if left >= 0 else b"") + self.bytes_of[right]) == ([left, right] if left >= 0 else [right])
            self.valid.put(key, known)
        return known

    def encode_words(self, words: list[bytes]) -> dict[bytes, bytes]:
        """The ids of distinct byte strings that hold one pre-token each."""
        out: dict[bytes, bytes] = {}
        id_of, fits, longest = self.id_of, self._fits, self.longest
        path, last, size = b"", [], []  # of the node at depth k + 1: its last token and that token's length
        for word in sorted(words):
            known, older = self.valid.young.get, self.valid.old.get
            k, most = 0, min(len(word), len(path))
            while k < most and word[k] == path[k]:
                k += 1
            del last[k:], size[k:]
            for end in range(k + 1, len(word) + 1):
                for n in range(min(end, longest), 0, -1):
                    token = id_of.get(word[end - n : end])
                    if token is not None:
                        before = last[end - n - 1] if end > n else -1
                        key = before * 1048576 + token
                        ok = known(key)
                        if ok is None:
                            ok = older(key)
                        if fits(before, token) if ok is None else ok:
                            last.append(token)
                            size.append(n)
                            break
            path, ids, at = word, [], len(word)
            while at:
                ids.append(last[at - 1])
                at -= size[at - 1]
            ids.reverse()
            out[word] = array("I", ids).tobytes()
        return out

    def pre_tokens(self, text: str) -> list[str]:
        """Pre-tokens; text of unsettled code points goes through the library's own splitter."""
        if text.isascii() or max(map(ord, text)) < SETTLED:
            return self.find(text)
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path).pre_tokenizer
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    def encode_many(self, texts: list[str]) -> list[bytes]:
        cut: list[list[bytes | int]] = []
        words: set[bytes] = set()
        for text in texts:
            own: list[bytes | int] = []
            for part in self.cut(text):
                if part in self.special:
                    own.append(self.special[part])
                elif part:
                    own += [x.encode() for x in self.pre_tokens(part)]
            words.update(x for x in own if isinstance(x, bytes))
            cut.append(own)
        ids = self.encode_words(list(words))
        return [b"".join(ids[x] if isinstance(x, bytes) else array("I", [x]).tobytes() for x in own) for own in cut]

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the decoded text; bytes that are no UTF-8 become the replacement character."""
        raw = b"".join(map(self.bytes_of.__getitem__, array("I", ids)))
        try:
            raw.decode()
        except UnicodeDecodeError:
            raw = raw.decode(errors="replace").encode()
        return raw


#: By tokenizer file. A worker that runs more tasks keeps what it has encoded, within the bounds.
_encoders: dict[str, tuple[TrieBPE, PieceEncoder]] = {}


def trie_encoder(tokenizer_path: str) -> tuple[TrieBPE, PieceEncoder]:
    if tokenizer_path not in _encoders:
        bpe = TrieBPE(tokenizer_path)
        _encoders[tokenizer_path] = bpe, PieceEncoder(lambda texts: pa.array(bpe.encode_many(texts.to_pylist()), pa.large_binary()))
    return _encoders[tokenizer_path]


def _rows(tokenizer_path: str, keep: list[str], full: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, encoder = trie_encoder(tokenizer_path)
        for batch in small_batches(batches, "text", 4 << 20):
            flat, n = encoder.encode(batch.column("text"))
            raw, ends = flat.tobytes(), 4 * np.cumsum(n)
            ids = [raw[a:b] for a, b in zip((ends - 4 * n).tolist(), ends.tolist())]
            texts = [bpe.decode(x) for x in ids]
            columns = [batch.column(x) for x in keep] + [pa.array([len(x) // 4 for x in ids], pa.int64())]
            if full:
                columns += [pa.array([list(array("I", x)) for x in ids], pa.list_(pa.int32())), pa.array([x.decode() for x in texts], pa.string())]
            else:
                columns += [pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "n_tokens", *(("ids", "decoded") if full else ("ids_sha256", "decoded_sha256"))])

    return lean(run)


def _apply(docs: DataFrame, tokenizer_path: str, full: bool, added: str) -> DataFrame:
    ship(docs.sparkSession)
    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_rows(tokenizer_path, ["doc_id"], full), f"doc_id {kind}, n_tokens long, {added}")


def encode_decode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens, ids array<int>, decoded string of every text. No exchange."""
    return _apply(docs, tokenizer_path, True, "ids array<int>, decoded string")


def encode_decode_digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids and of the decoded text."""
    return _apply(docs, tokenizer_path, False, "ids_sha256 string, decoded_sha256 string")
