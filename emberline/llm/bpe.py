"""Byte-pair encoding and decoding with a segment tree over adjacent pair ranks.

A pre-token is a row of byte symbols. Over its adjacent pairs stands a segment tree whose leaves are
``rank * width + position`` (a huge number where the pair has no merge) and whose inner nodes are the least of
their children, so the root is the leftmost pair of the lowest rank. A merge writes the new symbol, unlinks the
right one and updates three leaves with their ancestors, until the root is no pair. The trees of many
pre-tokens of one padded width are rows of one numpy matrix and take their steps together; each distinct
white-space chunk is encoded once per task and kept in a bounded table.

Text to pre-tokens follows the tokenizer file's pipeline: added tokens are cut out of the raw text, the rest is
put into NFC, white space runs become one blank, characters are lower-cased one by one, and the file's split
pattern keeps letters runs, single digits, other runs and English clitics. Decoding joins the tokens' strings
with blanks, as a file without a decoder says.

Defined cases: null is the empty text and gives no tokens; every byte is in the vocabulary, so all texts encode;
a very long pre-token takes one row of its own (memory in proportion to it); rows are mapped one to one, so
repeated rows, empty tables and further columns come through unchanged.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: White space of the file's patterns (Unicode White_Space).
WHITE = r"\t\n\x0b\x0c\r \x85\xa0  -     　"
#: White space for Python's str.split() but not for the patterns.
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f")
#: Clitics that are pre-tokens of their own, in order of preference.
CLITICS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
NONE = np.int64(2**62)
_RUNS = re.compile(r"a+|0|\.+")
_CHUNKS = re.compile(f"[^{WHITE}]+")


class _Kinds(dict):
    """For str.translate: letters to a, numbers to 0, all else to a dot; looked up once per character."""

    def __missing__(self, code: int) -> str:
        self[code] = {"L": "a", "N": "0"}.get(unicodedata.category(chr(code))[0], ".")
        return self[code]


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordPairs:
    """Vocabulary and merges of a tokenizer file of the byte-level, word-end kind."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, vocab = spec["model"], spec["model"]["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        left, right = (np.array([vocab[m[k]] for m in merges], dtype=np.int64) for k in (0, 1))
        made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        symbols = byte_symbols()
        self.inner = np.array([vocab[c] for c in symbols], dtype=np.int64)
        self.last = np.array([vocab[c + self.suffix] for c in symbols], dtype=np.int64)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: name for name, i in [*vocab.items(), *self.added.items()]}
        order = np.argsort(left << 20 | right, kind="stable")
        self.keys, self.ranks, self.made = (left << 20 | right)[order], order.astype(np.int64), made[order]
        bits = 20
        self.bucket_shift = np.uint64(64 - bits)
        self.slots = np.full(1 << bits, -1, dtype=np.int32)  # open addressing: key number by hash
        for number, slot in enumerate(self._hash(self.keys).tolist()):
            while self.slots[slot] >= 0:
                slot = (slot + 1) & (len(self.slots) - 1)
            self.slots[slot] = number
        self.kinds = _Kinds()
        self.outside = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None

    def split(self, chunk: str) -> list[str]:
        """Pre-tokens of a chunk without white space: clitics, letter runs, single digits, runs of the rest."""
        if chunk.isalpha():
            return [chunk]
        kinds, out, at = chunk.translate(self.kinds), [], 0
        while at < len(chunk):
            clitic = next((c for c in CLITICS if chunk.startswith(c, at)), None) if chunk[at] == "'" else None
            to = at + len(clitic) if clitic else _RUNS.match(kinds, at).end()
            out.append(chunk[at:to])
            at = to
        return out

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.bucket_shift).astype(np.int64)

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The number of each pair among the merges, -1 for none; symbols below 0 make none."""
        keys = left << 20 | right
        slot = self._hash(keys)
        found = self.slots[slot]
        out = np.full(len(keys), -1, dtype=np.int64)
        todo = np.flatnonzero((found >= 0) & (left >= 0) & (right >= 0))
        while len(todo):
            number = found[todo]
            hit = self.keys[number] == keys[todo]
            out[todo[hit]] = number[hit]
            todo = todo[~hit]
            slot[todo] = (slot[todo] + 1) & (len(self.slots) - 1)
            found[todo] = self.slots[slot[todo]]
            todo = todo[found[todo] >= 0]
        return out

    def merge_rows(self, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Merge each row of ``symbols`` (rows x width, a power of two) in place; merged-away places become -1."""
        rows, width = symbols.shape
        wide = np.arange(width, dtype=np.int64)
        after = np.where(wide[None] + 1 < sizes[:, None], wide[None] + 1, -1)
        before = np.broadcast_to(wide - 1, (rows, width)).copy()
        pairs = self.pair(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(rows, width - 1) if width > 1 else np.zeros((rows, 0), np.int64)
        tree = np.full((rows, 2 * width), NONE)
        tree[:, width : 2 * width - 1] = np.where(pairs >= 0, self.ranks[pairs] * width + wide[:-1], NONE)
        level = width
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2

        def put(row: np.ndarray, place: np.ndarray, value: np.ndarray) -> None:
            node = place + width
            tree[row, node] = value
            while node[0] > 1:
                node = node >> 1
                tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])

        def refresh(row: np.ndarray, place: np.ndarray) -> None:
            follower = after[row, place]
            number = self.pair(symbols[row, place], np.where(follower >= 0, symbols[row, follower], -1))
            put(row, place, np.where(number >= 0, self.ranks[number] * width + place, NONE))

        by_rank = np.empty(len(self.ranks), dtype=np.int64)
        by_rank[self.ranks] = self.made
        active = np.flatnonzero(tree[:, 1] < NONE)
        while len(active):
            root = tree[active, 1]
            place = root % width
            gone = after[active, place]
            symbols[active, place] = by_rank[root // width]
            symbols[active, gone] = -1
            follower = after[active, gone]
            after[active, place] = follower
            some = follower >= 0
            before[active[some], follower[some]] = place[some]
            put(active, gone, np.full(len(active), NONE))
            refresh(active, place)
            leader = before[active, place]
            some = leader >= 0
            if some.any():
                refresh(active[some], leader[some])
            active = active[tree[active, 1] < NONE]
        return symbols

    def encode_pretokens(self, pretokens: list[bytes], cells: int = 1 << 18) -> list[bytes]:
        """Ids (little-endian, 32 bits) of each pre-token (its UTF-8 bytes, not empty), in blocks of at most ``cells`` matrix cells or one row."""
        out = [b""] * len(pretokens)
        sizes = np.array([len(p) for p in pretokens], dtype=np.int64)
        widths = 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64)
        for width in np.unique(widths).tolist():
            members = np.flatnonzero(widths == width)
            step = max(1, cells // width)
            for at in range(0, len(members), step):
                block = members[at : at + step]
                size = sizes[block]
                raw = np.frombuffer(b"".join(pretokens[i] for i in block), dtype=np.uint8)
                symbols = np.full((len(block), width), -1, dtype=np.int64)
                symbols[np.arange(width)[None] < size[:, None]] = self.inner[raw]
                ends = np.cumsum(size) - 1
                symbols[np.arange(len(block)), size - 1] = self.last[raw[ends]]
                self.merge_rows(symbols, size)
                left = symbols >= 0
                ids = symbols[left].astype("<u4").tobytes()
                stops = np.cumsum(left.sum(axis=1)) * 4
                for i, start, stop in zip(block.tolist(), [0, *stops.tolist()], stops.tolist()):
                    out[i] = ids[start:stop]
        return out

    def normal(self, text: str) -> str:
        """NFC, then every character in lower case by itself (a final sigma is no exception)."""
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def pieces(self, text: str) -> list[str | int]:
        """White-space chunks of a raw text in order, and the ids of added tokens between them."""
        if not (self.outside and self.outside.search(text)):
            return self._chunks(text)
        out, at = [], 0
        for found in self.outside.finditer(text):
            out += [*self._chunks(text[at : found.start()]), self.added[found[0]]]
            at = found.end()
        return out + self._chunks(text[at:])

    def _chunks(self, text: str) -> list[str]:
        text = self.normal(text)
        return _CHUNKS.findall(text) if any(c in text for c in _ODD) else text.split()


class Encoder:
    """Encodes many texts; keeps the ids of up to ``keep`` distinct chunks, of the newest batch in any case."""

    def __init__(self, pairs: WordPairs, keep: int = 200_000):
        self.pairs, self.keep = pairs, keep
        self.known: dict[str | int, bytes] = {i: i.to_bytes(4, "little") for i in pairs.added.values()}

    def _learn(self, chunks: set[str]) -> None:
        cuts = [(c, self.pairs.split(c)) for c in chunks]
        tokens = list({p for _, parts in cuts for p in parts})
        ids = dict(zip(tokens, self.pairs.encode_pretokens([p.encode("utf-8") for p in tokens])))
        for chunk, parts in cuts:
            self.known[chunk] = b"".join([ids[p] for p in parts])

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """The token ids of each text."""
        cut = [self.pairs.pieces(t) for t in texts]
        wanted = set().union(*cut)
        fresh = wanted.difference(self.known)
        if len(self.known) + len(fresh) > self.keep:
            added = self.pairs.added.values()
            self.known = {c: v for c, v in self.known.items() if c in wanted or c in added}
        self._learn(fresh)
        get = self.known.__getitem__
        return [np.frombuffer(b"".join(map(get, chunks)), dtype="<u4") for chunks in cut]


def decoder(pairs: WordPairs):
    """A function from ids to the text they decode to: the tokens' strings, joined with blanks."""
    table = np.empty(max(pairs.names) + 1, dtype=object)
    for number, name in pairs.names.items():
        table[number] = name
    return lambda ids: " ".join(table[ids].tolist())


def encode(docs: DataFrame, tokenizer_path: str, batch_chars: int = 2_000_000) -> DataFrame:
    """``docs`` with ``token_ids array<int>`` (whole texts; null as empty) in place of any such column."""
    return _over_texts(docs, tokenizer_path, [("token_ids", T.ArrayType(T.IntegerType()), pa.list_(pa.int32()))], batch_chars, lambda ids, _: [ids.astype(np.int32) for ids in ids])


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """``encoded`` with ``decoded string`` made from ``token_ids``."""
    schema = T.StructType([f for f in encoded.schema.fields if f.name.lower() != "decoded"] + [T.StructField("decoded", T.StringType())])
    kept = [f.name for f in schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = decoder(WordPairs(tokenizer_path))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [read(ids.values.to_numpy() if ids.is_valid else []) for ids in part.column("token_ids")]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], pa.array(texts, pa.string())], names=[*kept, "decoded"])

    return encoded.select(*kept).mapInArrow(run, schema)


def _over_texts(docs: DataFrame, tokenizer_path: str, made: list, batch_chars: int, compute) -> DataFrame:
    new = {name.lower() for name, _, _ in made}
    kept = [f for f in docs.schema.fields if f.name.lower() not in new]
    schema = T.StructType(kept + [T.StructField(name, kind) for name, kind, _ in made])
    text_at = [f.name for f in kept].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = WordPairs(tokenizer_path)
        encoder, extra = Encoder(pairs), {"decode": decoder(pairs)}
        for batch in batches:
            texts = batch.column(text_at)
            sizes = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + batch.num_rows + 1]
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(sizes, sizes[at] + batch_chars, side="right")) - 1)
                part = batch.slice(at, to - at)
                ids = encoder.encode_batch([t or "" for t in part.column(text_at).to_pylist()])
                values = compute(ids, extra)
                columns = [pa.array(v, k) for v, (_, _, k) in zip([values] if len(made) == 1 else values, made)]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=schema.names)
                at = to

    return docs.select(*(f.name for f in kept)).mapInArrow(run, schema)


def encode_checked(docs: DataFrame, tokenizer_path: str, batch_chars: int = 2_000_000) -> DataFrame:
    """``docs`` with ``token_ids`` as of :func:`encode` and the ``decoded_sha256`` of the text that :func:`decode` makes of them.

    Both run in one task with one tokenizer: ids need not come back to Python, and an executor holds half the workers.
    """
    import hashlib

    def compute(encoded: list[np.ndarray], extra: dict) -> tuple:
        return [ids.astype(np.int32) for ids in encoded], [hashlib.sha256(extra["decode"](ids).encode("utf-8")).hexdigest() for ids in encoded]

    made = [("token_ids", T.ArrayType(T.IntegerType()), pa.list_(pa.int32())), ("decoded_sha256", T.StringType(), pa.string())]
    return _over_texts(docs, tokenizer_path, made, batch_chars, compute)


def digests(docs: DataFrame, tokenizer_path: str, batch_chars: int = 2_000_000) -> DataFrame:
    """``docs`` with n_tokens, ids_sha256 and decoded_sha256 of every encoded and decoded text.

    The same encoder and decoder as :func:`encode` and :func:`decode`, digested where they run: ids and decoded
    texts, several times the input, need not leave the task.
    """
    import hashlib

    def compute(encoded: list[np.ndarray], extra: dict) -> tuple:
        sha = lambda raw: hashlib.sha256(raw).hexdigest()
        return [len(i) for i in encoded], [sha(i.tobytes()) for i in encoded], [sha(extra["decode"](i).encode("utf-8")) for i in encoded]

    made = [("n_tokens", T.LongType(), pa.int64()), ("ids_sha256", T.StringType(), pa.string()), ("decoded_sha256", T.StringType(), pa.string())]
    return _over_texts(docs, tokenizer_path, made, batch_chars, compute)
