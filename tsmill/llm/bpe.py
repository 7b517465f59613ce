"""Byte-pair encoding by backtracking over longest matches, and decoding by an offset table.

A word's tokens under BPE are the one sequence in which every token encodes to itself and every neighbouring pair is
compatible, that is, encoding the two strings together gives the pair back. An Aho-Corasick pass finds the longest token
that starts at each position; the encoder takes it if it is compatible with the token before, else the next shorter
token that is its prefix, else it steps back. Positions that lead nowhere are marked, so each is left at most once and
the work is linear in the word. Compatibility is read from the merges and kept in a table.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

#: Stands for the end-of-word suffix: one symbol more at the end of each word.
END = "￿"
#: Words kept with their tokens by each Python worker; longer words are not kept.
KEPT_WORDS, KEPT_LENGTH = 150_000, 40

_L, _N, _S = "a-zªµºß-öø-ÿĀ-ſ", "0-9²³¹¼-¾", r"\t\n\x0b\x0c\r \x85\xa0"
#: Lower-cased text of code points below U+0180, which no normal form changes.
_PLAIN = re.compile(r"[\x00-ſ]*\Z")
_PIECE = re.compile(rf"[{_L}]+|[{_N}]|'(?:s|t|re|ve|m|ll|d)|[^{_S}{_L}{_N}]+")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, more = [], 256
    for b in range(256):
        out.append(chr(b if b in shown else more))
        more += b not in shown
    return out


class Bpe:
    """Encoder and decoder of a tokenizer file with byte-level BPE and an end-of-word suffix."""

    def __init__(self, path: str):
        import ahocorasick
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.library = Tokenizer.from_file(path)
        suffix = model["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]

        def name(token: str) -> str:
            return token[: -len(suffix)] + END if token.endswith(suffix) else token

        # own numbers: atoms first, then tokens in the order of their merges
        made = {a.removesuffix(suffix) + b if a.endswith(suffix) else a + b for a, b in merges}
        atoms = [t for t in vocab if t not in made]
        number = {t: i for i, t in enumerate(atoms)}
        self.left, self.right = list(range(len(atoms))), list(range(len(atoms)))
        self.merged: dict[tuple[int, int], int] = {}
        for a, b in merges:
            x, y = number[a], number[b]
            self.merged[x, y] = number[a + b] = len(self.left)
            self.left.append(x)
            self.right.append(y)
        self.to_vocab = [0] * len(number)
        strings = [""] * len(number)
        for t, i in number.items():
            self.to_vocab[i], strings[i] = vocab[t], name(t)
        self.length = list(map(len, strings))
        self.compatible: dict[tuple[int, int], bool] = {}
        # a token whose own string encodes otherwise never comes out of an encoding
        sound = [True] * len(number)
        for i in range(len(atoms), len(number)):
            x, y = self.left[i], self.right[i]
            sound[i] = sound[x] and sound[y] and self._split_by(x, y) == i
        self.matcher = ahocorasick.Automaton()
        by_string = {strings[i]: i for i in range(len(number)) if sound[i]}
        for s, i in by_string.items():
            self.matcher.add_word(s, i)
        self.matcher.make_automaton()
        self.shorter = [next((by_string[s[:k]] for k in range(len(s) - 1, 0, -1) if s[:k] in by_string), -1) for s in strings]
        self.letters = byte_letters()
        # decoding: all token strings in one buffer, and where each starts
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        by_id = {i: t for t, i in {**vocab, **special}.items()}
        self.buffer, self.offsets = b"", [0]
        parts = [by_id.get(i, "").encode() for i in range(max(by_id) + 1)]
        for p in parts:
            self.offsets.append(self.offsets[-1] + len(p))
        self.buffer = b"".join(parts)
        self.special = special
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.kept: dict[str, tuple[int, str, bytes]] = {}

    # ------------------------------------------------------------ compatibility
    def _split_by(self, x: int, y: int) -> int:
        """The merge at the seam of x and y that BPE reaches first, given that nothing else changes them; -1 if none."""
        left, right, merged = self.left, self.right, self.merged
        end = len(left)
        bound = end  # merges from here on come too late: they would take a part that is merged away by then
        while True:
            m = merged.get((x, y), end)
            if m < bound:
                return m
            if x > y:  # x is the younger: look at the seam before x was made
                bound, x2 = x, right[x]
                if x2 == x:
                    bound, y2 = y + 1, left[y]
                    if y2 == y:
                        return -1
                    y = y2
                else:
                    x = x2
            else:  # equal merges go left to right, so one of y's own number still comes first
                bound, y2 = y + 1, left[y]
                if y2 == y:
                    bound, x2 = x, right[x]
                    if x2 == x:
                        return -1
                    x = x2
                else:
                    y = y2

    def pair_ok(self, x: int, y: int) -> bool:
        ok = self.compatible.get((x, y))
        if ok is None:
            ok = self._split_by(x, y) < 0
            if len(self.compatible) > 2_000_000:
                self.compatible.clear()
            self.compatible[x, y] = ok
        return ok

    # ------------------------------------------------------------ encoding
    def encode_symbols(self, symbols: str) -> list[int]:
        """Own numbers of the tokens of a word given in byte letters."""
        word = symbols + END
        n = len(word)
        length, shorter, pair_ok = self.length, self.shorter, self.pair_ok
        longest = [-1] * n
        for end, i in self.matcher.iter(word):
            longest[end - length[i] + 1] = i  # ends rise, so the last one found is the longest
        open_ = bytearray(b"\x01") * (n + 1)
        open_[n - 1] = 0  # the end mark is no token of its own
        tokens: list[int] = []
        pos, token = 0, longest[0]
        while pos < n:
            before = tokens[-1] if tokens else -1
            while token >= 0 and not (open_[pos + length[token]] and (before < 0 or pair_ok(before, token))):
                token = shorter[token]
            if token >= 0:
                tokens.append(token)
                pos += length[token]
                token = longest[pos] if pos < n else -1
            else:
                open_[pos] = 0
                if not tokens:
                    raise ValueError(f"no encoding for {symbols[:80]!r}")
                token = tokens.pop()
                pos -= length[token]
                token = shorter[token]
        return tokens

    def encode_word(self, symbols: str) -> list[int]:
        return [self.to_vocab[t] for t in self.encode_symbols(symbols)]

    def words(self, text: str) -> list[str]:
        """Byte-letter words of text; the file's own normalizer and splitter read what lies beyond Latin letters."""
        if _PLAIN.match(text):
            found = _PIECE.findall(text.lower())
            if text.isascii():
                # white space and controls never enter a word, but other controls do
                return found if text.isprintable() or not any(c < " " and c not in "\t\n\x0b\x0c\r" or c == "\x7f" for c in set(text)) else [self.spell(w) for w in found]
            return [w if w.isascii() and w.isprintable() else self.spell(w) for w in found]
        lib = self.library
        return [w for w, _ in lib.pre_tokenizer.pre_tokenize_str(lib.normalizer.normalize_str(text))]

    def spell(self, word: str) -> str:
        letters = self.letters
        return "".join([letters[b] for b in word.encode("utf-8", "surrogatepass")])

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part in self.special_split.split(text) if self.special_split else [text]:
            if part in self.special:
                out.append(self.special[part])
            else:
                for w in self.words(part):
                    out += self.encode_word(w)
        return out

    # ------------------------------------------------------------ decoding
    def decode_bytes(self, ids: list[int]) -> bytes:
        buffer, offsets = self.buffer, self.offsets
        return b" ".join([buffer[offsets[i] : offsets[i + 1]] for i in ids])

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by one space, as for a tokenizer file that names no decoder."""
        return self.decode_bytes(ids).decode()

    # ------------------------------------------------------------ digests of whole texts
    def _entry(self, word: str) -> tuple[int, bytes, bytes]:
        ids = self.encode_word(word)
        entry = len(ids), b" ".join([b"%d" % i for i in ids]), self.decode_bytes(ids)
        if len(word) <= KEPT_LENGTH:
            if len(self.kept) >= KEPT_WORDS:
                self.kept.clear()
            self.kept[word] = entry
        return entry

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids in decimal, SHA-256 of the decoded text."""
        parts = self.special_split.split(text) if self.special_split and "<|" in text else [text]
        n, ids, decoded, get, entry = 0, [], [], self.kept.get, self._entry
        for part in parts:
            if part in self.special:
                i = self.special[part]
                found = [(1, b"%d" % i, self.decode_bytes([i]))]
            else:
                found = [get(w) or entry(w) for w in self.words(part)]
            n += sum([x[0] for x in found])
            ids += [x[1] for x in found]
            decoded += [x[2] for x in found]
        return n, hashlib.sha256(b" ".join(ids)).hexdigest(), hashlib.sha256(b" ".join(decoded)).hexdigest()


_loaded: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _path(path: str | None) -> str:
    """A named file must lie at the same place on every worker; by default each worker asks its installed package."""
    return path or default_path()


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs with a column token_ids (array<int>); a null text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(_path(path))
        for b in batches:
            ids = [bpe.encode(t or "") for t in b.column(b.schema.get_field_index("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*b.schema.names, "token_ids"])

    if "token_ids" in docs.columns:
        docs = docs.drop("token_ids")
    schema = StructType([*docs.schema.fields, StructField("token_ids", ArrayType(IntegerType()))])
    return docs.mapInArrow(run, schema)


def decode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs with a column decoded, the text of token_ids (null: none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(_path(path))
        for b in batches:
            text = [bpe.decode(t or []) for t in b.column(b.schema.get_field_index("token_ids")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(text, pa.string())], names=[*b.schema.names, "decoded"])

    if "decoded" in docs.columns:
        docs = docs.drop("decoded")
    schema = StructType([*docs.schema.fields, StructField("decoded", StringType())])
    return docs.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row. A null text counts as empty; repeated rows each get a row;
    no rows: no rows; texts are taken whole, whatever their length; other columns, whatever their names, are not read.

    Each batch is encoded where it is read: no row moves.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(_path(path))
        for b in batches:
            n, ids, text = [], [], []
            for t in b.column(1).to_pylist():
                x, y, z = bpe.digest(t or "")
                n.append(x)
                ids.append(y)
                text.append(z)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
