"""BPE encoding as a streaming transducer, and incremental decoding.

A sequence of tokens is what byte-pair encoding produces exactly when every
two neighbours stay apart on their own (``MergeList.apart``).  So the last
token of each prefix of a word follows from the prefixes before it, one symbol
at a time.  The token that covers the next symbol starts at most the length of the
longest token less one back, so every later result continues from one of these
positions.  What the token chains of all of them share is final: it is emitted
and forgotten.  How many symbols can stay open follows from the merge list
(``MergeList.lookahead``), not from the word: merges that wait for each other
can only form chains of falling rank.

Decoding is a state machine that keeps at most an unfinished UTF-8 sequence
(byte-level vocabularies) or the fact that a token was seen (vocabularies
without a decoder, whose tokens are joined by a space).
"""

from __future__ import annotations

import codecs
import json
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# The white space of Unicode as the patterns of the vocabulary files mean it, the letters and
# numbers below U+0250, and the split pattern that byte-level pre-tokenizers use when their file names none.
SPACE = "\\t-\\r \\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"
LATIN_LETTERS = r"A-Za-z\xAA\xB5\xBA\xC0-\xD6\xD8-\xF6\xF8-\u024F"
LATIN_NUMBERS = r"0-9\xB2\xB3\xB9\xBC-\xBE"
BEYOND_LATIN = re.compile(r"[^\x00-\u024F]")
BYTE_LEVEL_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHED_WORDS = 80_000  # in each of two generations, about 200 bytes each
CACHED_PAIRS = 250_000  # about 130 bytes each
LONG_WORD = 64
BATCH_BYTES = 4 << 20  # texts and ids handed on at a time


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if printable, else the next free one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(free)) for b in range(256)]


class MergeList:
    """The merges of a vocabulary: which tokens exist, how each is made, and which neighbours stay apart."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        self.suffix = suffix
        self.inner: dict[str, int] = {}
        self.ending: dict[str, int] = {}  # tokens that end a word, without their suffix
        for token, number in vocab.items():
            if suffix and token.endswith(suffix):
                self.ending[token[:-len(suffix)]] = number
            else:
                self.inner[token] = number
        if not suffix:
            self.ending = self.inner
        self.starts: dict = {}  # tree of all tokens by symbol; under "" the token that ends there inside a word
        for token in {*self.inner, *self.ending}:
            node = self.starts
            for symbol in token:
                node = node.setdefault(symbol, {})
            node[""] = self.inner.get(token), self.ending.get(token)
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for rank, merge in enumerate(merges):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            pair = vocab[left], vocab[right]
            self.rank.setdefault(pair, rank)
            self.made.setdefault(vocab[left + right], (rank, *pair))
        self.longest = max([len(t) for t in self.inner] + [len(t) for t in self.ending])
        self.sizes = {number: len(t) for tokens in (self.inner, self.ending) for t, number in tokens.items()}
        self._known: dict[tuple[int, int], bool] = {}

    @cached_property
    def lookahead(self) -> int:
        """The sufficient lookahead: how many symbols after a merge can still decide whether it happens.

        A merge fails if its right piece, or a piece at the right end of that, merges to the right first.  Such a
        merge has a lower rank and may itself fail through one of lower rank still, so the reach of each merge
        follows from those before it.
        """
        reached: dict[int, tuple[list[int], list[int]]] = {}  # by left piece: ranks, and the furthest reach up to each
        furthest = 0
        for (left, right), rank in sorted(self.rank.items(), key=lambda item: item[1]):
            reach, piece, until = 0, right, rank
            while True:
                ranks, best = reached.get(piece, ((), ()))
                if (before := bisect_left(ranks, until)):
                    reach = max(reach, best[before - 1])
                if (how := self.made.get(piece)) is None:
                    break
                until, piece = how[0], how[2]
            furthest = max(furthest, reach)
            ranks, best = reached.setdefault(left, ([], []))
            ranks.append(rank)
            best.append(max(best[-1] if best else 0, self.sizes[right] + reach))
        return furthest

    def apart(self, left: int, right: int) -> bool:
        """Whether encoding the text of the two tokens gives the two tokens.

        Goes back in time from the finished tokens to their symbols, along the
        pieces that touch the border.  A merge across the border happens if
        its rank comes before the merges that take its two pieces away.
        """
        key = left, right
        if (known := self._known.get(key)) is not None:
            return known
        left_until = right_until = 1 << 60
        result = True
        while True:
            rank = self.rank.get((left, right))
            # Of equal merges the one further left goes first.
            if rank is not None and rank < left_until and rank <= right_until:
                result = False
                break
            of_left, of_right = self.made.get(left), self.made.get(right)
            if of_left is None and of_right is None:
                break
            if of_right is None or (of_left is not None and of_left[0] > of_right[0]):
                left_until, left = of_left[0], of_left[2]
            else:
                right_until, right = of_right[0], of_right[1]
        if len(self._known) >= CACHED_PAIRS:
            self._known.clear()
        self._known[key] = result
        return result


class Transducer:
    """Symbols of one word in, tokens out as soon as they are final."""

    def __init__(self, merges: MergeList):
        self.merges = merges
        self.clear()

    def clear(self) -> None:
        self.size = 0  # symbols since the last emitted token
        self.limit = 4 * self.merges.longest  # symbols after which tokens are looked for that are final
        self.held = ""  # one symbol that may be the last of the word
        self.tokens, self.before = [-1], [0]  # last token of each prefix, and where it begins
        self.open: list[tuple[int, dict]] = []  # where tokens may have begun, longest first, with their place in the tree

    def _step(self, symbol: str, last: bool) -> None:
        tokens, known, apart = self.tokens, self.merges._known, self.merges.apart
        still, found = [], False
        self.open.append((self.size, self.merges.starts))
        for start, node in self.open:
            node = node.get(symbol)
            if node is None:
                continue
            still.append((start, node))
            if not found and (ends := node.get("")) is not None and (token := ends[last]) is not None:
                left = tokens[start]
                if left >= 0:
                    fits = known.get((left, token))
                    if not (apart(left, token) if fits is None else fits):
                        continue
                tokens.append(token)
                self.before.append(start)
                found = True
        if not found:
            raise ValueError(f"the vocabulary has no token for {symbol!r}")
        self.open = still
        self.size += 1

    def _chain(self, end: int) -> list[int]:
        out = []
        while end > 0:
            out.append(self.tokens[end])
            end = self.before[end]
        return out[::-1]

    def feed(self, symbols: str) -> list[int]:
        """Takes more symbols of the word and returns the tokens that are final now."""
        out: list[int] = []
        for symbol in symbols:
            if self.held:
                self._step(self.held, False)
                if self.size > self.limit:
                    out += self._settled()
                    # Beyond the lookahead and the tokens around it nothing can stay open.
                    self.limit = max(4 * self.merges.longest, 2 * self.size)
                    if self.size > self.merges.lookahead + 2 * self.merges.longest:
                        raise AssertionError("more symbols are open than the merge list allows")
            self.held = symbol
        return out

    def _settled(self) -> list[int]:
        """The tokens that the chains of all positions share from which a token may still go on; they are cut off."""
        end = self.size
        open_ends = set(range(max(0, end - self.merges.longest + 1), end + 1))
        while len(open_ends) > 1:
            latest = max(open_ends)
            open_ends.remove(latest)
            open_ends.add(self.before[latest])
        border = open_ends.pop()
        out = self._chain(border)
        if border:
            self.size -= border
            self.open = [(start - border, node) for start, node in self.open]
            self.tokens = self.tokens[border:]  # the first one is the last emitted token
            self.before = [max(0, b - border) for b in self.before[border:]]
        return out

    def finish(self) -> list[int]:
        """The rest of the word; the transducer is then ready for the next one."""
        if not self.held:
            return []
        self._step(self.held, True)
        out = self._chain(self.size)
        self.clear()
        return out


def _spelled_out(pattern: str, classes: dict[str, str]) -> str:
    """The pattern with its character classes written as explicit characters, inside and outside of sets."""
    out, i, in_set = [], 0, False
    while i < len(pattern):
        name = next((c for c in classes if pattern.startswith("\\" + c, i)), None)
        negated = pattern.startswith("\\S", i) and "s" in classes
        if name or negated:
            out.append(classes[name] if in_set else f"[{'^' if negated else ''}{classes[name or 's']}]")
            i += 1 + len(name or "S")
            continue
        step = 2 if pattern[i] == "\\" else 1
        in_set = (in_set or pattern[i] == "[") and pattern[i] != "]"
        out.append(pattern[i:i + step])
        i += step
    return "".join(out)


class Vocabulary:
    """What a tokenizer file says: normalisation, words, merges, special tokens and decoding."""

    def __init__(self, data: bytes):
        spec = json.loads(data)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("byte_fallback"):
            raise ValueError("only plain BPE models are read")
        self.merges = MergeList(model["vocab"], model["merges"], model.get("end_of_word_suffix") or "")
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.normalizers = self._parts(spec.get("normalizer"), "normalizers")
        splits = [p for p in self._parts(spec.get("pre_tokenizer"), "pretokenizers")]
        pattern = next((p["pattern"]["Regex"] for p in splits if p["type"] == "Split"), BYTE_LEVEL_SPLIT)
        self.words = regex.compile(_spelled_out(pattern, {"s": SPACE}))
        self.latin_words = re.compile(_spelled_out(pattern, {"s": SPACE, "p{L}": LATIN_LETTERS, "p{N}": LATIN_NUMBERS}))
        # Words found by a Split that removes everything else hold no white space, so replacing it changes nothing.
        if any(p["type"] == "Split" and p["behavior"] == "Removed" and p["invert"] for p in splits):
            self.normalizers = [n for n in self.normalizers if n["type"] != "Replace"]
        specials = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, specials)) + ")") if specials else None
        self.byte_level = bool(spec.get("decoder")) and "ByteLevel" in json.dumps(spec["decoder"])
        self.symbols = byte_symbols()
        self.to_symbols = {b: c for b, c in enumerate(self.symbols)}
        self.names = {number: token for token, number in [*model["vocab"].items(), *self.special.items()]}

    @staticmethod
    def _parts(spec: dict | None, inside: str) -> list[dict]:
        return [] if spec is None else spec[inside] if spec["type"] == "Sequence" else [spec]

    def normal(self, text: str) -> str:
        for part in self.normalizers:
            if part["type"] in ("NFC", "NFD", "NFKC", "NFKD"):
                text = unicodedata.normalize(part["type"], text)
            elif part["type"] == "Lowercase":
                text = text.replace("Σ", "σ").lower()  # character by character: no final sigma
            elif part["type"] == "Replace" and part["pattern"] == {"Regex": "\\s+"}:
                text = regex.sub(f"[{SPACE}]+", part["content"], text)
            else:
                raise ValueError(f"unknown normalizer {part['type']}")
        return text

    def split(self, text: str) -> list[str]:
        """The words of a normalised text."""
        return (self.words if BEYOND_LATIN.search(text) else self.latin_words).findall(text)


class Encoder(dict):
    """Text to token ids.

    As a dict: short word -> its ids as 32-bit integers.  When it is full it becomes the older of two generations,
    from which words that come again are taken over.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.older: dict[str, bytes] = {}
        self.transducer = Transducer(vocabulary.merges)

    def _stream(self, word: str) -> Iterator[int]:
        for start in range(0, len(word), 4096):
            piece = word[start:start + 4096].encode("utf-8", "surrogatepass").decode("latin-1")
            yield from self.transducer.feed(piece.translate(self.vocabulary.to_symbols))
        yield from self.transducer.finish()

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = np.fromiter(self._stream(word), dtype=np.int32).tobytes()
        if len(word) <= LONG_WORD:
            if len(self) >= CACHED_WORDS:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def pieces(self, text: str) -> Iterator[bytes]:
        """The ids of the parts between special tokens, and of these."""
        vocabulary = self.vocabulary
        for i, part in enumerate(vocabulary.cut.split(text) if vocabulary.cut else [text]):
            if i % 2:
                yield np.int32(vocabulary.special[part]).tobytes()
            elif part:
                yield b"".join(map(self.__getitem__, vocabulary.split(vocabulary.normal(part))))

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(self.pieces(text)), dtype=np.int32)


class Decoder:
    """Token ids to text, piece by piece; special tokens stay."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.names = np.full(max(vocabulary.names, default=0) + 1, "", dtype=object)
        for number, token in vocabulary.names.items():
            self.names[number] = token
        self.bytes = {symbol: bytes([b]) for b, symbol in enumerate(vocabulary.symbols)}
        self.clear()

    def clear(self) -> None:
        self.started = False
        self.partial = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int] | np.ndarray) -> str:
        """The text that these ids complete; what is unfinished waits for the next ones."""
        names = self.names[np.asarray(ids, dtype=np.int64)].tolist()
        if not names:
            return ""
        if self.vocabulary.byte_level:
            data = b"".join(self.bytes.get(c) or c.encode() for c in chain.from_iterable(names))
            return self.partial.decode(data)
        out = (" " if self.started else "") + " ".join(names)
        self.started = True
        return out

    def finish(self) -> str:
        out = self.partial.decode(b"", True) if self.vocabulary.byte_level else ""
        self.clear()
        return out

    def text(self, ids: np.ndarray, step: int = 1 << 16) -> str:
        parts = [self.feed(ids[i:i + step]) for i in range(0, len(ids), step)]
        return "".join(parts) + self.finish()


def read_vocabulary(path: str) -> bytes:
    """The tokenizer file at ``path``, read where the query is written; it travels to the tasks."""
    with open(path, "rb") as file:
        return file.read()


def _list_batches(flat: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in flat])]).astype(np.int32)
    values = np.concatenate(flat) if flat else np.zeros(0, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=pa.int32()))


def _texts(column: pa.Array) -> Iterator[tuple[int, str]]:
    """The texts of a column one after the other, missing ones empty; a batch is never turned into a list at once."""
    for i in range(len(column)):
        yield i, column[i].as_py() or ""


def _in_parts(batch: pa.RecordBatch, made: Iterator[tuple[list, int]], names: list[str], arrays) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of about ``BATCH_BYTES`` with the new columns that ``arrays`` builds from what ``made`` gives row by row."""
    start, held, size = 0, [], 0
    for i, (values, more) in enumerate(made):
        held.append(values)
        size += more
        if size >= BATCH_BYTES or i + 1 == batch.num_rows:
            part = batch.slice(start, len(held))
            yield pa.RecordBatch.from_arrays([*part.columns, *arrays(held)], [*part.schema.names, *names])
            start, held, size = i + 1, [], 0


def encode_documents(docs: DataFrame, vocabulary: bytes, out: str = "ids", decoded: str | None = None) -> DataFrame:
    """``docs`` plus ``out``, the token ids of the whole text, and, if named, ``decoded``, the text of these ids.

    NULL and empty texts have no ids, and an empty decoded text.  The result is that of the tokenizer file's own
    encoder without special tokens added; special tokens written in a text count as such.  Columns called ``out`` or
    ``decoded`` are replaced.  Both are made in one pass, so that a task holds the vocabulary once.
    """
    names = [out] if decoded is None else [out, decoded]
    docs = docs.drop(*names)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # one file, whatever the data's size
    new = [T.StructField(out, T.ArrayType(T.IntegerType())), *([T.StructField(decoded, T.StringType())] if decoded else [])]
    schema = T.StructType([*docs.schema.fields, *new])
    at = docs.columns.index("text")

    def run(batches):
        known = Vocabulary(shared.value)
        encoder, decoder = Encoder(known), Decoder(known)
        none = np.zeros(0, dtype=np.int32)

        def made(column):
            for _, text in _texts(column):
                ids = encoder.ids(text) if text else none
                back = decoder.text(ids) if decoded and len(ids) else ""
                yield (ids, back), len(text) + ids.nbytes + len(back)

        def arrays(held):
            ids = _list_batches([ids for ids, _ in held])
            return [ids, pa.array([back for _, back in held], type=pa.string())] if decoded else [ids]

        for batch in batches:
            yield from _in_parts(batch, made(batch.column(at)), names, arrays)

    return docs.mapInArrow(run, schema)


def decode_documents(docs: DataFrame, vocabulary: bytes, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` plus ``out``, the text of the token ids in column ``ids`` (NULL or no ids: empty).

    A column called ``out`` is replaced.
    """
    docs = docs.drop(out)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.StringType())])
    at = docs.columns.index(ids)

    def run(batches):
        decoder = Decoder(Vocabulary(shared.value))

        def made(column):
            for i in range(len(column)):
                x = column[i]
                text = decoder.text(x.values.to_numpy()) if x.is_valid and len(x.values) else ""
                yield text, len(text)

        for batch in batches:
            yield from _in_parts(batch, made(batch.column(at)), [out], lambda held: [pa.array(held, type=pa.string())])

    return docs.mapInArrow(run, schema)
