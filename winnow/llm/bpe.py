"""Byte-level BPE as a lazily determinised finite-state transducer, and streaming decoding.

Encoding. The rank table is the list of merges. A segmentation into tokens is what the merges give exactly if every two
neighbouring tokens, merged on their own bytes, come out as those two tokens. So after each byte one token can end there and
follow what was chosen before it, and what lies further back than the longest token prefix that is still open does not
matter. A state therefore holds the open bytes and, for each place among them where a token may end, the tokens not yet
emitted up to that place. Tokens shared by all those places are settled: the step that settles them emits them, so
output waits for no more bytes than the longest token has. States and steps are made when first met and kept.

Text is split by the pattern first; every match is run through the transducer, and frequent matches are remembered.

Decoding. Bytes of the ids go through a UTF-8 state machine that accepts input in pieces of any size: a character
that a piece cuts in two is held until the next piece, and bytes that are no UTF-8 become U+FFFD.

Matches are remembered, and chunks of text from their second time on, in two halves: when the younger is full it becomes the older, so what is frequent stays. Each
worker of an executor has tables of its own, so all are bounded (``MAX_STATES``, ``MAX_FITS``, ``MAX_EDGES``, ``MAX_WORDS``), to about 220 MB
together; results do not depend on that. Defined cases:
null counts as empty; an empty text has no ids; the sha256 of nothing is that of the empty byte string.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm import workers

MAX_STATES = 250_000
MAX_FITS = 150_000
MAX_EDGES = 20_000
HEAD = 5  # bytes taken in one step
MAX_WORDS = 120_000
FILTER = (1 << 20) - 1  # places of the filter that says which chunks were met before, from 0
LONG_WORD = 64
PIECE_TOKENS = 1 << 16
#: The pattern of the public byte-level vocabularies (fixed value); others are matched over whole texts.
CUT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_BYTES = [bytes([b]) for b in range(256)]
#: A space before more white space or the end: there, cutting at single spaces would change the matches.
_LOOSE = re.compile(r" (?=\s|\Z)")
#: A word of Latin letters and at most a run of marks after it: one or two matches of the pattern.
_PLAIN = re.compile("( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([!#$%&*,.:;?]*)\\Z")


class Transducer:
    """Emits the ids of one byte string, byte by byte."""

    START = (b"", ((),))

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.openings = {b[:k] for b in ranks for k in range(1, len(b) + 1)}
        #: Each state's node: the state itself under -1, and by byte the next node and the tokens emitted on the way.
        self.nodes: dict[tuple, dict] = {}
        #: Where frequent beginnings lead, in one step.
        self.jumps: dict[bytes, tuple[dict, list[int]]] = {}
        self.fits: dict[int, bool] = {}
        self.edges: dict[tuple[int, int], list[tuple[bytes, int]]] = {}
        #: Steps made since the states are full; those are not kept.
        self.passing = 0
        self.start = self._node(self.START)

    def merged(self, data: bytes) -> list[bytes]:
        """The merges by definition, short of the one that makes ``data`` itself. Only for tokens."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 2:
            _, i = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def edge(self, token: int, side: int) -> list[tuple[bytes, int]]:
        """What stands at one end (0: first, -1: last) while a token is built: pieces and the ranks that make them."""
        known = self.edges.get((token, side))
        if known is None:
            data, known = self.bytes_of[token], []
            while len(data) > 1:
                known.append((data, self.ranks[data]))
                data = self.merged(data)[side]
            if len(self.edges) >= MAX_EDGES:
                self.edges.clear()
            known = self.edges[token, side] = [(data, -1), *reversed(known)]
        return known

    def fit(self, left: int, right: int) -> bool:
        """Whether two tokens side by side stay these two tokens: no merge across the border comes before both are built."""
        key = left << 20 | right
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) > MAX_FITS:
                self.fits.clear()
            last, first = self.edge(left, -1), self.edge(right, 0)
            i = j = 0
            known = True
            while known:
                across = self.ranks.get(last[i][0] + first[j][0], 1 << 60)
                more_left = last[i + 1][1] if i + 1 < len(last) else 1 << 60
                more_right = first[j + 1][1] if j + 1 < len(first) else 1 << 60
                if across < more_left and across <= more_right and across < 1 << 60:
                    known = False
                elif more_left <= more_right and more_left < 1 << 60:
                    i += 1
                elif more_right < 1 << 60:
                    j += 1
                else:
                    break
            self.fits[key] = known
        return known

    def _node(self, state: tuple) -> dict:
        node = self.nodes.get(state)
        if node is None:
            node = self.nodes[state] = {-1: state}
        return node

    def _step(self, state: tuple, byte: int) -> tuple[tuple, tuple[int, ...]]:
        """A state is (open bytes, paths): paths[k] are the tokens not yet emitted up to the place after k open bytes.

        Every path keeps its last token, which decides what may follow; a place where no token ends has None.
        """
        data, paths = state
        data += _BYTES[byte]
        size, best, openings = len(data), None, self.openings
        cut = 0
        while cut < size and (paths[cut] is None or data[cut:] not in openings):
            cut += 1
        for k in range(cut, size):  # the longest fitting token that ends here; a token is an opening, so none starts before the cut
            path = paths[k]
            if path is not None:
                token = self.ranks.get(data[k:])
                if token is not None and (not path or self.fits.get(path[-1] << 20 | token) or self.fit(path[-1], token)):
                    best = (*path, token)
                    break
        paths = (*paths[cut:], best)
        alive = [p for p in paths if p is not None]
        first, shared = alive[0], 0
        if len(alive) == 1:
            shared = max(0, len(first) - 1)
        else:
            least = min(map(len, alive)) - 1
            while shared < least and all([p[shared] == first[shared] for p in alive]):
                shared += 1
        if shared > 0:
            paths = tuple([None if p is None else p[shared:] for p in paths])
        return (data[cut:], paths), first[:shared]

    def encode(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        if self.passing > MAX_STATES:  # what is met now is not what the kept states were made for
            self.passing = 0
            for node in self.nodes.values():  # nodes hold each other
                node.clear()
            self.nodes.clear()
            self.jumps.clear()
            self.start = self._node(self.START)
        head = data[:HEAD]
        jump = self.jumps.get(head)
        if jump is None:
            if len(self.jumps) >= MAX_EDGES:
                self.jumps.clear()
            jump = self.jumps[head] = self.walk(self.start, head, [])
        node, out = jump
        if len(data) > HEAD:
            node, out = self.walk(node, data[HEAD:], out.copy())
        return out + list(node[-1][1][-1] or ())

    def walk(self, node: dict, data: bytes, out: list[int]) -> tuple[dict, list[int]]:
        """The node that ``data`` leads to, and ``out`` with what is emitted on the way."""
        for byte in data:
            step = node.get(byte)
            if step is None:
                state, emitted = self._step(node[-1], byte)
                if len(self.nodes) < MAX_STATES:
                    step = node[byte] = (self._node(state), emitted)
                else:
                    self.passing += 1
                    step = self.nodes.get(state) or {-1: state}, emitted
            node, emitted = step
            if emitted:
                out += emitted
        return node, out


class Remembered:
    """Ids of strings in a younger and an older half, and a filter of what was met before."""

    def __init__(self):
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}
        self.met = bytearray(FILTER + 1)

    def keep(self, text: str, ids: tuple[int, ...]) -> None:
        if len(self.young) >= MAX_WORDS:
            # In place: whoever holds the younger half keeps holding it.
            self.old = dict(self.young)
            self.young.clear()
            self.met = bytearray(FILTER + 1)
        self.young[text] = ids


class Codec:
    """Texts to ids and back, for one rank table and pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.machine = Transducer(ranks)
        self.split = regex.compile(pattern).findall
        #: Only a pattern that takes a space with what follows it may be cut before spaces.
        self.spaced = pattern == CUT_PATTERN
        self.words, self.chunks = Remembered(), Remembered()
        self.names = {i: str(i) for i in ranks.values()}

    def word(self, word: str) -> tuple[int, ...]:
        seen = self.words
        ids = seen.old.get(word)
        if ids is None:
            ids = tuple(self.machine.encode(word.encode("utf-8", "surrogatepass")))
        if len(word) <= LONG_WORD:
            seen.keep(word, ids)
        return ids

    def chunk(self, chunk: str) -> tuple[int, ...]:
        seen = self.chunks
        ids = seen.old.get(chunk)
        if ids is not None:
            seen.keep(chunk, ids)
            return ids
        plain = _PLAIN.match(chunk)
        if plain:
            word, mark = plain.groups()
            ids = seen.young.get(word) or seen.old.get(word) or tuple(self.machine.encode(word.encode()))
            if mark:
                ids += self.words.young.get(mark) or self.word(mark)
        else:
            known = self.words.young.get
            ids = tuple([i for word in self.split(chunk) for i in known(word) or self.word(word)])
        trace = hash(chunk) & FILTER
        if not seen.met[trace]:
            seen.met[trace] = 1
        elif len(chunk) <= LONG_WORD:
            seen.keep(chunk, ids)
        return ids

    def encode(self, text: str | None) -> list[int]:
        """No match of the pattern reaches over a space that something other than white space follows.

        So text is cut there first, and the ids of frequent chunks are remembered whole.
        """
        if not text:
            return []
        if not self.spaced or _LOOSE.search(text):
            known = self.words.young.get
            return [i for word in self.split(text) for i in known(word) or self.word(word)]
        known = self.chunks.young.get
        chunks = text.replace(" ", "\0 ").split("\0") if "\0" not in text else regex.split("(?= )", text, flags=regex.V1)
        return [i for chunk in chunks if chunk for i in known(chunk) or self.chunk(chunk)]

    def decode_bytes(self, ids: Iterable[int]) -> Iterator[bytes]:
        """The bytes of the ids, in pieces of bounded size."""
        ids, table = list(ids), self.machine.bytes_of
        for at in range(0, len(ids), PIECE_TOKENS):
            yield b"".join([table[i] for i in ids[at:at + PIECE_TOKENS]])

    def decode_stream(self, ids: Iterable[int]) -> Iterator[str]:
        """The text of the ids, in pieces of bounded size that never cut a character."""
        reader = Utf8()
        for piece in self.decode_bytes(ids):
            yield reader.feed(piece)
        yield reader.end()

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(self.decode_stream(ids))

    def listed(self, ids: Iterable[int]) -> str:
        """Decimal ids, joined by one space."""
        names = self.names
        return " ".join([names[i] for i in ids])


class Utf8:
    """Incremental UTF-8: complete characters go out, the bytes of an open one are held.

    The state is the held bytes (three at most). They say how many bytes the character has and which may come next.
    """

    def __init__(self):
        self.held = b""

    @staticmethod
    def open_tail(data: bytes) -> int:
        """How many bytes at the end begin a character that is not finished."""
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte >= 0xC0:
                need = 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4
                low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(byte, (0x80, 0xBF))
                valid = 0xC2 <= byte <= 0xF4 and (back == 1 or low <= data[1 - back] <= high)
                return back if valid and back < need else 0
            if byte < 0x80:
                return 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.held + data
        tail = self.open_tail(data)
        self.held = data[len(data) - tail:]
        return data[:len(data) - tail].decode("utf-8", "replace")

    def end(self) -> str:
        left, self.held = self.held, b""
        return left.decode("utf-8", "replace")


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 token and rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _named(ranks: dict[bytes, int], pattern: str) -> str:
    """One name for one rank table and pattern: a worker that serves several jobs keeps one codec, not one for each."""
    digest = hashlib.sha256(pattern.encode())
    for token, rank in ranks.items():
        digest.update(b"%d:%d:%b" % (rank, len(token), token))
    return digest.hexdigest()


def with_ids(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str = "text", into: str = "ids") -> DataFrame:
    """Documents with the ids of their texts."""
    workers.small_batches(docs.sparkSession)
    shared, name = docs.sparkSession.sparkContext.broadcast(ranks), _named(ranks, pattern)

    @F.pandas_udf("array<int>")
    def encoded(texts: pd.Series) -> pd.Series:
        codec = workers.once(name, lambda: Codec(shared.value, pattern))
        with workers.no_cycles():
            return pd.Series([codec.encode(t) for t in texts], dtype=object)

    return docs.withColumn(into, encoded.asNondeterministic()(F.col(text_col)))


def with_text(ids: DataFrame, ranks: dict[bytes, int], pattern: str, ids_col: str = "ids", into: str = "text") -> DataFrame:
    """Rows with the text that their ids stand for."""
    workers.small_batches(ids.sparkSession)
    shared, name = ids.sparkSession.sparkContext.broadcast(ranks), _named(ranks, pattern)

    @F.pandas_udf("string")
    def decoded(rows: pd.Series) -> pd.Series:
        codec = workers.once(name, lambda: Codec(shared.value, pattern))
        return pd.Series([codec.decode([] if r is None else r) for r in rows], dtype=object)

    return ids.withColumn(into, decoded.asNondeterministic()(F.col(ids_col)))


def round_trips(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """Per document: n_tokens, ids_sha256, decoded_sha256. Ids stay in the worker; only digests leave it."""
    workers.small_batches(docs.sparkSession)
    shared, name = docs.sparkSession.sparkContext.broadcast(ranks), _named(ranks, pattern)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digested(texts: pd.Series) -> pd.DataFrame:
        codec = workers.once(name, lambda: Codec(shared.value, pattern))
        rows = []
        with workers.no_cycles():
            for text in texts:
                ids = codec.encode(text)
                written, read = hashlib.sha256(codec.listed(ids).encode()), hashlib.sha256()
                for piece in codec.decode_stream(ids):
                    read.update(piece.encode("utf-8", "surrogatepass"))
                rows.append((len(ids), written.hexdigest(), read.hexdigest()))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    found = docs.select("doc_id", digested.asNondeterministic()("text").alias("d"))
    return found.select("doc_id", "d.*")


def encoded(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """Per document: doc_id, ids, n_tokens, and whether decoding the ids gives the text again (null counts as empty)."""
    workers.small_batches(docs.sparkSession)
    shared, name = docs.sparkSession.sparkContext.broadcast(ranks), _named(ranks, pattern)

    @F.pandas_udf("ids array<int>, n_tokens long, round_trip boolean")
    def both_ways(texts: pd.Series) -> pd.DataFrame:
        codec = workers.once(name, lambda: Codec(shared.value, pattern))
        rows = []
        with workers.no_cycles():
            for text in texts:
                ids = codec.encode(text)
                rows.append((ids, len(ids), codec.decode(ids) == (text or "")))
        return pd.DataFrame(rows, columns=["ids", "n_tokens", "round_trip"])

    return docs.select("doc_id", both_ways.asNondeterministic()("text").alias("d")).select("doc_id", "d.*")
