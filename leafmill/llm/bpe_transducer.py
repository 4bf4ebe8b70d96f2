"""Byte-level BPE encoding and decoding by a lazily determinised finite-state transducer.

A token sequence is the BPE encoding of its bytes exactly when each pair of
neighbours is the encoding of the two tokens' bytes.  So an automaton may guess
where tokens end: its states pair the last finished token with the bytes of a
token in progress, and an end is allowed where the pair of tokens agrees.
:class:`Transducer` runs this automaton by subsets, made when first needed and
kept: a state holds all guesses that are still possible, and what they agree on
is emitted at once, so output lags by a bounded lookahead (a guess dies once its
bytes begin no token).  Tables are flushed at a fixed size; results don't depend
on that.

Decoding streams: a UTF-8 automaton, lifted from bytes to tokens (a token moves it
from state to state), says which bytes of a chunk make whole characters; a cut
character's wait for the next chunk.

Cases: null and empty texts have no tokens; texts of any length are encoded
whole, in one pass; equal texts have equal results; rows may repeat.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache
from itertools import chain

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import map_text, table

#: Entries at which a worker's tables (states, pieces) are flushed; pieces have a younger and an older table of that size.
MAX_STATES, MAX_PIECES, MAX_PIECE_CHARS = 300_000, 700_000, 48
#: A rank after all others.
NEVER = 1 << 60
#: The guess before any input.
START = (((), 0),)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class State:
    __slots__ = ("context", "end", "guesses", "next")

    def __init__(self, context: int, guesses: tuple) -> None:
        self.context = context  # the last token emitted, if some guess has finished none since; else -1
        self.guesses = guesses  # pairs: tokens finished but not emitted, trie node of a token in progress
        self.next: dict[int, tuple[State, tuple[int, ...]]] = {}
        self.end: tuple[int, ...] | None = None


class Transducer:
    """Encodes byte strings by ``ranks``; one instance for a worker."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES) -> None:
        self.ranks, self.max_states = ranks, max_states
        self.tokens = {i: t for t, i in ranks.items()}
        self.child: dict[int, int] = {}  # node << 8 | byte -> node
        self.token = [-1]
        for t, i in ranks.items():
            node = 0
            for byte in t:
                if (to := self.child.get(node << 8 | byte)) is None:
                    to = self.child[node << 8 | byte] = len(self.token)
                    self.token.append(-1)
                node = to
            self.token[node] = i
        self.edges: dict[int, tuple[list, list]] = {}
        self.shift = max(ranks.values(), default=0).bit_length()  # of the left token in a key of ``agree``
        self.agree: dict[int, bool] = {}
        self.flush()

    def flush(self) -> None:
        self.states: dict[tuple, State] = {}
        self.start = State(-1, START)
        self.start.end = ()
        # Tables of this size make the collector's passes dear; it has work only after a flush.
        gc.set_threshold(1_000_000, 50, 1000)
        gc.collect()

    def edge(self, token: int) -> tuple[list, list]:
        """How the first and the last symbol grow while BPE makes this token: pairs of a symbol and the rank that joins it."""
        if (known := self.edges.get(token)) is None:
            parts = [self.tokens[token][i : i + 1] for i in range(len(self.tokens[token]))]
            first, last = [], []
            while len(parts) > 1:
                rank, at = min((self.ranks.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
                if rank == NEVER:
                    break
                if at == 0:
                    first.append((parts[0], rank))
                if at == len(parts) - 2:
                    last.append((parts[-1], rank))
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            whole = NEVER if len(parts) == 1 else -1
            self.edges[token] = known = [*first, (parts[0], whole)], [*last, (parts[-1], whole)]
        return known

    def agrees(self, left: int, right: int) -> bool:
        """Whether these neighbours (left -1: none) are what BPE makes of their bytes.

        Ranks are met in rising order, so it is enough to follow the symbols on
        both sides of the border: the pair stays apart unless the border's rank
        comes before the ranks that join its symbols inwards.
        """
        key = left << self.shift | right
        if (known := self.agree.get(key)) is None:
            first = self.edge(right)[0]
            known = first[-1][1] == NEVER
            if known and left >= 0:
                last = self.edge(left)[1]
                i = j = 0
                while True:
                    (x, inner), (y, after) = last[i], first[j]
                    border = self.ranks.get(x + y, NEVER)
                    if border < inner and border <= after:
                        known = False
                        break
                    if inner == NEVER and after == NEVER:
                        break
                    if inner <= after:
                        i += 1
                    else:
                        j += 1
            if len(self.agree) >= 2 * self.max_states:
                self.agree.clear()
            self.agree[key] = known
        return known

    def ended(self, state: State) -> tuple[int, ...]:
        """Tokens still to come if the input ends here: those of the one guess whose last token is whole."""
        if (end := state.end) is None:
            token, agree, shift = self.token, self.agree, self.shift
            for done, node in state.guesses:
                if (t := token[node]) >= 0:
                    left = done[-1] if done else state.context
                    if (ok := agree.get(left << shift | t)) is None:
                        ok = self.agrees(left, t)
                    if ok:
                        state.end = end = (*done, t)
                        break
        return end

    def grow(self, state: State, byte: int) -> tuple[State, tuple[int, ...]]:
        """Make the transition of ``state`` on ``byte``."""
        child, guesses = self.child, []
        for done, node in state.guesses:
            if (to := child.get(node << 8 | byte)) is not None:
                guesses.append((done, to))
        if state is not self.start and state.guesses != START:
            guesses.append((self.ended(state), child[byte]))
        context, out = state.context, ()
        shared = guesses[0][0]
        if len(guesses) == 1:
            if shared:
                out, context, guesses = shared, shared[-1], [((), guesses[0][1])]
        elif shared:
            n = 0
            for n, t in enumerate(shared):  # noqa: B007
                for d, _ in guesses:
                    if len(d) <= n or d[n] != t:
                        break
                else:
                    continue
                break
            else:
                n = len(shared)
            if n:
                out, context = shared[:n], shared[n - 1]
                guesses = [(d[n:], node) for d, node in guesses]
            if guesses[0][0]:
                for d, _ in guesses:
                    if not d:
                        break
                else:
                    context = -1
        rest = tuple(guesses)
        key = (context, rest)
        if (to := self.states.get(key)) is None:
            if len(self.states) >= self.max_states:
                self.flush()
            to = self.states[key] = State(context, rest)
        state.next[byte] = move = (to, out)
        return move

    def encode(self, piece: bytes) -> tuple[int, ...]:
        """Identifiers of one piece, in time linear in its length; a piece that is itself a token stays whole."""
        if (whole := self.ranks.get(piece)) is not None:
            return (whole,)
        out: list[int] = []
        state, grow = self.start, self.grow
        for byte in piece:
            state, emitted = state.next.get(byte) or grow(state, byte)
            if emitted:
                out.extend(emitted)
        return (*out, *self.ended(state))


class Pieces(dict):
    """Identifiers of pieces of text, from the transducer, kept for pieces that come again."""

    def __init__(self, transducer: Transducer) -> None:
        super().__init__()
        self.transducer, self.old = transducer, {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if (ids := self.old.get(piece)) is None:
            ids = self.transducer.encode(piece.encode())
        if len(piece) <= MAX_PIECE_CHARS:
            if len(self) >= MAX_PIECES:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids


@lru_cache(maxsize=2)
def worker_pieces(path: str) -> Pieces:
    """The tables of one worker process, which keeps them from task to task."""
    return Pieces(Transducer(load_ranks(path)))


# -- UTF-8 ------------------------------------------------------------------

#: States of the UTF-8 automaton: how many continuation bytes are due, and the limits of the first of them.
ACCEPT, REJECT = 0, 8


def utf8_step(state: int, byte: int) -> int:
    """The next state: 0 whole, 1-3 continuations due, 4-7 one of them limited (after E0, ED, F0, F4), 8 wrong."""
    if state == ACCEPT:
        if byte < 0x80:
            return 0
        if 0xC2 <= byte <= 0xDF:
            return 1
        if 0xE0 <= byte <= 0xEF:
            return {0xE0: 4, 0xED: 5}.get(byte, 2)
        if 0xF0 <= byte <= 0xF4:
            return {0xF0: 6, 0xF4: 7}.get(byte, 3)
        return REJECT
    low, high, to = {1: (0x80, 0xBF, 0), 2: (0x80, 0xBF, 1), 3: (0x80, 0xBF, 2), 4: (0xA0, 0xBF, 1), 5: (0x80, 0x9F, 1), 6: (0x90, 0xBF, 2), 7: (0x80, 0x8F, 2)}.get(state, (1, 0, 0))
    return to if low <= byte <= high else REJECT


class Moves(dict):
    """The automaton's moves from one state, by token, made when first needed."""

    def __init__(self, state: int, tokens: dict[int, bytes]) -> None:
        super().__init__()
        self.state, self.tokens = state, tokens

    def __missing__(self, token: int) -> int:
        state = self.state
        for byte in self.tokens[token]:
            state = utf8_step(state, byte)
        self[token] = state
        return state


class Decoder:
    """Streaming decoder: tokens in, whole characters out; bytes of a cut character wait for the next tokens."""

    def __init__(self, tokens: dict[int, bytes]) -> None:
        self.tokens = tokens
        self.moves = [Moves(s, tokens) for s in range(REJECT + 1)]

    def stream(self, chunks: Iterable[Sequence[int]]) -> Iterator[bytes]:
        """UTF-8 of each chunk of tokens as soon as its characters are whole; ``ValueError`` if the bytes aren't UTF-8."""
        state, moves, token, held = ACCEPT, self.moves, self.tokens.__getitem__, b""
        for chunk in chunks:
            for i in chunk:
                state = moves[state][i]
            if state == REJECT:
                raise ValueError("the tokens' bytes aren't UTF-8")
            out, held = held + b"".join(map(token, chunk)), b""
            if state != ACCEPT:  # the bytes from the last one that begins a character wait
                cut = next(k for k in range(len(out) - 1, -1, -1) if out[k] & 0xC0 != 0x80)
                out, held = out[:cut], out[cut:]
            yield out
        if held:
            raise ValueError("the tokens end inside a character")

    def decode(self, ids: Sequence[int], chunk: int = 4096) -> Iterator[bytes]:
        """The bytes of a whole sequence, streamed in chunks of tokens."""
        return self.stream(ids[at : at + chunk] for at in range(0, len(ids), chunk))


# -- columns ---------------------------------------------------------------

ENCODED = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType()))])
DIGESTS = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


def encode_texts(df: DataFrame, keep: list[str], text_col: str, path: str, pattern: str) -> DataFrame:
    """Identifiers of each text; every match of ``pattern`` is encoded by itself."""

    def start():
        import regex

        pieces, split = worker_pieces(path), regex.compile(pattern)

        def work(texts):
            return [[[i for p in split.findall(t or "") for i in pieces[p]] for t in texts]]

        return work

    return map_text(df, start, text_col, keep, ENCODED)


def round_trip(df: DataFrame, keep: list[str], text_col: str, path: str, pattern: str) -> DataFrame:
    """Encode each text, decode its identifiers again, and give digests of both."""

    def start():
        import regex

        pieces, split = worker_pieces(path), regex.compile(pattern)
        tokens = pieces.transducer.tokens
        decoder, decimal = Decoder(tokens), {i: str(i) for i in tokens}

        def one(text):
            ids = list(chain.from_iterable(map(pieces.__getitem__, split.findall(text or ""))))
            back = hashlib.sha256()
            for part in decoder.decode(ids):
                back.update(part)
            return len(ids), hashlib.sha256(" ".join(map(decimal.__getitem__, ids)).encode()).hexdigest(), back.hexdigest()

        return lambda texts: list(zip(*map(one, texts))) or [[]] * 3

    return map_text(df, start, text_col, keep, DIGESTS)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` encoded by the public ranks and decoded again."""
    import public_tokenizers as public

    return round_trip(table(spark, sf_dir, "documents"), ["doc_id"], "text", public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
