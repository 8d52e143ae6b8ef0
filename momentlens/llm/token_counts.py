"""Token counts from compiled finite-state transducers.

A byte-level BPE tokenizer is two deterministic transducers in a row. The splitter reads characters and emits the ends of
pre-tokens; it has twelve states, so the effect of any piece of text is a map of twelve states, and the maps of all pieces
of a document compose by a parallel prefix scan. The merger reads the bytes of a pre-token; its transitions carry the
change of the number of tokens, and its states are compiled on first use.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from momentlens.llm.text import chunks, utf8

PIECE, _SETTLE = 256, 16
# Splitter states.
_START, _LETTERS, _NUMBERS, _OTHERS, _QUOTE, _QUOTE_R, _QUOTE_V, _QUOTE_L, _BLANK, _SPACE, _BLANKS, _SPACES = range(12)
# Character classes; _PAD leaves every state as it is.
_LETTER, _SDMT, _R, _V, _L, _E, _DIGIT, _SP, _WS, _APOS, _OTHER, _PAD = range(12)
# Unicode's white space besides the blank.
_WHITE = "\t\n\v\f\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_HERE, _BEFORE = 1, 2  # an end of a pre-token before this character, before the last one
#: At most so many compiled states and remembered pre-tokens; then compilation starts anew.
MOST_STATES, MOST_WORDS = 250_000, 600_000
# A place in a state: tokens more than now, plus a bias, above 20 bits of the last token there.
_BIAS, _NO_TOKEN, _NEVER = 512, (1 << 20) - 1, 1 << 60
_ZERO = _BIAS << 20 | _NO_TOKEN


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """(next state, ends) by class and state, for the splitting rule of byte-level BPE (contractions, words, numbers, signs, space)."""
    to, ends = np.zeros((12, 12), np.uint8), np.zeros((12, 12), np.uint8)
    fresh = {c: _LETTERS for c in range(6)} | {_DIGIT: _NUMBERS, _SP: _BLANK, _WS: _SPACE, _APOS: _QUOTE, _OTHER: _OTHERS}
    for c, s in fresh.items():
        to[c], ends[c] = s, _HERE
    letters = range(6)
    for c in letters:
        to[c, _LETTERS], ends[c, _LETTERS] = _LETTERS, 0
        for q in (_QUOTE_R, _QUOTE_V, _QUOTE_L):
            to[c, q], ends[c, q] = _LETTERS, _BEFORE
    for c in fresh:
        if c not in letters:
            for q in (_QUOTE_R, _QUOTE_V, _QUOTE_L):
                ends[c, q] = _BEFORE | _HERE
    for c, q in ((_E, _QUOTE_R), (_E, _QUOTE_V), (_L, _QUOTE_L)):
        to[c, q], ends[c, q] = _START, 0
    ends[_DIGIT, _NUMBERS] = 0
    for c in (_APOS, _OTHER):
        to[c, [_OTHERS, _QUOTE]], ends[c, [_OTHERS, _QUOTE]] = _OTHERS, 0
    for c, s in ((_SDMT, _START), (_R, _QUOTE_R), (_V, _QUOTE_V), (_L, _QUOTE_L)):
        to[c, _QUOTE], ends[c, _QUOTE] = s, 0
    for s, e in ((_BLANK, 0), (_BLANKS, _BEFORE)):  # a blank joins the next word
        for c in fresh:
            to[c, s], ends[c, s] = (_OTHERS if c == _APOS else fresh[c]), e
    for c in fresh:
        ends[c, _SPACES] = _BEFORE | _HERE
    for s in (_BLANK, _SPACE, _BLANKS, _SPACES):
        to[_SP, s], ends[_SP, s] = _BLANKS, 0
        to[_WS, s], ends[_WS, s] = _SPACES, 0
    to[_PAD], ends[_PAD] = np.arange(12), 0
    return to, ends


def character_classes(splits) -> np.ndarray:
    """The class of every code point, asked of the tokenizer's own splitting function (text -> start offsets).

    Between a letter and a digit, a letter starts no pre-token and a number doesn't end one.
    """
    table = np.full(0x110000, _OTHER, np.uint8)
    # beyond plane 3 no code point is a letter or number
    points = np.concatenate([np.arange(0x80, 0xD800), np.arange(0xF900, 0x40000)])
    for at in range(0, len(points), 20_000):
        part = points[at : at + 20_000]
        text = "".join(f"a{chr(c)}1" for c in part.tolist())
        begins = np.zeros(len(text), bool)
        begins[splits(text)] = True
        table[part[~begins[1::3]]] = _LETTER
        table[part[begins[1::3] & ~begins[2::3]]] = _DIGIT
    for c in _WHITE:
        table[ord(c)] = _WS
    for lo, hi, c in (("A", "Z", _LETTER), ("a", "z", _LETTER), ("0", "9", _DIGIT)):
        table[ord(lo) : ord(hi) + 1] = c
    for x, c in [*((x, _SDMT) for x in "sdmt"), ("r", _R), ("v", _V), ("l", _L), ("e", _E), (" ", _SP), ("'", _APOS)]:
        table[ord(x)] = c
    return table


def split_ends(code_points: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin in each of several texts: a flag for each character."""
    to, ends = _splitter()
    n = np.diff(offsets)
    pieces = -(-n // PIECE)
    total = int(pieces.sum())
    if not total:
        return np.zeros(len(code_points), bool)
    text = np.repeat(np.arange(len(n)), pieces)
    number = np.arange(total) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = offsets[:-1][text] + number * PIECE
    size = np.minimum(n[text] - number * PIECE, PIECE)
    classes = np.full((PIECE, total), _PAD, np.uint8)
    where = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
    column = np.repeat(np.arange(total), size)
    row = where - begin[column]
    classes[row, column] = table[code_points[where]]
    # the state map of each piece; nearly all are constant after a few characters and go on in one lane
    flat = to.reshape(-1)
    maps = np.repeat(np.arange(12, dtype=np.uint8)[:, None], total, axis=1)
    for step in range(_SETTLE):
        maps = flat[classes[step].astype(np.int16) * 12 + maps]
    settled = (maps == maps[0]).all(axis=0)
    one, many = np.flatnonzero(settled), np.flatnonzero(~settled)
    state, open_maps = maps[0, one], maps[:, many]
    for step in range(_SETTLE, PIECE):
        state = flat[classes[step, one].astype(np.int16) * 12 + state]
        if len(many):
            open_maps = flat[classes[step, many].astype(np.int16) * 12 + open_maps]
    maps[:, one], maps[:, many] = state, open_maps
    # prefix scan inside each text: compose with the map that ends where this one begins
    scan, reach = maps.T.copy(), 1
    while reach < int(pieces.max()):
        joined = np.flatnonzero(number >= reach)
        scan[joined] = np.take_along_axis(scan[joined], scan[joined - reach], axis=1)
        reach *= 2
    state = np.full(total, _START, np.uint8)
    later = np.flatnonzero(number > 0)
    state[later] = scan[later - 1, _START]
    # the emissions, now that each piece's first state is known
    emitted = np.zeros((PIECE, total), np.uint8)
    flat_ends = ends.reshape(-1)
    for step in range(PIECE):
        index = classes[step].astype(np.int16) * 12 + state
        emitted[step] = flat_ends[index]
        state = flat[index]
    got = emitted[row, column]
    out = np.zeros(len(code_points) + 1, bool)
    out[where] = (got & _HERE) > 0
    out[where[(got & _BEFORE) > 0] - 1] = True
    last = np.flatnonzero(np.append(number[1:] == 0, True))
    half = last[np.isin(state[last], (_QUOTE_R, _QUOTE_V, _QUOTE_L))]
    out[begin[half] + size[half] - 1] = True
    return out[:-1]


def _byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merger:
    """Counts the tokens of a pre-token in one pass over its bytes.

    After each byte the last token of the text so far is the only token that may follow the last token before it. A
    state holds, for each distance back that a token of the vocabulary could still span, the last token there and the
    difference in the number of tokens; that is finite, and all later behaviour follows from it.
    """

    def __init__(self, spec: dict):
        names = _byte_names()
        raw = lambda token: bytes(names[c] for c in token)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.token = {raw(t): i for i, t in enumerate(t for t in spec["model"]["vocab"] if all(c in names for c in t))}
        self.prefixes = {t[:i] for t in self.token for i in range(len(t) + 1)}
        self.special = [t["content"].encode() for t in spec.get("added_tokens", ())]
        #: rank of the merge of two tokens, and the merge that makes a token
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for i, (a, b) in enumerate(merges):
            x, y = self.token[raw(a)], self.token[raw(b)]
            self.rank[x, y] = i
            self.made.setdefault(self.token[raw(a) + raw(b)], (i, x, y))
        self.sides: tuple[dict, dict] = ({}, {})
        self.reset()

    def reset(self) -> None:
        self.states = [(b"", (_ZERO,))]
        self.number = {self.states[0]: 0}
        self.moves: list[dict[int, tuple[int, int]]] = [{}]
        self.pairs: dict[int, bool] = {}

    def _side(self, token: int, right: bool) -> list[tuple[int, int]]:
        """The tokens that stand at one side of a token while it is merged, with the rank at which each is taken up."""
        got = self.sides[right].get(token)
        if got is None:
            got, now, till = [], token, _NEVER
            while True:
                got.append((now, till))
                if now not in self.made:
                    break
                till, *parts = self.made[now]
                now = parts[right]
            self.sides[right][token] = got
        return got

    def _fits(self, a: int, b: int) -> bool:
        """Whether b can follow a: no merge across their border comes before the merges beside it (left ones first)."""
        key = a << 20 | b
        got = self.pairs.get(key)
        if got is None:
            rank, got = self.rank, True
            for x, x_till in self._side(a, True):
                for y, y_till in self._side(b, False):
                    r = rank.get((x, y))
                    if r is not None and r < x_till and r <= y_till:
                        got = False
                        break
                if not got:
                    break
            self.pairs[key] = got
        return got

    def _compile(self, state: int, byte: int) -> tuple[int, int]:
        context, back = self.states[state]
        text = context + bytes((byte,))
        size = len(text)
        for k in range(size):  # the longest token that may come last
            token = self.token.get(text[k:])
            if token is not None:
                before = back[size - k - 1]
                last = before & _NO_TOKEN
                if last == _NO_TOKEN or self._fits(last, token):
                    break
        else:
            raise ValueError(f"no token ends in {text!r}")
        delta = 1 - ((before >> 20) - _BIAS)
        while text not in self.prefixes:
            text = text[1:]
        shift = delta << 20
        new = (text, (_BIAS << 20 | token, *[x + shift for x in back[: len(text)]]))
        number = self.number.get(new)
        if number is None:
            number = self.number[new] = len(self.states)
            self.states.append(new)
            self.moves.append({})
        self.moves[state][byte] = found = (number, delta)
        return found

    def count(self, word: bytes) -> int:
        if len(self.states) > MOST_STATES:
            self.reset()
        moves = self.moves
        state = n = 0
        for byte in word:
            move = moves[state].get(byte) or self._compile(state, byte)
            state = move[0]
            n += move[1]
        return n


class _Remembered(dict):
    def __init__(self, merger: Merger):
        super().__init__()
        self.merger = merger

    def __missing__(self, word: bytes) -> int:
        if len(self) > MOST_WORDS:
            self.clear()
        n = self.merger.count(word)
        if len(word) <= 64:
            self[word] = n
        return n


class Counter:
    """Token counts of texts for one tokenizer file."""

    def __init__(self, spec: str, table: np.ndarray):
        self.table = table
        self.merger = Merger(json.loads(spec))
        self.seen = _Remembered(self.merger)
        some = sorted(self.merger.special, key=len, reverse=True)
        self.special = re.compile(b"|".join(map(re.escape, some))) if some else None

    def counts(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        raw = buf.tobytes()
        extra = np.zeros(len(offsets) - 1, np.int64)
        cuts, owner = offsets, np.arange(len(extra))
        if self.special and (found := [m.span() for d in range(len(extra)) for m in self.special.finditer(raw, offsets[d], offsets[d + 1])] if self.special.search(raw) else []):
            # special strings are tokens of their own and part the text around them
            spans = np.array(found)
            doc = np.searchsorted(offsets, spans[:, 0], "right") - 1
            extra = np.bincount(doc, minlength=len(extra))
            bounds = np.unique(np.concatenate([offsets, spans.reshape(-1)]))
            mine = ~np.isin(bounds[:-1], spans[:, 0])
            cuts, owner = bounds, np.searchsorted(offsets, bounds[:-1], "right") - 1
        else:
            mine = np.ones(len(extra), bool)
        at = np.flatnonzero((buf & 0xC0) != 0x80)  # first bytes of characters
        points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        begin = at[split_ends(points, np.searchsorted(at, cuts), self.table)]
        end = np.append(begin[1:], len(buf))[: len(begin)]  # none where all texts are empty
        part = np.searchsorted(cuts, begin, "right") - 1
        n = np.fromiter(map(self.seen.__getitem__, [raw[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]), np.int64, len(begin))
        n[~mine[part]] = 0
        return extra + np.bincount(owner[part], n, len(extra)).astype(np.int64)


_counters: dict[int, Counter] = {}


def class_table(spec: str) -> np.ndarray:
    from tokenizers import Tokenizer

    split = Tokenizer.from_str(spec).pre_tokenizer.pre_tokenize_str
    return character_classes(lambda text: [a for _, (a, _) in split(text)])


def count_tokens(docs: DataFrame, tokenizer_file: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs``; a null text counts as empty, repeated rows each.

    Reads a byte-level BPE file without normaliser. No shuffle; a text is counted whole, whatever its length.
    """
    with open(tokenizer_file, encoding="utf-8") as f:
        spec = f.read()
    shared = docs.sparkSession.sparkContext.broadcast((spec, class_table(spec)))

    def run(batches):
        key = hash(shared.value[0])
        if key not in _counters:
            _counters.clear()
            _counters[key] = Counter(*shared.value)
        counter = _counters[key]
        for batch in batches:
            buf, offsets = utf8(batch["text"])
            found = [counter.counts(b, o) for _, _, b, o in chunks(buf, offsets)]
            n = np.concatenate(found) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(np.diff(offsets)), pa.array(n)], ["doc_id", "n_bytes", "n_tokens"])

    schema = docs.select("doc_id").schema.add("n_bytes", "long").add("n_tokens", "long")
    return docs.select("doc_id", "text").mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)
