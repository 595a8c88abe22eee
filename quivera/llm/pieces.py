"""SentencePiece encoding and decoding as weighted finite-state transduction.

``compile_model`` turns a model file into a weighted machine of three parts that are composed with each input:

* the normaliser, a one-state transducer with an arc per rewriting rule (the longest source string wins; any other
  character passes), then blanks as U+2581 and a dummy prefix;
* an arc per piece, from an automaton over all pieces and user-defined symbols;
* byte fallback, an arc for each character without a piece, which gives the pieces of its bytes (or the unknown
  piece).

The composition is a lattice over the normalised characters. The encoding is its shortest path in the tropical
semiring: weights add along a path, the least total wins, and positions are relaxed from left to right.

* Unigram models: an arc weighs minus its piece's score.
* BPE models: arcs weigh nothing and pairs of neighbouring arcs have a weight, 0 or infinity: a piece may follow
  another only if merging their joint text gives back just these two. A merge inside a piece does not depend on
  its neighbours until one crosses a border, so a sequence is the BPE encoding if and only if each neighbouring pair
  is. The prefix of a text has one encoding, so a position has one state of finite weight, which is all that the
  relaxation keeps.

Inputs are cut where no piece holds the two characters at the cut, which no path crosses; ids of short stretches
between cuts are kept in a memory of a bounded number of bytes for words that come again. Decoding is the inverse
transduction.

Defined results: null and empty texts have no tokens, and an empty table gives an empty one; of paths of equal
weight the one whose last arc begins first wins (of equal merges the leftmost comes first); a text of any length is
whole; rows repeated get equal tokens; ids outside the model raise an error; input columns named like a new one are
replaced. User-defined symbols are pieces of their own wherever they stand, the longest first.
"""

from __future__ import annotations

import gc
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ensure_importable, give_back, map_texts

#: Where the box keeps public tokenizers; a parameter of every operator here.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Fixed values of the format: the sign for a blank, piece types, model types, what an unknown piece decodes to.
BLANK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
UNKNOWN_TEXT = " ⁇ "
#: A unigram model's penalty for an unknown character, below its least score.
UNKNOWN_PENALTY = 10.0
#: Bytes of stretches and their ids kept by a task, in two generations; a stretch of more characters is not kept.
KEPT_BYTES = 48 << 20
KEPT_LENGTH = 32
#: Pairs of pieces whose weight a worker keeps (some 30 MB), in two generations.
KEPT_PAIRS = 300_000
#: Where stretches are looked for by pattern; of longer ones than DIRECT characters all cuts are found.
PUNCTUATION = ".,;:!?\"'()"
DIRECT = 24
#: Characters of a text that are cut into stretches at once.
WINDOW = 1 << 16
INFINITY = float("inf")


@dataclass(frozen=True)
class Model:
    """What a model file says, small enough to travel with the tasks (bounded by the vocabulary and the rules)."""

    pieces: tuple[tuple[str, float, int], ...]
    kind: int
    dummy_prefix: bool
    remove_extra_blanks: bool
    byte_fallback: bool
    unknown: int
    #: Rewriting rules of the normaliser besides that for blanks.
    rules: tuple[tuple[str, str], ...] = ()


def load_model(path: str = MODEL) -> Model:
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    norm, trained = proto.normalizer_spec, proto.trainer_spec
    if not norm.escape_whitespaces or trained.treat_whitespace_as_suffix:
        raise ValueError("only escaped blanks as prefixes are compiled")
    if trained.model_type not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models are compiled")
    unknown = next(i for i, p in enumerate(proto.pieces) if p.type == UNKNOWN)
    rules = charsmap_rules(proto.SerializeToString()) if norm.precompiled_charsmap else ()
    return Model(tuple((p.piece, p.score, p.type) for p in proto.pieces), trained.model_type, norm.add_dummy_prefix, norm.remove_extra_whitespaces, trained.byte_fallback, unknown, rules)


def charsmap_rules(model_proto: bytes) -> tuple[tuple[str, str], ...]:
    """The rewriting rules (source, target) of a model's compiled character map."""
    import sentencepiece

    return tuple(sentencepiece.SentencePieceNormalizer(model_proto=model_proto).decompile())


class Normaliser:
    """The transducer of rewriting rules: at each place the longest source string is rewritten."""

    def __init__(self, model: Model):
        self.dummy_prefix, self.remove_extra_blanks = model.dummy_prefix, model.remove_extra_blanks
        self.single = {ord(a): b for a, b in model.rules if len(a) == 1}
        user = [p for p, _, t in model.pieces if t == USER_DEFINED]
        longer = {a: b for a, b in model.rules if len(a) > 1} | {p: p for p in user}
        self.longer = None
        if longer:
            self.longer = ahocorasick.Automaton()
            for a, b in longer.items():
                self.longer.add_word(a, (len(a), b))
            self.longer.make_automaton()

    def rewrite(self, text: str) -> str:
        if self.longer is None:
            return text.translate(self.single) if self.single else text
        out, at = [], 0
        for last, (size, target) in self.longer.iter_long(text):
            out += [text[at : last + 1 - size].translate(self.single), target]
            at = last + 1
        return "".join([*out, text[at:].translate(self.single)])

    def __call__(self, text: str) -> str:
        text = self.rewrite(text)
        if self.remove_extra_blanks:
            text = re.sub(" +", " ", text).lstrip(" ")
        if not text:
            return ""
        text = BLANK * self.dummy_prefix + text.replace(" ", BLANK)
        return text.rstrip(BLANK) if self.remove_extra_blanks else text


class Transducer:
    """A compiled model. Arcs are named by their piece's id; a character without a piece by -1."""

    def __init__(self, model: Model):
        self.model = model
        self.normalise = Normaliser(model)
        matched = {p: (i, s) for i, (p, s, t) in enumerate(model.pieces) if t in (NORMAL, USER_DEFINED) and p}
        self.user = {i for i, (_, _, t) in enumerate(model.pieces) if t == USER_DEFINED}
        self.text = [p for p, _, _ in model.pieces]
        self.ids = {p: i for p, (i, _) in matched.items()}
        #: What merges make: user-defined symbols take no part in them.
        self.score = {p: s for p, (i, s) in matched.items() if i not in self.user}
        self.unknown_weight = UNKNOWN_PENALTY - min(self.score.values(), default=0.0)
        self.bytes = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(model.pieces) if t == BYTE}
        #: Neighbouring characters that some piece holds; elsewhere a text may be cut.
        self.held = {p[k : k + 2] for p in matched for k in range(len(p) - 1)}
        self.blanks_lead = not any(h[1] == BLANK != h[0] for h in self.held)
        self.rough = re.compile(self._stretches() if self.blanks_lead else "(?s).+")
        self.out = [self._decoded(p, t) for p, _, t in model.pieces]
        self.out_array = pa.array(self.out, pa.large_binary())
        self.known = {p for p in matched if len(p) == 1}
        #: The automaton of arcs by their ends: (id, characters, weight).
        self.automaton = ahocorasick.Automaton()
        lightest = max(self.score.values(), default=0.0)
        for p, (i, s) in matched.items():
            weight = 0.0 if model.kind == BPE else -s if i not in self.user else 0.1 - len(p) * lightest
            self.automaton.add_word(p, (i, len(p), weight))
        self.automaton.make_automaton()
        self.user_symbols = None
        if self.user:
            self.user_symbols = re.compile("|".join(re.escape(self.text[i]) for i in sorted(self.user, key=lambda i: -len(self.text[i]))))
        self.vocabulary = len(model.pieces)
        self.pairs: dict[int, bool] = {}
        self.older_pairs: dict[int, bool] = {}
        if model.kind == BPE:
            self._order_merges()
        self.forget()

    def _stretches(self) -> str:
        """A pattern of stretches: cut before blanks, and before punctuation that no piece holds with the character before it."""
        before: dict[str, set[str]] = {x: set() for x in "\n" + PUNCTUATION}
        for a, b in (h for h in self.held if h[1] in before):
            before[b].add(a)
        joined = [f"(?<=[{''.join(map(re.escape, sorted(c)))}]){re.escape(x)}" for x, c in before.items() if c]
        plain = f"[^{BLANK}{''.join(map(re.escape, before))}]*+"
        return f"(?:{BLANK}++|[^{BLANK}]){plain}" + (f"(?:(?:{'|'.join(joined)}){plain})*+" if joined else "")

    # ---- weights of pairs -------------------------------------------------------------------------------

    def _order_merges(self) -> None:
        """When each piece is merged (``time``, earliest first), its last merge (``halves``), and what needs ``merged``."""
        by_score = sorted((p for p in self.score if len(p) > 1), key=lambda p: -self.score[p])
        counts: dict[float, int] = {}
        for p in by_score:
            counts[self.score[p]] = counts.get(self.score[p], 0) + 1
        self.time = {p: k for k, p in enumerate(by_score)} | dict.fromkeys(self.known, -1)
        self.halves, self.unreached, self.odd = {}, set(), set()
        for p in by_score:
            halves = self._before_last_merge(p)
            if len(halves) != 2:
                self.unreached.add(p)
                continue
            self.halves[p] = (halves[0], halves[1])
            if counts[self.score[p]] > 1 or any(h in self.odd or self.time.get(h, p) is p or self.time[h] >= self.time[p] for h in halves):
                self.odd.add(p)

    def _before_last_merge(self, text: str) -> list[str]:
        """The symbols when no merge or a last one is left; two of them if merging reaches the piece."""
        symbols = list(text)
        while len(symbols) > 2 and (at := self._best(symbols)) >= 0:
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def _best(self, symbols: list[str]) -> int:
        best, at = -INFINITY, -1
        for k in range(len(symbols) - 1):
            score = self.score.get(symbols[k] + symbols[k + 1])
            if score is not None and score > best:
                best, at = score, k
        return at

    def _meet(self, left: str, right: str) -> bool:
        """Whether no merge crosses the border of two pieces: undo the later one's last merge, again and again.

        A crossing merge comes first if it is earlier than the merge just undone; of equals the leftmost is first.
        """
        time, halves, limit = self.time, self.halves, len(self.time)
        while True:
            crossing = time.get(left + right)
            if crossing is not None and crossing < limit:
                return False
            t1, t2 = time.get(left, -1), time.get(right, -1)
            if t1 > t2:
                limit, left = t1, halves[left][1]
            elif t2 >= 0:
                limit, right = t2 + 1, halves[right][0]
            else:
                return True

    def merged(self, text: str) -> list[str]:
        """Plain BPE of a short text: the best-scored neighbouring pair is merged first, the leftmost of equals."""
        symbols = list(text)
        while len(symbols) > 1 and (at := self._best(symbols)) >= 0:
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def _finite(self, before: int, arc: int) -> bool:
        """Whether the pair of arcs weighs 0 (else infinity) in a BPE model; ``before`` is -2 at a cut."""
        if arc == -1 or arc in self.user:
            return True
        piece = self.text[arc]
        if piece in self.unreached:
            return False
        if before < 0 or before in self.user:
            return piece not in self.odd or self.merged(piece) == [piece]
        left = self.text[before]
        if left in self.odd or piece in self.odd:
            return self.merged(left + piece) == [left, piece]
        return self._meet(left, piece)

    # ---- shortest path ----------------------------------------------------------------------------------

    def _arcs(self, text: str) -> Iterator[tuple[int, tuple[int, int, float]]]:
        """(last character, (id, characters, weight)) by ascending ends, with arcs for characters without a piece."""
        if self.known.issuperset(text):
            return self.automaton.iter(text)
        single = ((k, (-1, 1, self.unknown_weight)) for k, c in enumerate(text) if c not in self.known)
        return iter(sorted([*self.automaton.iter(text), *single], key=lambda arc: arc[0]))

    def shortest_path(self, text: str) -> list[int]:
        """Arcs of the path of least weight through the lattice of a text, by relaxing ends from left to right."""
        n, paired, pairs, vocabulary = len(text), self.model.kind == BPE, self.pairs, self.vocabulary
        weight, last, begins = [0.0] + [INFINITY] * n, [-2] * (n + 1), [0] * (n + 1)
        for end, (arc, size, arc_weight) in self._arcs(text):
            end += 1
            start = end - size
            total = weight[start] + arc_weight
            if total < weight[end]:
                if paired:
                    key = last[start] * vocabulary + arc
                    finite = pairs.get(key)
                    if finite is None:
                        finite, pairs = self._weigh(key, last[start], arc), self.pairs
                    if not finite:
                        continue
                weight[end], last[end], begins[end] = total, arc, start
        path, at = [], n
        while at:
            path.append(last[at])
            at = begins[at]
        path.reverse()
        return path

    def _weigh(self, key: int, before: int, arc: int) -> bool:
        """Whether a pair weighs 0, for pairs that ``pairs`` does not hold, where it is then kept."""
        finite = self.older_pairs.get(key)
        if finite is None:
            finite = self._finite(before, arc)
        if len(self.pairs) >= KEPT_PAIRS // 2:
            self.older_pairs, self.pairs = self.pairs, {}
        self.pairs[key] = finite
        return finite

    def _path_ids(self, text: str, path: list[int]) -> list[int]:
        """Ids of a path: a character without a piece falls back to its bytes, or to the unknown piece."""
        if -1 not in path:
            return path
        out: list[int] = []
        at = 0
        for arc in path:
            size = 1 if arc == -1 else len(self.text[arc])
            if arc != -1:
                out.append(arc)
            elif self.model.byte_fallback:
                out += [self.bytes[b] for b in text[at : at + 1].encode("utf-8", "replace")]
            elif not out or out[-1] != self.model.unknown:  # unknown characters in a row are one
                out.append(self.model.unknown)
            at += size
        return out

    # ---- texts -------------------------------------------------------------------------------------------

    def cuts(self, text: str) -> list[str]:
        held, parts, start = self.held, [], 0
        for k in range(1, len(text)):
            if text[k - 1 : k + 1] not in held:
                parts.append(text[start:k])
                start = k
        return [*parts, text[start:]]

    def _between_symbols(self, text: str) -> Iterator[str]:
        """The parts of a text between user-defined symbols, and the symbols."""
        at = 0
        for m in self.user_symbols.finditer(text):
            yield text[at : m.start()]
            yield m[0]
            at = m.end()
        yield text[at:]

    def _windows(self, text: str) -> Iterator[str]:
        """A text in parts that no stretch crosses, so that a long one's stretches are not all held at once."""
        at = 0
        while self.blanks_lead and len(text) - at > WINDOW:
            end = text.find(BLANK, at + WINDOW)
            while end > 0 and text[end - 1] == BLANK:
                end = text.find(BLANK, end + 1)
            if end < 0:
                break
            yield text[at:end]
            at = end
        yield text[at:]

    def _encode_stretch(self, text: str) -> bytes:
        """Ids of a stretch that was not kept."""
        made = self.older.get(text)
        if made is None:
            parts = self.cuts(text) if len(text) > DIRECT else (text,)
            if len(parts) > 1 and self.model.byte_fallback:
                made = b"".join([self.kept[p] for p in parts])
            else:  # unknown pieces in a row are one, also across cuts
                path = self.shortest_path(text) if len(parts) == 1 else [arc for p in parts for arc in self.shortest_path(p)]
                made = array("i", self._path_ids(text, path)).tobytes()
        if len(text) <= KEPT_LENGTH:
            self.kept[text] = made
            self.kept_bytes += 240 + len(text) + len(made)
        return made

    def encode_bytes(self, text: str) -> bytes:
        """Ids of a text as native 32-bit integers."""
        whole = self.normalise(text)
        out, split = [], self.user_symbols is not None
        for part in self._between_symbols(whole) if split else (whole,):
            if split and part in self.ids and self.ids[part] in self.user:
                out.append(array("i", [self.ids[part]]).tobytes())
                continue
            for window in self._windows(part):
                out.append(b"".join(map(self.kept.__getitem__, self.rough.findall(window))))
                if self.kept_bytes > KEPT_BYTES // 2:
                    self.older, self.kept, self.kept_bytes = self.kept, _Kept(self), 0
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), np.int32).tolist()

    def forget(self) -> None:
        """Free what was kept for words that come again; weights of pairs stay, they follow from the model alone."""
        self.kept, self.older, self.kept_bytes = _Kept(self), {}, 0

    @staticmethod
    def _decoded(piece: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        return b"" if kind == CONTROL else UNKNOWN_TEXT.encode() if kind == UNKNOWN else piece.replace(BLANK, " ").encode()

    def decode(self, ids: list[int]) -> str:
        """The inverse transduction; a byte that is no part of a character becomes U+FFFD."""
        if len(ids) and min(ids) < 0:
            raise IndexError("no such piece")
        return self._text_of(b"".join(map(self.out.__getitem__, ids)), ids)

    def decode_bytes(self, ids: bytes) -> str:
        """``decode`` of ids as native 32-bit integers, gathered by Arrow."""
        numbers = np.frombuffer(ids, np.int32)
        if len(numbers) and numbers.min() < 0:
            raise IndexError("no such piece")
        taken = self.out_array.take(pa.array(numbers))
        size = np.frombuffer(taken.buffers()[1], np.int64, count=len(numbers) + 1)[-1] if len(numbers) else 0
        return self._text_of(taken.buffers()[2].slice(0, int(size)).to_pybytes() if size else b"", numbers)

    def _text_of(self, raw: bytes, ids) -> str:
        if self.model.dummy_prefix or self.model.remove_extra_blanks:
            first = next((i for i in ids if self.model.pieces[i][2] != CONTROL), None)
            if first is not None and self.model.pieces[first][0].startswith(BLANK):
                raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return _by_characters(raw)


class _Kept(dict):
    """Ids of stretches, made when first asked for."""

    def __init__(self, transducer: Transducer):
        super().__init__()
        self.make = transducer._encode_stretch

    def __missing__(self, text: str) -> bytes:
        return self.make(text)


def _by_characters(raw: bytes) -> str:
    out, at = [], 0
    while at < len(raw):
        for size in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + size].decode())
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("\ufffd")
            at += 1
    return "".join(out)


_compiled: dict[Model, Transducer] = {}


def transducer(model: Model) -> Transducer:
    """The compiled model, once a Python worker."""
    if model not in _compiled:
        _compiled.clear()
        _compiled[model] = Transducer(model)
        gc.freeze()  # the machine stays: collections need not look at it again
    return _compiled[model]


def _ids_array(blobs: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(b) // 4 for b in blobs)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(blobs), np.int32)))


def encode(docs: DataFrame, model_path: str = MODEL, text: str = "text", keep: list[str] | None = None, decoded: str | None = None, round_trip: str | None = None) -> DataFrame:
    """``docs`` with ``token_ids`` and ``n_tokens``; with ``decoded``, also that column, the ids decoded again; with
    ``round_trip``, whether decoding gave the text back (U+2581 stands for a blank in the format and comes back as one)."""
    model = docs.sparkSession.sparkContext.broadcast(load_model(model_path))
    columns = {"token_ids": T.ArrayType(T.IntegerType()), "n_tokens": T.IntegerType()}
    columns |= ({decoded: T.StringType()} if decoded else {}) | ({round_trip: T.BooleanType()} if round_trip else {})

    def make():
        t = transducer(model.value)

        def work(texts):
            blobs, again, same = [], [], []
            for x in texts:
                whole = x.decode("utf-8", "replace") if x else ""
                blob = t.encode_bytes(whole)
                blobs.append(blob)
                if decoded or round_trip:
                    back = t.decode_bytes(blob)
                    same.append(back == whole.replace(BLANK, " "))
                    if decoded:
                        again.append(back)
            made = [_ids_array(blobs), pa.array(np.array([len(b) // 4 for b in blobs], np.int32))]
            return made + ([pa.array(again, pa.string())] if decoded else []) + ([pa.array(same, pa.bool_())] if round_trip else [])

        work.done = t.forget  # a worker that goes on to other tasks keeps the machine and its pairs alone
        return work

    return map_texts(docs, columns, make, text, keep)


def decode(rows: DataFrame, model_path: str = MODEL, ids: str = "token_ids", into: str = "decoded") -> DataFrame:
    """``rows`` with the text of their ids; null ids give a null text."""
    model = rows.sparkSession.sparkContext.broadcast(load_model(model_path))
    fields = [f for f in rows.schema.fields if f.name != into]
    schema = T.StructType([*fields, T.StructField(into, T.StringType())])
    ensure_importable(rows.sparkSession)

    def run(batches):
        t = transducer(model.value)
        for batch in batches:
            made = [None if x is None else t.decode(x) for x in batch.column(batch.schema.get_field_index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(f.name)) for f in fields] + [pa.array(made, pa.string())], names=[*[f.name for f in fields], into])
        give_back()

    return rows.mapInArrow(run, schema)


def round_trip_column(text: str, decoded: str) -> Column:
    """Whether decoding gave the text back, for rows with both."""
    return F.coalesce(F.col(decoded) == F.translate(F.col(text), BLANK, " "), F.col(text).isNull())
